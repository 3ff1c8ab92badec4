"""Near-dedup of texts: candidates by SimHash and MinHash, verified by the similarity of word shingles.

Candidates are texts with a near fingerprint over single words (composite Golay keys), and texts that
share a band of MinHashes of their shingles (`BANDS` bands of `BAND_ROWS`). Fingerprints find scattered
edits, but few appended, cut or replaced blocks; bands depend on the similarity of the shingles alone
and miss a pair at 0.8 once in about 8 million, closer ones less often still. Fingerprints hang together
in components before documents are named, so copies of one passage cost one link each, whatever keys
they share. Candidates hang together in components, too; within one, exact Jaccard similarities of the
shingle sets decide. Jaccard distance is a metric, so a text close to a pivot needs no other
comparison, and texts of clusters with distant pivots need none; of the other pairs, those go first
whose shingles, counted by hash, can't meet often enough.

A component of more than GROUP texts or GROUP_BYTES of text is cut into blocks of half that size, and each
pair of blocks is decided in a task of its own. So each two texts of a component meet, and the links found
hang together over all blocks. The work on such a component grows with the square of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, materialise, may_match, mix, rows_per_batch, slices, text_key, text_or_empty
from .components import components
from .simhash import MOST_BITS, SLICE_BYTES, fingerprint_links, word_fingerprints
from .substring_dedup import word_hashes, words_of

BATCH_ROWS = 1000
BANDS, BAND_ROWS = 40, 5
GROUP, GROUP_BYTES = 20_000, 64 << 20


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; shorter texts are one shingle, empty ones none."""
    import pyarrow.compute as pc

    flat, counts = words_of(pc.ascii_lower(text))
    hashed, ends = word_hashes(flat), np.cumsum(counts)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        h = np.zeros(0 if a == b else max(1, b - a - words + 1), np.uint64)
        for k in range(min(words, b - a)):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashed[a + k : a + k + len(h)]
        out.append(np.unique(mix(h)))
    return out


def bands(sets: list[np.ndarray]) -> list[np.ndarray]:
    """BANDS hashes of each set, each over BAND_ROWS least values under hashing; empty sets have none."""
    salts = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    out = []
    for s in sets:
        low = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            np.minimum(low, np.multiply.outer(salts, s[i : i + 1024]).min(axis=1), out=low)
        key = np.arange(BANDS, dtype=np.uint64)
        for column in low.reshape(BANDS, BAND_ROWS).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
        out.append(key if len(s) else key[:0])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    met = len(np.intersect1d(a, b, assume_unique=True))
    return met / (len(a) + len(b) - met)


def hash_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles of each set by the low bits of their hash: the sum of two rows' minima is at least what they share."""
    width = 1 << min(12, max(8, int(np.median([len(s) for s in sets])).bit_length())) if sets else 1
    out = np.zeros((len(sets), width), np.int32 if max(map(len, sets), default=0) > 30_000 else np.int16)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width)
    return out


def similar_groups(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Least position that each set hangs together with over links of `least` similarity or more."""
    n, far, slack = len(sets), 1 - least, 1e-9
    root, size, counts = np.arange(n), np.array([len(s) for s in sets]), hash_counts(sets)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    def near(i: int, others: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of `others` that are `floor` or more similar to i, and how similar they are."""
        met = np.concatenate([np.minimum(counts[i], counts[others[k : k + 2048]]).sum(axis=1, dtype=np.int64) for k in range(0, len(others), 2048)]) if len(others) else size[:0]
        others = others[met >= floor * (size[i] + size[others] - met) - slack]
        exact = np.array([similarity(sets[i], sets[j]) for j in others.tolist()])
        return others[exact >= floor - slack], exact[exact >= floor - slack]

    left, pivots, members, away = np.arange(n), [], [], []
    while len(left):
        p = int(left[0])
        close, how = near(p, left, least)
        for i in close.tolist():
            join(p, i)
        pivots.append(p)
        members.append(close)
        away.append(1 - how)
        left = np.setdiff1d(left, close, assume_unique=True)
    every = np.array(pivots, np.int64)
    for x, p in enumerate(pivots):
        others, how = near(p, every[x + 1 :], max(0.0, 1 - 3 * far))
        for q, alike in zip(others.tolist(), how.tolist()):
            y = int(np.searchsorted(every, q))  # pivots ascend
            if find(p) == find(q):
                continue
            gap = 1 - alike - 2 * far - slack
            ends = members[y][away[y] >= gap]
            for i in members[x][away[x] >= gap].tolist():
                met, _ = near(i, ends, least)
                if len(met):
                    join(i, int(met[0]))
                    break
    return np.array([find(i) for i in range(n)])


def _print(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                keys = bands(shingle_sets(part.column(2), words))
                ends = np.cumsum([0] + [len(k) for k in keys])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(word_fingerprints(part.column(2), 1)[0].view(np.int64)), lists], ["doc_id", "key", "fp", "bands"])

    return run


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, keep_id) of each document that goes because a group that it is in keeps another.

    Groups hang together over links of `least` Jaccard similarity of `words`-word shingles (A-Z in lower
    case) among candidates. A document is an (id, text): rows that repeat both are one, an id with several
    texts is several. The least id of a group stays, a null one after all others, and of equal ids the
    text with the least `key` (`text_key`), which is also how the result names what goes. Empty texts are
    copies of each other. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    ids = base.select("doc_id", "key").distinct()
    if not ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        return _near_copies(base, words, least)
    # Some ids are null or stand for several texts: documents are numbered in order, and the numbers are their ids.
    order = [F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = materialise(ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()), "numbers")
    gone = _near_copies(base.select("key", "text").join(numbers, "key").select(F.col("number").alias("doc_id"), "key", "text"), words, least)
    named = gone.join(numbers.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    kept = numbers.select(F.col("number").alias("keep_id"), F.col("doc_id").alias("kept"))
    return named.join(kept, "keep_id").select(F.col("id").alias("doc_id"), "key", F.col("kept").alias("keep_id"))


def _near_copies(base: DataFrame, words: int, least: float) -> DataFrame:
    """`near_copies` of base (doc_id, key, text), whose ids are there and stand for one text each."""
    with rows_per_batch(base.sparkSession, BATCH_ROWS):
        printed = materialise(base.mapInArrow(_print(words), "doc_id long, key long, fp long, bands array<long>"), "word-fingerprints")
    total = printed.count()
    # Fingerprints: near ones hang together first; then each names the least document that has it.
    first = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    near = materialise(components(fingerprint_links(first, first.count(), MOST_BITS)).where("node <> root"), "fingerprint-groups")
    names = first.select("fp", "first")
    over = near.join(names.toDF("node", "u"), "node").join(names.toDF("root", "v"), "root").select("u", "v")
    same = join_counted(printed.select("doc_id", "fp"), first.where("n > 1"), "fp", "n", total, F.col("doc_id")).where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    # Bands: texts hang on the least of those that share one, however many they are.
    banded = printed.select("doc_id", F.explode("bands").alias("fp"))
    shared = materialise(banded.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared-bands")
    held = materialise(may_match(banded, shared.select(F.col("fp").alias("key")), F.col("fp")), "banded")
    met = join_counted(held, shared, "fp", "n", held.count(), F.col("doc_id")).where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    group = materialise(components(over.unionByName(same).unionByName(met)), "candidate-groups").toDF("doc_id", "root")
    for table in (printed, first, near, shared, held):
        discard(table)
    texts = may_match(base, group.select(F.xxhash64("doc_id").alias("key")), F.xxhash64("doc_id")).groupBy("doc_id").agg(F.min(F.struct("text", "key")).alias("one"))
    left = materialise(texts.join(group, "doc_id").select("doc_id", "one.key", "one.text", "root", F.octet_length("one.text").cast("long").alias("size")), "candidate-texts")
    over = F.greatest(F.count("*") / GROUP, F.sum("size") / GROUP_BYTES)
    blocks = F.when(over > 1, F.ceil(2 * over)).otherwise(1).cast("long")
    sizes = materialise(left.groupBy("root").agg(F.count("*").alias("n"), blocks.alias("blocks")), "group-sizes")
    whole = sizes.agg(F.max("blocks").alias("most"), F.sum("n").alias("n")).first()
    if (whole["most"] or 1) == 1:
        gone = materialise(left.groupBy("root").applyInArrow(_decide(words, least), "doc_id long, key long, keep_id long"), "near-copies")
        discard(left)
        return gone
    mine = join_counted(left, sizes, "root", "n", whole["n"], F.col("doc_id")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    # A block's own pairs are met with those of any other block; a component of one block has only itself.
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block OR blocks = 1")
    pairs = met.select("doc_id", "key", "text", "root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    found = materialise(pairs.groupBy("root", "x", "y").applyInArrow(_decide(words, least), "doc_id long, key long, keep_id long"), "near-copies")
    kept = components(found.select(F.col("doc_id").alias("u"), F.col("keep_id").alias("v"))).where("node <> root").toDF("doc_id", "keep_id")
    return kept.join(left.select("doc_id", "key"), "doc_id").select("doc_id", "key", "keep_id")


def _decide(words: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.select(["doc_id", "key", "text"]).sort_by("doc_id").combine_chunks()
        sets = [s for batch in table.to_batches() for part in slices(batch, "text", SLICE_BYTES) for s in shingle_sets(part.column(2), words)]
        root = similar_groups(sets, least)
        gone = root != np.arange(len(root))
        ids = table.column("doc_id").to_numpy()
        return pa.table([pa.array(ids[gone]), pa.array(table.column("key").to_numpy()[gone]), pa.array(ids[root[gone]])], ["doc_id", "key", "keep_id"])

    return run
