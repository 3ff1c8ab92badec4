"""Stupid-backoff language-model scores, computed relationally.

The n-gram count table is partitioned by hash. Documents' n-grams are exploded, dealt to the partition
of their hash, joined there to the counts, and the logarithms are summed per document. So that the
rows stay few, n-grams travel packed: one row holds the sorted hashes of all distinct n-grams that one
batch of documents has in one partition, and the counts come back in the same order. A batch has rows
only for partitions it has n-grams in, so the rows are never more than the distinct n-grams of batches.

A document is scored against the rest of the corpus: its own n-grams are taken from the counts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_planes, materialise, mix, planes, slices, text_bytes, text_or_empty
from .substring_dedup import word_hashes, words_of

#: Bytes of text in a batch; bytes of text for each partition of the count table; batches in a task that scores.
BATCH_BYTES, PART_BYTES, TASK_BATCHES = 5 << 20, 8 << 20, 4
#: Bits of a hash beside its partition's number, which adds its bits: of 10^9 n-grams in 256 partitions, about one in 10^7 shares both with another.
HASH_BITS, HASH_BYTES = 44, 6


def gram_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words up to each word; 0 where the document has fewer."""
    h = np.zeros(len(words), np.uint64)
    if len(words) < n:
        return h
    x = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    x = mix(x + np.uint64(n))
    h[n - 1 :] = np.where(owner[n - 1 :] == owner[: len(words) - n + 1], x | np.uint64(1), 0)
    return h


class Batch:
    """The n-grams of a batch of texts: for each order, its distinct hashes sorted by (partition, hash)."""

    def __init__(self, text: pa.Array, order: int, parts: int):
        words, self.count = words_of(pc.ascii_lower(text))
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        hashed = word_hashes(words)
        self.gram = [gram_hashes(hashed, self.owner, n) for n in range(1, order + 1)]
        full = np.concatenate(self.gram)
        full = full[full > 0]
        # A hash's last bit is always set, so it takes no part.
        self.part = lambda h: (h >> np.uint64(1)) % np.uint64(parts)
        self.short = lambda h: (h >> np.uint64(1)) // np.uint64(parts) % np.uint64(1 << HASH_BITS)
        key, self.seen = np.unique(self.keyed(full), return_counts=True)
        self.key = key

    def keyed(self, h: np.ndarray) -> np.ndarray:
        """(partition, short hash) as one number that sorts by both."""
        return (self.part(h) << np.uint64(HASH_BITS)) | self.short(h)

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """The partitions in which the batch has n-grams, in order, and where each begins, with the end of the last."""
        part, first = np.unique(self.key >> np.uint64(HASH_BITS), return_index=True)
        return part.astype(np.int64), np.r_[first, len(self.key)]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents: (batch, words, blob), the blob with ids and texts."""
    import uuid

    import zstandard

    z = zstandard.ZstdCompressor(level=9)
    kept, size = [], 0

    def flush():
        table = pa.Table.from_batches(kept).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        words = sum(int(words_of(b.column(1))[1].sum()) for b in kept)
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([words], pa.int64()), pa.array([z.compress(sink.getvalue().to_pybytes())], pa.binary())], ["batch", "words", "blob"])

    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            kept.append(part)
            size += part.nbytes
            if size >= BATCH_BYTES:
                yield flush()
                size = 0
    if kept:
        yield flush()


def _texts(blob: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()


def _one(a) -> pa.Array:
    return a.chunk(0) if isinstance(a, pa.ChunkedArray) and a.num_chunks == 1 else pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def _explode(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for rows in batches:
            for batch, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                b = Batch(_one(_texts(blob).column("text")), order, parts)
                (part, cut), out = b.split(), []
                for i, p in enumerate(part.tolist()):
                    k, n = b.key[cut[i] : cut[i + 1]] & np.uint64((1 << HASH_BITS) - 1), b.seen[cut[i] : cut[i + 1]]
                    out.append((p, batch, z.compress(struct.pack("<q", len(k)) + planes(np.diff(k, prepend=np.uint64(0)), HASH_BYTES) + planes(n, 4))))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["part", "batch", "blob"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """One partition of the count table: adds up the n-grams of all batches and answers each batch in its order."""
    import zstandard

    d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    keys, seen = [], []
    for blob in table.column("blob").to_pylist():
        raw = d.decompress(blob)
        n = struct.unpack_from("<q", raw)[0]
        keys.append(np.cumsum(from_planes(raw[8 : 8 + n * HASH_BYTES], n, HASH_BYTES)))
        seen.append(from_planes(raw[8 + n * HASH_BYTES :], n, 4))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(seen)).astype(np.uint64)[at]
    ends = np.cumsum([len(k) for k in keys])
    answers = [z.compress(planes(t, 5)) for t in np.split(total, ends[:-1])]
    return pa.table([table.column("batch").combine_chunks(), table.column("part").combine_chunks(), pa.array(answers, pa.binary())], ["batch", "part", "counts"])


def log_scores(b: Batch, total: np.ndarray, corpus: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Sum over each text's words of the log stupid-backoff score, and the number of words that backed off to one word."""
    n_docs = len(b.count)
    own, rest = [], []
    for h in b.gram:
        at = np.flatnonzero(h)
        key = b.keyed(h[at])
        pos = np.searchsorted(b.key, key)
        _, inverse, n = np.unique(b.owner[at] * np.int64(len(b.key) + 1) + pos, return_inverse=True, return_counts=True)
        mine, all_ = np.zeros(len(h)), np.zeros(len(h))
        mine[at], all_[at] = n[inverse], total[pos]
        own.append(mine)
        rest.append(all_ - mine)  # counts without the document's own
    other = corpus - b.count[b.owner]
    score = np.where(rest[0] > 0, rest[0], 0.5) / np.maximum(other, 1)
    low = np.ones(len(score), bool)
    for n in range(2, len(b.gram) + 1):
        # the context of an n-gram that ends here is the (n-1)-gram that ends one word before
        context = np.r_[0.0, rest[n - 2][:-1]]
        met = rest[n - 1] > 0
        score = np.where(met, rest[n - 1] / np.maximum(context, 1), np.where(b.gram[n - 1] > 0, backoff * score, score))
        low &= ~met
    logs = np.log(score)
    return np.bincount(b.owner, weights=logs, minlength=n_docs), np.bincount(b.owner, weights=low, minlength=n_docs).astype(np.int64)


def lm_score(docs: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, log_score (sum of natural logs), mean_log_score, n_backed_off.

    Words are runs of bytes outside 0x20 and 0x09-0x0D, A-Z in lower case; contexts don't cross documents.
    A word's score is count(n-gram) / count(context) over all other documents for the longest n-gram they
    have, times `backoff` for each order given up; a single word has its share of their words, or half
    an occurrence if they have none. Texts without words (null too) score 0, mean null. Repeated rows are
    separate documents. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = int(max(64, text_bytes(base) // PART_BYTES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = materialise(base.mapInArrow(_gather, "batch long, words long, blob binary"), "text-batches")
    corpus, n_batches = batches.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    scorers = max(tasks, n_batches // TASK_BATCHES)
    grams = batches.select("batch", "blob").mapInArrow(_explode(order, parts), "part int, batch long, blob binary")
    counts = grams.repartition(max(tasks, parts // 4), "part").groupBy("part").applyInArrow(_count, "batch long, part int, counts binary")

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        table = _texts(left.column("blob")[0].as_py())
        b = Batch(_one(table.column("text")), order, parts)
        total, (part, cut), d = np.zeros(len(b.key)), b.split(), zstandard.ZstdDecompressor()
        at = np.searchsorted(part, right.column("part").to_numpy())
        for i, blob in zip(at.tolist(), right.column("counts").to_pylist()):
            total[cut[i] : cut[i + 1]] = from_planes(d.decompress(blob), int(cut[i + 1] - cut[i]), 5)
        sums, low = log_scores(b, total, corpus, backoff)
        return pa.table([_one(table.column("doc_id")), pa.array(b.count.astype(np.int64)), pa.array(sums), pa.array(low)], ["doc_id", "n_words", "log_score", "n_backed_off"])

    # As many tasks as batches need, so that none grows with the input.
    left, right = (t.repartition(scorers, "batch").groupBy("batch") for t in (batches.select("batch", "blob"), counts))
    out = left.cogroup(right).applyInArrow(score, "doc_id long, n_words long, log_score double, n_backed_off long")
    return out.select("doc_id", "n_words", "log_score", F.expr("log_score / nullif(n_words, 0)").alias("mean_log_score"), "n_backed_off")
