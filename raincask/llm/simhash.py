"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. The perfect Golay code of 23 bits decodes every
segment to one of 4096 codeword indices; a segment's keys are the indices of all words within one bit
of it, one or six of them, so that two segments at most two bits apart share a key (the word halfway
decodes to it). Four errors over three segments leave, by the pigeonhole principle, either
  - a segment without an error, and another with two at most: key = (that segment, one Golay key), or
  - an error or two in each: key = (a Golay key of each segment).
Fingerprints meet where they share a composite key and are verified by the bits in which they differ.

Only distinct fingerprints take part, so copies cost nothing. Keys travel packed, one blob a batch and
bucket. A bucket hands on a spanning forest of its verified links, never all pairs of a group.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_planes, give_back, join_counted, materialise, mix, planes, slices, text_or_empty
from .components import components
from .substring_dedup import word_hashes, words_of

SLICE_BYTES = 2 << 20
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
WIDTHS = (22, 21, 21)
MOST_BITS = 4
#: Fingerprints a batch; keys a bucket on average.
BATCH, BUCKET_KEYS = 2048, 1 << 18


# ---------------------------------------------------------------- fingerprints
def fingerprints(text: pa.Array, words: int) -> np.ndarray:
    """SimHash of each text: lower-cased A-Z, `words`-word shingles with repeats, XXH64 seed 42, strict majority."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    flat, counts = words_of(pc.ascii_lower(text))
    if not len(flat):
        return np.zeros(len(counts), np.uint64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_buffer().to_pybytes()
    offset = np.r_[0, np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64) + 1)]
    shingles = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    text_of = np.repeat(np.arange(len(counts)), shingles)
    first = (np.cumsum(counts) - counts)[text_of] + np.arange(len(text_of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + words, np.cumsum(counts)[text_of])
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(offset[first].tolist(), (offset[last] - 1).tolist())), np.uint64, len(first))
    return majority(hashes, shingles)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes; a text without any has none set."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    votes = np.zeros((len(full), 64), np.int64)
    step = 1 << 16  # hashes at a time: bits of each, summed by text
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(starts, i, "right") - 1, np.searchsorted(starts, i + len(bits), "left")
        votes[lo:hi] += np.add.reduceat(bits, np.maximum(starts[lo:hi] - i, 0), axis=0, dtype=np.int32)
    most = votes * 2 > counts[full][:, None]
    out[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def word_fingerprints(text: pa.Array, seeds: int) -> list[np.ndarray]:
    """One SimHash for each seed over the distinct words of each text, in lower case and without outer punctuation."""
    flat, counts = words_of(pc.utf8_lower(text))
    flat = pc.utf8_trim(flat, characters="".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~")
    if not len(flat):
        return [np.zeros(len(counts), np.uint64)] * seeds
    coded = flat.dictionary_encode()
    each = word_hashes(coded.dictionary)
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * np.int64(len(each)) + coded.indices.to_numpy())
    doc, code = pairs // len(each), pairs % len(each)
    n = np.bincount(doc, minlength=len(counts))
    return [majority(mix(each[code] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))), n) for k in range(seeds)]


def _fingerprint(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), words).view(np.int64))], ["doc_id", "fp"])

    return run


# ---------------------------------------------------------------- Golay keys
def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    x = x.astype(np.uint32, copy=True)
    for bit in range(22, 10, -1):
        x ^= np.where(x >> np.uint32(bit) & np.uint32(1), np.uint32(GOLAY << (bit - 11)), np.uint32(0))
    return x


def error_table() -> np.ndarray:
    """The error pattern of three bits at most for each of the 2048 syndromes."""
    masks = [sum(1 << b for b in c) for k in range(4) for c in itertools.combinations(range(23), k)]
    masks = np.array(masks, np.uint32)
    table = np.zeros(2048, np.uint32)
    table[syndrome(masks)] = masks
    return table


def golay_keys(x: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (rows, 6) of the words within one bit of each `width`-bit word, and which are set."""
    ball = np.concatenate([x[:, None], x[:, None] ^ (np.uint32(1) << np.arange(width, dtype=np.uint32))[None, :]], axis=1).astype(np.uint32)
    index = np.sort((ball ^ table[syndrome(ball)]) >> np.uint32(11), axis=1)
    new = np.concatenate([np.ones((len(x), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
    rank = np.cumsum(new, axis=1) - 1
    keys, ok = np.zeros((len(x), 6), np.uint64), np.zeros((len(x), 6), bool)
    row, col = np.nonzero(new)
    keys[row, rank[row, col]] = index[row, col]
    ok[row, rank[row, col]] = True
    return keys, ok


def composite_keys(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all composite keys."""
    shift, parts = 64, []
    for width in WIDTHS:
        shift -= width
        parts.append((fps >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.uint32))
    golay = [golay_keys(p, w, table) for p, w in zip(parts, WIDTHS)]
    rows, keys = [], []
    for tag, (exact, fuzzy) in enumerate(itertools.permutations(range(3), 2)):
        g, ok = golay[fuzzy]
        key = (np.uint64(tag) << np.uint64(40)) | (parts[exact].astype(np.uint64)[:, None] << np.uint64(12)) | g
        r, c = np.nonzero(ok)
        rows.append(r)
        keys.append(key[r, c])
    (a, oa), (b, ob), (c, oc) = golay
    key = (np.uint64(6) << np.uint64(40)) | (a[:, :, None, None] << np.uint64(24)) | (b[:, None, :, None] << np.uint64(12)) | c[:, None, None, :]
    ok = oa[:, :, None, None] & ob[:, None, :, None] & oc[:, None, None, :]
    rows.append(np.nonzero(ok)[0])
    keys.append(key[ok])
    return np.concatenate(rows), np.concatenate(keys)


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table, z = error_table(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            every = np.sort(batch.column(0).to_numpy().view(np.uint64))
            for i in range(0, len(every), BATCH):
                fps = every[i : i + BATCH]
                row, key = composite_keys(fps, table)
                bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((key, bucket))
                row, key, bucket = row[order], key[order], bucket[order]
                head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                out = []
                for a, b in zip(head.tolist(), np.r_[head[1:], len(bucket)].tolist()):
                    own, at = np.unique(row[a:b], return_inverse=True)
                    deltas = (np.diff(key[a:b], prepend=np.uint64(0)), np.diff(fps[own], prepend=np.uint64(0)), at)  # keys and fingerprints ascend
                    out.append(z.compress(struct.pack("<qq", b - a, len(own)) + b"".join(planes(d, n) for d, n in zip(deltas, (6, 8, 2)))))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[head], pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])
            give_back()

    return run


def _dealt(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<qq", raw)
    at = 16 + 6 * n
    key, fps = np.cumsum(from_planes(raw[16:at], n, 6)), np.cumsum(from_planes(raw[at : at + 8 * m], m, 8))
    return key, fps[from_planes(raw[at + 8 * m :], n, 2).astype(np.int64)]


# ---------------------------------------------------------------- links
def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least number reachable from each of 0..n-1 over links u-v."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        if (root == before).all():
            return root


def group_links(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that span what is linked within one group, without its pairs.

    Each fingerprint within `most` of a pivot hangs on it. Two clusters are linked only over members
    near enough to the other pivot, until one link is found; the triangle inequality rules out the rest.
    """
    left, u, v, pivots, clusters = np.arange(len(x)), [], [], [], []
    while len(left):
        near = _close(x[left[0]], x[left], most)
        members = left[near]
        u.append(np.full(len(members) - 1, members[0]))
        v.append(members[1:])
        pivots.append(members[0])
        clusters.append(members)
        left = left[~near]
    for i in range(len(pivots)):
        gap = np.bitwise_count(x[pivots[i]] ^ x[np.array(pivots[i + 1 :], np.int64)])
        for j in (np.flatnonzero(gap <= 3 * most) + i + 1).tolist():
            a = clusters[i][np.bitwise_count(x[clusters[i]] ^ x[pivots[j]]) <= 2 * most]
            b = clusters[j][np.bitwise_count(x[clusters[j]] ^ x[pivots[i]]) <= 2 * most]
            for k in a.tolist():
                met = np.flatnonzero(_close(x[k], x[b], most))
                if len(met):
                    u.append(np.array([k]))
                    v.append(b[met[:1]])
                    break
    return np.concatenate(u), np.concatenate(v)


def linked(blobs: list[bytes], most: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint it hangs together with) for those with a link in this bucket."""
    key, fp = (np.concatenate(c) for c in zip(*map(_dealt, blobs)))
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(key)])
    u, v = [], []
    few = np.repeat(size <= small, size)
    for gap in range(1, small):
        at = np.flatnonzero((key[gap:] == key[:-gap]) & few[gap:]) if len(key) > gap else np.zeros(0, np.int64)
        at = at[_close(fp[at], fp[at + gap], most)]
        u.append(fp[at])
        v.append(fp[at + gap])
    for k in np.flatnonzero(size > small).tolist():
        x = fp[head[k] : head[k] + size[k]]
        a, b = group_links(x, most)
        u.append(x[a])
        v.append(x[b])
    u, v = np.concatenate(u), np.concatenate(v)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = forest(at[: len(u)], at[len(u) :], len(nodes))
    hang = root != np.arange(len(nodes))
    return nodes[hang], nodes[root[hang]]


def fingerprint_links(distinct: DataFrame, count: int, most: int = MOST_BITS) -> DataFrame:
    """(u, v): links that connect whatever fingerprints at most `most` (4 or fewer) bits apart connect."""
    if most > MOST_BITS:
        raise ValueError(f"keys find {MOST_BITS} differing bits at most")
    spark = distinct.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 180 * count // BUCKET_KEYS)

    def match(table: pa.Table) -> pa.Table:
        a, b = linked(table.column("blob").to_pylist(), most)
        give_back()
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    return distinct.select("fp").mapInArrow(_deal(tasks), "bucket int, blob binary").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(match, "u long, v long")


def simhash_components(docs: DataFrame, words: int = 4, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id (least id whose fingerprint is reachable).

    A null text counts as empty; texts without words have fingerprint zero, which links like any other.
    A null id is never a component's id unless the component has no other. Repeated rows share a
    component; an empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    printed = materialise(base.mapInArrow(_fingerprint(words), "doc_id long, fp long"), "fingerprints")
    distinct = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    total, count = printed.count(), distinct.count()
    of = components(fingerprint_links(distinct, count, most))
    rooted = distinct.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "n", "component_id")
    return join_counted(printed, materialise(named, "components"), "fp", "n", total, F.col("doc_id"))
