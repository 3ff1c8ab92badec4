"""Removal of long repeated byte strings by logarithmic families of suffix arrays.

Every string of `least` bytes holds an anchor: the position of the least hash among its GRAM-byte grams,
of common ones only if it has no others (a line that a third of the texts share is no place to meet).
Equal strings have equal anchors, so they meet where strings are dealt out by the bytes at their anchor.
Runs of strings with one anchor travel as one packed segment to the bucket of that anchor, batch by batch.

A bucket keeps a logarithmic family: each new batch gets its own suffix array (the suffixes at its
anchors, in the order of their bytes), which is merge-scanned against all levels for common prefixes of
GRAM bytes; it then becomes level 0, and two levels of equal rank merge into one of the next rank. So
an entry is merged as often as the logarithm of the number of batches. Segments with such a match get
a dense suffix array of all their positions, by prefix doubling; neighbours in it with a common prefix
of `least` bytes are the repeated strings. Ranks compare bytes, so no hash decides what goes.

Copies within one map batch meet before the shuffle: only one of several equal segments travels.

Repeats too short for removal are counted by marks: of each `report` bytes, the MARK-byte string of the
least hash. A mark that another row has too shows a shared passage, and none of `report` bytes lacks one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, SEGMENTS, Packer, common_grams, from_planes, measured, merge_runs, mix, packed_row, packed_rows, planes, ragged, rare_first, raw_bytes, runs_by_document, slices, sliding_min, text_or_empty, unpack

GRAM, MARK = 32, 64
SLICE_BYTES = 4 << 20
#: Packed bytes gathered before a batch's buckets are sent; bytes of text for each bucket.
FLUSH_BYTES, BUCKET_BYTES = 24 << 20, 4 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.empty((len(data) + 8) // 8 * 8, np.uint64)
    for r in range(8):
        m = len(word) // 8
        word[r::8] = np.frombuffer(padded[r : r + 8 * m].tobytes(), np.uint64)
    h = word[:n].copy()
    for k in range(1, GRAM // 8):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += word[8 * k : 8 * k + n]
    return mix(h)


def all_grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each GRAM-byte string of each text."""
    offsets, data = raw_bytes(text)
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    return np.repeat(np.arange(len(counts)), counts), gram_hashes(data)[ragged(offsets[:-1], counts)]


def segments(offsets: np.ndarray, prints: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text number, first byte, number of strings, anchor's byte) of each run of strings with one anchor, the least of `prints`."""
    width = least - GRAM + 1
    if len(prints) < width:
        return (np.zeros(0, np.int64),) * 4
    # The low bits carry the position: of equal hashes the leftmost is the anchor, so each anchor is one place.
    bits = np.uint64(max(16, len(prints).bit_length()))
    low = sliding_min((prints >> bits << bits) | np.arange(len(prints), dtype=np.uint64), width)
    new = np.r_[True, low[1:] != low[:-1]]
    starts = offsets[:-1][np.diff(offsets) > 0]
    new[starts[starts < len(new)]] = True
    head = np.flatnonzero(new)
    text = np.searchsorted(offsets, head, "right") - 1
    stop = np.minimum(np.r_[head[1:], len(low)], offsets[text + 1] - least + 1)  # no string leaves its text
    ok = stop > head
    anchor = low[head[ok]] & ((np.uint64(1) << bits) - np.uint64(1))
    return text[ok], head[ok], (stop - head)[ok], anchor.astype(np.int64)


def marks(offsets: np.ndarray, prints: np.ndarray, report: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash of the MARK bytes) of each distinct mark: one at least in every `report` bytes of a text."""
    text, _, _, at = segments(offsets, prints[: len(prints) - MARK + GRAM], report - MARK + GRAM) if report else (np.zeros(0, np.int64),) * 4
    ok = at + MARK <= offsets[text + 1] if len(text) else np.zeros(0, bool)
    at, text = at[ok], text[ok]
    hashed = mix(prints[at] * np.uint64(0x9E3779B97F4A7C15) + prints[at + MARK - GRAM])
    order = np.lexsort((hashed, text))
    hashed, text = hashed[order], text[order]
    new = np.r_[True, (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])] if len(text) else np.zeros(0, bool)
    return text[new], hashed[new]


class SuffixFamily:
    """Suffix arrays (the first GRAM bytes of each suffix, its entry), in the order of the bytes; one for each rank at most."""

    def __init__(self):
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.entries = 0

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Add a batch of suffixes; entry numbers (of this batch and before) that turned out to have a common prefix with another."""
        order = np.argsort(suffixes, kind="stable")
        key, entry = suffixes[order], order + self.entries
        self.entries += len(suffixes)
        same = key[1:] == key[:-1]
        hits = [entry[1:][same], entry[:-1][same]]
        for level, at in self.levels.values():
            low, high = np.searchsorted(level, key, "left"), np.searchsorted(level, key, "right")
            hits.append(entry[high > low])
            over = np.bincount(low, minlength=len(level) + 1) - np.bincount(high, minlength=len(level) + 1)  # where matched ranges begin and end
            hits.append(at[np.cumsum(over)[:-1] > 0])
        rank = 0
        while rank in self.levels:
            other, at = self.levels.pop(rank)
            into = np.searchsorted(other, key, "right")
            key, entry, rank = np.insert(other, into, key), np.insert(at, into, entry), rank + 1
        self.levels[rank] = (key, entry)
        return np.unique(np.concatenate(hits))


def prefix_ranks(data: np.ndarray, least: int) -> np.ndarray:
    """A number for each position, equal where the next `least` bytes are and ordered as they are, by prefix doubling.

    Positions with fewer bytes left are compared as if zeros followed. A rank is the place in the suffix
    array of the first suffix with that prefix; a suffix alone with its prefix is sorted no further.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.empty((n + 8) // 8 * 8, np.uint64)
    for r in range(8):
        word[r::8] = np.frombuffer(padded[r : r + len(word)].tobytes(), ">u8")
    word, known, most = word[:n], 8, 8
    while most * 2 <= least:
        most *= 2
    rank, left = np.zeros(n, np.int64), np.arange(n)
    key = word
    while True:
        order = np.argsort(key)
        key, left = key[order], left[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        before = rank[left]
        first = np.maximum.accumulate(np.where(np.r_[True, before[1:] != before[:-1]], np.arange(len(left)), 0))  # of the old group
        rank[left] = np.repeat(before[head] + head - first[head], size)
        left = left[np.repeat(size > 1, size)]
        if known >= least or not len(left):
            return rank
        step = min(known, least - known) if known < most else least - known
        ahead = left + step
        key = (rank[left].astype(np.uint64) << np.uint64(32)) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
        known += step


def repeated_strings(blobs: list[bytes], least: int) -> tuple:
    """Arrays doc, text hash, start, stop: bytes of the packed segments under strings that start more than once."""
    family, parts, hit = SuffixFamily(), [], []
    for blob in blobs:
        part = unpack(blob)
        part = part[:5] + (np.frombuffer(part[5], np.uint8),)
        parts.append(part)
        at = np.cumsum(part[4]) - part[4] + part[3]
        hit.append(family.add(part[5][at[:, None] + np.arange(GRAM)].view(f"S{GRAM}").ravel()))
    hit = np.unique(np.concatenate(hit))
    if not len(hit):
        return ((),) * 4
    doc, th, first, _, length = (np.concatenate([p[i] for p in parts])[hit] for i in range(5))
    size, pieces = np.cumsum([0] + [len(p[0]) for p in parts]), []
    for k, p in enumerate(parts):
        mine = hit[(hit >= size[k]) & (hit < size[k + 1])] - size[k]
        pieces.append(p[5][ragged((np.cumsum(p[4]) - p[4])[mine], p[4][mine])])
    del parts
    # Equal segments go as a whole, so one of them is enough for the others' sake.
    data = np.concatenate(pieces)
    begin, whole = np.cumsum(length) - length, data.tobytes()
    seen: dict[bytes, int] = {}
    twin = np.array([seen.setdefault(whole[a : a + n], i) for i, (a, n) in enumerate(zip(begin.tolist(), length.tolist()))], np.int64)
    del seen, whole
    often = np.bincount(twin, minlength=len(twin))[twin] > 1
    one = np.flatnonzero(twin == np.arange(len(twin)))
    out = [(doc[often], th[often], first[often], first[often] + length[often])]
    data = data[ragged(begin[one], length[one])]
    doc, th, first, length, often = doc[one], th[one], first[one], length[one], often[one]
    rank = prefix_ranks(data, least)
    strings = length - least + 1
    begin = np.cumsum(length) - length
    at = ragged(begin, strings)
    del data
    mine = rank[at]
    gone = np.flatnonzero(np.bincount(mine, minlength=len(rank))[mine] > 1)
    ends = np.cumsum(strings)
    seg = np.searchsorted(ends, gone, "right")
    gone, seg = gone[~often[seg]], seg[~often[seg]]
    if len(gone):
        pos = gone - (ends - strings)[seg]
        head = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (pos[1:] > pos[:-1] + least)])
        last, s = np.r_[head[1:], len(gone)] - 1, seg[head]
        out.append((doc[s], th[s], first[s] + pos[head], first[s] + pos[last] + least))
    return tuple(np.concatenate(c) for c in zip(*out))


def mark_blobs(hashes: np.ndarray, doc: np.ndarray, th: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Marks of a map batch for their buckets; `often` tells that the batch itself has the mark more than once."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    key, first, n = np.unique(hashes, return_index=True, return_counts=True)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        at = order[cut[b] : cut[b + 1]]
        columns = (np.diff(key[at], prepend=np.uint64(0)), doc[first[at]], th[first[at]], n[at] > 1)
        yield b, z.compress(np.int64(len(at)).tobytes() + b"".join(planes(np.asarray(c).astype(np.int64) if c.dtype == bool else c.view(np.int64), w) for c, w in zip(columns, (8, 8, 8, 1))))


def shared_marks(blobs: list[bytes]) -> tuple:
    """Rows doc, text hash, -1, number of marks that another batch has too; those that a batch has twice count there."""
    import zstandard

    parts = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        cut = [8 + n * k for k in (0, 8, 16, 24, 25)]
        columns = [from_planes(raw[a:b], n, (b - a) // n) for a, b in zip(cut, cut[1:])]
        parts.append([np.cumsum(columns[0]), *(c.astype(np.int64) for c in columns[1:])])
    key, doc, th, often = (np.concatenate(c) for c in zip(*parts))
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    return counted(*(c[(n[of] > 1) & (often == 0)] for c in (doc, th)))


def counted(doc: np.ndarray, th: np.ndarray) -> tuple:
    """Rows doc, text hash, -1, count of the (doc, text hash) given."""
    order = np.lexsort((th, doc))
    doc, th = doc[order], th[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[head], th[head], np.full(len(head), -1), np.diff(np.r_[head, len(doc)])


def _send(least: int, report: int, buckets: int, field: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen, local, noted = Packer(buckets), {}, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            seen.clear()
            if noted:
                hashes, doc, th = (np.concatenate(c) for c in zip(*noted))
                noted.clear()
                for bucket, blob in mark_blobs(hashes, doc, th, buckets):
                    yield packed_row(bucket, MARKS, blob)
                _, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
                local.extend(zip(*(c.tolist() for c in counted(doc[n[of] > 1], th[n[of] > 1]))))
            yield from packed_rows(packer, local)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, hashed = pc.fill_null(part.column(0), np.iinfo(np.int64).max).to_numpy(), part.column(1).to_numpy()
                offsets, data = raw_bytes(part.column(2))
                prints = gram_hashes(data)
                text, head, strings, anchor = segments(offsets, rare_first(prints, field), least)
                owner, marked = marks(offsets, prints, report)
                if len(owner):
                    noted.append((marked, ids[owner], hashed[owner]))
                whole = data.tobytes()
                bucket, key = (prints[anchor] % np.uint64(buckets)).astype(np.int64).tolist(), (anchor - head).tolist()
                a, b, at = head.tolist(), (head + strings + least - 1).tolist(), (head - offsets[text]).tolist()
                doc, th = ids[text].tolist(), hashed[text].tolist()
                for i in range(len(a)):
                    s = whole[a[i] : b[i]]
                    mine = (doc[i], th[i], at[i], at[i] + len(s))
                    twin = seen.get(s)
                    if twin is None:
                        seen[s] = [mine]
                        packer.add(bucket[i], doc[i], th[i], at[i], key[i], s)
                        continue
                    if twin:
                        local.append(twin.pop())  # all of the first goes too; it is noted once
                    if local and local[-1][:2] == mine[:2] and local[-1][2] <= mine[2] <= local[-1][3]:
                        mine = (*local.pop()[:3], mine[3])
                    local.append(mine)
                if packer.size + 200 * len(local) > FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            spans, kept, shared = [], [], []
            for text, runs in zip(pc.cast(part.column(1), pa.binary()).to_pylist(), part.column(2).to_pylist()):
                found, left, at = [], [], 0
                shared.append(sum(r["stop"] for r in runs or () if r["start"] < 0))
                runs = [r for r in runs or () if r["start"] >= 0]
                if runs:
                    a, b = merge_runs(np.array([r["start"] for r in runs]), np.array([r["stop"] for r in runs]))
                    found = list(zip(a.tolist(), b.tolist()))
                for a, b in found:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                spans.append([{"start": a, "stop": b} for a, b in found])
                kept.append(b"".join(left))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(part.column(1)), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(shared, pa.int64())], ["doc_id", "n_bytes", "spans", "kept", "n_shared"])


def suffix_array_dedup(docs: DataFrame, least: int = 400, report: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed byte runs, maximal), kept (the other bytes, binary), n_shared.

    A byte goes if a string of `least` bytes over it also starts anywhere else, in the same document too;
    strings are judged on the input and never cross documents. Kept bytes need not be valid UTF-8.
    n_shared counts the distinct marks that another row has too: strings of MARK bytes, one at least in every
    `report` bytes; so it is over 0 wherever rows share `report` bytes, and tells of passages too short to go.
    With `report` 0 nothing is marked. A null text counts as empty; a null id is an id like any other;
    repeated rows are copies of each other, so their long strings go from all of them. An empty table
    gives no rows; other columns are ignored.
    """
    if least < 2 * GRAM or report and report < 2 * MARK:
        raise ValueError(f"least must be at least {2 * GRAM}, and report 0 or at least {2 * MARK}")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    rows, size = measured(base)
    buckets, field = max(64, size // BUCKET_BYTES), common_grams(base, rows, all_grams)
    joined = runs_by_document(base, _send(least, report, buckets, field), {SEGMENTS: lambda blobs: repeated_strings(blobs, least), MARKS: shared_marks}, buckets)
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary, n_shared long")
