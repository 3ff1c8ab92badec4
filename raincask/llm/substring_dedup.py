"""Substring dedup over word windows by super-k-mer partitioning.

A window is `window` consecutive words of one document. Its minimiser is the least hash among the
`gram`-word grams inside it, of common grams only if it has no others. Consecutive windows that share a minimiser travel together, as one packed
string, to the bucket of that minimiser; equal windows have equal minimisers, so all copies of a window
meet in one bucket. There, sorting the windows finds the copies, and word codes decide exactly.

Copies within one map batch meet before the shuffle: of equal packed strings, that of the smallest id
travels and the others are known to go. So a passage that a third of all documents share travels
once a batch, not once a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEGMENTS, Packer, common_grams, measured, merge_runs, mix, packed_rows, ragged, rare_first, runs_by_document, slices, sliding_min, text_or_empty, unpack

SLICE_BYTES = 4 << 20
#: Packed bytes gathered before a batch's buckets are sent; bytes of text for each bucket.
FLUSH_BYTES, BUCKET_BYTES = 24 << 20, 8 << 20


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, one after the other, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    keep = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    at = offsets - offsets[0]
    return flat.filter(full), keep[at[1:]] - keep[at[:-1]]


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in pc.cast(coded.dictionary, pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def word_grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` words from each word on."""
    n = max(0, len(hashes) - gram + 1)
    g = hashes[:n].copy()
    for k in range(1, gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
    return mix(g)


def all_word_grams(gram: int):
    def run(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, counts = words_of(text)
        n = np.maximum(counts - gram + 1, 0)
        return np.repeat(np.arange(len(counts)), n), word_grams(word_hashes(words), gram)[ragged(np.cumsum(counts) - counts, n)]

    return run


def super_kmers(hashes: np.ndarray, counts: np.ndarray, window: int, gram: int, field: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text number, first word, number of windows, minimiser) of each run of windows with one minimiser.

    First words count from the start of all words. No window crosses from one text into the next.
    """
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = sliding_min(rare_first(word_grams(hashes, gram), field), window - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[: n - window + 1] == text[window - 1 :]
    new = np.r_[True, least[1:] != least[:-1]] | np.r_[True, ~inside[:-1]]
    starts = np.flatnonzero(new & inside)
    edges = np.flatnonzero(new | ~inside)
    ends = np.r_[edges, len(least)][np.searchsorted(edges, starts, "right")]
    return text[starts], starts, ends - starts, least[starts]


def repeated_windows(blobs: list[bytes], window: int) -> tuple:
    """Arrays doc, text hash, start, stop: words of each packed segment under windows that a smaller id has too."""
    parts = [unpack(b) for b in blobs]
    doc, th, first, _, length = (np.concatenate([p[i] for p in parts]) for i in range(5))
    data = b"".join(p[5] for p in parts)
    ends = np.cumsum(length)
    if data and len(data) < 1 << 31:
        text = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(data)])
    else:
        text = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(data)])
    words, counts = words_of(text)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    at = np.cumsum(counts) - counts
    windows = counts - window + 1
    segment = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    word = at[segment] + place
    for salt in range(1, 100):
        key = mix(codes.astype(np.uint64) + np.uint64(salt << 40))
        h = np.zeros(len(word), np.uint64)
        for k in range(window):
            h = h * np.uint64(0xD6E8FEB86659FD93) + key[word + k]
        order = np.argsort(h, kind="stable")
        h = h[order]
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.zeros(0, np.int64)
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        many = size[group] > 1
        order, group = order[many], group[many]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        lead = np.repeat(heads, np.diff(np.r_[heads, len(group)]))
        if all((codes[word[order] + k] == codes[word[order[lead]] + k]).all() for k in range(window)):
            break  # equal hashes are equal windows; otherwise try another hash
    if not len(order):
        return ((),) * 4
    ids = doc[segment[order]]
    least = np.minimum.reduceat(ids, heads)[np.cumsum(np.r_[False, group[1:] != group[:-1]])]
    gone = np.sort(order[ids > least])
    if not len(gone):
        return ((),) * 4
    seg, pos = segment[gone], place[gone]
    new = np.r_[True, (seg[1:] != seg[:-1]) | (pos[1:] > pos[:-1] + window)]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(gone)] - 1
    s = seg[head]
    return doc[s], th[s], first[s] + pos[head], first[s] + pos[last] + window


def _send(window: int, gram: int, buckets: int, field: np.ndarray | None = None):
    top = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen, local = Packer(buckets), {}, []

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = pc.fill_null(part.column(0), top)
                order = pc.sort_indices(ids)
                ids, th, text = ids.take(order).to_numpy(), part.column(1).take(order).to_numpy(), part.column(2).take(order)
                words, counts = words_of(text)
                doc, start, n, least = super_kmers(word_hashes(words), counts, window, gram, field)
                if not len(doc):
                    continue
                first = np.cumsum(counts) - counts
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer().to_pybytes()
                offset = np.r_[0, np.cumsum(pc.binary_length(words).to_numpy() + 1)]
                bucket = (least % np.uint64(buckets)).astype(np.int64).tolist()
                a, b = offset[start].tolist(), (offset[start + n + window - 1] - 1).tolist()
                at = (start - first[doc]).tolist()
                owner, hashed, stop = ids[doc].tolist(), th[doc].tolist(), (start - first[doc] + n + window - 1).tolist()
                for i in range(len(a)):
                    s = joined[a[i] : b[i]]
                    known = seen.get(s)
                    if known is not None and known < owner[i]:
                        mine = (owner[i], hashed[i], at[i], stop[i])
                        if local and local[-1][:2] == mine[:2] and local[-1][2] <= mine[2] <= local[-1][3]:
                            mine = (*local.pop()[:3], mine[3])
                        local.append(mine)
                        continue
                    if known is None or known > owner[i]:
                        seen[s] = owner[i]
                    packer.add(bucket[i], owner[i], hashed[i], at[i], 0, s)
                if packer.size + 200 * len(local) > FLUSH_BYTES:
                    seen.clear()
                    yield from packed_rows(packer, local)
        yield from packed_rows(packer, local)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            out = []
            for doc, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = text.encode().split()
                spans = [(0, 0)][:0]
                if runs:
                    a, b = merge_runs(np.array([r["start"] for r in runs]), np.array([r["stop"] for r in runs]))
                    spans = list(zip(a.tolist(), b.tolist()))
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((doc, len(words), [{"start": a, "stop": b} for a, b in spans], b" ".join(kept).decode()))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_words", "spans", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = 13, gram: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, spans (removed word runs), kept_text (kept words, one space between).

    A word goes if it lies in a window of `window` words that also starts in a document with a smaller
    id; windows are judged on the input. Words are runs of bytes outside 0x20 and 0x09-0x0D, unchanged.
    A null text has no words. A null id counts as larger than any other. Rows with the same id are
    one document for this rule: none of them removes words of another. Texts shorter than a window
    stay as they are, an empty table gives no rows, and other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    rows, size = measured(base)
    buckets, field = max(64, size // BUCKET_BYTES), common_grams(base, rows, all_word_grams(gram))
    joined = runs_by_document(base, _send(window, gram, buckets, field), {SEGMENTS: lambda blobs: repeated_windows(blobs, window)}, buckets)
    return joined.mapInArrow(_cut, "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, kept_text string")
