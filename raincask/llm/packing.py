"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are tokenised and cut into pieces where Spark holds them. Lengths are whole numbers up to the
capacity, so an instance is a histogram with one count for each length; only that goes to the driver,
however many documents there are. On it:
  1. reduction: sets that provably dominate every alternative for their largest piece are fixed for good
     (a piece alone, if nothing fits beside it; an exact complement; the largest partner, if no two
     pieces together fit better), as often as the counts allow;
  2. the rest is packed best fit decreasing, many equal bins at a time.
The plan says which ranks of each length go where; pieces get ranks by salted window counts, so that a
length that a third of all rows have is no single task's work.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ragged, raw_bytes, rows_per_batch, slices, text_or_empty

SLICE_BYTES, BATCH_ROWS = 1 << 19, 1000
END_OF_TEXT = "<|endoftext|>"
#: Bytes that are or may end, or may begin, a white-space character in UTF-8 (fixed values).
MAY_END_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
MAY_BEGIN_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]


# ---------------------------------------------------------------- tokens
def load_encoder(vocabulary: str):
    """The byte-level BPE of a ranks file, and the bytes in each token."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end = len(ranks)
    length = np.zeros(end + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    length[end] = len(END_OF_TEXT)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: end}), length


class ChunkEncoder:
    """Token ids of whole batches through the ids of their distinct chunks.

    A chunk starts at each single space between two other characters. The tokenizer's pattern always
    starts a new piece there, so the ids of a text are those of its chunks, one after the other.
    """

    def __init__(self, vocabulary: str):
        self.encoder, self.token_bytes = load_encoder(vocabulary)
        self.ends, self.begins = np.zeros(256, bool), np.zeros(256, bool)
        self.ends[MAY_END_SPACE] = True
        self.begins[MAY_BEGIN_SPACE] = True

    def cuts(self, data: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(data[1:-1] == 0x20) + 1
        return at[~self.ends[data[at - 1]] & ~self.begins[data[at + 1]]]

    def distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk, one after the other, and their numbers."""
        offsets, data = raw_bytes(chunks)
        size = np.diff(offsets)
        last = data[np.maximum(offsets[1:] - 1, 0)] if len(data) else np.zeros(len(size), np.uint8)
        second = data[np.minimum(offsets[:-1] + 1, len(data) - 1)] if len(data) else last
        # Chunks that start as a cut does and end in no space can be encoded in one go, in a row.
        plain = (size > 1) & (data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] == 0x20 if len(data) else False) & ~self.begins[second] & ~self.ends[last]
        rows, ids = [], []
        which = np.flatnonzero(plain)
        if len(which):
            text = data[ragged(offsets[:-1][which], size[which])].tobytes().decode()
            tokens = np.array(self.encoder.encode(text, allowed_special="all"), np.int64)
            of = np.searchsorted(np.cumsum(size[which]), np.cumsum(self.token_bytes[tokens]), "left")
            rows.append(which[of])
            ids.append(tokens)
        for k in np.flatnonzero(~plain).tolist():
            one = self.encoder.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), allowed_special="all")
            rows.append(np.full(len(one), k))
            ids.append(np.array(one, np.int64))
        row, ids = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        return ids[order], np.bincount(row, minlength=len(size)).astype(np.int64)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each ended by 0, and the number of each text's ids with that."""
        offsets, data = raw_bytes(text)
        starts = offsets[:-1][np.diff(offsets) > 0]
        begin = np.unique(np.concatenate([starts, self.cuts(data)]))
        chunks = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(np.r_[begin, len(data)].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]) if len(begin) else pa.array([], pa.string())
        coded = chunks.dictionary_encode()
        ids, n = self.distinct(coded.dictionary)
        code = coded.indices.to_numpy().astype(np.int64)
        flat = ids[ragged((np.cumsum(n) - n)[code], n[code])]
        owner = np.searchsorted(offsets, begin, "right") - 1
        count = np.bincount(owner, weights=n[code], minlength=len(text)).astype(np.int64) if len(begin) else np.zeros(len(text), np.int64)
        out = np.zeros(len(flat) + len(text), np.int64)
        out[ragged(np.cumsum(count + 1) - count - 1, count)] = flat
        return out, count + 1


def _tokenise(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, count = encoder.encode(part.column(1))
                pieces = -(-count // capacity)
                row = np.repeat(np.arange(len(count)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (count - (pieces - 1) * capacity)[row]  # the first piece may be shorter
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                at = (np.cumsum(count) - count)[row] + start
                small = ids.astype("<u4")
                crc = [zlib.crc32(small[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                cols = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([small[a:b].astype(np.int32) for a, b in zip(at.tolist(), (at + length).tolist())], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return run


# ---------------------------------------------------------------- the plan
class Plan:
    """Groups of bins filled alike. Slots: (length, pieces of that length in each bin)."""

    def __init__(self):
        self.groups: list[tuple[list[tuple[int, int]], int]] = []

    def fix(self, slots: list[tuple[int, int]], bins: int) -> None:
        if bins:
            self.groups.append((slots, bins))

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.groups)

    def segments(self) -> pd.DataFrame:
        """Where each run of ranks of a length goes: rank - from over `times` is the bin, the rest the place."""
        taken, base, out = {}, 0, []
        for slots, bins in self.groups:
            offset = 0
            for length, times in slots:
                first = taken.get(length, 0)
                taken[length] = first + bins * times
                out.append((length, first, first + bins * times, base, times, offset))
                offset += length * times
            base += bins
        return pd.DataFrame(out, columns=["length", "from_rank", "to_rank", "base", "times", "at"])


def best_pair(lengths: list[int], room: int, count: dict[int, int]) -> int:
    """The largest sum up to `room` of two pieces at hand, 0 if none fits."""
    best, i, j = 0, 0, bisect.bisect_right(lengths, room) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room:
            j -= 1
        elif i == j and count[lengths[i]] < 2:
            break
        else:
            best = max(best, total)
            i += 1
    return best


def reduce_instance(count: dict[int, int], capacity: int, plan: Plan) -> None:
    """Fix dominating sets, largest piece first; what stays in `count` is the reduced instance.

    Pieces without a dominating set are set aside and looked at again, since a smaller choice may
    open up once others are gone; that ends when a pass fixes nothing.
    """
    changed = True
    while changed:
        changed = False
        for a in sorted(count, reverse=True):
            while count.get(a, 0):
                n = count.pop(a)
                if n > 1:
                    count[a] = n - 1  # partners of one piece of this length
                lengths = sorted(count)
                room = capacity - a
                k = bisect.bisect_right(lengths, room)
                b = lengths[k - 1] if k else 0
                count[a] = n
                if not b:
                    plan.fix([(a, 1)], n)
                    del count[a]
                elif b == room or best_pair(lengths[:k], room, count | {a: n - 1}) <= b:
                    # No two pieces (so no three either, each pair of which would be a pair) beat b alone.
                    pairs = n // 2 if a == b else min(n, count[b])
                    plan.fix([(a, 2)] if a == b else [(a, 1), (b, 1)], pairs)
                    for c in {a, b}:
                        count[c] -= pairs * (2 if a == b else 1)
                        if not count[c]:
                            del count[c]
                else:
                    break
                changed = True


def best_fit(count: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit decreasing over equal pieces and equal bins at a time."""
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, slots: list[tuple[int, int]], bins: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((slots, bins))

    for a in sorted(count, reverse=True):
        n = count[a]
        while n:
            k = bisect.bisect_left(rooms, a)
            if k == len(rooms):
                room, slots, bins = capacity, [], n // (capacity // a) or 1
            else:
                room = rooms[k]
                slots, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(k)
            times = min(room // a, n)
            fill = min(bins, n // times)
            put(room - times * a, [*slots, (a, times)], fill)
            if fill < bins and slots:
                put(room, slots, bins - fill)
            n -= fill * times
    for groups in open_bins.values():
        for slots, bins in groups:
            plan.fix(slots, bins)


def make_plan(count: dict[int, int], capacity: int) -> Plan:
    plan, count = Plan(), dict(count)
    reduce_instance(count, capacity, plan)
    best_fit(count, capacity, plan)
    return plan


# ---------------------------------------------------------------- on Spark
def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A document is the ids of its text (null: the empty text) and a closing 0. Only documents of more
    than `capacity` ids are cut, into pieces of that size of which the first may be shorter. Sequences
    hold `capacity` ids at most, without gaps. Ids may be null or repeat: each row is a document. An
    empty table gives no rows; other columns are ignored. `vocabulary` is the path of a ranks file.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    with rows_per_batch(spark, BATCH_ROWS):
        pieces = materialise(base.mapInArrow(_tokenise(vocabulary, capacity, with_ids), schema), "pieces")
    plan = make_plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    # Its rows depend on the capacity, not on the number of documents.
    table = F.broadcast(spark.createDataFrame(plan.segments().astype("int64"), "length long, from_rank long, to_rank long, base long, times long, at long"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.join(table, (ranked.length == table.length) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))).drop(table.length)
    k = F.col("rank") - F.col("from_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(k / F.col("times")).cast("long")).alias("sequence_id"), (F.col("at") + k % F.col("times") * F.col("length")).alias("offset"), *["ids"] * with_ids
    )
