"""Helpers that the text operators share: shared storage, row keys, Arrow batches, packed shuffles."""

from __future__ import annotations

import contextlib
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="raincask-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/raincask/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._raincask_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialised frame that no later plan reads."""
    path = getattr(df, "_raincask_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def measured(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows, and UTF-8 bytes of all texts, counted; estimates of a plan's size can be off by any factor."""
    got = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(text_col)).alias("n")).first()
    return int(got["rows"]), int(got["n"] or 0)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return measured(docs, text_col)[1]


#: A key with more than 1/HOT_KEYS of the rows is hot; there can be at most HOT_KEYS of those.
HOT_KEYS = 256


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, salt: Column) -> DataFrame:
    """Left join on a unique key of `table`, whose column `count` says how many of the `total` rows have it.

    Hot keys, HOT_KEYS at most, come by broadcast; the others by a shuffle in which the rows of hot keys
    are dealt out by `salt` instead. Keys are non-null strings or longs.
    """
    least = total // HOT_KEYS + 1
    values = [c for c in table.columns if c not in (key, count)]
    hot = F.broadcast(table.where(F.col(count) >= least).select(F.col(key), F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values)))
    cold = table.where(F.col(count) < least).select(F.col(key).cast("string").alias("_key"), *(F.col(c).alias(f"_cold_{c}") for c in values))
    met = rows.join(hot, key, "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("salt "), F.hex(F.xxhash64(salt)))))
    out = met.join(cold, "_key", "left")
    return out.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values))


def _probed(rows: DataFrame, keys: DataFrame, hashed: Column, bits: int) -> tuple[DataFrame, Column]:
    words = keys.select(F.pmod("key", F.lit(bits)).alias("pos")).distinct().groupBy(F.shiftright("pos", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))")).alias("_mask"))
    probed = rows.withColumn("_pos", F.pmod(hashed, F.lit(bits))).withColumn("_word", F.shiftright("_pos", 6)).join(F.broadcast(words), "_word", "left")
    return probed, F.expr("coalesce(_mask & shiftleft(1L, cast(_pos & 63 as int)), 0L) != 0")


def may_match(rows: DataFrame, keys: DataFrame, hashed: Column, bits: int = 1 << 24) -> DataFrame:
    """Rows whose `hashed` (a long) may be among the long column `key` of `keys`: no false negatives.

    The filter is one field of `bits` positions, kept as at most bits / 64 words, so its broadcast is
    bounded whatever the number of keys; with too many keys it lets more rows through.
    """
    probed, hit = _probed(rows, keys, hashed, bits)
    return probed.where(hit).select(*rows.columns)


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash that tells one (id, text) from another; null ids and null texts are values like any other."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(id_col).isNull(), text_or_empty(text_col))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 1 << 24) -> DataFrame:
    """Rows of docs whose (id, text) is not in `gone`, which has them as the long column `key` (`text_key`).

    So null ids go like others, and of an id with several texts only the texts meant go. Columns of docs
    travel as one struct, so that no name of theirs can clash. Only rows that a filter of fixed size
    can't clear take part in a join.
    """
    rows = docs.select(F.struct("*").alias("row"), text_key(id_col, text_col).alias("key"))
    probed, hit = _probed(rows, gone, F.col("key"), bits)
    left = probed.where(hit).select("row", "key").join(gone.select("key").distinct(), "key", "left_anti")
    return probed.where(~hit).select("row").unionByName(left.select("row")).select("row.*")


# ---------------------------------------------------------------- Arrow batches
@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside hands Python at most `most` rows at a time: a batch of long texts is held whole on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if not 0 < int(was) <= most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most `most` bytes of `column`, one row at least."""
    a = batch.column(batch.schema.get_field_index(column))
    size = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if pa.types.is_string(a.type) or pa.types.is_binary(a.type) else None
    if size is None:
        size = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    start = 0
    while start < len(a):
        end = max(start + 1, int(np.searchsorted(size, size[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    give_back()


def raw_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a string or binary array, without a copy."""
    if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
        offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    else:
        offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... for each i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): equal in, equal out, well spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Rows sampled for what is common, slots that grams are counted in, share of the rows from which a gram is common.
SAMPLE_ROWS, COMMON_SLOTS, COMMON_SHARE, LEAST_COMMON = 4096, 1 << 22, 0.005, 20


def common_grams(base: DataFrame, rows: int, grams) -> np.ndarray:
    """Which slots (hash modulo COMMON_SLOTS) hold a gram that a share of the rows has, as a field of bits.

    base has th and text; grams(text) gives the row and the hash of each gram. Counted on SAMPLE_ROWS rows
    or so, picked by hash. What is common decides by which gram equal strings meet, never which strings are
    equal, so neither the sample nor a slot that two grams share can change a result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                owner, hashed = grams(part.column(0))
                pairs = np.unique(owner.astype(np.int64) * COMMON_SLOTS + (hashed % np.uint64(COMMON_SLOTS)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((pairs % COMMON_SLOTS).astype(np.int32))], ["slot"])

    every = max(1, rows // SAMPLE_ROWS)
    counts = materialise(base.where(F.pmod("th", F.lit(every)) == 0).select("text").mapInArrow(run, "slot int").groupBy("slot").agg(F.count("*").alias("n")), "gram-counts")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / COMMON_SLOTS
    often = counts.where(F.col("n") >= max(LEAST_COMMON, COMMON_SHARE * rows / every, 3 * mean)).select("slot").collect()
    discard(counts)
    field = np.zeros(COMMON_SLOTS, bool)
    field[[r.slot for r in often]] = True
    return np.packbits(field)


def rare_first(hashed: np.ndarray, field: np.ndarray | None) -> np.ndarray:
    """Numbers that order grams by their hash, common ones after all others."""
    if field is None:
        return hashed
    slot = (hashed % np.uint64(COMMON_SLOTS)).astype(np.int64)
    common = field[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
    return (hashed >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63))


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all first bytes first: packs better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by the two-scan block method."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


# ---------------------------------------------------------------- packed segments
class Packer:
    """Gathers (bucket, row key, start, anchor key, bytes) and hands them out as one compressed blob a bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, {}, 0

    def add(self, bucket: int, doc: int, text_hash: int, start: int, key: int, data: bytes) -> None:
        p = self.parts.get(bucket)
        if p is None:
            p = self.parts[bucket] = ([], [], [], [], [])
        p[0].append(doc)
        p[1].append(text_hash)
        p[2].append(start)
        p[3].append(key)
        p[4].append(data)
        self.size += len(data) + 40

    def flush(self) -> Iterator[tuple[int, bytes]]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for bucket, (doc, th, start, key, data) in self.parts.items():
            head = struct.pack("<q", len(doc)) + np.array(doc, np.int64).tobytes() + np.array(th, np.int64).tobytes() + np.array(start, np.int64).tobytes() + np.array(key, np.int64).tobytes() + np.fromiter(map(len, data), np.int64, len(data)).tobytes()
            yield bucket, z.compress(head + b"".join(data))
        self.parts, self.size = {}, 0


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """doc, text hash, start, key, length of each segment, and their bytes in one string."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    at, out = 8, []
    for kind in (np.int64,) * 5:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return (*out, raw[at:])


def pack_runs(runs: list[tuple[int, int, int, int]]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.array(runs, np.int64).reshape(-1, 4).T).tobytes())


def unpack_runs(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(4, -1)


#: Kinds of packed rows: segments for their bucket, runs that need no bucket, marks for theirs.
SEGMENTS, KNOWN, MARKS = 0, 1, 2
PACKED, RUNS = "bucket int, kind int, blob binary", "doc_id long, th long, start long, stop long"
#: Runs in one blob of known ones.
KNOWN_RUNS = 20_000


def packed_row(bucket: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "kind", "blob"])


def packed_rows(packer: Packer, known: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Empty both into rows of PACKED: segments for their buckets, and runs that need no bucket, spread over all."""
    for bucket, blob in packer.flush():
        yield packed_row(bucket, SEGMENTS, blob)
    for i in range(0, len(known), KNOWN_RUNS):
        yield packed_row(abs(known[i][1]) % packer.buckets, KNOWN, pack_runs(known[i : i + KNOWN_RUNS]))
    known.clear()


def resolve(table: pa.Table, finders: dict) -> pa.Table:
    """Runs of one bucket: the known ones as they are, and those that the finder of each other kind makes of its blobs."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    found = [unpack_runs(b) for k, b in zip(kinds, blobs) if k == KNOWN]
    for kind, find in finders.items():
        mine = [b for k, b in zip(kinds, blobs) if k == kind]
        if mine:
            found.append(np.array(find(mine), np.int64).reshape(4, -1))
    cols = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in cols], ["doc_id", "th", "start", "stop"])


def runs_by_document(base: DataFrame, send, finders: dict, buckets: int) -> DataFrame:
    """base (doc_id, th, text) with `runs`: one shuffle of packed segments, one of runs and one of texts."""
    tasks = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 16)
    runs = base.mapInArrow(send, PACKED).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: resolve(t, finders), RUNS)
    runs = runs.groupBy(F.col("doc_id").alias("key"), "th").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    keyed = base.withColumn("key", F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)))
    return keyed.join(runs.hint("shuffle_hash"), ["key", "th"], "left").select("doc_id", "text", "runs")


def merge_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join overlapping or touching [start, end) runs; the input need not be sorted."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[first], np.r_[end[first[1:] - 1], end[-1:]]
