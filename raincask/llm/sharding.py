"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition.

The key of a row is (hash of the text, hash of the id): equal texts lie side by side. A sample of keys,
each drawn with a chance in proportion to its bytes, gives splitters that cut the key space into many
fine ranges of about equal bytes. Exact bytes and rows of each range are then counted (one row a range,
RANGES at most, goes to the driver) and runs of ranges become shards of near equal bytes. A group of
equal texts that fills more than a range is subdivided by the second half of the key, so that no task
gets a whole hot group; its parts stay in one shard unless they would make that shard overfull.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, text_or_empty

#: Ranges: one for RANGE_BYTES of text, within these bounds. Keys sampled for each range, on average.
LEAST_RANGES, MOST_RANGES, RANGE_BYTES, PER_RANGE = 1024, 65_536, 256 << 20, 24
#: Share of a shard by which it may be off for the sake of a group of equal texts.
SLACK = 0.01


def quantile_splitters(sample: list[tuple[int, int]], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut a sorted sample into equal parts.

    A splitter starts at its group (second half lowest) unless one at that group's start is there
    already; then it lies inside the group and subdivides it.
    """
    first, second, low = [], [], np.iinfo(np.int64).min
    sample = sorted(sample)
    for i in range(1, ranges):
        if not sample:
            break
        a, b = sample[i * len(sample) // ranges]
        if not first or first[-1] != a:
            first.append(a)
            second.append(low)
        elif b > second[-1]:
            first.append(a)
            second.append(b)
    return np.array(first, np.int64), np.array(second, np.int64)


def find_range(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of splitters that are at most (a, b), for each pair."""
    low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
    out = low.copy()
    for lo, hi in np.unique(np.stack([low, high])[:, high > low], axis=1).T:
        at = (low == lo) & (high == hi)
        out[at] = lo + np.searchsorted(second[lo:hi], b[at], "right")
    return out.astype(np.int32)


def cut(sizes: np.ndarray, inside: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each range: cuts lie nearest to equal bytes, at the edge of a group if one is near enough."""
    ends = np.r_[0, np.cumsum(sizes)]
    total, cuts = ends[-1], []
    for j in range(1, shards):
        off = np.abs(ends - total * j / shards)
        best = int(np.argmin(off))
        whole = np.where(np.r_[inside, False], np.inf, off)
        if whole.min() <= off[best] + SLACK * total / shards / 2:
            best = int(np.argmin(whole))
        cuts.append(best)
    return np.searchsorted(np.array(cuts), np.arange(len(sizes)), "right").astype(np.int32)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot, range_id.

    Shards have near equal bytes (UTF-8 bytes of the text plus 1 for each row); slot numbers the rows
    of a shard from 0 without gaps, in key order. A null text counts as empty, a null id as a value of
    its own, rows that are repeated keep a slot each, an empty table gives no rows. Other columns are
    ignored. The sample is bounded: PER_RANGE keys for each of the ranges on average.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).select(
        "doc_id", (F.octet_length("t").cast("long") + 1).alias("size"), F.crc32("t").alias("text_crc32"), F.xxhash64("t").alias("a"), F.xxhash64("doc_id", F.lit("slot")).alias("b")
    )
    base = materialise(base, "shard-keys")
    total = base.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES)))
    # An exponential draw below size * rate: a chance of about size * rate, the same row each time.
    draw = -F.log((F.shiftrightunsigned(F.xxhash64("a", "b", F.lit("draw")), 11).cast("double") + 0.5) / F.lit(float(1 << 53)))
    rate = ranges * PER_RANGE / max(1, total)
    sample = [(r.a, r.b) for r in base.where(draw < F.col("size") * F.lit(rate)).select("a", "b").collect()]
    first, second = quantile_splitters(sample, ranges)

    @F.pandas_udf(T.IntegerType())
    def range_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(find_range(first, second, a.to_numpy(), b.to_numpy()))

    placed = materialise(base.withColumn("range_id", range_of("a", "b")), "shard-ranges")
    count = {r.range_id: (r.bytes, r.n) for r in placed.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    sizes = np.array([count.get(i, (0, 0))[0] for i in range(len(first) + 1)], np.int64)
    rows = np.array([count.get(i, (0, 0))[1] for i in range(len(first) + 1)], np.int64)
    inside = np.r_[False, second > np.iinfo(np.int64).min]  # the range starts within a group
    of = cut(sizes, inside, shards)
    before = np.cumsum(rows) - rows
    start = before - before[np.searchsorted(of, of, "left")]
    table = base.sparkSession.createDataFrame(pd.DataFrame({"range_id": np.arange(len(of), dtype=np.int32), "shard": of, "from": start}))
    place = Window.partitionBy("range_id").orderBy("a", "b", "doc_id")
    return (
        placed.withColumn("at", F.row_number().over(place) - 1)
        .join(F.broadcast(table), "range_id")
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("from") + F.col("at")).cast("long").alias("slot"), "range_id")
    )
