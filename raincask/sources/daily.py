"""Daily and sub-daily tables: strict checks, concatenation, accumulation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairing import GateError, assert_empty


def concatenated(parts: Sequence[DataFrame], keys: Sequence[str], wanted: DataFrame | None = None, on: str = "time") -> DataFrame:
    """All parts under one another; a key in two parts is fatal; `wanted` (column `on`) selects."""
    df = reduce(DataFrame.unionByName, parts)
    assert_empty(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "duplicate keys across files")
    return df if wanted is None else df.join(wanted.select(on).distinct(), on, "left_semi")


def checked_daily(df: DataFrame, value: str = "rain", time: str = "time", units: str = "mm", fill: float = -999.0) -> DataFrame:
    """A daily table with fill values as null; wrong units, a step other than a day or a negative value is an error."""
    if units not in ("mm", "mm/day"):
        raise GateError(f"units are {units!r}")
    out = df.withColumn(value, F.when((F.col(value) != fill) & ~F.isnan(value), F.col(value)))
    assert_empty(out.where(F.col(value) < 0), "negative rainfall")
    axis = out.select(F.to_date(time).alias("d")).distinct().agg(F.count("*").alias("n"), (F.date_diff(F.max("d"), F.min("d")) + 1).alias("span"))
    assert_empty(axis.where("n <> span"), "days are not contiguous")
    return out


def forecast_day(accum: DataFrame, state: DataFrame, fields: Sequence[str], hours: Sequence[int]) -> DataFrame:
    """Rain as the difference of two running totals, clipped at zero, and the mean of the sample hours' states.

    accum: (key, start, total at both ends as t0, t1); state: (key, hour, fields). All sample hours have to be there.
    """
    rain = accum.select("key", F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0)).alias("tp"))
    some = state.where(F.col("hour").isin(list(hours))).groupBy("key").agg(F.count("*").alias("_n"), *(F.avg(f).alias(f) for f in fields))
    full = some.select("key", *(F.when(F.col("_n") == len(hours), F.col(f)).alias(f) for f in fields))
    return rain.join(full, "key", "left")


def selected_granules(df: DataFrame, first: int, last: int, slot: str = "slot") -> DataFrame:
    """Granules that start in [first, last); one slot twice is fatal."""
    out = df.where((F.col(slot) >= first) & (F.col(slot) < last))
    assert_empty(out.groupBy(slot).agg(F.count("*").alias("n")).where("n > 1"), "duplicate granules")
    return out
