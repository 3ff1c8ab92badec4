"""Sources by name: each reads Parquet or JSON into a canonical table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.pairing import assert_empty

SOURCES: dict[tuple[str, str], Callable[..., DataFrame]] = {}
KINDS = ("forecast", "obs", "obs_native", "analysis")


class SourceError(ValueError):
    """No such source, or a field of it is missing or ambiguous."""


def source(kind: str, name: str):
    """Register a reader (spark, path, **options) under a kind and a name."""
    if kind not in KINDS:
        raise SourceError(f"unknown kind {kind!r}")

    def note(read):
        SOURCES[kind, name] = read
        return read

    return note


def open_source(spark: SparkSession, kind: str, name: str, path: str, **options) -> DataFrame:
    if (kind, name) not in SOURCES:
        raise SourceError(f"no {kind} source {name!r}; there are {sorted(n for k, n in SOURCES if k == kind)}")
    return SOURCES[kind, name](spark, path, **options)


def mapped(df: DataFrame, fields: dict[str, tuple[str, float, float]], keep: list[str] = ()) -> DataFrame:
    """canonical = source * scale + offset for each field; NaN becomes null. A missing column is an error at once."""
    missing = [s for s, _, _ in fields.values() if s not in df.columns]
    if missing:
        raise SourceError(f"columns missing: {missing}")
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(*keep, *((value(s) * scale + offset).alias(name) for name, (s, scale, offset) in fields.items()))


def pick_column(df: DataFrame, candidates: list[str]) -> str:
    """The one column of the candidates that is there; none or two is an error."""
    there = [c for c in candidates if c in df.columns]
    if len(there) != 1:
        raise SourceError(f"expected one of {candidates}, found {there}")
    return there[0]


@source("forecast", "parquet")
@source("obs", "parquet")
@source("obs_native", "parquet")
@source("analysis", "parquet")
def read_parquet(spark: SparkSession, path: str, fields: dict[str, tuple[str, float, float]] | None = None, keep: list[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return mapped(df, fields, keep) if fields else df


def no_fill(value: str, above: float = -998.0):
    """Values at or below the fill limit are null."""
    return F.when(F.col(value) > above, F.col(value))


#: What each kind of table has to hold: its key and its fields.
CONTRACTS = {
    "forecast": (("lead", "time", "iy", "ix"), ("tp", "u850", "v850", "tcwv", "cape", "mslp")),
    "obs": (("time", "iy", "ix"), ("rain",)),
    "analysis": (("time", "iy", "ix"), ("u850", "v850", "tcwv", "cape", "mslp")),
    "static": (("iy", "ix"), ("slope", "aspect", "elev", "land", "coast_dist")),
}


def increasing(df: DataFrame, index: str, coordinate: str) -> DataFrame:
    """The index values whose coordinate is missing, not the only one, or not above that of the index before: none if all is well."""
    axis = df.groupBy(index).agg(F.min(coordinate).alias("least"), F.max(coordinate).alias("most"))  # a row a grid line
    before = F.lag("most").over(Window.orderBy(index))
    return axis.where(F.col("least").isNull() | (F.col("least") != F.col("most"))).select(index).unionByName(axis.withColumn("_b", before).where("least <= _b").select(index)).distinct()


def validated(df: DataFrame, kind: str) -> DataFrame:
    """df, if it keeps its kind's contract: its fields are there, each key comes once, and lat and lon grow with iy and ix.

    A forecast's rain may be missing, but not negative. Fields beyond the contract are left alone.
    """
    if kind not in CONTRACTS:
        raise SourceError(f"no such kind: {kind}")
    keys, fields = CONTRACTS[kind]
    missing = [c for c in (*keys, "lat", "lon", *fields) if c not in df.columns]
    if missing:
        raise SourceError(f"{kind}: columns missing: {missing}")
    assert_empty(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), f"{kind}: a key comes twice")
    for index, coordinate in (("iy", "lat"), ("ix", "lon")):
        assert_empty(increasing(df, index, coordinate), f"{kind}: {coordinate} does not increase with {index}")
    if kind == "forecast":
        assert_empty(df.where("tp < 0"), "forecast: negative rain")
    return df
