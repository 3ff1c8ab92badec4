"""Files as tables: which are there, which are whole, and what their sizes say; polygons; merged settings.

Contents stay where they are: listings read no content, audits read each file once, in its task.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairing import assert_empty
from .mapping import SourceError, mapped, source

#: Properties that may hold a district's name, and its state, the first that is there (fixed values).
NAMES = ("district", "DISTRICT", "dtname", "NAME_2", "district_name", "name")
STATES = ("state", "STATE", "stname", "NAME_1")


# ---------------------------------------------------------------- settings
def merged(defaults: Mapping[str, object], given: Mapping[str, object], where: str = "") -> dict[str, object]:
    """Defaults with what is given over them, section by section; an unknown key is an error."""
    unknown = [f"{where}{k}" for k in given if k not in defaults]
    if unknown:
        raise SourceError(f"unknown settings: {unknown}")
    return {k: merged(v, given[k] or {}, f"{where}{k}.") if isinstance(v, Mapping) and v and k in given else given.get(k, v) for k, v in defaults.items()}


def read_settings(spark: SparkSession, path: str, defaults: Mapping[str, object], **over: object) -> dict[str, object]:
    """Defaults, over them a JSON file (or a YAML one, where a YAML parser is installed) of any store that Spark reads, over that what is given."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise SourceError(f"{path}: no YAML parser is installed; settings may be JSON, too") from e
        told = yaml.safe_load(text)
    else:
        told = json.loads(text) if text.strip() else {}
    if not isinstance(told or {}, Mapping):
        raise SourceError(f"{path}: settings are not a mapping")
    return merged(merged(defaults, told or {}), over)


# ---------------------------------------------------------------- files
def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, size) of each file under a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def resolved(found: DataFrame, wanted: DataFrame, template: str) -> DataFrame:
    """wanted (init, hour) with the name of its file; a file that is not there is an error. `template` is a printf format of yyyymmddhh and hour."""
    named = wanted.withColumn("name", F.format_string(template, F.date_format("init", "yyyyMMddHH"), "hour"))
    assert_empty(named.join(found.select("name"), "name", "left_anti"), "no such file")
    return named


def audited(spark: SparkSession, path: str, magic: str = "PAR1", pattern: str = "*") -> DataFrame:
    """(name, size, status) of cached files: 'good', or 'damaged' where the format's magic bytes are not at both ends. Spark lists no file without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    n = len(magic)
    ends = (F.substring("content", 1, n) == F.lit(magic.encode())) & (F.expr(f"substring(content, length(content) - {n - 1}, {n})") == F.lit(magic.encode()))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.when(ends & (F.col("length") >= 2 * n), "good").otherwise("damaged").alias("status"))


def raw_grid_facts(found: DataFrame, rows: int, columns: int, bytes_per_value: int = 4) -> DataFrame:
    """What sizes alone say of raw grid files: whole fields of rows x columns, and whether that is a year of days. The layout is assumed, not read."""
    one = rows * columns * bytes_per_value
    fields = F.when(F.col("size") % one == 0, F.floor(F.col("size") / one))
    return found.select("name", "size", fields.alias("fields"), fields.isin(365, 366).alias("is_year"), F.lit(f"assumed {rows} x {columns}, {bytes_per_value} bytes").alias("layout"))


def granule_plan(days: DataFrame, per_day: int = 48, column: str = "label") -> DataFrame:
    """(label, slot, starts): the granules that each daily window from 03 UTC needs, in order."""
    minutes = 1440 // per_day
    start = F.col(column).cast("timestamp_ntz") + F.expr("INTERVAL 3 HOUR")
    return days.select(column, F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("slot")).withColumn("starts", start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("slot") * minutes))


# ---------------------------------------------------------------- polygons
def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(district, ring array<struct<x, y>>): outer rings of a GeoJSON collection's polygons, one row a ring.

    The name is the first of NAMES, with the first of STATES in brackets; without one it is the number of the feature.
    """
    point = "array<double>"
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("at", "f"))
    of = lambda keys: F.coalesce(*(F.col("f.properties")[k] for k in keys))
    name, state = F.coalesce(of(NAMES), F.concat(F.lit("district_"), F.col("at"))), of(STATES)
    one = F.from_json("f.geometry.coordinates", f"array<array<{point}>>")
    many = F.from_json("f.geometry.coordinates", f"array<array<array<{point}>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.transform(many, lambda p: p[0])).otherwise(F.array(one[0]))
    told = each.select(F.when(state.isNull(), name).otherwise(F.concat(name, F.lit(" ("), state, F.lit(")"))).alias("district"), F.explode(rings).alias("points"))
    return told.select("district", F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


# ---------------------------------------------------------------- sources with a contract of their own
@source("obs", "gauge")
@source("obs", "merged")
def read_daily_rain(spark: SparkSession, path: str, value: str = "rain", fill: float = -999.0) -> DataFrame:
    """Daily rain (time, lat, lon, rain): fill values are null, a negative value is an error."""
    df = spark.read.parquet(path)
    out = mapped(df, {"rain": (value, 1.0, 0.0)}, ["time", "lat", "lon"]).withColumn("rain", F.when(F.col("rain") != fill, F.col("rain")))
    assert_empty(out.where("rain < 0"), "negative rainfall")
    return out


@source("obs_native", "granules")
def read_granules(spark: SparkSession, path: str, rate: str = "rate") -> DataFrame:
    """Half-hourly rates (slot, starts, lat, lon, rate in mm/h): intervals of exactly 30 minutes; rates below zero are missing."""
    df = spark.read.parquet(path)
    assert_empty(df.where("ends - starts <> INTERVAL '30' MINUTE").select("starts", "ends"), "a granule is not half an hour long")
    slot = F.floor(F.unix_micros(F.col("starts").cast("timestamp")) / 1_800_000_000).cast("long")
    return mapped(df.withColumn("slot", slot), {"rate": (rate, 1.0, 0.0)}, ["slot", "starts", "lat", "lon"]).withColumn("rate", F.when(F.col("rate") >= 0, F.col("rate")))


@source("forecast", "operational")
def read_operational(spark: SparkSession, path: str) -> DataFrame:
    """A forecast of the usual columns with pressure in Pa, which becomes hPa."""
    return mapped(spark.read.parquet(path), {"tp": ("tp", 1.0, 0.0), "mslp": ("mslp", 0.01, 0.0)}, ["time", "lead", "lat", "lon"])


@source("forecast", "daily")
def read_forecast(spark: SparkSession, path: str, fields: tuple[str, ...] = ("mslp", "u", "v"), strict: bool = True) -> DataFrame:
    """(lead, time, lat, lon, tp, fields, wind): a missing field is an error if strict, else null; wind is the speed of u and v."""
    df = spark.read.parquet(path)
    missing = [f for f in ("tp", *fields) if f not in df.columns]
    if missing and strict:
        raise SourceError(f"columns missing: {missing}")
    full = df.withColumns({f: F.lit(None).cast("double") for f in missing})
    return full.select("lead", "time", "lat", "lon", "tp", *fields, *([F.hypot("u", "v").alias("wind")] if {"u", "v"} <= set(fields) else []))
