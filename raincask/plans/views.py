"""Grid views over the driver's tables, as DataFrames and as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import space
from ..functions.windows import forecast_window, label_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("cell")
    iy, ix = F.floor(u / 15).cast("int"), (u % 15).cast("int")
    return (
        table(spark, sf_dir, "events").select(F.col("user_id").alias("cell")).distinct()
        .select("cell", iy.alias("iy"), ix.alias("ix"), (8.0 + 2.0 * (iy % 10)).alias("lat"), (70.0 + 1.5 * ix).alias("lon"), (u % 7 != 0).alias("land"), (100.0 * (iy % 5) + 37.0 * (u % 7) + 11.0 * ix).alias("elev"))
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, label, fc, obs): daily sums, null where a side has no events."""
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), label_of(F.col("ts")).alias("label")).agg(F.round(F.sum(F.when(even, F.col("value"))), 4).alias("fc"), F.round(F.sum(F.when(~even, F.col("value"))), 4).alias("obs"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with both sides, on land and sea, with place and region."""
    p = pairs(spark, sf_dir).where("fc IS NOT NULL AND obs IS NOT NULL")
    return p.join(cells(spark, sf_dir), "cell").withColumn("region", space.region_of(F.col("lat"), F.col("lon")))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar x cells with fc and obs, zero where missing, and `valid` where both are there."""
    p = pairs(spark, sf_dir)
    days = p.select("label").distinct()  # a calendar: its rows do not grow with the number of cells
    grid = cells(spark, sf_dir).crossJoin(F.broadcast(days))
    return grid.join(p, ["cell", "label"], "left").select("cell", "iy", "ix", "lat", "lon", "land", "elev", "label", F.coalesce("fc", F.lit(0.0)).alias("fc"), F.coalesce("obs", F.lit(0.0)).alias("obs"), (F.col("fc").isNotNull() & F.col("obs").isNotNull()).alias("valid"))


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`dense` as members of one grid of ten rows of fifteen cells: 150 cells after one another are a member."""
    return dense(spark, sf_dir).withColumn("member", F.floor(F.col("iy") / 10).cast("int")).withColumn("iy", (F.col("iy") % 10).cast("int"))


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, rate): half-hourly sums; slot counts half hours from the epoch."""
    return table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).cast("long").alias("slot")).agg(F.round(F.sum("value"), 4).alias("rate"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (1 + 2 * (F.col("l_linenumber") % 2)).cast("int").alias("lead"), (F.col("l_suppkey") % 10).cast("int").alias("iy"), (F.col("l_partkey") % 10).cast("int").alias("ix"), F.year("l_shipdate").alias("year"),
        F.to_date("l_shipdate").alias("time"), F.col("l_quantity").alias("tp"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000, 8).alias("obs"), "l_orderkey", "l_partkey", "l_suppkey",
    )


def windowed(df: DataFrame) -> DataFrame:
    start, end = forecast_window(F.col("label"))
    return df.withColumn("valid_start", start).withColumn("valid_end", end)


# ---------------------------------------------------------------- the same views in SQL
def region_sql(lat: str = "lat", lon: str = "lon") -> str:
    return "CASE " + " ".join(f"WHEN {lat} BETWEEN {a} AND {b} AND {lon} BETWEEN {c} AND {d} THEN '{n}'" for n, (a, b, c, d) in space.REGIONS.items()) + " ELSE 'other' END"


SQL = {
    "cells": """SELECT cell, CAST(cell // 15 AS INT) AS iy, CAST(cell % 15 AS INT) AS ix, 8.0 + 2.0 * ((cell // 15) % 10) AS lat, 70.0 + 1.5 * (cell % 15) AS lon,
        cell % 7 <> 0 AS land, CAST(100.0 * ((cell // 15) % 5) + 37.0 * (cell % 7) + 11.0 * (cell % 15) AS DOUBLE) AS elev FROM (SELECT DISTINCT user_id AS cell FROM events)""",
    "pairs": """SELECT user_id AS cell, CAST(ts - INTERVAL 3 HOUR AS DATE) AS label, round(sum(CASE WHEN event_id % 2 = 0 THEN value END), 4) AS fc,
        round(sum(CASE WHEN event_id % 2 = 1 THEN value END), 4) AS obs FROM events GROUP BY 1, 2""",
    "paired": f"SELECT p.*, iy, ix, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, land, elev, {region_sql()} AS region FROM pairs p JOIN cells USING (cell) WHERE fc IS NOT NULL AND obs IS NOT NULL",
    "dense": """SELECT c.cell, iy, ix, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, land, elev, d.label, coalesce(fc, 0.0) AS fc, coalesce(obs, 0.0) AS obs,
        fc IS NOT NULL AND obs IS NOT NULL AS valid FROM cells c CROSS JOIN (SELECT DISTINCT label FROM pairs) d LEFT JOIN pairs p ON p.cell = c.cell AND p.label = d.label""",
    "tiled": "SELECT * REPLACE (CAST(iy % 10 AS INT) AS iy), CAST(iy // 10 AS INT) AS member FROM dense",
    "granules": "SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) AS slot, round(sum(value), 4) AS rate FROM events GROUP BY 1",
    "ladder": """SELECT CAST(1 + 2 * (l_linenumber % 2) AS INT) AS lead, CAST(l_suppkey % 10 AS INT) AS iy, CAST(l_partkey % 10 AS INT) AS ix, CAST(year(l_shipdate) AS INT) AS year,
        CAST(l_shipdate AS DATE) AS time, l_quantity AS tp, round(l_extendedprice * (1 - l_discount) / 1000, 8) AS obs, l_orderkey, l_partkey, l_suppkey FROM lineitem""",
}
NEEDS = {"paired": ["pairs", "cells"], "dense": ["pairs", "cells"], "tiled": ["pairs", "cells", "dense"]}


def sql(body: str, *names: str) -> str:
    """body after WITH for the views it names and those that they need."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
