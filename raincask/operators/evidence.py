"""Stratified atlas and block-bootstrap evidence over paired cell-days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rain import hedges_g, ratio
from .scores import continuous_aggregates, contingency_scores


def sufficient(x: str, tag: str) -> list[Column]:
    """n, sum, sum of squares, sum of absolute values: all that effects need, and they add up."""
    return [F.count(x).alias(f"n{tag}"), F.sum(x).alias(f"s{tag}"), F.sum(F.col(x) * F.col(x)).alias(f"q{tag}"), F.sum(F.abs(x)).alias(f"a{tag}")]


def effect(df: DataFrame) -> DataFrame:
    """mean_diff, mae_diff, hedges_g of groups 1 and 0 from their sufficient statistics."""
    c = F.col
    mean = lambda t: ratio(c(f"s{t}"), c(f"n{t}"))
    var = lambda t: (c(f"q{t}") - c(f"s{t}") * c(f"s{t}") / c(f"n{t}")) / F.nullif((c(f"n{t}") - 1).cast("double"), F.lit(0.0))
    return df.withColumns({"mean_diff": mean(1) - mean(0), "mae_diff": ratio(c("a1"), c("n1")) - ratio(c("a0"), c("n0")), "hedges_g": hedges_g(c("n1"), mean(1), var(1), c("n0"), mean(0), var(0))})


def resample_index(rep: Column, draw: Column, blocks: Column) -> Column:
    """A block number for each (replicate, draw): arithmetic, so that any engine draws the same."""
    return F.pmod(F.pmod(rep * 7919 + draw * 104_729 + draw * draw * 31 + 42, F.lit(1_000_003)), blocks)


def block_bootstrap(df: DataFrame, error: str, target: Column, reference: Column, block: str, replicates: int = 200, confidence: float = 0.95) -> DataFrame:
    """One row: matched blocks, effects, and their percentile intervals over resampled blocks.

    Cells are summed up to blocks first; replicates touch blocks only, whose number is that of the days
    or systems. Blocks without both groups do not count.
    """
    x1, x0 = F.when(target, F.col(error)), F.when(reference, F.col(error))
    sides = df.select(block, x1.alias("_x1"), x0.alias("_x0"))
    blocks = sides.groupBy(block).agg(*sufficient("_x1", "1"), *sufficient("_x0", "0")).where("n1 > 0 AND n0 > 0")
    numbered = blocks.withColumn("_i", F.row_number().over(Window.orderBy(block)) - 1)
    total = numbered.agg(F.count("*").alias("_blocks"))
    draws = df.sparkSession.range(replicates).withColumnRenamed("id", "rep").crossJoin(F.broadcast(total)).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    sums = [F.sum(c).alias(c) for c in ("n1", "s1", "q1", "a1", "n0", "s0", "q0", "a0")]
    again = draws.withColumn("_i", resample_index(F.col("rep"), F.col("draw"), F.col("_blocks"))).join(F.broadcast(numbered), "_i").groupBy("rep").agg(*sums)
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    ends = effect(again).agg(*(F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in ("mean_diff", "mae_diff", "hedges_g") for n, p in (("low", low), ("high", high))))
    whole = effect(blocks.agg(F.count("*").alias("blocks"), *sums)).select("blocks", "n1", "n0", "mean_diff", "mae_diff", "hedges_g")
    return whole.crossJoin(F.broadcast(ends))


def material(df: DataFrame, least_blocks: int = 10, least_cells: int = 100, g: float = 0.2, mae: float = 1.0) -> DataFrame:
    """Whether the comparison is usable, and whether both intervals exclude zero by material amounts."""
    usable = (F.col("blocks") >= least_blocks) & (F.col("n1") >= least_cells) & (F.col("n0") >= least_cells)
    apart = lambda c: (F.col(f"{c}_low") > 0) | (F.col(f"{c}_high") < 0)
    return df.withColumn("usable", usable).withColumn("material", usable & apart("hedges_g") & (F.abs("hedges_g") >= g) & apart("mae_diff") & (F.abs("mae_diff") >= mae))


#: Days that one bitmap holds, and which of them are kept: from 1810 to 2079.
BITMAP_DAYS, BITMAPS = 32_768, (-1, 0, 1)


def distinct_days(day: str, some: Column | None = None) -> Column:
    """How many different days a group has, among rows where `some` is true: an aggregate of bitmaps, so nothing is sorted or counted apart.

    Bitmaps of a group merge by `or`, before the shuffle too, and take 4 KB for each 90 years. A day
    beyond BITMAPS is an error.
    """
    number = F.date_diff(F.col(day).cast("date"), F.lit("1900-01-01").cast("date"))
    bucket, position = F.floor(number / BITMAP_DAYS), F.pmod(number, F.lit(BITMAP_DAYS)).cast("long")
    there = F.col(day).isNotNull() if some is None else F.col(day).isNotNull() & some
    strange = F.max(F.when(there & ~bucket.isin(*BITMAPS), F.raise_error(F.lit("a day lies outside 1810 to 2079")).cast("long")))
    return sum((F.bitmap_count(F.bitmap_construct_agg(F.when(there & (bucket == k), position))) for k in BITMAPS), F.coalesce(strange, F.lit(0).cast("long")))


def by_threshold(grouped: DataFrame, keys: Sequence[str], thresholds: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Columns <name>_<place of the threshold> as a row for each threshold."""
    each = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{n}_{i}").alias(n) for n in names)) for i, t in enumerate(thresholds)))
    wide = {f"{n}_{i}" for n in names for i in range(len(thresholds))}
    return grouped.withColumn("_each", F.explode(each)).select(*keys, *(c for c in grouped.columns if c not in wide and c not in keys), "_each.*")


def atlas(long: DataFrame, fc: str, obs: str, day: str, thresholds: Sequence[float], template: DataFrame) -> DataFrame:
    """Scores by (axis, regime, region or 'all', threshold); groups of the template without data appear with n = 0.

    long has one row for each cell-day and mask. All thresholds are columns of one pass, days are bitmaps,
    and grouping sets give the region margin in the same pass.
    """
    names = ("hits", "false_alarms", "misses", "correct_negatives", "events")
    counts = []
    for i, t in enumerate(thresholds):
        f, o = F.col(fc) >= float(t), F.col(obs) >= float(t)
        counts += [F.count_if(c).alias(f"{n}_{i}") for n, c in zip(names, (f & o, f & ~o, ~f & o, ~f & ~o, o))]
    keys = ["axis", "regime", "region"]
    g = long.groupingSets([keys, keys[:2]], *keys).agg(*continuous_aggregates(fc, obs), distinct_days(day).alias("n_days"), *counts)
    g = contingency_scores(by_threshold(g, keys, thresholds, names).withColumn("region", F.coalesce("region", F.lit("all"))))
    out = template.join(g, [*keys, "threshold"], "left")
    filled = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_days", "events")})
    note = F.concat_ws("; ", F.when(F.col("n_days") < 30, "few days"), F.when(F.col("n") < 1000, "few cells"), F.when(F.col("events") < 20, "few events"))
    return filled.withColumn("low_sample", note)


def threshold_counts(long: DataFrame, obs: str, day: str, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, threshold, events, months): events at >= each threshold, and in how many months of the year; one pass, a month being a bit."""
    counts = []
    for i, t in enumerate(thresholds):
        hit = F.col(obs) >= float(t)
        months = F.bit_count(F.bit_or(F.when(hit, F.expr(f"shiftleft(1, month({day}) - 1)")))).cast("long")
        counts += [F.count_if(hit).alias(f"events_{i}"), F.coalesce(months, F.lit(0).cast("long")).alias(f"months_{i}")]
    return by_threshold(long.groupBy(*by).agg(*counts), by, thresholds, ("events", "months"))


def atlas_maps(df: DataFrame, fc: str, obs: str, regime: str, threshold: float, cell: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Per cell and regime: days, mean error, and the hits, misses and false alarms at >= threshold."""
    f, o = F.col(fc) >= threshold, F.col(obs) >= threshold
    return df.groupBy(*cell, regime).agg(F.count("*").alias("days"), F.avg(F.col(fc) - F.col(obs)).alias("bias"), F.count_if(f & o).alias("hits"), F.count_if(~f & o).alias("misses"), F.count_if(f & ~o).alias("false_alarms"))
