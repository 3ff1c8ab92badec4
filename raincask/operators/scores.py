"""Verification scores as aggregations. Undefined scores are null, never NaN or zero."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rain import ratio
from ..storage import stored

#: Rows of a range of values, on average, from which there are more ranges than shuffle partitions.
RANGE_ROWS = 1_000_000
#: Rows of a table of groups that a task may be sent whole.
BROADCAST_GROUPS = 10_000
# Literal edges of the ten reliability bins, as equal steps of a tenth come out in binary.
RELIABILITY_EDGES = [i / 10 for i in range(11)]


def _by(by: Sequence[str]) -> list[str]:
    return list(by)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded: sums in another order differ in their last bits."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def continuous_aggregates(fc: str, obs: str) -> list[Column]:
    e = F.col(fc) - F.col(obs)
    ok = F.col(fc).isNotNull() & F.col(obs).isNotNull()
    both = lambda c: F.when(ok, c)
    r = F.when((F.count(both(F.lit(1))) > 2) & (F.stddev_pop(both(F.col(fc))) > 0) & (F.stddev_pop(both(F.col(obs))) > 0), F.corr(both(F.col(fc)), both(F.col(obs))))
    return [F.count(both(F.lit(1))).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r.alias("r"), F.avg(both(F.col(fc))).alias("mean_fc"), F.avg(both(F.col(obs))).alias("mean_obs")]


def continuous(df: DataFrame, fc: str, obs: str, by: Sequence[str] = ()) -> DataFrame:
    """n, bias, MAE, RMSE, correlation (null for two pairs or fewer, or without variance), means."""
    return df.groupBy(*_by(by)).agg(*continuous_aggregates(fc, obs))


def contingency_scores(counts: DataFrame) -> DataFrame:
    h, f, m, c = (F.col(x).cast("double") for x in ("hits", "false_alarms", "misses", "correct_negatives"))
    n = h + f + m + c
    chance = (h + m) * (h + f) / F.nullif(n, F.lit(0.0))
    return counts.withColumns({"pod": ratio(h, h + m), "far": ratio(f, h + f), "csi": ratio(h, h + f + m), "ets": ratio(h - chance, h + f + m - chance), "freq_bias": ratio(h + f, h + m), "base_rate": ratio(h + m, n)})


def contingency(df: DataFrame, fc: str, obs: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Hits, false alarms, misses, correct negatives at `>=` each threshold, and the scores from them."""
    each = df.where(F.col(fc).isNotNull() & F.col(obs).isNotNull()).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    f, o = F.col(fc) >= F.col("threshold"), F.col(obs) >= F.col("threshold")
    counts = each.groupBy(*_by(by), "threshold").agg(F.count_if(f & o).alias("hits"), F.count_if(f & ~o).alias("false_alarms"), F.count_if(~f & o).alias("misses"), F.count_if(~f & ~o).alias("correct_negatives"))
    return contingency_scores(counts)


def metric_block(df: DataFrame, fc: str, obs: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Continuous scores and, for each threshold, contingency scores with the threshold in their names; one pass."""
    counts = []
    for t in thresholds:
        f, o, tag = F.col(fc) >= t, F.col(obs) >= t, f"{t:g}".replace(".", "_")
        counts += [F.count_if(f & o).alias(f"hits_{tag}"), F.count_if(f & ~o).alias(f"false_alarms_{tag}"), F.count_if(~f & o).alias(f"misses_{tag}")]
    out = df.groupBy(*_by(by)).agg(*continuous_aggregates(fc, obs), *counts)
    for t in thresholds:
        tag = f"{t:g}".replace(".", "_")
        h, f, m = F.col(f"hits_{tag}"), F.col(f"false_alarms_{tag}"), F.col(f"misses_{tag}")
        out = out.withColumns({f"pod_{tag}": ratio(h, h + m), f"far_{tag}": ratio(f, h + f), f"csi_{tag}": ratio(h, h + f + m)})
    return out


def running_counts(df: DataFrame, value: str, weights: dict[str, Column], by: Sequence[str] = (), seen: DataFrame | None = None) -> DataFrame:
    """(by, value, weights): df's sums by group and distinct value, with `<w>_below`, the sum over the group's smaller values, and `<w>_all`.

    Order statistics without a window over a whole group: about equal numbers of rows lie between
    neighbouring cuts (one pass of approximate quantiles; as many ranges as shuffle partitions, more where
    a range would hold over RANGE_ROWS rows), each range of a group adds up by itself, and the ranges' totals, a few numbers each, are added to them in order. So one
    group may hold all rows. The cuts decide where sums are made, never what they are. Nulls are left out. `seen` has the values for the cuts, if df is dear.
    """
    there = df.where(F.col(value).isNotNull())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = 1000  # steps of the sketch; finer cuts are a part of it
    sketch = (there if seen is None else seen.where(F.col(value).isNotNull())).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*(F.lit(k / fine) for k in range(1, fine))), 10 * fine).alias("c"), F.count("*").alias("n")).first()
    parts = min(fine, max(parts, math.ceil(sketch["n"] / RANGE_ROWS)))
    cuts = [sketch["c"][k * fine // parts - 1] for k in range(1, parts)] if sketch["c"] else None
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    counts = there.groupBy(*by, value).agg(*(c.alias(w) for w, c in weights.items())).withColumn("_range", place).repartition(parts, *by, "_range")
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "_range").agg(*(F.sum(w).alias(f"_t_{w}") for w in weights))  # a row for each group and range it lies in
    order = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_t_{w}").over(order), F.lit(0)).alias(f"_b_{w}") for w in weights), *(F.sum(f"_t_{w}").over(Window.partitionBy(*by)).alias(f"{w}_all") for w in weights))
    placed = counts.withColumns({f"_w_{w}": F.coalesce(F.sum(w).over(within), F.lit(0)) for w in weights}).alias("placed")
    before = before.alias("before")
    same = F.lit(True)
    for c in (*by, "_range"):
        same = same & F.col(f"placed.{c}").eqNullSafe(F.col(f"before.{c}"))
    return placed.join(before, same).select(*(F.col(f"placed.{c}") for c in (*by, value, *weights)), *((F.col(f"_b_{w}") + F.col(f"_w_{w}")).alias(f"{w}_below") for w in weights), *(F.col(f"{w}_all") for w in weights))


def average_rank(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rank of each value within its stratum, ties averaged; from counts of distinct values, so ties cost nothing."""
    ranks = running_counts(df, value, {"_ties": F.count("*")}, by).select(*by, value, (F.col("_ties_below") + (F.col("_ties") + 1) / 2).alias("rank"))
    return df.join(ranks, [*by, value])


def quantiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, q): interpolated quantiles of the values that are there, as an array in the order of `levels`. A row stands for `weight` values.

    They come from counts of distinct values and their running sums (`running_counts`), so neither a group
    nor the whole table is sorted in one task. A group without a value has no row; without `by` there is
    one row, whose quantiles are null if there is no value.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_k") if weight is None else F.col(weight).alias("_k"))
    placed = running_counts(rows, "_v", {"_n": F.sum("_k")}, by).withColumn("_upto", F.col("_n_below") + F.col("_n"))
    return placed.groupBy(*by).agg(*_ends(levels)).select(*by, _interpolated(levels).alias("q"))


def _ends(levels: Sequence[float]) -> list[Column]:
    """Of `running_counts` with `_n` and `_upto`: the number of values, and the two values that each level lies between."""
    place = [(F.col("_n_all") - 1) * F.lit(float(level)) for level in levels]
    ends = [end for p in place for end in (F.min(F.when(F.col("_upto") > F.floor(p), F.col("_v"))), F.min(F.when(F.col("_upto") > F.ceil(p), F.col("_v"))))]
    return [F.max("_n_all").alias("_n_all"), *(e.alias(f"_e{i}") for i, e in enumerate(ends))]


def _interpolated(levels: Sequence[float]) -> Column:
    place = [(F.col("_n_all") - 1) * F.lit(float(level)) for level in levels]
    return F.array(*(F.when(F.floor(p) == F.ceil(p), F.col(f"_e{2 * i}")).otherwise((F.ceil(p) - p) * F.col(f"_e{2 * i}") + (p - F.floor(p)) * F.col(f"_e{2 * i + 1}")) for i, p in enumerate(place)))


def quantiles_of(df: DataFrame, values: Sequence[str], levels: Sequence[float], by: Sequence[str], wide: Sequence[str] | None = None) -> DataFrame:
    """(by, n, q_<value> for each value): `quantiles` of several columns by the same groups, n being all rows of a group.

    With `wide`, some of `by`, there are groups by those alone, too, whose other keys are null and whose `_wide`
    is true. Equal values are counted once for all groups.
    """
    by = list(by)
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(values)))).alias("_e")
    long = df.select(*by, place)
    folded = long.groupBy(*by, "_e._c", "_e._v").agg(F.count("*").alias("_k"))
    folded = folded.withColumn("_wide", F.explode(F.array(F.lit(False), F.lit(True)) if wide is not None else F.array(F.lit(False))))
    keys = ["_wide", *by]
    folded = folded.select("_wide", *(F.when(~F.col("_wide"), F.col(c)).alias(c) if wide is not None and c not in wide else F.col(c) for c in by), "_c", "_v", "_k")
    placed = running_counts(folded, "_v", {"_n": F.sum("_k")}, [*keys, "_c"], long.select("_e._v")).withColumn("_upto", F.col("_n_below") + F.col("_n"))
    found = placed.groupBy(*keys, "_c").agg(*_ends(levels))
    each = found.select(*keys, "_c", _interpolated(levels).alias("q")).groupBy(*keys).agg(*(F.max_by("q", F.when(F.col("_c") == i, 1)).alias(f"q_{v}") for i, v in enumerate(values)))
    n = df.groupBy(*by).agg(F.count("*").alias("_k")).withColumn("_wide", F.explode(F.array(F.lit(False), F.lit(True)) if wide is not None else F.array(F.lit(False))))
    n = n.select("_wide", *(F.when(~F.col("_wide"), F.col(c)).alias(c) if wide is not None and c not in wide else F.col(c) for c in by), "_k").groupBy(*keys).agg(F.sum("_k").alias("n"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"each.{c}"))
    out = n.alias("n").join(each.alias("each"), same, "left")
    return out.select(*(["n._wide"] if wide is not None else []), *(f"n.{c}" for c in by), "n.n", *(f"each.q_{v}" for v in values))


def rank_auc(df: DataFrame, value: str, event: str, by: Sequence[str]) -> DataFrame:
    """n_event, n_other, auc (null without both): the chance that an event's value is above another's, ties half."""
    scored = running_counts(df, value, {"_e": F.count_if(F.col(event)), "_o": F.count_if(~F.col(event))}, by).withColumn("_u", F.col("_e") * (F.col("_o_below") + F.col("_o") / 2))
    return scored.groupBy(*by).agg(F.sum("_e").alias("n_event"), F.sum("_o").alias("n_other"), F.sum("_u").alias("u")).withColumn("auc", ratio(F.col("u"), F.col("n_event") * F.col("n_other"))).drop("u")


def probabilistic(df: DataFrame, p: str, event: str, by: Sequence[str]) -> DataFrame:
    """n, Brier score, that of the base rate, skill, ROC area, base rate."""
    y = F.col(event).cast("double")
    brier = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(y).alias("base_rate"))
    brier = brier.withColumn("brier_climatology", F.col("base_rate") * (1 - F.col("base_rate"))).withColumn("bss", 1 - ratio(F.col("brier"), F.col("brier_climatology")))
    return brier.join(rank_auc(df, p, event, by).select(*by, "auc"), list(by))


def reliability(df: DataFrame, p: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Ten bins of the forecast probability; empty bins do not appear."""
    inner = sum(((F.col(p) >= edge).cast("int") for edge in RELIABILITY_EDGES[1:10]), F.lit(0))
    return df.withColumn("bin", inner).groupBy(*_by(by), "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(event).cast("double")).alias("obs_freq")).withColumn("mid", (F.col("bin") + 0.5) / 10)


def stability_index(df: DataFrame, value: str, side: str, reference: str, tests: str, by: Sequence[str] = ()) -> DataFrame:
    """Population stability index of `value` between two sides, over the deciles of the reference side.

    Fewer than three distinct decile edges give 0. Values beyond the outer edges count in the outer bins.
    """
    keys = _by(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(1))
    edges = quantiles(df.where(F.col(side) == reference), value, [i / 10 for i in range(11)], keys).select(*keys, F.array_distinct("q").alias("_edges"))
    edges = edges.withColumn("_inner", F.when(F.size("_edges") < 3, F.array().cast("array<double>")).otherwise(F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))))
    # Few groups go to all tasks, so that no row moves; a group never lies in one task, however many there are.
    edges, _ = stored(edges, "edges")
    if edges.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        met = df.join(F.broadcast(edges), keys)
    else:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.xxhash64(value, side), F.lit(parts)).cast("int")
        folded = df.groupBy(*keys, value, side).agg(F.count("*").alias("_k"))
        met = folded.withColumn("_s", spread).join(edges.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*keys, "_s"])
    k = F.col("_k") if "_k" in met.columns else F.lit(1)
    binned = met.withColumn("_bin", F.size(F.filter("_inner", lambda e: F.col(value) >= e)))
    counted = lambda which: F.coalesce(F.sum(F.when(F.col(side) == which, k)), F.lit(0)).cast("long")
    counts = binned.groupBy(*keys, "_bin").agg(counted(reference).alias("_a"), counted(tests).alias("_b"), F.max(F.size("_edges")).alias("_size"))
    total = Window.partitionBy(*keys)
    pa, pb = ratio(F.col("_a"), F.sum("_a").over(total)) + 1e-6, ratio(F.col("_b"), F.sum("_b").over(total)) + 1e-6
    shares = counts.withColumn("_term", F.when(F.col("_size") < 3, 0.0).otherwise((pb - pa) * F.log(pb / pa)))
    out = shares.groupBy(*keys).agg(F.sum("_term").alias("psi"), F.count("*").alias("bins"))
    return out if by else out.drop("_all")
