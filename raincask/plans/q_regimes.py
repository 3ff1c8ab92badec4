"""Queries of regimes, runs, systems, atlas and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rain, space
from ..operators import detection as DT
from ..operators import evidence as E
from ..operators import focal as W
from ..operators import regimes as R
from ..operators.scores import rounded as R6
from .book import query
from .q_grid import GRID, grid
from .q_joins import CENTRES, INFLUENCE, centres
from .q_scores import CONT
from .views import cells, paired, sql, table, tiled

S = lambda c: c.cast("string")


@query("a14_zone_mean", sql("SELECT CAST(label AS VARCHAR) AS label, round(sum(cos(radians(lat)) * obs) / nullif(sum(cos(radians(lat))), 0), 6) AS zone FROM (SELECT label, lat, CASE WHEN land AND lat BETWEEN 18 AND 28 AND lon BETWEEN 65 AND 88 THEN obs END AS obs FROM paired) WHERE obs IS NOT NULL GROUP BY 1", "paired"))
def a14(spark, d):
    inside = F.col("land") & space.in_box(F.col("lat"), F.col("lon"), space.INDEX_BOX)
    return R6(R.zone_mean(paired(spark, d).where(inside), "obs", F.lit(True), "label").withColumn("label", S(F.col("label"))))


STATE = """st AS (SELECT l_suppkey % 20 AS k, CAST(l_shipdate AS DATE) AS day, CAST(CASE WHEN avg(l_quantity) >= 29 THEN 1 WHEN avg(l_quantity) <= 22 THEN -1 ELSE 0 END AS INT) AS state FROM lineitem GROUP BY 1, 2)"""


def states(spark, d):
    q = F.avg("l_quantity")
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("k"), F.to_date("l_shipdate").alias("day")).agg(F.when(q >= 29, 1).when(q <= 22, -1).otherwise(0).alias("state"))


@query("w08_run_filter", f"""WITH {STATE}, a AS (SELECT *, CASE WHEN lag(state) OVER w = state AND day - lag(day) OVER w = 1 THEN 0 ELSE 1 END AS new FROM st WINDOW w AS (PARTITION BY k ORDER BY day)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY day) AS run FROM a) SELECT k, CAST(day AS VARCHAR) AS day, state, CAST(CASE WHEN state <> 0 AND count(*) OVER (PARTITION BY k, run) >= 3 THEN state ELSE 0 END AS INT) AS kept FROM b""")
def w08(spark, d):
    return R.run_filter(states(spark, d), "state", "day", ["k"]).select("k", S(F.col("day")).alias("day"), "state", "kept")


CLIM = """z AS (SELECT l_suppkey % 5 AS k, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2), c AS (SELECT k, month(day) AS m, avg(x) AS mu, stddev_samp(x) AS sd FROM z GROUP BY 1, 2)"""


@query("w09_anomaly", f"WITH {CLIM} SELECT z.k, CAST(day AS VARCHAR) AS day, round((x - mu) / nullif(sd, 0), 5) AS z FROM z JOIN c ON z.k = c.k AND m = month(day)")
def w09(spark, d):
    return R6(anomalies(spark, d).select("k", S(F.col("day")).alias("day"), "z"), 5)


def anomalies(spark, d):
    z = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("k"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("x")).withColumn("m", F.month("day"))
    c = z.groupBy("k", "m").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    return z.join(F.broadcast(c), ["k", "m"]).withColumn("z", (F.col("x") - F.col("mu")) / F.nullif("sd", F.lit(0.0)))


@query("w10_active_break", f"""WITH {CLIM}, s AS (SELECT z.k, day, CAST(CASE WHEN month(day) NOT IN (7, 8) THEN 0 WHEN round((x - mu) / nullif(sd, 0), 8) >= 1 THEN 1 WHEN round((x - mu) / nullif(sd, 0), 8) <= -1 THEN -1 ELSE 0 END AS INT) AS state FROM z JOIN c ON z.k = c.k AND m = month(day))
    SELECT k, state, count(*) AS days FROM s GROUP BY 1, 2""")
def w10(spark, d):
    s = anomalies(spark, d).withColumn("state", R.classify_state(F.round("z", 8), F.col("day")))
    return s.groupBy("k", "state").agg(F.count("*").alias("days"))


@query("a13_climatology", """WITH z AS (SELECT dayofyear(l_shipdate) AS doy, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2), c AS (SELECT doy, avg(x) AS mu, stddev_samp(x) AS sd FROM z GROUP BY 1),
    o AS (SELECT unnest(range(-15, 16)) AS o), d AS (SELECT unnest(range(1, 366)) AS doy) SELECT CAST(d.doy AS INT) AS doy, round(avg(mu), 5) AS mean, round(greatest(avg(sd), 1e-6), 5) AS std FROM d CROSS JOIN o JOIN c ON c.doy = least(greatest(d.doy + o, 1), 365) GROUP BY 1""")
def a13(spark, d):
    """Mean and sample deviation of each day of the year, then a 31-day running mean with replicated ends."""
    z = table(spark, d, "lineitem").groupBy(F.dayofyear("l_shipdate").alias("doy"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("x"))
    c = z.groupBy("doy").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd")).where("doy <= 365")
    around = F.explode(F.transform(F.sequence(F.lit(-15), F.lit(15)), lambda o: F.least(F.greatest(F.col("doy") + o, F.lit(1)), F.lit(365)))).alias("at")
    days = spark.range(1, 366).select(F.col("id").cast("int").alias("doy")).select("doy", around)
    out = days.join(F.broadcast(c.withColumnRenamed("doy", "at")), "at").groupBy("doy").agg(F.avg("mu").alias("mean"), F.greatest(F.avg("sd"), F.lit(1e-6)).alias("std"))
    return R6(out, 5)


@query("a15_daily_rollup", "SELECT user_id AS cell, CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS label, CAST(max(event_id % 3) AS BIGINT) AS synoptic, round(min(value), 5) AS distance, round(avg(value / 500), 8) AS score FROM events GROUP BY 1, 2")
def a15(spark, d):
    from ..functions.windows import label_of

    g = table(spark, d, "events").groupBy(F.col("user_id").alias("cell"), S(label_of(F.col("ts"))).alias("label"))
    return g.agg(F.max(F.col("event_id") % 3).alias("synoptic"), F.round(F.min("value"), 5).alias("distance"), F.round(F.avg(F.col("value") / 500), 8).alias("score"))


SYN = "CASE WHEN cell % 10 = 0 THEN 2 WHEN cell % 10 <= 2 THEN 1 ELSE 0 END"
STATES = "CASE day(label) % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END"
MASKS = f"""ms AS (SELECT p.*, u.axis, u.regime FROM (SELECT *, {SYN} AS syn, {STATES} AS st, elev / 400 AS oro, lat / 40 AS coast, (cell % 4) / 3.0 AS conv FROM paired) p, LATERAL (SELECT * FROM (VALUES ('monsoon', CASE st WHEN -1 THEN 'break' WHEN 0 THEN 'normal' ELSE 'active' END),
    ('synoptic', CASE syn WHEN 0 THEN 'none' WHEN 1 THEN 'low' ELSE 'depression' END), ('local', CASE WHEN oro >= 0.5 THEN 'orographic' END), ('local', CASE WHEN coast >= 0.5 THEN 'coastal' END), ('local', CASE WHEN conv >= 0.5 THEN 'convective' END),
    ('local', CASE WHEN oro < 0.5 AND coast < 0.5 AND conv < 0.5 THEN 'none' END)) v(axis, regime)) u WHERE u.regime IS NOT NULL)"""


def synoptic():
    return F.when(F.col("cell") % 10 == 0, 2).when(F.col("cell") % 10 <= 2, 1).otherwise(0)


def masked(spark, d):
    """One row for each cell-day and regime that it belongs to."""
    k = F.dayofmonth("label") % 3
    state = F.when(k == 0, -1).when(k == 1, 0).otherwise(1)
    return paired(spark, d).withColumn("m", F.explode(R.masks(synoptic(), F.col("elev") / 400, F.col("lat") / 40, (F.col("cell") % 4) / 3.0, state))).select("*", "m.axis", "m.regime").drop("m")


@query("r05_regime_masks", sql(f"WITH {MASKS} SELECT axis, regime, count(*) AS n FROM ms GROUP BY 1, 2", "paired"))
def r05(spark, d):
    return masked(spark, d).groupBy("axis", "regime").agg(F.count("*").alias("n"))


TEMPLATE = [("monsoon", r) for r in ("break", "normal", "active")] + [("synoptic", r) for r in ("none", "low", "depression")] + [("local", r) for r in ("orographic", "coastal", "convective", "none")]
TSQL = ", ".join(f"('{a}', '{r}')" for a, r in TEMPLATE)
RSQL = ", ".join(f"('{r}')" for r in [*space.REGIONS, "other", "all"])


@query("a08_atlas", sql(f"""WITH {MASKS}, x AS (SELECT *, unnest([15.6, 64.5])::DOUBLE AS threshold FROM ms),
    g AS (SELECT axis, regime, coalesce(region, 'all') AS region, threshold, {CONT.replace(', 6)', ', 5)')}, count(DISTINCT label) AS n_days, CAST(count(*) FILTER (obs >= threshold) AS BIGINT) AS events, CAST(count(*) FILTER (fc >= threshold AND obs >= threshold) AS BIGINT) AS hits,
        CAST(count(*) FILTER (fc >= threshold AND obs < threshold) AS BIGINT) AS false_alarms FROM x GROUP BY GROUPING SETS ((axis, regime, region, threshold), (axis, regime, threshold)))
    SELECT t.axis, t.regime, r.region, th.threshold, coalesce(n, 0) AS n, coalesce(n_days, 0) AS n_days, coalesce(events, 0) AS events, bias, rmse, hits, false_alarms,
        concat_ws('; ', CASE WHEN coalesce(n_days, 0) < 30 THEN 'few days' END, CASE WHEN coalesce(n, 0) < 1000 THEN 'few cells' END, CASE WHEN coalesce(events, 0) < 20 THEN 'few events' END) AS low_sample
    FROM (VALUES {TSQL}) t(axis, regime) CROSS JOIN (VALUES {RSQL}) r(region) CROSS JOIN (SELECT unnest([15.6, 64.5])::DOUBLE AS threshold) th LEFT JOIN g ON g.axis = t.axis AND g.regime = t.regime AND g.region = r.region AND g.threshold = th.threshold""", "paired"))
def a08(spark, d):
    """Regime x region x threshold, from a dense template so that empty groups show."""
    rows = [(a, r, region, t) for a, r in TEMPLATE for region in [*space.REGIONS, "other", "all"] for t in (15.6, 64.5)]
    template = spark.createDataFrame(rows, "axis string, regime string, region string, threshold double")
    out = E.atlas(masked(spark, d), "fc", "obs", "label", (15.6, 64.5), template)
    return R6(out.select("axis", "regime", "region", "threshold", "n", "n_days", "events", "bias", "rmse", "hits", "false_alarms", "low_sample"), 5)


BOOT = """s AS (SELECT {block} AS b, count(*) FILTER ({t}) AS n1, sum(e) FILTER ({t}) AS s1, sum(e * e) FILTER ({t}) AS q1, sum(abs(e)) FILTER ({t}) AS a1, count(*) FILTER ({r}) AS n0, sum(e) FILTER ({r}) AS s0, sum(e * e) FILTER ({r}) AS q0, sum(abs(e)) FILTER ({r}) AS a0
    FROM (SELECT *, fc - obs AS e, {syn} AS syn FROM paired) GROUP BY 1 HAVING n1 > 0 AND n0 > 0), b AS (SELECT *, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS m FROM s),
    w AS (SELECT rep, sum(n1) AS n1, sum(s1) AS s1, sum(q1) AS q1, sum(a1) AS a1, sum(n0) AS n0, sum(s0) AS s0, sum(q0) AS q0, sum(a0) AS a0 FROM (SELECT unnest(range(0, 200)) AS rep), (SELECT unnest(range(0, (SELECT max(m) FROM b))) AS draw), b WHERE i = ((rep * 7919 + draw * 104729 + draw * draw * 31 + 42) % 1000003) % m GROUP BY rep
        UNION ALL SELECT -1, sum(n1), sum(s1), sum(q1), sum(a1), sum(n0), sum(s0), sum(q0), sum(a0) FROM b),
    e AS (SELECT rep, n1, n0, s1 / n1 - s0 / n0 AS mean_diff, a1 / n1 - a0 / n0 AS mae_diff, (s1 / n1 - s0 / n0) / sqrt(((q1 - s1 * s1 / n1) + (q0 - s0 * s0 / n0)) / (n1 + n0 - 2)) * (1 - 3.0 / (4 * (n1 + n0 - 2) - 1)) AS g FROM w)
    SELECT (SELECT count(*) FROM b) AS blocks, CAST(max(n1) FILTER (rep = -1) AS BIGINT) AS n1, CAST(max(n0) FILTER (rep = -1) AS BIGINT) AS n0, round(max(mean_diff) FILTER (rep = -1), 5) AS mean_diff, round(max(mae_diff) FILTER (rep = -1), 5) AS mae_diff, round(max(g) FILTER (rep = -1), 5) AS hedges_g,
    {ends} FROM e"""
ENDS = ", ".join(f"round(quantile_cont(CASE WHEN rep >= 0 THEN {c} END, {p}), 4) AS {n}_{side}" for c, n in (("mean_diff", "mean_diff"), ("mae_diff", "mae_diff"), ("g", "hedges_g")) for side, p in (("low", 0.025), ("high", 0.975)))


def boot(df):
    return R6(R6(df.select("blocks", "n1", "n0", "mean_diff", "mae_diff", "hedges_g", *(F.round(f"{c}_{s}", 4).alias(f"{c}_{s}") for c in ("mean_diff", "mae_diff", "hedges_g") for s in ("low", "high"))), 5), 5)


@query("a24_day_bootstrap", sql("WITH " + BOOT.format(block="label", t="syn = 1", r="syn = 0", syn=SYN, ends=ENDS), "paired"))
def a24(spark, d):
    """Errors under systems against errors without, by matched days."""
    p = paired(spark, d).select("label", (F.col("fc") - F.col("obs")).alias("e"), synoptic().alias("syn"))
    return boot(E.block_bootstrap(p, "e", F.col("syn") == 1, F.col("syn") == 0, "label"))


@query("a25_system_bootstrap", sql("WITH " + BOOT.format(block="(cell * 3 + day(label)) % 40", t="syn = 2", r="syn = 0", syn=SYN, ends=ENDS), "paired"))
def a25(spark, d):
    """The same with systems as blocks."""
    p = paired(spark, d).select(((F.col("cell") * 3 + F.dayofmonth("label")) % 40).alias("system"), (F.col("fc") - F.col("obs")).alias("e"), synoptic().alias("syn"))
    return boot(E.block_bootstrap(p, "e", F.col("syn") == 2, F.col("syn") == 0, "system"))


@query("a27_regime_counts", sql(f"WITH {MASKS} SELECT axis, regime, count(DISTINCT label) AS days, count(*) AS samples FROM ms GROUP BY 1, 2", "paired"))
def a27(spark, d):
    return masked(spark, d).groupBy("axis", "regime").agg(E.distinct_days("label").alias("days"), F.count("*").alias("samples"))


@query("a28_usable_groups", sql(f"WITH {MASKS}, c AS (SELECT axis, regime, region, count(*) AS n FROM ms GROUP BY 1, 2, 3) SELECT axis, regime, CAST(sum((n >= 30)::INT) AS BIGINT) AS usable, count(*) AS groups FROM c GROUP BY 1, 2", "paired"))
def a28(spark, d):
    c = masked(spark, d).groupBy("axis", "regime", "region").agg(F.count("*").alias("n"))
    return c.groupBy("axis", "regime").agg(F.count_if(F.col("n") >= 30).alias("usable"), F.count("*").alias("groups"))


@query("a29_threshold_counts", sql(f"WITH {MASKS}, x AS (SELECT *, unnest([15.6, 64.5, 115.6])::DOUBLE AS threshold FROM ms) SELECT axis, regime, threshold, CAST(count(*) FILTER (obs >= threshold) AS BIGINT) AS events, count(DISTINCT CASE WHEN obs >= threshold THEN month(label) END) AS months FROM x GROUP BY 1, 2, 3", "paired"))
def a29(spark, d):
    return E.threshold_counts(masked(spark, d), "obs", "label", (15.6, 64.5, 115.6), ["axis", "regime"])


def candidates(spark, d):
    """Made-up candidates of centres: local minima of the residual from a smooth background."""
    g = W.gaussian(grid(spark, d), "fc", 2.0, ["label", "member"], "background", 10, 15).withColumn("residual", F.col("background") - F.col("fc"))
    return W.focal_extreme(g, "residual", 7, ["label", "member"], "low", False).where("residual = low AND residual < -20")


@query("r01_systems")
def r01(spark, d):
    """Candidates, greedily separated by four degrees, a dozen a day at most, with their class."""
    c = candidates(spark, d).select(F.col("label").alias("time"), "member", "iy", "ix", "lat", "lon", "residual", F.col("obs").alias("depth"))
    kept = c.groupBy("time", "member").applyInPandas(R.separated(), c.schema)
    return R6(kept.select(S(F.col("time")).alias("time"), "member", "iy", "ix", "lat", "lon", "residual", rain.system_class(F.col("depth") / 20, F.lit(2.0), F.lit(9.0)).alias("class")), 5)


@query("r03_detection_audit", sql(f"WITH {GRID} SELECT CAST(label AS VARCHAR) AS label, CAST(count(*) FILTER (fc >= 60) AS BIGINT) AS minima, CAST(count(*) FILTER (fc >= 60 AND obs >= 30) AS BIGINT) AS with_vorticity, CAST(count(*) FILTER (fc >= 60 AND obs >= 60) AS BIGINT) AS with_ring, max(fc) AS strongest FROM g GROUP BY 1", "tiled"))
def r03(spark, d):
    """How many cells survive each gate in turn."""
    g = tiled(spark, d)
    a, b, c = F.col("fc") >= 60, F.col("obs") >= 30, F.col("obs") >= 60
    return g.groupBy(S(F.col("label")).alias("label")).agg(F.count_if(a).alias("minima"), F.count_if(a & b).alias("with_vorticity"), F.count_if(a & c).alias("with_ring"), F.max("fc").alias("strongest"))


@query("r06_regime_bundle", sql(f"WITH {STATE}, o AS (SELECT k, day, state FROM st) SELECT s.source, s.state, count(*) AS days FROM (SELECT 'forecast' AS source, state FROM o UNION ALL SELECT 'label', kept FROM (SELECT CAST(CASE WHEN state <> 0 AND count(*) OVER (PARTITION BY k, run) >= 3 THEN state ELSE 0 END AS INT) AS kept FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY day) AS run FROM (SELECT *, CASE WHEN lag(state) OVER w = state AND day - lag(day) OVER w = 1 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY k ORDER BY day))))) s GROUP BY 1, 2"))
def r06(spark, d):
    """Forecast states as they are, label states after the run filter."""
    s = states(spark, d)
    labels = R.run_filter(s, "state", "day", ["k"]).select(F.lit("label").alias("source"), F.col("kept").alias("state"))
    return s.select(F.lit("forecast").alias("source"), "state").unionByName(labels).groupBy("source", "state").agg(F.count("*").alias("days"))


def system_centres(spark, d):
    e = table(spark, d, "events").where("event_type = 'error' AND value >= 100")
    six = F.date_trunc("hour", F.col("ts")) - F.make_dt_interval(F.lit(0), F.hour("ts") % 6)
    return e.join(cells(spark, d).select("cell", "lat", "lon"), e["user_id"] == F.col("cell")).select(F.year("ts").alias("season"), six.cast("timestamp_ntz").alias("time"), "lat", "lon", F.when(F.col("value") >= 150, 2).otherwise(1).alias("code"), "event_id")


def tracked(spark, d):
    c = R.stretches(system_centres(spark, d), 12.0)
    return c.groupBy("season", "stretch").applyInPandas(R.track(), "season int, stretch long, time timestamp_ntz, lat double, lon double, code int, event_id long, system_id long")


@query("r07_tracker")
def r07(spark, d):
    """Deterministic nearest-neighbour tracks; sequential within a stretch of a season, stretches side by side."""
    return tracked(spark, d).select(S(F.col("time")).alias("time"), "lat", "lon", "code", "event_id", "season", "stretch", "system_id")


@query("r08_event_summary")
def r08(spark, d):
    out = R.event_summary(tracked(spark, d), ["season", "stretch"])
    return out.withColumns({c: S(F.col(c)) for c in ("first_time", "last_time")})


@query("a30_event_counts")
def a30(spark, d):
    t = tracked(spark, d)
    by = t.groupBy("code").agg(F.countDistinct("season", "stretch", "system_id").alias("systems"), F.countDistinct(F.to_date("time")).alias("days"), F.count("*").alias("snapshots"))
    primary = R.event_summary(t, ["season", "stretch"]).groupBy(F.col("primary_code").alias("code")).agg(F.count("*").alias("primary_systems"))
    return by.join(primary, "code", "left").na.fill(0, ["primary_systems"])


#: A grid of 1,200 rows of 1,100 cells, the gates on it, and the cells of a tile's side.
WIDE, WIDE_GATES, TILE = DT.Grid(1200, 1100, -40.0, 20.0, 0.1), DT.Gates(box=(-30.0, 70.0, 30.0, 120.0), sigma_cells=8.0, ring_degrees=1.0), 256


def wide_tiles(spark, d):
    """A calm field in which each event lowers the pressure around its cell and turns the wind; a time is a third of a month."""
    e = table(spark, d, "events").select(F.trunc("ts", "month").alias("month"), F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int").alias("part"), "event_id", "value")
    centre = e.select(
        (F.col("month").cast("timestamp_ntz") + F.make_dt_interval(F.col("part") * 10)).alias("time"), F.pmod(F.col("event_id") * 7919 + 13, F.lit(WIDE.rows)).cast("int").alias("cy"),
        F.pmod(F.col("event_id") * 104_729 + 7, F.lit(WIDE.columns)).cast("int").alias("cx"), (F.col("value") / 20).alias("depth"),
    )
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(2.0 ** -(dy * dy + dx * dx)).alias("w")) for dy in range(-2, 3) for dx in range(-2, 3)))).alias("o")
    each = centre.select("time", "cy", "cx", "depth", around)
    part = F.round(F.col("depth") * F.col("o.w"), 6)
    summed = each.groupBy("time", (F.col("cy") + F.col("o.dy")).alias("iy"), (F.col("cx") + F.col("o.dx")).alias("ix")).agg(*(F.sum((c * 1e6).cast("long")).alias(n) for n, c in (("low", part), ("east", -part * F.col("o.dy")), ("north", part * F.col("o.dx")))))
    field = summed.select("time", "iy", "ix", (1008.0 - F.col("low") / 1e6).alias("mslp"), (F.col("east") / 1e6).alias("u"), (F.col("north") / 1e6).alias("v"))
    return DT.detect(field, WIDE, WIDE_GATES, TILE, fill=(1008.0, 0.0, 0.0))


@query("r01_tiled_systems")
def r01_tiled(spark, d):
    """Systems of a large grid by the real gates: background, vorticity, closed ring, separation, class."""
    out = DT.systems(wide_tiles(spark, d), WIDE_GATES)
    return R6(out.select(S(F.col("time")).alias("time"), "iy", "ix", "lat", "lon", "mslp", "residual", "depth", "vorticity", "wind", "class"), 5)


@query("r03_tiled_audit")
def r03_tiled(spark, d):
    """How many cells of the large grid survive each gate, by time, and how many centres are left."""
    tiles = wide_tiles(spark, d)
    return R6(DT.audit(tiles, DT.systems(tiles, WIDE_GATES)).withColumn("time", S(F.col("time"))), 5)


@query("t01_greedy_top")
def t01(spark, d):
    c = candidates(spark, d).select(F.col("label").alias("time"), "member", "iy", "ix", "lat", "lon", "residual")
    return c.groupBy("time", "member").applyInPandas(R.separated(most=3), c.schema).groupBy(S(F.col("time")).alias("time")).agg(F.count("*").alias("kept"))


@query("k07_atlas_maps", sql("SELECT iy, ix, CAST(cell % 3 AS INT) AS regime, count(*) AS days, round(avg(fc - obs), 6) AS bias, count(*) FILTER (fc >= 64.5 AND obs >= 64.5) AS hits, count(*) FILTER (fc < 64.5 AND obs >= 64.5) AS misses, count(*) FILTER (fc >= 64.5 AND obs < 64.5) AS false_alarms FROM paired GROUP BY 1, 2, 3", "paired"))
def k07(spark, d):
    """Maps of the error atlas, as a table of cells and regimes."""
    from ..operators.evidence import atlas_maps

    return R6(atlas_maps(paired(spark, d).withColumn("regime", (F.col("cell") % 3).cast("int")), "fc", "obs", "regime", 64.5), 6)
