"""Queries of sources, profiles and the feature table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rain
from ..operators import focal as W
from ..operators.scores import rounded as R6
from ..sources import daily, profile, synthetic
from .book import query
from .q_columns import EDGES, TERRAIN
from .q_grid import grid
from .views import cells, dense, granules, paired, pairs, sql, table, tiled

S = lambda c: c.cast("string")


def _uniform_sql(salt, *keys):
    x = " + ".join([str(synthetic.stream(salt)), *(f"CAST({k} AS BIGINT) * {step}" for k, step in zip(keys, synthetic.STEPS))])
    for _ in range(3):
        x = f"(({x}) % {synthetic.PRIME}) * ((({x}) % {synthetic.PRIME}) + 48271)"
    return f"((({x}) % {synthetic.PRIME} + 0.5::DOUBLE) / {synthetic.PRIME}::DOUBLE)"


def _normal_sql(salt, *keys):
    return f"(sqrt(-2 * ln({_uniform_sql(salt + 'r', *keys)})) * cos(2 * pi() * {_uniform_sql(salt + 'a', *keys)}))"


def _realised_sql(mean, salt, *keys):
    return f"CASE WHEN {_uniform_sql(salt + 'w', *keys)} < 1 - exp(-({mean}) / 6.0::DOUBLE) THEN least(greatest(({mean}) * exp(0.8::DOUBLE * {_normal_sql(salt + 'n', *keys)} - 0.32::DOUBLE), 0), 600) ELSE 0 END"


def _world_sql(*years):
    """CTEs up to `f`: cells, days and fields of the synthetic world on twelve rows of twelve cells, with the mean rain."""
    return f"""dd AS (SELECT year, time, dayofyear(time) AS doy, date_diff('day', DATE '1970-01-01', time) AS day FROM (SELECT year, CAST(unnest(generate_series(make_date(year, 6, 1), make_date(year, 9, 30), INTERVAL 1 DAY)) AS DATE) AS time FROM (VALUES {', '.join(f'({y})' for y in years)}) y(year))),
    w AS (SELECT *, sin(2 * pi() * (doy / 42.0::DOUBLE + {_uniform_sql('phase', 'year')})) AS wave FROM dd),
    s AS (SELECT *, exp(-pow((doy - 215) / 60.0::DOUBLE, 2)) * (1 + 0.5::DOUBLE * wave) AS strength, 18.0::DOUBLE + 0.4::DOUBLE * (doy % 9) AS low_lat, 88.0::DOUBLE - 1.6::DOUBLE * (doy % 9) AS low_lon FROM w),
    p AS (SELECT i AS cell, CAST(i // 12 AS INT) AS iy, (6.5 + i // 12)::DOUBLE AS lat, (66.5 + i % 12)::DOUBLE AS lon FROM (SELECT unnest(range(0, 144)) AS i)),
    c AS (SELECT *, ({TERRAIN})::DOUBLE AS elev, (SELECT count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1::DOUBLE + (lat - y1::DOUBLE) * (x2::DOUBLE - x1::DOUBLE) / nullif(y2::DOUBLE - y1::DOUBLE, 0)) FROM (VALUES {EDGES}) e(x1, y1, x2, y2)) % 2 = 1 AS land FROM p),
    g AS (SELECT *, exp(-(pow((lat - low_lat) / 3.0::DOUBLE, 2) + pow((lon - low_lon) / 3.0::DOUBLE, 2))) AS low, exp(-pow((lat - 13.0::DOUBLE) / 6.0::DOUBLE, 2)) AS jet FROM s CROSS JOIN c),
    f AS (SELECT *, 6 * strength + 14 * least(elev / 1000 * strength * CASE WHEN lon < 78 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 2.0) + CASE WHEN wave < -0.5 AND lat > 26 THEN 6.0::DOUBLE ELSE 0 END + 35 * low AS truth FROM g)"""


@query("s02_synthetic_forecast", f"""WITH {_world_sql(2020, 2021)}, n AS (SELECT *, (0.75::DOUBLE * truth + 1) * exp(0.15::DOUBLE * lead * {_normal_sql('fc', 'cell', 'day', 'lead')}) AS noisy FROM f CROSS JOIN (VALUES (1), (3)) l(lead)),
    t AS (SELECT CAST(lead AS INT) AS lead, CAST(year AS INT) AS year, {_realised_sql('noisy', 'tp', 'cell', 'day', 'lead')} AS tp FROM n) SELECT lead, year, count(*) AS n, round(avg(tp), 4) AS mean, round(max(tp), 4) AS most FROM t GROUP BY 1, 2""")
def s02(spark, d):
    f = synthetic.forecast(spark, [2020, 2021], 12, 12)
    return R6(f.groupBy("lead", F.year("time").alias("year")).agg(F.count("*").alias("n"), F.avg("tp").alias("mean"), F.max("tp").alias("most")), 4)


@query("s03_synthetic_obs", f"""WITH {_world_sql(2020)}, t AS (SELECT time, CASE WHEN land THEN {_realised_sql('truth', 'obs', 'cell', 'day')} END AS rain FROM f)
    SELECT CAST(month(time) AS INT) AS month, count(rain) AS n, round(avg(rain), 4) AS mean FROM t GROUP BY 1""")
def s03(spark, d):
    o = synthetic.observations(spark, [2020], 12, 12)
    return R6(o.groupBy(F.month("time").alias("month")).agg(F.count("rain").alias("n"), F.avg("rain").alias("mean")), 4)


@query("s04_synthetic_analysis", f"""WITH {_world_sql(2020)} SELECT iy, round(avg((12 * strength * jet - 6 * low * (lat - low_lat) / 3.0::DOUBLE) * (1 + 0.05::DOUBLE * {_normal_sql('u850', 'cell', 'day')})), 3) AS u850,
    round(avg((1004 - 4 * strength * exp(-pow((lat - 24.0::DOUBLE) / 8.0::DOUBLE, 2)) - 6 * low) * (1 + 0.05::DOUBLE * {_normal_sql('mslp', 'cell', 'day')})), 3) AS mslp FROM f GROUP BY 1""")
def s04(spark, d):
    return R6(synthetic.analysis(spark, [2020], 12, 12).groupBy("iy").agg(F.avg("u850").alias("u850"), F.avg("mslp").alias("mslp")), 3)


@query("s05_season_curve", """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2020-06-01', DATE '2020-09-30', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(day AS VARCHAR) AS day, round(exp(-pow((dayofyear(day) - 215) / 60.0, 2)), 6) AS base,
    round(18.0 + 0.4 * (dayofyear(day) % 9), 6)::DOUBLE AS low_lat, round(88.0 - 1.6 * (dayofyear(day) % 9), 6)::DOUBLE AS low_lon FROM d""")
def s05(spark, d):
    days = synthetic.days(spark, [2020])
    return R6(days.select(S(F.col("time")).alias("day"), (F.col("strength") / (1 + 0.5 * F.col("wave"))).alias("base"), "low_lat", "low_lon"))


@query("s29_field_equations", "SELECT CAST(i AS BIGINT) AS cell, round(12 * exp(-pow((6.5 + i - 13.0) / 6.0, 2)), 6) AS jet FROM (SELECT unnest(range(0, 12)) AS i)")
def s29(spark, d):
    g = synthetic.grid(spark, 12, 1).withColumns({"strength": F.lit(1.0), "low_lat": F.lit(1000.0), "low_lon": F.lit(0.0), "wave": F.lit(0.0)})
    return R6(synthetic.fields(g).select("cell", F.col("u850").alias("jet")))


@query("s30_rain_means", "SELECT CAST(i AS BIGINT) AS cell, round(6 * (i / 10.0) + 14 * least(i * 100 / 1000.0 * (i / 10.0), 2.0), 5)::DOUBLE AS truth, round(0.75 * (6 * (i / 10.0) + 14 * least(i * 100 / 1000.0 * (i / 10.0), 2.0)) + 1, 5)::DOUBLE AS model FROM (SELECT unnest(range(0, 20)) AS i)")
def s30(spark, d):
    i = F.col("id")
    x = spark.range(20).select(i.alias("cell"), (i / 10.0).alias("strength"), (i * 100.0).alias("elev"), F.lit(70.0).alias("lon"), F.lit(20.0).alias("lat"), F.lit(0.0).alias("wave"), F.lit(0.0).alias("low"))
    return R6(x.select("cell", synthetic.rain_mean(False).alias("truth"), synthetic.rain_mean(True).alias("model")), 5)


@query("s31_realisation", f"SELECT round(avg((r > 0)::INT), 4) AS wet, round(avg(r), 4) AS mean, round(max(r), 4) AS most FROM (SELECT {_realised_sql('6.0::DOUBLE', 't', 'id')} AS r FROM (SELECT unnest(range(0, 20000)) AS id))")
def s31(spark, d):
    x = spark.range(20_000).withColumn("r", synthetic.realised(F.lit(6.0), "id", salt="t"))
    return R6(x.agg(F.avg((F.col("r") > 0).cast("int")).alias("wet"), F.avg("r").alias("mean"), F.max("r").alias("most")), 4)


@query("s06_forecast_scan", """WITH t AS (SELECT o_custkey AS key, min(o_totalprice) / 1000 AS t0, max(o_totalprice) / 1000 AS t1 FROM orders GROUP BY 1), s AS (SELECT o_custkey AS key, o_orderkey % 24 AS hour, avg(o_totalprice) AS mslp FROM orders GROUP BY 1, 2),
    m AS (SELECT key, count(*) AS n, avg(mslp) AS mslp FROM s WHERE hour IN (3, 9, 15, 21) GROUP BY 1) SELECT t.key, round(greatest(t1 - t0, 0), 5) AS tp, round(CASE WHEN n = 4 THEN mslp END, 3) AS mslp FROM t LEFT JOIN m USING (key)""")
def s06(spark, d):
    """Rain from two running totals and the mean state of four hours; an hour short means no state."""
    o = table(spark, d, "orders")
    t = o.groupBy(F.col("o_custkey").alias("key")).agg((F.min("o_totalprice") / 1000).alias("t0"), (F.max("o_totalprice") / 1000).alias("t1"))
    s = o.groupBy(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 24).alias("hour")).agg(F.avg("o_totalprice").alias("mslp"))
    out = daily.forecast_day(t, s, ["mslp"], [3, 9, 15, 21])
    return out.select("key", F.round("tp", 5).alias("tp"), F.round("mslp", 3).alias("mslp"))


@query("s27_daily_state", """WITH s AS (SELECT o_custkey AS key, o_orderkey % 4 AS hour, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS u FROM orders GROUP BY 1, 2),
    m AS (SELECT key, (max(u) FILTER (hour = 0) + max(u) FILTER (hour = 1) + max(u) FILTER (hour = 2) + max(u) FILTER (hour = 3)) / 4 AS u FROM s GROUP BY 1) SELECT key, u, sqrt(u * u + 144) AS wind FROM m""")
def s27(spark, d):
    """Mean state of four hours, and the wind with a constant other part; an hour short means no state. Sums are of decimals, so no order of adding matters."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 4).alias("hour"))
    s = o.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("u"))
    hours = [F.max(F.when(F.col("hour") == h, F.col("u"))) for h in range(4)]
    m = s.groupBy("key").agg(((hours[0] + hours[1] + hours[2] + hours[3]) / 4).alias("u"))
    return m.select("key", "u", F.sqrt(F.col("u") * F.col("u") + 144).alias("wind"))


@query("s12_s13_daily_files", sql("SELECT CAST(label AS VARCHAR) AS time, cell, obs AS rain FROM pairs WHERE obs IS NOT NULL AND day(label) <= 10", "pairs"))
def s13(spark, d):
    """Two files of one product under one another, selected by wanted days; a day and cell in both would be fatal."""
    p = pairs(spark, d).where("obs IS NOT NULL").select(F.col("label").alias("time"), "cell", F.col("obs").alias("rain"))
    odd = F.dayofmonth("time") % 2 == 1
    wanted = p.select("time").distinct().where(F.dayofmonth("time") <= 10)
    return daily.concatenated([p.where(odd), p.where(~odd)], ["time", "cell"], wanted).select(S(F.col("time")).alias("time"), "cell", "rain")


@query("s15_fill_values", "SELECT c_custkey, CASE WHEN c_acctbal > -998 THEN c_acctbal END AS v FROM customer")
def s15(spark, d):
    from ..sources.mapping import no_fill

    return table(spark, d, "customer").select("c_custkey", no_fill("c_acctbal").alias("v"))


def _written(spark, df, form, **options):
    """df written by one of the grid sources, a file to a partition in the order of its records, and read back."""
    from ..sources import grids
    from ..storage import shared_dir

    grids.register(spark)
    path = f"{shared_dir(spark)}/raincask/{form}-{uuid.uuid4().hex}"
    df.repartition("file").sortWithinPartitions("file", "record", *[c for c in df.columns if c == "time"]).write.format(form).options(**options).mode("append").save(path)
    return spark.read.format(form).options(**options, records="7").load(path), path


MONTHS = "SELECT label, iy, ix, CASE WHEN valid THEN obs END AS v, CAST(year(label) * 100 + month(label) AS VARCHAR) AS file, day(label) - 1 AS record FROM dense"


@query("s15_raw_grids", sql(f"""WITH m AS ({MONTHS}) SELECT file, CAST(record AS INT) AS record, count(*) AS n, count(v) AS there, round(sum(v::FLOAT::DOUBLE), 3) AS total, round(max(v::FLOAT::DOUBLE), 3) AS most FROM m GROUP BY 1, 2""", "dense"))
def s15_raw(spark, d):
    """Monthly files of raw daily fields, written from the cells' rain and read back by ranges of records; days without a field are not asked for."""
    g = dense(spark, d)
    ny = g.agg(F.max("iy")).first()[0] + 1
    rows = g.select(F.date_format("label", "yyyyMM").alias("file"), (F.dayofmonth("label") - 1).alias("record"), "iy", "ix", F.when(F.col("valid"), F.col("obs")).alias("value"))
    back, _ = _written(spark, rows, "raincask_raw", ny=str(ny), nx="15")
    asked = rows.select("file", "record").distinct()
    own = rows.select("iy", "ix").distinct()
    out = back.join(asked, ["file", "record"], "left_semi").join(own, ["iy", "ix"], "left_semi")
    return R6(out.groupBy("file", "record").agg(F.count("*").alias("n"), F.count("value").alias("there"), F.sum("value").alias("total"), F.max("value").alias("most")), 3)


@query("s12_netcdf_files", sql(f"""WITH m AS ({MONTHS}) SELECT file, count(*) AS n, count(v) AS there, CAST(date_diff('day', DATE '1990-01-01', min(label)) AS DOUBLE) AS first, CAST(date_diff('day', DATE '1990-01-01', max(label)) AS DOUBLE) AS last, round(sum(v), 4) AS total, max(v) AS most FROM m GROUP BY 1""", "dense"))
def s12_netcdf(spark, d):
    """Monthly classic files, a record a day, written from the cells' rain and read back by ranges of records."""
    g = dense(spark, d)
    rows = g.select(F.date_format("label", "yyyyMM").alias("file"), F.lit(0).alias("record"), F.date_diff("label", F.lit("1990-01-01").cast("date")).cast("double").alias("time"), F.lit("days since 1990-01-01").alias("time_units"), F.col("iy").cast("double").alias("y"), F.col("ix").cast("double").alias("x"), F.when(F.col("valid"), F.col("obs")).alias("value"))
    back, _ = _written(spark, rows, "raincask_netcdf", variable="rain")
    own = g.select(F.col("iy").cast("double").alias("y"), F.col("ix").cast("double").alias("x")).distinct()
    out = back.where("time_units = 'days since 1990-01-01'").join(own, ["y", "x"], "left_semi").groupBy("file")
    return R6(out.agg(F.count("*").alias("n"), F.count("value").alias("there"), F.min("time").alias("first"), F.max("time").alias("last"), F.sum("value").alias("total"), F.max("value").alias("most")), 4)


@query("s17_granule_selection", sql("SELECT count(*) AS granules, CAST(max(slot) - min(slot) + 1 - count(*) AS BIGINT) AS gaps FROM granules WHERE slot >= 946000 * 2 + 1048 AND slot < 946000 * 2 + 2048", "granules"))
def s17(spark, d):
    g = daily.selected_granules(granules(spark, d), 946_000 * 2 + 1048, 946_000 * 2 + 2048)
    return g.agg(F.count("*").alias("granules"), (F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("gaps"))


@query("s18_analysis_merge", "WITH a AS (SELECT o_orderkey % 1000 AS k, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2), b AS (SELECT l_orderkey % 1000 AS k, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT a.k, CAST(a.day AS VARCHAR) AS day, round(p / 100, 4) AS mslp, round(q, 4) AS u FROM a JOIN b ON a.k = b.k AND a.day = b.day")
def s18(spark, d):
    """Surface and level sets joined by cell and day, with the surface's units changed."""
    a = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 1000).alias("k"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("p"))
    b = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("k"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("q"))
    return R6(a.join(b, ["k", "day"]).select("k", S(F.col("day")).alias("day"), (F.col("p") / 100).alias("mslp"), F.col("q").alias("u")), 4)


@query("s21_s34_profile", sql("WITH l AS (SELECT DISTINCT CAST(lon AS DOUBLE) AS x FROM cells), g AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS step FROM l) SELECT 'lon' AS axis, count(*) AS n, min(x) AS least, max(x) AS most, min(step) AS least_step, max(step) AS most_step FROM g", "cells"))
def s21(spark, d):
    return profile.axis_profile(cells(spark, d), "lon")


@query("s21_time_profile", sql("SELECT CAST(min(label) AS VARCHAR) AS first, CAST(max(label) AS VARCHAR) AS last, count(DISTINCT label) AS days, CAST(max(label) - min(label) + 1 - count(DISTINCT label) AS BIGINT) AS missing_days, CAST(count(*) - count(DISTINCT (cell, label)) AS BIGINT) AS repeats FROM pairs", "pairs"))
def s21t(spark, d):
    return profile.time_profile(pairs(spark, d), "label", ["cell"])


@query("k13_field_evidence", sql(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, count(*) - count({f}) AS missing, round(min({f}), 6)::DOUBLE AS least, round(avg({f}), 6) AS mean, round(max({f}), 6)::DOUBLE AS most FROM paired" for f in ("fc", "obs", "lat", "lon")), "paired"))
def k13(spark, d):
    """Statistics of each field, all from one pass."""
    return R6(profile.field_statistics(paired(spark, d), ["fc", "obs", "lat", "lon"]))


@query("k15_text_evidence", "SELECT * FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{p}'" for p in profile.EVIDENCE) + " END AS pattern FROM documents) WHERE pattern IS NOT NULL")
def k15(spark, d):
    """Texts that may bear on the day a label covers, with the first pattern met."""
    texts = table(spark, d, "documents").select("doc_id", F.col("source").alias("place"), F.lit("text").alias("name"), "text")
    return profile.text_evidence(texts).select("doc_id", "pattern")


@query("s22_fetch_plan", "SELECT CAST(n AS INT) AS days, CAST(n * 48 AS INT) AS granules FROM (SELECT unnest(range(1, 32)) AS n)")
def s22(spark, d):
    return spark.range(1, 32).select(F.col("id").cast("int").alias("days"), (F.col("id") * 48).cast("int").alias("granules"))


@query("f01_feature_table", sql("""WITH g AS (SELECT * FROM tiled), w AS (SELECT label, avg(fc) FILTER (lat BETWEEN 18 AND 28 AND lon BETWEEN 65 AND 88) AS zone FROM g GROUP BY 1),
    o AS (SELECT unnest(range(-1, 2)) AS o), e AS (SELECT label, member, cell, least(greatest(iy + a.o, 0), (SELECT max(iy) FROM g)) AS y, least(greatest(ix + b.o, 0), (SELECT max(ix) FROM g)) AS x FROM g, o a, o b),
    n AS (SELECT e.label, e.cell, avg(g.fc) AS n3 FROM e JOIN g ON g.label = e.label AND g.member = e.member AND g.iy = e.y AND g.ix = e.x GROUP BY 1, 2)
    SELECT CAST(g.label AS VARCHAR) AS label, g.cell, g.fc AS tp, round(ln(1 + g.fc), 8) AS tp_log, round(n3, 8) AS tp_n3_mean, round(zone, 8) AS zone_tp, round(sin(2 * pi() * dayofyear(g.label) / 365.25), 8) AS doy_sin, g.obs FROM g JOIN w ON w.label = g.label JOIN n ON n.label = g.label AND n.cell = g.cell WHERE land AND valid""", "tiled"))
def f01(spark, d):
    """Land rows with both sides: rain, its log, its neighbourhood, the zone's plain mean, the season."""
    g = W.focal_mean(grid(spark, d), "fc", 3, ["label", "member"], "n3", 10, 15)
    zone = tiled(spark, d).where("lat BETWEEN 18 AND 28 AND lon BETWEEN 65 AND 88").groupBy("label").agg(F.avg("fc").alias("zone"))
    s, _ = rain.season_phase(F.col("label"))
    out = g.where("land AND valid").join(F.broadcast(zone), "label")
    return R6(out.select(S(F.col("label")).alias("label"), "cell", F.col("fc").alias("tp"), F.log1p("fc").alias("tp_log"), F.col("n3").alias("tp_n3_mean"), F.col("zone").alias("zone_tp"), s.alias("doy_sin"), "obs"), 8)
