"""Queries of the score and aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rain, space
from ..operators import scores as S
from ..sources.profile import value_profile
from .book import query
from .views import cells, dense, granules, ladder, paired, pairs, sql, table

R6 = S.rounded
THR = ", ".join(str(t) for t in rain.THRESHOLDS)
CONT = """count(*) AS n, round(avg(fc - obs), 6) AS bias, round(avg(abs(fc - obs)), 6) AS mae, round(sqrt(avg((fc - obs) * (fc - obs))), 6) AS rmse,
    round(CASE WHEN count(*) > 2 AND stddev_pop(fc) > 0 AND stddev_pop(obs) > 0 THEN corr(fc, obs) END, 6) AS r, round(avg(fc), 6) AS mean_fc, round(avg(obs), 6) AS mean_obs"""
COUNTS = """CAST(count(*) FILTER (fc >= threshold AND obs >= threshold) AS BIGINT) AS hits, CAST(count(*) FILTER (fc >= threshold AND obs < threshold) AS BIGINT) AS false_alarms,
    CAST(count(*) FILTER (fc < threshold AND obs >= threshold) AS BIGINT) AS misses, CAST(count(*) FILTER (fc < threshold AND obs < threshold) AS BIGINT) AS correct_negatives"""
SCORES = """round(hits / nullif(hits + misses, 0)::DOUBLE, 6) AS pod, round(false_alarms / nullif(hits + false_alarms, 0)::DOUBLE, 6) AS far, round(hits / nullif(hits + false_alarms + misses, 0)::DOUBLE, 6) AS csi,
    round((hits - e) / nullif(hits + false_alarms + misses - e, 0.0), 6) AS ets, round((hits + false_alarms) / nullif(hits + misses, 0)::DOUBLE, 6) AS freq_bias, round((hits + misses) / nullif(n, 0)::DOUBLE, 6) AS base_rate"""


def contingency_sql(by: str, source: str = "paired") -> str:
    keys = f"{by}, " if by else ""
    return f"""WITH k AS (SELECT {keys}threshold, {COUNTS} FROM {source} CROSS JOIN (SELECT unnest([{THR}]) AS threshold) WHERE fc IS NOT NULL AND obs IS NOT NULL GROUP BY ALL),
        x AS (SELECT *, hits + false_alarms + misses + correct_negatives AS n, (hits + misses)::DOUBLE * (hits + false_alarms) / nullif(hits + false_alarms + misses + correct_negatives, 0) AS e FROM k)
        SELECT {keys}CAST(threshold AS DOUBLE) AS threshold, hits, false_alarms, misses, correct_negatives, {SCORES} FROM x"""


@query("a01_continuous", sql(f"SELECT region, {CONT} FROM paired GROUP BY region", "paired"))
def a01(spark, d):
    return R6(S.continuous(paired(spark, d), "fc", "obs", ["region"]))


@query("a02_contingency", sql(contingency_sql("region"), "paired"))
def a02(spark, d):
    return R6(S.contingency(paired(spark, d), "fc", "obs", rain.THRESHOLDS, ["region"]))


def proba(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("p"), (F.col("quality") == 1).alias("event"))


PROBA = "SELECT d.doc_id, lang, least(1.0, n_chars / 5000.0)::DOUBLE AS p, quality = 1 AS event FROM documents d JOIN labels l USING (doc_id)"


@query("a03_probabilistic", f"""WITH q AS ({PROBA}), k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS rk FROM q),
    s AS (SELECT lang, count(*) AS n, avg((p - event::INT) * (p - event::INT)) AS brier, avg(event::INT) AS b, sum(CASE WHEN event THEN rk END) AS rs, sum(event::INT)::DOUBLE AS e FROM k GROUP BY lang)
    SELECT lang, n, round(brier, 6) AS brier, round(b, 6) AS base_rate, round(b * (1 - b), 6) AS brier_climatology, round(1 - brier / nullif(b * (1 - b), 0), 6) AS bss, round((rs - e * (e + 1) / 2) / nullif(e * (n - e), 0), 6) AS auc FROM s""")
def a03(spark, d):
    return R6(S.probabilistic(proba(spark, d), "p", "event", ["lang"]))


@query("a04_reliability", f"""WITH q AS ({PROBA}), b AS (SELECT *, {' + '.join(f'(p >= {i / 10})::INT' for i in range(1, 10))} AS bin FROM q)
    SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(event::INT), 6) AS obs_freq, round((bin + 0.5) / 10, 6) AS mid FROM b GROUP BY bin""")
def a04(spark, d):
    return R6(S.reliability(proba(spark, d), "p", "event"))


@query("a37_daily_metrics", sql(f"""SELECT CAST(label AS VARCHAR) AS label, {CONT} FROM paired WHERE land GROUP BY label HAVING count(*) > 2
    UNION ALL SELECT 'pooled', {CONT} FROM paired WHERE land""".replace(", 6)", ", 5)"), "paired"))
def a37(spark, d):
    """Each day with more than two cells, and all days pooled, by grouping sets in one pass."""
    p = paired(spark, d).where("land")
    out = p.rollup("label").agg(*S.continuous_aggregates("fc", "obs"), F.grouping("label").alias("g")).where("n > 2 OR g = 1")
    return R6(out.select(F.coalesce(F.col("label").cast("string"), F.lit("pooled")).alias("label"), *[c for c in out.columns if c not in ("label", "g")]), 5)


@query("a37b_metric_block", sql(f"""WITH k AS (SELECT region, {CONT}, {', '.join(f"count(*) FILTER (fc >= {t} AND obs >= {t}) AS hits_{x}, count(*) FILTER (fc >= {t} AND obs < {t}) AS false_alarms_{x}, count(*) FILTER (fc < {t} AND obs >= {t}) AS misses_{x}" for t, x in ((15.6, '15_6'), (64.5, '64_5')))}
    FROM paired GROUP BY region) SELECT *, {', '.join(f"round(hits_{x} / nullif(hits_{x} + misses_{x}, 0)::DOUBLE, 6) AS pod_{x}, round(false_alarms_{x} / nullif(hits_{x} + false_alarms_{x}, 0)::DOUBLE, 6) AS far_{x}, round(hits_{x} / nullif(hits_{x} + false_alarms_{x} + misses_{x}, 0)::DOUBLE, 6) AS csi_{x}" for x in ('15_6', '64_5'))} FROM k""", "paired"))
def a37b(spark, d):
    return R6(S.metric_block(paired(spark, d), "fc", "obs", (15.6, 64.5), ["region"]))


@query("w07_average_rank", sql("SELECT cell, CAST(label AS VARCHAR) AS label, rank() OVER (PARTITION BY label ORDER BY round(fc, 0)) + (count(*) OVER (PARTITION BY label, round(fc, 0)) - 1) / 2.0 AS rank FROM paired", "paired"))
def w07(spark, d):
    p = paired(spark, d).select("cell", "label", F.round("fc", 0).alias("v"))
    return S.average_rank(p, "v", ["label"]).select("cell", F.col("label").cast("string").alias("label"), F.col("rank").cast("double").alias("rank"))


LADDER_SPLIT = "SELECT *, CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split FROM ladder"


def split_ladder(spark, d):
    return ladder(spark, d).withColumn("split", F.when(F.col("year") <= 1998, "train").when(F.col("year") == 1999, "val").otherwise("test"))


PSI = f"""WITH l AS ({LADDER_SPLIT}), v AS (SELECT lead, split, 'tp' AS name, tp AS x FROM l UNION ALL SELECT lead, split, 'obs', obs FROM l),
    e AS (SELECT lead, name, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM v WHERE split = 'train' GROUP BY 1, 2),
    b AS (SELECT lead, name, split, CASE WHEN len(edges) < 3 THEN 0 ELSE len(list_filter(edges[2:len(edges) - 1], lambda z: x >= z)) END AS bin, len(edges) AS m FROM v JOIN e USING (lead, name)),
    c AS (SELECT lead, name, bin, max(m) AS m, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM b GROUP BY 1, 2, 3),
    s AS (SELECT lead, name, m, a / (sum(a) OVER w)::DOUBLE + 1e-6 AS pa, b / (sum(b) OVER w)::DOUBLE + 1e-6 AS pb FROM c WINDOW w AS (PARTITION BY lead, name))"""


@query("a11_psi", sql(PSI + " SELECT lead, name, round(sum(CASE WHEN m < 3 THEN 0 ELSE (pb - pa) * ln(pb / pa) END), 6) AS psi, count(*) AS bins FROM s GROUP BY 1, 2", "ladder"))
def a11(spark, d):
    long = split_ladder(spark, d).select("lead", "split", F.explode(F.create_map(F.lit("tp"), "tp", F.lit("obs"), "obs")).alias("name", "x"))
    return R6(S.stability_index(long, "x", "split", "train", "test", ["lead", "name"]))


@query("a12_drift", sql(PSI + """, p AS (SELECT lead, name, sum(CASE WHEN m < 3 THEN 0 ELSE (pb - pa) * ln(pb / pa) END) AS psi FROM s GROUP BY 1, 2),
    r AS (SELECT lead, avg(tp - obs) FILTER (split = 'train') AS b0, avg(tp - obs) FILTER (split = 'test') AS b1, count(*) FILTER (split = 'train') AS n0, count(*) FILTER (split = 'test') AS n1 FROM l GROUP BY 1)
    SELECT p.lead, name, round(psi, 6) AS psi, psi > 0.25 AS input_drift, round(b1 - b0, 6) AS bias_shift, n0 > 500 AND n1 > 500 AND abs(b1 - b0) > 3 AS skill_drift FROM p JOIN r ON p.lead = r.lead""", "ladder"))
def a12(spark, d):
    l = split_ladder(spark, d)
    long = l.select("lead", "split", F.explode(F.create_map(F.lit("tp"), "tp", F.lit("obs"), "obs")).alias("name", "x"))
    psi = S.stability_index(long, "x", "split", "train", "test", ["lead", "name"])
    e, at = F.col("tp") - F.col("obs"), lambda s: F.col("split") == s
    shift = l.groupBy("lead").agg(F.avg(F.when(at("train"), e)).alias("b0"), F.avg(F.when(at("test"), e)).alias("b1"), F.count_if(at("train")).alias("n0"), F.count_if(at("test")).alias("n1"))
    gap = F.col("b1") - F.col("b0")
    return R6(psi.join(shift, "lead").select("lead", "name", "psi", (F.col("psi") > 0.25).alias("input_drift"), gap.alias("bias_shift"), ((F.col("n0") > 500) & (F.col("n1") > 500) & (F.abs(gap) > 3)).alias("skill_drift")))


@query("a10_weighted_bias", sql(f"WITH l AS ({LADDER_SPLIT}), c AS (SELECT lead, ix % 3 AS regime, iy, count(*) AS n, avg(tp - obs) AS bias FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 10) SELECT lead, regime, CAST(sum(n) AS BIGINT) AS n, round(sum(n * bias) / sum(n), 6) AS bias FROM c GROUP BY 1, 2", "ladder"))
def a10(spark, d):
    c = ladder(spark, d).groupBy("lead", (F.col("ix") % 3).alias("regime"), "iy").agg(F.count("*").alias("n"), F.avg(F.col("tp") - F.col("obs")).alias("bias")).where("n >= 10")
    return R6(c.groupBy("lead", "regime").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("bias")) / F.sum("n")).alias("bias")))


@query("a09_error_atlas", sql("""SELECT lead, ix % 3 AS regime, iy % 4 AS region, count(*) AS n, round(avg(tp - obs), 5) AS bias, round(avg(tp - obs) / nullif(avg(obs), 0), 5) AS relative_bias FROM ladder
    WHERE tp IS NOT NULL AND obs IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 100""", "ladder"))
def a09(spark, d):
    l = ladder(spark, d).where("tp IS NOT NULL AND obs IS NOT NULL")
    e = F.avg(F.col("tp") - F.col("obs"))
    return R6(l.groupBy("lead", (F.col("ix") % 3).alias("regime"), (F.col("iy") % 4).alias("region")).agg(F.count("*").alias("n"), e.alias("bias"), rain.ratio(e, F.avg("obs")).alias("relative_bias")).where("n >= 100"), 5)


@query("a07_verification_cube", sql(f"""WITH m AS (SELECT region, 'raw' AS model, fc, obs FROM paired UNION ALL SELECT region, 'damped', round(0.5 * fc, 6), obs FROM paired)
    SELECT model, coalesce(region, 'all') AS region, {CONT} FROM m GROUP BY GROUPING SETS ((model, region), (model)) HAVING count(*) >= 20""", "paired"))
def a07(spark, d):
    """Models side by side, overall and by region, by grouping sets over one unpivoted scan."""
    p = paired(spark, d)
    long = p.select("region", "obs", F.explode(F.create_map(F.lit("raw"), F.col("fc"), F.lit("damped"), F.round(F.col("fc") * 0.5, 6))).alias("model", "fc"))
    out = long.groupingSets([["model", "region"], ["model"]], "model", "region").agg(*S.continuous_aggregates("fc", "obs")).where("n >= 20")
    return R6(out.withColumn("region", F.coalesce("region", F.lit("all"))))


@query("a38_pivot", sql("SELECT region, round(avg(fc) FILTER (cell % 3 = 0), 6) AS m0, round(avg(fc) FILTER (cell % 3 = 1), 6) AS m1, round(avg(fc) FILTER (cell % 3 = 2), 6) AS m2 FROM paired GROUP BY region", "paired"))
def a38(spark, d):
    p = paired(spark, d).withColumn("m", F.concat(F.lit("m"), (F.col("cell") % 3).cast("string")))
    return R6(p.groupBy("region").pivot("m", ["m0", "m1", "m2"]).agg(F.avg("fc")))


@query("a39_headline", sql(f"""WITH o AS (SELECT {CONT} FROM paired), c AS ({contingency_sql('').replace('WITH ', 'WITH ', 1)}) SELECT 'raw' AS model, o.rmse, o.bias, max(csi) FILTER (threshold = 15.6) AS csi_moderate, max(csi) FILTER (threshold = 64.5) AS csi_heavy FROM o, c GROUP BY 1, 2, 3""", "paired"))
def a39(spark, d):
    p = paired(spark, d)
    c = S.contingency(p, "fc", "obs", rain.THRESHOLDS)
    heads = c.agg(F.max(F.when(F.col("threshold") == 15.6, F.col("csi"))).alias("csi_moderate"), F.max(F.when(F.col("threshold") == 64.5, F.col("csi"))).alias("csi_heavy"))
    one = lambda x: x.withColumn("model", F.lit("raw"))
    return R6(one(S.continuous(p, "fc", "obs").select("rmse", "bias")).join(one(heads), "model"))


@query("t06_model_order", "SELECT model, CAST(place AS INT) AS place FROM (VALUES ('L6_regime_qm', 6), ('L0_raw', 0), ('L2_qmap', 2)) v(model, place) ORDER BY place")
def t06(spark, d):
    order = spark.createDataFrame([(m, i) for i, m in enumerate(["L0_raw", "L1_climbias", "L2_qmap", "L3_gbm", "L4_gbm_regime", "L5_moe", "L6_regime_qm"])], "model string, place int")
    return spark.createDataFrame([("L6_regime_qm",), ("L0_raw",), ("L2_qmap",)], "model string").join(F.broadcast(order), "model").orderBy("place")


@query("a16_shifted_daily_mean", "SELECT user_id, CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS label, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def a16(spark, d):
    from ..functions.windows import label_of

    return R6(table(spark, d, "events").groupBy("user_id", label_of(F.col("ts")).cast("string").alias("label")).agg(F.avg("value").alias("mean")))


@query("a17_granule_day", sql("""SELECT CAST(CAST(make_timestamp((slot * 1800 - 10800) * 1000000) AS DATE) AS VARCHAR) AS label, count(*) AS granules, count(*) = 48 AS complete,
    round(CASE WHEN count(*) = 48 AND count(rate) = 48 THEN sum(rate) * 0.5 END, 4) AS rain FROM granules GROUP BY 1""", "granules"))
def a17(spark, d):
    """Sum of 48 half-hourly rates from 03 UTC; a day with another number of granules, or a null, has no sum."""
    g = granules(spark, d)
    day = F.to_date(F.timestamp_seconds(F.col("slot") * 1800 - 10800)).cast("string")
    return R6(g.groupBy(day.alias("label")).agg(F.count("*").alias("granules"), (F.count("*") == 48).alias("complete"), F.when((F.count("*") == 48) & (F.count("rate") == 48), F.sum("rate") * 0.5).alias("rain")), 4)


@query("a18_accumulation_difference", """WITH t AS (SELECT o_custkey % 50 AS cell, o_orderkey % 5 AS k, max(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2), p AS (SELECT * FROM (VALUES (4, 1), (0, -1)) x(k, sign)),
    s AS (SELECT cell, sum(sign * v) AS diff, count(*) AS n FROM t JOIN p USING (k) GROUP BY cell) SELECT cell, round(CASE WHEN n = 2 AND diff >= -0.25 THEN greatest(diff, 0) END, 6) AS rain, n = 2 AND diff < -0.25 AS fatal FROM s""")
def a18(spark, d):
    """Difference of running totals by signed pieces; a small negative is zero, a large one is flagged."""
    t = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("cell"), (F.col("o_orderkey") % 5).alias("k")).agg((F.max("o_totalprice") / 1000).alias("v"))
    pieces = spark.createDataFrame([(4, 1), (0, -1)], "k long, sign int")
    s = t.join(F.broadcast(pieces), "k").groupBy("cell").agg(F.sum(F.col("sign") * F.col("v")).alias("diff"), F.count("*").alias("n"))
    return R6(s.select("cell", F.when((F.col("n") == 2) & (F.col("diff") >= -0.25), F.greatest("diff", F.lit(0.0))).alias("rain"), ((F.col("n") == 2) & (F.col("diff") < -0.25)).alias("fatal")))


@query("a19_bucket_check", """WITH t AS (SELECT o_custkey % 50 AS cell, o_orderkey % 6 AS k, max(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2),
    d AS (SELECT cell, abs(sum(CASE k WHEN 5 THEN v WHEN 0 THEN -v ELSE 0 END) - sum(CASE WHEN k % 2 = 1 THEN v ELSE -v END)) AS x FROM t GROUP BY cell HAVING count(*) = 6)
    SELECT count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS most, round(avg((x > 1.0)::INT), 6) AS share_above FROM d""")
def a19(spark, d):
    t = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("cell"), (F.col("o_orderkey") % 6).alias("k")).agg((F.max("o_totalprice") / 1000).alias("v"))
    v, k = F.col("v"), F.col("k")
    x = F.abs(F.sum(F.when(k == 5, v).when(k == 0, -v).otherwise(0.0)) - F.sum(F.when(k % 2 == 1, v).otherwise(-v)))
    per = t.groupBy("cell").agg(x.alias("x"), F.count("*").alias("c")).where("c = 6")
    return R6(per.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.percentile("x", F.lit(0.95)).alias("p95"), F.max("x").alias("most"), F.avg((F.col("x") > 1.0).cast("int")).alias("share_above")))


@query("a23_sufficient_statistics", sql("""WITH b AS (SELECT label, count(*) AS n, sum(fc - obs) AS s, sum((fc - obs) * (fc - obs)) AS q, sum(abs(fc - obs)) AS a FROM paired GROUP BY label)
    SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean, round((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1), 4) AS variance, round(sum(a) / sum(n), 6) AS mae, count(*) AS blocks FROM b""", "paired"))
def a23(spark, d):
    e = F.col("fc") - F.col("obs")
    b = paired(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q"), F.sum(F.abs(e)).alias("a"))
    out = b.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), ((F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")) / (F.sum("n") - 1)).alias("variance"), (F.sum("a") / F.sum("n")).alias("mae"), F.count("*").alias("blocks"))
    return R6(out.withColumn("variance", F.round("variance", 4)))


@query("a26_interval", sql("WITH b AS (SELECT label, avg(fc - obs) AS m FROM paired GROUP BY label) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b WHERE isfinite(m)", "paired"))
def a26(spark, d):
    b = paired(spark, d).groupBy("label").agg(F.avg(F.col("fc") - F.col("obs")).alias("m")).where(F.col("m").isNotNull() & ~F.isnan("m"))
    return R6(b.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")))


@query("a32_regime_fractions", sql("SELECT region, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS fraction FROM paired WHERE land GROUP BY region", "paired"))
def a32(spark, d):
    p = paired(spark, d).where("land")
    n = p.groupBy("region").agg(F.count("*").alias("n"))
    return R6(n.crossJoin(F.broadcast(p.agg(F.count("*").alias("total")))).select("region", "n", (F.col("n") / F.col("total")).alias("fraction")))


@query("a33_field_statistics", sql("SELECT count(*) AS n, count(*) FILTER (obs IS NULL) AS missing, round(min(obs), 6) AS least, round(avg(obs), 6) AS mean, round(max(obs), 6) AS most FROM pairs", "pairs"))
def a33(spark, d):
    return R6(pairs(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("obs").isNull()).alias("missing"), F.min("obs").alias("least"), F.avg("obs").alias("mean"), F.max("obs").alias("most")))


@query("a34_value_profile", sql("""SELECT count(*) FILTER (obs IS NULL) AS missing, count(*) FILTER (obs <= -900) AS fill_like, round(avg((obs IS NULL)::INT), 6) AS missing_fraction, round(avg((obs >= 2.5)::INT), 6) AS wet_fraction,
    round(quantile_cont(CASE WHEN obs >= 2.5 THEN obs END, 0.5), 6) AS wet_p50, round(quantile_cont(CASE WHEN obs >= 2.5 THEN obs END, 0.99), 6) AS wet_p99 FROM pairs""", "pairs"))
def a34(spark, d):
    return R6(value_profile(pairs(spark, d), "obs"))


@query("a35_land_from_obs", sql("SELECT c.cell, round(count(obs) / (SELECT count(DISTINCT label) FROM pairs)::DOUBLE, 6) AS share, count(obs) / (SELECT count(DISTINCT label) FROM pairs)::DOUBLE >= 0.9 AS land FROM cells c LEFT JOIN pairs p USING (cell) GROUP BY c.cell", "pairs", "cells"))
def a35(spark, d):
    p = pairs(spark, d)
    days = p.agg(F.countDistinct("label").alias("days"))
    n = cells(spark, d).join(p, "cell", "left").groupBy("cell").agg(F.count("obs").alias("n")).crossJoin(F.broadcast(days))
    share = F.col("n") / F.col("days")
    return n.select("cell", F.round(share, 6).alias("share"), (share >= 0.9).alias("land"))


@query("a36_classifier_scores", """WITH t AS (SELECT CAST(s_suppkey % 4 AS INT) AS truth, CAST(s_nationkey % 4 AS INT) AS guess FROM supplier), c AS (SELECT unnest([0, 1, 2, 3]) AS k),
    f AS (SELECT k, count(*) FILTER (truth = k AND guess = k) AS tp, count(*) FILTER (truth <> k AND guess = k) AS fp, count(*) FILTER (truth = k AND guess <> k) AS fn FROM t, c GROUP BY k),
    g AS (SELECT k, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM f)
    SELECT CAST(k AS INT) AS class, tp, fp, fn, round(f1, 6) AS f1, round(avg(f1) OVER (), 6) AS macro_f1, round((SELECT avg((truth = guess)::INT) FROM t), 6) AS accuracy FROM g""")
def a36(spark, d):
    t = table(spark, d, "supplier").select((F.col("s_suppkey") % 4).cast("int").alias("truth"), (F.col("s_nationkey") % 4).cast("int").alias("guess"))
    each = t.withColumn("class", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    right, took = F.col("truth") == F.col("class"), F.col("guess") == F.col("class")
    f = each.groupBy("class").agg(F.count_if(right & took).alias("tp"), F.count_if(~right & took).alias("fp"), F.count_if(right & ~took).alias("fn"))
    f = f.withColumn("f1", F.coalesce(rain.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    macro, acc = f.agg(F.avg("f1").alias("macro_f1")), t.agg(F.avg((F.col("truth") == F.col("guess")).cast("int")).alias("accuracy"))
    return R6(f.crossJoin(F.broadcast(macro)).crossJoin(F.broadcast(acc)))


@query("p21_fss_useful", sql("SELECT region, round(0.5 + avg((obs >= 64.5)::INT) / 2, 6) AS useful FROM paired GROUP BY region", "paired"))
def p21(spark, d):
    return R6(paired(spark, d).groupBy("region").agg((0.5 + F.avg((F.col("obs") >= 64.5).cast("int")) / 2).alias("useful")))


@query("p28_effect", sql("""WITH s AS (SELECT region, fc - obs AS e, cell % 2 = 0 AS t FROM paired), g AS (SELECT region, count(*) FILTER (t) AS n1, count(*) FILTER (NOT t) AS n2, avg(e) FILTER (t) AS m1, avg(e) FILTER (NOT t) AS m2,
    var_samp(e) FILTER (t) AS v1, var_samp(e) FILTER (NOT t) AS v2, avg(abs(e)) FILTER (t) AS a1, avg(abs(e)) FILTER (NOT t) AS a2 FROM s GROUP BY region)
    SELECT region, round(m1 - m2, 6) AS mean_diff, round(a1 - a2, 6) AS mae_diff, round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)), 0) * (1 - 3.0 / (4 * (n1 + n2 - 2) - 1)), 6) AS g FROM g""", "paired"))
def p28(spark, d):
    s = paired(spark, d).select("region", (F.col("fc") - F.col("obs")).alias("e"), (F.col("cell") % 2 == 0).alias("t"))
    a, b = F.when(F.col("t"), F.col("e")), F.when(~F.col("t"), F.col("e"))
    g = s.groupBy("region").agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.avg(F.abs(a)).alias("a1"), F.avg(F.abs(b)).alias("a2"))
    c = F.col
    return R6(g.select("region", (c("m1") - c("m2")).alias("mean_diff"), (c("a1") - c("a2")).alias("mae_diff"), rain.hedges_g(c("n1"), c("m1"), c("v1"), c("n2"), c("m2"), c("v2")).alias("g")))


@query("p30_strict_and_weak", sql("SELECT count(*) FILTER (round(obs, 0) > 64) AS strict, count(*) FILTER (round(obs, 0) >= 64) AS weak FROM paired", "paired"))
def p30(spark, d):
    o = F.round("obs", 0)
    return paired(spark, d).agg(F.count_if(o > 64).alias("strict"), F.count_if(o >= 64).alias("weak"))
