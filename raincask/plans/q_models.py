"""Queries of the model ladder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import ladder as LD
from ..operators import models as M
from ..operators.lookup import fallback_lookup
from ..operators.scores import quantiles_of
from ..operators.scores import rounded as R6
from .book import query
from .views import ladder, sql, table

L = "SELECT *, CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split FROM ladder"
IDS = ["lead", "iy", "ix", "year", "l_orderkey", "l_partkey", "l_suppkey"]


def split(spark, d):
    return M.split(ladder(spark, d))


@query("m00_raw", sql("SELECT lead, year, count(*) AS n, round(sum(tp), 4) AS total FROM ladder GROUP BY 1, 2", "ladder"))
def m00(spark, d):
    return R6(ladder(spark, d).groupBy("lead", "year").agg(F.count("*").alias("n"), F.sum("tp").alias("total")), 4)


RATIO = f"l AS ({L}), r AS (SELECT lead, iy, ix, least(greatest((sum(obs) + 50) / (sum(tp) + 50), 0.2), 5.0) AS ratio FROM l WHERE split = 'train' GROUP BY 1, 2, 3)"


@query("a20_ratio_table", sql(f"WITH {RATIO} SELECT lead, iy, ix, round(ratio, 6) AS ratio FROM r", "ladder"))
def a20(spark, d):
    return R6(M.ratio_table(split(spark, d).where("split = 'train'"), ["lead", "iy", "ix"]))


@query("m01_ratio_model", sql(f"WITH {RATIO} SELECT lead, iy, count(*) AS n, round(avg(tp * coalesce(ratio, 1.0)), 5) AS mean, round(sqrt(avg(pow(tp * coalesce(ratio, 1.0) - obs, 2))), 5) AS rmse FROM l LEFT JOIN r USING (lead, iy, ix) WHERE split = 'test' GROUP BY 1, 2", "ladder"))
def m01(spark, d):
    s = split(spark, d)
    r = M.ratio_table(s.where("split = 'train'"), ["lead", "iy", "ix"])
    p = s.where("split = 'test'").join(r, ["lead", "iy", "ix"], "left").withColumn("p", F.col("tp") * F.coalesce("ratio", F.lit(1.0)))
    e = F.col("p") - F.col("obs")
    return R6(p.groupBy("lead", "iy").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.sqrt(F.avg(e * e)).alias("rmse")), 5)


LEVELS = "[" + ", ".join(f"{q!r}" for q in M.UNIFORM) + "]"
TAILS = "[" + ", ".join(f"{q!r}" for q in M.TAIL) + "]"


def _map_sql(x: str) -> str:
    """Interpolation over unique knots (f, o), with the first of ties, from lists qf and qo."""
    return f"""list_filter(list_transform(range(1, len(qf) + 1), lambda i: {{'f': qf[i], 'o': qo[i], 'first': i = 1 OR qf[i] > qf[greatest(i - 1, 1)]}}), lambda k: k.first) AS ks, list_filter(ks, lambda k: k.f <= {x}) AS lo, list_filter(ks, lambda k: k.f > {x}) AS hi"""


MAPPED = "greatest(CASE WHEN x > qf[len(qf)] THEN x + qo[len(qo)] - qf[len(qf)] WHEN x <= ks[1].f THEN ks[1].o WHEN len(hi) = 0 THEN lo[len(lo)].o ELSE lo[len(lo)].o + (x - lo[len(lo)].f) * (hi[1].o - lo[len(lo)].o) / nullif(hi[1].f - lo[len(lo)].f, 0) END, 0)"


@query("a21_quantile_table", sql(f"WITH l AS ({L}) SELECT lead, iy, ix, CAST(i AS INT) AS level, round(qf[i + 1], 10) AS qf, round(qo[i + 1], 10) AS qo FROM (SELECT lead, iy, ix, quantile_cont(tp, {LEVELS}) AS qf, quantile_cont(obs, {LEVELS}) AS qo FROM l WHERE split = 'train' GROUP BY 1, 2, 3), (SELECT unnest([0, 10, 50, 90, 100]) AS i)", "ladder"))
def a21(spark, d):
    t = M.quantile_table(split(spark, d).where("split = 'train'"), ["lead", "iy", "ix"], M.UNIFORM)
    at = F.explode(F.array(*(F.lit(i) for i in (0, 10, 50, 90, 100)))).alias("level")
    return R6(t.select("lead", "iy", "ix", at, "qf", "qo").select("lead", "iy", "ix", "level", F.element_at("qf", F.col("level") + 1).alias("qf"), F.element_at("qo", F.col("level") + 1).alias("qo")), 10)


@query("m02_quantile_mapping", sql(f"""WITH l AS ({L}), q AS (SELECT lead, iy, ix, quantile_cont(tp, {LEVELS}) AS qf, quantile_cont(obs, {LEVELS}) AS qo FROM l WHERE split = 'train' GROUP BY 1, 2, 3),
    k AS (SELECT l.lead, l.iy, l.tp AS x, qf, qo, {_map_sql('l.tp')} FROM l JOIN q USING (lead, iy, ix) WHERE split = 'test') SELECT lead, iy, count(*) AS n, round(avg({MAPPED}), 5) AS mean, round(max({MAPPED}), 5) AS most FROM k GROUP BY 1, 2""", "ladder"))
def m02(spark, d):
    """Maps fitted on the training years, applied to the test years."""
    s = split(spark, d)
    q = M.with_knots(M.quantile_table(s.where("split = 'train'"), ["lead", "iy", "ix"], M.UNIFORM))
    p = M.quantile_mapped(s.where("split = 'test'").join(q, ["lead", "iy", "ix"]), "tp", "p")
    return R6(p.groupBy("lead", "iy").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.max("p").alias("most")), 5)


@query("a22_regime_quantiles", sql(f"WITH l AS ({L}) SELECT lead, iy AS regime, count(*) AS n, round(quantile_cont(tp, 0.99), 10) AS f99, round(quantile_cont(obs, 0.99), 10) AS o99 FROM l GROUP BY GROUPING SETS ((lead, iy), (lead)) HAVING count(*) >= 2000", "ladder"))
def a22(spark, d):
    """By lead and regime from 2000 rows on, and by lead alone; no group's values meet in one task."""
    s = split(spark, d).withColumnRenamed("iy", "regime")
    g = quantiles_of(s, ["tp", "obs"], [0.99], ["lead", "regime"], ["lead"]).where("n >= 2000")
    return R6(g.select("lead", "regime", "n", F.col("q_tp")[0].alias("f99"), F.col("q_obs")[0].alias("o99")), 10)


@query("m06_regime_restore", sql(f"""WITH l AS ({L}), q AS (SELECT lead, iy AS regime, quantile_cont(tp, {TAILS}) AS qf, quantile_cont(obs, {TAILS}) AS qo FROM l WHERE split = 'val' GROUP BY GROUPING SETS ((lead, iy), (lead)) HAVING iy IS NULL OR count(*) >= 400),
    j AS (SELECT l.lead, l.tp AS x, coalesce(a.qf, b.qf) AS qf, coalesce(a.qo, b.qo) AS qo FROM l LEFT JOIN q a ON a.lead = l.lead AND a.regime = l.iy LEFT JOIN q b ON b.lead = l.lead AND b.regime IS NULL WHERE split = 'test'),
    k AS (SELECT *, {_map_sql('x')} FROM j) SELECT lead, count(*) AS n, round(avg({MAPPED}), 5) AS mean, round(max({MAPPED}), 5) AS most FROM k GROUP BY 1""", "ladder"))
def m06(spark, d):
    """Quantiles restored by regime, with the lead's own map where a regime has too few rows."""
    s = split(spark, d).withColumnRenamed("iy", "regime")
    g = quantiles_of(s.where("split = 'val'"), ["tp", "obs"], M.TAIL, ["lead", "regime"], ["lead"]).where("_wide OR (regime IS NOT NULL AND n >= 400)")
    maps = M.with_knots(g.select("lead", "regime", F.col("q_tp").alias("qf"), F.col("q_obs").alias("qo"), "n"))
    rows = s.where("split = 'test'").select("lead", "regime", "tp")
    p = fallback_lookup(rows, maps, ["lead", "regime"], ["lead"], ["knots", "top"])
    p = M.quantile_mapped(p, "tp", "p")
    return R6(p.groupBy("lead").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.max("p").alias("most")), 5)


@query("w14_argmax", "SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'break' WHEN b >= c THEN 'normal' ELSE 'active' END AS regime, greatest(a, b, c) AS confidence FROM (SELECT p_partkey, (p_size % 7) / 10.0::DOUBLE AS a, (p_partkey % 5) / 10.0::DOUBLE AS b, (p_partkey % 3) / 10.0::DOUBLE AS c FROM part)")
def w14(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7 / 10).alias("a"), (F.col("p_partkey") % 5 / 10).alias("b"), (F.col("p_partkey") % 3 / 10).alias("c"))
    name, most = M.argmax(["break", "normal", "active"], ["a", "b", "c"])
    return p.select("p_partkey", name.alias("regime"), most.alias("confidence"))


FEATURES = ["tp", "tp_log", "iy", "ix", "lead", "season_sin", "season_cos"]


def features(spark, d):
    from ..functions.rain import season_phase

    s, c = season_phase(F.col("time"))
    return split(spark, d).withColumns({"tp_log": F.log1p("tp"), "season_sin": s, "season_cos": c, "label": F.when(F.col("tp") > 40, 1).when(F.col("obs") > 60, 2).otherwise(0)})


#: Rounds and depth of the learned levels in these queries.
BOOSTING = {"rounds": 4, "depth": 3, "rate": 0.3}
YEARS, CLASSES = [1996, 1997, 1998], [0, 1, 2]
AWARE = [*FEATURES, *(f"p_{c}" for c in CLASSES)]


def part(name):
    return F.col("split") == name


def scored(df, name, **more):
    e = F.col(name) - F.col("obs")
    return R6(df.groupBy("lead").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.min(name).alias("least"), *(v.alias(k) for k, v in more.items())), 4)


@query("m03_boosted")
def m03(spark, d):
    """Tweedie trees that stop on the validation year."""
    f = features(spark, d)
    model = B.fit(f, FEATURES, F.col("obs"), "tweedie", [B.Problem(part("train"), part("val"))], **BOOSTING)[0]
    return scored(f.where("split = 'test'").withColumn("L3_gbm", B.prediction(model)), "L3_gbm")


def regime_features(spark, d):
    """All rows with class probabilities: training rows have those that other years give."""
    f = features(spark, d)
    return LD.class_probabilities(f, FEATURES, "label", CLASSES, part("train") & F.col("year").isin(YEARS), YEARS, **BOOSTING)[1]


@query("m04_regime_boosted")
def m04(spark, d):
    """Tweedie trees that know the class probabilities, cross-fitted by year."""
    f = regime_features(spark, d)
    model = B.fit(f, AWARE, F.col("obs"), "tweedie", [B.Problem(part("train") & F.col("year").isin(YEARS), part("val"))], **BOOSTING)[0]
    return scored(f.where("split = 'test'").withColumn("L4_gbm_regime", B.prediction(model)), "L4_gbm_regime")


def whole_ladder(spark, d, thresholds=()):
    """Fitted on all rows of all training years; each of those years has probabilities that the others give."""
    f = features(spark, d)
    years = sorted(r.year for r in f.where(part("train") & F.col("obs").isNotNull()).select("year").distinct().collect())  # a row a year
    return LD.fit_ladder(f.where(part("val") | part("train")), FEATURES, CLASSES, years, thresholds, least_expert_rows=500, least_map_rows=400, **BOOSTING), f.where("split = 'test'")


@query("m05_experts")
def m05(spark, d):
    """A boosted model for each class with enough rows, mixed by the class probabilities and shrunk to the general one."""
    ladder, test = whole_ladder(spark, d)
    return scored(LD.predict_table(ladder, test), "L5_moe")


@query("m05_gate", sql("SELECT lead, count(*) AS n, round(avg(0.25 * (0.2 * (tp + 1) + 0.8 * tp) + 0.75 * (0.5 * tp / 2 + 0.5 * tp)), 4) AS mean FROM ladder GROUP BY 1", "ladder"))
def m05_gate(spark, d):
    """The gate of the mixture by itself, on two predictions by formula: shrunk by their training rows, weighted by class probabilities."""
    gated = M.gate_experts(F.col("tp"), [(F.col("tp") + 1, F.lit(0.25), 5_000.0), (F.col("tp") / 2, F.lit(0.75), 20_000.0)])
    return R6(ladder(spark, d).groupBy("lead").agg(F.count("*").alias("n"), F.avg(gated).alias("mean")), 4)


@query("m12_importance")
def m12_importance(spark, d):
    """Shares of the gain in a fitted boosted model."""
    f = features(spark, d)
    return spark.createDataFrame(B.importance(B.fit(f, FEATURES, F.col("obs"), "tweedie", [B.Problem(part("train"), part("val"))], **BOOSTING)[0]), "feature string, share double")


@query("m12_shapley")
def m12_shapley(spark, d):
    """Exact attributions of the Tweedie level for all test rows: means by lead and feature, and how far they are from adding up."""
    f = features(spark, d)
    model = B.fit(f, FEATURES, F.col("obs"), "tweedie", [B.Problem(part("train"), part("val"))], **BOOSTING)[0]
    c = f.where("split = 'test'").select("lead", B.contributions(model).alias("c"), B.margin(model).alias("m"))
    gap = F.abs(F.aggregate("c", F.lit(B.base_value(model)), lambda s, x: s + x) - F.col("m"))
    each = c.select("lead", gap.alias("gap"), F.posexplode("c").alias("at", "value")).withColumn("feature", F.element_at(F.array(*map(F.lit, FEATURES)), F.col("at") + 1))
    return R6(each.groupBy("lead", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.abs("value")).alias("strength"), F.max("gap").alias("gap")), 6)


#: Features of each driver theme.
THEMES = {"rain": ["tp", "tp_log"], "place": ["iy", "ix"], "lead": ["lead"], "season": ["season_sin", "season_cos"], "regime": [f"p_{c}" for c in CLASSES]}


@query("t03_model_drivers")
def t03_model(spark, d):
    """The strongest driver themes of each test row, by attributions of the regime-aware level, counted by place."""
    ladder, test = whole_ladder(spark, d)
    p = B.with_probabilities(ladder.classifier, test)
    top = LD.drivers(ladder, p, ["l_orderkey", "l_partkey", "l_suppkey", "lead", "time", "tp"], THEMES, 3)
    return R6(top.groupBy("driver", "rank", "direction").agg(F.count("*").alias("n"), F.sum("contribution_log").alias("total")), 2)


@query("m13_explanations")
def m13_explanations(spark, d):
    """Each row of one day: its levels, predicted class, how typical it is of the archive, confidence and first driver. All rows of the archive say what is usual."""
    ladder, test = whole_ladder(spark, d)
    key = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "lead", "tp", "obs").alias("id")
    day = LD.predict_table(ladder, test.where("time = DATE '2000-07-01'")).withColumn("id", key)
    archive = B.with_probabilities(ladder.classifier, features(spark, d).where(part("train"))).withColumn("id", key).withColumn("regime_pred", M.argmax(CLASSES, [f"p_{c}" for c in CLASSES])[0])
    # Rows of equal ids are equal here: each is told the same once.
    kind = LD.typicality(day, archive, None, ["tp_log", "iy", "ix", "season_sin"], "regime_pred", "id").withColumnRenamed("query", "id").dropDuplicates(["id"])
    first = LD.drivers(ladder, day, ["id"], THEMES, 1).select("id", "driver", "direction").dropDuplicates(["id"])
    out = day.join(kind, "id").join(first, "id").withColumn("confidence", LD.explained_confidence(F.col("regime_conf"), F.col("typicality")))
    return R6(out.select("id", "lead", "tp", "L4_gbm_regime", "regime_pred", "regime_conf", "distance", "typicality", "confidence", "driver", "direction"), 5)


DRIVERS = {"rain": ("tp", 0.02), "north": ("iy", -0.1), "east": ("ix", 0.05), "lead": ("lead", -0.3), "season": ("year", -0.0007), "supply": ("l_suppkey", 0.001)}


@query("t03_top_drivers", sql("WITH c AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_partkey, l_suppkey, lead, time, tp, '{k}' AS driver, {c} * ({w}::DOUBLE) AS value FROM ladder" for k, (c, w) in DRIVERS.items()) + """), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, lead, time, tp ORDER BY abs(value) DESC, driver) AS rank FROM c)
    SELECT driver, CAST(rank AS INT) AS rank, CASE WHEN value > 0 THEN 'increases' ELSE 'decreases' END AS direction, count(*) AS n, round(sum(round(value, 3)), 3) AS total FROM r WHERE rank <= 5 GROUP BY 1, 2, 3""", "ladder"))
def t03(spark, d):
    """The five strongest of six drivers of each row, counted by place."""
    by = ["l_orderkey", "l_partkey", "l_suppkey", "lead", "time", "tp"]
    top = M.top_drivers_of(ladder(spark, d), by, {k: F.col(c) * w for k, (c, w) in DRIVERS.items()})
    return top.groupBy("driver", "rank", "direction").agg(F.count("*").alias("n"), F.round(F.sum("contribution_log"), 3).alias("total"))


@query("m07_exceedance_head")
def m07(spark, d):
    f = features(spark, d)
    p = LD.with_head(f.where("split = 'test'"), "p", LD.fit_head(f, FEATURES, 64.5, part("train"), part("val"), **BOOSTING))
    return R6(p.groupBy("lead").agg(F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most"), F.avg("p").alias("mean")), 4)


@query("m08_regime_classifier")
def m08(spark, d):
    """Boosted trees of all classes at once; the fourth class has no rows and gets no probability."""
    f = features(spark, d)
    models, p = LD.class_probabilities(f, FEATURES, "label", range(4), part("train"), [], **BOOSTING)
    name, most = M.argmax(["0", "1", "2", "3"], [f"p_{c}" for c in range(4)])
    p = p.where("split = 'test'").select(name.alias("predicted"), most.alias("confidence"), F.col("label"))
    return R6(p.groupBy("predicted", "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")), 4)


@query("m09_out_of_year")
def m09(spark, d):
    """Each year's class probabilities from the other years."""
    f = features(spark, d).where("year BETWEEN 1996 AND 1998")
    p = LD.class_probabilities(f, FEATURES, "label", CLASSES, F.lit(True), YEARS, **BOOSTING)[1]
    return R6(p.groupBy("year").agg(F.count("*").alias("n"), *(F.avg(f"p_{c}").alias(f"p_{c}") for c in CLASSES)), 4)


@query("m10_predictions")
def m10(spark, d):
    """The whole prediction table of the test rows: seven levels, heads, class probabilities, predicted class and its confidence."""
    ladder, test = whole_ladder(spark, d, thresholds=(15.6, 64.5))
    p = LD.predict_table(ladder, test)
    levels = ["L0_raw", "L1_climbias", "L2_qmap", "L3_gbm_generic", "L4_gbm_regime", "L5_moe", "L6_regime_qm", "p_gt_15_6", "p_gt_64_5", *(f"p_{c}" for c in CLASSES), "regime_conf"]
    return R6(p.select(*IDS, "regime_pred", *levels), 5)


def predictions(spark, d):
    s = split(spark, d)
    train = s.where("split = 'train'")
    r, q = M.ratio_table(train, ["lead", "iy", "ix"]), M.with_knots(M.quantile_table(train, ["lead", "iy", "ix"], M.UNIFORM))
    p = s.where("split = 'test'").join(r, ["lead", "iy", "ix"], "left").join(q, ["lead", "iy", "ix"], "left")
    p = M.quantile_mapped(p, "tp", "L2_qmap")
    return p.select(*IDS, F.col("tp").alias("L0_raw"), (F.col("tp") * F.coalesce("ratio", F.lit(1.0))).alias("L1_climbias"), F.coalesce("L2_qmap", "tp").alias("L2_qmap"))


@query("m10_prediction_means", sql(f"""WITH {RATIO}, q AS (SELECT lead, iy, ix, quantile_cont(tp, {LEVELS}) AS qf, quantile_cont(obs, {LEVELS}) AS qo FROM l WHERE split = 'train' GROUP BY 1, 2, 3),
    k AS (SELECT l.*, ratio, l.tp AS x, qf, qo, {_map_sql('l.tp')} FROM l LEFT JOIN r USING (lead, iy, ix) LEFT JOIN q USING (lead, iy, ix) WHERE split = 'test')
    SELECT lead, iy, ix, year, count(*) AS n, round(avg(tp), 6) AS L0_raw, round(avg(tp * coalesce(ratio, 1.0)), 6) AS L1_climbias, round(avg(coalesce(CASE WHEN qf IS NOT NULL THEN {MAPPED} END, tp)), 6) AS L2_qmap FROM k GROUP BY 1, 2, 3, 4""", "ladder"))
def m10_means(spark, d):
    """Means of the prediction table by cell and year: single rows end in ties that two engines round apart."""
    return R6(predictions(spark, d).groupBy("lead", "iy", "ix", "year").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("L0_raw", "L1_climbias", "L2_qmap"))))


@query("m11_one_day", sql(f"WITH {RATIO} SELECT lead, iy, ix, tp, round(tp * coalesce(ratio, 1.0), 5) AS corrected, l_orderkey FROM l LEFT JOIN r USING (lead, iy, ix) WHERE time = DATE '2000-07-01'", "ladder"))
def m11(spark, d):
    """The same plan as for all test rows, for one day."""
    s = split(spark, d)
    r = M.ratio_table(s.where("split = 'train'"), ["lead", "iy", "ix"])
    return R6(s.where("time = DATE '2000-07-01'").join(r, ["lead", "iy", "ix"], "left").select("lead", "iy", "ix", "tp", (F.col("tp") * F.coalesce("ratio", F.lit(1.0))).alias("corrected"), "l_orderkey"), 5)


@query("m12_contributions", sql("SELECT lead, feature, round(avg(v), 4) AS mean, round(avg(abs(v)), 4) AS strength FROM (SELECT lead, 'tp' AS feature, tp * 0.02 AS v FROM ladder UNION ALL SELECT lead, 'iy', iy * -0.1 FROM ladder) GROUP BY 1, 2", "ladder"))
def m12(spark, d):
    c = ladder(spark, d).select("lead", F.inline(M.linear_contributions(None, {"tp": 0.02, "iy": -0.1})))
    return R6(c.groupBy("lead", "feature").agg(F.avg("value").alias("mean"), F.avg(F.abs("value")).alias("strength")), 4)


@query("m13_confidence", "SELECT p_partkey, CASE WHEN p >= 0.6 AND m <= 30 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT p_partkey, (p_partkey % 10) / 10.0::DOUBLE AS p, p_size AS m FROM part)")
def m13(spark, d):
    return table(spark, d, "part").select("p_partkey", M.confidence(F.col("p_partkey") % 10 / 10, F.col("p_size"), F.lit(30)).alias("confidence"))


@query("m14_subsample", "SELECT l_orderkey % 100 AS k, count(*) AS n FROM lineitem WHERE (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + 42) % 1000003 % 10 < 3 GROUP BY 1")
def m14(spark, d):
    """A seeded share of the training rows by arithmetic on their keys; a sampling operator, as in the ladder's training caps."""
    pick = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104_729 + F.col("l_suppkey") * 31 + 42, F.lit(1_000_003)) % 10 < 3
    return table(spark, d, "lineitem").where(pick).groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.count("*").alias("n"))
