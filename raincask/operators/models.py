"""The correction ladder: ratios, quantile maps, learned regressors and heads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rain import clip, ratio

UNIFORM = [i / 100 for i in range(101)]
# Tail-weighted levels: 46 up to 0.9, 19 up to 0.99, 11 up to 1.
TAIL = sorted({round(x, 12) for x in [0.9 * i / 45 for i in range(46)] + [0.9 + 0.09 * i / 18 for i in range(19)] + [0.99 + 0.01 * i / 10 for i in range(11)]})


def ratio_table(train: DataFrame, keys: Sequence[str], tp: str = "tp", obs: str = "obs", pseudo: float = 50.0) -> DataFrame:
    """Climatological ratio of each key, with a pseudo-amount, clipped to 0.2 to 5."""
    r = (F.sum(obs) + pseudo) / (F.sum(tp) + pseudo)
    return train.groupBy(*keys).agg(clip(r, 0.2, 5.0).alias("ratio"))


def quantile_table(train: DataFrame, keys: Sequence[str], levels: Sequence[float], tp: str = "tp", obs: str = "obs") -> DataFrame:
    """Paired quantiles of forecast and observation: arrays qf and qo."""
    probs = F.array(*(F.lit(float(q)) for q in levels))
    return train.groupBy(*keys).agg(F.percentile(tp, probs).alias("qf"), F.percentile(obs, probs).alias("qo"), F.count("*").alias("n"))


def knots(qf: Column, qo: Column) -> Column:
    """array<struct<f, o>>: the paired quantiles without tied forecasts; the first of equal ones stays."""
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice(qf, 1, F.size(qf) - 1))
    pairs = F.filter(F.arrays_zip(qf.alias("f"), qo.alias("o"), before.alias("p")), lambda k: k["p"].isNull() | (k["f"] > k["p"]))
    return F.transform(pairs, lambda k: F.struct(k["f"].alias("f"), k["o"].alias("o")))


def with_knots(maps: DataFrame) -> DataFrame:
    """Quantile tables with their knots, made once a map and not once a row; top is the last pair."""
    return maps.select(*[c for c in maps.columns if c not in ("qf", "qo")], knots(F.col("qf"), F.col("qo")).alias("knots"), F.struct(F.element_at("qf", -1).alias("f"), F.element_at("qo", -1).alias("o")).alias("top"))


def quantile_mapped(df: DataFrame, x: str, out: str) -> DataFrame:
    """Interpolation over the row's knots (null without them), a constant shift above the top, never negative."""
    at = df.withColumn("_i", F.size(F.filter("knots", lambda k: k["f"] <= F.col(x))))
    ends = at.withColumn("_lo", F.element_at("knots", F.greatest("_i", F.lit(1)))).withColumn("_hi", F.try_element_at("knots", F.col("_i") + 1))
    v, lo, hi, top = F.col(x), F.col("_lo"), F.col("_hi"), F.col("top")
    inner = lo["o"] + (v - lo["f"]) * (hi["o"] - lo["o"]) / F.nullif(hi["f"] - lo["f"], F.lit(0.0))
    y = F.when(v > top["f"], v + (top["o"] - top["f"])).when((F.col("_i") == 0) | hi.isNull(), lo["o"]).otherwise(inner)
    return ends.withColumn(out, F.when(F.col("knots").isNotNull(), F.greatest(y, F.lit(0.0)))).drop("_i", "_lo", "_hi")


def argmax(names: Sequence[str], columns: Sequence[str]) -> tuple[Column, Column]:
    """(name of the first largest, its value)."""
    p = F.array(*columns)
    return F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(p, F.array_max(p)).cast("int")), F.array_max(p)


def gate_experts(general: Column, experts: Sequence[tuple[Column, Column, float]], k: float = 20_000.0) -> Column:
    """Mixture of experts: (prediction, class probability, training rows) each, shrunk to the general one by n / (n + k)."""
    out = F.lit(0.0)
    for prediction, p, n in experts:
        w = n / (n + k)
        out = out + p * (w * prediction + (1 - w) * general)
    return out


def split(df: DataFrame, year: str = "year") -> DataFrame:
    return df.withColumn("split", F.when(F.col(year) <= 1998, "train").when(F.col(year) == 1999, "val").otherwise("test"))


def no_leak(features: Sequence[str]) -> list[str]:
    """The features, or an error if one of them is an observation, an analysis field or a label."""
    bad = [f for f in features if f == "obs" or f.startswith(("an_", "label", "obs_"))]
    if bad:
        raise ValueError(f"predictors would leak: {bad}")
    return list(features)


def boosted_regressor(train: DataFrame, features: Sequence[str], target: str = "obs", trees: int = 20, depth: int = 4, seed: int = 42):
    """Gradient-boosted trees on log1p of the rain. Spark has no Tweedie loss for trees: squared error on the log scale stands in."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = train.withColumn("_y", F.log1p(target))
    return Pipeline(stages=[VectorAssembler(inputCols=no_leak(features), outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)]).fit(data)


def predict_rain(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, F.greatest(F.expm1("_p"), F.lit(0.0))).drop("_x", "_p")


def exceedance_head(train: DataFrame, calibration: DataFrame, features: Sequence[str], threshold: float, target: str = "obs", least_events: int = 20, seed: int = 42):
    """P(rain > threshold), strictly: boosted classifier and isotonic calibration; the base rate with too few events.

    Returns a function DataFrame -> DataFrame with the column p_gt_<threshold>.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    name = f"p_gt_{threshold:g}"
    event = (F.col(target) > threshold).cast("double")
    stats = train.agg(F.sum(event).alias("e"), F.avg(event).alias("rate")).first()
    if (stats.e or 0) < least_events:
        return lambda df: df.withColumn(name, F.lit(float(stats.rate or 0.0)))
    model = Pipeline(stages=[VectorAssembler(inputCols=no_leak(features), outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=10, maxDepth=3, seed=seed)]).fit(train.withColumn("_y", event))
    score = lambda df: model.transform(df).withColumn("_s", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
    iso = IsotonicRegression(featuresCol="_s", labelCol="_y").fit(score(calibration).withColumn("_y", event))
    return lambda df: iso.transform(score(df)).withColumn(name, clip(F.col("prediction"))).drop("_s", "prediction")


def regime_classifier(train: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], trees: int = 20, seed: int = 42):
    """Class probabilities p_<class> by a random forest (Spark's boosted trees are binary); classes without rows get 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    forest = RandomForestClassifier(featuresCol="_x", labelCol="_c", numTrees=trees, maxDepth=5, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=no_leak(features), outputCol="_x"), forest]).fit(train.withColumn("_c", F.col(label).cast("double")))
    width = model.stages[-1].numClasses

    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn("_a", vector_to_array("probability"))
        return out.withColumns({f"p_{c}": F.col("_a")[c] if c < width else F.lit(0.0) for c in classes}).drop("_x", "_a", "rawPrediction", "probability", "prediction")

    return apply


def out_of_year(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], years: Sequence[int]) -> DataFrame:
    """Each year's probabilities from a classifier fitted on the other years; one year alone is in-sample."""
    out = None
    for y in years:
        rest = df.where(F.col("year") != y) if len(years) > 1 else df
        part = regime_classifier(rest, features, label, classes, trees=5)(df.where(F.col("year") == y))
        out = part if out is None else out.unionByName(part)
    return out


def cross_fitted(train: DataFrame, others: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], years: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Class probabilities of the training rows, each year's from the other years, and of other rows, from all training years."""
    return out_of_year(train, features, label, classes, years), regime_classifier(train, features, label, classes, trees=5)(others)


@dataclass
class Experts:
    """A general model, and one for each class with enough rows; `rows` has all classes' numbers of training rows."""

    general: object
    experts: dict[int, object]
    rows: dict[int, int]


def fit_experts(train: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], general=None, least_rows: int = 5_000, **options) -> Experts:
    """One boosted model a class, fitted on the rows of that class; a class with fewer than `least_rows` gets none."""
    general = general or boosted_regressor(train, features, **options)
    rows = {int(r[label]): r["n"] for r in train.where(F.col(label).isin(list(classes))).groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    experts = {c: boosted_regressor(train.where(F.col(label) == c), features, **options) for c in classes if rows.get(c, 0) >= least_rows}
    return Experts(general, experts, {c: rows.get(c, 0) for c in classes})


def predict_mixture(model: Experts, df: DataFrame, name: str, k: float = 20_000.0, probability: str = "p_{}") -> DataFrame:
    """Experts weighted by the class probabilities, each shrunk to the general model by n / (n + k); a class without one counts as general."""
    out = predict_rain(model.general, df, "_general")
    for c, expert in model.experts.items():
        out = predict_rain(expert, out, f"_expert_{c}")
    parts = [(F.col(f"_expert_{c}") if c in model.experts else F.col("_general"), F.col(probability.format(c)), float(n) if c in model.experts else 0.0) for c, n in model.rows.items()]
    return out.withColumn(name, gate_experts(F.col("_general"), parts, k)).drop("_general", *(f"_expert_{c}" for c in model.experts))


def importance(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Shares of the gain of a fitted boosted model by feature, the largest first."""
    gain = model.stages[-1].featureImportances.toArray()
    return sorted(((f, round(float(g), 4)) for f, g in zip(features, gain)), key=lambda x: (-x[1], x[0]))


def top_drivers(contributions: DataFrame, by: Sequence[str], top: int = 5) -> DataFrame:
    """The `top` drivers of each row by the size of their contribution; of equal ones the first by name. contributions: (by, driver, value)."""
    w = Window.partitionBy(*by).orderBy(F.abs("value").desc(), "driver")
    ranked = contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select(*by, "rank", "driver", F.round("value", 3).alias("contribution_log"), F.when(F.col("value") > 0, "increases").otherwise("decreases").alias("direction"))


def top_drivers_of(rows: DataFrame, by: Sequence[str], drivers: dict[str, Column], top: int = 5) -> DataFrame:
    """`top_drivers` of rows that have all their drivers at once: a row is moved once and not for each driver. Rows of equal keys are ranked together."""
    each = rows.select(*by, F.array(*(c.cast("double") for c in drivers.values())).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_v")
    all_of = each.select(*by, F.collect_list("_v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"), F.row_number().over(w).alias("_r")).where("_r = 1")
    # NaN first, null last, as in a descending order.
    pairs = F.flatten(F.transform("_all", lambda v: F.array(*(F.struct(v[i].isNull().alias("a"), (~F.isnan(v[i])).alias("b"), (0.0 - F.abs(v[i])).alias("c"), F.lit(d).alias("driver"), v[i].alias("value")) for i, d in enumerate(drivers)))))
    ranked = all_of.select(*by, F.posexplode(F.slice(F.array_sort(pairs), 1, top)).alias("_p", "_d"))
    return ranked.select(*by, (F.col("_p") + 1).alias("rank"), "_d.driver", F.round("_d.value", 3).alias("contribution_log"), F.when(F.col("_d.value") > 0, "increases").otherwise("decreases").alias("direction"))


def linear_contributions(df: DataFrame, weights: dict[str, float]) -> Column:
    """array<struct<feature, value>>: contributions of a linear model in log space, in place of tree-based ones."""
    return F.array(*(F.struct(F.lit(f).alias("feature"), (F.col(f) * w).alias("value")) for f, w in weights.items()))


def confidence(p: Column, median: Column, p90: Column) -> Column:
    return F.when((p >= 0.6) & (median <= p90), "HIGH").when(p >= 0.4, "MEDIUM").otherwise("LOW")


def relative(a: Column, b: Column) -> Column:
    return ratio(a - b, b)
