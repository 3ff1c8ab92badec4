"""The whole ladder of corrections: fitted once, then one table of all levels, heads and classes, and explanations of its rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rain import clip
from ..storage import stored
from . import boosting as B
from .lookup import fallback_lookup, nearest_lists, squared_distance
from .models import TAIL, UNIFORM, argmax, gate_experts, no_leak, quantile_mapped, quantile_table, ratio_table, top_drivers_of, with_knots
from .scores import quantiles, quantiles_of


@dataclass
class Ladder:
    """Fitted levels. Tables belong to the grid or the classes; learned levels are node tables on the driver."""

    features: list[str]
    classes: list[int]
    keys: list[str]
    ratios: DataFrame
    maps: DataFrame
    classifier: B.Boosted
    generic: B.Boosted
    regime: B.Boosted
    experts: dict[int, B.Boosted]
    expert_rows: dict[int, int]
    restore: DataFrame | None = None
    heads: dict[float, tuple[B.Boosted, object] | float] = field(default_factory=dict)

    @property
    def aware(self) -> list[str]:
        return [*self.features, *(f"p_{c}" for c in self.classes)]


def class_probabilities(rows: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], train: Column, years: Sequence[int], **options) -> tuple[list[B.Boosted], DataFrame]:
    """Boosted classifiers, one that leaves out each year and the last on all training rows, and `rows` with probabilities.

    A training row gets those of the model that has not seen its year, any other row those of the last
    model. With one training year the last model serves all. As many models as a fit takes grow in the same aggregations.
    """
    place = F.coalesce(*(F.when(F.col(label) == c, F.lit(k)) for k, c in enumerate(classes)))
    left_out = list(years) if len(years) > 1 else []
    problems = [*(B.Problem(train & (F.col("year") != y)) for y in left_out), B.Problem(train)]
    models = [m for at in range(0, len(problems), B.PROBLEMS) for m in B.fit(rows, no_leak(features), place, "softmax", problems[at : at + B.PROBLEMS], classes=classes, **options)]
    own = F.coalesce(train & F.col("year").isin(left_out), F.lit(False)) if left_out else F.lit(False)
    chosen = sum((F.when(own & (F.col("year") == y), F.lit(k - len(left_out))).otherwise(F.lit(0)) for k, y in enumerate(left_out)), F.lit(len(left_out)))
    return models, B.with_probabilities_of(models, rows, chosen)


def fit_ladder(
    rows: DataFrame, features: Sequence[str], classes: Sequence[int], years: Sequence[int], thresholds: Sequence[float], keys: Sequence[str] = ("lead", "iy", "ix"), label: str = "label",
    least_expert_rows: int = 5_000, least_map_rows: int = 2_000, least_events: int = 20, **options,
) -> Ladder:
    """rows: features, keys, tp, obs, year, `label` (the analysed class) and split (train, val or test). Test rows are not read.

    Learned levels stop on the validation rows. Heads have as many training events as `least_events`, or
    give the training rate; they are calibrated on the validation rows by isotonic regression.
    """
    used = rows.where("split IN ('train', 'val') AND obs IS NOT NULL")
    train, valid = F.col("split") == "train", F.col("split") == "val"
    models, with_p = class_probabilities(used, features, label, classes, train, years, **options)
    with_p, _ = stored(with_p, "ladder-rows")
    aware = [*features, *(f"p_{c}" for c in classes)]
    counts = {int(r[label]): r["n"] for r in with_p.where(train & F.col(label).isin(list(classes))).groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    experts = [c for c in classes if counts.get(c, 0) >= least_expert_rows]
    generic = B.fit(with_p, no_leak(features), F.col("obs"), "tweedie", [B.Problem(train, valid)], **options)[0]
    regime, *own = B.fit(with_p, no_leak(aware), F.col("obs"), "tweedie", [B.Problem(train, valid), *(B.Problem(train & (F.col(label) == c), valid & (F.col(label) == c)) for c in experts)], **options)
    fitted = with_p.where(train)
    out = Ladder(
        list(features), list(classes), list(keys), ratio_table(fitted, keys), with_knots(quantile_table(fitted, keys, UNIFORM)),
        models[-1], generic, regime, dict(zip(experts, own)), {c: counts.get(c, 0) for c in classes},
    )
    checked = with_p.where(valid).withColumn("base", B.prediction(regime)).withColumn("regime", argmax(list(classes), [f"p_{c}" for c in classes])[0])
    maps = quantiles_of(checked, ["base", "obs"], TAIL, ["lead", "regime"], ["lead"]).where(F.col("_wide") | (F.col("regime").isNotNull() & (F.col("n") >= least_map_rows)))
    out.restore = with_knots(maps.select("lead", "regime", F.col("q_base").alias("qf"), F.col("q_obs").alias("qo"), "n"))
    for threshold in thresholds:
        out.heads[threshold] = fit_head(with_p, aware, threshold, train, valid, least_events, **options)
    return out


def fit_head(rows: DataFrame, features: Sequence[str], threshold: float, train: Column, valid: Column, least_events: int = 20, **options):
    """(boosted model, isotonic model) of P(rain > threshold), strictly, or the training rate where events are too few."""
    from pyspark.ml.regression import IsotonicRegression

    event = (F.col("obs") > threshold).cast("double")
    stats = rows.where(train).agg(F.sum(event).alias("events"), F.avg(event).alias("rate")).first()
    if (stats["events"] or 0) < least_events:
        return float(stats["rate"] or 0.0)
    model = B.fit(rows, no_leak(features), event, "logistic", [B.Problem(train, valid)], **options)[0]
    # Trees give few distinct scores, so equal ones meet before the regression, weighted by their number.
    scored = rows.where(valid).groupBy(B.prediction(model).alias("_s")).agg(F.avg(event).alias("_y"), F.count("*").cast("double").alias("_w"))
    return model, IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w").fit(scored)


def with_head(df: DataFrame, name: str, head) -> DataFrame:
    if isinstance(head, float):
        return df.withColumn(name, F.lit(head))
    model, calibrated = head
    out = calibrated.setPredictionCol("_calibrated").transform(df.withColumn("_s", B.prediction(model)))
    return out.withColumn(name, clip(F.col("_calibrated"))).drop("_s", "_calibrated")


def predict_table(ladder: Ladder, rows: DataFrame, k: float = 20_000.0, have_probabilities: bool = False) -> DataFrame:
    """rows with L0_raw to L6_regime_qm, p_gt_<threshold> (a point of which becomes _), p_<class>, regime_pred and regime_conf.

    One chain of joins with small tables and of expressions; rows may be of any length. A cell without a
    ratio or a map keeps its raw rain there. Equal class probabilities give the first class.
    """
    out = rows if have_probabilities else B.with_probabilities(ladder.classifier, rows)
    out = out.join(ladder.ratios, ladder.keys, "left").join(ladder.maps, ladder.keys, "left")
    out = quantile_mapped(out, "tp", "_l2").withColumns({"L0_raw": F.col("tp"), "L1_climbias": F.col("tp") * F.coalesce("ratio", F.lit(1.0)), "L2_qmap": F.coalesce("_l2", "tp")}).drop("_l2", "ratio", "knots", "top", "n")
    out = out.withColumns({"L3_gbm_generic": B.prediction(ladder.generic), "L4_gbm_regime": B.prediction(ladder.regime), **{f"_expert_{c}": B.prediction(m) for c, m in ladder.experts.items()}})
    parts = [(F.col(f"_expert_{c}") if c in ladder.experts else F.col("L4_gbm_regime"), F.col(f"p_{c}"), float(n) if c in ladder.experts else 0.0) for c, n in ladder.expert_rows.items()]
    name, most = argmax(ladder.classes, [f"p_{c}" for c in ladder.classes])
    out = out.withColumns({"L5_moe": F.greatest(gate_experts(F.col("L4_gbm_regime"), parts, k), F.lit(0.0)), "regime_pred": name, "regime_conf": most}).drop(*(f"_expert_{c}" for c in ladder.experts))
    mapped = fallback_lookup(out.withColumn("regime", F.col("regime_pred")), ladder.restore, ["lead", "regime"], ["lead"], ["knots", "top"])
    out = quantile_mapped(mapped, "L4_gbm_regime", "_l6").withColumn("L6_regime_qm", F.coalesce("_l6", "L4_gbm_regime")).drop("_l6", "knots", "top", "regime")
    for threshold, head in ladder.heads.items():
        out = with_head(out, f"p_gt_{threshold:g}".replace(".", "_"), head)
    return out


# ---------------------------------------------------------------- explanations
def drivers(ladder: Ladder, predicted: DataFrame, by: Sequence[str], themes: dict[str, Sequence[str]], top: int = 5) -> DataFrame:
    """The strongest themes of each row: Shapley values of the regime-aware level in log space, summed by theme."""
    place = {f: k for k, f in enumerate(ladder.regime.features)}
    each = predicted.select(*by, B.contributions(ladder.regime).alias("_c"))
    return top_drivers_of(each, by, {t: sum((F.col("_c")[place[f]] for f in fs), F.lit(0.0)) for t, fs in themes.items()}, top)


def typicality(queries: DataFrame, archive: DataFrame, reference: DataFrame | None, features: Sequence[str], regime: str, identifier: str, k: int = 20) -> DataFrame:
    """(query, distance, typicality): the mean distance to the k nearest archive rows of the same regime, against what is usual.

    Features are standardised by the archive. `reference` (rows chosen by the caller, or None for all rows
    of the archive) says what is usual in a regime: up to its median is typical, up to its 95th percentile
    unusual, beyond that, or without archive rows, rare. Equal rows are searched, and search, as one line.
    """
    stats = archive.agg(*(F.avg(f).alias(f"m{j}") for j, f in enumerate(features)), *(F.stddev(f).alias(f"s{j}") for j, f in enumerate(features))).first()
    vector = F.array(*((F.coalesce(F.col(f).cast("double"), F.lit(stats[f"m{j}"])) - stats[f"m{j}"]) / (stats[f"s{j}"] or 1.0) for j, f in enumerate(features))).alias("_v")
    sent = [df.select(F.col(regime).alias("_regime"), F.col(identifier).alias("_id"), vector) for df in (queries, archive, reference) if df is not None]
    line, row, there = ["_regime", "_v"], ["_regime", "_id", "_v"], "_regime IS NOT NULL AND _id IS NOT NULL"
    archived, _ = stored(sent[1].where("_regime IS NOT NULL").groupBy(*row).agg(F.count("*").alias("_n")), "archive")
    lines, _ = stored(archived.groupBy(*line).agg(F.sum("_n").alias("_n")), "lines")

    def with_own(each: DataFrame) -> DataFrame:
        """Rows with the distances of their own rows of the archive: those don't count, so as many are taken off."""
        met = each.alias("q").join(archived.alias("a"), (F.col("q._regime") == F.col("a._regime")) & (F.col("q._id") == F.col("a._id")), "left")
        own = F.when(F.col("a._n").isNotNull(), F.struct(F.sqrt(squared_distance(F.col("q._v"), F.col("a._v"))).alias("distance"), (-F.col("a._n")).alias("_n")))
        return met.groupBy("q._regime", "q._id", "q._v").agg(F.array_sort(F.collect_list(own)).alias("_own"))

    asked, _ = stored(with_own(sent[0].where(there).distinct()).withColumn("_rows", F.lit(None).cast("long")), "queries")
    kinds = with_own(archived.where(there).select(*row) if reference is None else sent[2].where(there).distinct()).groupBy(*line, "_own").agg(F.count("*").alias("_rows"))
    kinds, _ = stored(kinds.select("_regime", F.lit(None).cast(asked.schema["_id"].dataType).alias("_id"), "_v", "_own", "_rows"), "kinds")
    each = asked.unionByName(kinds)
    need = each.groupBy(*line).agg((k - F.min(F.aggregate("_own", F.lit(0).cast("long"), lambda s, x: s + x["_n"]))).alias("_need"))
    found = nearest_lists(need, lines, ["_regime"], "_v", "_need", "_n").groupBy(*line).agg(F.flatten(F.collect_list("_near")).alias("_near"))
    distance = _mean_of_first(F.array_sort(F.concat("_near", "_own")), k).alias("distance")
    means, _ = stored(each.join(found, line).select(*row, "_rows", distance), "near")
    usual = quantiles(means.where("_rows IS NOT NULL"), "distance", [0.5, 0.95], ["_regime"], "_rows")
    told = F.when(F.col("distance") <= F.col("q")[0], "typical").when(F.col("distance") <= F.col("q")[1], "unusual").otherwise("rare")
    out = sent[0].join(means.where("_rows IS NULL").select(*row, "distance"), row, "left").join(usual, "_regime", "left")
    return out.select(F.col("_id").alias("query"), "distance", told.alias("typicality"))


def _mean_of_first(sorted_counts: Column, k: int) -> Column:
    """The mean of the k least distances, or of all if fewer; null without any. Counts of equal distances, some below zero, are added up first."""
    state = lambda at, n, left, total: F.struct(at.alias("at"), n.alias("n"), left.alias("left"), total.alias("total"))
    taken = lambda s: F.least(F.greatest(s["n"], F.lit(0).cast("long")), s["left"])
    grown = lambda s: s["total"] + F.when(taken(s) > 0, s["at"] * taken(s)).otherwise(F.lit(0.0))

    def add(s: Column, x: Column) -> Column:
        same = s["at"] == x["distance"]
        return state(x["distance"], F.when(same, s["n"]).otherwise(F.lit(0).cast("long")) + x["_n"], F.when(same, s["left"]).otherwise(s["left"] - taken(s)), F.when(same, s["total"]).otherwise(grown(s)))

    def mean(s: Column) -> Column:
        n = F.lit(k).cast("long") - s["left"] + taken(s)
        return F.when(n > 0, grown(s) / n)

    return F.aggregate(sorted_counts, state(F.lit(-1.0), F.lit(0).cast("long"), F.lit(k).cast("long"), F.lit(0.0)), add, mean)


def explained_confidence(confidence: Column, typical: Column) -> Column:
    """HIGH, MEDIUM or LOW from the probability of the predicted regime and how typical the situation is."""
    return F.when((confidence >= 0.6) & (typical == "typical"), "HIGH").when((confidence < 0.4) | (typical == "rare"), "LOW").otherwise("MEDIUM")

