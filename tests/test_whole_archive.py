"""Ladder and typicality take all years and all rows that they are given."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincask.operators import boosting as B
from raincask.operators import ladder as LD
from raincask.operators.scores import quantiles
from raincask.plans import q_models as Q

SMALL = "/root/testdata/sf0.001"


def test_ladder_trains_on_all_training_years(spark, monkeypatch):
    got = []
    monkeypatch.setattr(Q.LD, "fit_ladder", lambda rows, features, classes, years, *rest, **more: got.append((rows, years)))
    Q.whole_ladder(spark, SMALL)
    rows, years = got[0]
    all_rows = Q.features(spark, SMALL).where("split <> 'test'")
    assert years == sorted(r.year for r in all_rows.where("split = 'train'").select("year").distinct().collect())
    counts = lambda df: {(r.split, r.year): r["count"] for r in df.groupBy("split", "year").count().collect()}
    assert counts(rows) == counts(all_rows) and min(years) < 1996


def test_all_rows_of_the_archive_say_what_is_usual(spark, tmp_path, monkeypatch):
    """Distances and typicality of m13 by hand, on a table with many rows of the day, three of them twice."""
    lineitem = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lineitem = lineitem.withColumn("l_shipdate", F.when(F.year("l_shipdate") >= 2000, F.lit("2000-07-01").cast("timestamp")).otherwise(F.col("l_shipdate")).cast(lineitem.schema["l_shipdate"].dataType))
    twice = lineitem.where("year(l_shipdate) = 2000").orderBy("l_orderkey", "l_linenumber").limit(3)
    lineitem.unionByName(twice).write.parquet(str(tmp_path / "lineitem.parquet"))
    sent, plain = {}, LD.typicality

    def noted(queries, archive, *rest, **more):
        sent["archive"] = archive.select("id", "regime_pred", *rest[1]).toPandas()
        sent["queries"] = queries.select("id", "regime_pred", *rest[1]).toPandas()
        return plain(queries, archive, *rest, **more)

    monkeypatch.setattr(Q.LD, "typicality", noted)
    monkeypatch.setattr(Q, "BOOSTING", {"rounds": 2, "depth": 2, "rate": 0.5})
    out = Q.m13_explanations(spark, str(tmp_path)).toPandas()
    a, q = sent["archive"], sent["queries"]
    assert len(a) == Q.features(spark, str(tmp_path)).where("split = 'train'").count() and len(q) == len(out) == len(set(q.id)) + 3
    names = ["tp_log", "iy", "ix", "season_sin"]
    z = lambda df: ((df[names] - a[names].mean()) / a[names].std()).to_numpy()

    def near(rows, own):
        d = np.sqrt(((z(rows)[:, None, :] - z(own)[None, :, :]) ** 2).sum(axis=2))
        d[rows.id.to_numpy()[:, None] == own.id.to_numpy()[None, :]] = np.inf
        return np.sort(d, axis=1)[:, :20].mean(axis=1)

    told = {r.id: r for r in out.itertuples()}
    for regime, own in a.groupby("regime_pred"):
        asked = q[q.regime_pred == regime]
        if not len(asked):
            continue
        d50, d95 = np.quantile(near(own, own), [0.5, 0.95])
        for i, d in zip(asked.id, near(asked, own)):
            assert told[i].distance == pytest.approx(d, abs=1e-5)
            if min(abs(d - d50), abs(d - d95)) > 1e-9:
                assert told[i].typicality == ("typical" if d <= d50 else "unusual" if d <= d95 else "rare")
    assert {r.typicality for r in told.values()} == {"typical", "unusual", "rare"}


def test_rows_of_equal_ids_are_taken_off(spark):
    """An id of several archive rows at different and at equal places; fewer rows than k; a regime of one row."""
    rows = [("a", 0, 1.0, 0.0), ("a", 0, 1.0, 0.0), ("a", 0, 3.0, 0.0), ("b", 0, 1.0, 0.0), ("c", 0, 5.0, 1.0), ("d", 0, -1.0, 0.0), ("e", 1, 1.0, 1.0)]
    archive = spark.createDataFrame(rows, "id string, r int, x double, y double")
    queries = spark.createDataFrame([("a", 0, 1.0, 0.0), ("z", 0, 1.0, 0.0), ("e", 1, 1.0, 1.0), ("n", None, 1.0, 1.0)], "id string, r int, x double, y double")
    v = np.array([r[2:] for r in rows])
    z = (v - v.mean(axis=0)) / v.std(axis=0, ddof=1)
    got = {r.query: r for r in LD.typicality(queries, archive, None, ["x", "y"], "r", "id", 4).collect()}
    d = np.sqrt(((z[:6] - z[0]) ** 2).sum(axis=1))
    assert got["a"].distance == pytest.approx(d[3:].mean()) and got["z"].distance == pytest.approx(np.sort(d)[:4].mean())
    assert got["e"].distance is None and got["n"].distance is None and got["e"].typicality == got["n"].typicality == "rare"


def test_more_years_than_a_fit_takes(spark, monkeypatch):
    rows = spark.range(600).select(F.col("id"), (1990 + F.col("id") % 4).alias("year"), (F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") * 7 % 31 > 15).cast("int").alias("label")).coalesce(1).cache()
    fitted = lambda: LD.class_probabilities(rows, ["x"], "label", [0, 1], F.lit(True), [1990, 1991, 1992, 1993], rounds=2, depth=2)
    models, out = fitted()
    want = {r.id: r.p_1 for r in out.collect()}
    monkeypatch.setattr(B, "PROBLEMS", 2)
    parts, again = fitted()
    cuts = lambda fits: [[(t.feature, t.threshold, t.cover) for trees in m.trees for t in trees] for m in fits]
    assert len(parts) == 5 and cuts(parts) == cuts(models)
    assert {r.id: r.p_1 for r in again.collect()} == pytest.approx(want, abs=1e-4)  # gradients are rounded by the line, and lines by what a fit tells apart


def test_weighted_quantiles(spark):
    rows = [(g, float(x), n) for g in (0, 1) for x, n in ((1.0, 3), (2.5, 1), (4.0, 2 + g))]
    got = {r.g: r.q for r in quantiles(spark.createDataFrame(rows, "g int, v double, n long"), "v", [0.5, 0.95], ["g"], "n").collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(list(np.quantile(np.repeat([x for h, x, _ in rows if h == g], [n for h, _, n in rows if h == g]), [0.5, 0.95])))
