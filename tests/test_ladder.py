"""The ladder as a whole: levels, mixture, heads, restoring, typicality and driver themes against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincask.operators import boosting as B
from raincask.operators import ladder as LD
from raincask.operators import regrid

FEATURES, CLASSES = ["tp", "x"], [0, 1, 2]


@pytest.fixture(scope="module")
def rows(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    n = 4000
    year = rng.integers(1995, 2001, n)
    x, label = rng.normal(size=n).round(3), rng.choice([0, 1], n, p=[0.8, 0.2])  # class 2 has no rows
    tp = rng.gamma(1.0, 12.0, n).round(2)
    obs = (tp * np.where(label == 1, 2.5, 0.7) * rng.gamma(4.0, 0.25, n)).round(3)
    df = pd.DataFrame({"id": np.arange(n), "year": year, "lead": 1 + 2 * (np.arange(n) % 2), "iy": rng.integers(0, 3, n), "ix": rng.integers(0, 3, n), "tp": tp, "x": x + 2 * label, "label": label, "obs": obs})
    df["split"] = np.select([year <= 1998, year == 1999], ["train", "val"], "test")
    return spark.createDataFrame(df).repartition(3).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return LD.fit_ladder(rows, FEATURES, CLASSES, [1995, 1996, 1997, 1998], [15.6, 1e6], least_expert_rows=300, least_map_rows=200, rounds=12, depth=3, rate=0.3)


def test_levels_agree_with_their_definitions(rows, fitted):
    test = rows.where("split = 'test'")
    p = LD.predict_table(fitted, test).toPandas()
    assert len(p) == test.count() and set(fitted.experts) == {0, 1} and fitted.expert_rows[2] == 0
    n0, n1 = fitted.expert_rows[0], fitted.expert_rows[1]
    with_p = B.with_probabilities(fitted.classifier, test)
    experts = with_p.select("id", *(B.prediction(fitted.experts[c]).alias(f"e{c}") for c in (0, 1)), B.prediction(fitted.regime).alias("g")).toPandas().set_index("id").loc[p.id]
    g = experts.g.to_numpy()
    blend = sum(p[f"p_{c}"] * (w * e + (1 - w) * g) for c, w, e in ((0, n0 / (n0 + 20000), experts.e0.to_numpy()), (1, n1 / (n1 + 20000), experts.e1.to_numpy()))) + p.p_2 * g
    assert np.allclose(p.L5_moe, blend) and np.allclose(p.L4_gbm_regime, g)
    assert (p.p_2 == 0).all() and np.allclose(p.p_0 + p.p_1, 1) and np.allclose(p.regime_conf, p[["p_0", "p_1", "p_2"]].max(axis=1))
    assert (p.regime_pred == p[["p_0", "p_1", "p_2"]].to_numpy().argmax(axis=1)).all() and (p.regime_pred == p.label).mean() > 0.85
    # By the loss that the levels are fitted to; squared errors here are those of one heavy fall.
    deviance = lambda c: B.mean_loss("tweedie", p.obs.to_numpy(), np.log(np.maximum(p[c].to_numpy(), 1e-6))[:, None]).mean()
    assert deviance("L4_gbm_regime") < 0.9 * deviance("L0_raw") and deviance("L3_gbm_generic") < 0.9 * deviance("L0_raw") and (p.filter(like="L") >= 0).all().all()
    assert p.p_gt_15_6.between(0, 1).all() and p[p.obs > 15.6].p_gt_15_6.mean() > p[p.obs <= 15.6].p_gt_15_6.mean() + 0.2
    assert (p["p_gt_1e+06"] == 0).all()  # no events: the training rate


def test_training_rows_have_probabilities_of_other_years(rows):
    train = F.col("split") == "train"
    models, out = LD.class_probabilities(rows, FEATURES, "label", CLASSES, train, [1995, 1996], rounds=3, depth=2)
    assert out.count() == rows.count() and len(models) == 3
    own = B.with_probabilities(models[0], rows.where("year = 1995")).select("id", F.col("p_1").alias("q")).join(out.select("id", "p_1"), "id")
    assert own.where("abs(q - p_1) > 1e-12").count() == 0
    left_out = B.fit(rows, FEATURES, F.col("label"), "softmax", [B.Problem(train & (F.col("year") != 1995)), B.Problem(train)], classes=CLASSES, rounds=3, depth=2)[0]
    assert left_out.trees == models[0].trees


def test_typicality_and_confidence(spark, rows):
    archive = rows.where("split = 'train'").withColumn("r", F.col("label"))
    queries, reference = rows.where("split = 'test' AND id % 10 = 0").withColumn("r", F.col("label")), archive.where("id % 7 = 0")
    got = {r.query: r for r in LD.typicality(queries, archive, reference, FEATURES, "r", "id", 5).collect()}
    a, q, ref = (df.toPandas() for df in (archive, queries, reference))
    mean, std = a[FEATURES].mean(), a[FEATURES].std()
    z = lambda df: ((df[FEATURES] - mean) / std).to_numpy()
    near = lambda row, v, own: np.sort(np.sqrt(((z(a[(a.label == row.label) & (a.id != own)]) - v) ** 2).sum(axis=1)))[:5].mean()
    for regime in (0, 1):
        usual = [near(r, v, r.id) for r, v in zip(ref.itertuples(), z(ref)) if r.label == regime]
        d50, d95 = np.quantile(usual, [0.5, 0.95])
        for r, v in zip(q.itertuples(), z(q)):
            if r.label == regime:
                d = near(r, v, r.id)
                assert got[r.id].distance == pytest.approx(d, abs=1e-9)
                assert got[r.id].typicality == ("typical" if d <= d50 else "unusual" if d <= d95 else "rare")
    levels = spark.createDataFrame([(0.7, "typical"), (0.7, "rare"), (0.7, "unusual"), (0.3, "typical"), (0.5, "typical")], "c double, t string")
    assert [r[0] for r in levels.select(LD.explained_confidence(F.col("c"), F.col("t"))).collect()] == ["HIGH", "LOW", "MEDIUM", "LOW", "MEDIUM"]


def test_driver_themes_add_up(rows, fitted):
    themes = {"rain": ["tp"], "place": ["x"], "regime": [f"p_{c}" for c in CLASSES]}
    p = B.with_probabilities(fitted.classifier, rows.where("split = 'test'"))
    got = LD.drivers(fitted, p, ["id"], themes, 3).toPandas()
    margins = p.select("id", B.margin(fitted.regime).alias("m")).toPandas().set_index("id").m
    total = got.groupby("id").contribution_log.sum()
    assert np.allclose(total + B.base_value(fitted.regime), margins.loc[total.index], atol=2e-3)  # three shares of three places
    assert (got.sort_values(["id", "rank"]).groupby("id").contribution_log.apply(lambda s: (s.abs().diff().dropna() <= 1e-9).all())).all()


def test_bridge_meets_only_near_cells(spark):
    districts = [(f"d{k}", [(70.0 + 3 * k, 8.0), (72.4 + 3 * k, 8.3), (72.0 + 3 * k, 11.0), (70.2 + 3 * k, 10.0)]) for k in range(8)]
    cells = [(i, j, 6.0 + 0.5 * i, 68.0 + 0.5 * j) for i in range(20) for j in range(60)]
    df = spark.createDataFrame(cells, "iy int, ix int, lat double, lon double")
    outlines = spark.createDataFrame(districts, "district string, points array<struct<x: double, y: double>>")
    met = regrid.near_outlines(df, outlines, 0.5)
    assert met.count() < len(districts) * len(cells) / 15
    got = {(r.district, r.iy, r.ix): r.w for r in regrid.bridge(df, districts, 0.5).collect()}
    want = {(d, i, j): w for d, i, j, w, _ in regrid.bridge_rows(districts, cells, 0.5)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
