"""The histogram trees: first tree by brute force, losses that fall, early stopping, classes, and attributions by all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincask.operators import boosting as B

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 3000
    a, b, c = rng.integers(0, 30, n).astype(float), rng.normal(size=n).round(2), rng.integers(0, 5, n).astype(float)
    mean = np.exp(0.08 * a + (b > 0.3) - 0.5 * (c == 2))
    rain = np.where(rng.random(n) < 0.35, 0.0, rng.gamma(0.8, mean))
    kind = np.where(a > 20, 0, np.where(b > 0, 1, 2))
    part = np.where(np.arange(n) % 5 == 0, "val", np.where(np.arange(n) % 5 == 1, "test", "train"))
    return [(int(i), *(None if (i + k) % 97 == 0 else float(v[i]) for k, v in enumerate((a, b, c))), float(rain[i]), int(kind[i]), str(part[i])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id int, a double, b double, c double, rain double, kind int, part string").repartition(4).cache()


def arrays(rows, part):
    some = [r for r in rows if r[6] == part]
    return np.array([[np.nan if v is None else v for v in r[1:4]] for r in some]), np.array([r[4] for r in some]), np.array([r[5] for r in some])


def split_by_hand(x, g, h, edges, least, l2):
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for t in [-math.inf, *edges[f]]:
            left = np.isnan(x[:, f]) | (x[:, f] <= t)
            if least <= left.sum() <= len(x) - least:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + l2)
                if gain > best[0]:
                    best = (gain, (f, t))
    return best[1]


def test_first_tree_is_the_one_by_hand(table, rows):
    model = B.fit(table, FEATURES, F.col("rain"), "tweedie", [B.Problem(F.col("part") == "train")], rounds=1, depth=3, least_rows=20)[0]
    x, y, _ = arrays(rows, "train")
    g, h = (np.round(v[:, 0] * 65536) / 65536 for v in B.gradients("tweedie", y, np.full((len(y), 1), math.log(y.mean()))))
    tree = model.trees[0][0]
    assert model.start[0] == pytest.approx(math.log(y.mean()), abs=1e-12)

    def compare(node, mask, level):
        found = split_by_hand(x[mask], g[mask], h[mask], model.edges, 20, 1.0) if level < 3 else None
        if found is None:
            assert tree.feature[node] == -1 and tree.value[node] == pytest.approx(-0.1 * g[mask].sum() / (h[mask].sum() + 1.0), abs=1e-12)
            return
        assert (tree.feature[node], tree.threshold[node]) == found and tree.cover[node] == mask.sum()
        left = np.isnan(x[:, found[0]]) | (x[:, found[0]] <= found[1])
        compare(tree.left[node], mask & left, level + 1)
        compare(tree.right[node], mask & ~left, level + 1)

    compare(0, np.ones(len(y), bool), 0)


def test_losses_fall_and_a_model_stops(spark, table, rows):
    train, valid = F.col("part") == "train", F.col("part") == "val"
    tweedie, squared, repeat = (
        B.fit(table.repartition(n), FEATURES, target, loss, [B.Problem(train, valid)], rounds=25, depth=3, rate=0.2, patience=5)[0]
        for loss, target, n in (("tweedie", F.col("rain"), 4), ("squared", F.log1p("rain"), 4), ("tweedie", F.col("rain"), 3))
    )
    told = [t for t, _ in tweedie.history]
    assert all(b < a for a, b in zip(told, told[1:]))
    assert tweedie.trees == repeat.trees  # sums do not depend on the order of rows or partitions
    valid_losses = [v for _, v in tweedie.history]
    assert len(tweedie.trees) == int(np.argmin(valid_losses)) and len(valid_losses) - 1 - int(np.argmin(valid_losses)) <= 5
    test = table.where("part = 'test'").select("rain", B.prediction(tweedie).alias("t"), F.greatest(F.expm1(B.prediction(squared)), F.lit(1e-6)).alias("s")).toPandas()
    deviance = lambda p: B.mean_loss("tweedie", test.rain.to_numpy(), np.log(p.to_numpy())[:, None]).mean()
    assert deviance(test.t) < deviance(test.s)  # log rain pulls the mean down
    whole = B.mean_loss("tweedie", *(lambda x, y, _: (y, np.full((len(y), 1), tweedie.start[0])))(*arrays(rows, "train"))).mean()
    assert told[0] == pytest.approx(whole, rel=1e-9)


def test_classes_and_problems_side_by_side(table, rows):
    train = F.col("part") == "train"
    both = B.fit(table, FEATURES, F.col("kind"), "softmax", [B.Problem(train), B.Problem(train & (F.col("kind") != 1))], rounds=6, depth=3, rate=0.3, classes=[0, 1, 2])
    alone = B.fit(table, FEATURES, F.col("kind"), "softmax", [B.Problem(train & (F.col("kind") != 1))], rounds=6, depth=3, rate=0.3, classes=[0, 1, 2])[0]
    out = B.with_probabilities(both[0], table.where("part = 'test'")).toPandas()
    p = out[["p_0", "p_1", "p_2"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == out.kind).mean() > 0.97
    log_loss = -np.log(p[np.arange(len(p)), out.kind]).mean()
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = table.fillna(-999.0)
    forest = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), RandomForestClassifier(featuresCol="x", labelCol="kind", numTrees=20, maxDepth=3, seed=1)]).fit(known.where(train))
    got = [(r.probability[r.kind]) for r in forest.transform(known.where("part = 'test'")).select("probability", "kind").collect()]
    assert log_loss <= -np.log(np.maximum(got, 1e-15)).mean()
    absent = B.with_probabilities(both[1], table.where("part = 'test'")).toPandas()
    assert (absent.p_1 == 0).all() and np.allclose(absent.p_0 + absent.p_2, 1) and both[1].trees[0][0].threshold[0] == alone.trees[0][0].threshold[0]


def test_logistic_and_empty_problems(table):
    event, train = (F.col("rain") > 5).cast("double"), F.col("part") == "train"
    models = B.fit(table, FEATURES, event, "logistic", [B.Problem(train), B.Problem(F.lit(False))], rounds=4, depth=2, rate=0.3)
    out = table.select(B.prediction(models[0]).alias("p"), B.prediction(models[1]).alias("q"), event.alias("e")).toPandas()
    assert out.p.between(0, 1).all() and out[out.e == 1].p.mean() > out[out.e == 0].p.mean() + 0.05 and (out.q == 0.5).all()
    assert sum(s for _, s in B.importance(models[0])) == pytest.approx(1, abs=2e-4)


def expectation(tree, x, known, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    f, (left, right) = tree.feature[node], (tree.left[node], tree.right[node])
    if f in known:
        return expectation(tree, x, known, left if math.isnan(x[f]) or x[f] <= tree.threshold[node] else right)
    return sum(tree.cover[c] / tree.cover[node] * expectation(tree, x, known, c) for c in (left, right))


def test_contributions_add_up_and_match_all_subsets(table, rows):
    model = B.fit(table, FEATURES, F.col("rain"), "tweedie", [B.Problem(F.col("part") == "train")], rounds=3, depth=3)[0]
    out = table.select("id", B.margin(model).alias("m"), B.contributions(model).alias("c")).collect()
    base = B.base_value(model)
    assert max(abs(base + sum(r.c) - r.m) for r in out) < 1e-9
    value = lambda x, known: sum(expectation(t[0], x, known) for t in model.trees)
    told = {r.id: r.c for r in out}
    for i, a, b, c, *_ in rows[:60]:
        x = [math.nan if v is None else v for v in (a, b, c)]
        for f in range(3):
            others = [k for k in range(3) if k != f]
            want = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (value(x, {*s, f}) - value(x, set(s))) for n in range(3) for s in itertools.combinations(others, n))
            assert told[i][f] == pytest.approx(want, abs=1e-9)


def test_equal_rows_are_added_up_and_all_count(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n = 6000
    a, b = rng.integers(0, 6, n), rng.integers(0, 5, n)
    rain = np.where(rng.random(n) < 0.3, 0.0, np.round(rng.gamma(1.0, 4.0 + 3 * a) * 16) / 16)
    rows = [(float(a[i]), None if b[i] == 4 else float(b[i]), float(rain[i]), int(rain[i] > 6) + int(a[i] > 3), ("train", "train", "val", "test")[i % 4]) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, rain double, kind int, part string").repartition(3).cache()
    train, valid, lines = F.col("part") == "train", F.col("part") == "val", []
    histograms = B._histograms
    monkeypatch.setattr(B, "_histograms", lambda table, *rest: (lines or lines.append(table.agg(F.count("*"), F.sum("n")).first()), histograms(table, *rest))[1])
    for loss, target, classes in (("tweedie", F.col("rain"), (0,)), ("softmax", F.col("kind"), (0, 1, 2))):
        fits = []
        for fold in (3, 1e9):
            monkeypatch.setattr(B, "FOLD", fold)
            lines.clear()
            fits.append(B.fit(df, ["a", "b"], target, loss, [B.Problem(train, valid), B.Problem(train & (F.col("a") > 1), valid)], rounds=1, depth=2, classes=classes))
            assert lines[0][1] == 4500 and (lines[0][0] <= 6 * 5 * 3 if fold == 3 else lines[0][0] == 4500)
        for folded, plain in zip(*fits):
            assert folded.edges == plain.edges and folded.start == pytest.approx(plain.start) and np.allclose(folded.history, plain.history, rtol=1e-4)
            for ours, theirs in zip(folded.trees, plain.trees):
                for s, t in zip(ours, theirs):
                    assert (s.feature, s.bin, s.left, s.cover) == (t.feature, t.bin, t.left, t.cover) and np.allclose(s.value, t.value, atol=1e-5)


def test_sums_of_lines_are_those_of_their_rows():
    rng = np.random.default_rng(12)
    for loss, outputs in (("squared", 1), ("tweedie", 1), ("logistic", 1), ("softmax", 3)):
        y = rng.gamma(1.0, 9.0, 50) if loss in ("squared", "tweedie") else rng.integers(0, max(2, outputs), 50).astype(float)
        margin = np.repeat(rng.normal(size=(1, outputs)), 50, axis=0)
        parts = (y[:, None] == np.arange(outputs)).astype(float) if loss == "softmax" else y[:, None]
        constant = y * y if loss == "squared" else y**0.7 if loss == "tweedie" else 0 * y
        line = np.array([50.0]), parts.sum(axis=0, keepdims=True), np.array([constant.sum()]), margin[:1]
        assert np.allclose(B._line_losses(loss, *line, 1.3), B.mean_loss(loss, y, margin).sum())
        for ours, rows in zip(B._line_gradients(loss, line[0], line[1], line[3], 1.3), B.gradients(loss, y, margin)):
            assert np.allclose(ours[0], rows.sum(axis=0))
