"""Order statistics and distinct days against plain ones; an entry that imports without a session."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincask.operators import evidence as E
from raincask.operators import scores as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def rows():
    rand = random.Random(5)  # one group has most rows
    return [(rand.choice(["a", "a", "a", "a", "b", None]), rand.choice([None, *[round(rand.gauss(0, 40), 1)] * 20]), rand.random() < 0.3) for _ in range(4000)]


def test_running_counts_ranks_and_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, e boolean").repartition(5)
    for key in ("a", "b", None):
        own = np.array([v for g, v, _ in rows if g == key and v is not None])
        q = {r.g: r.q for r in S.quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1], ["g"]).collect()}
        assert q[key] == pytest.approx(np.quantile(own, [0, 0.1, 0.5, 0.99, 1]).tolist(), abs=1e-9)
    every = np.array([v for _, v, _ in rows if v is not None])
    assert S.quantiles(df, "v", [0.25, 0.75]).first().q == pytest.approx(np.quantile(every, [0.25, 0.75]).tolist(), abs=1e-9)
    assert S.quantiles(df.where("v > 1e9"), "v", [0.5]).first().q == [None]
    some = df.where("g = 'a' AND v IS NOT NULL")
    ranks = {(r.v): r["rank"] for r in S.average_rank(some, "v", ["g"]).collect()}
    own = np.array([v for g, v, _ in rows if g == "a" and v is not None])
    assert all(r == (own < v).sum() + ((own == v).sum() + 1) / 2 for v, r in ranks.items())
    event = np.array([e for g, v, e in rows if g == "a" and v is not None])
    wins = np.mean([np.where(x > own[~event], 1, np.where(x == own[~event], 0.5, 0)).mean() for x in own[event]])
    assert S.rank_auc(some, "v", "e", ["g"]).first().auc == pytest.approx(wins, abs=1e-12)


def test_no_window_over_a_whole_group(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, e boolean")
    for out in (S.quantiles(df, "v", [0.5]), S.rank_auc(df, "v", "e", ["g"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line and "sum(_t_" not in line]
        assert windows and all("_range" in w for w in windows)


def test_distinct_days(spark):
    rows = [(k % 3, f"{y}-{m:02d}-{d:02d}", float(d)) for k, (y, m, d) in enumerate((y, m, d) for y in (1811, 1899, 1900, 1989, 2024, 2078) for m in (1, 6) for d in (1, 1, 2, 28))]
    df = spark.createDataFrame([*rows, (0, None, 1.0)], "g int, day string, v double").withColumn("day", F.col("day").cast("date"))
    got = {r.g: (r.n, r.some) for r in df.groupBy("g").agg(E.distinct_days("day").alias("n"), E.distinct_days("day", F.col("v") > 5).alias("some")).collect()}
    want = {g: (len({d for k, d, _ in rows if k == g}), len({d for k, d, v in rows if k == g and v > 5})) for g in range(3)}
    assert got == want
    with pytest.raises(Exception, match="outside 1810"):
        spark.sql("SELECT DATE'1700-01-01' AS day").agg(E.distinct_days("day")).collect()
    counts = {(r.g, r.threshold): (r.events, r.months) for r in E.threshold_counts(df, "v", "day", (2, 99), ["g"]).collect()}
    assert counts == {(g, t): (sum(k == g and v >= t for k, d, v in rows), len({d[5:7] for k, d, v in rows if k == g and v >= t})) for g in range(3) for t in (2.0, 99.0)}


def test_the_entry_imports_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql()"], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr
