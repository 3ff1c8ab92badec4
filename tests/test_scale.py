"""Steps that used to gather a group, a file or a time in one task, against plain results on small tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from raincask.operators import models as M
from raincask.operators import regimes, scores
from raincask.sources import grids as G


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_groups_and_wider_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 2), None if i % 11 == 0 else int(i % 3), float(rng.integers(0, 9)), float(x)) for i, x in enumerate(rng.gamma(1.0, 9.0, 900))]
    df = spark.createDataFrame(rows, "lead int, regime int, a double, b double")
    got = scores.quantiles_of(df, ["a", "b"], [0.1, 0.99], ["lead", "regime"], ["lead"])
    assert "percentile(" not in plan(got)
    want = df.groupBy("lead", "regime").agg(F.count("*").alias("n"), *(F.percentile(c, F.array(F.lit(0.1), F.lit(0.99))).alias(c) for c in "ab")).collect() + df.groupBy("lead").agg(F.lit(None).alias("regime"), F.count("*").alias("n"), *(F.percentile(c, F.array(F.lit(0.1), F.lit(0.99))).alias(c) for c in "ab")).collect()
    key = lambda r: (r.lead, r.regime is None, r.regime or 0, r.n)
    got, want = sorted(got.collect(), key=key), sorted(want, key=key)
    assert len(got) == len(want) and sum(r._wide for r in got) == 2
    for g, w in zip(got, want):
        assert (g.lead, g.regime, g.n) == (w.lead, w.regime, w.n) and np.allclose(g.q_a, w.a) and np.allclose(g.q_b, w.b)


def test_drivers_of_rows_with_equal_keys(spark):
    rows = spark.createDataFrame([(1, 0.1, -0.5, 0.5), (1, 0.1, -0.5, 0.5), (2, 0.0, None, float("nan")), (None, 3.0, -4.0, 1.0)], "k int, a double, b double, c double")
    got = M.top_drivers_of(rows, ["k"], {c: F.col(c) for c in "abc"}, 4)
    assert "Generate inline" not in plan(got)  # rows move once, not once a driver
    each = rows.select("k", F.inline(F.array(*(F.struct(F.lit(c).alias("driver"), F.col(c).alias("value")) for c in "abc"))))
    told = lambda df: sorted(map(str, df.select("k", "rank", "driver", "contribution_log", "direction").collect()))
    assert told(got) == told(M.top_drivers(each, ["k"], 4))


def test_influence_moves_no_pairs(spark):
    cells = spark.createDataFrame([(i, 8.0 + i % 10, 70.0 + i // 10) for i in range(100)], "cell long, lat double, lon double")
    centres = spark.createDataFrame([(t, 8.0 + 3 * o, 70.0 + 2 * t + o, 1 + o % 2, o) for t in range(3) for o in range(3)], "t int, clat double, clon double, code int, ord int")
    out = regimes.influence(centres, cells, "t")
    assert "Aggregate" not in plan(out) and out.count() == 300
    at = {(r.t, r.cell): r for r in out.collect()}
    for (t, cell), r in at.items():
        lat, lon = 8.0 + cell % 10, 70.0 + cell // 10
        km = [(round(float(np.hypot((lat - 8 - 3 * o) * 111, (lon - 70 - 2 * t - o) * 111 * np.cos(np.radians(8 + 3 * o)))), 4), o) for o in range(3)]
        assert r.km == min(km)[0] and r.synoptic in (0, 1 + min(km)[1] % 2)


def netcdf_batches(days, ny, order):
    y = np.arange(ny, dtype=float)
    for t in order(range(days)):
        yield pa.RecordBatch.from_pydict({"file": ["m"] * ny, "record": pa.array([0] * ny, pa.int32()), "time": np.full(ny, float(t)), "time_units": ["days"] * ny, "y": y, "x": np.zeros(ny), "value": pa.array([None if k % 7 == 0 else t + k / 8 for k in range(ny)], pa.float64())})


def test_writers_hold_one_record(tmp_path):
    G.NetcdfWriter({"path": f"{tmp_path}/a", "variable": "v"}).write(netcdf_batches(2, 5, list))
    tracemalloc.start()
    G.NetcdfWriter({"path": f"{tmp_path}/b", "variable": "v"}).write(netcdf_batches(40, 5000, list))
    assert tracemalloc.get_traced_memory()[1] < 10e6  # 200,000 rows as Python objects take over 30 MB
    tracemalloc.stop()
    G.NetcdfWriter({"path": f"{tmp_path}/c", "variable": "v"}).write(netcdf_batches(40, 5000, reversed))
    assert (tmp_path / "b/m").read_bytes() == (tmp_path / "c/m").read_bytes()
    field = np.array([[[np.nan if k % 7 == 0 else t + k / 8] for k in range(5)] for t in range(2)])
    assert (tmp_path / "a/m").read_bytes() == G.classic_file("v", "days", np.arange(2.0), np.arange(5.0), np.zeros(1), field)


def test_raw_writer_takes_batches(tmp_path):
    rows = [("a", 2, 1, 0, 5.0), ("b", 0, 0, 1, 1.5), ("a", 0, 0, 0, None), ("a", 0, 1, 1, 2.5), ("b", 1, 0, 0, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["file", "record", "iy", "ix", "value"])
    G.RawWriter({"path": str(tmp_path), "ny": "2", "nx": "2"}).write(iter([batch]))
    want = np.full((3, 2, 2), -999.0, "<f4")
    want[2, 1, 0], want[0, 1, 1] = 5.0, 2.5
    assert (tmp_path / "a").read_bytes() == want.tobytes() and np.frombuffer((tmp_path / "b").read_bytes(), "<f4").tolist() == [-999.0, 1.5, *[-999.0] * 6]


def test_stability_of_many_groups_is_that_of_few(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(i % 3), "ab"[int(i % 2)], float(x)) for i, x in enumerate(rng.gamma(1.0, 9.0, 600).round(1))], "g int, side string, x double")
    told = lambda: sorted((r.g, round(r.psi, 9), r.bins) for r in scores.stability_index(df, "x", "side", "a", "b", ["g"]).collect())
    few = told()
    monkeypatch.setattr(scores, "BROADCAST_GROUPS", 0)
    assert told() == few and len(few) == 3
