"""Known answers, invariants and gates of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from raincask.functions import rain, space, windows
from raincask.operators import focal, lookup, models, pairing, regimes, regrid, scores
from raincask.sources import daily, mapping, sinks


def one(df):
    return df.collect()[0].asDict()


def test_contingency_counts_and_ets(spark):
    df = spark.createDataFrame([(70.0, 70.0), (70.0, 70.0), (70.0, 0.0), (0.0, 70.0), (0.0, 0.0), (0.0, 0.0)], "fc double, obs double")
    r = one(scores.contingency(df, "fc", "obs", [64.5]))
    assert (r["hits"], r["false_alarms"], r["misses"], r["correct_negatives"]) == (2, 1, 1, 2)
    assert r["ets"] == pytest.approx(0.2)


def test_undefined_scores_are_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 3.0)], "fc double, obs double")
    r = one(scores.contingency(df, "fc", "obs", [64.5]))
    assert r["pod"] is None and r["csi"] is None and r["far"] is None
    c = one(scores.continuous(df, "fc", "obs"))
    assert c["n"] == 2 and c["r"] is None


def test_average_rank_and_auc(spark):
    df = spark.createDataFrame([("a", v, e) for v, e in ((1.0, False), (2.0, True), (2.0, False), (3.0, True))], "k string, v double, e boolean")
    assert sorted(r["rank"] for r in scores.average_rank(df, "v", ["k"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert one(scores.rank_auc(df, "v", "e", ["k"]))["auc"] == pytest.approx(0.875)


def dense(spark, ny, nx, value):
    return spark.range(ny * nx).select(F.lit(0).alias("t"), F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"), value.alias("v"))


def test_fss_of_shifted_cell(spark):
    base = dense(spark, 20, 20, F.lit(0.0)).drop("v").withColumn("valid", F.lit(True))
    hit = lambda x: F.when((F.col("iy") == 10) & (F.col("ix") == x), 100.0).otherwise(0.0)
    same, off = base.withColumn("f", hit(8)).withColumn("o", hit(8)), base.withColumn("f", hit(8)).withColumn("o", hit(10))
    assert one(focal.fss(same, "f", "o", 64.5, 1, ["t"], "valid"))["fss"] == pytest.approx(1)
    assert one(focal.fss(off, "f", "o", 64.5, 1, ["t"], "valid"))["fss"] == pytest.approx(0)
    assert one(focal.fss(off, "f", "o", 64.5, 9, ["t"], "valid"))["fss"] > 0.5


def test_focal_against_numpy(spark):
    np = pytest.importorskip("numpy")
    df = dense(spark, 7, 9, (F.col("id") * 37 % 101).cast("double"))
    a = np.array([(i * 37 % 101) for i in range(63)], float).reshape(7, 9)
    padded = np.pad(a, 2, mode="edge")
    mean = {(r.iy, r.ix): r.m for r in focal.focal_mean(df, "v", 5, ["t"], "m", 7, 9).collect()}
    most = {(r.iy, r.ix): r.m for r in focal.focal_extreme(df, "v", 5, ["t"], "m", True).collect()}
    for y in range(7):
        for x in range(9):
            box = padded[y : y + 5, x : x + 5]
            assert mean[y, x] == pytest.approx(box.mean()) and most[y, x] == box.max()


def test_dense_gate(spark):
    df = dense(spark, 3, 3, F.lit(1.0))
    focal.assert_dense(df, ["t"], 9)
    with pytest.raises(pairing.GateError):
        focal.assert_dense(df.where("ix <> 1 OR iy <> 1"), ["t"], 9)
    with pytest.raises(pairing.GateError):
        focal.ring_minimum(df, "v", 1, ["t"], "r")


def test_regrid_keeps_constants_and_integral(spark):
    import math

    sy, sx = [0.5 + i for i in range(6)], [0.5 + i for i in range(6)]
    ty, tx = [1.0 + 2 * i for i in range(3)], [1.5 + 3 * i for i in range(2)]
    wy, wx = regrid.overlap_weights(sy, ty, 1.0, 2.0, True), regrid.overlap_weights(sx, tx, 1.0, 3.0, False)
    field = dense(spark, 6, 6, (F.col("id") * 7 % 11).cast("double"))
    args = regrid.weight_table(spark, wy, "y"), regrid.weight_table(spark, wx, "x"), ["t"]
    assert all(r.v == pytest.approx(3.0) for r in regrid.conservative(field.withColumn("v", F.lit(3.0)), "v", *args).collect())
    area = lambda lat, step: math.sin(math.radians(lat + step / 2)) - math.sin(math.radians(lat - step / 2))
    fine = sum(r.v * area(sy[r.iy], 1.0) for r in field.collect())
    coarse = sum(r.v * area(ty[r.iy], 2.0) * 3 for r in regrid.conservative(field, "v", *args).collect())
    assert coarse == pytest.approx(fine, rel=1e-9)
    holes = field.withColumn("v", F.when((F.col("iy") > 1) | (F.col("ix") > 0), F.col("v")))
    assert [r for r in regrid.conservative(holes, "v", *args).collect() if r.v is None]


def test_districts_use_valid_cells_only():
    rows = regrid.bridge_rows([("far", [(50.0, 50.0), (51.0, 50.0), (50.0, 51.0)]), ("near", [(0.0, 0.0), (1.5, 0.0), (1.5, 1.0), (0.0, 1.0)])], [(0, 0, 0.5, 0.5), (0, 1, 0.5, 1.5)], 1.0)
    assert [r for r in rows if r[0] == "far"] == [("far", 0, 1, 1.0, True)]
    near = {r[2]: r[3] for r in rows if r[0] == "near"}
    assert near[0] == pytest.approx(2 / 3) and near[1] == pytest.approx(1 / 3)


def test_run_filter(spark):
    state = [1, 1, 0, 1, 1, 1, -1, -1, -1, 0, 1]
    day = [dt.date(2020, 7, 1) + dt.timedelta(days=i) for i in range(11)]
    out = regimes.run_filter(spark.createDataFrame(list(zip(["k"] * 11, day, state)), "k string, d date, s int"), "s", "d", ["k"])
    assert [r.kept for r in out.orderBy("d").collect()] == [0, 0, 0, 1, 1, 1, -1, -1, -1, 0, 0]
    gap = day[:5] + [d + dt.timedelta(days=1) for d in day[5:]]
    out = regimes.run_filter(spark.createDataFrame(list(zip(["k"] * 11, gap, state)), "k string, d date, s int"), "s", "d", ["k"])
    assert [r.kept for r in out.orderBy("d").collect()][3:6] == [0, 0, 0]


def test_tracker_makes_two_systems(spark):
    t = lambda h: dt.datetime(2020, 7, 1, h)
    rows = [(2020, t(0), 18.0, 88.0, 1, 1), (2020, t(6), 18.5, 87.0, 2, 2), (2020, t(6), 24.0, 76.0, 1, 3)]
    out = spark.createDataFrame(rows, "season int, time timestamp_ntz, lat double, lon double, code int, event_id long").groupBy("season").applyInPandas(regimes.track(), "season int, time timestamp_ntz, lat double, lon double, code int, event_id long, system_id long")
    of = {r.event_id: r.system_id for r in out.collect()}
    assert of[1] == of[2] != of[3]
    events = regimes.event_summary(out, ["season"]).orderBy("system_id").collect()
    assert [(e.primary_code, e.snapshots) for e in events] == [(2, 2), (1, 1)]


def test_windows_and_labels(spark):
    df = spark.createDataFrame([(dt.date(2024, 7, 16),)], "d date")
    for convention, expected in (("ending", dt.datetime(2024, 7, 15, 3)), ("starting", dt.datetime(2024, 7, 16, 3))):
        start, end = windows.observation_window(F.col("d"), convention)
        w = df.select(start.alias("valid_start"), end.alias("valid_end"))
        assert one(w)["valid_start"] == expected
        assert one(pairing.inverse_labels(w, convention))["label"] == dt.date(2024, 7, 16)
    with pytest.raises(windows.ConventionError):
        windows.observation_window(F.col("d"), "unverified")


def test_gates_stop_before_the_work(spark):
    p = spark.createDataFrame([(1, 2), (1, 2)], "valid_start int, valid_end int")
    with pytest.raises(pairing.GateError):
        pairing.assert_unique(p, ["valid_start", "valid_end"], "twice")
    with pytest.raises(pairing.GateError):
        daily.concatenated([p, p], ["valid_start", "valid_end"])
    rain_ = spark.createDataFrame([(dt.date(2020, 6, 1), 1.0), (dt.date(2020, 6, 3), 2.0)], "time date, rain double")
    with pytest.raises(pairing.GateError):
        daily.checked_daily(rain_)
    with pytest.raises(pairing.GateError):
        daily.checked_daily(rain_, units="inch")
    with pytest.raises(mapping.SourceError):
        mapping.mapped(rain_, {"tp": ("nothing", 1.0, 0.0)})
    with pytest.raises(mapping.SourceError):
        mapping.open_source(spark, "obs", "nowhere", "x")


def test_lattice_roles_and_axes():
    assert space.lattice_role(*space.CANONICAL) == "canonical"
    assert space.lattice_role(10.0, 20.0, 70.0, 80.0, 0.25) == "crop"
    assert space.lattice_role(10.1, 20.0, 70.0, 80.0, 0.25) == "foreign"
    assert (len(space.axis(6.5, 38.5, 0.25)), len(space.axis(66.5, 100.0, 0.25))) == (129, 135)


def test_quantile_map_ties_and_tail(spark):
    df = spark.createDataFrame([(x, [0.0, 0.0, 1.0, 2.0], [0.5, 1.0, 2.0, 6.0]) for x in (-1.0, 0.0, 0.5, 1.5, 2.0, 3.0)], "x double, qf array<double>, qo array<double>")
    got = [r.y for r in models.quantile_mapped(models.with_knots(df), "x", "y").orderBy("x").collect()]
    assert got == pytest.approx([0.5, 0.5, 1.25, 4.0, 6.0, 7.0])


def test_no_leak():
    assert models.no_leak(["tp", "lat"]) == ["tp", "lat"]
    for bad in ("obs", "an_u850", "label_primary"):
        with pytest.raises(ValueError):
            models.no_leak(["tp", bad])


def test_nearest_counts_and_order(spark):
    df = spark.createDataFrame([(i, 0, [float(i), 0.0]) for i in range(6)], "i long, g int, v array<double>")
    out = lookup.nearest(df.where("i = 0"), df, ["g"], "i", "i", "v", 3).orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in out] == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_categories_and_warnings(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 15.6, 64.4, 204.5)], "x double")
    assert [r[0] for r in df.orderBy("x").select(rain.category(F.col("x"))).collect()] == ["no rain", "very light", "moderate", "moderate", "extremely heavy"]
    w = spark.createDataFrame([(10.0, 0.0, 0.5), (10.0, 0.2, 0.0), (120.0, 0.0, 0.0), (1.0, 0.0, 0.0)], "m double, h double, v double")
    assert [r[0] for r in w.select(rain.warning(F.col("m"), F.col("h"), F.col("v"))).collect()] == ["red", "yellow", "orange", "green"]


def test_bundle_round_trip_and_tampering(tmp_path):
    path = str(tmp_path / "b")
    sinks.write_bundle(path, {"grid": [1, 2], "districts": {"a": 1}})
    assert sinks.read_bundle(path) == {"grid": [1, 2], "districts": {"a": 1}}
    with pytest.raises(sinks.BundleError):
        sinks.write_bundle(path, {"x": 1})
    (tmp_path / "b" / "extra.txt").write_text("x")
    with pytest.raises(sinks.BundleError):
        sinks.read_bundle(path)
    (tmp_path / "b" / "extra.txt").unlink()
    (tmp_path / "b" / "grid.json.gz").write_bytes(b"no")
    with pytest.raises(sinks.BundleError):
        sinks.read_bundle(path)


def test_streaming_day_equals_batch(spark, tmp_path):
    from raincask.streaming.windows import daily_sums

    start = dt.datetime(2024, 7, 1, 3)
    rows = [(start + dt.timedelta(minutes=30 * i), 1, 1.0) for i in range(48)] + [(start + dt.timedelta(days=1, minutes=30 * i), 1, 1.0) for i in range(47)]
    df = spark.createDataFrame(rows, "ts timestamp, cell int, rate double")
    assert sorted((r.granules, r.rain) for r in daily_sums(df).collect()) == [(47, None), (48, 24.0)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = daily_sums(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.granules, r.rain) for r in spark.table("days").collect()) == [(47, None), (48, 24.0)]


def test_district_bridge_takes_the_whole_grid(spark, tmp_path):
    from raincask.plans import q_joins, registry, views

    spark.range(400).selectExpr("id AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    land = views.cells(spark, str(tmp_path)).where("land").orderBy("iy", "ix").collect()
    brute = regrid.bridge_rows(q_joins.TILES, [(r.iy, r.ix, r.lat, r.lon) for r in land], 1.5)
    got = registry.QUERIES["j08_district_bridge"](spark, str(tmp_path)).collect()
    assert {(r.district, r.iy, r.ix): (round(r.w, 6), r.fallback) for r in got} == {(n, y, x): (round(w, 6), f) for n, y, x, w, f in brute}
    assert len(got) == len(brute) and max(r.iy for r in got) >= 10
