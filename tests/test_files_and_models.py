"""Files as tables, settings, polygons, and the fitted parts of the ladder."""

import datetime as dt
import json

import pytest

from raincask.operators import models as M
from raincask.operators.pairing import GateError
from raincask.sources import files as S
from raincask.sources import sinks
from raincask.sources.mapping import SourceError, open_source


def test_settings():
    defaults = {"a": 1, "grid": {"res": 0.25, "lat": 6}, "free": {}}
    assert S.merged(defaults, {"grid": {"res": 0.5}, "free": {"x": 1}}) == {"a": 1, "grid": {"res": 0.5, "lat": 6}, "free": {"x": 1}}
    with pytest.raises(SourceError, match="grid.step"):
        S.merged(defaults, {"grid": {"step": 1}})


def test_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "t" / "broken.parquet").write_bytes(b"PAR1 but cut")
    status = {r.name: r.status for r in S.audited(spark, f"{tmp_path}/t", pattern="*.parquet").collect()}
    assert status.pop("broken.parquet") == "damaged" and set(status.values()) == {"good"}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "fc_2024060100_027.grd").write_bytes(bytes(4 * 6 * 365))
    found = S.listed(spark, f"{tmp_path}/g")
    facts = S.raw_grid_facts(found, 2, 3).first()
    assert (facts.fields, facts.is_year) == (365, True) and S.raw_grid_facts(found, 2, 4).first().fields is None
    wanted = spark.createDataFrame([(dt.datetime(2024, 6, 1), 27)], "init timestamp, hour int")
    assert S.resolved(found, wanted, "fc_%s_%03d.grd").first().name == "fc_2024060100_027.grd"
    with pytest.raises(GateError):
        S.resolved(found, wanted.withColumn("hour", wanted.hour + 1), "fc_%s_%03d.grd")


def test_granule_plan(spark):
    plan = S.granule_plan(spark.createDataFrame([(dt.date(2024, 6, 1),)], "label date")).orderBy("slot").collect()
    assert len(plan) == 48 and plan[0].starts == dt.datetime(2024, 6, 1, 3) and plan[47].starts == dt.datetime(2024, 6, 2, 2, 30)


def test_polygons(spark, tmp_path):
    ring = [[70.0, 8.0], [72.0, 8.0], [72.0, 10.0], [70.0, 8.0]]
    of = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "d.json").write_text(json.dumps({"type": "FeatureCollection", "features": [of("Polygon", [ring], NAME_2="A", state="S"), of("MultiPolygon", [[ring], [ring[::-1]]], name="B"), of("Polygon", [ring])]}, indent=1))
    got = [(r.district, len(r.ring), r.ring[0].x) for r in S.polygons(spark, f"{tmp_path}/d.json").collect()]
    assert got == [("A (S)", 4, 70.0), ("B", 4, 70.0), ("B", 4, 70.0), ("district_2", 4, 70.0)]


def test_sources_with_contracts(spark, tmp_path):
    spark.createDataFrame([("2024-06-01", 8.0, 70.0, 5.0), ("2024-06-01", 8.0, 70.5, -999.0)], "time string, lat double, lon double, rain double").write.parquet(f"{tmp_path}/obs")
    assert [r.rain for r in open_source(spark, "obs", "gauge", f"{tmp_path}/obs").orderBy("lon").collect()] == [5.0, None]
    t = dt.datetime(2024, 6, 1, 3)
    schema = "starts timestamp_ntz, ends timestamp_ntz, lat double, lon double, rate double"
    spark.createDataFrame([(t, t + dt.timedelta(minutes=30), 8.0, 70.0, -9999.9)], schema).write.parquet(f"{tmp_path}/g")
    row = open_source(spark, "obs_native", "granules", f"{tmp_path}/g").first()
    assert row.rate is None and row.slot == t.replace(tzinfo=dt.timezone.utc).timestamp() // 1800
    spark.createDataFrame([(t, t + dt.timedelta(minutes=29), 8.0, 70.0, 1.0)], schema).write.parquet(f"{tmp_path}/h")
    with pytest.raises(GateError):
        open_source(spark, "obs_native", "granules", f"{tmp_path}/h")
    spark.createDataFrame([("2024-06-01", 1, 8.0, 70.0, 2.0, 100_000.0)], "time string, lead int, lat double, lon double, tp double, mslp double").write.parquet(f"{tmp_path}/f")
    assert open_source(spark, "forecast", "operational", f"{tmp_path}/f").first().mslp == 1000.0
    assert open_source(spark, "forecast", "daily", f"{tmp_path}/f", strict=False).first().wind is None
    with pytest.raises(SourceError):
        open_source(spark, "forecast", "daily", f"{tmp_path}/f")


def test_experts_registry_and_importance(spark, tmp_path):
    rows = [(float(k % 17), float(k % 5), k % 2, float((k % 17) * (3 if k % 2 else 1))) for k in range(600)] + [(1.0, 1.0, 2, 5.0)] * 5
    df = spark.createDataFrame(rows, "tp double, x double, label int, obs double").selectExpr("*", "cast(label = 0 as double) AS p_0", "cast(label = 1 as double) AS p_1", "cast(label = 2 as double) AS p_2")
    model = M.fit_experts(df, ["tp", "x"], "label", [0, 1, 2], least_rows=100, trees=5)
    assert set(model.experts) == {0, 1} and model.rows == {0: 300, 1: 300, 2: 5}
    error = lambda out: out.selectExpr("avg(pow(p - obs, 2)) AS e").first().e
    general = M.predict_rain(model.general, df, "p")
    assert error(M.predict_mixture(model, df, "p", k=10.0)) < 0.5 * error(general)
    only = M.predict_mixture(model, df.where("label = 2"), "q", k=10.0)
    assert M.predict_rain(model.general, only, "p").where("abs(p - q) > 1e-9").count() == 0  # no expert: the general model
    share = dict(M.importance(model.general, ["tp", "x"]))
    assert share["tp"] > share["x"] and abs(sum(share.values()) - 1) < 1e-3
    sinks.save_models(spark, f"{tmp_path}/r", {"general": model.general}, {"rows": 605})
    loaded, card = sinks.load_models(spark, f"{tmp_path}/r")
    assert card == {"rows": 605, "models": ["general"]} and abs(error(M.predict_rain(loaded["general"], df, "p")) - error(general)) < 1e-9
    with pytest.raises(Exception):  # noqa: B017
        sinks.save_models(spark, f"{tmp_path}/r", {"general": model.general}, {})


def test_top_drivers(spark):
    c = spark.createDataFrame([(1, d, v) for d, v in (("a", 0.1), ("b", -0.5), ("c", 0.5), ("d", 0.0), ("e", 0.3), ("f", -0.2))], "k int, driver string, value double")
    assert [(r.driver, r.direction) for r in M.top_drivers(c, ["k"]).orderBy("rank").collect()] == [("b", "decreases"), ("c", "increases"), ("e", "increases"), ("f", "decreases"), ("a", "increases")]
