"""Profiles from counts, records and exports."""

import json

import numpy as np
import pytest

from raincask.operators.pairing import GateError
from raincask.operators.scores import quantiles
from raincask.sources import profile, reports, sinks


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 4, 900), rng.integers(0, 60, 900) / 7)] + [(9, None), (8, 2.5)]
    levels = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in quantiles(spark.createDataFrame(rows, "k int, v double"), "v", levels, ["k"]).collect()}
    assert set(got) == {k for k, v in rows if v is not None}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for j, v in rows if j == k and v is not None], levels))
    whole = quantiles(spark.createDataFrame(rows, "k int, v double"), "v", levels).first().q
    assert np.allclose(whole, np.quantile([v for _, v in rows if v is not None], levels))
    empty = spark.createDataFrame([], "k int, v double")
    assert quantiles(empty, "v", [0.5]).first().q == [None] and quantiles(empty, "v", [0.5], ["k"]).count() == 0


def test_value_profile_without_wet_values(spark):
    r = profile.value_profile(spark.createDataFrame([(0.0,), (None,), (-999.0,)], "v double"), "v").first()
    assert (r.missing, r.fill_like, r.wet_p50, r.wet_p99) == (1, 1, None, None)


def test_field_statistics_count_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2), (3.0, 4)], "a double, b int")
    got = {r.field: r[1:] for r in profile.field_statistics(df, ["a", "b"]).collect()}
    assert got == {"a": (3, 1, 1.0, 2.0, 3.0), "b": (3, 1, 2.0, 3.0, 4.0)}


def ground(spark, shift=0.0):
    return spark.createDataFrame([(10.0 + shift, 70.0, 1.0), (10.0 + shift, 71.0, 2.0), (11.0, 70.0, 3.0), (11.0, 71.0, None)], "lat double, lon double, x double")


def test_validation_needs_one_grid(spark):
    record = reports.validation_record(ground(spark), ground(spark), ["x"], ["x"], {"files": ["a"], "share": float("nan")})
    assert record["status"] == "PASS" and record["provenance"] == {"files": ["a"], "share": None}
    assert record["atmosphere"][0]["missing"] == 1 and [a["n"] for a in record["grid"]] == [2, 2]
    with pytest.raises(GateError, match="differ"):
        reports.validation_record(ground(spark, 0.25), ground(spark), ["x"], ["x"], {})


def test_inspection_never_sets_a_convention(spark, tmp_path):
    df = spark.sql("SELECT DATE'2024-06-01' + CAST(id AS INT) AS time, 10.0 AS lat, 70.0 AS lon, id * 1.0 AS rain FROM range(4)")
    attributes = spark.createDataFrame([("global", "title", "Rain | ending at 03Z"), ("rain", "units", "mm")], "place string, name string, text string")
    record = reports.inspection_record("t", df, "rain", attributes)
    assert record["convention"] == "UNVERIFIED" and [e["name"] for e in record["evidence"]] == ["title"]
    assert reports.inspection_record("t", df, "rain", attributes.where("name = 'units'"))["verdict"].startswith("no evidence")
    reports.write_record(spark, f"{tmp_path}/r", "Inspection", record)
    assert json.loads(spark.read.text(f"{tmp_path}/r/json").first().value)["time"]["days"] == 4
    told = reports.record_markdown("Inspection", record)
    assert "## evidence" in told and "Rain \\| ending" in told
    with pytest.raises(Exception, match="exists"):
        reports.write_record(spark, f"{tmp_path}/r", "Inspection", record)


def test_export_prefers_validated_evidence(tmp_path):
    reports.export_run(f"{tmp_path}/a", {"cycle": {"day": 1}}, {"c2": {"status": "PASS"}, "c3": {"status": "PASS with notes"}}, {"rmse": 1.0})
    assert sinks.read_bundle(f"{tmp_path}/a")["about"]["evidence"] == "c3"
    reports.export_run(f"{tmp_path}/b", {"cycle": {}}, {}, {"rmse": 1.0})
    assert sinks.read_bundle(f"{tmp_path}/b")["about"]["phase"] == "trained"
    with pytest.raises(GateError, match="did not pass"):
        reports.export_run(f"{tmp_path}/c", {}, {"c3": {"status": "FAIL"}}, {"rmse": 1.0})
    with pytest.raises(sinks.BundleError, match="neither"):
        reports.export_run(f"{tmp_path}/c", {}, {})


def test_definitions_are_plain():
    assert json.dumps(reports.plain(reports.definitions())) and [s["radius_km"] for s in reports.definitions()["systems"]] == [350.0, 550.0]
