"""Contracts of tables, settings from files, sources by name, sinks and reports."""

import datetime as dt
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from raincask.operators.detection import Gates
from raincask.operators.pairing import GateError
from raincask.sources import files, mapping, reports, sinks


def folder():
    return tempfile.mkdtemp(prefix="raincask-contracts-")


@pytest.fixture(scope="module")
def forecast(spark):
    rows = [(lead, dt.date(2024, 6, 1), y, x, 10.0 + y, 70.0 + x, 1.0, 2.0, 3.0, 40.0, 500.0, 1000.0) for lead in (1, 3) for y in range(3) for x in range(4)]
    return spark.createDataFrame(rows, "lead int, time date, iy int, ix int, lat double, lon double, tp double, u850 double, v850 double, tcwv double, cape double, mslp double").cache()


def test_contracts(spark, forecast):
    assert mapping.validated(forecast, "forecast").count() == 24
    assert mapping.validated(forecast.where("lead = 3").drop("tp"), "analysis").count() == 12
    broken = {
        "columns missing": forecast.drop("cape"), "a key comes twice": forecast.unionByName(forecast.limit(1)), "negative rain": forecast.withColumn("tp", F.when(F.col("ix") == 1, -0.1).otherwise(F.col("tp"))),
        "lat does not increase": forecast.withColumn("lat", -F.col("lat")), "lon does not increase": forecast.withColumn("lon", F.when(F.col("iy") == 2, F.col("lon") + 0.1).otherwise(F.col("lon"))),
    }
    for told, df in broken.items():
        with pytest.raises((GateError, mapping.SourceError), match=told):
            mapping.validated(df, "forecast")
    assert mapping.validated(forecast.withColumn("tp", F.lit(None).cast("double")), "forecast").count() == 24
    assert mapping.validated(forecast.where("lead = 1").drop("lead").withColumn("rain", F.col("tp")), "obs").count() == 12
    with pytest.raises(mapping.SourceError, match="no such kind"):
        mapping.validated(forecast, "other")


def test_settings_from_files(spark):
    where = Path(folder())
    defaults = {"leads": [1, 3], "model": {"rounds": 20, "rate": 0.1}, "name": None}
    (where / "a.json").write_text(json.dumps({"model": {"rounds": 5}, "name": "x"}))
    assert files.read_settings(spark, str(where / "a.json"), defaults, leads=[2]) == {"leads": [2], "model": {"rounds": 5, "rate": 0.1}, "name": "x"}
    (where / "b.json").write_text('{"modle": {}}')
    with pytest.raises(mapping.SourceError, match="modle"):
        files.read_settings(spark, str(where / "b.json"), defaults)
    (where / "c.json").write_text("[1]")
    with pytest.raises(mapping.SourceError, match="mapping"):
        files.read_settings(spark, str(where / "c.json"), defaults)
    pytest.importorskip("yaml")
    (where / "d.yaml").write_text("model:\n  rate: 0.3\n")
    assert files.read_settings(spark, str(where / "d.yaml"), defaults)["model"] == {"rounds": 20, "rate": 0.3}


def test_sources_by_name(spark, forecast):
    where = folder()
    forecast.select("lead", "time", "lat", "lon", "tp", "mslp", F.col("u850").alias("u"), F.col("v850").alias("v")).write.parquet(f"{where}/f")
    daily = mapping.open_source(spark, "forecast", "daily", f"{where}/f")
    assert daily.first().wind == pytest.approx((4 + 9) ** 0.5) and "mslp" in daily.columns
    forecast.select("lead", "time", "lat", "lon", "tp", F.col("u850").alias("u")).write.parquet(f"{where}/g")
    with pytest.raises(mapping.SourceError, match="mslp"):
        mapping.open_source(spark, "forecast", "daily", f"{where}/g")
    loose = mapping.open_source(spark, "forecast", "daily", f"{where}/g", strict=False)
    assert loose.where("v IS NULL AND mslp IS NULL AND wind IS NULL").count() == 24
    operational = mapping.open_source(spark, "forecast", "operational", f"{where}/f")
    assert {r.mslp for r in operational.collect()} == {10.0} and operational.columns == ["time", "lead", "lat", "lon", "tp", "mslp"]
    start = dt.datetime(2024, 6, 1, 3)
    granules = [(start + dt.timedelta(minutes=30 * k), start + dt.timedelta(minutes=30 * k + 30), 10.0, 70.0, rate) for k, rate in enumerate([1.5, -9.0, float("nan")])]
    spark.createDataFrame(granules, "starts timestamp_ntz, ends timestamp_ntz, lat double, lon double, rate double").write.parquet(f"{where}/h")
    got = mapping.open_source(spark, "obs_native", "granules", f"{where}/h").orderBy("slot").collect()
    assert [r.rate for r in got] == [1.5, None, None] and [r.slot - got[0].slot for r in got] == [0, 1, 2]
    spark.createDataFrame([(start, start + dt.timedelta(minutes=20), 1.0, 1.0, 1.0)], "starts timestamp_ntz, ends timestamp_ntz, lat double, lon double, rate double").write.parquet(f"{where}/i")
    with pytest.raises(GateError, match="half an hour"):
        mapping.open_source(spark, "obs_native", "granules", f"{where}/i")


def test_district_names(spark):
    where = Path(folder())
    ring = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    names = [{"district_name": "A"}, {"name": "B", "state": "S"}, {"NAME": "C"}, {"district": "D", "name": "E"}]
    (where / "d.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": "Polygon", "coordinates": ring}} for p in names]}))
    assert [r.district for r in files.polygons(spark, str(where / "d.json")).collect()] == ["A", "B (S)", "district_2", "D"]


def test_tables_and_evidence_are_written_once(spark, forecast):
    where = folder()
    sinks.write_table(forecast, f"{where}/t", by=["lead"])
    assert spark.read.parquet(f"{where}/t").where("lead = 3").count() == 12 and (Path(where) / "t" / "lead=3").is_dir()
    for form in ("csv", "json"):
        sinks.write_evidence(forecast.select("lead", "iy", "tp"), f"{where}/{form}", form)
        assert len([p for p in Path(where, form).iterdir() if p.name.startswith("part-")]) == 1
        with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
            sinks.write_evidence(forecast.select("lead"), f"{where}/{form}", form)
    back = spark.read.option("header", True).csv(f"{where}/csv")
    assert back.columns == ["lead", "iy", "tp"] and back.count() == 24


def test_reports_of_several_sections(spark, forecast):
    scores = forecast.groupBy("lead").agg(F.avg("tp").alias("tp")).orderBy("lead")
    text = reports.verification_report("Scores", {"By lead": scores, "Rows": forecast.agg(F.count("*").alias("n"))}, {"By lead": "Means of all cells."})
    assert text.startswith("# Scores\n\n## By lead\n\nMeans of all cells.\n\n| lead | tp |") and "| 3 | 1.0 |" in text and "## Rows" in text and "| 24 |" in text
    with pytest.raises(sinks.BundleError):
        reports.verification_report("Scores", {"All": spark.range(300)})
    told = reports.definitions(Gates(box=(0, 1, 0, 1), depth=7.5, most=3))
    rules = {r["axis"]: r["rule"] for r in told["thresholds"]}
    assert "7.5 hPa" in rules["low"] and "3 a time" in rules["separation"] and "8.7" in rules["depression"]
    record = reports.capability_record("PASS", False, {"low": {"available": True, "detected": 4, "kind": "stand-in", "reason": "gates"}}, {"paired_days": 31}, "Go on | slowly")
    text = reports.record_markdown("Capability", record)
    assert "| low | True | 4 | stand-in | gates |" in text and "- paired_days: 31" in text and "learning: NO" in text
