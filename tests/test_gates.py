"""Gates: each lets good data through and names the fault of bad data."""

import datetime as dt

import pytest

from raincask.operators import gates as G
from raincask.operators.pairing import GateError

GOOD = {"source_name": "IMD", "product_role": "FINAL_TRUTH", "is_proxy": False, "product_name": "gridded rain", "source_filename": "f", "observation_resolution": "0.25", "native_grid": "g", "units": "mm", "time_convention": "ending"}
SCHEMA = "source_name string, product_role string, is_proxy boolean, product_name string, source_filename string, observation_resolution string, native_grid string, units string, time_convention string"


def described(spark, *rows):
    return spark.createDataFrame([tuple({**GOOD, **r}[k] for k in GOOD) for r in rows], SCHEMA)


def test_conventions():
    assert G.verified_convention({"time_convention": "ending"}, "train") == "ending"
    for config in ({}, {"time_convention": "unverified"}, {"time_convention": "ending", "adapter_options": {"imd_window": "x"}}):
        with pytest.raises(GateError):
            G.verified_convention(config, "build")
    with pytest.raises(GateError):
        G.verified_convention({"time_convention": "ending"}, "deploy")
    G.same_convention({"time_convention": "ending"}, "ending")
    for stored in ({}, {"time_convention": "starting"}):
        with pytest.raises(GateError):
            G.same_convention(stored, "ending")


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({"source_name": "x"}, "unknown source"), ({"source_name": None}, "unknown source"), ({"product_role": "SYNTHETIC_TEST"}, "role of another source"), ({"is_proxy": True}, "proxy flag of another source"), ({"is_proxy": None}, "proxy flag of another source"),
        ({"product_name": "IMERG final"}, "gauge product under another name"), ({"units": " "}, "units is empty"), ({"native_grid": None}, "native_grid is empty"),
        ({"source_name": "NASA-GPM-IMERG", "product_role": "SMOKE_TEST_PROXY", "is_proxy": True, "product_name": "imd like IMERG"}, "satellite product under another name"),
    ],
)
def test_provenance(spark, change, fault):
    assert [r.fault for r in G.provenance_faults(described(spark, change)).collect()] == [fault]
    with pytest.raises(GateError):
        G.assert_provenance(described(spark, GOOD, change))


def test_proxies_stay_out(spark):
    G.no_proxy(described(spark, GOOD), "pairing")
    proxy = {"source_name": "NASA-GPM-IMERG", "product_role": "SMOKE_TEST_PROXY", "is_proxy": True, "product_name": "IMERG final"}
    G.assert_provenance(described(spark, proxy))
    with pytest.raises(GateError):
        G.no_proxy(described(spark, GOOD, proxy), "pairing")


def test_lattices(spark):
    cells = spark.createDataFrame([(6.5, 66.5), (6.75, 67.25)], "lat double, lon double")
    G.truth_grid(cells, "imd", (6.5, 66.5), 0.25)
    G.truth_grid(cells, "IMERG", (0.0, 0.1), 0.5)
    for wrong in (lambda: G.truth_grid(cells, "IMD", (6.5, 66.5), 0.5), lambda: G.truth_grid(spark.createDataFrame([(39.5, 70.0)], "lat double, lon double"), "IMD")):
        with pytest.raises(GateError):
            wrong()
    G.uniform_axis(cells, "lat")
    with pytest.raises(GateError):
        G.uniform_axis(spark.createDataFrame([(0.0,), (1.0,), (2.1,)], "lat double"), "lat")


def test_windows(spark):
    day = dt.datetime(2024, 6, 1, 3)
    schema = "label date, valid_start timestamp_ntz, valid_end timestamp_ntz"
    good = spark.createDataFrame([(day.date(), day, day + dt.timedelta(days=1)), (day.date(), None, None)], schema)
    G.forecast_provenance(good)
    with pytest.raises(GateError):
        G.known_windows(good)
    G.known_windows(good.where("valid_start IS NOT NULL"))
    with pytest.raises(GateError):
        G.known_windows(good.drop("valid_end"))
    with pytest.raises(GateError):
        G.forecast_provenance(spark.createDataFrame([(day.date(), day, day + dt.timedelta(hours=23))], schema))
    daily = "init timestamp_ntz, first_hour int, last_hour int, valid_start timestamp_ntz, valid_end timestamp_ntz"
    row = (dt.datetime(2024, 6, 1), 3, 27, day, day + dt.timedelta(days=1))
    G.daily_windows(spark.createDataFrame([row], daily))
    for wrong in ((dt.datetime(2024, 6, 1, 6), *row[1:]), (row[0], 3, 26, *row[3:]), (*row[:3], day - dt.timedelta(hours=1), day)):
        with pytest.raises(GateError):
            G.daily_windows(spark.createDataFrame([wrong], daily))


def test_interval_selection(spark):
    schema = "file string, init int, start_h int, end_h int, key int, value double"
    rows = [("a", 0, 0, 27, 1, 5.0), ("a", 0, 0, 27, 1, 5.0), ("a", 0, 0, 27, 2, 6.0), ("a", 0, 0, 3, 1, 1.0)]
    want = lambda *w: spark.createDataFrame([w], "file string, init int, start_h int, end_h int")
    messages = spark.createDataFrame(rows, schema)
    assert sorted(r.value for r in G.select_interval(messages, want("a", 0, 0, 27)).collect()) == [5.0, 6.0]
    for bad, rows_ in ((want("a", 0, 0, 24), rows), (want("a", 12, 0, 27), rows), (want("a", 0, 0, 27), [*rows, ("a", 0, 0, 27, 2, 7.0)])):
        with pytest.raises(GateError):
            G.select_interval(spark.createDataFrame(rows_, schema), bad)


def test_accumulations(spark):
    schema = "window int, cell int, daily double, check double, least_step double"
    rows = [(1, c, 2.0 - 2.2 * (c == 0), 2.0 - 2.2 * (c == 0), -0.2) for c in range(20)]
    rows += [(2, 0, -0.3, -0.3, 0.0), (3, 0, 1.0, 1.0, -0.3), (4, 0, 1.0, 1.2, 0.0)] + [(5, c, 1.0, 1.6 if c == 0 else 1.0, 0.0) for c in range(20)]
    assert {(r.window, r.fault) for r in G.accumulation_faults(spark.createDataFrame(rows, schema)).collect()} == {(2, "negative sum"), (3, "running total falls"), (4, "pieces disagree on average"), (5, "pieces disagree in a cell")}


def test_seasons_and_years(spark):
    days = spark.sql("SELECT 2020 + y AS year, make_date(2020 + y, 6, 1) + d AS label FROM (SELECT explode(sequence(0, 19)) AS y) CROSS JOIN (SELECT explode(sequence(0, 121)) AS d)")
    G.seasonal_windows(days)
    assert G.climatology_years(days) == 20
    with pytest.raises(GateError):
        G.seasonal_windows(days.where("label <> DATE'2021-07-04'"))
    with pytest.raises(GateError):
        G.climatology_years(days.where("year > 2020"))


def test_geography_readiness_and_summaries(spark):
    facts = {"is_synthetic": "False", "static_source": "s", "static_source_url": "u", "static_source_doi": "d", "static_source_resolution": "r"}
    G.real_static(facts)
    for wrong in ({}, {**facts, "is_synthetic": True}, {**facts, "static_source_doi": ""}):
        with pytest.raises(GateError):
            G.real_static(wrong)
    effects = lambda *rows: spark.createDataFrame(list(rows), "target_regime string, material_difference boolean")
    assert G.readiness(90, 3, "FINAL_TRUTH", effects(("low_proxy", True)), 1) == []
    assert len(G.readiness(89, 2, "SMOKE_TEST_PROXY", effects(("other", True)), 0)) == 5
    assert G.passing_summary({"c2": {"status": "PASS"}, "c3": {"status": "PASS with notes"}})[0] == "c3"
    for wrong in ({}, {"c3": {"status": "FAIL"}, "c2": {"status": "PASS"}}):
        with pytest.raises(GateError):
            G.passing_summary(wrong)
