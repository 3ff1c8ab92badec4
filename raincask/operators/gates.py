"""Gates: checks that have to hold before data are built, trained on, verified or published.

Each gate looks at a table, or at the few facts that describe one, and raises GateError with the first
fault it finds. Tables are reduced by Spark to the faulty rows; nothing but one of them is collected.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import forecast_window, parse_convention
from .pairing import GateError, assert_empty

#: Observation sources: the one role each may have, and whether it is a proxy (fixed values).
SOURCES = {
    "IMD": ("FINAL_TRUTH", False),
    "IMD-NCMRWF": ("OFFICIAL_ALTERNATIVE", False),
    "NASA-GPM-IMERG": ("SMOKE_TEST_PROXY", True),
    "synthetic": ("SYNTHETIC_TEST", True),
}
#: What a description of observations has to say (fixed values).
DESCRIBED = ("product_name", "source_filename", "observation_resolution", "native_grid", "units", "time_convention")
#: Adapter options of an older configuration that let a run assume a convention (fixed values).
LEGACY = ("imd_window",)
VERBS = ("build", "train", "verify", "smoke")


@dataclass(frozen=True)
class Tolerances:
    """Millimetres by which daily sums from running totals may be off (fixed values)."""

    negative: float = 0.25
    monotonic: float = 0.25
    most_off: float = 0.5
    mean_off: float = 0.1
    share_within: float = 1.0


# ---------------------------------------------------------------- time conventions
def verified_convention(config: Mapping[str, object], verb: str) -> str:
    """The configured convention; a verb that pairs data may not run on an unverified one, nor on a legacy key."""
    if verb not in VERBS:
        raise GateError(f"unknown verb {verb!r}")
    no_legacy_keys(config)
    try:
        return parse_convention(str(config.get("time_convention", "unverified")))
    except ValueError as e:
        raise GateError(f"{verb} is blocked: {e}") from None


def no_legacy_keys(config: Mapping[str, object], keys: tuple[str, ...] = LEGACY) -> None:
    options = config.get("adapter_options") or {}
    there = [k for k in keys if k in config or k in options]
    if there:
        raise GateError(f"legacy keys are not read any more: {there}; set time_convention instead")


def same_convention(stored: Mapping[str, str], configured: str) -> None:
    """A table built under one convention is not read under another; a table that names none is refused."""
    name = stored.get("time_convention")
    if name != configured:
        raise GateError(f"stored under {name!r}, configured is {configured!r}")


# ---------------------------------------------------------------- provenance of observations
def provenance_faults(described: DataFrame) -> DataFrame:
    """(source_name, fault) for each fault of the rows of `described`, one row a product.

    It has source_name, product_role, is_proxy and the columns of DESCRIBED. A source has one role; the
    proxy flag goes with it; a satellite product names itself and not the gauges, and the other way round.
    """
    spark = described.sparkSession
    rules = spark.createDataFrame([(k, role, proxy) for k, (role, proxy) in SOURCES.items()], "source_name string, _role string, _proxy boolean")
    name = F.coalesce("product_name", F.lit(""))
    imd, imerg = name.rlike(r"(?i)\bIMD\b"), name.rlike("(?i)IMERG")
    faults = [
        F.when(F.col("_role").isNull(), "unknown source"),
        F.when(~F.col("product_role").eqNullSafe(F.col("_role")) & F.col("_role").isNotNull(), "role of another source"),
        F.when(~F.col("is_proxy").eqNullSafe(F.col("_proxy")) & F.col("_role").isNotNull(), "proxy flag of another source"),
        F.when((F.col("source_name") == "NASA-GPM-IMERG") & (imd | ~imerg), "satellite product under another name"),
        F.when((F.col("source_name") == "IMD") & imerg, "gauge product under another name"),
        *(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"{c} is empty") for c in DESCRIBED),
    ]
    told = described.join(F.broadcast(rules), "source_name", "left").select("source_name", F.explode(F.array_compact(F.array(*faults))).alias("fault"))
    return told


def assert_provenance(described: DataFrame) -> None:
    """To be called on write and on read."""
    assert_empty(provenance_faults(described), "provenance of observations")


def no_proxy(described: DataFrame, workflow: str) -> None:
    """A smoke-test proxy cannot enter the path of daily pairs."""
    assert_provenance(described)
    assert_empty(described.where("product_role = 'SMOKE_TEST_PROXY'").select("source_name", "product_name"), f"{workflow} is blocked for proxies")


def truth_grid(cells: DataFrame, source: str, origin: tuple[float, float] = (6.5, 66.5), step: float = 0.25, far: tuple[float, float] = (38.5, 100.0), tolerance: float = 1e-6) -> None:
    """Gauge observations come on the lattice from `origin` to `far` in this step, so nothing is interpolated; other sources are not held to it."""
    if source.upper() != "IMD":
        return
    off = lambda c, o: F.abs((F.col(c) - o) / step - F.round((F.col(c) - o) / step))
    inside = F.col("lat").between(origin[0] - tolerance, far[0] + tolerance) & F.col("lon").between(origin[1] - tolerance, far[1] + tolerance)
    assert_empty(cells.where((off("lat", origin[0]) > tolerance) | (off("lon", origin[1]) > tolerance) | ~inside).select("lat", "lon"), "not a point of the gauge lattice")


# ---------------------------------------------------------------- windows
def forecast_provenance(forecast: DataFrame) -> None:
    """Recorded windows (null where none is) agree with those of the labels."""
    start, end = forecast_window(F.col("label"))
    wrong = forecast.where((F.col("valid_start") != start) | (F.col("valid_end") != end))
    assert_empty(wrong.select("label", "valid_start", "valid_end"), "recorded window disagrees with the label")


def known_windows(obs: DataFrame) -> None:
    """Observations carry a window each; one unknown blocks pairing."""
    missing = [c for c in ("valid_start", "valid_end") if c not in obs.columns]
    if missing:
        raise GateError(f"observations carry no {missing}")
    assert_empty(obs.where("valid_start IS NULL OR valid_end IS NULL").limit(1), "observation without a known window")


def select_interval(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The message of each wanted (file, init, start_h, end_h): none, two that disagree, or another init is an error.

    messages: (file, init, start_h, end_h, key, value), one row a cell; equal repeats count once.
    """
    span = ["file", "start_h", "end_h"]
    there = messages.select(*span, F.col("init").alias("_init")).distinct()
    met = wanted.join(there, span, "left")
    assert_empty(met.where("_init IS NULL").select(*span), "no message for the interval")
    assert_empty(met.where("_init <> init").select(*span, "init", "_init"), "message of another cycle")
    mine = messages.join(wanted.select(*span), span, "left_semi").select(*span, "init", "key", "value").distinct()
    assert_empty(mine.groupBy(*span, "key").agg(F.count("*").alias("n")).where("n > 1"), "messages of one interval disagree")
    return mine


def daily_windows(windows: DataFrame) -> None:
    """(init, first_hour, last_hour, valid_start, valid_end): cycles of 00 UTC, 24 hours, from 03 to the next day's 03 UTC."""
    midnight = (F.hour("init") == 0) & (F.minute("init") == 0)
    day = (F.hour("valid_start") == 3) & (F.minute("valid_start") == 0) & (F.second("valid_start") == 0) & (F.col("valid_end") - F.col("valid_start") == F.expr("INTERVAL '24' HOUR"))
    assert_empty(windows.where(~(midnight & (F.col("last_hour") - F.col("first_hour") == 24) & day)), "not a daily window")


def accumulation_faults(fields: DataFrame, tolerances: Tolerances = Tolerances()) -> DataFrame:
    """(window, fault) of daily sums: fields (window, cell, daily, check, least_step), the step being the least rise of a running total.

    `daily` may be negative by packing noise only, totals may fall by as much, and `check`, the same sum
    from other pieces, is near it in all cells and nearer on average. Windows are reduced in one pass.
    """
    off = F.abs(F.col("daily") - F.col("check"))
    by = fields.groupBy("window").agg(F.min("daily").alias("low"), F.min("least_step").alias("step"), F.avg(off).alias("mean"), F.avg((off < tolerances.most_off).cast("double")).alias("within"))
    faults = [
        F.when(F.col("low") < -tolerances.negative, "negative sum"),
        F.when(F.col("step") < -tolerances.monotonic, "running total falls"),
        F.when(F.col("mean") > tolerances.mean_off, "pieces disagree on average"),
        F.when(F.col("within") < tolerances.share_within, "pieces disagree in a cell"),
    ]
    return by.select("window", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def seasonal_windows(found: DataFrame, year_column: str = "year", days: int = 122) -> None:
    """Each season has exactly its 122 daily windows of June to September."""
    assert_empty(found.groupBy(year_column).agg(F.countDistinct("label").alias("windows")).where(F.col("windows") != days), f"a season has not {days} windows")


def uniform_axis(points: DataFrame, axis: str, by: list[str] = (), tolerance: float = 1e-5) -> None:
    """The values of an axis ascend by one step. The window runs over an axis, whose length belongs to the grid."""
    w = Window.partitionBy(*by).orderBy("_at") if by else Window.orderBy("_at")
    steps = points.select(*by, F.col(axis).alias("_at")).distinct().withColumn("_step", F.col("_at") - F.lag("_at").over(w)).where("_step IS NOT NULL")
    ends = steps.groupBy(*by).agg(F.min("_step").alias("least"), F.max("_step").alias("most"))
    assert_empty(ends.where((F.col("most") - F.col("least") > tolerance) | (F.col("least") <= 0)), f"{axis} is not uniform")


# ---------------------------------------------------------------- geography, climatology, readiness
def real_static(facts: Mapping[str, object]) -> None:
    """A real run needs geography that is not synthetic and says where it comes from; silence counts as synthetic."""
    if str(facts.get("is_synthetic", True)).strip().lower() == "true":
        raise GateError("geography is synthetic or unproven")
    missing = [k for k in ("static_source", "static_source_url", "static_source_doi", "static_source_resolution") if not facts.get(k)]
    if missing:
        raise GateError(f"provenance of geography is missing: {missing}")


def climatology_years(daily: DataFrame, least: int = 20, year_column: str = "year") -> int:
    """The number of years, which has to be `least` or more."""
    n = daily.agg(F.countDistinct(year_column).alias("n")).first()["n"]
    if n < least:
        raise GateError(f"{n} years of climatology, {least} are needed")
    return n


def readiness(days: int, months: int, role: str, effects: DataFrame, usable_rows: int, least_days: int = 90, least_months: int = 3) -> list[str]:
    """Reasons against a start of machine learning; none means go. effects: (target_regime, material_difference)."""
    low = effects.where("target_regime = 'low_proxy'").agg(F.first("material_difference").alias("there")).first()["there"]
    told = [
        (days < least_days, f"{days} paired days, {least_days} are needed"),
        (months < least_months, f"{months} months, {least_months} are needed"),
        (not low, "lows show no material difference yet"),
        (usable_rows == 0, "no row of the atlas has enough samples"),
        (role != "FINAL_TRUTH", f"{role} is not final truth"),
    ]
    return [reason for fails, reason in told if fails]


def passing_summary(summaries: Mapping[str, Mapping[str, object]], order: tuple[str, ...] = ("c3", "c2")) -> tuple[str, Mapping[str, object]]:
    """The first summary of `order` that is there; its status has to begin with PASS."""
    for name in order:
        if name in summaries:
            if not str(summaries[name].get("status", "")).startswith("PASS"):
                raise GateError(f"summary {name} did not pass: {summaries[name].get('status')!r}")
            return name, summaries[name]
    raise GateError(f"no summary of {order}")
