"""Accumulation windows: which 24 hours a daily label stands for. All times are UTC without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONVENTIONS = ("ending", "starting")


class ConventionError(ValueError):
    """A label's meaning is not configured, or not one of the known ones."""


def parse_convention(name: str) -> str:
    """Exact names only; anything else, 'unverified' too, is refused."""
    if name not in CONVENTIONS:
        raise ConventionError(f"unknown or unverified time convention: {name!r}")
    return name


def at_hours(date: Column, hours: Column | int) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)


def label_of(ts: Column) -> Column:
    """The forecast label of an instant: days run from 03 to 03 UTC."""
    return F.to_date(ts - F.expr("INTERVAL 3 HOUR"))


def forecast_window(label: Column) -> tuple[Column, Column]:
    return at_hours(label, 3), at_hours(label, 27)


def observation_window(label: Column, convention: str) -> tuple[Column, Column]:
    shift = -24 if parse_convention(convention) == "ending" else 0
    return at_hours(label, 3 + shift), at_hours(label, 27 + shift)


def initial_time(label: Column, lead: Column) -> Column:
    return F.date_sub(label, (lead - 1).cast("int"))


def first_hour(lead: Column) -> Column:
    """Forecast hour at which the window of a lead begins."""
    return (3 + 24 * (lead - 1)).cast("int")


def sample_hours(lead: Column) -> Column:
    return F.transform(F.array(*(F.lit(h) for h in (3, 9, 15, 21))), lambda h: (first_hour(lead) + h).cast("int"))


def whole_hours(value: Column, unit: Column) -> Column:
    """Hours of a GRIB time range: units 0 minute, 1 hour, 2 day, 10 three hours, 11 six, 12 twelve; null if not whole."""
    minutes = F.when(unit == 0, value).when(unit == 1, value * 60).when(unit == 2, value * 1440).when(unit == 10, value * 180).when(unit == 11, value * 360).when(unit == 12, value * 720)
    return F.when(minutes % 60 == 0, (minutes / 60).cast("int"))


def step_range(text: Column) -> tuple[Column, Column]:
    """'0-27' gives (0, 27); a single number stands for both ends."""
    return F.regexp_extract(text, r"^(\d+)", 1).cast("int"), F.regexp_extract(text, r"(\d+)$", 1).cast("int")
