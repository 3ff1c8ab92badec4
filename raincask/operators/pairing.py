"""Pairing of forecasts and observations by identical accumulation windows, and the gates before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = ["valid_start", "valid_end"]


class GateError(ValueError):
    """A check that has to hold before the work begins does not."""


def assert_empty(df: DataFrame, message: str) -> None:
    """Fail with the message and one offending row, if there is any row."""
    row = df.limit(1).collect()
    if row:
        raise GateError(f"{message}: {row[0].asDict()}")


def assert_unique(df: DataFrame, keys: list[str], message: str) -> None:
    assert_empty(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), message)


def window_join(targets: DataFrame, candidates: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Left join on window equality; `matched` says whether a candidate was there. Never nearest, never overlapping."""
    return targets.join(candidates.withColumn("matched", F.lit(True)), [*WINDOW, *extra], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def unpaired(targets: DataFrame, candidates: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Targets without a candidate, with the reason: no such window at all, or not for this key."""
    left = targets.join(candidates.select(*WINDOW, *extra).distinct(), [*WINDOW, *extra], "left_anti")
    some = candidates.select(*WINDOW).distinct().withColumn("_there", F.lit(True))
    return left.join(some, WINDOW, "left").withColumn("reason", F.when(F.col("_there"), "window without this key").otherwise("no such window")).drop("_there")


def inverse_labels(windows: DataFrame, convention: str) -> DataFrame:
    """The unique label, of the start's date and the next, whose window is the given one; none or two is an error elsewhere."""
    from ..functions.windows import observation_window

    day = F.to_date("valid_start")
    each = windows.withColumn("label", F.explode(F.array(day, F.date_add(day, 1))))
    start, end = observation_window(F.col("label"), convention)
    return each.where((start == F.col("valid_start")) & (end == F.col("valid_end")))


def contiguous(df: DataFrame, start: str = "valid_start", end: str = "valid_end") -> DataFrame:
    """Windows with what is wrong before them: 'gap', 'overlap', 'duplicate' or 'ok', by successive start."""
    w = Window.orderBy(start, end)  # one row per window of a period: a calendar, not the cells
    before = F.lag(end).over(w)
    return df.withColumn("state", F.when(before.isNull(), "ok").when(F.lag(start).over(w) == F.col(start), "duplicate").when(before > F.col(start), "overlap").when(before < F.col(start), "gap").otherwise("ok"))


def period_audit(found: DataFrame, first, last, column: str = "label") -> DataFrame:
    """Expected days against found ones: expected, found, times found, for each day of either."""
    days = found.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(column)).withColumn("expected", F.lit(True))
    counts = found.groupBy(column).agg(F.count("*").alias("times"))
    return days.join(counts, column, "full_outer").select(column, F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("times", F.lit(0)).cast("long").alias("times"))
