"""Neighbourhood operators on dense grids, as two passes of one-dimensional windows.

The grid must be complete: rows are neighbours by order, so a missing cell would shift the others.
`complete` makes it so and `assert_dense` checks it. Partition keys (by) come first everywhere: after
one repartition by them, both passes sort within partitions without another exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pairing import GateError


def assert_dense(df: DataFrame, by: Sequence[str], rows: int) -> None:
    bad = df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") != rows).limit(1).collect()
    if bad:
        raise GateError(f"grid is not dense: {bad[0].asDict()} instead of {rows}")


def aligned(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.repartition(*by)


def _pass(df: DataFrame, by: Sequence[str], across: str, along: str, k: int, value: str, out: str, agg: Callable[[Column], Column]) -> DataFrame:
    w = Window.partitionBy(*by, across).orderBy(along).rowsBetween(-(k // 2), k // 2)
    return df.withColumn(out, agg(F.col(value)).over(w))


def focal_sum(df: DataFrame, value: str, k: int, by: Sequence[str], out: str) -> DataFrame:
    """Sum over the k x k box; beyond the edge there is nothing (zero)."""
    df = _pass(df, by, "iy", "ix", k, value, "_row", F.sum)
    return _pass(df, by, "ix", "iy", k, "_row", out, F.sum).drop("_row")


def focal_extreme(df: DataFrame, value: str, k: int, by: Sequence[str], out: str, most: bool) -> DataFrame:
    """Maximum or minimum over the k x k box within the grid; replicated or reflected edges give the same."""
    agg = F.max if most else F.min
    df = _pass(df, by, "iy", "ix", k, value, "_row", agg)
    return _pass(df, by, "ix", "iy", k, "_row", out, agg).drop("_row")


def weighted_pass(df: DataFrame, by: Sequence[str], across: str, along: str, n: int, kernel: list[float], value: str, out: str) -> DataFrame:
    """One pass of a symmetric kernel with replicated edges, from one ordered list of a grid line.

    A line has n values, a number that belongs to the grid and not to the data.
    """
    half = len(kernel) // 2
    w = Window.partitionBy(*by, across).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = F.collect_list(value).over(w)
    clamp = lambda i: F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    terms = sum((F.lit(kernel[half + o]) * F.element_at(F.col("_line"), (clamp(F.col("_at") + o) + 1).cast("int")) for o in range(-half, half + 1)), F.lit(0.0))
    at = F.row_number().over(Window.partitionBy(*by, across).orderBy(along)) - 1
    return df.withColumn("_line", line).withColumn("_at", at).withColumn(out, terms).drop("_line", "_at")


def focal_mean(df: DataFrame, value: str, k: int, by: Sequence[str], out: str, ny: int, nx: int) -> DataFrame:
    """Mean over the k x k box with replicated edges."""
    box = [1.0 / k] * k
    df = weighted_pass(df, by, "iy", "ix", nx, box, value, "_row")
    return weighted_pass(df, by, "ix", "iy", ny, box, "_row", out).drop("_row")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    half = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-half, half + 1)]
    return [r / sum(raw) for r in raw]


def gaussian(df: DataFrame, value: str, sigma: float, by: Sequence[str], out: str, ny: int, nx: int) -> DataFrame:
    kernel = gaussian_kernel(sigma)
    df = weighted_pass(df, by, "ix", "iy", ny, kernel, value, "_row")
    return weighted_pass(df, by, "iy", "ix", nx, kernel, "_row", out).drop("_row")


def central_difference(df: DataFrame, value: str, along: str, across: str, by: Sequence[str], out: str) -> DataFrame:
    """Half the difference of both neighbours; one-sided at the edges; per cell, not per metre."""
    w = Window.partitionBy(*by, across).orderBy(along)
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return df.withColumn(out, F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2))


def gradient_magnitude(df: DataFrame, value: str, step: float, by: Sequence[str], out: str) -> DataFrame:
    """Per degree, the zonal part divided by the cosine of latitude."""
    df = central_difference(central_difference(df, value, "iy", "ix", by, "_gy"), value, "ix", "iy", by, "_gx")
    return df.withColumn(out, F.hypot(F.col("_gx") / F.cos(F.radians("lat")), F.col("_gy")) / step).drop("_gx", "_gy")


def ring_minimum(df: DataFrame, value: str, radius: int, by: Sequence[str], out: str) -> DataFrame:
    """Minimum over the square ring `radius` cells away; null where the ring leaves the grid. The radius is at least 2."""
    if radius < 2:
        raise GateError("a ring of radius 1 would hold its own centre's neighbours only; the grid is too coarse")
    side = 2 * radius + 1
    wx, wy = Window.partitionBy(*by, "iy").orderBy("ix"), Window.partitionBy(*by, "ix").orderBy("iy")
    df = df.withColumn("_h", F.min(value).over(wx.rowsBetween(-radius, radius))).withColumn("_hn", F.count(value).over(wx.rowsBetween(-radius, radius)))
    df = df.withColumn("_v", F.min(value).over(wy.rowsBetween(-radius, radius))).withColumn("_vn", F.count(value).over(wy.rowsBetween(-radius, radius)))
    ends = [F.lag("_h", radius).over(wy), F.lead("_h", radius).over(wy), F.lag("_v", radius).over(wx), F.lead("_v", radius).over(wx)]
    full = (F.lag("_hn", radius).over(wy) == side) & (F.lead("_hn", radius).over(wy) == side) & (F.lag("_vn", radius).over(wx) == side) & (F.lead("_vn", radius).over(wx) == side)
    return df.withColumn("_full", full).withColumn("_m", F.least(*ends)).withColumn(out, F.when(F.col("_full"), F.col("_m"))).drop("_h", "_hn", "_v", "_vn", "_full", "_m")


def fss_parts(df: DataFrame, fc: str, obs: str, threshold: float, k: int, by: Sequence[str], valid: str) -> DataFrame:
    """Neighbourhood fractions of the events at >= threshold, over the valid cells of each box: columns pf and po."""
    ok = F.col(valid)
    df = df.withColumn("_v", ok.cast("double")).withColumn("_f", F.when(ok & (F.col(fc) >= threshold), 1.0).otherwise(0.0)).withColumn("_o", F.when(ok & (F.col(obs) >= threshold), 1.0).otherwise(0.0))
    for c in ("_v", "_f", "_o"):
        df = focal_sum(df, c, k, by, f"{c}s")
    n = F.nullif("_vs", F.lit(0.0))
    return df.withColumn("pf", F.col("_fs") / n).withColumn("po", F.col("_os") / n).drop("_v", "_f", "_o", "_vs", "_fs", "_os")


def fss(df: DataFrame, fc: str, obs: str, threshold: float, k: int, by: Sequence[str], valid: str, groups: Sequence[str] = (), centre: Column | None = None) -> DataFrame:
    """Fractions skill score: fractions from the full grid, summed over the valid centres (of `centre`, if given)."""
    parts = fss_parts(aligned(df, by), fc, obs, threshold, k, by, valid).where(F.col(valid) if centre is None else F.col(valid) & centre)
    diff = F.sum((F.col("pf") - F.col("po")) * (F.col("pf") - F.col("po")))
    norm = F.sum(F.col("pf") * F.col("pf") + F.col("po") * F.col("po"))
    return parts.groupBy(*groups).agg((1 - diff / F.nullif(norm, F.lit(0.0))).alias("fss"), F.count("*").alias("n"))


def distance_to_sea(cells: DataFrame, step: float) -> DataFrame:
    """(cell, coast_km): Euclidean distance in cells to the nearest sea cell, 0 over sea, null without any sea.

    Rows of a static grid, whose number belongs to the grid: each column's nearest sea cell first, then
    the columns of each row, so that a cell meets one candidate per column and not every sea cell.
    """
    col = Window.partitionBy("ix").orderBy("iy")
    up = F.last(F.when(~F.col("land"), F.col("iy")), ignorenulls=True).over(col.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(F.when(~F.col("land"), F.col("iy")), ignorenulls=True).over(col.rowsBetween(0, Window.unboundedFollowing))
    near = cells.withColumn("_g", F.least(F.col("iy") - up, down - F.col("iy")))
    row = near.groupBy("iy").agg(F.collect_list(F.struct("ix", "_g")).alias("_cols"))  # as many as the grid has columns
    best = F.array_min(F.transform(F.filter("_cols", lambda c: c["_g"].isNotNull()), lambda c: F.sqrt(((c["ix"] - F.col("ix")) * (c["ix"] - F.col("ix")) + c["_g"] * c["_g"]).cast("double"))))
    return near.join(row, "iy").select("cell", (best * step * 111.0).alias("coast_km"))
