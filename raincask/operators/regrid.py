"""Moving fields between grids: exact selection, bilinear placement, area-conserving means, district bridges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def overlap_weights(source: list[float], target: list[float], source_step: float, target_step: float, sphere: bool) -> list[tuple[int, int, float]]:
    """(target, source, overlap) of the cells of one axis; on a sphere, latitudes measure by their sines."""
    at = (lambda x: math.sin(math.radians(max(-90.0, min(90.0, x))))) if sphere else (lambda x: x)
    out = []
    for j, t in enumerate(target):
        for i, s in enumerate(source):
            low, high = max(t - target_step / 2, s - source_step / 2), min(t + target_step / 2, s + source_step / 2)
            if high > low + 1e-12:
                out.append((j, i, at(high) - at(low)))
    return out


def weight_table(spark: SparkSession, rows: list[tuple[int, int, float]], axis: str) -> DataFrame:
    """A table of one axis' overlaps: its rows grow with the axis, not with the field."""
    return spark.createDataFrame(rows, f"t{axis} int, s{axis} int, w{axis} double")


def conservative(field: DataFrame, value: str, wy: DataFrame, wx: DataFrame, by: list[str], coverage: float = 1.0) -> DataFrame:
    """Area-weighted mean on the target grid: the two axes' weights apply one after the other.

    field has (by, iy, ix, value). Missing values add no area; a target cell that is covered by less
    than `coverage` of its area is null. The covered share comes with it.
    """
    full = wx.groupBy("tx").agg(F.sum("wx").alias("_x")), wy.groupBy("ty").agg(F.sum("wy").alias("_y"))
    here = field.where(F.col(value).isNotNull())
    rows = here.join(F.broadcast(wx), here["ix"] == F.col("sx")).groupBy(*by, "iy", "tx").agg(F.sum(F.col("wx") * F.col(value)).alias("_v"), F.sum("wx").alias("_w"))
    out = rows.join(F.broadcast(wy), rows["iy"] == F.col("sy")).groupBy(*by, "ty", "tx").agg(F.sum(F.col("wy") * F.col("_v")).alias("_v"), F.sum(F.col("wy") * F.col("_w")).alias("_w"))
    out = out.join(F.broadcast(full[0]), "tx").join(F.broadcast(full[1]), "ty")
    share = F.col("_w") / (F.col("_x") * F.col("_y"))
    return out.select(*by, F.col("ty").alias("iy"), F.col("tx").alias("ix"), F.when(share >= coverage - 1e-9, F.col("_v") / F.col("_w")).alias(value), share.alias("covered"))


def daily_then_regrid(granules: DataFrame, rate: str, hours: float, expected: int, wy: DataFrame, wx: DataFrame, by: list[str], coverage: float = 1.0) -> DataFrame:
    """Sums of `expected` granules of `hours` each, and then the area-weighted mean of the sums on the target grid.

    granules: (by, iy, ix, rate), one row a granule. A cell short of a granule, or with a null, has no sum and adds no area.
    """
    whole = (F.count("*") == expected) & (F.count(rate) == expected)
    days = granules.groupBy(*by, "iy", "ix").agg(F.when(whole, F.sum(rate) * hours).alias("rain"))
    return conservative(days, "rain", wy, wx, by, coverage)


def lattice_index(x: Column, origin: float, step: float, tolerance: float = 1e-4) -> Column:
    """Whole cell number of a coordinate that lies on the lattice, else null; never the nearest cell."""
    k = F.round((x - origin) / step)
    return F.when(F.abs(x - (origin + k * step)) <= tolerance, k.cast("int"))


def select_cells(field: DataFrame, targets: DataFrame, origin: tuple[float, float], step: float) -> DataFrame:
    """The field's values at targets (lat, lon) by exact cell number; targets off the lattice get null."""
    at = targets.withColumn("iy", lattice_index(F.col("lat"), origin[0], step)).withColumn("ix", lattice_index(F.col("lon"), origin[1], step))
    return at.join(field, ["iy", "ix"], "left")


def bilinear(field: DataFrame, value: str, targets: DataFrame, by: list[str], origin: tuple[float, float], step: float) -> DataFrame:
    """Bilinear placement: four neighbours and their weights by one equi-join; a missing neighbour of weight gives null."""
    y, x = (F.col("lat") - origin[0]) / step, (F.col("lon") - origin[1]) / step
    fy, fx = y - F.floor(y), x - F.floor(x)
    corner = lambda dy, dx: F.struct((F.floor(y) + dy).cast("int").alias("iy"), (F.floor(x) + dx).cast("int").alias("ix"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    need = targets.select("target", F.inline(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)))).where("w > 1e-9")
    got = field.join(need, ["iy", "ix"])
    return got.groupBy("target", *by).agg(F.when(F.sum("w") > 1 - 1e-6, F.sum(F.col("w") * F.col(value))).alias(value))


def clip_to_box(polygon: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """A polygon cut to a box, one side after the other."""
    for axis, bound, keep_above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        out = []
        inside = lambda p: p[axis] >= bound if keep_above else p[axis] <= bound  # noqa: B023, E731
        for a, b in zip(polygon, polygon[1:] + polygon[:1]):
            if inside(a):
                out.append(a)
            if inside(a) != inside(b):
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        polygon = out
        if not polygon:
            break
    return polygon


def area(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(polygon, polygon[1:] + polygon[:1]))) / 2 if polygon else 0.0


def bridge_rows(districts: list[tuple[str, list[tuple[float, float]]]], cells: list[tuple[int, int, float, float]], step: float) -> list[tuple[str, int, int, float, bool]]:
    """(district, iy, ix, weight, fallback) of polygon and cell overlaps, normalised within each district.

    `cells` are the valid ones. A district that meets none takes the nearest valid one, and says so.
    """
    out = []
    for name, polygon in districts:
        rows = [(iy, ix, a) for iy, ix, lat, lon in cells if (a := area(clip_to_box(polygon, lon - step / 2, lat - step / 2, lon + step / 2, lat + step / 2))) > 0]
        fallback = not rows
        if fallback and cells:
            cx, cy = (sum(p[k] for p in polygon) / len(polygon) for k in (0, 1))
            iy, ix, *_ = min(cells, key=lambda c: (c[2] - cy) ** 2 + (c[3] - cx) ** 2)
            rows = [(iy, ix, 1.0)]
        total = sum(a for *_, a in rows)
        out += [(name, iy, ix, a / total, fallback) for iy, ix, a in rows]
    return out


def _clipped(points: str, axis: str, bound: Column, keep_above: bool) -> Column:
    """`clip_to_box` for one side, over an array column of points (x, y)."""
    inside = lambda p: p[axis] >= bound if keep_above else p[axis] <= bound
    none = F.slice(F.col(points), 1, 0)

    def edge(a: Column, i: Column) -> Column:
        b = F.element_at(F.col(points), (i + 1) % F.size(points) + 1)
        t = (bound - a[axis]) / (b[axis] - a[axis])
        met = F.struct(*((a[c] + t * (b[c] - a[c])).alias(c) for c in ("x", "y")))
        return F.concat(F.when(inside(a), F.array(a)).otherwise(none), F.when(inside(a) != inside(b), F.array(met)).otherwise(none))

    return F.flatten(F.transform(points, edge))


def near_outlines(cells: DataFrame, outlines: DataFrame, step: float, bucket_cells: int = 8) -> DataFrame:
    """cells (iy, ix, lat, lon) beside the outlines (district, points) whose bounding box their own box meets.

    A hash join on squares of `bucket_cells` cells a side: a cell lies in one, an outline in those of its
    bounding box and half a cell around it. So neither each cell meets each outline, nor has either
    side to be small.
    """
    side, half = step * bucket_cells, step / 2
    ends = [(agg(F.col(f"points.{c}")) + F.lit(d)).alias(f"{c}{n}") for c in ("x", "y") for n, agg, d in (("0", F.array_min, -half), ("1", F.array_max, half))]
    boxed = outlines.select("district", "points", *ends)
    for c in ("x", "y"):
        boxed = boxed.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / side).cast("int"), F.floor(F.col(f"{c}1") / side).cast("int"))))
    placed = cells.select("iy", "ix", "lat", "lon", F.floor(F.col("lon") / side).cast("int").alias("bx"), F.floor(F.col("lat") / side).cast("int").alias("by"))
    met = placed.join(boxed, ["bx", "by"]).where((F.col("lon") >= F.col("x0")) & (F.col("lon") <= F.col("x1")) & (F.col("lat") >= F.col("y0")) & (F.col("lat") <= F.col("y1")))
    return met.select("iy", "ix", "lat", "lon", "district", "points")


def bridge(cells: DataFrame, districts: list[tuple[str, list[tuple[float, float]]]], step: float) -> DataFrame:
    """`bridge_rows` over a table of valid cells (iy, ix, lat, lon); of equally near cells the least (iy, ix) is taken."""
    spark = cells.sparkSession
    met = near_outlines(cells, spark.createDataFrame(districts, "district string, points array<struct<x: double, y: double>>"), step)
    for axis, at in (("x", "lon"), ("y", "lat")):
        for side, above in ((-step / 2, True), (step / 2, False)):
            # explode keeps each step's points from being written out in full wherever the next uses them.
            met = met.withColumn("points", F.explode(F.array(_clipped("points", axis, F.col(at) + side, above))))
    turn = F.transform("points", lambda a, i: a["x"] * F.element_at("points", (i + 1) % F.size("points") + 1)["y"] - F.element_at("points", (i + 1) % F.size("points") + 1)["x"] * a["y"])
    met = met.select("district", "iy", "ix", (F.abs(F.aggregate(turn, F.lit(0.0), lambda n, v: n + v)) / 2).alias("a")).where("a > 0")
    total = met.groupBy("district").agg(F.sum("a").alias("total"))
    own = met.join(F.broadcast(total), "district").select("district", "iy", "ix", (F.col("a") / F.col("total")).alias("w"), F.lit(False).alias("fallback"))
    middles = spark.createDataFrame([(name, *(sum(p[k] for p in polygon) / len(polygon) for k in (0, 1))) for name, polygon in districts], "district string, cx double, cy double")
    lone = F.broadcast(middles.join(total, "district", "left_anti"))
    away = F.pow(F.col("lat") - F.col("cy"), 2) + F.pow(F.col("lon") - F.col("cx"), 2)
    near = cells.crossJoin(lone).groupBy("district").agg(F.min(F.struct(away.alias("away"), "iy", "ix")).alias("c"))
    return own.unionByName(near.select("district", "c.iy", "c.ix", F.lit(1.0).alias("w"), F.lit(True).alias("fallback")))
