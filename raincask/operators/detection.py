"""Low-pressure systems on grids of any size: tiles with halos, one exchange, then the few candidates of a time.

Each cell is sent to the tiles whose halo it lies in; a tile is a bounded array whatever the grid, and
decides its own cells alone. Every number of a cell is made from the same neighbours in the same order
in whatever tile, so results do not depend on the tiling. Beyond the grid's edge the background
repeats the edge, rings are open, and minima and maxima see nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rain
from .focal import gaussian_kernel


@dataclass(frozen=True)
class Grid:
    """rows x columns from (lat, lon) northwards and eastwards, `res` degrees apart."""

    rows: int
    columns: int
    lat: float
    lon: float
    res: float


@dataclass(frozen=True)
class Gates:
    """What a centre has to pass (hPa, 1e-5 a second, degrees), and the box (south, north, west, east) that is searched."""

    box: tuple[float, float, float, float]
    sigma_cells: float = 8.0
    residual: float = 1.5
    vorticity: float = 1.0
    depth: float = 2.0
    ring_degrees: float = 3.0
    separation_degrees: float = 4.0
    most: int = 12


FIELDS = ("mslp", "u", "v")
CANDIDATE = "time timestamp_ntz, iy int, ix int, lat double, lon double, mslp double, residual double, depth double, vorticity double, wind double"
AUDIT = "minima long, with_vorticity long, with_ring long, least_residual double, most_vorticity double, most_depth double"


def _shifted(a: np.ndarray, dy: int, dx: int, inner: tuple[slice, slice]) -> np.ndarray:
    """The cells of `inner`, each replaced by its neighbour (dy, dx); a has room for it."""
    (y, x) = inner
    return a[y.start + dy : y.stop + dy, x.start + dx : x.stop + dx]


def _window(a: np.ndarray, half: int, pick, fill: float) -> np.ndarray:
    """pick (np.minimum or np.maximum) over the square of 2 half + 1 cells; outside the array is `fill`."""
    for axis in (0, 1):
        wide = np.pad(a, [(half, half) if k == axis else (0, 0) for k in (0, 1)], constant_values=fill)
        out = wide.take(range(a.shape[axis]), axis)
        for o in range(1, 2 * half + 1):
            out = pick(out, wide.take(range(o, o + a.shape[axis]), axis))
        a = out
    return a


def _slope(a: np.ndarray, axis: int, first: bool, last: bool) -> np.ndarray:
    """Central differences a cell; one-sided at an end that is the grid's own edge."""
    out = np.full(a.shape, np.nan)
    n = a.shape[axis]
    at = lambda s: tuple(s if k == axis else slice(None) for k in (0, 1))
    if n > 2:
        out[at(slice(1, n - 1))] = (a[at(slice(2, n))] - a[at(slice(0, n - 2))]) / 2
    if first and n > 1:
        out[at(slice(0, 1))] = a[at(slice(1, 2))] - a[at(slice(0, 1))]
    if last and n > 1:
        out[at(slice(n - 1, n))] = a[at(slice(n - 1, n))] - a[at(slice(n - 2, n - 1))]
    return out


def tile_fields(fields: dict[str, np.ndarray], y0: int, x0: int, grid: Grid, gates: Gates) -> dict[str, np.ndarray]:
    """Everything a gate needs for the cells of an array whose first cell is (y0, x0) of the grid.

    Right for cells that are a halo away from each side that is not the grid's own edge.
    """
    p, u, v = (fields[c] for c in FIELDS)
    top, left, bottom, right = y0 == 0, x0 == 0, y0 + p.shape[0] == grid.rows, x0 + p.shape[1] == grid.columns
    kernel = gaussian_kernel(gates.sigma_cells)
    half = len(kernel) // 2
    background = p
    for axis in (0, 1):  # what lies beyond a tile's side repeats too, but only its halo sees that
        wide = np.pad(background, [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        total = np.zeros(p.shape)
        for o, w in enumerate(kernel):
            total += w * wide.take(range(o, o + p.shape[axis]), axis)
        background = total
    residual = p - background
    lat = grid.lat + grid.res * (y0 + np.arange(p.shape[0]))
    north = grid.res * 111e3
    east = (north * np.cos(np.radians(lat)))[:, None]
    vorticity = (_slope(v, 1, left, right) / east - _slope(u, 0, top, bottom) / north) * 1e5
    r = max(1, round(gates.ring_degrees / grid.res))
    wide = np.pad(p, r, constant_values=-np.inf)
    ring = np.full(p.shape, np.inf)
    inner = (slice(r, r + p.shape[0]), slice(r, r + p.shape[1]))
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if r == 1 or r in (abs(dy), abs(dx))]
    for dy, dx in offsets:
        ring = np.minimum(ring, _shifted(wide, dy, dx, inner))
    return {
        "residual": residual, "vorticity": vorticity, "depth": ring - p, "wind": _window(np.hypot(u, v), r, np.maximum, -np.inf), "low": _window(residual, 3, np.minimum, np.inf),
        "lat": np.repeat(lat[:, None], p.shape[1], 1), "lon": np.repeat((grid.lon + grid.res * (x0 + np.arange(p.shape[1])))[None, :], p.shape[0], 0),
    }


def halo(grid: Grid, gates: Gates) -> int:
    return max(len(gaussian_kernel(gates.sigma_cells)) // 2 + 3, max(1, round(gates.ring_degrees / grid.res)), 1)


def detect(cells: DataFrame, grid: Grid, gates: Gates, tile: int = 256, fill: tuple[float, float, float] | None = None) -> DataFrame:
    """cells (time, iy, ix, mslp, u, v) -> a row a tile that has cells: time, candidates (all that pass the gates), and the tile's audit.

    Cells that are not there have `fill` as their fields, or are missing: a cell with a missing
    neighbour that counts is no candidate. Of repeated cells the last by mslp, u, v counts. Where all is
    `fill` there is neither a low nor a residual, so tiles without cells need no row.
    """
    h = halo(grid, gates)
    low = lambda c: F.greatest(F.floor((F.col(c) - h) / tile), F.lit(0)).cast("int")
    high = lambda c, n: F.least(F.floor((F.col(c) + h) / tile), F.lit((n - 1) // tile)).cast("int")
    sent = cells.select(F.col("time").cast("timestamp_ntz").alias("time"), F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), *(F.col(c).cast("double").alias(c) for c in FIELDS))
    sent = sent.where(F.col("iy").between(0, grid.rows - 1) & F.col("ix").between(0, grid.columns - 1))
    sent = sent.withColumn("ty", F.explode(F.sequence(low("iy"), high("iy", grid.rows)))).withColumn("tx", F.explode(F.sequence(low("ix"), high("ix", grid.columns))))
    south, north, west, east = gates.box

    def run(key, pdf):
        import pandas as pd

        time, ty, tx = key
        y = slice(max(0, ty * tile - h), min(grid.rows, (ty + 1) * tile + h))
        x = slice(max(0, tx * tile - h), min(grid.columns, (tx + 1) * tile + h))
        pdf = pdf.sort_values(list(FIELDS), kind="stable")
        fields = {}
        for c, default in zip(FIELDS, fill or (np.nan,) * 3):
            fields[c] = np.full((y.stop - y.start, x.stop - x.start), default)
            fields[c][pdf["iy"] - y.start, pdf["ix"] - x.start] = pdf[c]
        own = (slice(ty * tile - y.start, min(grid.rows, (ty + 1) * tile) - y.start), slice(tx * tile - x.start, min(grid.columns, (tx + 1) * tile) - x.start))
        with np.errstate(invalid="ignore"):
            made = {c: a[own] for c, a in tile_fields(fields, y.start, x.start, grid, gates).items()}
            searched = (made["lat"] >= south) & (made["lat"] <= north) & (made["lon"] >= west) & (made["lon"] <= east)
            minima = (made["residual"] == made["low"]) & searched & (made["residual"] <= -gates.residual)
            turning = minima & (made["vorticity"] >= gates.vorticity)
            closed = turning & (made["depth"] >= gates.depth)
        best = lambda a, some, pick: float(pick(a[some])) if some.any() else np.nan
        seen = searched & ~np.isnan(made["residual"]) & ~np.isnan(made["vorticity"])
        rows, columns = np.nonzero(closed)
        found = pd.DataFrame({"time": [time] * len(rows), "iy": rows + ty * tile, "ix": columns + tx * tile, "mslp": fields["mslp"][own][closed], **{c: made[c][closed] for c in ("lat", "lon", "residual", "depth", "vorticity", "wind")}})
        audit = [int(minima.sum()), int(turning.sum()), int(closed.sum()), best(made["residual"], seen, np.min), best(made["vorticity"], seen, np.max), best(made["depth"], turning, np.max)]
        order = ["time", "iy", "ix", "lat", "lon", "mslp", "residual", "depth", "vorticity", "wind"]
        return pd.DataFrame([[time, found[order].to_dict("records"), *audit]], columns=["time", "candidates", *(a.split()[0] for a in AUDIT.split(", "))])

    return sent.groupBy("time", "ty", "tx").applyInPandas(run, f"time timestamp_ntz, candidates array<struct<{', '.join(c.replace(' ', ': ', 1) for c in CANDIDATE.split(', '))}>>, {AUDIT}")


def separate(most: int, degrees: float):
    """For applyInPandas over the candidates of one time: the deepest residual is taken and clears its surroundings, again and again."""

    def rounds(pdf) -> Iterator[int]:
        lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
        left = np.ones(len(pdf), bool)
        order = np.lexsort((pdf["ix"], pdf["iy"], pdf["residual"]))
        for _ in range(most):
            remaining = order[left[order]]
            if not len(remaining):
                return
            yield (deepest := remaining[0])
            left &= np.hypot(lat - lat[deepest], lon - lon[deepest]) >= degrees

    return lambda pdf: pdf.iloc[list(rounds(pdf))]


def systems(tiles: DataFrame, gates: Gates) -> DataFrame:
    """The accepted centres of each time, with their class."""
    found = tiles.select(F.inline("candidates"))
    kept = found.groupBy("time").applyInPandas(separate(gates.most, gates.separation_degrees), CANDIDATE)
    return kept.withColumn("class", rain.system_class(F.col("depth"), F.col("vorticity"), F.col("wind")))


def audit(tiles: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row a time: what survives each gate in turn, the extremes that were seen, and how many centres were accepted."""
    sums = [F.sum(c).alias(c) for c in ("minima", "with_vorticity", "with_ring")]
    most = lambda c: F.max(F.nanvl(c, F.lit(None).cast("double"))).alias(c)
    out = tiles.groupBy("time").agg(*sums, F.min(F.nanvl("least_residual", F.lit(None).cast("double"))).alias("least_residual"), most("most_vorticity"), most("most_depth"))
    return out.join(accepted.groupBy("time").agg(F.count("*").alias("accepted")), "time", "left").na.fill(0, ["accepted"])
