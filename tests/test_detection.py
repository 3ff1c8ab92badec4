"""Systems on tiles: the same at any tile size, and by hand for every cell of a small grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincask.operators import detection as D
from raincask.plans import registry

GRID = D.Grid(rows=90, columns=130, lat=5.0, lon=60.0, res=0.25)
GATES = D.Gates(box=(8.0, 26.0, 62.0, 91.0), sigma_cells=3.0, ring_degrees=1.0, residual=1.0, vorticity=0.5, depth=1.0, separation_degrees=2.0, most=6)


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(8)
    y, x = np.mgrid[: GRID.rows, : GRID.columns]
    p, u, v = 1008 + 0.2 * rng.normal(size=y.shape).cumsum(0) / 9, rng.normal(size=y.shape), rng.normal(size=y.shape)
    for _ in range(14):
        cy, cx, s = rng.integers(0, GRID.rows), rng.integers(0, GRID.columns), rng.uniform(3, 9)
        bump = np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 9)
        p, u, v = p - s * bump, u - 3 * s * (y - cy) * bump / 3, v + 3 * s * (x - cx) * bump / 3
    return p, u, v


@pytest.fixture(scope="module")
def cells(spark, world):
    import pandas as pd

    y, x = np.mgrid[: GRID.rows, : GRID.columns]
    return spark.createDataFrame(pd.DataFrame({"time": pd.Timestamp("2024-07-01 03:00"), "iy": y.ravel(), "ix": x.ravel(), **{c: a.ravel() for c, a in zip(D.FIELDS, world)}})).repartition(4).cache()


def outcome(cells, tile):
    tiles = D.detect(cells, GRID, GATES, tile).cache()
    found = D.systems(tiles, GATES)
    every = sorted(tuple(r) for r in tiles.select(F.inline("candidates")).collect())
    return every, sorted(tuple(r) for r in found.collect()), [tuple(r) for r in D.audit(tiles, found).collect()]


def test_any_tiling_gives_the_same(cells):
    whole = outcome(cells, 1000)
    assert len(whole[0]) > 4 and whole[2][0][1] > whole[2][0][3] > 0
    for tile in (17, 40):
        assert outcome(cells, tile) == whole  # to the last bit


def test_candidates_by_hand(cells, world):
    p, u, v = world
    rows, columns = p.shape
    k = [math.exp(-0.5 * (o / 3.0) ** 2) for o in range(-12, 13)]
    k = np.array(k) / sum(k)
    clamp = lambda i, n: min(max(i, 0), n - 1)
    across = np.array([[sum(k[o + 12] * p[clamp(i + o, rows), j] for o in range(-12, 13)) for j in range(columns)] for i in range(rows)])
    background = np.array([[sum(k[o + 12] * across[i, clamp(j + o, columns)] for o in range(-12, 13)) for j in range(columns)] for i in range(rows)])
    residual, r = p - background, 4
    lat, lon = 5.0 + 0.25 * np.arange(rows), 60.0 + 0.25 * np.arange(columns)
    vort = (np.gradient(v)[1] / (0.25 * 111e3 * np.cos(np.radians(lat)))[:, None] - np.gradient(u)[0] / (0.25 * 111e3)) * 1e5
    want, minima = {}, 0
    for i in range(rows):
        for j in range(columns):
            if not (8 <= lat[i] <= 26 and 62 <= lon[j] <= 91) or residual[i, j] > -1.0 or residual[i, j] > residual[max(0, i - 3) : i + 4, max(0, j - 3) : j + 4].min():
                continue
            minima += 1
            inside = r <= i < rows - r and r <= j < columns - r
            ring = min(p[a, b] for a in range(i - r, i + r + 1) for b in range(j - r, j + r + 1) if r in (abs(a - i), abs(b - j))) if inside else -math.inf
            if vort[i, j] >= 0.5 and ring - p[i, j] >= 1.0:
                want[(i, j)] = (residual[i, j], ring - p[i, j], vort[i, j], np.hypot(u, v)[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1].max())
    tiles = D.detect(cells, GRID, GATES, 33)
    got = {(c.iy, c.ix): (c.residual, c.depth, c.vorticity, c.wind) for c in tiles.select(F.inline("candidates")).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-8) for c in want)
    taken = []
    for c in sorted(want, key=lambda c: (want[c][0], c)):
        if len(taken) < 6 and all(math.hypot(lat[c[0]] - lat[o[0]], lon[c[1]] - lon[o[1]]) >= 2.0 for o in taken):
            taken.append(c)
    found = D.systems(tiles, GATES)
    assert {(s.iy, s.ix) for s in found.collect()} == set(taken)
    told = D.audit(tiles, found).first()
    box = (lat[:, None] >= 8) & (lat[:, None] <= 26) & (lon[None, :] >= 62) & (lon[None, :] <= 91)
    assert (told.minima, told.with_ring, told.accepted) == (minima, len(want), len(taken))
    assert told.least_residual == pytest.approx(residual[box].min(), abs=1e-9) and told.most_vorticity == pytest.approx(vort[box].max(), abs=1e-9)


def test_cells_that_are_not_there(spark, cells):
    holes = cells.where("iy % 11 != 0")
    with_holes, filled = D.detect(holes, GRID, GATES, 40), D.detect(holes, GRID, GATES, 40, fill=(1008.0, 0.0, 0.0))
    assert with_holes.select(F.inline("candidates")).count() == 0 and filled.select(F.sum("minima")).first()[0] > 0
    assert D.detect(cells.limit(0), GRID, GATES, 40).count() == 0


def test_query_on_a_large_grid_is_the_same_at_another_tile_size(spark, monkeypatch):
    from raincask.plans import q_regimes

    one = sorted(map(tuple, registry.QUERIES["r01_tiled_systems"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(q_regimes, "TILE", 301)
    assert one and one == sorted(map(tuple, registry.QUERIES["r01_tiled_systems"](spark, "/root/testdata/sf0.001").collect()))
