"""Nearest rows in blocks against distances by hand."""

import math

import numpy as np
import pytest

from raincask.operators import lookup


def test_nearest_in_blocks_of_any_size(spark, monkeypatch):
    """Several blocks give what pairs by hand give, with ties, a huge vector, and vectors and components that are not there."""
    monkeypatch.setattr(lookup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(lookup, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(150)] + [(150, 0, None), (151, 1, [1.0, None, 2.0]), (152, 0, [1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, g int, v array<double>")
    got = {(r.query, r["rank"]): (r.neighbour, r.distance) for r in lookup.nearest(df.where("i % 10 = 0"), df, ["g"], "i", "i", "v", 100).collect()}

    def apart(a, b):
        both = [(x - y) * (x - y) for x, y in zip(a or [], b or []) if x is not None and y is not None]
        return math.sqrt(sum(both)) if both else None

    for i, g, v in rows[::10]:
        near = sorted((d is None, d or 0.0, j) for j, h, w in rows if h == g and j != i for d in [apart(v, w)])[:100]
        assert [got[i, k + 1] for k in range(len(near))] == [(j, None if gone else pytest.approx(d)) for gone, d, j in near]


def test_nearest_lines_of_many_boxes(spark, monkeypatch):
    """Lines in boxes stand for as many rows as their weight says; queries far from all lines find them, too."""
    monkeypatch.setattr(lookup, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(4)
    v = np.unique(rng.normal(0, 1, (600, 3)).round(1), axis=0)
    n = rng.integers(1, 9, len(v))
    lines = spark.createDataFrame([(0, [float(c) for c in x], int(k)) for x, k in zip(v, n)], "g int, v array<double>, n long")
    asked = [*v[:40], np.array([9.0, -9.0, 0.0])]
    got = lookup.nearest_lines(spark.createDataFrame([(0, [float(c) for c in x], 25) for x in asked], "g int, v array<double>, need long"), lines, ["g"], "v", "need", "n").collect()
    for x in asked:
        want = np.repeat(np.sqrt(((v - x) ** 2).sum(axis=1)), n)
        mine = sorted(d for r in got if np.allclose(r.v, x, rtol=0, atol=0) for d in [r.distance] * r.n)
        assert np.allclose(mine[:25], np.sort(want)[:25])
