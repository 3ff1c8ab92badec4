"""Queries of the neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rain
from ..operators import focal as W
from ..operators.scores import rounded as R6
from .book import query
from .views import cells, sql, tiled

S = lambda c: c.cast("string")
NY, NX = 10, 15
#: Members of a grid of ten rows of fifteen cells; all cells belong to one.
BY = ["label", "member"]
GRID = "g AS (SELECT label, member, cell, iy, ix, lat, lon, land, elev, fc, obs, valid FROM tiled)"


def grid(spark, d):
    return W.aligned(tiled(spark, d), BY)


def out(df, *cols, places=5):
    return R6(df.select(S(F.col("label")).alias("label"), "cell", *cols), places)


def box_sql(k, agg):
    h = k // 2
    return f"""SELECT CAST(a.label AS VARCHAR) AS label, a.cell, {agg} FROM g a JOIN g b ON a.label = b.label AND a.member = b.member AND b.iy BETWEEN a.iy - {h} AND a.iy + {h} AND b.ix BETWEEN a.ix - {h} AND a.ix + {h} GROUP BY 1, 2"""


def clamp_sql(k):
    h = k // 2
    return f"""o AS (SELECT unnest(range(-{h}, {h} + 1)) AS o), e AS (SELECT label, member, cell, least(greatest(iy + a.o, 0), (SELECT max(iy) FROM g)) AS y, least(greatest(ix + b.o, 0), (SELECT max(ix) FROM g)) AS x FROM g, o a, o b)
    SELECT CAST(e.label AS VARCHAR) AS label, e.cell, round(avg(g.fc), 8) AS mean FROM e JOIN g ON g.label = e.label AND g.member = e.member AND g.iy = e.y AND g.ix = e.x GROUP BY 1, 2"""


for K in (3, 5, 9):
    @query(f"w01_focal_mean_{K}", sql(f"WITH {GRID}, {clamp_sql(K)}", "tiled"))
    def w01(spark, d, k=K):
        """Box mean with replicated edges, in two passes."""
        return out(W.focal_mean(grid(spark, d), "fc", k, BY, "mean", NY, NX), "mean", places=8)


for K in (5, 9):
    @query(f"w02_focal_max_{K}", sql(f"WITH {GRID} {box_sql(K, 'round(max(b.fc), 5) AS most')}", "tiled"))
    def w02(spark, d, k=K):
        return out(W.focal_extreme(grid(spark, d), "fc", k, BY, "most", True), "most")


KERNEL = W.gaussian_kernel(2.0)


@query("w03_gaussian", sql(f"""WITH {GRID}, k AS (SELECT * FROM (VALUES {', '.join(f'({i - len(KERNEL) // 2}, {w!r}::DOUBLE)' for i, w in enumerate(KERNEL))}) v(o, w)),
    r AS (SELECT a.label, a.member, a.cell, a.iy, a.ix, sum(w * b.fc) AS v FROM g a CROSS JOIN k JOIN g b ON b.label = a.label AND b.member = a.member AND b.ix = a.ix AND b.iy = least(greatest(a.iy + o, 0), (SELECT max(iy) FROM g)) GROUP BY 1, 2, 3, 4, 5)
    SELECT CAST(a.label AS VARCHAR) AS label, a.cell, round(sum(w * b.v), 5) AS background FROM r a CROSS JOIN k JOIN r b ON b.label = a.label AND b.member = a.member AND b.iy = a.iy AND b.ix = least(greatest(a.ix + o, 0), (SELECT max(ix) FROM g)) GROUP BY 1, 2""", "tiled"))
def w03(spark, d):
    return out(W.gaussian(grid(spark, d), "fc", 2.0, BY, "background", NY, NX), "background")


@query("w04_ring_minimum", sql(f"""WITH {GRID} SELECT CAST(a.label AS VARCHAR) AS label, a.cell, CASE WHEN count(*) = 16 THEN min(b.fc) END AS ring FROM g a LEFT JOIN g b ON a.label = b.label AND a.member = b.member AND greatest(abs(a.iy - b.iy), abs(a.ix - b.ix)) = 2 GROUP BY 1, 2""", "tiled"))
def w04(spark, d):
    return out(W.ring_minimum(grid(spark, d), "fc", 2, BY, "ring"), "ring")


@query("w05_local_minimum", sql(f"WITH {GRID} {box_sql(7, 'min(b.fc) = any_value(a.fc) AS is_minimum')}", "tiled"))
def w05(spark, d):
    m = W.focal_extreme(grid(spark, d), "fc", 7, BY, "m", False)
    return out(m.withColumn("is_minimum", F.col("m") == F.col("fc")), "is_minimum")


@query("w06_gradient", sql(f"""WITH {GRID}, d AS (SELECT label, cell, lat, fc, lag(fc) OVER y AS a, lead(fc) OVER y AS b, lag(fc) OVER x AS c, lead(fc) OVER x AS e FROM g WINDOW y AS (PARTITION BY label, member, ix ORDER BY iy), x AS (PARTITION BY label, member, iy ORDER BY ix))
    SELECT CAST(label AS VARCHAR) AS label, cell, round(sqrt(pow(CASE WHEN c IS NULL THEN e - fc WHEN e IS NULL THEN fc - c ELSE (e - c) / 2 END / cos(radians(lat)), 2) + pow(CASE WHEN a IS NULL THEN b - fc WHEN b IS NULL THEN fc - a ELSE (b - a) / 2 END, 2)) / 2.0, 5) AS gradient FROM d""", "tiled"))
def w06(spark, d):
    return out(W.gradient_magnitude(grid(spark, d), "fc", 2.0, BY, "gradient"), "gradient")


def fss_sql(threshold, k, groups="", centre="TRUE"):
    h = k // 2
    by = f"{groups}, " if groups else ""
    return f"""WITH {GRID}, m AS (SELECT *, valid AND land AS ok FROM g), p AS (SELECT a.label, a.cell, any_value(a.ok) AS ok, sum((b.ok AND b.fc >= {threshold})::INT) / nullif(sum(b.ok::INT), 0)::DOUBLE AS pf, sum((b.ok AND b.obs >= {threshold})::INT) / nullif(sum(b.ok::INT), 0)::DOUBLE AS po
        FROM m a JOIN m b ON a.label = b.label AND a.member = b.member AND b.iy BETWEEN a.iy - {h} AND a.iy + {h} AND b.ix BETWEEN a.ix - {h} AND a.ix + {h} GROUP BY 1, 2)
        SELECT {by}round(1 - sum((pf - po) * (pf - po)) / nullif(sum(pf * pf + po * po), 0), 6) AS fss, count(*) AS n FROM (SELECT *, CAST(cell % 3 AS INT) AS regime FROM p) WHERE ok AND {centre} GROUP BY {groups or 'ALL'}"""


for K in (1, 3, 5, 9):
    @query(f"a05_fss_{K}", sql(fss_sql(64.5, K), "tiled"))
    def a05(spark, d, k=K):
        g = grid(spark, d).withColumn("ok", F.col("valid") & F.col("land"))
        return R6(W.fss(g, "fc", "obs", 64.5, k, BY, "ok"))


@query("a06_grouped_fss", sql(fss_sql(15.6, 3, "regime"), "tiled"))
def a06(spark, d):
    """Fractions from the full grid, scored at the centres of each regime only."""
    g = grid(spark, d).withColumn("ok", F.col("valid") & F.col("land")).withColumn("regime", (F.col("cell") % 3).cast("int"))
    return R6(W.fss(g, "fc", "obs", 15.6, 3, BY, "ok", ["regime"]))


@query("w15_distance_to_sea", sql("SELECT a.cell, round(min(sqrt(pow(a.iy - b.iy, 2) + pow(a.ix - b.ix, 2))) * 0.25 * 111, 5) AS coast_km FROM cells a JOIN cells b ON NOT b.land GROUP BY a.cell", "cells"))
def w15(spark, d):
    return R6(W.distance_to_sea(cells(spark, d), 0.25), 5)


@query("p15_upslope_onshore", sql(f"""WITH {GRID}, c AS (SELECT DISTINCT cell, member, iy, ix, lat, elev FROM g), d AS (SELECT *, lag(elev) OVER y AS a, lead(elev) OVER y AS b, lag(elev) OVER x AS c0, lead(elev) OVER x AS e FROM c WINDOW y AS (PARTITION BY member, ix ORDER BY iy), x AS (PARTITION BY member, iy ORDER BY ix))
    SELECT cell, round((5 * CASE WHEN c0 IS NULL THEN e - elev WHEN e IS NULL THEN elev - c0 ELSE (e - c0) / 2 END / (222000 * cos(radians(lat))) + 3 * CASE WHEN a IS NULL THEN b - elev WHEN b IS NULL THEN elev - a ELSE (b - a) / 2 END / 222000.0) * 1000, 5) AS upslope FROM d""", "tiled"))
def p15(spark, d):
    """u dh/dx + v dh/dy for a constant wind of (5, 3), in mm/s."""
    c = cells(spark, d).withColumn("member", F.floor(F.col("iy") / 10).cast("int")).withColumn("iy", F.col("iy") % 10)
    g = W.central_difference(W.central_difference(c, "elev", "iy", "ix", ["member"], "gy"), "elev", "ix", "iy", ["member"], "gx")
    metres = 2.0 * 111_000
    return R6(g.select("cell", ((5 * F.col("gx") / (metres * F.cos(F.radians("lat"))) + 3 * F.col("gy") / metres) * 1000).alias("upslope")), 5)


@query("s32_static_grid", sql(f"""WITH {GRID}, c AS (SELECT DISTINCT cell, member, iy, ix, lat, elev FROM g), d AS (SELECT *, lag(elev) OVER y AS a, lead(elev) OVER y AS b, lag(elev) OVER x AS c0, lead(elev) OVER x AS e FROM c WINDOW y AS (PARTITION BY member, ix ORDER BY iy), x AS (PARTITION BY member, iy ORDER BY ix)),
    s AS (SELECT cell, CASE WHEN c0 IS NULL THEN e - elev WHEN e IS NULL THEN elev - c0 ELSE (e - c0) / 2 END / (222000 * cos(radians(lat))) AS zx, CASE WHEN a IS NULL THEN b - elev WHEN b IS NULL THEN elev - a ELSE (b - a) / 2 END / 222000.0 AS zy FROM d)
    SELECT cell, round(degrees(atan(sqrt(zx * zx + zy * zy))), 5) AS slope, round(CASE WHEN sqrt(zx * zx + zy * zy) < 1e-12 THEN 0 ELSE (degrees(atan2(-zx, -zy)) + 360) - 360 * floor((degrees(atan2(-zx, -zy)) + 360) / 360) END, 5) AS aspect FROM s""", "tiled"))
def s32(spark, d):
    """Slope and downslope aspect, clockwise from north."""
    c = cells(spark, d).withColumn("member", F.floor(F.col("iy") / 10).cast("int")).withColumn("iy", F.col("iy") % 10)
    g = W.central_difference(W.central_difference(c, "elev", "iy", "ix", ["member"], "gy"), "elev", "ix", "iy", ["member"], "gx")
    zx, zy = F.col("gx") / (222_000 * F.cos(F.radians("lat"))), F.col("gy") / 222_000
    size = F.hypot(zx, zy)
    return R6(g.select("cell", F.degrees(F.atan(size)).alias("slope"), F.when(size < 1e-12, 0.0).otherwise(F.pmod(F.degrees(F.atan2(-zx, -zy)) + 360, F.lit(360.0))).alias("aspect")), 5)
