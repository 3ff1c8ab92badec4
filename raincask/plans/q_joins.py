"""Queries of joins, alignment, regridding, districts, analogues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rain, space
from ..functions.windows import forecast_window
from ..operators import pairing as P
from ..operators import regrid as G
from ..operators.lookup import fallback_lookup, lookup, nearest
from ..operators.scores import rounded as R6
from .book import query
from .q_columns import WARNING
from .views import cells, dense, ladder, paired, pairs, sql, table, tiled, windowed

S = lambda c: c.cast("string")


def sides(spark, d):
    p = windowed(pairs(spark, d))
    return p.where("fc IS NOT NULL").select("cell", "valid_start", "valid_end", "fc"), p.where("obs IS NOT NULL").select("cell", "valid_start", "valid_end", "obs")


SIDES = "f AS (SELECT cell, label + INTERVAL 3 HOUR AS s, fc FROM pairs WHERE fc IS NOT NULL), o AS (SELECT cell, label + INTERVAL 3 HOUR AS s, obs FROM pairs WHERE obs IS NOT NULL)"


@query("j01_window_join", sql(f"WITH {SIDES} SELECT cell, CAST(s AS VARCHAR) AS valid_start, fc, obs FROM f JOIN o USING (cell, s)", "pairs"))
def j01(spark, d):
    """Equality on both ends of the window, on unique candidates."""
    f, o = sides(spark, d)
    P.assert_unique(o, ["cell", "valid_start", "valid_end"], "two observations for a window")
    return P.window_join(f, o, ["cell"]).where("matched").select("cell", S(F.col("valid_start")).alias("valid_start"), "fc", "obs")


@query("j02_align", sql(f"WITH {SIDES} SELECT cell, CAST(s AS VARCHAR) AS valid_start, fc, obs, obs IS NOT NULL AS matched FROM f LEFT JOIN o USING (cell, s)", "pairs"))
def j02(spark, d):
    f, o = sides(spark, d)
    return P.window_join(f, o, ["cell"]).select("cell", S(F.col("valid_start")).alias("valid_start"), "fc", "obs", "matched")


@query("j03_unpaired", sql(f"WITH {SIDES} SELECT cell, CAST(s AS VARCHAR) AS valid_start, CASE WHEN s IN (SELECT s FROM o) THEN 'window without this key' ELSE 'no such window' END AS reason FROM f ANTI JOIN o USING (cell, s)", "pairs"))
def j03(spark, d):
    f, o = sides(spark, d)
    return P.unpaired(f, o, ["cell"]).select("cell", S(F.col("valid_start")).alias("valid_start"), "reason")


@query("j04_lattice_selection", sql("SELECT cell, CAST(iy % 10 AS INT) AS iy, ix, CASE WHEN cell % 5 <> 0 THEN CAST(1000 + (iy % 10) * 15 + ix AS BIGINT) END AS v FROM cells", "cells"))
def j04(spark, d):
    field = spark.range(150).select(F.floor(F.col("id") / 15).cast("int").alias("iy"), (F.col("id") % 15).cast("int").alias("ix"), (1000 + F.col("id")).alias("v"))
    step_y = cells(spark, d).select("cell", "ix", "iy", ((F.col("lat") - 8) * 0.75).alias("lat"), F.when(F.col("cell") % 5 == 0, F.col("lon") + 0.4).otherwise(F.col("lon")).alias("lon")).withColumnsRenamed({"ix": "own_ix", "iy": "own_iy"})
    out = G.select_cells(field, step_y, (0.0, 70.0), 1.5)
    return out.select("cell", (F.col("own_iy") % 10).cast("int").alias("iy"), F.col("own_ix").alias("ix"), "v")


def _weights():
    sy, sx = [8.0 + 2.0 * i for i in range(10)], [70.0 + 1.5 * i for i in range(15)]
    ty, tx = [9.5 + 3.0 * i for i in range(5)], [71.0 + 2.5 * i for i in range(8)]
    return G.overlap_weights(sy, ty, 2.0, 3.0, True), G.overlap_weights(sx, tx, 1.5, 2.5, False)


WY, WX = (", ".join(f"({t}, {s}, {w!r})" for t, s, w in rows) for rows in _weights())
REGRID = f"""wy AS (SELECT * FROM (VALUES {WY}) v(ty, sy, wy)), wx AS (SELECT * FROM (VALUES {WX}) v(tx, sx, wx)), src AS (SELECT label, member, iy, ix, CASE WHEN valid THEN obs END AS obs FROM tiled),
    g AS (SELECT label, member, ty, tx, sum(wy * wx * obs) AS v, sum(CASE WHEN obs IS NOT NULL THEN wy * wx END) AS w FROM src JOIN wy ON iy = sy JOIN wx ON ix = sx GROUP BY 1, 2, 3, 4),
    t AS (SELECT ty, tx, a * b AS full_area FROM (SELECT ty, sum(wy) AS a FROM wy GROUP BY 1), (SELECT tx, sum(wx) AS b FROM wx GROUP BY 1))
    SELECT CAST(label AS VARCHAR) AS label, member, CAST(ty AS INT) AS iy, CAST(tx AS INT) AS ix, round(CASE WHEN w / full_area >= 0.5 - 1e-9 THEN v / w END, 5) AS obs, round(w / full_area, 5) AS covered FROM g JOIN t USING (ty, tx) WHERE w IS NOT NULL"""


@query("j05_conservative_regrid", sql("WITH " + REGRID, "tiled"))
def j05(spark, d):
    wy, wx = _weights()
    src = tiled(spark, d).select("label", "member", "iy", "ix", F.when(F.col("valid"), F.col("obs")).alias("obs"))
    out = G.conservative(src, "obs", G.weight_table(spark, wy, "y"), G.weight_table(spark, wx, "x"), ["label", "member"], 0.5)
    return R6(out.withColumn("label", S(F.col("label"))), 5)


@query("j06_sparse_regrid", sql("WITH " + REGRID.replace("CASE WHEN valid THEN obs END AS obs", "elev AS obs").replace(">= 0.5", ">= 1.0"), "tiled"))
def j06(spark, d):
    """The same with full coverage asked for, as for terrain."""
    wy, wx = _weights()
    src = tiled(spark, d).select("label", "member", "iy", "ix", F.col("elev").alias("obs"))
    return R6(G.conservative(src, "obs", G.weight_table(spark, wy, "y"), G.weight_table(spark, wx, "x"), ["label", "member"], 1.0).withColumn("label", S(F.col("label"))), 5)


@query("a17b_daily_regrid", sql("WITH " + REGRID.replace("CASE WHEN valid THEN obs END AS obs", "CASE WHEN valid THEN (fc + obs) * 12.0 END AS obs").replace("AS obs, round(w / full_area", "AS rain, round(w / full_area"), "tiled"))
def a17b(spark, d):
    """Two half days stand for the granules of a day: their sum where both are there, and then the regridding."""
    wy, wx = _weights()
    both = tiled(spark, d).where("valid").select("label", "member", "iy", "ix", F.explode(F.array("fc", "obs")).alias("rate"))
    out = G.daily_then_regrid(both, "rate", 12.0, 2, G.weight_table(spark, wy, "y"), G.weight_table(spark, wx, "x"), ["label", "member"], 0.5)
    return R6(out.withColumn("label", S(F.col("label"))), 5)


@query("j07_bilinear", sql("""WITH t AS (SELECT * FROM (VALUES (0, 2, 3, 0.25, 0.5), (1, 4, 6, 0.75, 0.125)) v(target, y, x, fy, fx)), c AS (SELECT target, y + dy AS iy, x + dx AS ix, abs(1 - dy - fy) * abs(1 - dx - fx) AS w FROM t, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
    SELECT CAST(target AS INT) AS target, CAST(label AS VARCHAR) AS label, round(sum(w * fc), 10) AS fc FROM dense JOIN c USING (iy, ix) GROUP BY 1, 2 HAVING sum(w) > 1 - 1e-6""", "dense"))
def j07(spark, d):
    targets = spark.createDataFrame([(0, 8 + 2 * 2.25, 70 + 2 * 3.5), (1, 8 + 2 * 4.75, 70 + 2 * 6.125)], "target int, lat double, lon double")
    out = G.bilinear(dense(spark, d).select("label", "iy", "ix", "fc"), "fc", targets, ["label"], (8.0, 70.0), 2.0)
    return R6(out.select("target", S(F.col("label")).alias("label"), "fc"), 10)


TILES = [("A", [(69.0, 8.0), (75.0, 8.0), (75.0, 14.0), (69.0, 14.0)]), ("B", [(76.0, 9.0), (84.0, 11.0), (80.0, 20.0)]), ("C", [(200.0, 50.0), (201.0, 50.0), (201.0, 51.0)])]


# The triangle's overlap is summed by trapezoids between all places where its height within the cell's row bends.
BRIDGE = """c AS (SELECT iy, ix, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM cells WHERE land),
    ra AS (SELECT 'A' AS district, iy, ix, greatest(least(lon + 0.75, 75) - greatest(lon - 0.75, 69), 0) * greatest(least(lat + 0.75, 14) - greatest(lat - 0.75, 8), 0) AS a FROM c),
    x AS (SELECT *, unnest([lon - 0.75, lon + 0.75, 76, 80, 84, 76 + (lat - 9.75) * 4, 76 + (lat - 8.25) * 4, 76 + (lat - 9.75) * 4 / 11, 76 + (lat - 8.25) * 4 / 11, 80 + (20.75 - lat) * 4 / 9, 80 + (19.25 - lat) * 4 / 9]) AS x FROM c),
    k AS (SELECT DISTINCT * FROM x WHERE x BETWEEN greatest(lon - 0.75, 76) AND least(lon + 0.75, 84)),
    h AS (SELECT *, greatest(least(lat + 0.75, CASE WHEN x <= 80 THEN 9 + (x - 76) * 11 / 4 ELSE 20 - (x - 80) * 9 / 4 END) - greatest(lat - 0.75, 9 + (x - 76) / 4), 0) AS high FROM k),
    t AS (SELECT iy, ix, (x - lag(x) OVER w) * (high + lag(high) OVER w) / 2 AS a FROM h WINDOW w AS (PARTITION BY iy, ix ORDER BY x)),
    o AS (SELECT * FROM ra UNION ALL SELECT 'B', iy, ix, sum(a) FROM t GROUP BY iy, ix)"""


@query("j08_district_bridge", sql(f"WITH {BRIDGE} SELECT district, iy, ix, round(a / sum(a) OVER (PARTITION BY district), 6) AS w, false AS fallback FROM o WHERE a > 0 UNION ALL SELECT district, n.iy, n.ix, 1.0, true FROM (SELECT m.district, min({{'away': pow(lat - m.y, 2) + pow(lon - m.x, 2), 'iy': iy, 'ix': ix}}) AS n FROM (VALUES ('A', 72.0, 11.0), ('B', 80.0, 40 / 3.0), ('C', 200.5, 50.5)) m(district, x, y), c WHERE m.district NOT IN (SELECT district FROM o WHERE a > 0) GROUP BY 1)", "cells"))
def j08(spark, d):
    """Polygon and cell overlaps, over all land cells of the grid."""
    return R6(G.bridge(cells(spark, d).where("land"), TILES, 1.5))


INFLUENCE = """SELECT label, cell, code, km, ord FROM (SELECT label, c.cell, s.code, s.ord, round(sqrt(pow((c.lat - s.lat) * 111, 2) + pow((c.lon - s.lon) * 111 * cos(radians(s.lat)), 2)), 4) AS km,
    row_number() OVER (PARTITION BY label, c.cell ORDER BY round(sqrt(pow((c.lat - s.lat) * 111, 2) + pow((c.lon - s.lon) * 111 * cos(radians(s.lat)), 2)), 4), ord) AS k FROM s CROSS JOIN (SELECT cell, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM cells) c) WHERE k = 1"""
CENTRES = "s AS (SELECT label, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CASE WHEN obs >= 150 THEN 2 ELSE 1 END AS code, row_number() OVER (PARTITION BY label ORDER BY obs DESC, cell) AS ord FROM paired QUALIFY ord <= 3)"


def centres(spark, d):
    """Up to three made-up centres a day, the strongest first."""
    w = Window.partitionBy("label").orderBy(F.col("obs").desc(), "cell")
    return paired(spark, d).withColumn("ord", F.row_number().over(w)).where("ord <= 3").select("label", F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.when(F.col("obs") >= 150, 2).otherwise(1).alias("code"), "ord")


@query("j09_system_influence", sql(f"WITH {CENTRES}, i AS ({INFLUENCE}) SELECT CAST(label AS VARCHAR) AS label, cell, CAST(CASE WHEN km <= CASE code WHEN 2 THEN 550 ELSE 350 END THEN code ELSE 0 END AS INT) AS synoptic, km FROM i", "paired"))
def j09(spark, d):
    """Each cell belongs to its nearest centre of the day, and has its class only within that centre's radius."""
    from ..operators.regimes import influence

    out = influence(centres(spark, d), cells(spark, d).select("cell", "lat", "lon"), "label")
    return out.select(S(F.col("label")).alias("label"), "cell", "synoptic", "km")


@query("j10_lookup_default", sql("WITH r AS (SELECT lead, iy, count(*) AS n, round(sum(obs) / sum(tp), 6) AS ratio FROM ladder WHERE ix < 5 AND iy < 8 GROUP BY 1, 2) SELECT l.lead, l.iy, count(*) AS n, round(avg(tp * coalesce(ratio, 1.0)), 5) AS mean FROM ladder l LEFT JOIN r USING (lead, iy) GROUP BY 1, 2", "ladder"))
def j10(spark, d):
    l = ladder(spark, d)
    r = l.where("ix < 5 AND iy < 8").groupBy("lead", "iy").agg(F.round(F.sum("obs") / F.sum("tp"), 6).alias("ratio"))
    return R6(lookup(l, r, ["lead", "iy"], "ratio", 1.0).groupBy("lead", "iy").agg(F.count("*").alias("n"), F.avg(F.col("tp") * F.col("ratio")).alias("mean")), 5)


@query("j11_fallback_lookup", sql("""WITH m AS (SELECT lead, iy AS regime, round(avg(obs), 4) AS v FROM ladder GROUP BY 1, 2 HAVING iy % 3 = 0 UNION ALL SELECT lead, NULL, round(avg(obs), 4) FROM ladder GROUP BY 1)
    SELECT l.lead, l.iy AS regime, coalesce(a.v, b.v) AS v FROM (SELECT DISTINCT lead, iy FROM ladder) l LEFT JOIN m a ON a.lead = l.lead AND a.regime = l.iy LEFT JOIN m b ON b.lead = l.lead AND b.regime IS NULL""", "ladder"))
def j11(spark, d):
    l = ladder(spark, d).withColumnRenamed("iy", "regime")
    m = l.groupingSets([["lead", "regime"], ["lead"]], "lead", "regime").agg(F.round(F.avg("obs"), 4).alias("v")).where("regime IS NULL OR regime % 3 = 0")
    return fallback_lookup(l.select("lead", "regime").distinct(), m, ["lead", "regime"], ["lead"], ["v"])


@query("j12_dataset_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS bal, c_nationkey FROM customer".replace("c_acctbal * 2", "round(c_acctbal * 2, 4)"))
def j12(spark, d):
    """Values of the second table win where it has the key."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), "c_nationkey")
    other = c.where("c_custkey % 3 = 0").select("c_custkey", F.round(F.col("a") * 2, 4).alias("b"))
    return c.join(other, "c_custkey", "left").select("c_custkey", F.coalesce("b", "a").alias("bal"), "c_nationkey")


@query("j13_semi_join", sql("SELECT cell, CAST(label AS VARCHAR) AS label, obs FROM pairs WHERE label IN (SELECT DISTINCT label FROM pairs WHERE day(label) % 5 = 0) AND obs IS NOT NULL", "pairs"))
def j13(spark, d):
    p = pairs(spark, d)
    days = p.select("label").distinct().where(F.dayofmonth("label") % 5 == 0)
    return p.where("obs IS NOT NULL").join(days, "label", "left_semi").select("cell", S(F.col("label")).alias("label"), "obs")


@query("j14_mask_intersection", sql("SELECT cell, land AND lat BETWEEN 18 AND 28 AS scored FROM cells", "cells"))
def j14(spark, d):
    return cells(spark, d).select("cell", (F.col("land") & F.col("lat").between(18, 28)).alias("scored"))


@query("j15_point_lookup", sql("SELECT cell, CAST(label AS VARCHAR) AS label, obs FROM paired WHERE iy = 3 AND ix = 5 AND land", "paired"))
def j15(spark, d):
    """The cell nearest to (14.3 N, 77.4 E) by arithmetic on its coordinates."""
    iy, ix = round((14.3 - 8) / 2), round((77.4 - 70) / 1.5)
    return paired(spark, d).where((F.col("iy") == iy) & (F.col("ix") == ix) & F.col("land")).select("cell", S(F.col("label")).alias("label"), "obs")


@query("j16_analogues", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, a.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, a.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance
    FROM q JOIN embeddings a ON a.label = q.label AND a.vec_id <> q.vec_id) SELECT query, neighbour, CAST(rank AS INT) AS rank, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM p) WHERE rank <= 20""")
def j16(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    out = nearest(e.where("vec_id % 20 = 0"), e, ["label"], "vec_id", "vec_id", "v", 20)
    return R6(out.select("query", "neighbour", "rank", "distance"), 5)


@query("t04_nearest_medians", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, a.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, a.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance
    FROM q JOIN embeddings a ON a.label = q.label AND a.vec_id <> q.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM p) WHERE rank <= 20)
    SELECT query, round(quantile_cont(distance, 0.5), 5) AS median, round(quantile_cont(distance, 0.9), 5) AS p90 FROM k GROUP BY query""")
def t04(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    out = nearest(e.where("vec_id % 20 = 0"), e, ["label"], "vec_id", "vec_id", "v", 20)
    return R6(out.groupBy("query").agg(F.percentile("distance", F.lit(0.5)).alias("median"), F.percentile("distance", F.lit(0.9)).alias("p90")), 5)


@query("a31_district_product", sql(f"""WITH b AS (SELECT c_nationkey AS d, CAST(c_custkey % 150 AS BIGINT) AS cell, 1.0 / count(*) OVER (PARTITION BY c_nationkey) AS w FROM customer), f AS (SELECT cell, max(obs) AS rain, avg((obs >= 64.5)::INT) AS ph, avg((obs >= 115.6)::INT) AS pv FROM paired GROUP BY cell),
    g AS (SELECT d, count(*) AS n_cells, sum(w * coalesce(rain, 0)) AS rain_mean, max(coalesce(rain, 0)) AS most, max(coalesce(ph, 0)) AS ph, max(coalesce(pv, 0)) AS pv FROM b LEFT JOIN f USING (cell) GROUP BY d)
    SELECT d, n_cells, round(rain_mean, 5) AS rain_mean, most, round(ph, 5) AS p_heavy, round(pv, 5) AS p_very, {WARNING} AS warning FROM g""", "paired"))
def a31(spark, d):
    """District values through the bridge, in order of severity and rain."""
    from ..operators.district import district_product

    c = table(spark, d, "customer")
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    bridge = c.join(n, "c_nationkey").select(F.col("c_nationkey").alias("d"), (F.col("c_custkey") % 150).alias("cell"), (1.0 / F.col("n")).alias("w"))
    field = paired(spark, d).groupBy("cell").agg(F.max("obs").alias("rain"), F.avg((F.col("obs") >= 64.5).cast("int")).alias("ph"), F.avg((F.col("obs") >= 115.6).cast("int")).alias("pv"))
    return R6(district_product(bridge, field), 5)


@query("u01_concat", sql("SELECT lead, count(*) AS n FROM (SELECT 1 AS lead, cell FROM paired UNION ALL SELECT 3, cell FROM paired WHERE fc > 50) GROUP BY lead", "paired"))
def u01(spark, d):
    p = paired(spark, d)
    both = p.select(F.lit(1).alias("lead"), "cell").unionByName(p.where("fc > 50").select(F.lit(3).alias("lead"), "cell"))
    return both.groupBy("lead").agg(F.count("*").alias("n"))


@query("u03_missing_times", sql("""WITH f AS (SELECT DISTINCT slot FROM granules), e AS (SELECT unnest(range((SELECT min(slot) FROM f), (SELECT max(slot) FROM f) + 1)) AS slot) SELECT slot, 'missing' AS what FROM e ANTI JOIN f USING (slot)""", "granules"))
def u03(spark, d):
    from .views import granules

    f = granules(spark, d).select("slot").distinct()
    ends = f.agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    expected = ends.select(F.explode(F.sequence("a", "b")).alias("slot"))
    return expected.join(f, "slot", "left_anti").withColumn("what", F.lit("missing"))


@query("u04_common_windows", sql("SELECT CAST(label AS VARCHAR) AS label FROM pairs GROUP BY label HAVING count(fc) > 0 AND count(obs) > 0 AND bool_and(coalesce(fc, 0) >= 0)", "pairs"))
def u04(spark, d):
    p = pairs(spark, d)
    f, o = p.where("fc IS NOT NULL").select("label").distinct(), p.where("obs IS NOT NULL").select("label").distinct()
    fine = p.groupBy("label").agg(F.bool_and(F.coalesce("fc", F.lit(0.0)) >= 0).alias("ok")).where("ok").select("label")
    return f.join(o, "label").join(fine, "label").select(S(F.col("label")).alias("label"))


@query("t05_latest_cycle", "SELECT CAST(max(ts) AS VARCHAR) AS latest, arg_max(event_id, ts) AS event_id FROM events")
def t05(spark, d):
    return table(spark, d, "events").agg(S(F.max("ts")).alias("latest"), F.max_by("event_id", "ts").alias("event_id"))


@query("w12_gap_detection", sql("SELECT slot, CASE WHEN lag(slot) OVER (ORDER BY slot) IS NULL OR lag(slot) OVER (ORDER BY slot) = slot - 1 THEN 'ok' ELSE 'gap' END AS state FROM granules", "granules"))
def w12(spark, d):
    from .views import granules

    g = granules(spark, d).select("slot", F.col("slot").alias("valid_start"), (F.col("slot") + 1).alias("valid_end"))
    return P.contiguous(g).select("slot", "state")


@query("w13_period_audit", sql("WITH e AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS label), f AS (SELECT label, count(*) AS times FROM (SELECT DISTINCT label FROM pairs) GROUP BY 1) SELECT CAST(label AS VARCHAR) AS label, e.label IS NOT NULL AS expected, coalesce(times, 0) AS times FROM (SELECT label FROM e UNION SELECT label FROM f) a LEFT JOIN e USING (label) LEFT JOIN f USING (label)".replace("e.label IS NOT NULL", "label IN (SELECT label FROM e)"), "pairs"))
def w13(spark, d):
    found = pairs(spark, d).select("label").distinct()
    return P.period_audit(found, "2024-01-01", "2024-02-02").select(S(F.col("label")).alias("label"), "expected", "times")


@query("w11_monotonic_chain", "SELECT o_custkey, o_orderkey, coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_totalprice > 0.25, FALSE) AS falls FROM orders")
def w11(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lag("o_totalprice").over(w) - F.col("o_totalprice") > 0.25, F.lit(False)).alias("falls"))
