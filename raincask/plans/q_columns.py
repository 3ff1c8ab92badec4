"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rain, space
from ..functions import windows as T
from ..operators.scores import rounded as R6
from .book import query
from .views import cells, ladder, paired, pairs, sql, table

S = lambda c: c.cast("string")


@query("p01_forecast_window", sql("SELECT DISTINCT CAST(label AS VARCHAR) AS label, CAST(label + INTERVAL 3 HOUR AS VARCHAR) AS valid_start, CAST(label + INTERVAL 27 HOUR AS VARCHAR) AS valid_end FROM pairs", "pairs"))
def p01(spark, d):
    start, end = T.forecast_window(F.col("label"))
    return pairs(spark, d).select("label").distinct().select(S(F.col("label")).alias("label"), S(start).alias("valid_start"), S(end).alias("valid_end"))


@query("p02_initial_time", sql("SELECT DISTINCT CAST(time AS VARCHAR) AS time, lead, CAST(CAST(time AS DATE) - (lead - 1) AS VARCHAR) AS init, CAST(3 + 24 * (lead - 1) AS INT) AS first_hour FROM ladder", "ladder"))
def p02(spark, d):
    lead = F.col("lead")
    return ladder(spark, d).select("time", "lead").distinct().select(S(F.col("time")).alias("time"), "lead", S(T.initial_time(F.col("time"), lead)).alias("init"), T.first_hour(lead).alias("first_hour"))


@query("p03_sample_hours", sql("SELECT DISTINCT lead, CAST(3 + 24 * (lead - 1) + h AS INT) AS hour FROM ladder CROSS JOIN (SELECT unnest([3, 9, 15, 21]) AS h)", "ladder"))
def p03(spark, d):
    return ladder(spark, d).select("lead").distinct().select("lead", F.explode(T.sample_hours(F.col("lead"))).alias("hour"))


@query("p04_observation_window", sql("""SELECT DISTINCT CAST(label AS VARCHAR) AS label, c AS convention, CAST(label + INTERVAL 3 HOUR - CASE c WHEN 'ending' THEN INTERVAL 24 HOUR ELSE INTERVAL 0 HOUR END AS VARCHAR) AS valid_start,
    CAST(label + INTERVAL 27 HOUR - CASE c WHEN 'ending' THEN INTERVAL 24 HOUR ELSE INTERVAL 0 HOUR END AS VARCHAR) AS valid_end FROM pairs CROSS JOIN (SELECT unnest(['ending', 'starting']) AS c)""", "pairs"))
def p04(spark, d):
    out = None
    days = pairs(spark, d).select("label").distinct()
    for name in T.CONVENTIONS:
        start, end = T.observation_window(F.col("label"), name)
        part = days.select(S(F.col("label")).alias("label"), F.lit(name).alias("convention"), S(start).alias("valid_start"), S(end).alias("valid_end"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p05_inverse_label", sql("SELECT DISTINCT CAST(label + INTERVAL 3 HOUR AS VARCHAR) AS valid_start, CAST(label + 1 AS VARCHAR) AS label FROM pairs", "pairs"))
def p05(spark, d):
    from ..operators.pairing import inverse_labels

    start, end = T.forecast_window(F.col("label"))
    w = pairs(spark, d).select("label").distinct().select(start.alias("valid_start"), end.alias("valid_end"))
    return inverse_labels(w, "ending").select(S(F.col("valid_start")).alias("valid_start"), S(F.col("label")).alias("label"))


@query("p06_season_calendar", """SELECT CAST(y AS INT) AS year, CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM (SELECT unnest([2021, 2022, 2023, 2024]) AS y),
    LATERAL (SELECT unnest(generate_series(make_date(y, 6, 1), make_date(y, 9, 30), INTERVAL 1 DAY)) AS d)""")
def p06(spark, d):
    years = spark.createDataFrame([(y,) for y in (2021, 2022, 2023, 2024)], "year int")
    return years.select("year", F.explode(F.sequence(F.make_date("year", F.lit(6), F.lit(1)), F.make_date("year", F.lit(9), F.lit(30)))).alias("day")).select("year", S(F.col("day")).alias("day"))


@query("p07_longitude_wrap", "SELECT DISTINCT user_id, round(((user_id * 7.5 + 180) % 360 + 360) % 360 - 180, 6)::DOUBLE AS lon FROM events")
def p07(spark, d):
    return R6(table(spark, d, "events").select("user_id").distinct().select("user_id", space.wrap_longitude(F.col("user_id") * 7.5).alias("lon")))


@query("p08_box", sql("SELECT cell, lat BETWEEN 18 AND 28 AND lon BETWEEN 65 AND 88 AS inside FROM cells", "cells"))
def p08(spark, d):
    return cells(spark, d).select("cell", space.in_box(F.col("lat"), F.col("lon"), space.INDEX_BOX).alias("inside"))


@query("p09_region", sql("SELECT DISTINCT cell, region FROM paired", "paired"))
def p09(spark, d):
    return paired(spark, d).select("cell", "region").distinct()


EDGES = ", ".join(f"({x1}, {y1}, {x2}, {y2})" for (x1, y1), (x2, y2) in zip(space.OUTLINE, space.OUTLINE[1:] + space.OUTLINE[:1]))


@query("p10_outline_mask", sql(f"""SELECT cell, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1 AS inside
    FROM (SELECT cell, CAST(lat AS DOUBLE) + 0.01 AS lat, CAST(lon AS DOUBLE) + 0.01 AS lon FROM cells) CROSS JOIN (SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM (VALUES {EDGES}) e(x1, y1, x2, y2)) GROUP BY cell""", "cells"))
def p10(spark, d):
    return cells(spark, d).select("cell", space.inside_outline(F.col("lat") + 0.01, F.col("lon") + 0.01).alias("inside"))


@query("p12_axis", "SELECT CAST(i AS INT) AS i, round(6.5 + i * 0.25, 4)::DOUBLE AS lat FROM (SELECT unnest(range(0, 129)) AS i)")
def p12(spark, d):
    n = len(space.axis(6.5, 38.5, 0.25))
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.round(6.5 + F.col("id") * 0.25, 4).alias("lat"))


def _piecewise_sql(x, knots):
    out = f"CASE WHEN {x} <= {knots[0][0]} THEN {float(knots[0][1])}"
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out += f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE"
    return out + f" ELSE {float(knots[-1][1])} END"


TERRAIN = f"""CASE WHEN lat > 8 AND lat < 21.5 THEN 1100 * exp(-pow((lon - ({_piecewise_sql('lat', space.RIDGE)})) / 0.45, 2)) ELSE 0 END + 4500 / (1 + exp(-(lat - ({_piecewise_sql('lon', space.FOOTHILL)}) - 0.8) / 0.35))
    + 1500 * exp(-(pow((lat - 25.5) / 0.6, 2) + pow((lon - 91.5) / 1.2, 2))) + CASE WHEN lat > 22 AND lat < 27 THEN 1200 * exp(-pow((lon - 93.8) / 0.6, 2)) ELSE 0 END + 500 * exp(-(pow((lat - 18.5) / 1.5, 2) + pow((lon - 82.5) / 0.8, 2)))"""


@query("p13_terrain", sql(f"SELECT cell, round({TERRAIN}, 6) AS height FROM (SELECT cell, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM cells)", "cells"))
def p13(spark, d):
    return R6(cells(spark, d).select("cell", space.terrain(F.col("lat"), F.col("lon")).alias("height")))


@query("p14_wind_moisture", "SELECT c_custkey, round(sqrt(u * u + v * v), 6) AS wind, round(sqrt(u * u + v * v) * w, 6) AS flux FROM (SELECT c_custkey, c_acctbal / 500 AS u, c_nationkey - 12.0 AS v, c_custkey % 70 AS w FROM customer)")
def p14(spark, d):
    u, v = F.col("c_acctbal") / 500, F.col("c_nationkey") - 12.0
    return R6(table(spark, d, "customer").select("c_custkey", F.hypot(u, v).alias("wind"), (F.hypot(u, v) * (F.col("c_custkey") % 70)).alias("flux")))


@query("p16_season_phase", sql("SELECT DISTINCT CAST(label AS VARCHAR) AS label, round(sin(2 * pi() * dayofyear(label) / 365.25), 6) AS s, round(cos(2 * pi() * dayofyear(label) / 365.25), 6) AS c FROM pairs", "pairs"))
def p16(spark, d):
    s, c = rain.season_phase(F.col("label"))
    return R6(pairs(spark, d).select("label").distinct().select(S(F.col("label")).alias("label"), s.alias("s"), c.alias("c")))


@query("p17_log_rain", sql("SELECT cell, CAST(label AS VARCHAR) AS label, round(ln(1 + fc), 6) AS log_fc FROM paired", "paired"))
def p17(spark, d):
    return R6(paired(spark, d).select("cell", S(F.col("label")).alias("label"), F.log1p("fc").alias("log_fc")))


@query("p18_forcing_scores", sql("""SELECT cell, round(least(greatest((lat - 15) / 50 / 0.12, 0), 1), 6) AS oro, round(least(greatest((lon - 75) / 8.0, 0), 1) * exp(-(elev) / 150.0) * (elev > 0)::INT, 6) AS coast,
    round(least(greatest(elev * 5 / 2500.0, 0), 1) * least(greatest(lat * 2 / 60.0, 0), 1), 6) AS conv FROM (SELECT cell, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, elev FROM cells)""", "cells"))
def p18(spark, d):
    c = F.col
    return R6(cells(spark, d).select("cell", rain.upslope_score((c("lat") - 15) / 50).alias("oro"), rain.coastal_score(c("lon") - 75, c("elev")).alias("coast"), rain.convective_score(c("elev") * 5, c("lat") * 2).alias("conv")))


CATEGORY = "CASE " + " ".join(f"WHEN obs >= {low} THEN '{name}'" for low, name in reversed(rain.CATEGORIES[1:])) + " ELSE 'no rain' END"


@query("p19_category", sql(f"SELECT cell, CAST(label AS VARCHAR) AS label, {CATEGORY} AS category FROM paired", "paired"))
def p19(spark, d):
    return paired(spark, d).select("cell", S(F.col("label")).alias("label"), rain.category(F.col("obs")).alias("category"))


WARNING = "CASE WHEN most >= 204.5 OR pv >= 0.5 THEN 'red' WHEN most >= 115.6 OR ph >= 0.5 OR pv >= 0.25 THEN 'orange' WHEN most >= 64.5 OR ph >= 0.2 THEN 'yellow' ELSE 'green' END"


@query("p20_warning", sql(f"SELECT cell, {WARNING} AS warning FROM (SELECT cell, max(obs) AS most, avg((obs >= 64.5)::INT) AS ph, avg((obs >= 115.6)::INT) AS pv FROM paired GROUP BY cell)", "paired"))
def p20(spark, d):
    g = paired(spark, d).groupBy("cell").agg(F.max("obs").alias("most"), F.avg((F.col("obs") >= 64.5).cast("int")).alias("ph"), F.avg((F.col("obs") >= 115.6).cast("int")).alias("pv"))
    return g.select("cell", rain.warning(F.col("most"), F.col("ph"), F.col("pv")).alias("warning"))


@query("p22_p23_distances", sql("""SELECT cell, round(sqrt(pow((lat - 20) * 111, 2) + pow((lon - 80) * 111 * cos(radians((lat + 20) / 2)), 2)), 4) AS flat_km,
    round(sqrt(pow((lat - 20) * 111, 2) + pow((lon - 80) * 111 * cos(radians(20.0)), 2)), 4) AS centre_km FROM (SELECT cell, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM cells)""", "cells"))
def p22(spark, d):
    lat, lon, a, b = F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(80.0)
    return R6(cells(spark, d).select("cell", space.flat_km(a, b, lat, lon).alias("flat_km"), space.centre_km(lat, lon, a, b).alias("centre_km")), 4)


@query("p24_unit_spec", """WITH s AS (SELECT * FROM (VALUES (0, 'hPa', 0.01, 0.0, 1.0), (1, 'K', 1.0, 0.0, 30.0), (2, 'pct', 100.0, 0.0, 4000.0)) x(k, unit, scale, low, high))
    SELECT p_partkey, unit, round(p_retailprice * scale, 6) AS value, p_retailprice * scale BETWEEN low AND high AS plausible FROM part JOIN s ON p_size % 3 = k""")
def p24(spark, d):
    """Scale by a broadcast table of field specifications and check the plausible range."""
    spec = spark.createDataFrame([(0, "hPa", 0.01, 0.0, 1.0), (1, "K", 1.0, 0.0, 30.0), (2, "pct", 100.0, 0.0, 4000.0)], "k int, unit string, scale double, low double, high double")
    v = F.col("p_retailprice") * F.col("scale")
    return R6(table(spark, d, "part").withColumn("k", F.col("p_size") % 3).join(F.broadcast(spec), "k").select("p_partkey", "unit", v.alias("value"), v.between(F.col("low"), F.col("high")).alias("plausible")))


@query("p25_time_units", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS value, CASE WHEN m % 60 = 0 THEN CAST(m / 60 AS INT) END AS hours FROM
    (SELECT *, CAST(l_quantity AS INT) * CASE l_linenumber WHEN 1 THEN 60 WHEN 2 THEN 1440 WHEN 3 THEN 1 WHEN 4 THEN 360 END AS m FROM lineitem)""")
def p25(spark, d):
    unit = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 2).when(F.col("l_linenumber") == 3, 0).when(F.col("l_linenumber") == 4, 11)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("value"), T.whole_hours(F.col("l_quantity").cast("int"), unit).alias("hours"))


@query("p26_step_range", "SELECT p_partkey, CAST(p_size AS INT) AS a, CAST(p_size + 24 AS INT) AS b FROM part")
def p26(spark, d):
    a, b = T.step_range(F.concat_ws("-", F.col("p_size"), F.col("p_size") + 24))
    return table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))


@query("p27_half_even", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE round_even(p_size / 8.0, 2)::DOUBLE END AS v FROM part")
def p27(spark, d):
    """Non-finite values become null, others are rounded half to even."""
    v = F.when(F.col("p_size") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("p_size") / 8.0)
    return table(spark, d, "part").select("p_partkey", F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.bround(v.cast("decimal(20,6)"), 2).cast("double")).alias("v"))


@query("p29_year_split", sql("SELECT CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM ladder GROUP BY 1", "ladder"))
def p29(spark, d):
    y = F.col("year")
    return ladder(spark, d).groupBy(F.when(y.isin(list(range(1990, 1999))), "train").when(y == 1999, "val").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


THEMES = {"rain": ["l_quantity", "l_extendedprice"], "terrain": ["l_discount"], "moisture": ["l_tax"]}


@query("p31_driver_themes", """WITH c AS (SELECT l_orderkey, CAST(sum(l_quantity - 25) * 100 + sum(l_extendedprice - 1000) / 1000 AS DOUBLE) AS rain, sum(l_discount - 0.05) * 1000 AS terrain, sum(l_tax - 0.04) * 900 AS moisture FROM lineitem GROUP BY 1),
    u AS (SELECT l_orderkey, 'rain' AS theme, round(rain + 3e-6, 2) AS v FROM c UNION ALL SELECT l_orderkey, 'terrain', round(terrain + 3e-6, 2) FROM c UNION ALL SELECT l_orderkey, 'moisture', round(moisture + 3e-6, 2) FROM c)
    SELECT l_orderkey, theme, v AS contribution, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(v) DESC, theme) AS rank FROM u) WHERE rank <= 2""")
def p31(spark, d):
    """Contributions summed by theme, the strongest first."""
    from pyspark.sql.window import Window

    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") - 25).alias("q"), F.sum(F.col("l_extendedprice") - 1000).alias("e"), F.sum(F.col("l_discount") - 0.05).alias("s"), F.sum(F.col("l_tax") - 0.04).alias("t"))
    themed = F.explode(F.create_map(F.lit("rain"), F.round(F.col("q") * 100 + F.col("e") / 1000 + 3e-6, 2), F.lit("terrain"), F.round(F.col("s") * 1000 + 3e-6, 2), F.lit("moisture"), F.round(F.col("t") * 900 + 3e-6, 2))).alias("theme", "contribution")
    ranked = c.select("l_orderkey", themed).withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.abs("contribution").desc(), "theme")))
    return ranked.where("rank <= 2").select("l_orderkey", "theme", "contribution", "rank")


@query("p33_signed_pieces", sql("SELECT DISTINCT lead, CAST(e AS INT) AS hour, CAST(s AS INT) AS sign FROM ladder, LATERAL (SELECT 27 + 24 * (lead - 1) AS e, 1 AS s UNION ALL SELECT 3 + 24 * (lead - 1), -1)", "ladder"))
def p33(spark, d):
    first = T.first_hour(F.col("lead"))
    piece = F.array(F.struct((first + 24).alias("hour"), F.lit(1).alias("sign")), F.struct(first.alias("hour"), F.lit(-1).alias("sign")))
    return ladder(spark, d).select("lead").distinct().select("lead", F.inline(piece))


@query("p34_spacing", sql("WITH l AS (SELECT DISTINCT lat FROM cells), g AS (SELECT lat - lag(lat) OVER (ORDER BY lat) AS step FROM l) SELECT round(min(step), 6)::DOUBLE AS least, round(max(step), 6)::DOUBLE AS most, max(step) - min(step) < 1e-5 AS uniform FROM g", "cells"))
def p34(spark, d):
    from pyspark.sql.window import Window

    axis = cells(spark, d).select("lat").distinct()  # one row a grid line
    step = axis.select((F.col("lat") - F.lag("lat").over(Window.orderBy("lat"))).alias("step"))
    return R6(step.agg(F.min("step").alias("least"), F.max("step").alias("most"), (F.max("step") - F.min("step") < 1e-5).alias("uniform")))


@query("p35_scoring_mask", sql("SELECT cell, CAST(label AS VARCHAR) AS label, land AND obs IS NOT NULL AS scored FROM pairs JOIN cells USING (cell)", "pairs", "cells"))
def p35(spark, d):
    return pairs(spark, d).join(cells(spark, d), "cell").select("cell", S(F.col("label")).alias("label"), (F.col("land") & F.col("obs").isNotNull()).alias("scored"))


@query("p36_evidence", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'ending|until|0300') THEN 'text found' ELSE 'none' END AS verdict FROM documents")
def p36(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.lower("text").rlike("ending|until|0300"), "text found").otherwise("none").alias("verdict"))


@query("r02_class_rule", "SELECT c_custkey, CASE WHEN c_acctbal / 1000 >= 4 AND c_nationkey >= 2 AND c_custkey % 20 >= 8.7 THEN 2 ELSE 1 END AS class FROM customer")
def r02(spark, d):
    return table(spark, d, "customer").select("c_custkey", rain.system_class(F.col("c_acctbal") / 1000, F.col("c_nationkey"), F.col("c_custkey") % 20).alias("class"))


@query("r04_primary_regime", sql("SELECT cell, CAST(label AS VARCHAR) AS label, CASE WHEN cell % 10 <= 2 AND cell % 10 >= 0 THEN 0 WHEN elev / 400 >= 0.5 THEN 1 WHEN lat / 40 >= 0.5 THEN 2 WHEN s = 1 THEN 3 WHEN s = -1 THEN 5 ELSE 4 END AS regime FROM (SELECT *, CAST(day(label) % 3 - 1 AS INT) AS s FROM paired)", "paired"))
def r04(spark, d):
    syn = F.when(F.col("cell") % 10 == 0, 2).when(F.col("cell") % 10 <= 2, 1).otherwise(0)
    return paired(spark, d).select("cell", S(F.col("label")).alias("label"), rain.primary_regime(syn, F.col("elev") / 400, F.col("lat") / 40, F.dayofmonth("label") % 3 - 1).alias("regime"))


@query("s07_variable_map", "SELECT p_partkey, p_retailprice * 0.01 AS mslp, p_size * 1.0 - 273.15 AS t2 FROM part".replace("p_retailprice * 0.01", "round(p_retailprice * 0.01, 6)").replace("p_size * 1.0 - 273.15", "round(p_size * 1.0 - 273.15, 6)::DOUBLE"))
def s07(spark, d):
    from ..sources.mapping import mapped

    return R6(mapped(table(spark, d, "part"), {"mslp": ("p_retailprice", 0.01, 0.0), "t2": ("p_size", 1.0, -273.15)}, keep=["p_partkey"]))
