"""A synthetic world as closed-form columns: any executor makes any cell, the same each time."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import space


#: A prime below 2^31, and a multiplier for each key.
PRIME, STEPS = 2_147_483_647, (7_919, 104_729, 1_299_709)


def stream(salt: str) -> int:
    """The whole number that a salt starts from."""
    return zlib.crc32(salt.encode()) % PRIME


def uniform(*keys: Column | str, salt: str) -> Column:
    """A number in (0, 1) from up to three whole numbers, by arithmetic that any engine can repeat."""
    x = F.lit(stream(salt)).cast("long")
    for key, step in zip(keys, STEPS):
        x = x + (F.col(key) if isinstance(key, str) else key).cast("long") * step
    for _ in range(3):
        x = x % PRIME
        x = x * (x + 48_271)
    return (x % PRIME + 0.5) / float(PRIME)


def normal(*keys: Column | str, salt: str) -> Column:
    """A standard normal from the keys, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*keys, salt=salt + "r"))) * F.cos(2 * math.pi * uniform(*keys, salt=salt + "a"))


def grid(spark: SparkSession, ny: int, nx: int, step: float = 1.0, lat0: float = 6.5, lon0: float = 66.5) -> DataFrame:
    iy, ix = F.floor(F.col("id") / nx).cast("int"), (F.col("id") % nx).cast("int")
    g = spark.range(ny * nx).select(F.col("id").alias("cell"), iy.alias("iy"), ix.alias("ix"), (lat0 + step * iy).alias("lat"), (lon0 + step * ix).alias("lon"))
    return g.withColumn("land", space.inside_outline(F.col("lat"), F.col("lon"))).withColumn("elev", space.terrain(F.col("lat"), F.col("lon")))


def days(spark: SparkSession, years: list[int], first: str = "06-01", last: str = "09-30") -> DataFrame:
    """Days with the season's strength: a seasonal curve, an intraseasonal wave with a phase of its own each year, and a moving low."""
    y = spark.createDataFrame([(v,) for v in years], "year int")
    d = y.withColumn("time", F.explode(F.sequence(F.expr(f"to_date(concat(year, '-{first}'))"), F.expr(f"to_date(concat(year, '-{last}'))"))))
    doy = F.dayofyear("time")
    wave = F.sin(2 * math.pi * (doy / 42.0 + uniform("year", salt="phase")))
    low_age = F.pmod(doy, F.lit(9))
    return d.withColumns({"day": F.unix_date("time"), "strength": F.exp(-F.pow((doy - 215) / 60.0, F.lit(2.0))) * (1 + 0.5 * wave), "wave": wave, "low_lat": 18.0 + 0.4 * low_age, "low_lon": 88.0 - 1.6 * low_age})


def fields(cell_days: DataFrame) -> DataFrame:
    """Winds, pressure, water, energy: a jet, a trough, and the moving low."""
    d2 = F.pow((F.col("lat") - F.col("low_lat")) / 3.0, F.lit(2.0)) + F.pow((F.col("lon") - F.col("low_lon")) / 3.0, F.lit(2.0))
    low = F.exp(-d2)
    jet = F.exp(-F.pow((F.col("lat") - 13.0) / 6.0, F.lit(2.0)))
    return cell_days.withColumns({
        "u850": 12 * F.col("strength") * jet - 6 * low * (F.col("lat") - F.col("low_lat")) / 3.0, "v850": 3 * F.col("strength") * jet + 6 * low * (F.col("lon") - F.col("low_lon")) / 3.0,
        "mslp": 1004 - 4 * F.col("strength") * F.exp(-F.pow((F.col("lat") - 24.0) / 8.0, F.lit(2.0))) - 6 * low, "tcwv": 40 + 15 * F.col("strength") * jet + 8 * low, "cape": 800 + 1200 * F.col("strength") * jet, "low": low,
    })


def rain_mean(model: bool) -> Column:
    """Mean rain: zonal, orographic, break-phase and low-centred terms; the model damps them and adds drizzle."""
    oro = F.col("elev") / 1000.0 * F.col("strength") * F.when(F.col("lon") < 78, 1.0).otherwise(0.5)
    foothill = F.when((F.col("wave") < -0.5) & (F.col("lat") > 26), 6.0).otherwise(0.0)
    truth = 6 * F.col("strength") + 14 * F.least(oro, F.lit(2.0)) + foothill + 35 * F.col("low")
    return 0.75 * truth + 1.0 if model else truth


def realised(mean: Column, *keys: str, salt: str, scale: float = 6.0) -> Column:
    """Wet with chance 1 - exp(-mean / scale), then a lognormal amount; 0 to 600 mm."""
    wet = uniform(*keys, salt=salt + "w") < 1 - F.exp(-mean / scale)
    amount = mean * F.exp(0.8 * normal(*keys, salt=salt + "n") - 0.32)
    return F.when(wet, F.least(F.greatest(amount, F.lit(0.0)), F.lit(600.0))).otherwise(0.0)


def forecast(spark: SparkSession, years: list[int], ny: int, nx: int, leads: list[int] = (1, 3)) -> DataFrame:
    """Forecast rows (lead, time, iy, ix, tp, u850, ...), less exact at longer leads."""
    base = fields(days(spark, years).crossJoin(F.broadcast(grid(spark, ny, nx))))
    each = base.withColumn("lead", F.explode(F.array(*(F.lit(v) for v in leads))))
    noisy = rain_mean(True) * F.exp(0.15 * F.col("lead") * normal("cell", "day", "lead", salt="fc"))
    return each.withColumn("tp", realised(noisy, "cell", "day", "lead", salt="tp"))


def observations(spark: SparkSession, years: list[int], ny: int, nx: int) -> DataFrame:
    """Observed rain on land; null over sea."""
    base = fields(days(spark, years).crossJoin(F.broadcast(grid(spark, ny, nx))))
    return base.select("time", "cell", "iy", "ix", F.when(F.col("land"), realised(rain_mean(False), "cell", "day", salt="obs")).alias("rain"))


def analysis(spark: SparkSession, years: list[int], ny: int, nx: int) -> DataFrame:
    """The true state with five per cent of noise."""
    base = fields(days(spark, years).crossJoin(F.broadcast(grid(spark, ny, nx))))
    return base.select("time", "cell", "iy", "ix", *((F.col(c) * (1 + 0.05 * normal("cell", "day", salt=c))).alias(c) for c in ("u850", "v850", "mslp", "tcwv", "cape")))
