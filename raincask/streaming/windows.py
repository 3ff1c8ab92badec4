"""The daily sum of half-hourly rates on a stream: the batch operator's windows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sums(granules: DataFrame, late: str = "6 hours", expected: int = 48) -> DataFrame:
    """(valid_start, valid_end, cell, granules, rain) from (ts, cell, rate), streaming or batch.

    A day runs from 03 to 03 UTC. A day with another number of granules than expected, or with a null
    rate, has no sum: a late granule rejects its window, there are no partial sums.
    """
    day = F.window("ts", "1 day", "1 day", "3 hours")
    g = granules.withWatermark("ts", late) if granules.isStreaming else granules
    full = (F.count("*") == expected) & (F.count("rate") == expected)
    out = g.groupBy(day.alias("w"), "cell").agg(F.count("*").alias("granules"), F.when(full, F.sum("rate") * 0.5).alias("rain"))
    return out.select(F.col("w.start").alias("valid_start"), F.col("w.end").alias("valid_end"), "cell", "granules", "rain")
