"""District values from cell values through a bridge of area weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rain


def district_product(bridge: DataFrame, field: DataFrame) -> DataFrame:
    """bridge (d, cell, w), field (cell, rain, ph, pv) -> one row a district, the most severe first.

    Rain and probabilities of cells without a value count as zero.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = bridge.join(field, "cell", "left").groupBy("d").agg(
        F.count("*").alias("n_cells"), F.sum(F.col("w") * zero("rain")).alias("rain_mean"), F.max(zero("rain")).alias("most"), F.max(zero("ph")).alias("p_heavy"), F.max(zero("pv")).alias("p_very")
    )
    out = g.withColumn("warning", rain.warning(F.col("most"), F.col("p_heavy"), F.col("p_very")))
    order = F.array_position(F.array(*(F.lit(s) for s in rain.SEVERITY)), F.col("warning"))
    return out.orderBy(order, F.col("rain_mean").desc())
