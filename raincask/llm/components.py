"""Connected components by alternating large-star and small-star steps, each a pair of aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(links: DataFrame, low: DataFrame, u: str, v: str) -> DataFrame:
    return links.join(low, u).select(F.col(v).alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for each node of `links` (u, v: longs); root is the least node reachable.

    A node's neighbours are never gathered: each step takes their minimum, which aggregates before the
    shuffle, and joins it back. Self-links and repeated links do no harm; no links give no rows.
    """
    links = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        # Large star: the larger neighbours of each node hang on the least of its neighbourhood.
        low = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = links.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        # Small star: the smaller neighbours of a node, and itself, hang on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialise(small, "small-star")
        # Done when each node hangs on one that hangs on none.
        roots, nodes = small.select(F.col("v").alias("u")).distinct(), small.groupBy("u").agg(F.count("*").alias("n"))
        open_nodes = nodes.join(roots.withColumn("is_root", F.lit(True)), "u", "left").where("n > 1 OR is_root").limit(1).count()
        discard(links)
        discard(large)
        links = small
        if not open_nodes:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
