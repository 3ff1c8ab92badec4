"""Exact dedup by a two-pass Bloom filter; DataFrame functions only.

Pass 1 hashes each text once and counts how often each of `hashes` positions of a bit field is hit;
positions hit twice or more form the filter. Pass 2 probes it: a text with a position that was hit
once has no equal, so its row passes straight through. Only the other rows shuffle, by SHA-256.

The filter is broadcast. Its size has a hard bound, `most_bits` / 64 rows of two longs; with more
documents than it can tell apart, more rows take the shuffle and the result stays the same.

Hot groups: groups are pre-aggregated before their shuffle. A group with more than 1/`HOT_GROUPS` of
the rows is joined by broadcast (there can be at most HOT_GROUPS of those), all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, may_match, text_key, text_or_empty, without

HOT_GROUPS = 256


def _positions(bits: int, hashes: int):
    return [F.pmod(F.xxhash64("h", F.lit(k)), F.lit(bits)) for k in range(hashes)]


def repeat_filter(hashed: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the 64-bit words of the bit field that have a position hit more than once."""
    return (
        hashed.select(F.explode(F.array(*_positions(bits, hashes))).alias("pos"))
        .groupBy("pos")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, cast(pos & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("mask"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, most_bits: int = 1 << 27, hashes: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, key (`text_key`).

    Texts are equal if identical; a null text counts as the empty one. Of equal texts the largest id
    stays; a null id counts as smaller than any. Of rows that repeat that id and the text, one stays: all
    count in group_size. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"), text_key(id_col, text_col).alias("key"))
    # The number of a row tells repeated rows apart; it is written with them, so it stays what it is.
    keyed = keyed.select("doc_id", "key", F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("row"))
    keyed = materialise(keyed, "exact-keys")
    rows = keyed.count()
    bits = 1 << max(10, min(most_bits, bits_per_row * max(1, rows)).bit_length() - 1)
    seen = F.broadcast(repeat_filter(keyed, bits, hashes))
    probed = keyed
    for k, pos in enumerate(_positions(bits, hashes)):
        probed = probed.withColumn("pos", pos).withColumn("word", F.shiftright("pos", 6)).join(seen.withColumnRenamed("mask", f"mask{k}"), "word", "left")
        probed = probed.withColumn(f"hit{k}", F.expr(f"coalesce(mask{k} & shiftleft(1L, cast(pos & 63 as int)), 0L) != 0")).drop("word", "pos", f"mask{k}")
    again = F.lit(True)
    for k in range(hashes):
        again = again & F.col(f"hit{k}")
    probed = probed.select("doc_id", "key", "row", "text_sha256", again.alias("again"))
    alone = probed.where(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "key")

    maybe = probed.where("again").select("doc_id", "key", "row", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    groups = materialise(groups, "exact-groups")
    least = rows // HOT_GROUPS + 1
    hot = F.broadcast(groups.where(F.col("group_size") >= least).select("text_sha256", F.col("top").alias("hot_top"), F.col("group_size").alias("hot_size")))
    # A row of a hot group has its answer already; a key of its own deals it out evenly in the other join.
    salted = maybe.join(hot, "text_sha256", "left").withColumn("of", F.when(F.col("hot_size").isNull(), F.col("text_sha256")).otherwise(F.hex(F.xxhash64("row"))))
    cold = groups.where(F.col("group_size") < least).withColumnRenamed("text_sha256", "of")
    told = salted.join(cold, "of", "left").select("doc_id", "key", "row", "text_sha256", F.coalesce("hot_top", "top").alias("top"), F.coalesce("hot_size", "group_size").alias("group_size"))
    told = told.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256", "key")
    return alone.unionByName(told)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs without those that `exact_dedup` drops, with all their columns.

    Of rows that repeat an id and its text, and that stay, one stays, whatever their other columns hold.
    """
    told = exact_dedup(docs, id_col, text_col)
    gone = materialise(told.where("NOT kept").select("key", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("listed_again")).distinct(), "exact-copies")
    left = without(docs, gone, id_col, text_col)
    again = gone.where("listed_again").select("key")
    if not again.limit(1).count():
        return left
    rows = may_match(docs.select(F.struct("*").alias("row"), text_key(id_col, text_col).alias("key")), again, F.col("key")).join(again, "key", "left_semi")
    return left.unionByName(rows.groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
