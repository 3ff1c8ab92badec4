"""The registered queries of the text operators: thin digests over each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .fim import fill_in_middle
from .hard_negatives import hard_negatives
from .html_text import main_text
from .lm_score import lm_score
from .packing import pack
from .pii import BASE_KINDS, find_pii, written
from .quality import score_quality
from .sharding import shard
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_array_dedup


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(documents(spark, sf_dir), least=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), window=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("key")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir), words=4, most=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), length=13)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), capacity=2048)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score(documents(spark, sf_dir), order=3, backoff=0.4)
    # Sums in another order differ in their last bits.
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_backed_off")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(documents(spark, sf_dir))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE_KINDS[kind]}")

    counts = [count(k) for k in range(len(BASE_KINDS))]
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("key")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir), plain_percent=10, spm_percent=20, seed="1")
    parts = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return out.select("doc_id", "n", "form", *parts, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), positives=5, negatives=5, every=100, margin=(4, 5), scale=256)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_pii": op8_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_sharding": op10_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_html_text": op13_html_text,
}

ORACLES: dict[str, str] = {
    "op7_lm_score": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
        u AS (SELECT *, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS c1, CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY doc_id, a, b) END AS c2,
              CASE WHEN c IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) END AS c3, (SELECT sum(len(w)) FROM d) - count(*) OVER (PARTITION BY doc_id) AS other FROM t),
        v AS (SELECT *, lag(c1) OVER p AS h1, lag(c2) OVER p AS h2 FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
        x AS (SELECT *, (CASE WHEN c1 > 0 THEN c1 ELSE 0.5 END)::DOUBLE / greatest(other, 1) AS s1 FROM v),
        y AS (SELECT *, CASE WHEN c2 > 0 THEN c2::DOUBLE / greatest(h1, 1) WHEN b IS NOT NULL THEN 0.4 * s1 ELSE s1 END AS s2 FROM x),
        z AS (SELECT *, CASE WHEN c3 > 0 THEN c3::DOUBLE / greatest(h2, 1) WHEN c IS NOT NULL THEN 0.4 * s2 ELSE s2 END AS s3 FROM y),
        q AS (SELECT doc_id, sum(ln(s3)) AS s, CAST(sum((coalesce(c2, 0) = 0 AND coalesce(c3, 0) = 0)::INT) AS BIGINT) AS low FROM z GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / len(w), 6) AS mean_log_score, coalesce(low, 0) AS n_backed_off FROM d LEFT JOIN q USING (doc_id)
    """,
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 11, 1))) AS r(i)),
        f AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT p.doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (s) WHERE p.doc_id > least),
        n AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id)
    """,
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        g AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[17:24])::BIGINT % 100 AS c3, ('0x' || h[25:32])::BIGINT % 100 AS c4 FROM d),
        f AS (SELECT *, least(c1, c2) AS lo, greatest(c1, c2) AS hi, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
        p AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1) AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """,
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        r AS (SELECT * FROM e WHERE len(list_filter(q, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
