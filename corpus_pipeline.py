"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but
the last return rows of `documents`, with all their columns; the last returns packed pieces.

For all stages: a null text counts as the empty one, a null id is an id like any other, what a stage
decides it decides for (id, text), so an id with several texts loses only those meant; very long texts
are read whole; an empty table gives an empty one; columns beyond doc_id and text are carried along,
whatever their names. What repeated rows and ties get is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raincask.llm.common import materialise, without
from raincask.llm.decontamination import decontaminate
from raincask.llm.exact_dedup import exact_dedup, one_of_each
from raincask.llm.near_dedup import near_copies
from raincask.llm.packing import pack
from raincask.llm.quality import score_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier predicts to be of low quality. Equal texts get one answer; a score of a half stays."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, materialise(scored.where("predicted = 0").select("key"), "low-quality"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document with the largest id; of rows that repeat that id and text, one."""
    return one_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of five-word shingles), keeps the document with the least id.

    A document is an (id, text): rows that repeat both stay or go together, and null ids come after all others.
    """
    return without(docs, near_copies(docs).select("key"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark. Rows that repeat an id and its text go together."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_key=True)
    return without(docs, materialise(found.where("contaminated").select("key"), "contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens at most. Repeated rows are packed as often as they come."""
    return pack(docs, capacity=2048)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage), ("benchmark decontamination", benchmark_stage), ("best-fit packing", packing_stage)]

#: SQL can express neither the classifier nor the tokenizer; tests plant cases for each stage and hold its operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
