"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .book import ORACLES, QUERIES
from . import q_columns, q_grid, q_joins, q_models, q_regimes, q_scores, q_sources  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a02_contingency"](spark, sf_dir)
