"""Tables in the folder that driver and executors share, in place of long lineages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a folder of its own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="raincask-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet under the shared folder and read back, and its path."""
    path = f"{shared_dir(df.sparkSession)}/raincask/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
