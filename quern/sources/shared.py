"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only where that is unset and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quern_shared", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark._quern_shared = "file://" + tempfile.mkdtemp(prefix="quern-")
    return f"{root}/quern/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table: its lineage ends here and a lost executor reads it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
