"""Tables between stages, in a folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset and all runs in one process, below a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="treescan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/treescan/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written and read again: lineage is cut, and a lost executor costs a re-read only."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
