"""Working folders that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_path(spark: SparkSession, tag: str) -> str:
    """A new path under `spark.checkpoint.dir`. Where that is unset a local session uses a temporary folder; on a cluster it is an
    error, since executors don't share local folders."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/trainlake-work"
    return f"{top.rstrip('/')}/trainlake-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, for tables that several results are made of."""
    path = working_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
