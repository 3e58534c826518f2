"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: `spark.checkpoint.dir`. Where it is unset a local session gets a temporary
    one; on a cluster that is an error, since executors don't share local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/trainlake-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The one folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/trainlake-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that have not been written elsewhere can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Shuffle files of what is written within are removed when its writing ends, rather than with the driver's next garbage
    collection; what is read afterwards is the written table. A stage that is run again makes them anew."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    with released_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, task, schema) -> DataFrame:
    """mapInArrow with this package sent to the workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def map_groups(df: DataFrame, key: str, task, schema) -> DataFrame:
    """applyInArrow of task to the rows of each key, with this package sent to the workers first."""
    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(lambda table: task(table), schema)


def map_cogroups(left: DataFrame, right: DataFrame, key: str, task, schema) -> DataFrame:
    """The same for the rows that two tables have of each key."""
    ship(left.sparkSession)
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(lambda x, y: task(x, y), schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_tl_{n}"
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body names it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE + "+"))


def text_bytes(text: Column) -> Column:
    """Bytes of the UTF-8 text; null counts as none."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def partitions_for(n_bytes: int, each: int, least: int = 8) -> int:
    """Number of partitions that keeps each near `each` bytes."""
    return max(least, -(-int(n_bytes) // each))
