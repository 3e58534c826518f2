"""Turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turn(turns: DataFrame, role: str = "user") -> DataFrame:
    """The last turn of a role in each conversation; one row a task and conversation is shuffled."""
    rest = [c for c in turns.columns if c not in ("conv_id", "turn")]
    rows = turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max(F.struct("turn", *rest)).alias("t"))
    return rows.select("conv_id", "t.*")


def recent_turns(turns: DataFrame, most: int = 12) -> DataFrame:
    """The last `most` turns of each conversation."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
