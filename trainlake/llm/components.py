"""Connected components by random contraction, every round a few joins; no edge or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b long): two nodes have equal labels if a path joins them.

    Each round sends every node to its neighbour (or itself) of least hash and contracts the edges; the hash differs from
    round to round, so chains shrink by a constant share as well as stars. Nulls and loops are ignored; repeated edges count
    once; no edges give no rows."""
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "cc-labels")
    for k in range(200):
        if edges.isEmpty():
            return labels
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.when(F.col("m") < rank("a"), F.col("m.v")).otherwise(F.col("a")).alias("to"))
        to = materialize(to, "cc-to")
        ends = edges.join(to.select("a", F.col("to").alias("ta")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        edges = materialize(ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        labels = materialize(labels.join(to.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
    raise RuntimeError("contraction did not end")
