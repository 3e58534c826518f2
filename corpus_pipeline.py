"""From raw documents to shards of training text: five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.llm import decontamination, minhash_dedup, mixing, quality_classifier, sharding
from trainlake.llm.common import fresh, materialize

#: Two stages are no SQL (a trained classifier, signatures). tests/llm/test_queries.py holds run() on a small fixture to plain-Python
#: versions of the other four stages, row by row, from the classifier's verdicts on; those are held to labels and to their own formula.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labelled ones, accepts. Null and empty texts are scored like any, null
    sources and languages are sites of their own, repeated rows are judged alike; an empty table stays empty. Without labels
    every score is even and every document stays."""
    columns = docs.columns
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify(docs, model).where("accepted").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id (a null one comes first). Rows with null texts
    stay, texts without words are near copies of equal ones only, of repeated rows one stays."""
    return minhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none. An empty benchmark drops nothing."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source's documents to its target weight; a document may be drawn twice. A null source is a source; documents of a
    source without any word are not drawn, a single source is drawn once."""
    return mixing.draw(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all drawn rows to 16 shards by a reproducible permutation; adds row_no, n_rows, shard and slot. Null ids come first,
    repeated rows get places of their own, an empty table stays empty."""
    (h,) = fresh(docs, "hash")
    return sharding.shard(docs.withColumn(h, F.xxhash64("text", "source", "lang")), ["doc_id", h], n_shards=16).drop(h)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
