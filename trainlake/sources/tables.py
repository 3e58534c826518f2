"""The driver's tables read as the engine's inputs: activities, samples, daily metrics, feedback, articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physio
from ..functions.numbers import nz, pyround, ratio

AS_OF = "2001-08-01"
AS_OF_EVENTS = "2024-01-31"


#: Tables of texts, whose rows cost far more to work on than to move.
TEXTS = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """df as it is where it has a part for every core; a table in fewer parts (a file of one row group can't be split) is dealt
    out to all cores. Large tables have many parts and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities: an order's summed quantity gives its duration and distance, its priority the sport."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    orders = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, q = F.col("o_orderkey"), F.coalesce("q", F.lit(0).cast("long"))
    sport = F.when(F.col("o_orderpriority") == "2-HIGH", "cycling").when(F.col("o_orderpriority") == "3-MEDIUM", "walking").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "swimming").otherwise("running")
    out = orders.select(
        k.alias("activity_id"),
        F.col("o_custkey").alias("athlete"),
        F.col("o_orderdate").alias("start_time"),
        sport.alias("sport_type"),
        (q * 36).alias("duration_s"),
        F.when(k % 5 == 0, 0).otherwise(q * 30).alias("moving_time_s"),
        (q * (60 + k % 40)).alias("distance_m"),
        F.when(F.col("o_orderstatus") != "P", 100 + k % 80).alias("avg_hr"),
        F.when(k % 7 == 0, 0).otherwise(140 + k % 50).alias("avg_cadence_spm"),
        F.when(k % 7 != 0, (80 + k % 60) / 100).alias("avg_stride_m"),
    )
    moving = F.coalesce(nz("moving_time_s"), "duration_s")
    out = out.withColumn("avg_speed_mps", ratio("distance_m", moving))
    out = out.withColumn("l", physio.load(F.col("sport_type"), moving, F.col("avg_speed_mps"), F.col("avg_hr")))
    return out.withColumn("avg_pace_s_per_km", pyround(ratio(nz(moving) * 1000.0, "distance_m"), 1)).select("*", "l.load", F.col("l.source").alias("load_source")).drop("l")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the samples of one activity a user; seq is the order in which a file would hold them."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.groupBy("user_id").agg(F.min(us).alias("t0"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return e.join(first, "user_id").select(
        F.col("user_id").alias("activity_id"),
        F.when(F.col("user_id") % 3 == 0, "cycling").otherwise("running").alias("sport_type"),
        F.col("event_id").alias("seq"),
        F.floor((us - F.col("t0")) / 1_000_000).cast("double").alias("t"),
        F.when(kind != "signup", 30 + (F.col("event_id") % 1000) / 1000).alias("lat"),
        F.when(kind != "signup", 110 + (F.col("event_id") % 700) / 1000).alias("lon"),
        F.when(kind != "error", 100 + F.col("value")).alias("alt"),
        F.when(k % 10 == 0, 0).otherwise(80 + k).alias("hr"),
        F.when(kind == "click", 0).otherwise(150 + k % 30).alias("cad"),
        F.when(kind != "view", F.col("value") / 40).alias("speed"),
    )


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day of events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    d = e.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s"))
    return d.select("date", (70 + (F.col("n") % 50) / 10).alias("weight_kg"), F.when(F.col("s") % 4 != 0, 5 + (F.col("s") % 40) / 10).alias("sleep_h"), F.when(F.col("s") % 5 != 0, 50 + F.col("s") % 20).alias("resting_hr"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pain = F.when(k % 13 == 0, "knee ").when(k % 13 == 1, " calf").when(k % 13 == 2, "").when(k % 13 == 3, "hip")
    return table(spark, sf_dir, "orders").where(k % 4 != 0).select(k.alias("activity_id"), (k % 11).alias("rpe"), pain.alias("pain"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title, the next lines give up to eight key points."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    a = d.select("doc_id", F.explode(F.array(lines)).alias("lines"), "text", "lang", "source", "n_chars").where(F.size("lines") > 0)
    k = F.col("doc_id")
    domain = F.element_at(F.array(*[F.lit(x) for x in ("www.cdc.gov", "blog.sleepfoundation.org", "example.com", "uni.edu", "clinic.nhs.uk", "unknown.xyz", "sport.gov.cn")]), (k % 7 + 1).cast("int"))
    return a.select(
        k.alias("id"),
        F.substring(F.get("lines", F.lit(0)), 1, 80).alias("title"),
        F.slice("lines", 2, 8).alias("key_points"),
        F.col("text").alias("content_md"),
        domain.alias("domain"),
        F.col("source"),
        "lang",
        F.when(k % 6 != 0, F.date_sub(F.lit("2024-06-01").cast("date"), (k % 3000).cast("int"))).alias("published_at"),
        pyround((k % 100) / 100, 2).alias("score"),
    )
