"""Queries on streams, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import pyround
from ..sources import tables
from ..storage import working_path
from ..store import Store
from ..streaming import imports
from ..streaming import streams as ops
from .registry import pr, query


@query("select distinct strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority as sport_type from orders")
def str01_new_activities(spark, sf_dir):
    s = ops.read_stream(spark, f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("start_time"), F.col("o_orderpriority").alias("sport_type"))
    out = ops.run_to_end(ops.new_activities(s, "4000 days"), "str01")
    return out.select(F.date_format("start_time", "yyyy-MM-dd").alias("day"), "sport_type")


@query(
    """with w as (select event_type, count(*) as n, sum(cast(value as decimal(18,2)))::double as value, timestamp '2024-01-03' + interval 7 day * floor(epoch(ts - timestamp '2024-01-03') / 604800)::int as start from events group by event_type, 4)
select strftime(start, '%Y-%m-%d') as start, event_type, n, value from w where start + interval 7 day <= (select max(ts) - interval 1 day from events)"""
)
def str03_weekly_windows(spark, sf_dir):
    out = ops.run_to_end(ops.windows(ops.read_stream(spark, f"{sf_dir}/events.parquet"), "7 days", "6 days"), "str03")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.col("value").cast("double"))


@query(
    f"""with d as (select o_custkey as athlete, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as day, sum(o_orderkey % 97)::double as load from orders group by 1, 2)
select a.athlete, a.day, {pr('sum(b.load * (1 - exp(-1.0::double / 42)) * exp(-(a.day - b.day) / 42.0::double))')} as ctl, {pr('sum(b.load * (1 - exp(-1.0::double / 7)) * exp(-(a.day - b.day) / 7.0::double))')} as atl from d a join d b on b.athlete = a.athlete and b.day <= a.day group by 1, 2"""
)
def str02_rolling_load(spark, sf_dir):
    """Orders as loads, in three batches that hold every athlete's days in mixed order."""
    orders = tables.table(spark, sf_dir, "orders")
    at = working_path(spark, "str02-loads")
    daily = orders.select(F.col("o_custkey").alias("athlete"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), (F.col("o_orderkey") % 97).cast("double").alias("load"))
    daily.repartition(3).write.parquet(at)
    ops.rocks_state(spark)
    # all days of these tables are kept, so that the last revision of each is the batch curve
    rows = ops.rolling_load(ops.read_stream(spark, f"{at}/", 1), kept_days=10_000)
    return ops.latest_days(ops.run_to_end(rows, "str02")).select("athlete", "day", pyround("ctl").alias("ctl"), pyround("atl").alias("atl"))


@query("select event_type as source, event_id as id from (select *, row_number() over (partition by event_type order by event_id desc) as k from events) where k <= 500")
def str04_trace_ring(spark, sf_dir):
    """Events as a log: the ring of the last 500 of each type, kept in a ledger by a stream."""
    e = ops.read_stream(spark, f"{sf_dir}/events.parquet")
    log = e.select(F.col("event_type").alias("source"), F.col("event_id").alias("id"), "ts", F.lit("info").alias("level"), F.col("props").alias("label"), F.lit(None).cast("string").alias("detail"))
    ops.rocks_state(spark)
    at = working_path(spark, "str04")
    store = Store(spark, f"{at}/ring", ["source", "id"], 4)
    ops.keep_ring(ops.trace_ring(log), store, f"{at}/checkpoint")
    return store.read().select("source", "id")


_FILES = """
e as (select user_id, cast(ts as date) as day, epoch(date_trunc('second', ts)) as s, event_id from events),
f as (select 'd' as kind, user_id, day::varchar as day, count(*) as n, arg_min(s, event_id) as first, max(s) - min(s) as dur from e group by user_id, day
  union all select 'w', user_id, '', count(*), arg_min(s, event_id), max(s) - min(s) from e where user_id % 5 = 0 group by user_id)
"""


def _import_files(spark, sf_dir):
    """A GPX file a user and day, a second one of every third user's, and one of all days of every fifth user, imported in several batches;
    then all of them again by another stream."""
    e = tables.table(spark, sf_dir, "events")
    stamp = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.format_string('<trkpt lat="%.4f" lon="110.5"><time>%s</time></trkpt>', 30 + F.col("event_id") / 1e6, stamp)
    e = e.select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", point.alias("x"))
    name = lambda kind, day: F.concat(F.lit(kind), F.col("user_id").cast("string"), day, F.lit(".gpx"))
    days = e.withColumn("file", name("d", F.col("day")))
    every = days.unionByName(days.where("user_id % 3 = 0").withColumn("file", name("c", F.col("day")))).unionByName(e.where("user_id % 5 = 0").withColumn("file", name("w", F.lit(""))))
    head, tail = '<gpx xmlns="http://www.topografix.com/GPX/1/0"><trk><type>running</type><trkseg>', "</trkseg></trk></gpx>"
    files = every.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", "x"))).alias("xs"))
    at = working_path(spark, "import")
    # a file of a bucket holds many workouts, a line each; the stream reads them as (file, text), half of the files a batch
    half = max(1, spark.sparkContext.defaultParallelism)
    files.select("file", F.concat(F.lit(head), F.array_join("xs.x", ""), F.lit(tail)).alias("content")).repartition(2 * half, "file").write.parquet(f"{at}/inbox")
    stream = lambda n: ops.read_stream(spark, f"{at}/inbox/", n).select(F.col("file").alias("path"), F.lit("gpx").alias("kind"), "content")
    first = imports.Importer(spark, f"{at}/store", n_parts=4)
    first.run(stream(half), f"{at}/first")
    again = imports.Importer(spark, f"{at}/store", writer="again", n_parts=4)
    again.run(stream(2 * half), f"{at}/again")
    return again


@query(
    f"""with {_FILES}, ok as (select * from f where dur <= 86400), one as (select first, count(distinct (n, dur)) as k from ok group by first)
select strftime(to_timestamp(first) at time zone 'UTC' + interval 8 hour, '%Y-%m-%d %H:%M:%S') as start_time, 'running' as sport_type, 1::bigint as n from one"""
)
def str01_import_files(spark, sf_dir):
    """Each start once, however many files hold it and however often they come."""
    acts = _import_files(spark, sf_dir).activities.read()
    return acts.groupBy(F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), "sport_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with a as (select o_custkey as k, count(*) as n, max(o_orderkey) as last from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as k, count(*) as n, max(o_orderkey) as last from orders where o_orderkey % 2 = 1 and o_orderstatus = 'F' group by 1)"
    " select coalesce(b.k, a.k) as k, coalesce(b.n, a.n) as n, case when b.k is not null and b.last % 3 <> 0 then b.last else a.last end as last, coalesce(a.kind, 'late') as kind"
    " from (select *, 'old' as kind from a) a full join b on a.k = b.k"
)
def snk07_stored_upsert(spark, sf_dir):
    """A ledger of customers kept from the even orders, migrated, then merged with what the odd ones say; nulls keep what is known."""
    orders = tables.table(spark, sf_dir, "orders")
    sums = lambda cond: orders.where(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    ledger = Store(spark, working_path(spark, "ledger"), ["k"], 8)
    ledger.merge(sums("o_orderkey % 2 = 0"))
    ledger.add_columns({"kind": ("string", "old")})
    new = sums("o_orderkey % 2 = 1 and o_orderstatus = 'F'").withColumn("last", F.when(F.col("last") % 3 != 0, F.col("last")))
    known = ledger.read().select("k")
    ledger.merge(new.join(known, "k", "left_semi"))
    ledger.merge(new.join(known, "k", "left_anti").withColumn("kind", F.lit("late")))
    return ledger.read()


@query("select event_id as id from events order by id desc limit 100")
def str04_tail(spark, sf_dir):
    return ops.tail(tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))


@query("select event_id as id from events where event_id > 500 order by id limit 100")
def srt07_since(spark, sf_dir):
    return ops.tail(tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), 500)
