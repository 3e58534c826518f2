"""Queries on ledgers, upserts and small joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeparse
from ..functions.numbers import pyround
from ..operators import ledger as ops
from ..sources import tables
from .registry import pr, query
from .training import ACT, _acts

_ENTRIES = "en as (select l_suppkey as shoe_id, cast(l_shipdate as date) as run_date, l_quantity / 10 as km from lineitem)"


def _entries(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("shoe_id"), F.to_date("l_shipdate").alias("run_date"), (F.col("l_quantity") / 10).alias("km"))


@query(f"with {_ENTRIES} select shoe_id, run_date::varchar as run_date, {pr('sum(cast(km as decimal(18,2)))')} as km from en group by 1, en.run_date")
def snk08_daily_mileage(spark, sf_dir):
    return ops.daily_mileage(_entries(spark, sf_dir)).withColumn("run_date", F.col("run_date").cast("string"))


@query(f"with {_ENTRIES}, s as (select shoe_id, sum(cast(km as decimal(18,2))) as k, count(*) as n from en group by 1) select s_suppkey as shoe_id, coalesce(n, 0) as n, {pr('cast(s_acctbal as decimal(18,2)) + coalesce(k, 0)')} as total_km from supplier left join s on s_suppkey = shoe_id")
def agg16_shoe_totals(spark, sf_dir):
    shoes = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shoe_id"), F.col("s_acctbal").alias("initial_km"))
    return ops.shoe_totals(shoes, _entries(spark, sf_dir)).select("shoe_id", "n", "total_km")


@query("select n_name as city, count(*) as visit_count, cast(min(o_orderdate) as date)::varchar as first_date from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1")
def snk08_visited(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    c = tables.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "city")
    v = tables.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("city", F.to_date("o_orderdate").alias("date"))
    return ops.visited(v).withColumn("first_date", F.col("first_date").cast("string"))


@query(
    """with lib as (select n_nationkey as ord, n_name as city from nation), nm as (select distinct 'NATION_' || (c_nationkey % 40)::varchar || case when c_custkey % 3 = 0 then '市' else '' end as name from customer),
j as (select name, city, ord, case when name = city then 0 when regexp_replace(name, '市$', '') = city then 1 else 2 end as r from nm left join lib on starts_with(regexp_replace(name, '市$', ''), city) or starts_with(city, regexp_replace(name, '市$', '')))
select name, city from j qualify row_number() over (partition by name order by r, ord) = 1"""
)
def joi09_match_city(spark, sf_dir):
    lib = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("city"))
    c = tables.table(spark, sf_dir, "customer")
    names = c.select(F.concat(F.lit("NATION_"), (F.col("c_nationkey") % 40).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "市").otherwise("")).alias("name")).distinct()
    return ops.match_city(names, lib)


@query("select n_nationkey as ord, n_name as city from nation join region on r_regionkey = n_regionkey where contains(n_name, '1') or contains(r_name, '1') order by ord limit 30")
def flt08_search_cities(spark, sf_dir):
    n, r = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    lib = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    return ops.search_cities(lib, "1").select("ord", "city")


@query("with o as (select c_custkey as k, c_name as a, c_acctbal as b from customer where c_custkey % 3 <> 0), n as (select c_custkey as k, case when c_custkey % 2 = 0 then c_mktsegment end as a, case when c_custkey % 5 = 0 then 1.5 end as b from customer where c_custkey % 4 <> 0) select k, coalesce(n.a, o.a) as a, coalesce(n.b::double, o.b) as b from o full join n using (k)")
def snk07_upsert(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("k"), F.col("c_name").alias("a"), F.col("c_acctbal").alias("b"))
    new = c.where(k % 4 != 0).select(k.alias("k"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("a"), F.when(k % 5 == 0, 1.5).alias("b"))
    return ops.upsert(old, new, ["k"])


@query("with o as (select s_name as domain, 'user' as name, 0.5::double as authority, s_suppkey % 5 <> 0 as enabled from supplier where s_suppkey % 3 <> 0), d as (select s_name as domain, 'def' as name, 0.9::double as authority from supplier where s_suppkey % 2 = 0) select domain, coalesce(d.name, o.name) as name, coalesce(d.authority, o.authority) as authority, case when domain in ('Supplier#000000004', 'Supplier#000000007') then false else coalesce(enabled, true) end as enabled from o full join d using (domain)")
def src31_seed(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    old = s.where(k % 3 != 0).select(F.col("s_name").alias("domain"), F.lit("user").alias("name"), F.lit(0.5).alias("authority"), (k % 5 != 0).alias("enabled"))
    new = s.where(k % 2 == 0).select(F.col("s_name").alias("domain"), F.lit("def").alias("name"), F.lit(0.9).alias("authority"))
    return ops.seed(old, new, ["Supplier#000000004", "Supplier#000000007"])


@query(
    f"""with {ACT}, up as (select activity_id as id, case when activity_id % 20 = 0 then null else 20 + activity_id % 200 end as hr, 20 + activity_id % 200 + activity_id % 7 - 1 as mx from act where activity_id % 10 = 0),
ok as (select * from up where hr is null or (hr between 30 and 250 and mx between 30 and 250 and mx >= hr)), j as (select act.*, ok.id is not null as s, hr from act left join ok on ok.id = act.activity_id),
e as (select *, case when s then hr else avg_hr end as h, least(greatest((met0 - 1) / (15.0 * 190 / 60 / 3.5 - 1), 0), 1) as rm from (select *, case sport_type when 'cycling' then greatest(4.0::double, v * 0.35) when 'walking' then greatest(3.0::double, v * 0.5) when 'swimming' then greatest(6.0::double, v * 2.0) else greatest(6.0::double, v * 0.95) end as met0 from (select *, coalesce(avg_speed_mps, 0) * 3.6::double as v from j))),
r as (select *, case when h is not null then least(greatest((h - 60) / 130.0::double, 0), 1) else rm end as res from e)
select activity_id, h as avg_hr, case when s then {pr("case when mt > 0 then mt / 60.0::double * res * (0.64 * exp(1.92::double * res)) when h is not null then 0 end")} else load end as load, case when s then case when h is not null then 'trimp' when mt <> 0 then 'met_estimate' else 'none' end else load_source end as load_source from r"""
)
def snk05_heart_rates(spark, sf_dir):
    a = _acts(spark, sf_dir)
    k = F.col("activity_id")
    up = a.where(k % 10 == 0).select(k, F.when(k % 20 != 0, 20 + k % 200).alias("avg_hr"), (20 + k % 200 + k % 7 - 1).alias("max_hr"))
    return ops.set_heart_rates(a, up).select("activity_id", "avg_hr", "load", "load_source")


_MANUAL = "m as (select o_orderkey as id, 'running' as sport_type, (o_orderkey % 1500)::double as minutes, (o_orderkey % 600)::double as km, case when o_orderkey % 3 <> 0 then 90 + o_orderkey % 90 end as hr from orders)"


@query(
    f"""with {_MANUAL}, g as (select *, minutes * 60 as s, case when km > 0 then km * 1000 / (minutes * 60) end as v from m where minutes > 0 and minutes <= 1440 and km <= 500), e as (select *, greatest(6.0::double, coalesce(v, 0) * 3.6::double * 0.95) as met from g),
r as (select *, case when hr is not null then least(greatest((hr - 60) / 130.0::double, 0), 1) else least(greatest((met - 1) / (15.0 * 190 / 60 / 3.5 - 1), 0), 1) end as res from e)
select id, {pr('s / 60 * res * (0.64 * exp(1.92::double * res))')} as load, case when hr is not null then 'trimp' else 'met_estimate' end as load_source, {pr('met * 70 * (s / 3600)', 1)} as calories from r"""
)
def snk04_manual(spark, sf_dir):
    k = F.col("o_orderkey")
    e = tables.table(spark, sf_dir, "orders").select(k.alias("id"), F.lit("running").alias("sport_type"), F.col("o_orderdate").alias("start_time"), (k % 1500).cast("double").alias("duration_min"), (k % 600).cast("double").alias("distance_km"), F.when(k % 3 != 0, 90 + k % 90).alias("avg_hr"))
    return ops.manual_entries(e, 70.0)[0].select("id", "load", "load_source", "calories")


@query(f"""with {_MANUAL} select o_orderdate::date::varchar as start_time, 'running' as sport_type, case when minutes <= 0 then 'no_duration' when minutes > 1440 then 'duration' else 'distance' end as reason
from m join orders on o_orderkey = id where minutes <= 0 or minutes > 1440 or km > 500""")
def snk04_rejects(spark, sf_dir):
    k = F.col("o_orderkey")
    e = tables.table(spark, sf_dir, "orders").select(F.lit("running").alias("sport_type"), F.col("o_orderdate").alias("start_time"), (k % 1500).cast("double").alias("duration_min"), (k % 600).cast("double").alias("distance_km"), F.lit(None).cast("int").alias("avg_hr"))
    return ops.manual_entries(e, 70.0)[1].withColumn("start_time", F.col("start_time").cast("date").cast("string"))


_ZONED = """z as (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ['Z', '', '+08:00', '-05:00', '+0530'][event_id % 5 + 1] as raw from events)"""


@query(
    f"""with {_ZONED} select event_id, raw, strftime(case event_id % 5 when 1 then t else t + interval 8 hour - to_minutes([0, 0, 480, -300, 330][event_id % 5 + 1]) end, '%Y-%m-%d %H:%M:%S') as local_time
from (select *, strptime(raw[:19], '%Y-%m-%dT%H:%M:%S') as t from z)"""
)
def fn20_local_time(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    zone = F.element_at(F.array(*[F.lit(x) for x in ("Z", "", "+08:00", "-05:00", "+0530")]), (F.col("event_id") % 5 + 1).cast("int"))
    r = e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("raw"))
    return r.select("event_id", "raw", F.date_format(timeparse.parse_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("with e as (select event_id, case event_id % 4 when 0 then 1693900000 + event_id * 977 when 1 then (1693900000 + event_id * 977) * 1000 when 2 then event_id else 1693900000 + event_id end::varchar as raw from events) select event_id, case when length(raw) >= 10 then strftime(make_timestamp((case when length(raw) >= 13 then raw::bigint // 1000 else raw::bigint end + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') end as local_time from e")
def fn22_epoch(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, 1693900000 + k * 977).when(k % 4 == 1, (1693900000 + k * 977) * 1000).when(k % 4 == 2, k).otherwise(1693900000 + k).cast("string")
    return tables.table(spark, sf_dir, "events").select("event_id", F.date_format(timeparse.parse_time_or_epoch(raw), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("with e as (select event_id, event_id % 7200 as s, event_id % 3 as m from events) select event_id, s::double as elapsed, case when s > 0 then printf('%d''%02d\"', s // 60, s % 60) end as pace from e")
def src13_elapsed(spark, sf_dir):
    k, s = F.col("event_id"), (F.col("event_id") % 7200).cast("int")
    raw = F.when(k % 3 == 0, s.cast("string")).when(k % 3 == 1, F.format_string("%d:%02d", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))
    return tables.table(spark, sf_dir, "events").select("event_id", timeparse.elapsed(raw).alias("elapsed"), F.when(s > 0, timeparse.pace_text(timeparse.pace(F.format_string("%d'%02d\"", F.floor(s / 60), s % 60)))).alias("pace"))


@query("with n as (select p_partkey, replace(replace(replace(p_name, 'ring', 'cycling'), 'widget', 'Trail Run'), 'gear', '步行') as nm from part) select p_partkey, case when contains(lower(nm), 'cycl') then 'cycling' when contains(nm, '步行') then 'walking' else 'running' end as sport from n")
def fn30_sport(spark, sf_dir):
    n = F.replace(F.replace(F.replace(F.col("p_name"), F.lit("ring"), F.lit("cycling")), F.lit("widget"), F.lit("Trail Run")), F.lit("gear"), F.lit("步行"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", timeparse.sport(n).alias("sport"))
