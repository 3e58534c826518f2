"""Queries on activities and load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physio
from ..functions.numbers import pyround
from ..operators import activities as ops
from ..plans import metrics, rules
from ..sources import tables
from .registry import pr, query

AS_OF = tables.AS_OF
ACT = f"""
qty as (select l_orderkey, sum(l_quantity)::bigint as q from lineitem group by 1),
a0 as (select o_orderkey as activity_id, o_custkey as athlete, o_orderdate as start_time,
  case o_orderpriority when '2-HIGH' then 'cycling' when '3-MEDIUM' then 'walking' when '4-NOT SPECIFIED' then 'swimming' else 'running' end as sport_type,
  coalesce(q, 0) * 36 as duration_s, case when o_orderkey % 5 = 0 then 0 else coalesce(q, 0) * 30 end as moving_time_s, coalesce(q, 0) * (60 + o_orderkey % 40) as distance_m,
  case when o_orderstatus <> 'P' then 100 + o_orderkey % 80 end as avg_hr, case when o_orderkey % 7 = 0 then 0 else 140 + o_orderkey % 50 end as avg_cadence_spm,
  case when o_orderkey % 7 <> 0 then (80 + o_orderkey % 60) / 100.0::double end as avg_stride_m
  from orders left join qty on l_orderkey = o_orderkey),
a1 as (select *, coalesce(nullif(moving_time_s, 0), duration_s) as mt from a0),
a2 as (select *, case when mt <> 0 then distance_m::double / mt end as avg_speed_mps from a1),
a3 as (select *, coalesce(avg_speed_mps, 0) * 3.6::double as kmh from a2),
a4 as (select *, case sport_type when 'cycling' then greatest(4.0::double, kmh * 0.35) when 'walking' then greatest(3.0::double, kmh * 0.5) when 'swimming' then greatest(6.0::double, kmh * 2.0) else greatest(6.0::double, kmh * 0.95) end as met from a3),
a5 as (select *, case when avg_hr is not null then least(greatest((avg_hr - 60) / 130.0::double, 0), 1) else least(greatest((met - 1) / (15.0 * 190 / 60 / 3.5 - 1), 0), 1) end as res from a4),
act as (select * exclude (kmh, met, res), {pr("case when mt > 0 then mt / 60.0::double * res * (0.64 * exp(1.92::double * res)) when avg_hr is not null then 0 end")} as load,
  case when avg_hr is not null then 'trimp' when mt <> 0 then 'met_estimate' else 'none' end as load_source,
  {pr("case when distance_m > 0 then nullif(mt, 0) * 1000.0::double / distance_m end", 1)} as avg_pace_s_per_km from a5)
"""
L = "cast(coalesce(load, 0) as decimal(18,2))"
D = f"date '{AS_OF}'"
DAILY = f"{ACT}, daily as (select cast(start_time as date) as date, sum({L})::double as load from act group by 1)"
FB = "fb as (select o_orderkey as activity_id, o_orderkey % 11 as rpe, case o_orderkey % 13 when 0 then 'knee ' when 1 then ' calf' when 2 then '' when 3 then 'hip' end as pain from orders where o_orderkey % 4 <> 0)"
LAST28 = f"start_time >= {D} - 28 and start_time < {D}"
_DM = """dm as (select date, (70 + (n % 50) / 10.0::double) as weight_kg, case when s % 4 <> 0 then 5 + (s % 40) / 10.0::double end as sleep_h, case when s % 5 <> 0 then 50 + s % 20 end as resting_hr
  from (select cast(ts as date) as date, count(*) as n, sum(cast(json_extract_string(props, '$.k') as int))::bigint as s from events group by 1))"""


def _acts(spark, sf_dir):
    return tables.activities(spark, sf_dir)


def _dated(df):
    return df.withColumn("date", F.col("date").cast("string"))


def _joined(c):
    return F.array_join(F.col(c).cast("array<string>"), ",")


@query(f"with {ACT} select activity_id, sport_type, start_time, {pr('distance_m / 1000.0::double')} as distance_km, {pr('duration_s / 60.0::double', 1)} as duration_min, avg_hr, load, case when nullif(load, 0) is not null then case when avg_hr is not null then 'trimp' else 'met_estimate' end end as load_source from act")
def prj01_brief(spark, sf_dir):
    return ops.brief(_acts(spark, sf_dir))


@query(f"with {ACT}, {FB} select act.activity_id, strftime(start_time, '%Y-%m-%d') as date, sport_type as type, {pr('distance_m / 1000.0::double')} as distance_km, {pr('duration_s / 60.0::double', 1)} as duration_min, avg_hr, {pr('nullif(avg_pace_s_per_km, 0) / 60')} as pace_min_per_km, rpe from act left join fb on fb.activity_id = act.activity_id")
def joi01_cards(spark, sf_dir):
    return ops.cards(_acts(spark, sf_dir), tables.feedback(spark, sf_dir))


@query(f"with {ACT} select activity_id, load, load_source from act")
def fn06_load(spark, sf_dir):
    return _acts(spark, sf_dir).select("activity_id", "load", "load_source")


@query(f"with {ACT} select activity_id, case when share >= 0.5 and share < 0.6 then 'z1' when share >= 0.6 and share < 0.7 then 'z2' when share >= 0.7 and share < 0.8 then 'z3' when share >= 0.8 and share < 0.9 then 'z4' when share >= 0.9 and share < 1.01 then 'z5' end as zone from (select activity_id, avg_hr / 190.0::double as share from act)")
def joi12_zone(spark, sf_dir):
    return _acts(spark, sf_dir).select("activity_id", physio.zone(F.col("avg_hr")).alias("zone"))


@query(f"with {DAILY} select date::varchar as date, load from daily")
def agg05_daily_load(spark, sf_dir):
    return _dated(ops.daily_load(_acts(spark, sf_dir)))


def _ema(tau, d="date"):
    return f"coalesce(sum(load * (1 - exp(-1.0::double / {tau})) * exp(-date_diff('day', {d}, {D}) / {tau}.0::double)), 0)"


_POINT = f"(select {pr(_ema(42))} as ctl, {pr(_ema(7))} as atl from daily where date between {D} - 90 and {D})"


@query(f"with {DAILY} select ctl, atl, {pr('ctl - atl')} as tsb, case when ctl > 0 then {pr('atl / ctl')} else 0 end as acwr from {_POINT}")
def agg06_ema_point(spark, sf_dir):
    return ops.ema_point(ops.daily_load(_acts(spark, sf_dir)), AS_OF)


@query(
    f"""with {ACT}, daily as (select athlete, cast(start_time as date) as date, sum({L})::double as load from act group by 1, 2),
p as (select athlete, {pr(_ema(42))} as ctl, {pr(_ema(7))} as atl from daily where date between {D} - 90 and {D} group by 1)
select athlete, ctl, atl, {pr('ctl - atl')} as tsb, case when ctl > 0 then {pr('atl / ctl')} else 0 end as acwr from p"""
)
def agg06_ema_by_athlete(spark, sf_dir):
    return ops.ema_point(ops.daily_load(_acts(spark, sf_dir), ["athlete"]), AS_OF, ["athlete"])


@query(
    f"""with recursive {DAILY},
spine as (select row_number() over (order by d) - 1 as n, d::date as date, coalesce(load, 0) as load from range({D} - 90, {D} + 1, interval 1 day) r(d) left join daily on daily.date = r.d::date),
run as (select n, date, load, load * (1 - exp(-1.0::double / 42)) as c, load * (1 - exp(-1.0::double / 7)) as a from spine where n = 0
  union all select s.n, s.date, s.load, c + (s.load - c) * (1 - exp(-1.0::double / 42)), a + (s.load - a) * (1 - exp(-1.0::double / 7)) from run join spine s on s.n = run.n + 1)
select date::varchar as date, {pr('load')} as load, {pr('c')} as ctl, {pr('a')} as atl, {pr('c - a')} as tsb from run"""
)
def win07_load_curve(spark, sf_dir):
    return _dated(ops.load_curve(ops.daily_load(_acts(spark, sf_dir)), AS_OF))


@query(f"with {DAILY}, spine as (select d::date as date from range({D} - 90, {D} + 1, interval 1 day) r(d)) select spine.date::varchar as date, coalesce(load, 0) as load from spine left join daily on daily.date = spine.date")
def joi13_spine(spark, sf_dir):
    days = ops.calendar(spark, AS_OF, 90)
    return days.join(ops.daily_load(_acts(spark, sf_dir)), "date", "left").select(F.col("date").cast("string"), F.coalesce("load", F.lit(0.0)).alias("load"))


@query(
    f"""with {ACT}, w as (select date_diff('day', cast(start_time as date), {D}) // 7 as weeks_ago, sum(distance_m) as d, sum({L}) as l, sum(duration_s) as s from act where cast(start_time as date) <= {D} group by 1)
select r.weeks_ago::int as weeks_ago, {pr('coalesce(d, 0) / 1000.0::double')} as distance_km, {pr('coalesce(l, 0)', 1)} as load, {pr('coalesce(s, 0) / 3600.0::double')} as duration_h from range(8) r(weeks_ago) left join w on w.weeks_ago = r.weeks_ago"""
)
def agg04_weekly(spark, sf_dir):
    return ops.weekly(_acts(spark, sf_dir), AS_OF)


_SUMMARY = f"""count(*) as n, {pr('coalesce(sum(distance_m), 0) / 1000.0::double')} as distance_km, {pr('coalesce(sum(duration_s), 0) / 3600.0::double')} as duration_h, {pr(f'coalesce(sum({L}), 0)', 1)} as load,
  {pr('case when sum(distance_m) > 100 then sum(mt) / (sum(distance_m) / 1000.0::double) end', 1)} as avg_pace_s_per_km, {pr('sum(avg_hr * duration_s)::double / nullif(sum(case when avg_hr is not null then duration_s end), 0)', 1)} as avg_hr,
  {pr('avg(nullif(avg_cadence_spm, 0))', 1)} as avg_cadence_spm, {pr('avg(cast(avg_stride_m as decimal(18,3)))', 3)} as avg_stride_m"""


@query(f"with {ACT} select {_SUMMARY} from act where start_time >= {D} - 30")
def agg07_summary(spark, sf_dir):
    return ops.summary(_acts(spark, sf_dir), F.date_sub(ops.date_lit(AS_OF), 30).cast("timestamp_ntz"))


@query(f"with {ACT} select athlete, {_SUMMARY} from act where start_time >= {D} - 365 and sport_type = 'running' group by 1")
def agg07_summary_by_athlete(spark, sf_dir):
    return ops.summary(_acts(spark, sf_dir), F.date_sub(ops.date_lit(AS_OF), 365).cast("timestamp_ntz"), "running", ["athlete"])


@query(
    f"""with {ACT} select cast(start_time as date)::varchar as date, count(*) as n, {pr('coalesce(sum(distance_m), 0) / 1000.0::double')} as distance_km, {pr(f'coalesce(sum({L}), 0)', 1)} as load, {pr('avg(nullif(avg_hr, 0))', 1)} as avg_hr,
  {pr('avg(cast(nullif(avg_pace_s_per_km, 0) as decimal(18,1)))', 1)} as avg_pace_s_per_km, {pr('avg(nullif(avg_cadence_spm, 0))', 1)} as avg_cadence_spm from act where start_time >= {D} - 90 group by 1"""
)
def agg08_trend(spark, sf_dir):
    return _dated(ops.trend(_acts(spark, sf_dir), F.date_sub(ops.date_lit(AS_OF), 90).cast("timestamp_ntz")))


_PACE = f"""pace as (select case when sum(distance_m) filter (start_time >= {D} - 14) > 100 then sum(mt) filter (start_time >= {D} - 14) / (sum(distance_m) filter (start_time >= {D} - 14) / 1000.0::double) end as a,
  case when sum(distance_m) filter (start_time < {D} - 14) > 100 then sum(mt) filter (start_time < {D} - 14) / (sum(distance_m) filter (start_time < {D} - 14) / 1000.0::double) end as b from act where {LAST28})"""


@query(f"with {ACT}, {_PACE} select {pr('a', 1)} as pace_now, {pr('b', 1)} as pace_before, {pr('coalesce((a / b - 1) * 100, 0)')} as pace_trend_pct from pace")
def agg09_pace_trend(spark, sf_dir):
    return ops.pace_trend(_acts(spark, sf_dir), AS_OF)


@query(
    f"""with {_DM} select {pr("coalesce(case when count(weight_kg) >= 3 then regr_slope(weight_kg, date_diff('day', date '2024-01-31', date)::double) end * 7, 0)", 3)} as weight_trend_kg_per_week,
  {pr("coalesce(case when count(resting_hr) >= 3 then regr_slope(resting_hr::double, case when resting_hr is not null then date_diff('day', date '2024-01-31', date)::double end) end * 7, 0)")} as resting_hr_trend, {pr('avg(cast(sleep_h as decimal(18,1)))')} as sleep_avg_h
from dm where date >= date '2024-01-31' - 30"""
)
def agg10_slope(spark, sf_dir):
    return ops.body_trends(tables.daily_metrics(spark, sf_dir), tables.AS_OF_EVENTS)


_ZROW = "select case when avg_hr % 5 = 0 then 'z1' when avg_hr % 5 = 1 then 'z2' when avg_hr % 5 = 2 then 'z3' when avg_hr % 5 = 3 then 'z4' else 'z5' end as zone, duration_s * 0.6 as s from act where avg_hr is not null and " + LAST28 + " union all select 'rest', duration_s * 0.4 from act where avg_hr is not null and " + LAST28


@query(f"with {ACT}, r as ({_ZROW}) select zone, sum(cast(s as decimal(18,2)))::double as seconds from r group by 1")
def agg11_zone_totals(spark, sf_dir):
    a = _acts(spark, sf_dir).where(ops.between_days(AS_OF, 28, 0)).where("avg_hr is not null")
    z = F.concat(F.lit("z"), (F.col("avg_hr") % 5 + 1).cast("string"))
    return ops.zone_totals(a.select(F.create_map(z, F.col("duration_s") * 0.6, F.lit("rest"), F.col("duration_s") * 0.4).alias("zones")))


_QUALITY = f"""count(*) as n, {pr('count(*) filter (avg_hr is null)::double / nullif(count(*), 0)')} as hr_missing_ratio, {pr(f'sum({L}) filter (avg_hr is null)::double / nullif(sum({L}), 0)::double')} as estimated_load_ratio"""


@query(f"with {ACT} select {_QUALITY} from act where {LAST28}")
def agg12_quality(spark, sf_dir):
    return ops.quality_ratios(_acts(spark, sf_dir), AS_OF)


_FEEDBACK = f"{pr('avg(nullif(rpe, 0))', 1)} as avg_rpe, array_to_string(list_sort(list_distinct(list(nullif(trim(pain), ''))))[1:5], ',') as pain_flags, {pr('coalesce(max(duration_s), 0) / 60.0::double', 1)} as longest_min"


@query(f"with {ACT}, {FB} select {_FEEDBACK} from act left join fb on fb.activity_id = act.activity_id where {LAST28}")
def agg13_feedback(spark, sf_dir):
    return ops.feedback_summary(_acts(spark, sf_dir), tables.feedback(spark, sf_dir), AS_OF).withColumn("pain_flags", _joined("pain_flags"))


@query(
    f"""with {DAILY}, {FB}, {_PACE}, w as (select date_diff('day', cast(start_time as date), {D}) // 7 as k, sum(distance_m) as d, sum({L}) as l, sum(duration_s) as s from act where cast(start_time as date) <= {D} group by 1),
ww as (select r.k, {pr('coalesce(d, 0) / 1000.0::double')} as d, {pr('coalesce(l, 0)', 1)} as l, {pr('coalesce(s, 0) / 3600.0::double')} as s from range(8) r(k) left join w on w.k = r.k),
lists as (select array_to_string(list(d order by k desc), ',') as weekly_distance_km, array_to_string(list(l order by k desc), ',') as weekly_load, array_to_string(list(s order by k desc), ',') as weekly_duration_h from ww),
m as (select {pr('avg(nullif(avg_hr, 0))', 1)} as avg_hr, {pr('avg(nullif(avg_cadence_spm, 0))', 1)} as avg_cadence_spm, {pr('avg(cast(avg_stride_m as decimal(18,3)))', 3)} as avg_stride_m from act where {LAST28}),
q as (select {_QUALITY} from act where {LAST28}), f as (select {_FEEDBACK} from act left join fb on fb.activity_id = act.activity_id where {LAST28})
select ctl, atl, {pr('ctl - atl')} as tsb, case when ctl > 0 then {pr('atl / ctl')} else 0 end as acwr, weekly_distance_km, weekly_load, weekly_duration_h, {pr('a', 1)} as pace_now, {pr('coalesce((a / b - 1) * 100, 0)')} as pace_trend_pct,
  avg_hr, avg_cadence_spm, avg_stride_m, n as activity_count_28d, hr_missing_ratio, estimated_load_ratio, avg_rpe, pain_flags, longest_min from {_POINT}, lists, pace, m, q, f"""
)
def agg14_bundle(spark, sf_dir):
    b = metrics.bundle(_acts(spark, sf_dir), tables.feedback(spark, sf_dir), None, AS_OF)
    return b.withColumns({c: _joined(c) for c in ("weekly_distance_km", "weekly_load", "weekly_duration_h", "pain_flags")})


@query(f"with {ACT} select cast(start_time as date)::varchar as date, array_to_string(list(activity_id order by start_time, activity_id), ',') as ids, array_to_string(list({pr('distance_m / 1000.0::double')} order by start_time, activity_id), ',') as kms from act where start_time >= date '2001-07-01' and start_time < date '2001-08-01' group by 1")
def agg15_calendar(spark, sf_dir):
    c = ops.month_calendar(_acts(spark, sf_dir), 2001, 7)
    return _dated(c).select("date", _joined("entries.activity_id").alias("ids"), _joined("entries.km").alias("kms"))


@query(f"with {ACT} select activity_id, load from act where sport_type = 'running' and start_time >= date '2001-06-01' and start_time < date '2001-07-01' order by start_time desc, activity_id limit 20 offset 5")
def srt01_page(spark, sf_dir):
    return ops.list_page(_acts(spark, sf_dir), "running", 2001, 6, 5, 20).select("activity_id", "load")


@query(f"with {ACT}, old as (select distinct start_time, sport_type from act where activity_id % 3 = 0) select activity_id from act where activity_id % 3 <> 0 and not exists (select 1 from old where old.start_time = act.start_time and old.sport_type = act.sport_type)")
def joi05_antidup(spark, sf_dir):
    a = _acts(spark, sf_dir)
    return ops.new_activities(a.where("activity_id % 3 <> 0"), a.where("activity_id % 3 = 0")).select("activity_id")


@query(f"with {ACT} select activity_id, case when duration_s > 7000 then 'duration' else 'distance' end as reason from act where duration_s > 7000 or distance_m > 15000")
def snk03_implausible(spark, sf_dir):
    return ops.implausible(_acts(spark, sf_dir), 7000, 15_000.0).select("activity_id", "reason")


@query(f"with {ACT} select activity_id from (select activity_id, avg_hr, avg_cadence_spm as max_hr from act) where not (avg_hr between 30 and 250) or not (max_hr between 30 and 250) or max_hr < avg_hr")
def flt07_heart_rates(spark, sf_dir):
    a = _acts(spark, sf_dir).withColumn("max_hr", F.col("avg_cadence_spm"))
    return ops.bad_heart_rates(a).select("activity_id")


_BODY = "select c_custkey, 45 + c_custkey % 60 as w, 150 + c_custkey % 45 as h, 18 + c_custkey % 50 as a, case when c_nationkey % 2 = 0 then 'female' else 'male' end as g, case c_mktsegment when 'HOUSEHOLD' then 'fat_loss' else 'health' end as goal, c_custkey % 9 as days from customer"
_NUT = f"""with b as ({_BODY}), c as (select *, 10.0::double * w + 6.25::double * h - 5.0::double * a + case g when 'male' then 5 else -161 end as bmr, [1.20, 1.30, 1.38, 1.46, 1.55, 1.64, 1.72]::double[] as f from b),
d as (select *, bmr * f[least(days, 6) + 1] as tdee from c), e as (select *, case goal when 'fat_loss' then greatest(tdee - 400, bmr * 1.1::double) else tdee end as target from d),
g as (select *, {pr('w * 1.8::double', 0)} as protein, greatest({pr('w * 0.9::double', 0)}, {pr('target * 0.2::double / 9', 0)}) as fat from e)
select c_custkey, {pr('bmr', 0)}::bigint as bmr, {pr('tdee', 0)}::bigint as tdee, {pr('target', 0)}::bigint as target_kcal, (case goal when 'fat_loss' then {pr('tdee - target', 0)} else 0 end)::bigint as deficit_kcal, protein::bigint as protein_g, fat::bigint as fat_g,
  greatest({pr('(target - protein * 4 - fat * 9) / 4', 0)}, 0)::bigint as carb_g from g"""


@query(_NUT)
def fn10_nutrition(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    t = physio.nutrition_targets(45 + k % 60, 150 + k % 45, 18 + k % 50, F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "fat_loss").otherwise("health"), (k % 9).cast("int"))
    return c.select("c_custkey", t.alias("t")).select("c_custkey", *[f"t.{x}" for x in ("bmr", "tdee", "target_kcal", "deficit_kcal", "protein_g", "fat_g", "carb_g")])


@query(f"with {ACT} select activity_id, {pr('res_met', 6)} as reserve, {pr('met', 3)} as met from (select activity_id, met, least(greatest((met - 1) / (15.0 * 190 / 60 / 3.5 - 1), 0), 1) as res_met from a4)")
def fn03_met(spark, sf_dir):
    met = physio.met_for(F.col("sport_type"), F.col("avg_speed_mps"))
    return _acts(spark, sf_dir).select("activity_id", pyround(physio.reserve_from_met(met), 6).alias("reserve"), pyround(met, 3).alias("met"))


PLAN = f"""
p0 as (select c_custkey as plan_id, i as day, case when (c_custkey + i) % 7 = 0 and c_custkey % 3 <> 0 then 'rest' when (c_custkey + i) % 5 = 0 then 'interval' when (c_custkey * i) % 4 = 1 then 'tempo' when i = 6 then 'long' else 'easy' end as kind,
  (c_custkey * (i + 3)) % 12 as km, (c_custkey * (i + 5)) % 70 as minutes from customer, range(7) r(i) where c_custkey % 50 <> 0 or i < 6),
ctx as (select c_custkey as plan_id, [c_custkey % 40, c_custkey % 31, c_custkey % 23, c_custkey % 47]::double[] as last4, (c_custkey % 20) / 10.0::double as acwr, (c_custkey % 50) - 30 as tsb, (c_custkey % 80)::double as longest, -(c_custkey % 20) / 10.0::double as trend, case when c_custkey % 4 = 0 then 'fat_loss' else 'health' end as goal,
  c_custkey % 6 = 0 as pain, (c_custkey % 10) / 10.0::double as est from customer)"""


@query(
    f"""with {PLAN}, t as (select plan_id, count(*) as n, bool_or(kind = 'rest') as has_rest, sum(km)::double as km, sum(minutes)::double as mins, coalesce(sum(minutes) filter (kind in ('interval', 'tempo')), 0)::double as hard_min, bool_or(kind in ('interval', 'tempo', 'long')) as hard, max(minutes)::double as most from p0 group by 1),
j as (select *, list_avg(last4) as base from t join ctx using (plan_id))
select plan_id, list_filter([case when n <> 7 then 'days' end, case when not has_rest then 'no_rest' end, case when base > 1 and km > base * 1.1::double then 'volume' end, case when mins > 0 and hard_min / mins > 0.2::double then 'intensity' end,
  case when acwr > 1.3::double then 'acwr' end, case when acwr > 1.3::double and km > base then 'acwr_volume' end, case when est >= 0.3::double and (acwr > 1.3::double or tsb < -20) then 'estimated' end, case when tsb < -20 and hard then 'tsb' end, case when longest > 0 and most > longest * 1.1::double then 'longest' end,
  case when goal = 'fat_loss' and trend < -1 then 'weight' end, case when pain and hard then 'pain' end], lambda x: x is not null).array_to_string(',') as findings from j"""
)
def val01_plan_rules(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = lambda i: F.when(((k + i) % 7 == 0) & (k % 3 != 0), "rest").when((k + i) % 5 == 0, "interval").when((k * i) % 4 == 1, "tempo").when(F.lit(i) == 6, "long").otherwise("easy")
    day = lambda i: F.struct(kind(i).alias("kind"), ((k * (i + 3)) % 12).cast("double").alias("km"), ((k * (i + 5)) % 70).cast("double").alias("minutes"))
    days = F.array(*[day(i) for i in range(7)])
    plans = c.select(
        k.alias("plan_id"),
        F.when(k % 50 == 0, F.slice(days, 1, 6)).otherwise(days).alias("days"),
        F.array(*[(k % m).cast("double") for m in (40, 31, 23, 47)]).alias("last4_km"),
        ((k % 20) / 10).alias("acwr"),
        ((k % 50) - 30).alias("tsb"),
        (k % 80).cast("double").alias("longest_min"),
        (-(k % 20) / 10).alias("weight_trend"),
        F.when(k % 4 == 0, "fat_loss").otherwise("health").alias("goal"),
        (k % 6 == 0).alias("pain"),
        ((k % 10) / 10).alias("estimated_ratio"),
    )
    return rules.check(plans).select("plan_id", _joined("findings").alias("findings"))
