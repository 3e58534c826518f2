"""Queries on sample series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import pyround
from ..operators import ingest
from ..operators import samples as ops
from ..sources import tables
from .registry import pr, query

SAMPLES = """
s as (select user_id as activity_id, case when user_id % 3 = 0 then 'cycling' else 'running' end as sport_type, event_id as seq,
  cast((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) // 1000000 as double) as t,
  case when event_type <> 'signup' then 30 + (event_id % 1000) / 1000.0::double end as lat, case when event_type <> 'signup' then 110 + (event_id % 700) / 1000.0::double end as lon,
  case when event_type <> 'error' then 100 + value end as alt,
  case when k % 10 = 0 then 0 else 80 + k end as hr, case when event_type = 'click' then 0 else 150 + k % 30 end as cad,
  case when event_type <> 'view' then value / 40 end as speed
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)),
c as (select * from s where t is not null qualify row_number() over (partition by activity_id, t order by seq desc) = 1)
"""
RICH = f"""with {SAMPLES},
g as (select *, t - lag(t) over w as dt, lag(lat) over w as plat, lag(lon) over w as plon, last_value(alt ignore nulls) over (partition by activity_id order by t rows between unbounded preceding and 1 preceding) as palt from c window w as (partition by activity_id order by t)),
h as (select *, case when dt > 0 then coalesce(speed * dt, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))))) end as seg0 from g),
i as (select *, case when seg0 > 0 then seg0 end as seg from h),
r as (select * exclude (speed), coalesce(speed, seg / dt) as speed, case when seg / dt >= case when sport_type = 'cycling' then 0.8 else 0.5 end then dt else 0 end as moving,
  case when alt - palt > 0.5 then alt - palt else 0 end as climb from i),
e as (select *, case when cad > 0 then nullif(speed, 0) * 60 / cad end as stride from r)
"""
GAP = 100_000.0


@query(f"with {SAMPLES} select activity_id, t, seq, hr from c")
def win01_dedup(spark, sf_dir):
    return ops.last_of_each_time(tables.samples(spark, sf_dir)).select("activity_id", "t", "seq", "hr")


@query(RICH + f"select activity_id, t, {pr('seg', 3)} as seg, {pr('speed', 4)} as speed, {pr('moving', 1)} as moving from e")
def win02_distance(spark, sf_dir):
    r = ops.enrich(tables.samples(spark, sf_dir))
    return r.select("activity_id", "t", pyround("seg", 3).alias("seg"), pyround("speed", 4).alias("speed"), pyround("moving", 1).alias("moving"))


@query(RICH + f"select activity_id, t, {pr('climb', 2)} as climb, {pr('stride', 3)} as stride from e")
def win04_elevation(spark, sf_dir):
    r = ops.enrich(tables.samples(spark, sf_dir))
    return r.select("activity_id", "t", pyround("climb", 2).alias("climb"), pyround("stride", 3).alias("stride"))


_ZONES = "".join(f", {pr(f'coalesce(sum(case when share >= {lo} and share < {hi} then d end), 0)', 0)} as {z}" for z, lo, hi in (("z1", 0.5, 0.6), ("z2", 0.6, 0.7), ("z3", 0.7, 0.8), ("z4", 0.8, 0.9), ("z5", 0.9, 1.01)))
_ZONE_CTE = f"""
zd as (select activity_id, t, nullif(hr, 0) / 190.0::double as share, coalesce(t - lag(t) over (partition by activity_id order by t), 0) as d0 from c),
zz as (select activity_id, share, case when d0 < 0 or d0 > {GAP} then 1 else d0 end as d from zd),
z as (select activity_id{_ZONES} from zz group by 1)
"""
_DRIFT_CTE = """
hd as (select activity_id, nullif(hr, 0) as hr, row_number() over (partition by activity_id order by t) - 1 as i, count(*) over (partition by activity_id) as n from c),
dr as (select activity_id, case when max(n) >= 20 then avg(hr) filter (i >= n // 2) / avg(hr) filter (i < n // 2) - 1 end as hr_drift from hd group by 1)
"""


@query(f"with {SAMPLES}, {_ZONE_CTE} select * from z")
def agg02_zones(spark, sf_dir):
    return ops.zone_seconds(ops.last_of_each_time(tables.samples(spark, sf_dir)), max_gap_s=GAP)


@query(f"with {SAMPLES}, {_DRIFT_CTE} select activity_id, {pr('hr_drift', 4)} as hr_drift from dr")
def agg03_drift(spark, sf_dir):
    return ops.drift(ops.last_of_each_time(tables.samples(spark, sf_dir))).withColumn("hr_drift", pyround("hr_drift", 4))


@query(
    RICH
    + f""", {_ZONE_CTE}, {_DRIFT_CTE},
b as (select activity_id, max(sport_type) as sport_type, count(*) as n_samples, max(t) - min(t) as dur, coalesce(nullif(sum(moving), 0), max(t) - min(t)) as mov, coalesce(sum(seg), 0) as dist, sum(climb) as climb,
  avg(nullif(hr, 0)) as hr, max(nullif(hr, 0)) as max_hr, avg(nullif(cad, 0)) as cad, avg(nullif(stride, 0)) as stride from e group by 1),
v as (select *, case when mov <> 0 then dist / mov end as v from b),
m as (select *, case when sport_type = 'cycling' then greatest(4.0::double, coalesce(v, 0) * 3.6 * 0.35) else greatest(6.0::double, coalesce(v, 0) * 3.6 * 0.95) end as met from v),
x as (select *, case when hr is not null then least(greatest((hr - 60) / 130.0, 0), 1) else least(greatest((met - 1) / (15.0 * 190 / 60 / 3.5 - 1), 0), 1) end as res from m)
select x.activity_id, sport_type, n_samples, {pr('dur', 1)} as duration_s, {pr('mov', 1)} as moving_time_s, {pr('dist', 1)} as distance_m, {pr('climb', 1)} as elev_gain_m, {pr('hr', 1)} as avg_hr, max_hr,
  {pr('case when dist > 0 then nullif(mov, 0) / (dist / 1000) end', 1)} as avg_pace_s_per_km, {pr('cad', 1)} as avg_cadence_spm, {pr('stride', 3)} as avg_stride_m, {pr('nullif(v, 0)', 3)} as avg_speed_mps,
  {pr('met * 70.0 * (nullif(dur, 0) / 3600)', 1)} as calories, {pr('case when mov > 0 then mov / 60 * res * (0.64 * exp(1.92 * res)) when hr is not null then 0 end', 2)} as load,
  case when hr is not null then 'trimp' when nullif(mov, 0) is not null then 'met_estimate' else 'none' end as load_source, z1, z2, z3, z4, z5, {pr('hr_drift', 4)} as hr_drift
from x join z on z.activity_id = x.activity_id join dr on dr.activity_id = x.activity_id"""
)
def agg01_summary(spark, sf_dir):
    return ops.summarise(tables.samples(spark, sf_dir), weight_kg=70.0, max_gap_s=GAP)


@query(f"with {SAMPLES}, n as (select *, row_number() over (partition by activity_id order by t) - 1 as i, count(*) over (partition by activity_id) as n from c) select activity_id, t from n where n <= 40 or ((i * 40 + n - 1) // n < 40 and ((i * 40 + n - 1) // n) * n // 40 = i)")
def win08_downsample(spark, sf_dir):
    return ops.downsample(ops.last_of_each_time(tables.samples(spark, sf_dir)), 40).select("activity_id", "t")


@query(f"with {SAMPLES} select activity_id, t, {pr('case when speed > 0.3 then 1000.0 / speed end', 1)} as pace from c")
def prj04_series(spark, sf_dir):
    return ops.series(ops.last_of_each_time(tables.samples(spark, sf_dir))).select("activity_id", "t", "pace")


@query(f"with {SAMPLES} select activity_id, count(*) as n_points, min(lat) as lat_min, max(lat) as lat_max, min(lon) as lon_min, max(lon) as lon_max from c where lat is not null group by 1 having count(*) >= 2")
def flt06_tracks(spark, sf_dir):
    return ops.tracks(ops.last_of_each_time(tables.samples(spark, sf_dir)))


@query(
    f"""with {SAMPLES}, b as (select *, min(lat) over w as a0, max(lat) over w as a1, min(lon) over w as o0, max(lon) over w as o1 from c where lat is not null window w as (partition by activity_id)),
k as (select *, least(coalesce(580 / nullif(o1 - o0, 0), 1e9), coalesce(380 / nullif(a1 - a0, 0), 1e9)) as k from b)
select activity_id, t, {pr('10 + (lon - o0) * k')} as x, {pr('10 + (a1 - lat) * k')} as y from k"""
)
def fn08_fit_track(spark, sf_dir):
    return ops.fit_track(ops.last_of_each_time(tables.samples(spark, sf_dir))).select("activity_id", "t", "x", "y")


@query(f"with {SAMPLES} select activity_id, bool_or(coalesce(hr, 0) <> 0) as has_hr, bool_or(lat is not null) as has_place from s group by 1")
def agg25_any(spark, sf_dir):
    s = tables.samples(spark, sf_dir)
    return s.groupBy("activity_id").agg(F.bool_or(F.coalesce("hr", F.lit(0)) != 0).alias("has_hr"), F.bool_or(F.col("lat").isNotNull()).alias("has_place"))


@query(
    f"""with p as (select event_id, 30 + (event_id % 1000) / 1000.0::double as lat, 110 + (event_id % 700) / 1000.0::double as lon from events)
select event_id, {pr('2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 31.2) / 2), 2) + cos(radians(31.2)) * cos(radians(lat)) * pow(sin(radians(lon - 110.4) / 2), 2))))', 2)} as metres from p"""
)
def fn01_haversine(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    lat, lon = 30 + (F.col("event_id") % 1000) / 1000, 110 + (F.col("event_id") % 700) / 1000
    return e.select("event_id", pyround(geo.haversine(F.lit(31.2), F.lit(110.4), lat, lon), 2).alias("metres"))


_GCJ = """
with p as (select event_id, 30 + (event_id % 1000) / 1000.0::double as lat, case when event_id % 50 = 0 then 5.0 else 110 + (event_id % 700) / 1000.0::double end as lon from events),
q as (select *, lon - 105 as x, lat - 35 as y, pi() as p from p),
r as (select *, (20 * sin(6 * x * p) + 20 * sin(2 * x * p)) * 2 / 3 as ripple from q),
d as (select *, -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + ripple + (20 * sin(y * p) + 40 * sin(y / 3 * p)) * 2 / 3 + (160 * sin(y / 12 * p) + 320 * sin(y * p / 30)) * 2 / 3 as dlat,
  300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + ripple + (20 * sin(x * p) + 40 * sin(x / 3 * p)) * 2 / 3 + (150 * sin(x / 12 * p) + 300 * sin(x / 30 * p)) * 2 / 3 as dlon,
  1 - 0.00669342162296594323 * pow(sin(radians(lat)), 2) as magic from r)
"""


@query(
    _GCJ
    + f"""select event_id, {pr('case when lon between 72.004 and 137.8347 then lat + dlat * 180 / ((6378245.0 * (1 - 0.00669342162296594323)) / (magic * sqrt(magic)) * p) else lat end', 6)} as lat,
  {pr('case when lon between 72.004 and 137.8347 then lon + dlon * 180 / (6378245.0 / sqrt(magic) * cos(radians(lat)) * p) else lon end', 6)} as lon from d"""
)
def fn07_gcj02(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    lon = F.when(F.col("event_id") % 50 == 0, 5.0).otherwise(110 + (F.col("event_id") % 700) / 1000)
    g = geo.wgs84_to_gcj02(30 + (F.col("event_id") % 1000) / 1000, lon)
    return e.select("event_id", g.alias("g")).select("event_id", pyround("g.lat", 6).alias("lat"), pyround("g.lon", 6).alias("lon"))


@query(
    f"""with {SAMPLES}, m as (select activity_id, {pr('avg(nullif(hr, 0)) filter (activity_id % 4 <> 0)', 1)} as hr, max(t) - min(t) as dur, activity_id % 4 = 0 as typed from c group by 1)
select activity_id, case when typed and activity_id % 8 = 0 then 150.0::double else hr end as avg_hr, {pr('dur', 1)} as duration_s, case when typed and activity_id % 8 = 0 then {pr('30.0::double * (90 / 130.0::double) * (0.64 * exp(1.92::double * (90 / 130.0::double)))')} end as typed_load from m"""
)
def snk06_recalc(spark, sf_dir):
    """Every fourth activity has no heart rate in its samples; half of these have one that was typed in, which stays."""
    s = tables.samples(spark, sf_dir).withColumn("hr", F.when(F.col("activity_id") % 4 != 0, F.col("hr")))
    k = F.col("activity_id")
    acts = s.select("activity_id", "sport_type").distinct().select(k, "sport_type", F.when(k % 8 == 0, 150.0).alias("avg_hr"), F.lit(1800.0).alias("duration_s"), F.lit(0.0).alias("moving_time_s"), F.lit(1.0).alias("load"), F.lit("none").alias("load_source"))
    out = ingest.recalculate(acts, s)
    return out.select("activity_id", "avg_hr", "duration_s", F.when(k % 8 == 0, F.col("load")).alias("typed_load"))

