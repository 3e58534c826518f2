"""Queries that write tables as workout files and screenshots and read them back with the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import pyround
from ..operators import ingest, recognition
from ..sources import tables, workouts
from .registry import pr, query

_E = """
e as (select user_id, event_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as seq, epoch(date_trunc('second', ts)) as s, (event_id % 900) / 10.0::double as lat, cast(json_extract_string(props, '$.k') as int) + 60 as hr, (event_id % 50 + 10) / 10.0::double as speed from events),
x as (select 'u' || user_id::varchar as path, seq, s - first_value(s) over (partition by user_id order by event_id) as t, lat, hr, speed, event_id from e)
"""


def _files(spark, sf_dir, line, glue, head, tail):
    """One file a user: a line an event in order, between head and tail."""
    e = tables.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") + 60
    e = e.select("user_id", "event_id", F.date_trunc("second", "ts").alias("ts"), ((F.col("event_id") % 900) / 10).alias("lat"), k.alias("hr"), ((F.col("event_id") % 50 + 10) / 10).alias("speed"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("x")))).alias("xs"))
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit(head), F.array_join("xs.x", glue), F.lit(tail)).alias("content"))


def _second(n):
    """The n-th second from 2024 on as local date and time; days follow one another however large n is."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(n / 86_400).cast("int")).cast("string")
    return F.format_string("%s %02d:%02d:%02d", day, F.floor(n / 3600) % 24, F.floor(n / 60) % 60, n % 60)


def _stamp(zone):
    return F.date_format("ts", f"yyyy-MM-dd'T'HH:mm:ss'{zone}'")


@query(f"with {_E} select path, seq, t::double as t, {pr('lat', 1)} as lat, hr from x")
def src02_gpx(spark, sf_dir):
    point = F.format_string('<trkpt lat="%.1f" lon="110.5"><ele>80</ele><time>%s</time><extensions><v:hr xmlns:v="x">%d</v:hr></extensions></trkpt>', "lat", _stamp("Z"), "hr")
    files = _files(spark, sf_dir, point, "", '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/0"><trk><type>running</type><trkseg>', "</trkseg></trk></gpx>")
    return workouts.read_gpx(files).select("path", "seq", "t", pyround("lat", 1).alias("lat"), "hr")


@query(f"with {_E} select path, seq, t::double as t, hr, 160.0::double as cad from x")
def src05_tcx(spark, sf_dir):
    point = F.format_string("<Trackpoint><Time>%s</Time><HeartRateBpm><Value>%d</Value></HeartRateBpm><Cadence>80</Cadence></Trackpoint>", _stamp("Z"), "hr")
    files = _files(spark, sf_dir, point, "", '<TrainingCenterDatabase><Activities><Activity Sport="Running"><Lap><Track>', "</Track></Lap></Activity></Activities></TrainingCenterDatabase>")
    return workouts.read_tcx(files).select("path", "seq", "t", "hr", "cad")


@query(f"with {_E} select path, seq, (event_id - min(event_id) over (partition by path))::double as t, hr, {pr('speed', 2)} as speed from x")
def src07_csv(spark, sf_dir):
    files = _files(spark, sf_dir, F.format_string('%s,"%d",%.2f', _second(F.col("event_id")), "hr", "speed"), "\n", "exported,,\nTime,心率(bpm),速度(m/s)\n", "\n")
    return workouts.read_csv(files)[0].select("path", "seq", "t", "hr", pyround("speed", 2).alias("speed"))


@query("select 'u' || user_id::varchar as path, count(*)::int as n_samples, 'cycling' as sport_type, '2023-09-05 15:46:40' as start_time from events group by 1")
def src19_json(spark, sf_dir):
    files = _files(spark, sf_dir, F.format_string('{"time": %d, "heartRate": %d}', F.col("event_id"), "hr"), ",", '{"record_list": [{"startTime": 1693900000, "sportType": "骑行", "dataList": [', "]}]}")
    h = workouts.read_json(files)[1]
    return h.select("path", "n_samples", "sport_type", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"))


@query(f"with {_E} select path, seq, event_id::double as t, hr from x")
def src19_samples(spark, sf_dir):
    """Points whose times are seconds from the start in files of even users, epochs in milliseconds in the others'."""
    k = F.col("event_id")
    files = _files(spark, sf_dir, F.format_string('{"time": %d, "heartRate": %d}', F.when(F.col("user_id") % 2 == 0, k).otherwise((k + 1_693_900_000) * 1000), "hr"), ",", '{"record_list": [{"startTime": 1693900000, "sportType": "骑行", "dataList": [', "]}]}")
    return workouts.read_json(files)[0].select("path", "seq", "t", "hr")


def _images(spark, sf_dir):
    """Keys of customer, dealt out to all cores: each becomes a screenshot of many blocks, while a million lie in one row group."""
    keys = tables.table(spark, sf_dir, "customer").select("c_custkey")
    return keys.repartition(4 * spark.sparkContext.defaultParallelism)


@query("select c_custkey as image_id, 'cycling' as sport_type, (c_custkey % 300 + 1) / 10.0::double as distance_km, " + pr("(c_custkey % 90 + 1) + (c_custkey % 60) / 60.0::double") + " as duration_min, (60 + c_custkey % 100)::double as avg_hr, (100 + c_custkey % 100)::double as max_hr from customer")
def rec01_recognise(spark, sf_dir):
    k = F.col("c_custkey")
    texts = [F.lit("户外骑行"), F.format_string("%.1f", (k % 300 + 1) / 10), F.lit("公里"), F.format_string("%d:%02d", k % 90 + 1, k % 60), F.lit("用时"), F.format_string("%d次/分", 60 + k % 100), F.lit("平均心率"), F.format_string("%d次/分", 100 + k % 100), F.lit("最大心率")]
    block = lambda t: F.struct(t.alias("text"), F.lit(0.9).alias("conf"), F.lit(None).cast("array<array<double>>").alias("bbox"))
    images = _images(spark, sf_dir).select(k.alias("image_id"), F.array(*[block(t) for t in texts]).alias("blocks"))
    return recognition.recognise(images, 2026).select("image_id", "sport_type", "distance_km", "duration_min", "avg_hr", "max_hr")


@query(
    f"""select k as image_id, 'cycling' as sport_type, (k % 300 + 1) / 10.0::double as distance_km, case when k % 5 <> 0 then {pr('(k % 3 + 1) * 60 + k % 60 + (k % 50) / 60.0::double')} end as duration_min, case when k % 7 <> 0 then (100 + k % 100)::double end as max_hr, (100 + k % 100)::double as avg_cadence_spm,
{pr('(60 + k % 60) / 100.0::double', 3)} as avg_stride_m, (k % 900)::double as elev_gain_m, (1 + k % 3000)::double as calories, '2026-' || lpad((k % 9 + 1)::varchar, 2, '0') || '-' || lpad((4 + k % 6)::varchar, 2, '0') || ' ' || (10 + k % 10)::varchar || ':' || lpad((k % 60)::varchar, 2, '0') || ':00' as start_time,
array_to_string(list_filter([case when k % 5 = 0 then 'duration_min' end, case when k % 7 = 0 then 'heart_rate' end], lambda x: x is not null), ',') as notes from (select c_custkey as k from customer)"""
)
def rec02_boxes(spark, sf_dir):
    """Labels with boxes: the value stands below or beside its label and comes after all labels, or above it and comes next. Digits of a
    chart are glued before a cadence, and of the hour behind a date; some images lack the duration or the heart rate."""
    k = F.col("c_custkey")
    kind = k % 3

    def block(t, x, y):
        x, y = (F.lit(v).cast("double") if isinstance(v, (int, float)) else v.cast("double") for v in (x, y))
        corners = F.array(*[F.array(x + dx, y + dy) for dx, dy in ((0.0, 0.0), (80.0, 0.0), (80.0, 30.0), (0.0, 30.0))])
        return F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(0.9).alias("conf"), corners.alias("bbox"))

    cells = [
        ("用时", F.format_string("%d:%02d:%02d", k % 3 + 1, k % 60, k % 50), k % 5 != 0),
        ("最大心率", F.format_string("%d次/分", 100 + k % 100), k % 7 != 0),
        ("步频", F.format_string("99%d步/分", 100 + k % 100), F.lit(True)),
        ("步幅", F.format_string("%d厘米", 60 + k % 60), F.lit(True)),
        ("累计爬升", F.format_string("%d米", k % 900), F.lit(True)),
        ("千卡", F.format_string("%d", 1 + k % 3000), F.lit(True)),
    ]
    labels = [F.when(there, block(label, 10, 400 * i)) for i, (label, _, there) in enumerate(cells)]
    values = [F.when(there, block(v, F.when(kind == 1, 210).otherwise(10), F.when(kind == 0, 40).when(kind == 1, 0).otherwise(-100) + 400 * i)) for i, (_, v, there) in enumerate(cells)]
    whole = [block("户外骑行", 2000, 9000), block(F.format_string("2026/%d/%d%d:%02d", k % 9 + 1, 4 + k % 6, 10 + k % 10, k % 60), 2000, 9400), block(F.format_string("%.1f公里", (k % 300 + 1) / 10), 2000, 9800)]
    order = F.when(kind == 2, F.array(*whole, *[x for pair in zip(labels, values, strict=True) for x in pair])).otherwise(F.array(*whole, *labels, *values))
    found = recognition.recognise(_images(spark, sf_dir).select(k.alias("image_id"), F.array_compact(order).alias("blocks")), 2026)
    return found.select("image_id", "sport_type", "distance_km", "duration_min", "max_hr", "avg_cadence_spm", "avg_stride_m", "elev_gain_m", "calories", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.array_join("notes", ",").alias("notes"))


@query("select c_custkey as image_id, 0.8::double as mean_conf, (length(c_name) - 1 + length(c_mktsegment))::bigint as n_chars from customer")
def agg27_block_stats(spark, sf_dir):
    block = lambda t, c: F.struct(t.alias("text"), F.lit(c).alias("conf"), F.lit(None).cast("array<array<double>>").alias("bbox"))
    images = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.array(block(F.col("c_name"), 0.7), block(F.col("c_mktsegment"), 0.9)).alias("blocks"))
    return recognition.block_stats(images)


_INGEST = """
f as (select user_id, event_id, ts, user_id::varchar || case when user_id % 2 = 0 then '-' || cast(ts as date)::varchar else '' end as name from events),
g as (select name, user_id, count(*) as n, epoch(date_trunc('second', arg_min(ts, event_id))) as first, epoch(date_trunc('second', min(ts))) as lo, epoch(date_trunc('second', max(ts))) as hi from f group by 1, 2),
h as (select 'u' || name || '.gpx' as path, * from g union all select 'v' || name || '.gpx', * from g where user_id % 3 = 0),
o as (select path, n, hi - lo as dur, user_id % 5 = 0 as known, first from h), k as (select distinct first from o where known),
i as (select o.*, k.first is not null as old from o left join k on k.first = o.first), j as (select *, min(case when not old and dur <= 86400 then path end) over (partition by first) as lead from i)
"""


def _ingest(spark, sf_dir):
    """A GPX file of all events of a user, or one of each day of every second user; a second copy of every third user's, a CSV file without
    a known header and a file of another type; starts of every fifth user are stored."""
    day = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("-"), F.to_date("ts").cast("string"))).otherwise("")
    e = tables.table(spark, sf_dir, "events").withColumn("name", F.concat(F.col("user_id").cast("string"), day))
    point = F.format_string('<trkpt lat="%.4f" lon="110.5"><time>%s</time></trkpt>', 30 + F.col("event_id") / 1e6, F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    files = e.groupBy("name", "user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", point.alias("x")))).alias("xs"), F.min_by("ts", "event_id").alias("first"))
    body = F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/0"><trk><type>running</type><trkseg>'), F.array_join("xs.x", ""), F.lit("</trkseg></trk></gpx>"))
    named = lambda c: F.concat(F.lit(c), "name", F.lit(".gpx"))
    gpx = files.select(named("u").alias("path"), F.lit("gpx").alias("kind"), body.alias("content")).union(files.where("user_id % 3 = 0").select(named("v"), F.lit("gpx"), body))
    others = spark.createDataFrame([("x.csv", "csv", "a,b\n1,2\n"), ("y.doc", None, "z")], "path string, kind string, content string")
    stored = files.where("user_id % 5 = 0").select((F.date_trunc("second", "first").cast("timestamp_ntz") + F.expr("interval 8 hours")).alias("start_time"), F.lit("running").alias("sport_type"))
    return ingest.ingest(gpx.union(others), stored)


@query(
    f"""with {_INGEST} select path, case when old or path > lead then 'duplicate' when dur > 86400 then 'duration' end as reason, n::bigint as n_samples, dur::double as duration_s from j
union all select 'x.csv', 'no_header', 1, null union all select 'y.doc', 'unknown_type', 0, null"""
)
def snk01_ingest(spark, sf_dir):
    return _ingest(spark, sf_dir)[2].select("path", "reason", "n_samples", "duration_s")


@query(f"with {_INGEST} select path as file_name, 'gpx' as source, 'running' as sport_type, n::bigint as n_samples from j where not old and dur <= 86400 and path = lead")
def snk01_stored(spark, sf_dir):
    """The activities that came in, with the number of samples stored for each."""
    acts, samples, _ = _ingest(spark, sf_dir)
    n = samples.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return acts.join(n, "activity_id").select("file_name", "source", "sport_type", "n_samples")


_CSV_CELLS = "select event_id, user_id, row_number() over (partition by user_id order by event_id) - 1 as seq from events"


@query(f"select 'u' || user_id::varchar as path, seq::int as seq, (event_id - min(event_id) over (partition by user_id))::double as t, (60 + event_id % 90)::int as hr from ({_CSV_CELLS})")
def src07_quoted(spark, sf_dir):
    """CSV files whose notes are quoted cells with commas, quotes and line ends."""
    line = F.format_string('%s,"a ""b"", %d\nc",%d', _second(F.col("event_id")), "event_id", 60 + F.col("event_id") % 90)
    return workouts.read_csv(_files(spark, sf_dir, line, "\r\n", "Time,Note,心率(bpm)\r\n", "\r\n"))[0].select("path", "seq", "t", "hr")


@query(
    """select 'u' || user_id::varchar as path, case when user_id % 8 = 6 then 'cycling' else 'running' end as sport_type, count(*) + case when user_id % 8 = 7 then 1 else 0 end as n_samples,
  case user_id % 8 when 0 then 'no_time' when 1 then 'daily_table' when 3 then case when count(*) > 1 then 'not_rising' end when 4 then 'bad_time'
    when 5 then case when count(distinct event_id % 28) >= 3 then 'daily_table' end when 7 then 'daily_table' end as error,
  case user_id % 8 when 5 then 'relative_time' when 6 then '' when 7 then 'no_distance' else 'relative_time,no_distance' end as warnings
from events group by user_id"""
)
def src14_headers(spark, sf_dir):
    """Headers of CSV files of eight shapes: no time column, dates alone, elapsed seconds, falling seconds, words for times, seconds beside
    several days, epochs with sport and places, and a bare date over times."""
    n = F.col("event_id")
    lines = [
        ("steps,hr", F.format_string("%d,%d", n, "hr")),
        ("date,hr", F.format_string("2024-01-%02d,%d", n % 28 + 1, "hr")),
        ("time,hr", F.format_string("%d,%d", n, "hr")),
        ("time,hr", F.format_string("%d,%d", 100_000_000 - n, "hr")),
        ("time,hr", F.format_string("x%d,%d", n, "hr")),
        ("date,time,hr,speed", F.format_string("2024-01-%02d,%d,%d,%.2f", n % 28 + 1, n, "hr", "speed")),
        ("time,sport,hr,lat,lon", F.format_string("%d,骑行,%d,%.1f,110.5", 1_704_067_200 + n, "hr", "lat")),
        ("time,hr\n2024-01-01,60", F.format_string("%d,%d", 1_704_067_200 + n, "hr")),
    ]
    pick = lambda of, column: F.element_at(F.array(*[x[of] if of else F.lit(x[0]) for x in lines]), (column % 8 + 1).cast("int"))
    e = _files(spark, sf_dir, pick(1, F.col("user_id")), "\n", "", "\n")
    head = F.concat(pick(0, F.substring("path", 2, 20).cast("long")), F.lit("\n"))
    h = workouts.read_csv(e.select("path", F.concat(head, "content").alias("content")))[1]
    return h.select("path", "sport_type", "n_samples", "error", F.array_join("warnings", ",").alias("warnings"))
