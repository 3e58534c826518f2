"""Readers of workout files. Each takes files (path string, content string or binary) and gives samples (path, seq, t, lat, lon, alt, hr,
cad, speed) and headers (path, sport_type, start_time, n_samples, error, warnings); files are read by Spark's own sources."""

from __future__ import annotations

import csv
import io
import json
import re
from itertools import chain, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import timeparse

SAMPLE = ["path", "seq", "t", "lat", "lon", "alt", "hr", "cad", "speed"]
KINDS = {"gpx": "gpx", "tcx": "tcx", "csv": "csv", "json": "json"}
_POINT = "struct<_lat:double,_lon:double,ele:double,time:string,extensions:string>"
GPX = f"struct<trk:array<struct<type:string,trkseg:array<struct<trkpt:array<{_POINT}>>>>>>"
_TRACKPOINT = "struct<Time:string,Position:struct<LatitudeDegrees:double,LongitudeDegrees:double>,AltitudeMeters:double,HeartRateBpm:struct<Value:double>,Cadence:double,Extensions:string>"
TCX = f"struct<Activities:struct<Activity:array<struct<_Sport:string,Lap:array<struct<Track:array<struct<Trackpoint:array<{_TRACKPOINT}>>>>>>>>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (gpx, tcx, csv, json; null: unknown type) and content of all files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("kind", F.when(ext.isin(*KINDS), ext))


def rejects(files: DataFrame) -> DataFrame:
    return files.where("kind is null").select("path", F.lit("unknown file type").alias("error"))


def _tag(xml: Column, *keys: str) -> Column:
    """Number in the first element whose tag holds one of the keys."""
    return F.regexp_extract(xml, r"(?i)<[^<>/]*(?:" + "|".join(keys) + r")[^<>]*>\s*([0-9.]+)", 1).try_cast("double")


def _timed(points: DataFrame) -> DataFrame:
    """t: seconds from the first time of the file; the sample's place where the file has no times."""
    at = timeparse.parse_time(F.col("time"))
    w = W.partitionBy("path")
    rows = points.withColumn("_at", at)
    first = F.first("_at", ignorenulls=True).over(w.orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("start_time", first)
    seconds = (F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    return rows.withColumn("t", F.when(F.col("start_time").isNull(), F.col("seq").cast("double")).otherwise(seconds))


def read_gpx(files: DataFrame) -> DataFrame:
    """All tracks, segments and points in order, with start_time and sport_type; heart rate, cadence and speed from extensions."""
    x = files.select("path", F.from_xml("content", GPX, {"ignoreNamespace": "true", "rowTag": "gpx"}).alias("g"))
    kind = F.get(F.filter(F.transform("g.trk", lambda t: F.trim(t["type"])), lambda s: s != ""), F.lit(0))
    points = F.flatten(F.flatten(F.transform("g.trk", lambda t: F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    rows = x.select("path", timeparse.sport(kind).alias("sport_type"), F.posexplode(points).alias("seq", "p"))
    ext = F.col("p.extensions")
    out = rows.select("path", "sport_type", "seq", F.col("p.time").alias("time"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("alt"), _tag(ext, "hr", "heart").cast("int").alias("hr"), _tag(ext, "cad").alias("cad"), _tag(ext, "speed").alias("speed"))
    return _timed(out).select(*SAMPLE, "sport_type", "start_time")


def read_tcx(files: DataFrame) -> DataFrame:
    """All laps and tracks in order. Cadence is doubled where its maximum is under 130 on foot: then it counts one leg."""
    x = files.select("path", F.from_xml("content", TCX, {"ignoreNamespace": "true", "rowTag": "TrainingCenterDatabase"}).alias("g"))
    laps = F.flatten(F.transform("g.Activities.Activity", lambda a: a["Lap"]))
    points = F.flatten(F.flatten(F.transform(laps, lambda lap: F.transform(lap["Track"], lambda t: t["Trackpoint"]))))
    rows = x.select("path", timeparse.sport(F.get("g.Activities.Activity", F.lit(0))["_Sport"]).alias("sport_type"), F.posexplode(points).alias("seq", "p"))
    ext = F.col("p.Extensions")
    out = rows.select("path", "sport_type", "seq", F.col("p.Time").alias("time"), F.col("p.Position.LatitudeDegrees").alias("lat"), F.col("p.Position.LongitudeDegrees").alias("lon"), F.col("p.AltitudeMeters").alias("alt"), F.col("p.HeartRateBpm.Value").cast("int").alias("hr"), F.coalesce("p.Cadence", _tag(ext, "cadence")).alias("cad"), _tag(ext, "speed").alias("speed"))
    most = F.max(F.nullif("cad", F.lit(0.0))).over(W.partitionBy("path"))
    one_leg = F.col("sport_type").isin("running", "walking") & (most < 130)
    return _timed(out).withColumn("cad", F.when(one_leg, F.col("cad") * 2).otherwise(F.col("cad"))).select(*SAMPLE, "sport_type", "start_time")


#: Field -> names of its column; names of the sport column match exactly.
ALIASES = {
    "t": ["t", "time", "elapsed", "sec", "秒", "时间", "用时"],
    "date": ["date", "日期"],
    "hr": ["hr", "heart", "heartrate", "heart_rate", "bpm", "心率"],
    "cad": ["cad", "cadence", "steprate", "step_rate", "spm", "步频"],
    "speed": ["speed", "velocity", "mps", "速度"],
    "pace": ["pace", "配速"],
    "alt": ["alt", "altitude", "elev", "海拔", "高度"],
    "lat": ["lat", "latitude", "纬度"],
    "lon": ["lon", "lng", "longitude", "经度"],
    "dist": ["dist", "distance", "距离"],
}
SPORT_NAMES = ["sport", "sporttype", "sport_type", "type", "activitytype", "运动类型", "活动类型", "锻炼类型", "运动"]


def _header_score(header: str, alias: str) -> int:
    """3: the alias as a word or without separators; 2: inside (three letters or more; Chinese anywhere); 0: no match."""
    if re.search("[一-鿿]", alias):
        return 0 if alias not in header else 3 if header == alias else 2
    if len(alias) == 1:
        return 3 if header == alias else 0
    tight, key = (re.sub("[^a-z0-9]", "", x) for x in (header, alias))
    if re.search(rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])", header) or tight == key:
        return 3
    return 2 if len(key) >= 3 and key in tight else 0


def _assign(cells: list[str]) -> dict[str, int]:
    """Field -> column: the best scores first, then the leftmost column, every field and column once."""
    heads = [re.sub(r"\s+", " ", re.sub(r"[（(\[][^）)\]]*[）)\]]", " ", c.strip().lower())).strip() for c in cells]
    found = [(-max(_header_score(h, a) for a in names), i, f) for i, h in enumerate(heads) for f, names in ALIASES.items()]
    found += [(-4, i, "sport") for i, h in enumerate(heads) if re.sub(r"[\s_-]+", "", h) in {n.replace("_", "") for n in SPORT_NAMES}]
    out: dict[str, int] = {}
    for score, i, f in sorted(found, key=lambda x: x[:2]):
        if score < 0 and f not in out and i not in out.values():
            out[f] = i
    return out


def _find_header(rows: list[list[str]]) -> tuple[int, dict[str, int]]:
    """(place, field -> column) of the row with most known columns."""
    at, fields = 0, {}
    for i, r in enumerate(rows):
        if len(m := _assign(r)) > len(fields):
            at, fields = i, m
    return at, fields


_CSV = "path string, seq int, cells array<string>, fields map<string,int>"


def _split_csv(batches, top: int = 10):
    """Rows (path, seq, cells, fields) of each file: the cells of what stands over the header as seq -1, then data rows from 0; blank rows are
    left out. The header is the best of the first `top` rows. Quoted cells may hold commas and line ends. A file is read once."""
    csv.field_size_limit(1 << 30)
    out = []
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            rows = ([c.strip() for c in r] for r in csv.reader(io.StringIO((content or "").removeprefix("\ufeff"), newline="")) if any(c.strip() for c in r))
            first = list(islice(rows, top))
            at, fields = _find_header(first)
            out.append((path, -1, [c for r in first[:at] for c in r], fields))
            for seq, cells in enumerate(chain(first[at + 1 :], rows)):
                out.append((path, seq, cells, fields))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=["path", "seq", "cells", "fields"])
                    out = []
    yield pd.DataFrame(out, columns=["path", "seq", "cells", "fields"])


def _judge_csv(files: DataFrame) -> DataFrame:
    """All rows of all files (seq -1: the file itself) with what holds of their file: one parse and one exchange by file."""
    ship(files.sparkSession)
    rows = files.select("path", "content").mapInPandas(_split_csv, _CSV)
    data = F.col("seq") >= 0
    cell = lambda f: F.when(data & F.col("fields")[f].isNotNull(), F.nullif(F.trim(F.get("cells", F.col("fields")[f])), F.lit("")))
    number = lambda f: cell(f).try_cast("double")
    rows = rows.withColumns({"raw": cell("t"), "day": cell("date"), "sport_cell": cell("sport")})
    rows = rows.withColumns({"at_time": timeparse.parse_time_or_epoch(F.col("raw")), "rel": timeparse.elapsed(F.col("raw"))})
    rows = rows.withColumns({"speed": F.coalesce(number("speed"), 1000.0 / timeparse.pace(cell("pace"))), "lat": number("lat"), "lon": number("lon"), "alt": number("alt"), "hr": number("hr").cast("int"), "cad": number("cad")})
    line = W.partitionBy("path").orderBy("seq")
    upto, every = line.rowsBetween(W.unboundedPreceding, 0), line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    over = lambda x: x.over(every)
    first = lambda x: over(F.first(x, ignorenulls=True))
    rows = rows.withColumns({"start_time": first("at_time"), "first_raw": first("raw")})
    absolute = F.col("start_time").isNotNull()
    rows = rows.withColumn("dated", absolute & ~F.coalesce(F.col("first_raw").rlike(r"\d{1,2}:\d{2}|^\d{10,13}$"), F.lit(False)))
    seconds = (F.unix_micros(F.col("at_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    # a time that is missing is the one before it; elapsed seconds that are missing are the row's number
    carried = F.coalesce(F.last(seconds, ignorenulls=True).over(upto), F.lit(0.0))
    rows = rows.withColumn("t", F.when(data, F.when(absolute, carried).otherwise(F.coalesce("rel", F.col("seq").cast("double")))))
    rows = rows.withColumn("falls", F.col("t") < F.lag("t").over(line))
    rows = rows.withColumns(
        {
            "n_rows": over(F.count_if(data)),
            "n_rel": over(F.count("rel")),
            "n_days": F.size(over(F.collect_set(timeparse.parse_time(F.col("day")).cast("date")))),
            "any_fall": over(F.bool_or(F.coalesce("falls", F.lit(False)))),
            "moves": F.coalesce(over(F.bool_or(F.col("speed").isNotNull() | (F.col("lat").isNotNull() & F.col("lon").isNotNull()))), F.lit(False)),
            "sport_cell": first(timeparse.sport_strict(F.col("sport_cell"))),
        }
    )
    has = lambda f: F.col("fields")[f].isNotNull()
    error = (
        F.when(F.col("n_rows") == 0, "no_data")
        .when(F.size("fields") == 0, "no_header")
        .when(~has("t"), F.when(has("date"), "daily_table").otherwise("no_time"))
        .when(F.col("dated"), "daily_table")
        .when(~absolute & (F.col("n_rel") == 0), "bad_time")
        .when(F.col("n_days") >= 3, "daily_table")
        .when(F.col("any_fall"), "not_rising")
    )
    return rows.withColumns({"error": error, "absolute": absolute})


def read_csv(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, headers). A file with an error has no samples. Errors: no_data, no_header, daily_table, no_time, bad_time, not_rising;
    warnings: relative_time, no_distance. The kind of a time column is judged by its first cell; a missing absolute time is the one
    before it, a missing elapsed time the row's number. Both results read a file once; whoever needs both keeps the rows."""
    rows = _judge_csv(files)
    return _csv_samples(rows), _csv_headers(rows)


def _csv_samples(rows: DataFrame) -> DataFrame:
    return rows.where("seq >= 0 and error is null").select(*SAMPLE)


def _csv_headers(rows: DataFrame) -> DataFrame:
    sniffed = F.get(F.filter(F.transform("cells", timeparse.sport_strict), lambda s: s.isNotNull()), F.lit(0))
    warnings = F.array_compact(F.array(F.when(~F.col("absolute"), "relative_time"), F.when(~F.col("moves"), "no_distance")))
    return rows.where("seq = -1").select("path", F.coalesce("sport_cell", sniffed, F.lit("running")).alias("sport_type"), F.when(F.col("absolute"), F.col("start_time")).alias("start_time"), F.col("n_rows").alias("n_samples"), "error", warnings.alias("warnings"))


#: Names of fields in JSON exports; longer names may match inside a key.
JSON_KEYS = {
    "t": ["time", "t", "timestamp", "second", "elapsed"],
    "hr": ["heartrate", "hr", "heart", "bpm"],
    "cad": ["steprate", "cadence", "cad", "stepfrequency", "frequency"],
    "speed": ["speed", "velocity", "pacespeed"],
    "lat": ["latitude", "lat"],
    "lon": ["longitude", "lon", "lng"],
    "alt": ["altitude", "alt", "elevation"],
    "start": ["starttime", "begintime", "start", "time", "date"],
    "sport": ["sporttype", "sport", "activitytype", "type"],
}
LIST_KEYS = ["datalist", "pointlist", "points", "samples", "details", "trajectory", "track", "records", "list"]

#: A list of objects with one of these keys is one of points, whatever its name.
POINT_KEYS = {"heartrate", "hr", "heart", "time", "timestamp"}


def pick(fields: Column, names: list[str]) -> Column:
    """Value of a map by name: an equal key, else a key that begins with a two-letter name, else one that holds a longer name."""
    entries = F.map_entries(fields)
    norm = lambda e: F.regexp_replace(F.lower(e["key"]), "[_ ]", "")
    first = lambda test: F.get(F.filter(entries, lambda e: test(norm(e))), F.lit(0))["value"]
    short, long = [n for n in names if len(n) == 2], [n for n in names if len(n) >= 3]
    never = lambda k: F.lit(False)
    return F.coalesce(
        first(lambda k: k.isin(*names)),
        first((lambda k: k.rlike("^(" + "|".join(short) + ")")) if short else never),
        first((lambda k: k.rlike("|".join(long))) if long else never),
    )


def _records_like(v) -> bool:
    return isinstance(v, list) and bool(v) and isinstance(v[0], dict)


def _dict_lists(node, depth: int, width: int, path: str = "$") -> list[tuple[str, list]]:
    """(path, list) of the outermost lists of objects under the keys of a JSON value, `depth` more levels down, `width` items of
    a list."""
    if depth < 0:
        return []
    if isinstance(node, dict):
        below = ((f"{path}.{k}", v) for k, v in node.items())
        return [x for at, v in below for x in ([(at, v)] if _records_like(v) else _dict_lists(v, depth - 1, width, at))]
    return [x for i, v in enumerate(node[:width]) for x in _dict_lists(v, depth - 1, width, f"{path}[{i}]")] if isinstance(node, list) else []


def _loads(content):
    try:
        return json.loads((content or "").lstrip("\ufeff"))
    except ValueError:
        return None


def _flat(d: dict) -> dict[str, str]:
    return {str(k): str(v) for k, v in d.items() if isinstance(v, (str, int, float)) and not isinstance(v, bool)}


#: Points (and records) of JSON that a task hands over at once; one file's are never split.
JSON_POINTS = 20_000
_RECORDS = ["path", "record", "n_records", "fields", "points"]


def _json_records(batches, depth: int, width: int, most: int):
    """Rows (path, record, fields, points) of the longest list of objects of each file: a record's own fields, and its longest list of
    points as maps. Rows are handed over as soon as they hold JSON_POINTS, so memory doesn't grow with the files of a batch."""
    out, held = [], 0
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            for row in _records_of(path, content, depth, width, most):
                out.append(row)
                held += 1 + len(row[4])
                if held >= JSON_POINTS:
                    yield pd.DataFrame(out, columns=_RECORDS)
                    out, held = [], 0
    yield pd.DataFrame(out, columns=_RECORDS)


def _records_of(path: str, content: str | None, depth: int, width: int, most: int):
    data = _loads(content)
    if data is None:
        return
    lists = [v for _, v in _dict_lists(data, depth, width)]
    records = max(lists, key=len) if lists else [data] if isinstance(data, dict) else []
    if isinstance(data, dict) and not any(_records_like(v) for r in records if isinstance(r, dict) for v in r.values()):
        records = [data]
    for i, rec in enumerate(r for r in records[:most] if isinstance(r, dict)):
        named = [v for k, v in rec.items() if _records_like(v) and any(n in re.sub("[_ ]", "", k.lower()) for n in LIST_KEYS)]
        other = [v for v in rec.values() if _records_like(v) and {re.sub("[_ ]", "", k.lower()) for k in v[0]} & POINT_KEYS]
        points = max(named or other, key=len, default=[])
        yield path, i, len(records), _flat(rec), [_flat(p) for p in points if isinstance(p, dict)]


def probe_json(files: DataFrame, depth: int = 6, width: int = 50, candidates: int = 12, keys: int = 20, top: int = 30) -> DataFrame:
    """path, is_list, top_keys and candidates (array of path, count, keys): what a JSON file of unknown shape holds, without
    importing it. Files that are no JSON have nulls. The numbers bound the report, not what is searched."""
    ship(files.sparkSession)

    def look(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                data = _loads(content)
                found = [{"path": at, "count": len(v), "keys": list(map(str, v[0]))[:keys]} for at, v in _dict_lists(data, depth, width)[:candidates]]
                tops = list(map(str, data))[:top] if isinstance(data, dict) else []
                out.append((path, isinstance(data, list), tops, found) if data is not None else (path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "is_list", "top_keys", "candidates"])

    return files.select("path", "content").mapInPandas(look, "path string, is_list boolean, top_keys array<string>, candidates array<struct<path:string,count:int,keys:array<string>>>")


def read_json(files: DataFrame, least: int = 20, depth: int = 6, width: int = 50, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(samples, headers) of the record with most points in each file; headers tell how many records were found and how many have
    `least` points. Records are looked for `depth` levels deep and `width` items wide, and the first `most` of a file are compared;
    records_truncated says that a file has more. Only finding the lists in JSON of unknown shape is Python; fields are picked by columns."""
    ship(files.sparkSession)
    recs = files.select("path", "content").mapInPandas(lambda it: _json_records(it, depth, width, most), "path string, record int, n_records int, fields map<string,string>, points array<map<string,string>>")
    w = W.partitionBy("path").orderBy(F.size("points").desc(), "record")
    recs = recs.withColumns({"_n": F.row_number().over(w), "importable": F.count_if(F.size("points") >= least).over(W.partitionBy("path"))}).where("_n = 1")
    recs = recs.withColumns({"start_time": timeparse.parse_time_or_epoch(pick(F.col("fields"), JSON_KEYS["start"])), "sport_type": timeparse.sport(pick(F.col("fields"), JSON_KEYS["sport"]))})
    headers = files.select("path").join(recs.select("path", "sport_type", "start_time", F.size("points").alias("n_samples"), F.col("n_records").alias("records_found"), F.col("importable").alias("records_importable"), (F.col("n_records") > most).alias("records_truncated")), "path", "left")
    p = recs.select("path", "start_time", F.posexplode("points").alias("seq", "p"))
    get = lambda f: pick(F.col("p"), JSON_KEYS[f])
    number = lambda f: get(f).try_cast("double")
    start_s = (F.unix_micros(F.col("start_time").cast("timestamp")) / 1e6) - timeparse.OFFSET_HOURS * 3600
    at = timeparse.parse_time(get("t"))
    raw = F.coalesce(number("t"), (F.unix_micros(at.cast("timestamp")) / 1e6) - timeparse.OFFSET_HOURS * 3600 - start_s, F.col("seq").cast("double"))
    t = F.when(raw > 1e11, raw / 1000.0 - F.coalesce(start_s, F.lit(0.0))).otherwise(raw)
    samples = p.select("path", "seq", t.alias("t"), number("lat").alias("lat"), number("lon").alias("lon"), number("alt").alias("alt"), F.nullif(number("hr").cast("int"), F.lit(0)).alias("hr"), number("cad").alias("cad"), number("speed").alias("speed"))
    return samples, headers
