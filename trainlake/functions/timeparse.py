"""Times of workout files as naive local times: what carries a zone is moved to a fixed offset, what carries none stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_HOURS = 8
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
STAMP = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def parse_time(raw: Column, offset_hours: int = OFFSET_HOURS) -> Column:
    """ISO 8601 with or without zone, dates with - or /, with or without seconds; null otherwise."""
    s = F.trim(raw)
    zone = F.regexp_extract(s, ZONE, 1)
    clock = s.rlike(r"\d:\d{2}.*" + ZONE)
    bare = F.regexp_replace(F.when(clock, F.regexp_replace(s, ZONE, "")).otherwise(s), "/", "-")
    local = F.when(bare.rlike(STAMP), bare.try_cast("timestamp_ntz"))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(digits == "", 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    shift = F.lit(offset_hours * 60) - minutes
    return F.when(clock, local + F.make_dt_interval(F.lit(0), F.lit(0), shift, F.lit(0))).otherwise(local)


def from_epoch(seconds: Column, offset_hours: int = OFFSET_HOURS) -> Column:
    """Naive local time of seconds (or milliseconds, from 10^12) since 1970; null below 10^9, where numbers are elapsed seconds."""
    s = F.when(seconds >= 1e12, seconds / 1000.0).otherwise(seconds)
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(s >= 1e9, base + F.make_dt_interval(F.lit(0), F.lit(offset_hours), F.lit(0), s.cast("decimal(18,6)")))


def parse_time_or_epoch(raw: Column, offset_hours: int = OFFSET_HOURS) -> Column:
    s = F.trim(raw)
    return F.when(s.rlike(r"^\d{10,13}(\.\d+)?$"), from_epoch(s.try_cast("double"), offset_hours)).otherwise(parse_time(s, offset_hours))


def elapsed(raw: Column) -> Column:
    """Seconds of 330, 5:30 or 1:02:03."""
    s = F.trim(raw)
    parts = F.transform(F.split(s, ":"), lambda x: x.try_cast("double"))
    return F.when(s.rlike(r"^\d+(\.\d+)?(:\d{1,2}(\.\d+)?){0,2}$"), F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x))


def pace(raw: Column) -> Column:
    """Seconds a km of 5:30, 5'30" or a number; null for 0."""
    s = F.trim(raw)
    m = r"""^(\d+)[:'′](\d{1,2})["″]?$"""
    v = F.when(s.rlike(m), F.regexp_extract(s, m, 1).try_cast("double") * 60 + F.regexp_extract(s, m, 2).try_cast("double")).otherwise(s.try_cast("double"))
    return F.when(v > 0, v)


#: Sport -> parts of its names, in order.
SPORTS = {
    "cycling": ["cycl", "bik", "骑行", "单车", "自行车", "骑车"],
    "swimming": ["swim", "游泳", "泳池", "开放水域"],
    "walking": ["walk", "hik", "步行", "徒步", "健走", "散步", "登山", "越野走"],
    "running": ["run", "跑步", "越野跑", "慢跑"],
}


def sport_strict(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    out = F.lit(None).cast("string")
    for sport, names in reversed(SPORTS.items()):
        out = F.when(low.rlike("|".join(names)), sport).otherwise(out)
    return out


def sport(raw: Column) -> Column:
    return F.coalesce(sport_strict(raw), F.lit("running"))


def pace_text(seconds: Column) -> Column:
    """m'ss", seconds cut."""
    whole = F.floor(seconds)
    return F.format_string("%d'%02d\"", F.floor(whole / 60), whole % 60)
