"""Workout fields from the text blocks of a screenshot: labels are matched with the blocks that stand below, beside or after them.

images: image_id, blocks array<struct<text string, conf double, bbox array<array<double>>>>. An image's blocks are matched within its
row, without joins or shuffles; a block's candidates are ordered by (tier, distance)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeparse
from ..functions.numbers import pyround


@dataclass(frozen=True)
class Field:
    labels: tuple[str, ...]
    low: float
    high: float
    unit: str = ""


#: Labels and plausible ranges of the fields; unit: characters behind a number that may have others glued before it.
FIELDS = {
    "distance_km": Field(("公里", "千米", "km", "距离"), 0, 500),
    "duration_min": Field(("时长", "用时", "历时", "运动时间"), 0, 1440),
    "max_hr": Field(("最大心率", "最高心率"), 30, 250),
    "avg_hr": Field(("平均心率", "心率", "avehr"), 30, 250),
    "avg_cadence_spm": Field(("步频", "步幅频率", "cadence", "spm"), 40, 260, "步次"),
    "avg_stride_m": Field(("步幅", "步长", "stride"), 0.2, 3.0, "厘米cm"),
    "elev_gain_m": Field(("爬升", "累计爬升", "攀升"), 0, 10000),
    "calories": Field(("千卡", "卡路里", "kcal", "热量", "消耗"), 1, 5000),
}
#: Words that tell the sport, blocks that are a unit alone, a number.
SPORT_LABELS = ("跑步", "骑行", "骑车", "单车", "步行", "走路", "游泳", "徒步", "健走", "户外", "训练")
UNIT_ONLY = r"(?i)^(次|步|米|公里|千米|厘米|千卡|卡路里|kcal|分钟|小时|km|cm|m|bpm|spm|步/分|次/分|步/分钟|次/分钟)[/分]?[\d\s]*$"
NUMBER = r"(-?\d+(?:\.\d+)?)"


def is_unit(t: Column) -> Column:
    """A unit without a value, with digits of a footnote at most."""
    s = F.trim(t)
    glued = s.rlike(r"[次步米公里千厘卡][\d/]") & ~s.rlike(r"\d{2,}") & ~s.rlike(r"^\d{1,3}(\.\d+)?\s*(厘米|米|公里|千米|cm|m|km|kcal|千卡)")
    return (s == "") | glued | s.rlike(UNIT_ONLY)


def number(t: Column) -> Column:
    """The first number of a text. A cast of no text to double costs a Java exception each, so texts without digits aren't cast."""
    return F.when(t.rlike(r"\d"), F.regexp_extract(t, NUMBER, 1).try_cast("double"))


def tailed(t: Column) -> Column:
    """The digits before a unit that may have others glued before them."""
    return F.regexp_replace(F.regexp_extract(t, NUMBER + r"\s*[步次厘米cm]", 1), "-", "")


def values(first: Column, tail: Column) -> Column:
    """Numbers a block may stand for, likeliest first: one before its unit and its endings (99171步: 99171, 9171, 171 ...), then the first."""
    n = F.length(tail)
    ends = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(tail, k, n).try_cast("double"))).otherwise(F.array().cast("array<double>"))
    return F.filter(F.flatten(F.array(ends, F.array(first))), lambda v: v.isNotNull())


def minutes(t: Column) -> Column:
    """h:mm:ss and h.mm.ss, else m:ss, in minutes."""
    of = lambda p, i: F.regexp_extract(t, p, i).try_cast("int").cast("double")
    full, dotted, short = r"(\d{1,2})[:：](\d{1,2})[:：](\d{2})", r"(\d{1,2})[.．](\d{2})[.．](\d{2})", r"(\d{1,2})[:：](\d{2})"
    hms = lambda p: of(p, 1) * 60 + of(p, 2) + of(p, 3) / 60
    return F.when(t.rlike(full), hms(full)).when(t.rlike(dotted), hms(dotted)).when(t.rlike(short), of(short, 1) + of(short, 2) / 60)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df and more columns, each worked out once a row. Spark puts a plain column's expression wherever it is used, in a lambda too."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def boxes(images: DataFrame) -> DataFrame:
    """images and bs, an array of a struct a block: i, text, conf, after (it and the next two texts), x, y, w, h (null without a box of
    four corners)."""
    texts = F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit("")))
    axis = lambda b, k: F.when(F.size(b["bbox"]) == 4, F.transform(b["bbox"], lambda p: F.get(p, F.lit(k))))
    raw = F.transform("blocks", lambda b: F.struct(b["conf"].alias("conf"), axis(b, 0).alias("xs"), axis(b, 1).alias("ys")))
    ends = lambda b, k: F.struct(F.array_min(b[k]).alias("low"), F.array_max(b[k]).alias("high"))
    df = _once(images, _texts=texts, _raw=raw)
    df = _once(df, _ends=F.transform("_raw", lambda b: F.struct(b["conf"].alias("conf"), ends(b, "xs").alias("x"), ends(b, "ys").alias("y"))))

    def block(b, i):
        t = F.get("_texts", i)
        middle = lambda k: (b[k]["low"] + b[k]["high"]) / 2
        size = lambda k: b[k]["high"] - b[k]["low"]
        return F.struct(
            i.alias("i"),
            t.alias("text"),
            b["conf"].alias("conf"),
            F.concat_ws(" ", t, F.get("_texts", i + 1), F.get("_texts", i + 2)).alias("after"),
            middle("x").alias("x"),
            middle("y").alias("y"),
            size("x").alias("w"),
            size("y").alias("h"),
        )

    return _once(df, bs=F.transform("_ends", block)).drop("_texts", "_raw", "_ends")


#: Passes over an image's blocks for a field, in order; all others take one.
PASSES = {"duration_min": ("mins", "duration_min")}


def _numbers(df: DataFrame) -> DataFrame:
    """df and ns, the blocks of bs that hold a number: as there, and for each pass what the block stands for if it is within the field's
    range; and distance: whether it decides a label's distance, plausible or not."""
    low, high = ({k: float(getattr(spec, end)) for k, spec in FIELDS.items()} for end in ("low", "high"))
    inside = lambda k, v: v.between(low[k], high[k])
    within = lambda k, v: (v > low[k]) & (v < high[k])
    likeliest = lambda k, vs: F.get(F.filter(vs, lambda x: inside(k, x)), F.lit(0))

    def read(b):
        t = b["text"]
        return F.struct(*[b[k].alias(k) for k in ("i", "text", "conf", "after", "x", "y", "w", "h")], minutes(t).alias("mins"), F.when(~is_unit(t), F.struct(number(t).alias("first"), tailed(t).alias("tail"))).alias("n"))

    def listed(b):
        return F.struct(b.alias("b"), F.when(b["n"].isNotNull(), values(b["n"]["first"], b["n"]["tail"])).alias("vs"))

    def km(v, after):
        metres = after.contains("米") & ~after.rlike("公里|千米")
        kilometres = after.rlike(r"公里|千米|(?i)\bkm\b")
        return F.when(within("distance_km", v), pyround(F.when(metres | (~kilometres & (v > 100)), v / 1000).otherwise(v), 3))

    def stride(v, after):
        return F.when(v < 1000, pyround(F.when(after.rlike("厘|(?i)cm") | ((v > 3) & (v < 300)), v / 100).otherwise(v), 3))

    def meant(r):
        b, v, vs = r["b"], r["b"]["n"]["first"], r["vs"]
        # only the likeliest number counts where another unit would change it
        out = {"distance_km": km(v, b["after"]), "avg_stride_m": likeliest("avg_stride_m", F.transform(F.slice(vs, 1, 1), lambda x: stride(x, b["after"])))}
        out |= {"mins": F.when(within("duration_min", b["mins"]), pyround(b["mins"], 2)), "duration_min": F.when(within("duration_min", v), pyround(v, 2))}
        for k, spec in FIELDS.items():
            if k not in out:
                out[k] = likeliest(k, vs) if spec.unit else F.when(inside(k, v), v)
        return F.struct(*[b[k].alias(k) for k in ("i", "text", "conf", "x", "y", "w", "h")], v.isNotNull().alias("distance"), *[c.alias(k) for k, c in out.items()])

    df = _once(df, _read=F.transform(F.filter("bs", lambda b: b["text"].rlike(r"\d")), read))
    df = _once(df, _listed=F.transform("_read", listed))
    return _once(df, ns=F.transform("_listed", meant)).drop("_read", "_listed")


def _place(field: str, a: Column, b: Column) -> Column:
    """(tier, far) of a block that may hold the value of label a; else null.

    Tiers: 0 the label's own block; 1 left neighbours (distance only); 2 below and aligned; 3 to the right in its row; 4 the next three.
    Without boxes tier 2 is the order -1, +1, -2, +2."""
    d, boxed = b["i"] - a["i"], a["x"].isNotNull()
    below = (b["y"] > a["y"]) & (b["y"] <= a["y"] + 6 * F.greatest(a["h"], b["h"]))
    aligned = F.abs(b["x"] - a["x"]) < 0.8 * F.greatest(a["w"], b["w"]) + 40
    beside = ~below & (F.abs(b["y"] - a["y"]) <= 0.6 * F.greatest(a["h"], b["h"])) & (b["x"] > a["x"])
    near = F.when(d < 0, -2 * d - 1).otherwise(2 * d)
    at = lambda tier, far: F.struct(F.lit(tier).alias("tier"), far.cast("double").alias("far"))
    place = F.when(d == 0, at(0, F.lit(0)))
    if field == "distance_km":
        place = place.when(d.isin(-1, -2), at(1, -d))
    place = place.when(boxed & below & aligned, at(2, b["y"] - a["y"])).when(boxed & beside, at(3, b["x"] - a["x"]))
    return place.when(~boxed & d.isin(-1, 1, -2, 2), at(2, near)).when(boxed & d.between(1, 3), at(4, d))


def _best(field: str, labels: Column) -> Column:
    """The first label with a value, and its first block of ns by (pass, tier, far, i)."""

    def found(a, n, k):
        def reading(b):
            place = _place(field, a, b)
            # only the first pass looks at the label's own block
            return F.struct(a["i"].alias("label"), F.lit(n).alias("pass"), (F.when(b["i"] != a["i"], place) if n else place).alias("place"), b["i"].alias("i"), b[k].alias("value"), b["conf"].alias("conf"), b["text"].alias("text"))

        # a label's first number decides its distance, plausible or not
        there = F.filter("ns", lambda b: b["distance"] if field == "distance_km" else b[k].isNotNull())
        return F.array_min(F.filter(F.transform(there, reading), lambda r: r["place"].isNotNull()))

    passes = PASSES.get(field, (field,))
    picks = F.transform(labels, lambda a: F.coalesce(*[found(a, n, k) for n, k in enumerate(passes)]))
    return F.array_min(F.filter(picks, lambda r: r["value"].isNotNull()))


def _picks(images: DataFrame) -> DataFrame:
    """image_id, bs and for each field a struct of label, value, conf and text. The maximum is picked before the mean, which skips its label."""
    named = lambda spec: F.filter("bs", lambda b: reduce(or_, [b["text"].contains(x) for x in spec.labels]))
    df = _once(_numbers(boxes(images).select("image_id", "bs")), **{f"_{k}": named(spec) for k, spec in FIELDS.items()})
    df = _once(df, **{k: _best(k, F.col(f"_{k}")) for k in FIELDS if k != "avg_hr"})
    df = _once(df, avg_hr=_best("avg_hr", F.filter("_avg_hr", lambda a: ~a["i"].eqNullSafe(F.col("max_hr.label")))))
    return df.select("image_id", "bs", *FIELDS)


def fields(images: DataFrame) -> DataFrame:
    """image_id, field, value, conf, raw: the numeric fields."""
    found = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("pick")) for k in FIELDS])
    rows = _picks(images).select("image_id", F.inline(F.filter(found, lambda x: x["pick"].isNotNull())))
    return rows.select("image_id", "field", "pick.value", "pick.conf", F.col("pick.text").alias("raw"))


def _dated(df: DataFrame, year: int) -> DataFrame:
    """df with bs, and date and start_time: the last valid date, and the last time that stands behind or beside a date. A day over 31 has a
    digit of the hour glued to it."""
    full, part = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", r"(\d{1,2})月(\d{1,2})日?"

    def day(b):
        t, is_full = b["text"], b["text"].rlike(full)
        g = lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
        day0 = F.when(is_full, g(full, 3)).otherwise(g(part, 2))
        glued = is_full & (day0 > 31)
        tail0 = F.when(is_full, F.regexp_extract(t, full + "(.*)$", 4)).otherwise(F.regexp_extract(t, part + "(.*)$", 3))
        beside = lambda n: F.coalesce(F.get("bs", b["i"] + n)["text"], F.lit(""))
        return F.struct(
            F.when(is_full, g(full, 1)).otherwise(year).alias("y"),
            F.when(is_full, g(full, 2)).otherwise(g(part, 1)).alias("m"),
            F.when(glued, F.floor(day0 / 10).cast("int")).otherwise(day0).alias("d"),
            F.concat_ws(" ", F.concat(F.when(glued, (day0 % 10).cast("string")).otherwise(""), tail0), beside(1), beside(-1)).alias("tail"),
        )

    days = F.transform(F.filter("bs", lambda b: b["text"].rlike(full) | b["text"].rlike(part)), day)
    df = _once(df, _days=F.filter(days, lambda x: x["m"].between(1, 12) & x["d"].between(1, 31)))
    clock = r"(\d{1,2})[:：.](\d{2})"

    def time(x):
        hh, mm = (F.regexp_extract(x["tail"], clock, k).try_cast("int") for k in (1, 2))
        return F.when(hh.between(0, 23) & mm.between(0, 59), F.format_string("%02d:%02d:00", hh, mm))

    last = lambda c: F.get(c, F.size(c) - 1)
    df = _once(df, _day=last(F.col("_days")), _times=F.array_compact(F.transform("_days", time)))
    df = df.withColumn("date", F.when(F.col("_day").isNotNull(), F.format_string("%04d-%02d-%02d", "_day.y", "_day.m", "_day.d")))
    return df.withColumn("start_time", F.concat("date", F.lit(" "), last(F.col("_times"))).try_cast("timestamp_ntz")).drop("_days", "_day", "_times")


def start_times(images: DataFrame, year: int) -> DataFrame:
    """image_id, date, start_time of the images that have a date."""
    return _dated(boxes(images).select("image_id", "bs"), year).where(F.col("date").isNotNull()).select("image_id", "date", "start_time")


def recognise(images: DataFrame, year: int) -> DataFrame:
    """One row an image: sport_type, the numeric fields, date, start_time and notes on what is missing."""
    sports = F.filter("bs", lambda b: b["text"].rlike("|".join(SPORT_LABELS)))
    df = _once(_dated(_picks(images), year), _sport=F.get(sports, F.lit(0))["text"])
    sport = F.when(F.col("_sport").isNotNull(), timeparse.sport(F.col("_sport")))
    out = df.select("image_id", sport.alias("sport_type"), *[F.col(k)["value"].alias(k) for k in FIELDS], "date", "start_time")
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("sport_type", "start_time", "duration_min", "distance_km")]
    return out.withColumn("notes", F.array_compact(F.array(*missing, F.when(F.col("avg_hr").isNull() & F.col("max_hr").isNull(), F.lit("heart_rate")))))


def block_stats(images: DataFrame) -> DataFrame:
    """image_id, mean_conf, n_chars (letters and digits) of the blocks."""
    b = images.select("image_id", F.explode("blocks").alias("b")).select("image_id", F.coalesce("b.text", F.lit("")).alias("text"), "b.conf")
    return b.groupBy("image_id").agg(pyround(F.avg("conf"), 4).alias("mean_conf"), F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("n_chars"))
