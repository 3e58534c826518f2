"""Import of workout files: parse, reject or deduplicate, summarise, guard; and recalculation of what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import physio
from ..functions.numbers import nz, pyround
from ..sources import workouts
from ..storage import keep
from . import samples as series

MOST_SECONDS = 24 * 3600
_NO_RECORDS = {"records_found": "int", "records_importable": "long", "records_truncated": "boolean"}


def profile_params(profile: DataFrame, daily: DataFrame) -> DataFrame:
    """One row: max_hr, resting_hr, gender and weight_kg for summaries. Missing or zero heart rates and an empty gender have
    defaults; the weight is that of the latest day, null if that day has none."""
    first = profile.agg(F.min_by(F.struct("max_hr", "resting_hr", "gender"), "id").alias("p"))
    last = daily.agg(F.max_by("weight_kg", "date").alias("weight_kg"))
    return first.crossJoin(last).select(
        F.coalesce(nz("p.max_hr"), F.lit(physio.MAX_HR)).cast("int").alias("max_hr"),
        F.coalesce(nz("p.resting_hr"), F.lit(physio.RESTING_HR)).cast("int").alias("resting_hr"),
        F.coalesce(F.nullif("p.gender", F.lit("")), F.lit("male")).alias("gender"),
        "weight_kg",
    )


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, samples) of files (path, kind, content) of all kinds; headers have path, sport_type, start_time, n_samples, error,
    warnings and the counts of records of JSON files. A file of an unknown kind has the error unknown_type."""
    heads, points = [], []

    def add(head: DataFrame, rows: DataFrame) -> None:
        fill = {c: F.lit(None).cast(t) for c, t in {"error": "string", "warnings": "array<string>", **_NO_RECORDS}.items() if c not in head.columns}
        heads.append(head.withColumns(fill).select("path", "sport_type", "start_time", F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"), "error", "warnings", *_NO_RECORDS))
        points.append(rows.select(*workouts.SAMPLE))

    for kind, read in (("gpx", workouts.read_gpx), ("tcx", workouts.read_tcx)):
        own = files.where(F.col("kind") == kind)
        rows = keep(read(own), f"parsed-{kind}")  # headers and samples are made of one parse
        facts = rows.groupBy("path").agg(F.first("sport_type").alias("sport_type"), F.first("start_time").alias("start_time"), F.count(F.lit(1)).alias("n_samples"))
        add(own.select("path").join(facts, "path", "left"), rows)
    for kind, read in (("csv", workouts.read_csv), ("json", workouts.read_json)):
        rows, head = read(files.where(F.col("kind") == kind))
        add(head, rows)
    unknown = files.where(F.coalesce(~F.col("kind").isin("gpx", "tcx", "csv", "json"), F.lit(True)))
    none = {"sport_type": "string", "start_time": "timestamp_ntz"}
    heads.append(unknown.select("path", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(0).cast("long").alias("n_samples"), F.lit("unknown_type").alias("error"), F.lit(None).cast("array<string>").alias("warnings"), *[F.lit(None).cast(t).alias(c) for c, t in _NO_RECORDS.items()]))
    out = []
    for parts in (heads, points):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        out.append(whole)
    return out[0], out[1]


def ingest(files: DataFrame, stored: DataFrame, max_hr: int = physio.MAX_HR, resting_hr: int = physio.RESTING_HR, gender: str = "male", weight_kg: float | None = None, most_s: int = MOST_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(activities, samples, results) of importing files (path, kind, content) beside stored activities (start_time, sport_type).

    results has a row a file: reason (null: imported) and notes. Reasons, the first that holds: the reader's error or no_samples;
    duplicate (start and sport are stored, or imported from a file of a smaller path; a file without a start never is);
    too_few (no sample with a time); duration (over most_s, as when milliseconds are taken for seconds). Notes are the reader's
    warnings, longest_record_only and records_truncated. samples holds raw values and, beside them, what enrichment derives."""
    heads, points = parse(keep(files, "files"))
    heads = keep(heads.withColumn("sport_type", F.coalesce("sport_type", F.lit("running"))), "ingest-heads")
    points = keep(points.join(heads.select("path", "sport_type"), "path").withColumnRenamed("path", series.ID), "ingest-samples")
    sums = series.summarise(points, max_hr, resting_hr, gender, weight_kg).drop("sport_type", "n_samples").withColumnRenamed(series.ID, "path")
    old = stored.where("start_time is not null").select("start_time", "sport_type", F.lit(True).alias("_old")).distinct()
    rows = heads.join(sums, "path", "left").join(old, ["start_time", "sport_type"], "left")
    empty, known = (F.col("n_samples") == 0) | F.col("error").isNotNull(), F.coalesce("_old", F.lit(False))
    fits = ~empty & ~known & F.col("duration_s").isNotNull() & (F.col("duration_s") <= most_s)
    same = W.partitionBy("start_time", "sport_type", F.when(F.col("start_time").isNull(), F.col("path")))
    rows = rows.withColumn("_first", F.min(F.when(fits, F.col("path"))).over(same))
    again = F.coalesce(F.col("path") > F.col("_first"), F.lit(False))
    reason = F.when(empty, F.coalesce("error", F.lit("no_samples"))).when(known | again, "duplicate").when(F.col("duration_s").isNull(), "too_few").when(F.col("duration_s") > most_s, "duration")
    notes = F.array_compact(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(F.when(F.col("records_importable") > 1, "longest_record_only"), F.when((F.col("records_importable") > 1) & F.col("records_truncated"), "records_truncated"))))
    rows = keep(rows.withColumn("reason", reason).withColumn("notes", notes), "ingest-rows")
    good = rows.where("reason is null").withColumn("activity_id", F.xxhash64("path"))
    source = F.when(F.col("path").contains("."), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))).otherwise("manual")
    acts = good.select("activity_id", source.alias("source"), F.col("path").alias("file_name"), "start_time", "sport_type", *[c for c in sums.columns if c != "path"])
    ids = good.select(F.col("path").alias(series.ID), F.col("activity_id").alias("_id"))
    mine = points.join(ids, series.ID)
    rich = series.enrich(mine).withColumnRenamed("speed", "speed_filled").select(series.ID, "t", "seq", "speed_filled", "stride", "seg")
    out = mine.join(rich, [series.ID, "t", "seq"], "left").drop(series.ID).withColumnRenamed("_id", "activity_id")
    return acts, out, rows.select("path", "reason", "n_samples", "duration_s", "notes")


def recalculate(acts: DataFrame, samples: DataFrame, max_hr: int = physio.MAX_HR, resting_hr: int = physio.RESTING_HR, gender: str = "male", weight_kg: float | None = None) -> DataFrame:
    """acts with their summaries made anew from samples, after a change of weight or heart rates. Activities without samples stay
    as they are. Where no sample has a heart rate but the activity has a mean one, it was typed in: it stays, and decides the load."""
    rows = samples.join(acts.select(series.ID, "sport_type"), series.ID) if "sport_type" not in samples.columns else samples
    new = series.summarise(rows, max_hr, resting_hr, gender, weight_kg)
    seen = rows.groupBy(series.ID).agg(F.bool_or(nz("hr").isNotNull()).alias("_seen"))
    made = [c for c in new.columns if c in acts.columns and c not in (series.ID, "sport_type")]
    new = new.select(series.ID, *[F.col(c).alias(f"_new_{c}") for c in made]).join(seen, series.ID)
    out = acts.join(new, series.ID, "left")
    typed = F.col("_seen").isNotNull() & ~F.coalesce("_seen", F.lit(False)) & nz("avg_hr").isNotNull()
    minutes = F.coalesce(nz("moving_time_s"), nz("duration_s"), F.lit(0)) / 60.0
    own = {"avg_hr": F.col("avg_hr"), "load": nz(pyround(physio.trimp(minutes, F.col("avg_hr"), max_hr, resting_hr, gender), 2)), "load_source": F.lit("trimp")}
    if "max_hr" in acts.columns:
        own["max_hr"] = F.coalesce(nz("max_hr"), "_new_max_hr")
    values = {c: F.when(F.col("_seen").isNull(), F.col(c)).when(typed, own.get(c, F.col(f"_new_{c}"))).otherwise(F.col(f"_new_{c}")) for c in made}
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in acts.columns])
