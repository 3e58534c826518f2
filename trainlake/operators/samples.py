"""Sample series: cleaning, enrichment, down-sampling and per-activity summaries. One shuffle on the activity serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, physio
from ..functions.numbers import nz, pyround, ratio

ID = "activity_id"
#: Samples that an activity needs for its drift of heart rate.
DRIFT_SAMPLES = 20


def _w() -> W:
    return W.partitionBy(ID).orderBy("t")


def last_of_each_time(samples: DataFrame) -> DataFrame:
    """Rows with a time; of rows with equal times the last in file order (seq)."""
    w = W.partitionBy(ID, "t").orderBy(F.desc("seq"))
    return samples.where("t is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def moving_threshold(sport: Column) -> Column:
    return F.when(sport == "cycling", 0.8).otherwise(0.5)


def enrich(samples: DataFrame, min_climb: float = 0.5) -> DataFrame:
    """Adds dt, seg (metres since the sample before), climb, moving (seconds), stride, and fills speed from seg.

    Speed decides the distance where there is one, else the places of this sample and the one before; segments that are not
    positive count for nothing. A climb counts if it exceeds min_climb over the last known altitude."""
    w = _w()
    before = w.rowsBetween(W.unboundedPreceding, -1)
    dt = F.col("t") - F.lag("t").over(w)
    place = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    seg = F.when(F.col("dt") > 0, F.coalesce(F.col("speed") * F.col("dt"), F.col("_place")))
    out = last_of_each_time(samples).withColumns({"dt": dt, "_place": place, "_alt": F.last("alt", ignorenulls=True).over(before)})
    out = out.withColumn("seg", F.when(seg > 0, seg))
    out = out.withColumns(
        {
            "speed": F.coalesce("speed", F.col("seg") / F.col("dt")),
            "moving": F.when(F.col("seg") / F.col("dt") >= moving_threshold(F.col("sport_type")), F.col("dt")).otherwise(0.0),
            "climb": F.when(F.col("alt") - F.col("_alt") > min_climb, F.col("alt") - F.col("_alt")).otherwise(0.0),
        }
    )
    return out.withColumn("stride", F.when(F.col("cad") > 0, nz("speed") * 60.0 / F.col("cad"))).drop("_place", "_alt")


def zone_seconds(samples: DataFrame, max_hr: int = physio.MAX_HR, max_gap_s: float = 300.0) -> DataFrame:
    """z1..z5 (rounded seconds) of every activity; gaps over max_gap_s count as one second, the first sample as none."""
    dt = F.coalesce(F.col("t") - F.lag("t").over(_w()), F.lit(0.0))
    dt = F.when((dt < 0) | (dt > max_gap_s), 1.0).otherwise(dt)
    rows = samples.withColumns({"_dt": dt, "_z": physio.zone(nz("hr"), max_hr)})
    return rows.groupBy(ID).agg(*[pyround(F.coalesce(F.sum(F.when(F.col("_z") == z, F.col("_dt"))), F.lit(0.0)), 0).alias(z) for z in physio.ZONES])


def drift(samples: DataFrame, least: int = DRIFT_SAMPLES) -> DataFrame:
    """hr_drift: mean heart rate of the second half over that of the first, less one; null with under `least` samples."""
    n = F.count(F.lit(1)).over(W.partitionBy(ID))
    rows = samples.withColumns({"_i": F.row_number().over(_w()) - 1, "_n": n}).withColumn("_late", F.col("_i") >= F.floor(F.col("_n") / 2))
    mean = lambda late: F.avg(F.when(F.col("_late") == late, nz("hr")))
    return rows.groupBy(ID).agg(F.when(F.max("_n") >= least, ratio(mean(True), mean(False)) - 1.0).alias("hr_drift"))


def summarise(samples: DataFrame, max_hr: int = physio.MAX_HR, resting_hr: int = physio.RESTING_HR, gender: str = "male", weight_kg: float | None = None, max_gap_s: float = 300.0) -> DataFrame:
    """One row an activity: duration, moving time, distance, climb, heart rate, pace, cadence, stride, speed, zone seconds,
    drift, calories, load and load_source. Means are over samples, zeros left out. Samples are dealt by activity once; the
    windows and the one aggregation keep that partitioning."""
    rich = enrich(samples.repartition(ID))
    dt = F.coalesce("dt", F.lit(0.0))
    rich = rich.withColumns(
        {
            "_gap": F.when((dt < 0) | (dt > max_gap_s), 1.0).otherwise(dt),
            "_z": physio.zone(nz("hr"), max_hr),
            "_i": F.row_number().over(_w()) - 1,
            "_n": F.count(F.lit(1)).over(W.partitionBy(ID)),
        }
    )
    mean = lambda c: F.avg(nz(c))
    half = lambda late: F.avg(F.when((F.col("_i") >= F.floor(F.col("_n") / 2)) == late, nz("hr")))
    base = rich.groupBy(ID).agg(
        F.max("sport_type").alias("sport_type"),
        (F.max("t") - F.min("t")).alias("_dur"),
        F.coalesce(nz(F.sum("moving")), F.max("t") - F.min("t")).alias("_mov"),
        F.coalesce(F.sum("seg"), F.lit(0.0)).alias("_dist"),
        F.sum("climb").alias("_climb"),
        mean("hr").alias("_hr"),
        F.max(nz("hr")).alias("max_hr"),
        mean("cad").alias("_cad"),
        mean("stride").alias("_stride"),
        F.count(F.lit(1)).alias("n_samples"),
        *[pyround(F.coalesce(F.sum(F.when(F.col("_z") == z, F.col("_gap"))), F.lit(0.0)), 0).alias(z) for z in physio.ZONES],
        pyround(F.when(F.max("_n") >= DRIFT_SAMPLES, ratio(half(True), half(False)) - 1.0), 4).alias("hr_drift"),
    )
    speed = ratio("_dist", "_mov")
    base = base.withColumn("_load", physio.load(F.col("sport_type"), F.col("_mov"), speed, F.col("_hr"), max_hr, resting_hr, gender))
    return base.select(
        ID,
        "sport_type",
        "n_samples",
        pyround("_dur", 1).alias("duration_s"),
        pyround("_mov", 1).alias("moving_time_s"),
        pyround("_dist", 1).alias("distance_m"),
        pyround("_climb", 1).alias("elev_gain_m"),
        pyround("_hr", 1).alias("avg_hr"),
        "max_hr",
        pyround(F.when(F.col("_dist") > 0, nz("_mov") / (F.col("_dist") / 1000.0)), 1).alias("avg_pace_s_per_km"),
        pyround("_cad", 1).alias("avg_cadence_spm"),
        pyround("_stride", 3).alias("avg_stride_m"),
        pyround(nz(speed), 3).alias("avg_speed_mps"),
        physio.calories(F.col("sport_type"), speed, F.col("_dur"), F.lit(weight_kg).cast("double")).alias("calories"),
        F.col("_load.load").alias("load"),
        F.col("_load.source").alias("load_source"),
        *physio.ZONES,
        "hr_drift",
    )


def downsample(samples: DataFrame, most: int = 600) -> DataFrame:
    """At most `most` rows an activity, the rows floor(k * n / most); shorter series stay whole."""
    i, n = F.row_number().over(_w()) - 1, F.count(F.lit(1)).over(W.partitionBy(ID))
    rows = samples.withColumns({"_i": i.cast("long"), "_n": n})
    k = F.floor((F.col("_i") * most + F.col("_n") - 1) / F.col("_n"))
    kept = (F.col("_n") <= most) | ((k < most) & (F.floor(k * F.col("_n") / most) == F.col("_i")))
    return rows.where(kept).drop("_i", "_n")


def series(samples: DataFrame) -> DataFrame:
    """Adds pace (seconds a km) where speed exceeds 0.3 m/s."""
    return samples.withColumn("pace", F.when(F.col("speed") > 0.3, pyround(1000.0 / F.col("speed"), 1)))


def tracks(samples: DataFrame, least: int = 2) -> DataFrame:
    """Activities with `least` or more places."""
    return samples.where("lat is not null").groupBy(ID).agg(F.count(F.lit(1)).alias("n_points"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max")).where(F.col("n_points") >= least)


def fit_track(samples: DataFrame, width: float = 600.0, height: float = 400.0, pad: float = 10.0) -> DataFrame:
    """x, y of every place in a box of the given size, one scale for both axes, y downwards."""
    w = W.partitionBy(ID)
    span = {f"_{f.__name__}_{c}": f(c).over(w) for c in ("lat", "lon") for f in (F.min, F.max)}
    rows = samples.where("lat is not null").withColumns(span)
    scale = F.least(
        F.coalesce(ratio(F.lit(width - 2 * pad), F.col("_max_lon") - F.col("_min_lon")), F.lit(1e9)),
        F.coalesce(ratio(F.lit(height - 2 * pad), F.col("_max_lat") - F.col("_min_lat")), F.lit(1e9)),
    )
    x = pad + (F.col("lon") - F.col("_min_lon")) * scale
    y = pad + (F.col("_max_lat") - F.col("lat")) * scale
    return rows.withColumns({"x": pyround(x, 2), "y": pyround(y, 2)}).drop(*span)
