"""Activity roll-ups: daily and weekly sums, load curves, trends, ratios, lists. All take an explicit as_of; none reads a clock.

`by` names grouping columns (an athlete, a club); empty for one athlete's table. Loads and rounded values are summed as decimals, so
results don't depend on the order of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import cents, nz, pyround, ratio
from . import ledger

TAU_CTL, TAU_ATL = 42, 7


def day(x: str = "start_time") -> Column:
    return F.to_date(F.col(x))


def date_lit(d: str) -> Column:
    return F.lit(d).cast("date")


def between_days(as_of: str, start: int, end: int, at: str = "start_time") -> Column:
    """as_of - start days <= at < as_of - end days, both at midnight."""
    return (F.col(at) >= F.date_sub(date_lit(as_of), start).cast("timestamp_ntz")) & (F.col(at) < F.date_sub(date_lit(as_of), end).cast("timestamp_ntz"))


def daily_load(acts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """date, load: summed load of every day with an activity; missing loads count as 0."""
    return acts.where("start_time is not null").groupBy(*by, day().alias("date")).agg(F.sum(cents(F.coalesce("load", F.lit(0.0)))).cast("double").alias("load"))


def ema_point(daily: DataFrame, as_of: str, by: Sequence[str] = (), history: int = 90) -> DataFrame:
    """ctl, atl, tsb and acwr at as_of, in closed form: a day's load weighs (1 - e^(-1/tau)) e^(-age/tau). One aggregation, no
    order, no spine. Without by there is always one row."""
    age = F.datediff(date_lit(as_of), "date")
    weigh = lambda tau: F.coalesce(F.sum(F.col("load") * (1 - math.exp(-1 / tau)) * F.exp(-age / tau)), F.lit(0.0))
    seen = daily.where(age.between(0, history)).groupBy(*by).agg(pyround(weigh(TAU_CTL)).alias("ctl"), pyround(weigh(TAU_ATL)).alias("atl"))
    return seen.withColumns({"tsb": pyround(F.col("ctl") - F.col("atl")), "acwr": F.when(F.col("ctl") > 0, pyround(ratio("atl", "ctl"))).otherwise(0.0)})


def calendar(spark, as_of: str, days: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(date_lit(as_of), days), date_lit(as_of))).alias("date"))


def load_curve(daily: DataFrame, as_of: str, days: int = 90, by: Sequence[str] = ()) -> DataFrame:
    """date, load, ctl, atl, tsb for each day of the last `days`; the averages start at 0 on the first day.

    The recurrence unrolls to e^(-n/tau) * sum of load * e^(n/tau); n stays below `days`, so exponents stay small. With by, a
    window a group; the calendar is joined to the distinct groups, not to the rows."""
    spine = calendar(daily.sparkSession, as_of, days)
    if by:
        spine = daily.where(F.col("date").between(F.date_sub(date_lit(as_of), days), date_lit(as_of))).select(*by).distinct().crossJoin(F.broadcast(spine))
    rows = spine.join(daily, [*by, "date"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    n = F.datediff("date", F.date_sub(date_lit(as_of), days))
    w = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    avg = lambda tau: F.exp(-n / tau) * F.sum(F.col("load") * (1 - math.exp(-1 / tau)) * F.exp(n / tau)).over(w)
    raw = rows.withColumns({"_c": avg(TAU_CTL), "_a": avg(TAU_ATL)})
    return raw.select(*by, "date", pyround("load").alias("load"), pyround("_c").alias("ctl"), pyround("_a").alias("atl"), pyround(F.col("_c") - F.col("_a")).alias("tsb"))


def rolling(acts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Activities of the last `days`, later ones too."""
    return acts.where(F.col("start_time") >= F.date_sub(date_lit(as_of), days).cast("timestamp_ntz"))


def month_grid(months: DataFrame) -> DataFrame:
    """year, month, date, week (row of the month's grid, from 0) and dow (1: Monday) of each day of the months (year, month; each once)."""
    first = F.make_date("year", "month", F.lit(1))
    days = months.select("year", "month", F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    first = F.make_date("year", "month", F.lit(1))
    return days.select("year", "month", "date", F.floor((F.dayofmonth("date") - 1 + F.weekday(first)) / 7).cast("int").alias("week"), (F.weekday("date") + 1).alias("dow"))


def weekly(acts: DataFrame, as_of: str, weeks: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """weeks_ago (weeks-1 .. 0), distance_km, load, duration_h of the seven-day weeks that end at as_of, today included; empty
    weeks are zero rows (without by)."""
    ago = F.floor(F.datediff(date_lit(as_of), day()) / 7).cast("int")
    rows = acts.where("start_time is not null").withColumn("weeks_ago", ago).where(F.col("weeks_ago").between(0, weeks - 1) & (day() <= date_lit(as_of)))
    sums = rows.groupBy(*by, "weeks_ago").agg(F.sum("distance_m").alias("d"), F.sum(cents("load")).alias("l"), F.sum("duration_s").alias("s"))
    if not by:
        sums = acts.sparkSession.range(weeks).select(F.col("id").cast("int").alias("weeks_ago")).join(sums, "weeks_ago", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sums.select(*by, "weeks_ago", pyround(zero(F.col("d")) / 1000.0).alias("distance_km"), pyround(zero(F.col("l")), 1).alias("load"), pyround(zero(F.col("s")) / 3600.0).alias("duration_h"))


def moving_time() -> Column:
    return F.coalesce(nz("moving_time_s"), F.col("duration_s"))


def mean_pace(distance: Column, seconds: Column) -> Column:
    """Seconds a km of summed metres and seconds; null for 100 m or less."""
    return F.when(distance > 100, ratio(seconds, distance / 1000.0))


def pace_trend(acts: DataFrame, as_of: str, days: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """pace_now, pace_before (aggregate pace of the last `days` and the `days` before) and pace_trend_pct (0 if either is missing)."""
    part = lambda a, b, c: F.sum(F.when(between_days(as_of, a, b), c))
    pace = lambda a, b: mean_pace(part(a, b, F.col("distance_m")), part(a, b, moving_time()))
    out = acts.where(between_days(as_of, 2 * days, 0)).groupBy(*by).agg(pace(days, 0).alias("_now"), pace(2 * days, days).alias("_before"))
    trend = (ratio("_now", "_before") - 1) * 100
    return out.select(*by, pyround("_now", 1).alias("pace_now"), pyround("_before", 1).alias("pace_before"), pyround(F.coalesce(trend, F.lit(0.0))).alias("pace_trend_pct"))


def summary(acts: DataFrame, since: Column, sport: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Totals of activities at or after `since`: sums, aggregate pace, duration-weighted heart rate, plain means of cadence and
    stride; without by one row, of zeros and nulls if there is none."""
    rows = acts.where(F.col("start_time") >= since)
    if sport is not None:
        rows = rows.where(F.col("sport_type") == sport)
    seconds = F.when(nz("avg_hr").isNotNull(), F.col("duration_s"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        pyround(zero("distance_m") / 1000.0).alias("distance_km"),
        pyround(zero("duration_s") / 3600.0).alias("duration_h"),
        pyround(zero(cents("load")), 1).alias("load"),
        pyround(mean_pace(F.sum("distance_m"), F.sum(moving_time())), 1).alias("avg_pace_s_per_km"),
        pyround(ratio(F.sum(F.col("avg_hr") * seconds), nz(F.sum(seconds))), 1).alias("avg_hr"),
        pyround(F.avg(nz("avg_cadence_spm")), 1).alias("avg_cadence_spm"),
        pyround(F.avg(cents(nz("avg_stride_m"), 3)), 3).alias("avg_stride_m"),
    )


def trend(acts: DataFrame, since: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row a day: sums and plain means."""
    rows = acts.where(F.col("start_time") >= since)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(*by, day().alias("date")).agg(
        F.count(F.lit(1)).alias("n"),
        pyround(zero("distance_m") / 1000.0).alias("distance_km"),
        pyround(zero(cents("load")), 1).alias("load"),
        pyround(F.avg(nz("avg_hr")), 1).alias("avg_hr"),
        pyround(F.avg(cents(nz("avg_pace_s_per_km"), 1)), 1).alias("avg_pace_s_per_km"),
        pyround(F.avg(nz("avg_cadence_spm")), 1).alias("avg_cadence_spm"),
    )


def quality_ratios(acts: DataFrame, as_of: str, days: int = 28, by: Sequence[str] = ()) -> DataFrame:
    """Share of activities without heart rate, and of load that is estimated; null without activities or load."""
    rows = acts.where(between_days(as_of, days, 0))
    load = cents(F.coalesce("load", F.lit(0.0)))
    n, missing = F.count(F.lit(1)), F.count_if(nz("avg_hr").isNull())
    return rows.groupBy(*by).agg(
        n.alias("n"),
        pyround(ratio(missing, nz(n))).alias("hr_missing_ratio"),
        pyround(ratio(F.sum(F.when(nz("avg_hr").isNull(), load)), nz(F.sum(load)))).alias("estimated_load_ratio"),
    )


def slope_per_week(days: DataFrame, value: str, as_of: str, window: int = 30, digits: int = 3) -> Column:
    """Aggregate: seven times the least-squares slope of value over days; 0.0 with fewer than three values."""
    x = F.when(nz(value).isNotNull(), F.datediff("date", date_lit(as_of)))
    return pyround(F.coalesce(F.when(F.count(nz(value)) >= 3, F.regr_slope(nz(value), x.cast("double"))) * 7, F.lit(0.0)), digits)


def body_trends(daily: DataFrame, as_of: str, window: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """weight and resting heart rate a week, mean sleep."""
    rows = daily.where(F.col("date") >= F.date_sub(date_lit(as_of), window))
    return rows.groupBy(*by).agg(
        slope_per_week(rows, "weight_kg", as_of, window).alias("weight_trend_kg_per_week"),
        slope_per_week(rows, "resting_hr", as_of, window, 2).alias("resting_hr_trend"),
        pyround(F.avg(cents(nz("sleep_h"), 1))).alias("sleep_avg_h"),
    )


def feedback_summary(acts: DataFrame, feedback: DataFrame, as_of: str, days: int = 28, by: Sequence[str] = ()) -> DataFrame:
    """Mean rating of effort (zeros left out), up to five distinct pain notes in order, longest activity in minutes."""
    rows = acts.where(between_days(as_of, days, 0)).join(feedback, "activity_id", "left")
    pains = F.collect_set(F.nullif(F.trim("pain"), F.lit("")))
    return rows.groupBy(*by).agg(
        pyround(F.avg(nz("rpe")), 1).alias("avg_rpe"),
        F.slice(F.array_sort(pains), 1, 5).alias("pain_flags"),
        pyround(F.coalesce(F.max("duration_s"), F.lit(0)) / 60.0, 1).alias("longest_min"),
    )


def zone_totals(zones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """zone, seconds: maps of zone -> seconds summed over activities."""
    return zones.select(*by, F.explode("zones").alias("zone", "s")).groupBy(*by, "zone").agg(F.sum(cents("s")).cast("double").alias("seconds"))


def month_calendar(acts: DataFrame, year: int, month: int, by: Sequence[str] = ()) -> DataFrame:
    """day -> activities of that day in order of start, for one month."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    rows = acts.where((F.col("start_time") >= first.cast("timestamp_ntz")) & (F.col("start_time") < F.add_months(first, 1).cast("timestamp_ntz")))
    entry = F.struct("start_time", "activity_id", "sport_type", pyround(F.col("distance_m") / 1000.0).alias("km"))
    return rows.groupBy(*by, day().alias("date")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def source_of() -> Column:
    """trimp or met_estimate by whether there is a heart rate; null without load."""
    return F.when(nz("load").isNotNull(), F.when(nz("avg_hr").isNotNull(), "trimp").otherwise("met_estimate"))


def brief(acts: DataFrame) -> DataFrame:
    return acts.select("activity_id", "sport_type", "start_time", pyround(F.col("distance_m") / 1000.0).alias("distance_km"), pyround(F.col("duration_s") / 60.0, 1).alias("duration_min"), "avg_hr", "load", source_of().alias("load_source"))


def cards(acts: DataFrame, feedback: DataFrame) -> DataFrame:
    rows = acts.join(feedback.select("activity_id", "rpe"), "activity_id", "left")
    return rows.select(
        "activity_id",
        F.date_format("start_time", "yyyy-MM-dd").alias("date"),
        F.col("sport_type").alias("type"),
        pyround(F.coalesce("distance_m", F.lit(0)) / 1000.0).alias("distance_km"),
        pyround(F.coalesce("duration_s", F.lit(0)) / 60.0, 1).alias("duration_min"),
        "avg_hr",
        pyround(nz("avg_pace_s_per_km") / 60.0).alias("pace_min_per_km"),
        "rpe",
    )


def list_page(acts: DataFrame, sport: str | None = None, year: int | None = None, month: int | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of activities with `total`, the number of all that fit; latest first, ties by id. The month counts only if both year
    and month are given."""
    if sport is not None:
        acts = acts.where(F.col("sport_type") == sport)
    if year and month:
        first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
        acts = acts.where((F.col("start_time") >= first.cast("timestamp_ntz")) & (F.col("start_time") < F.add_months(first, 1).cast("timestamp_ntz")))
    return ledger.page(acts, [F.col("start_time").desc_nulls_last(), "activity_id"], offset, limit)


def new_activities(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose (start_time, sport_type) is not stored; a null start never matches."""
    return incoming.join(stored.select("start_time", "sport_type"), ["start_time", "sport_type"], "left_anti")


def implausible(acts: DataFrame, most_s: int = 24 * 3600, most_m: float = 500_000.0) -> DataFrame:
    """Rejects with a reason."""
    reason = F.when(F.col("duration_s") > most_s, "duration").when(F.col("distance_m") > most_m, "distance")
    return acts.withColumn("reason", reason).where("reason is not null")


def bad_heart_rates(acts: DataFrame) -> DataFrame:
    low, high = 30, 250
    bad = ~F.col("avg_hr").between(low, high) | ~F.col("max_hr").between(low, high) | (F.col("max_hr") < F.col("avg_hr"))
    return acts.where(bad)
