"""The coach's bundle of metrics in one row (or one a group)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physio
from ..functions.numbers import cents, nz, pyround, ratio
from ..operators import activities as ops

WEEKS, HISTORY = 8, 90


def bundle(acts: DataFrame, feedback: DataFrame, daily: DataFrame | None, as_of: str, by: Sequence[str] = ()) -> DataFrame:
    """All metrics at as_of: load averages, eight weekly sums (oldest first), pace and its trend, means and data quality of 28 days,
    feedback, zone seconds of 28 days where acts have a map `zones`, and trends of body data where daily is given (without by).

    One conditional aggregation over the activities of 90 days, joined to their feedback (one row an activity) before; without by
    always one row."""
    rows = acts.where(ops.between_days(as_of, HISTORY, -1)).join(feedback.select("activity_id", "rpe", "pain"), "activity_id", "left")
    age = F.datediff(ops.date_lit(as_of), ops.day())
    zero = lambda c: F.coalesce(c, F.lit(0))
    month = ops.between_days(as_of, 28, 0)
    of = lambda cond, c: F.when(cond, c)
    load = cents(F.coalesce("load", F.lit(0.0)))

    def average(tau: int) -> Column:
        weight = (1 - math.exp(-1 / tau)) * F.exp(-age / tau)
        return pyround(F.coalesce(F.sum(of(age.between(0, HISTORY), load.cast("double") * weight)), F.lit(0.0)))

    def weekly(value: Column, scale: float, digits: int) -> Column:
        week = lambda k: (age >= 7 * k) & (age < 7 * (k + 1))
        return F.array(*[pyround(zero(F.sum(of(week(k), value))) / scale, digits) for k in reversed(range(WEEKS))])

    def pace(start: int, end: int) -> Column:
        part = ops.between_days(as_of, start, end)
        return ops.mean_pace(F.sum(of(part, F.col("distance_m"))), F.sum(of(part, ops.moving_time())))

    n, without = F.count_if(month), nz("avg_hr").isNull()
    pains = F.collect_set(of(month, F.nullif(F.trim("pain"), F.lit(""))))
    made = {
        "ctl": average(ops.TAU_CTL),
        "atl": average(ops.TAU_ATL),
        "weekly_distance_km": weekly(F.col("distance_m"), 1000.0, 2),
        "weekly_load": weekly(cents("load"), 1, 1),
        "weekly_duration_h": weekly(F.col("duration_s"), 3600.0, 2),
        "_now": pace(14, 0),
        "_before": pace(28, 14),
        "avg_hr": pyround(F.avg(of(month, nz("avg_hr"))), 1),
        "avg_cadence_spm": pyround(F.avg(of(month, nz("avg_cadence_spm"))), 1),
        "avg_stride_m": pyround(F.avg(of(month, cents(nz("avg_stride_m"), 3))), 3),
        "activity_count_28d": n,
        "hr_missing_ratio": pyround(ratio(F.count_if(month & without), nz(n))),
        "estimated_load_ratio": pyround(ratio(F.sum(of(month & without, load)), nz(F.sum(of(month, load))))),
        "avg_rpe": pyround(F.avg(of(month, nz("rpe"))), 1),
        "pain_flags": F.slice(F.array_sort(pains), 1, 5),
        "longest_min": pyround(zero(F.max(of(month, F.col("duration_s")))) / 60.0, 1),
    }
    if "zones" in acts.columns:
        made["zone_seconds"] = F.create_map(*[x for z in physio.ZONES for x in (F.lit(z), zero(F.sum(of(month, cents(F.col("zones")[z])))).cast("double"))])
    out = rows.groupBy(*by).agg(*[c.alias(k) for k, c in made.items()])
    out = out.withColumns(
        {
            "tsb": pyround(F.col("ctl") - F.col("atl")),
            "acwr": F.when(F.col("ctl") > 0, pyround(ratio("atl", "ctl"))).otherwise(0.0),
            "pace_now": pyround("_now", 1),
            "pace_trend_pct": pyround(F.coalesce((ratio("_now", "_before") - 1) * 100, F.lit(0.0))),
        }
    ).drop("_now", "_before")
    return out.crossJoin(F.broadcast(ops.body_trends(daily, as_of))) if daily is not None and not by else out
