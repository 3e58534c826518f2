"""Safety rules on weekly training plans, as columns: every rule is evaluated on the plan's array of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio

#: Rule -> severity, in the order findings are reported.
SEVERITY = {
    "days": "warning",
    "no_rest": "error",
    "volume": "error",
    "intensity": "error",
    "acwr": "warning",
    "acwr_volume": "error",
    "estimated": "note",
    "tsb": "error",
    "longest": "error",
    "weight": "error",
    "pain": "warning",
}
LIMIT = 1.10


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, d: a + F.coalesce(value(d), F.lit(0.0)))


def check(plans: DataFrame) -> DataFrame:
    """Adds findings (codes in order), errors, warnings (arrays) and passed.

    plans: days array<struct<kind, km, minutes>>, last4_km array<double>, acwr, tsb, longest_min, weight_trend, goal, pain (boolean),
    estimated_ratio. Missing numbers count as 0. No shuffle."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    has = lambda *kinds: F.exists("days", lambda d: d["kind"].isin(*kinds))
    km, minutes = _sum(F.col("days"), lambda d: d["km"]), _sum(F.col("days"), lambda d: d["minutes"])
    hard = _sum(F.filter("days", lambda d: d["kind"].isin("interval", "tempo")), lambda d: d["minutes"])
    base = F.coalesce(ratio(_sum(F.col("last4_km"), lambda x: x), F.size("last4_km")), F.lit(0.0))
    strained = zero("acwr") > 1.3
    fails = {
        "days": F.size("days") != 7,
        "no_rest": ~has("rest"),
        "volume": (base > 1) & (km > base * LIMIT),
        "intensity": (minutes > 0) & (ratio(hard, minutes) > 0.2),
        "acwr": strained,
        "acwr_volume": strained & (km > base),
        "estimated": (zero("estimated_ratio") >= 0.3) & (strained | (zero("tsb") < -20)),
        "tsb": (zero("tsb") < -20) & has("interval", "tempo", "long"),
        "longest": (zero("longest_min") > 0) & F.exists("days", lambda d: d["minutes"] > F.col("longest_min") * LIMIT),
        "weight": (F.col("goal") == "fat_loss") & (zero("weight_trend") < -1.0),
        "pain": F.coalesce(F.col("pain"), F.lit(False)) & has("interval", "tempo", "long"),
    }
    pick = lambda *levels: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in fails.items() if SEVERITY[k] in levels]))
    out = plans.withColumns({"findings": pick("error", "warning", "note"), "errors": pick("error"), "warnings": pick("warning")})
    return out.withColumn("passed", F.size("errors") == 0)
