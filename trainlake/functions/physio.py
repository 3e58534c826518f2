"""Training load, metabolic equivalents and energy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, nz, pyround

MAX_HR, RESTING_HR = 190, 60
#: Sport -> (least MET, MET for each km/h); other sports count as running.
MET = {"cycling": (4.0, 0.35), "walking": (3.0, 0.5), "swimming": (6.0, 2.0), "running": (6.0, 0.95)}
#: Zone -> share of the maximal heart rate, lower bound included, upper not.
ZONES = {"z1": (0.50, 0.60), "z2": (0.60, 0.70), "z3": (0.70, 0.80), "z4": (0.80, 0.90), "z5": (0.90, 1.01)}
#: Activity factor for 0, 1, 2 ... 6 and more training days a week.
ACTIVITY_FACTORS = [1.20, 1.30, 1.38, 1.46, 1.55, 1.64, 1.72]
#: Fixed values of the nutrition targets: deficit in kcal, least share of the basal rate, grams of protein and fat a kg, least share of energy from fat.
DEFICIT, BASAL_SHARE, PROTEIN, FAT, FAT_SHARE = 400.0, 1.10, 1.8, 0.9, 0.20


def _or_lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def trimp(minutes: Column, avg_hr: Column, max_hr=MAX_HR, resting_hr=RESTING_HR, gender=None) -> Column:
    """Banister's training impulse; 0 without a heart rate, a duration or a reserve."""
    top, rest = _or_lit(max_hr), _or_lit(resting_hr)
    reserve = clamp(F.try_divide((avg_hr - rest).cast("double"), (top - rest).cast("double")), 0.0, 1.0)
    female = F.lit(False) if gender is None else F.coalesce(_or_lit(gender) == "female", F.lit(False))
    weight = F.when(female, 0.86 * F.exp(1.67 * reserve)).otherwise(0.64 * F.exp(1.92 * reserve))
    usable = nz(avg_hr).isNotNull() & (top > rest) & (minutes > 0)
    return F.when(usable, minutes * reserve * weight).otherwise(0.0)


def met_for(sport: Column, mean_speed: Column) -> Column:
    kmh = F.coalesce(mean_speed, F.lit(0.0)) * 3.6
    of = lambda s: F.greatest(F.lit(MET[s][0]), kmh * MET[s][1])
    out = F.when(sport == "cycling", of("cycling"))
    for s in ("walking", "swimming"):
        out = out.when(sport == s, of(s))
    return out.otherwise(of("running"))


def reserve_from_met(met: Column, max_hr=MAX_HR, resting_hr=RESTING_HR) -> Column:
    """Share of the heart-rate reserve that a MET asks for; the largest MET follows from VO2max = 15 * max / resting."""
    top, rest = nz(_or_lit(max_hr)), nz(_or_lit(resting_hr))
    most = F.try_divide(15.0 * top, rest) / 3.5
    return F.when((top > rest) & (most > 1.0), clamp((nz(met) - 1.0) / (most - 1.0), 0.0, 1.0))


def calories(sport: Column, mean_speed: Column, duration_s: Column, weight_kg: Column) -> Column:
    return pyround(met_for(sport, mean_speed) * nz(weight_kg) * (nz(duration_s) / 3600.0), 1)


def load(sport: Column, moving_s: Column, mean_speed: Column, avg_hr: Column, max_hr=MAX_HR, resting_hr=RESTING_HR, gender=None) -> Column:
    """struct(load, source): by heart rate ("trimp") where there is one, else by the MET of the pace ("met_estimate"), else
    null ("none"). Both are of the same scale."""
    top, rest = _or_lit(max_hr), _or_lit(resting_hr)
    minutes = moving_s / 60.0
    reserve = reserve_from_met(met_for(sport, mean_speed), max_hr, resting_hr)
    by_hr = nz(avg_hr).isNotNull()
    by_met = reserve.isNotNull() & nz(moving_s).isNotNull()
    value = F.when(by_hr, trimp(minutes, avg_hr, max_hr, resting_hr, gender)).when(by_met, trimp(minutes, rest + reserve * (top - rest), max_hr, resting_hr, gender))
    source = F.when(by_hr, "trimp").when(by_met, "met_estimate").otherwise("none")
    return F.struct(pyround(value, 2).alias("load"), source.alias("source"))


def zone(hr: Column, max_hr=MAX_HR) -> Column:
    """Name of the zone of a heart rate; null outside all zones."""
    share = F.try_divide(hr.cast("double"), nz(_or_lit(max_hr)).cast("double"))
    out = F.lit(None).cast("string")
    for name, (low, high) in ZONES.items():
        out = F.when((share >= low) & (share < high), name).otherwise(out)
    return out


def basal_rate(weight_kg: Column, height_cm: Column, age: Column, gender: Column) -> Column:
    """Mifflin-St Jeor, kcal a day; a missing gender counts as male."""
    male = F.lower(F.coalesce(nz_text(gender), F.lit("male"))).startswith("m")
    return 10.0 * weight_kg + 6.25 * height_cm - 5.0 * age + F.when(male, 5.0).otherwise(-161.0)


def nz_text(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def activity_factor(days: Column) -> Column:
    table = F.array(*[F.lit(x) for x in ACTIVITY_FACTORS])
    return F.coalesce(F.get(table, F.least(F.coalesce(days, F.lit(0)), F.lit(6)).cast("int")), F.lit(1.46))


def nutrition_targets(weight_kg: Column, height_cm: Column, age: Column, gender: Column, goal: Column, days: Column) -> Column:
    """struct(available, bmr, tdee, target_kcal, deficit_kcal, protein_g, fat_g, carb_g); all null but available (false) without
    weight, height or age."""
    w, h, a = nz(weight_kg), nz(height_cm), nz(age)
    bmr = basal_rate(w, h, a, gender)
    tdee = bmr * activity_factor(days)
    losing = F.lower(F.coalesce(goal, F.lit("health"))).isin("fat_loss", "weight_loss")
    target = F.when(losing, F.greatest(tdee - DEFICIT, bmr * BASAL_SHARE)).otherwise(tdee)
    protein = pyround(w * PROTEIN, 0)
    fat = F.greatest(pyround(w * FAT, 0), pyround(target * FAT_SHARE / 9, 0))
    carb = F.greatest(pyround((target - protein * 4 - fat * 9) / 4, 0), F.lit(0.0))
    known = w.isNotNull() & h.isNotNull() & a.isNotNull()
    out = {"bmr": pyround(bmr, 0), "tdee": pyround(tdee, 0), "target_kcal": pyround(target, 0), "deficit_kcal": F.when(losing, pyround(tdee - target, 0)).otherwise(0.0), "protein_g": protein, "fat_g": fat, "carb_g": carb}
    return F.struct(known.alias("available"), *[F.when(known, c).cast("long").alias(k) for k, c in out.items()])
