"""Ledgers and small tables: upserts that keep known values, mileage, visited places, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import cents, nz, pyround
from ..functions import physio


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with new's non-null values over it; new keys are added. One row a key on either side."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values if c in new.columns])
    out = old.join(n, list(keys), "full")
    return out.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in values])


def daily_mileage(entries: DataFrame) -> DataFrame:
    """shoe_id, run_date, km: entries of one shoe and day are one row."""
    return entries.groupBy("shoe_id", "run_date").agg(pyround(F.sum(cents("km"))).alias("km"))


def shoe_totals(shoes: DataFrame, entries: DataFrame) -> DataFrame:
    """total_km (initial and run) and n of each shoe; for their order see shoe_list()."""
    sums = entries.groupBy("shoe_id").agg(F.sum(cents("km")).alias("_km"), F.count(F.lit(1)).alias("n"))
    out = shoes.join(sums, "shoe_id", "left")
    return out.withColumns({"total_km": pyround(cents("initial_km") + F.coalesce("_km", F.lit(0))), "n": F.coalesce("n", F.lit(0))}).drop("_km")


def shoe_list(shoes: DataFrame) -> DataFrame:
    """Shoes in use before retired ones, the newest first, ties by id."""
    return shoes.orderBy(F.coalesce("retired", F.lit(0)), F.col("created_at").desc_nulls_last(), "shoe_id")


def window_of(order: str):
    """From the first row to this one in the given order; for small tables such as a person's shoes."""
    return W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def new_shoes(entries: DataFrame) -> DataFrame:
    """Rows for the table of shoes: name and brand trimmed, the date of purchase where it is one, missing kilometres 0, in use."""
    bought = F.when(F.trim("purchased_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim("purchased_date").try_cast("date"))
    return entries.select("shoe_id", F.trim("name").alias("name"), F.trim("brand").alias("brand"), bought.alias("purchased_date"), F.coalesce("initial_km", F.lit(0.0)).alias("initial_km"), F.lit(0).alias("retired"), "created_at")


def patch_shoes(shoes: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shoes, rejects) after patches (shoe_id and any of name, brand, initial_km, retired; null: unchanged), one a shoe. Rejected
    are patches of unknown shoes and blank names."""
    known = patches.join(shoes.select("shoe_id", F.lit(True).alias("_known")), "shoe_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown").when(F.trim("name") == "", "blank_name")
    known = known.withColumn("reason", reason).drop("_known")
    clean = {"name": F.trim("name"), "brand": F.trim("brand"), "retired": F.when(F.col("retired").isNotNull(), (F.col("retired") != 0).cast("int"))}
    good = known.where("reason is null").drop("reason").withColumns({c: x for c, x in clean.items() if c in patches.columns})
    return upsert(shoes, good, ["shoe_id"]), known.where("reason is not null").select("shoe_id", "reason")


def latest(rows: DataFrame, at: str, limit: int, key: str = "id") -> DataFrame:
    """The last `limit` rows by a time (plans, runs), ties by the larger key."""
    return rows.orderBy(F.col(at).desc_nulls_last(), F.desc(key)).limit(limit)


def since(daily: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Daily rows of the last `days` in order of date."""
    return daily.where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)).orderBy("date")


def page(rows: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of rows in the given order, each with `total`, the number of all rows; the order should decide between all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def accumulate(stored: DataFrame, entries: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """stored with the entries' sums added to it by key, rounded to two places; new keys are added."""
    sums = entries.groupBy(*keys).agg(F.sum(cents(value)).alias("_more"))
    out = stored.join(sums, list(keys), "full")
    added = F.when(F.col("_more").isNull(), F.col(value)).otherwise(pyround(cents(F.coalesce(value, F.lit(0.0))) + F.col("_more")))
    return out.select(*[added.alias(value) if c == value else F.col(c) for c in stored.columns])


def cities_of(places: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visited, suggested): of an activity's places (activity_id, city) those that its visits hold, and those they lack."""
    own = visits.select("activity_id", "city").distinct()
    return places.join(own, ["activity_id", "city"], "left_semi").distinct(), places.join(own, ["activity_id", "city"], "left_anti").distinct()


def with_defaults(profile: DataFrame, defaults: dict) -> DataFrame:
    """The profile's one row with defaults for missing fields; a row of defaults where there is none. For many users' profiles see
    profiles_with_defaults()."""
    base = profile.sparkSession.range(1).select(F.lit(1).alias("_one"))
    own = profile.orderBy("id").limit(1).withColumn("_one", F.lit(1))
    out = base.join(F.broadcast(own), "_one", "left").drop("_one")
    return out.select(*[F.coalesce(c, F.lit(defaults[c]).cast(t)).alias(c) if c in defaults else F.col(c) for c, t in profile.dtypes])


def profiles_with_defaults(users: DataFrame, profiles: DataFrame, key: str, defaults: dict) -> DataFrame:
    """One row a user (users: key): the profile of least id with defaults for its missing fields, or a row of defaults."""
    values = [(c, t) for c, t in profiles.dtypes if c not in (key, "id")]
    own = profiles.groupBy(key).agg(F.min_by(F.struct(*[c for c, _ in values]), "id").alias("_p"))
    out = users.select(key).distinct().join(own, key, "left")
    return out.select(key, *[F.coalesce(f"_p.{c}", F.lit(defaults[c]).cast(t)).alias(c) if c in defaults else F.col(f"_p.{c}").alias(c) for c, t in values])


def age(birth_year: Column, as_of: str, default: int = 30) -> Column:
    """Years since the year of birth; a default without one."""
    return F.coalesce(F.year(F.lit(as_of).cast("date")) - nz(birth_year), F.lit(default)).cast("int")


def visited(visits: DataFrame) -> DataFrame:
    """city, visit_count, first_date: counts add up, the earliest date stays."""
    return visits.groupBy("city").agg(F.count(F.lit(1)).alias("visit_count"), F.min("date").alias("first_date"))


def match_city(names: DataFrame, library: DataFrame) -> DataFrame:
    """name, city: the library city equal to the name, else (without a final 市) the first that begins the name or that the name
    begins. library: ord, city. Names and cities meet at equal prefixes, so no pair that doesn't match is made and neither side
    is broadcast."""
    bare = lambda c: F.regexp_replace(F.trim(c), "市$", "")
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    n = names.select("name", bare(F.col("name")).alias("_n")).distinct()
    lib = library.select("ord", "city", bare(F.col("city")).alias("_b"))
    some, any_of = n.where("_n <> ''"), lib.where("_b <> ''")
    begun = some.withColumn("k", F.explode(heads(F.col("_n")))).join(any_of.withColumn("k", F.col("_b")), "k")
    begins = some.withColumn("k", F.col("_n")).join(any_of.withColumn("k", F.explode(heads(F.col("_b")))), "k")
    rank = F.struct(F.when(F.col("name") == F.col("city"), 0).when(F.col("_n") == F.col("_b"), 1).otherwise(2).alias("r"), "ord", "city")
    found = begun.unionByName(begins).groupBy("name").agg(F.min(rank).alias("m"))
    return n.select("name").join(found, "name", "left").select("name", F.col("m.city").alias("city"))


def search_cities(library: DataFrame, text: str, limit: int = 30) -> DataFrame:
    return library.where(F.col("city").contains(text) | F.col("province").contains(text)).orderBy("ord").limit(limit)


def seed(stored: DataFrame, defined: DataFrame, disabled: Sequence[str]) -> DataFrame:
    """Sources after a sync: defined ones are inserted or brought up to date, disabled ones switched off, users' own rows left alone.

    stored and defined: domain, name, authority, enabled; users' rows are those with domains that defined lacks."""
    d = defined.select("domain", F.col("name").alias("_name"), F.col("authority").alias("_auth"))
    out = stored.join(d, "domain", "full")
    on = F.when(F.col("domain").isin(*disabled), False).otherwise(F.coalesce("enabled", F.lit(True)))
    return out.select("domain", F.coalesce("_name", "name").alias("name"), F.coalesce("_auth", "authority").alias("authority"), on.alias("enabled"))


def set_heart_rates(acts: DataFrame, updates: DataFrame, max_hr: int = physio.MAX_HR, resting_hr: int = physio.RESTING_HR) -> DataFrame:
    """Activities with corrected heart rates and loads. updates: activity_id, avg_hr, max_hr, one row an activity; invalid ones (outside
    30..250, or the maximum under the mean) are ignored, a null avg_hr clears the rate and the load is estimated again."""
    ok = F.col("avg_hr").isNull() | (F.col("avg_hr").between(30, 250) & F.coalesce(F.col("max_hr").between(30, 250) & (F.col("max_hr") >= F.col("avg_hr")), F.lit(True)))
    u = updates.where(ok).select("activity_id", F.col("avg_hr").alias("_hr"), F.lit(True).alias("_set"))
    out = acts.join(u, "activity_id", "left").withColumn("avg_hr", F.when(F.col("_set"), F.col("_hr")).otherwise(F.col("avg_hr")))
    moving = F.coalesce(nz("moving_time_s"), "duration_s")
    load: Column = physio.load(F.col("sport_type"), moving, F.col("avg_speed_mps"), F.col("avg_hr"), max_hr, resting_hr)
    return out.withColumn("_l", load).withColumns({"load": F.when(F.col("_set"), F.col("_l.load")).otherwise(F.col("load")), "load_source": F.when(F.col("_set"), F.col("_l.source")).otherwise(F.col("load_source"))}).drop("_hr", "_set", "_l")


def manual_entries(entries: DataFrame, weight_kg: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(activities, rejects) of entries typed in: sport_type, start_time, duration_min, distance_km, avg_hr. Rejected with a reason are
    durations of 0 or over 24 hours and distances over 500 km."""
    rows = entries.withColumns({"duration_s": F.col("duration_min") * 60.0, "distance_m": F.coalesce("distance_km", F.lit(0.0)) * 1000.0})
    reason = F.when(F.coalesce("duration_s", F.lit(0.0)) <= 0, "no_duration").when(F.col("duration_s") > 24 * 3600, "duration").when(F.col("distance_m") > 500_000, "distance")
    rows = rows.withColumn("reason", reason)
    speed = F.when(F.col("distance_m") > 0, F.col("distance_m") / F.col("duration_s"))
    good = rows.where("reason is null").withColumn("avg_speed_mps", pyround(speed, 3)).withColumn("_l", physio.load(F.col("sport_type"), F.col("duration_s"), speed, F.col("avg_hr")))
    good = good.withColumns({"load": F.col("_l.load"), "load_source": F.col("_l.source"), "calories": physio.calories(F.col("sport_type"), speed, F.col("duration_s"), F.lit(weight_kg).cast("double"))})
    return good.drop("_l", "reason"), rows.where("reason is not null").select("start_time", "sport_type", "reason")
