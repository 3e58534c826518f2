"""Incremental forms of the roll-ups with Structured Streaming: deduplicated import, windows, and the load recurrence as state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..deploy import ship
from ..storage import working_path
from ..store import Store


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet file or files of a table as a stream; the schema is read from the files that are there. The path is given as a
    pattern, since a stream's base path may not be a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*")


def run_to_end(stream: DataFrame, tag: str) -> DataFrame:
    """Everything that is there now, written exactly once as Parquet with a checkpoint, and read back."""
    spark, out = stream.sparkSession, working_path(stream.sparkSession, tag)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def new_activities(acts: DataFrame, delay: str = "2 days", at: str = "start_time") -> DataFrame:
    """Each (start_time, sport_type) once; repeats that come within `delay` are dropped, with bounded state. Event time must carry a
    zone, so naive times are read as UTC."""
    return acts.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([at, "sport_type"])


def windows(events: DataFrame, length: str = "7 days", offset: str = "0 days", delay: str = "1 day", at: str = "ts") -> DataFrame:
    """start, event_type, n and value of every window that the watermark has closed."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    w = F.window(at, length, startTime=offset)
    out = timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day", at: str = "ts") -> DataFrame:
    """start, user_id and n of every closed session."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    out = timed.groupBy(F.session_window(at, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "user_id", "n")


_REST = {tau: math.exp(-1 / tau) for tau in (42, 7)}
_K = {tau: 1 - x for tau, x in _REST.items()}


_ROLLING = "athlete long, day long, load double, ctl double, atl double, kind string, revision long"
#: Athletes whose ids differ in these last bits only come to Python together (64 at most); each has a state of its own.
TOGETHER = 6
#: The group of rows without an athlete; no id gives it.
NOBODY = -(1 << 62)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days whose loads are kept one by one.
KEPT_DAYS = 60


class RollingLoad(StatefulProcessor):
    """Load averages of a few athletes. State of each: the loads of recent days, and the averages at the end of the day before them; it
    is read and written once a batch."""

    def __init__(self, kept_days: int, idle_days: int | None):
        self.kept, self.ttl = kept_days, idle_days and idle_days * 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("athletes", "athlete long", "day long, ctl double, atl double, revision long, days array<long>, loads array<double>", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, dict[int, float]] = {}
        for r in rows:
            for a, d, x, dated in zip(r["athlete"].tolist(), r["day"].tolist(), r["load"].tolist(), r["dated"].tolist(), strict=True):
                mine = new.setdefault(a, {})
                if dated:
                    mine[d] = mine.get(d, 0.0) + x
        out = []
        for a in sorted(new):
            base_day, ctl, atl, revision, days, loads = self.state.getValue((a,)) or (None, 0.0, 0.0, 0, [], [])
            known, base, given = self._roll(new[a], dict(zip(days, loads, strict=True)), (base_day, ctl, atl))
            self.state.updateValue((a,), (*base, revision + 1, list(known), list(known.values())))
            name = None if key[0] == NOBODY else a
            out += [(name, *row, revision + 1) for row in given]
        yield pd.DataFrame(out, columns=["athlete", "day", "load", "ctl", "atl", "kind", "revision"])

    def _roll(self, new: dict[int, float], known: dict[int, float], base: tuple) -> tuple[dict, tuple, list]:
        """(days that are kept, averages before them, rows) of an athlete after new loads."""
        base_day, ctl, atl = base
        last, out, first = max(known, default=None), [], None
        for d in sorted(new):
            x = new[d]
            if base_day is not None and d <= base_day:
                # before all days that are kept: the averages get what is left of it by now
                ctl, atl = (v + x * _K[tau] * _REST[tau] ** (base_day - d) for v, tau in ((ctl, 42), (atl, 7)))
                out.append((d, x, None, None, "missed"))
                first = base_day + 1
            else:
                known[d] = known.get(d, 0.0) + x
                first = d if first is None else min(first, d)
        at, c, a = base_day, ctl, atl
        latest = max(known, default=None)
        for d in sorted(known):
            if at is not None:
                c, a = c * _REST[42] ** (d - at - 1), a * _REST[7] ** (d - at - 1)
            c, a, at = c * _REST[42] + known[d] * _K[42], a * _REST[7] + known[d] * _K[7], d
            if first is not None and d >= first:
                out.append((d, known[d], c, a, "new" if last is None or d > last else "again"))
            if d < latest - self.kept:
                base_day, ctl, atl = d, c, a
        return {d: x for d, x in known.items() if base_day is None or d > base_day}, (base_day, ctl, atl), out

    def close(self) -> None:
        pass


def rolling_load(daily: DataFrame, kept_days: int = KEPT_DAYS, idle_days: int | None = None) -> DataFrame:
    """athlete, day (days since 1970), load, ctl, atl after each day with a load (days between count as rest), kind and revision.
    daily: athlete, day, load. Null days are ignored, null loads are 0.

    kind is new for a day after all others. A load for a day that was there, or lies between such days, gives every day from
    its own on `again`, so the last revision of each day (see latest_days()) is the batch curve whatever the order of arrival.
    Athletes come to Python in groups of neighbouring ids, since a call for each would cost more than its work. State is bounded: days over `kept_days` before the last one are folded into the averages. A load for such a day still counts in
    all days from the kept ones on, which come again; the day itself is given as `missed` without averages, and the few days
    from it to the kept ones have to be taken from stored loads.

    With idle_days an athlete's state is dropped so long after its last change (of 730 days under 1e-7 of a load is left). That is for
    queries that keep running: Spark goes on making empty batches to look for expired state, so a run to the end doesn't end.
    The session must keep stream state in RocksDB (rocks_state())."""
    ship(daily.sparkSession)
    # nulls are marked, since ids and days with nulls would come to Python as floats
    athlete, day = F.col("athlete").cast("long"), F.col("day").cast("long")
    rows = daily.select(F.coalesce(F.shiftright(athlete, TOGETHER), F.lit(NOBODY)).alias("few"), F.coalesce(athlete, F.lit(0)).alias("athlete"), F.coalesce(day, F.lit(0)).alias("day"), day.isNotNull().alias("dated"), F.coalesce("load", F.lit(0.0)).cast("double").alias("load"))
    return rows.groupBy("few").transformWithStateInPandas(RollingLoad(kept_days, idle_days), _ROLLING, "append", "processingTime" if idle_days else "none")


def rocks_state(spark: SparkSession) -> None:
    """State that is bounded by disk rather than by an executor's heap; stream operators with maps and timers need it."""
    spark.conf.set(_STORE, _ROCKS)


def latest_days(curve: DataFrame) -> DataFrame:
    """The last revision of each day of rolling_load()'s rows; days that were only missed are left out."""
    given = curve.where("kind <> 'missed'")
    return given.groupBy("athlete", "day").agg(F.max_by(F.struct("load", "ctl", "atl"), "revision").alias("x")).select("athlete", "day", "x.*")


class Ring(StatefulProcessor):
    """The last rows of one source by id."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "id long", "ts timestamp, level string, label string, detail string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = sorted(k[0] for k in self.rows.keys())  # noqa: SIM118
        least = had[0] if len(had) >= self.most else None
        new = None
        for r in rows:
            r = r if least is None else r[r["id"] >= least]
            new = (r if new is None else pd.concat([new, r])).drop_duplicates("id", keep="last").nlargest(self.most, "id")
        stay = set(sorted({*had, *new["id"].tolist()})[-self.most :])
        for i in had:
            if i not in stay:
                self.rows.removeKey((i,))
        out = new[new["id"].isin(stay)].sort_values("id")
        for r in out.itertuples(index=False):
            self.rows.updateValue((int(r.id),), (r.ts, r.level, r.label, r.detail))
        gone = pd.DataFrame({"source": key[0], "id": [i for i in had if i not in stay], "gone": True})
        yield pd.concat([out.assign(source=key[0], gone=False), gone])[["source", "id", "ts", "level", "label", "detail", "gone"]].astype({"gone": bool, "id": "int64"}).replace({float("nan"): None, pd.NaT: None})

    def close(self) -> None:
        pass


def trace_ring(log: DataFrame, most: int = 500) -> DataFrame:
    """Changes of a ring of the last `most` rows of each source: rows that come in (gone: false) and ids that they push out (gone: true).
    log: source, id, ts, level, label, detail. A row whose id is there already replaces it; ids under a full ring's are passed over, so a
    source's state never has more than `most` rows. keep_ring() applies the changes to a stored table for tail() and since()."""
    ship(log.sparkSession)
    rows = log.select("source", F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "level", "label", "detail").where("id is not null")
    return rows.groupBy("source").transformWithStateInPandas(Ring(most), "source string, id long, ts timestamp, level string, label string, detail string, gone boolean", "append", "none")


def keep_ring(changes: DataFrame, store: Store, checkpoint: str, writer: str = "ring") -> None:
    """Runs what is there now into a store with the keys source and id, whose rows are then the ring of every source."""

    def put(old: DataFrame, new: DataFrame) -> DataFrame:
        last = new.groupBy("source", "id").agg(F.min("gone").alias("gone"))
        stays = new.where("not gone").join(last.where("not gone").select("source", "id"), ["source", "id"], "left_semi")
        out = old.join(new.select("source", "id").distinct(), ["source", "id"], "left_anti").unionByName(stays)
        dropped = new.where("gone").select("source", "id").distinct()
        return out.join(dropped, ["source", "id"], "left_anti")

    q = changes.writeStream.foreachBatch(lambda rows, batch: store.merge(rows, put, writer, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def tail(log: DataFrame, since: int | None = None, most: int = 100) -> DataFrame:
    """The last rows of a log by id, or those after an id."""
    return log.where(F.col("id") > since).orderBy("id").limit(most) if since is not None else log.orderBy(F.desc("id")).limit(most)
