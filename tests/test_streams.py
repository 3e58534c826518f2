"""Streams over several batches: late and repeated loads, sessions."""

import math
import time
from datetime import datetime, timedelta

from trainlake.store import Store
from trainlake.streaming import streams


def batches(spark, path, schema, parts):
    """One file a batch, in order of time."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def curve(loads):
    """(athlete, day) -> (load, ctl, atl) of every day with a load, from all loads at once."""
    out = {}
    for a in {x[0] for x in loads}:
        mine = [(d, x) for b, d, x in loads if b == a]
        for day in {d for d, _ in mine}:
            avg = lambda tau: sum(x * (1 - math.exp(-1 / tau)) * math.exp(-(day - d) / tau) for d, x in mine if d <= day)  # noqa: B023, E731
            out[a, day] = (sum(x for d, x in mine if d == day), avg(42), avg(7))
    return out


def close(got, want):
    return all(abs(x - y) < 1e-9 for x, y in zip(got, want, strict=True))


def rolled(spark, tmp_path, parts, **how):
    path = f"file://{tmp_path}/loads"
    batches(spark, path, "athlete long, day long, load double", parts)
    stream = spark.readStream.schema("athlete long, day long, load double").option("maxFilesPerTrigger", 1).parquet(path)
    streams.rocks_state(spark)
    return streams.run_to_end(streams.rolling_load(stream, **how), f"loads-{len(parts)}").collect()


def test_late_loads_give_their_day_and_all_after_it_again(spark, tmp_path):
    parts = [[(1, 10, 50.0), (1, 12, 30.0), (2, 10, 5.0)], [(1, 12, 20.0), (2, 11, 7.0)], [(1, 11, 40.0), (1, 15, 10.0), (2, None, 1.0)], [(2, 3, 8.0), (1, 9, None)]]
    got = rolled(spark, tmp_path, parts)
    upto = lambda k: curve([(a, d, x or 0.0) for p in parts[: k + 1] for a, d, x in p if d is not None])
    for r in got:
        assert close((r.load, r.ctl, r.atl), upto(r.revision - 1 if r.athlete == 1 else r.revision - 1)[r.athlete, r.day])
    last = {}
    for r in sorted(got, key=lambda r: r.revision):
        last[r.athlete, r.day] = (r.load, r.ctl, r.atl)
    want = upto(3)
    assert last.keys() == want.keys() and all(close(last[k], want[k]) for k in want)
    kinds = {(r.athlete, r.day, r.revision): r.kind for r in got}
    assert kinds[1, 11, 3] == kinds[1, 12, 3] == "again" and kinds[1, 15, 3] == "new"
    assert kinds[2, 3, 4] == kinds[2, 10, 4] == kinds[2, 11, 4] == "again" and (1, 10, 3) not in kinds


def test_state_is_bounded_and_days_before_it_are_missed(spark, tmp_path):
    loads = [(1, d, 10.0 + d) for d in range(0, 100, 2)]
    parts = [loads[:30], loads[30:], [(1, 20, 7.0), (1, 95, 3.0)]]
    got = rolled(spark, tmp_path, parts, kept_days=10)
    want = curve([x for p in parts for x in p])
    final = [r for r in got if r.revision == 3]
    assert [(r.day, r.load, r.ctl) for r in final if r.kind == "missed"] == [(20, 7.0, None)]
    again = {r.day: r for r in final if r.kind != "missed"}
    assert sorted(again) == [88, 90, 92, 94, 95, 96, 98]  # the kept days only
    assert all(close((r.load, r.ctl, r.atl), want[1, d]) for d, r in again.items())


def test_trace_ring(spark, tmp_path):
    at = datetime(2024, 1, 1)
    row = lambda s, i, label="x": (s, i, at + timedelta(seconds=i), "node", label, None)
    parts = [[row("a", i) for i in range(1, 8)] + [row("b", 1)], [row("a", i) for i in (3, 8, 9)] + [row("b", 1, "y"), row("b", 2)], [row("a", 10), row("a", 1), row("c", 5)]]
    path, schema = f"file://{tmp_path}/log", "source string, id long, ts timestamp, level string, label string, detail string"
    batches(spark, path, schema, parts)
    streams.rocks_state(spark)
    store = Store(spark, f"file://{tmp_path}/ring", ["source", "id"], 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.keep_ring(streams.trace_ring(stream, 5), store, f"file://{tmp_path}/ring-checkpoint")
    ring = {}
    for r in store.read().collect():
        ring.setdefault(r.source, []).append((r.id, r.label))
    assert {s: sorted(x) for s, x in ring.items()} == {"a": [(i, "x") for i in range(6, 11)], "b": [(1, "y"), (2, "x")], "c": [(5, "x")]}
    assert all(store.read(v).groupBy("source").count().agg({"count": "max"}).first()[0] <= 5 for v in range(3))
    assert [r.id for r in streams.tail(store.read().where("source = 'a'"), since=8).collect()] == [9, 10]


def test_sessions(spark, tmp_path):
    at = datetime(2024, 1, 1)
    hours = lambda *hs: [(1, at + timedelta(hours=h)) for h in hs]
    path = f"file://{tmp_path}/events"
    batches(spark, path, "user_id long, ts timestamp", [hours(0, 1, 5), hours(20, 21), hours(200)])
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.start.hour, r.n) for r in streams.run_to_end(streams.sessions(stream), "sessions").collect()}
    assert got == {(0, 3), (20, 2)}


def test_neighbours_come_together_and_keep_their_own_state():
    """A call holds many athletes; the state of each is read and written once, however many days it has."""
    import pandas as pd

    state, calls = {}, {"get": 0, "put": 0}

    class Map:
        def getValue(self, key):
            calls["get"] += 1
            return state.get(key)

        def updateValue(self, key, value):
            calls["put"] += 1
            state[key] = value

    class Handle:
        def getMapState(self, *_):
            return Map()

    p = streams.RollingLoad(1000, None)
    p.init(Handle())
    loads = [(a, d, float(a + d)) for d in (3, 1, 9) for a in range(64)]
    batch = lambda rows: pd.DataFrame([(*r, True) for r in rows], columns=["athlete", "day", "load", "dated"])
    first, again = loads[:100], loads[100:]
    got = {}
    for rows in (first, again):
        for out in p.handleInputRows((0,), iter([batch(rows)]), None):
            got |= {(r.athlete, r.day): (r.load, r.ctl, r.atl) for r in out.itertuples()}
    want = curve(loads)
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)
    assert calls == {"get": 128, "put": 128}


def test_ids_beyond_doubles_and_none(spark, tmp_path):
    big = 2**53 + 1
    got = rolled(spark, tmp_path, [[(big, 1, 5.0), (big - 1, 1, 7.0), (None, 1, 9.0), (-1, 1, 3.0)], [(big, 2, 1.0), (None, 2, 2.0)]])
    assert {(r.athlete, r.day, r.load, r.revision) for r in got} == {(big, 1, 5.0, 1), (big - 1, 1, 7.0, 1), (None, 1, 9.0, 1), (-1, 1, 3.0, 1), (big, 2, 1.0, 2), (None, 2, 2.0, 2)}
