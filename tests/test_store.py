"""Stored ledgers: versions, merges, failures, additive columns, and imports that break off."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trainlake.store import Conflict, Store
from trainlake.streaming import imports


@pytest.fixture
def folder(spark, tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('store')}"


def frame(spark, rows, schema="k long, a string, b long"):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_keeps_known_values_and_versions(spark, folder):
    t = Store(spark, folder, ["k"], 4)
    assert t.version() is None
    with pytest.raises(FileNotFoundError):
        t.read()
    t.merge(frame(spark, [(i, f"a{i}", i) for i in range(20)]))
    t.merge(frame(spark, [(3, None, 33), (4, "new", None), (99, "x", None)]))
    want = {i: (f"a{i}", i) for i in range(20)} | {3: ("a3", 33), 4: ("new", 4), 99: ("x", None)}
    assert {r.k: (r.a, r.b) for r in t.read().collect()} == want
    assert {r.k: (r.a, r.b) for r in t.read(0).collect()} == {i: (f"a{i}", i) for i in range(20)}


def test_read_modify_write_of_one_table(spark, folder):
    t = Store(spark, folder, ["k"], 3)
    t.replace(frame(spark, [(i, "a", i) for i in range(10)]))
    for _ in range(3):
        t.replace(t.read().withColumn("b", F.col("b") + 1))
    assert sorted(r.b for r in t.read().collect()) == list(range(3, 13))
    t.merge(t.read().where("k < 5").withColumn("b", F.lit(0).cast("long")))
    assert sorted(r.b for r in t.read().collect()) == [0] * 5 + list(range(8, 13))


def test_only_touched_parts_are_rewritten(spark, folder):
    t = Store(spark, folder, ["k"], 8)
    t.merge(frame(spark, [(i, "a", i) for i in range(200)]))
    before = t.version().parts
    t.merge(frame(spark, [(7, "z", 0)]))
    after = t.version().parts
    assert sum(before[p] != after[p] for p in before) == 1 and len(after) == 8


def test_a_failed_write_leaves_the_old_version(spark, folder):
    t = Store(spark, folder, ["k"], 2)
    t.merge(frame(spark, [(1, "a", 1)]))
    bad = frame(spark, [(1, "b", 2)]).withColumn("a", F.when(F.col("b") == 2, F.raise_error(F.lit("forced"))).cast("string"))
    with pytest.raises(Exception, match="forced"):
        t.merge(bad)
    with pytest.raises(Exception, match="forced"):
        t.merge(frame(spark, [(1, "b", 2)]), lambda old, new: new.withColumn("a", F.raise_error(F.lit("forced")).cast("string")))
    assert rows_of(t.read()) == [(1, "a", 1)] and t.version().number == 0
    t.merge(frame(spark, [(1, "c", None)]))
    assert rows_of(t.read()) == [(1, "c", 1)]


def test_second_writer_of_a_version_is_told(spark, folder):
    t = Store(spark, folder, ["k"], 2)
    t.merge(frame(spark, [(1, "a", 1)]))

    def slow(old, new):
        Store(spark, folder, ["k"], 2).merge(frame(spark, [(2, "b", 2)]))
        return old.unionByName(new)

    with pytest.raises(Conflict):
        t.merge(frame(spark, [(3, "c", 3)]), slow)
    assert rows_of(t.read()) == [(1, "a", 1), (2, "b", 2)]


def test_batches_go_in_once(spark, folder):
    t = Store(spark, folder, ["k"], 2)
    assert t.append(frame(spark, [(1, "a", 1)]), "w", 0)
    assert not t.append(frame(spark, [(1, "a", 1)]), "w", 0)
    assert t.append(frame(spark, [(1, "a", 1)]), "other", 0)
    assert t.append(frame(spark, [(2, "a", 1)]), "w", 1)
    assert t.read().count() == 3
    assert t.read_before("w", 1, "k long").count() == 2 and t.read_before("w", 2, "k long").count() == 3
    assert t.read_before("w", 0, "k long").count() == 0


def test_columns_are_added_without_rewriting(spark, folder):
    t = Store(spark, folder, ["k"], 4)
    t.merge(frame(spark, [(i, "a", i) for i in range(8)]))
    t.add_columns({"c": ("int", 7), "a": ("string", "ignored"), "d": ("string", None)})
    assert {tuple(r) for r in t.read().select("a", "c", "d").collect()} == {("a", 7, None)}
    t.merge(frame(spark, [(1, "b", 1, 8, 0.5)], "k long, a string, b long, c int, e double"))
    got = {r.k: r for r in t.read().collect()}
    assert tuple(got[1]) == (1, "b", 1, 8, None, 0.5) and tuple(got[2]) == (2, "a", 2, 7, None, None)


def test_vacuum(spark, folder):
    t = Store(spark, folder, ["k"], 2)
    for i in range(5):
        t.merge(frame(spark, [(i, "a", i)]))
    t.vacuum(2)
    assert t.read().count() == 5 and t.read(3).count() == 4
    with pytest.raises(Exception):
        t.read(1)


def gpx(at, n, step=10):
    point = lambda i: f'<trkpt lat="{30 + i / 1e4}" lon="110"><time>{(at + timedelta(seconds=step * i)).strftime("%Y-%m-%dT%H:%M:%SZ")}</time></trkpt>'
    return '<gpx xmlns="http://www.topografix.com/GPX/1/0"><trk><type>running</type><trkseg>' + "".join(map(point, range(n))) + "</trkseg></trk></gpx>"


def put(folder, files):
    for name, text in files.items():
        with open(f"{folder.removeprefix('file://')}/{name}", "w") as f:
            f.write(text)


def state(importer):
    acts = sorted((str(r.start_time), r.sport_type, r.duration_s) for r in importer.activities.read().collect())
    n = sorted(tuple(r) for r in importer.samples.read().groupBy("activity_id").count().select("count").collect())
    return acts, n, importer.results.read().count()


def test_import_twice_and_after_a_crash(spark, folder, tmp_path_factory, monkeypatch):
    inbox = f"file://{tmp_path_factory.mktemp('inbox')}"
    day = datetime(2024, 1, 1)
    files = {f"f{i}.gpx": gpx(day + timedelta(days=i), 5 + i) for i in range(4)} | {"copy.gpx": gpx(day, 5), "bad.csv": "a,b\n1,2\n", "odd.doc": "?", "long.gpx": gpx(day + timedelta(days=9), 3, 80_000)}
    put(inbox, files)
    one = imports.Importer(spark, f"{folder}/one", n_parts=3)
    one.run(imports.read_files(spark, inbox, 5), f"{folder}/one-checkpoint")
    acts, n, results = state(one)
    assert len(acts) == 4 and [x for (x,) in n] == [5, 6, 7, 8] and results == 8
    reasons = {r.path: r.reason for r in one.results.read().collect()}
    assert reasons["bad.csv"] == "no_header" and reasons["odd.doc"] == "unknown_type" and reasons["long.gpx"] == "duration"
    assert sorted(str(reasons[x]) for x in ("f0.gpx", "copy.gpx")) == ["None", "duplicate"]
    # all files again, as by another stream: nothing comes in twice
    two = imports.Importer(spark, f"{folder}/one", writer="again", n_parts=3)
    two.run(imports.read_files(spark, inbox, 100), f"{folder}/again-checkpoint")
    assert state(two) == (acts, n, results)
    # a run that breaks off between two of the three writes, in its second batch, and is started again
    crash = imports.Importer(spark, f"{folder}/crash", n_parts=3)
    whole, left = Store.append, [3]

    def failing(self, *a):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("forced")
        return whole(self, *a)

    monkeypatch.setattr(Store, "append", failing)
    with pytest.raises(Exception, match="forced"):
        crash.run(imports.read_files(spark, inbox, 5), f"{folder}/crash-checkpoint")
    monkeypatch.setattr(Store, "append", whole)
    assert crash.samples.version().number > crash.activities.version().number
    crash.run(imports.read_files(spark, inbox, 5), f"{folder}/crash-checkpoint")
    assert state(crash) == (acts, n, results)
    # a later file is imported by itself
    put(inbox, {"late.gpx": gpx(day + timedelta(days=20), 9)})
    crash.run(imports.read_files(spark, inbox, 5), f"{folder}/crash-checkpoint")
    assert len(state(crash)[0]) == 5
    shutil.rmtree(inbox.removeprefix("file://"))


def test_all_cores_write_a_table_of_few_parts(spark, tmp_path):
    from pathlib import Path

    from trainlake.store import Store

    store = Store(spark, f"file://{tmp_path}/few", ["k"], 1)
    store.merge(spark.range(1000).withColumnRenamed("id", "k"))
    assert len(list(Path(tmp_path, "few").glob("data-*/*/*.parquet"))) > 1
    assert sorted(r.k for r in store.read().collect()) == list(range(1000))


def test_imported_files_are_parsed_once(spark):
    from trainlake.operators import ingest

    point = '<gpx><trk><trkseg><trkpt lat="1" lon="2"><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>'
    heads, points = ingest.parse(spark.createDataFrame([("a.gpx", "gpx", point)], "path string, kind string, content string"))
    for df in (heads, points):
        assert "from_xml" not in df._jdf.queryExecution().analyzed().toString()
    assert [r.n_samples for r in heads.collect()] == [1] and points.count() == 1
