import json
from datetime import datetime

import pytest

from trainlake.functions import timeparse
from trainlake.operators import samples as sample_ops
from trainlake.sources import workouts

F = pytest.importorskip("pyspark.sql.functions")

GPX = """<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1" xmlns:x="http://x/y"><trk><type>户外骑行</type><trkseg>{}</trkseg></trk></gpx>"""
POINT = '<trkpt lat="34.8" lon="{lon}"><ele>80</ele><time>2026-09-05T11:45:{s:02d}Z</time><extensions><x:TrackPointExtension><x:hr>{hr}</x:hr><x:cad>80</x:cad></x:TrackPointExtension></extensions></trkpt>'
TCX = """<?xml version="1.0"?><TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"><Activities><Activity Sport="Running"><Lap><Track>{}</Track></Lap></Activity></Activities></TrainingCenterDatabase>"""
TP = "<Trackpoint><Time>2026-09-05T11:45:{s:02d}Z</Time><Position><LatitudeDegrees>34.8</LatitudeDegrees><LongitudeDegrees>{lon}</LongitudeDegrees></Position><AltitudeMeters>80</AltitudeMeters><HeartRateBpm><Value>{hr}</Value></HeartRateBpm><Cadence>85</Cadence></Trackpoint>"


def files(spark, **contents):
    return spark.createDataFrame([(k, v) for k, v in contents.items()], "path string, content string")


def test_gpx(spark):
    body = "".join(POINT.format(lon=113 + i * 1e-4, s=i, hr=140 + i) for i in range(30))
    rows = workouts.read_gpx(files(spark, a=GPX.format(body))).orderBy("seq").collect()
    assert len(rows) == 30 and [r.t for r in rows] == [float(i) for i in range(30)]
    assert {r.sport_type for r in rows} == {"cycling"} and rows[0].start_time == datetime(2026, 9, 5, 19, 45)
    assert rows[3].hr == 143 and rows[3].cad == 80.0


def test_gpx_without_times_counts_points(spark):
    body = '<trkpt lat="34.8" lon="113"/><trkpt lat="34.8" lon="113.1"/>'
    rows = workouts.read_gpx(files(spark, a=GPX.format(body))).orderBy("seq").collect()
    assert [r.t for r in rows] == [0.0, 1.0] and rows[0].start_time is None


def test_tcx_and_gpx_distances_agree(spark):
    lons = [113 + i * 3e-5 for i in range(60)]
    g = workouts.read_gpx(files(spark, a=GPX.format("".join(POINT.format(lon=x, s=i, hr=150) for i, x in enumerate(lons)))))
    t = workouts.read_tcx(files(spark, a=TCX.format("".join(TP.format(lon=x, s=i, hr=150) for i, x in enumerate(lons)))))
    assert {r.cad for r in t.collect()} == {170.0}  # one leg counted
    d = [sample_ops.enrich(x.withColumnRenamed("path", "activity_id")).agg(F.sum("seg")).first()[0] for x in (g, t)]
    assert d[0] > 100 and abs(d[0] / d[1] - 1) < 0.01


CSV = {
    "plain": "Time,HeartRate,Speed\n" + "\n".join(f"2026-09-05 11:45:{i:02d},{140 + i},2.5" for i in range(30)),
    "preamble": "导出\n运动类型,户外骑行\n,\n时间,心率(bpm),配速,距离,步频\n" + "\n".join(f"2026-09-05 11:45:{i:02d},140,5:30,{i},170" for i in range(5)),
    "reversed": "HeartRate,Time\n140,0\n141,1\n142,2",
    "falling": "Time,HeartRate\n10,140\n5,141\n20,142",
    "daily": "日期,步数,卡路里\n2026-09-01,1000,200\n2026-09-02,1000,200",
    "relative": "Elapsed,HeartRate,Speed\n0:05,140,2.5\n0:10,141,2.6",
    "distance": "时间,心率,距离\n2026-09-05 11:45:01,140,3\n2026-09-05 11:45:02,141,6",
    "junk": "甲,乙,丙\n1,2,3",
    "empty": "",
}


def test_csv(spark):
    samples, headers = workouts.read_csv(files(spark, **CSV))
    h = {r.path: r for r in headers.collect()}
    s = {}
    for r in samples.orderBy("path", "seq").collect():
        s.setdefault(r.path, []).append(r)
    assert [r.t for r in s["plain"]] == [float(i) for i in range(30)] and s["plain"][0].hr == 140 and h["plain"].warnings == []
    assert h["preamble"].sport_type == "cycling" and s["preamble"][0].cad == 170.0 and abs(s["preamble"][0].speed - 1000 / 330) < 1e-9
    assert [r.t for r in s["reversed"]] == [0.0, 1.0, 2.0]
    assert h["falling"].error == "not_rising" and "falling" not in s
    assert h["daily"].error == "daily_table" and h["junk"].error == "no_header" and h["empty"].error == "no_data"
    assert h["relative"].start_time is None and "relative_time" in h["relative"].warnings and [r.t for r in s["relative"]] == [5.0, 10.0]
    assert h["distance"].warnings == ["no_distance"]


SHAPES = {
    # name: (file, error, times of its samples)
    "gap_falls": ("time,hr\n0,1\n5,1\n,1\n15,1", "not_rising", None),
    "gap_rises": ("time,hr\n0,1\n1,1\n,1\n15,1", None, [0.0, 1.0, 2.0, 15.0]),
    "absolute_gap": ("time,hr\n2026-09-05 10:00:00,1\n,1\n2026-09-05 10:00:09,1", None, [0.0, 0.0, 9.0]),
    "bare_date_first": ("time,hr\n2026-09-05,1\n2026-09-05 10:00:00,1", "daily_table", None),
    "time_then_bare_date": ("time,hr\n2026-09-05 00:00:00,1\n2026-09-05,1", None, [0.0, 0.0]),
    "epoch": ("time,hr\n1693900000,1\n1693900007,1", None, [0.0, 7.0]),
    "dotted": ("time,step.rate\n0,170\n1,171", None, [0.0, 1.0]),
    "dashed": ("TIME (s),Heart-Rate [bpm]\n0,150\n1,151", None, [0.0, 1.0]),
    "three_days": ("date,time,hr\n2026-09-01,0,1\n2026-09-02,1,1\n2026-09-03,2,1", "daily_table", None),
    "words": ("time,hr\nsoon,1\nlater,1", "bad_time", None),
    "clock_only": ("time,hr\n0:59,1\n1:00,1\n1:00:00,1", None, [59.0, 60.0, 3600.0]),
    "header_in_row_eleven": ("x,y\n" * 10 + "time,hr\n0,1", "no_header", None),
    "header_in_row_ten": ("x,y\n" * 9 + "time,hr\n0,1", None, [0.0]),
    "quoted": ('time,note,hr\r\n0,"a\r\nb, ""c""",1\r\n1,,2', None, [0.0, 1.0]),
}


def test_csv_shapes(spark):
    samples, headers = workouts.read_csv(files(spark, **{k: v[0] for k, v in SHAPES.items()}))
    times, rest = {}, {}
    for r in samples.orderBy("path", "seq").collect():
        times.setdefault(r.path, []).append(r.t)
        rest.setdefault(r.path, r)
    assert {r.path: r.error for r in headers.collect()} == {k: v[1] for k, v in SHAPES.items()}
    assert times == {k: v[2] for k, v in SHAPES.items() if v[2] is not None}
    assert rest["dotted"].cad == 170.0 and rest["dashed"].hr == 150


def test_csv_is_parsed_once(spark):
    samples, _ = workouts.read_csv(files(spark, **CSV))
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert sum("MapInPandas" in x or "EvalPython" in x for x in plan.split("\n")) == 1 and plan.count("Exchange hashpartitioning") == 1


def test_json(spark):
    rec = lambda n, sport: {"startTime": 1693900000000, "sportType": sport, "distance": 5, "dataList": [{"time": i, "heartRate": 140 + i % 5, "latitude": 34.8} for i in range(n)]}
    contents = {"multi": json.dumps({"record_list": [rec(30, "跑步"), rec(25, "骑行"), rec(3, "walk")]}), "bad": "{", "swapped": json.dumps({"list": [{"heartRate": 141, "time": 3}, {"heartRate": 142, "time": 4}]})}
    samples, headers = workouts.read_json(files(spark, **contents))
    h = {r.path: r for r in headers.collect()}
    assert (h["multi"].n_samples, h["multi"].records_found, h["multi"].records_importable, h["multi"].sport_type) == (30, 3, 2, "running")
    assert h["multi"].start_time == datetime(2023, 9, 5, 15, 46, 40) and h["bad"].n_samples is None
    rows = samples.where("path = 'swapped'").orderBy("seq").collect()
    assert [(r.t, r.hr) for r in rows] == [(3.0, 141), (4.0, 142)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2026-09-05T11:45:33.000Z", datetime(2026, 9, 5, 19, 45, 33)),
        ("2026-09-05T11:45:33", datetime(2026, 9, 5, 11, 45, 33)),
        ("2026-09-05T11:45:33+08:00", datetime(2026, 9, 5, 11, 45, 33)),
        ("2026-09-05T11:45:33-05:00", datetime(2026, 9, 6, 0, 45, 33)),
        ("2026-09-05T17:30:00Z", datetime(2026, 9, 6, 1, 30)),
        ("1693900000", datetime(2023, 9, 5, 15, 46, 40)),
        ("1693900000000", datetime(2023, 9, 5, 15, 46, 40)),
        ("330", None),
        ("2026/9/5 7:05", datetime(2026, 9, 5, 7, 5)),
        ("2026-09-05", datetime(2026, 9, 5)),
        ("soon", None),
        (None, None),
    ],
)
def test_times(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(timeparse.parse_time_or_epoch(F.col("raw"))).first()[0]
    assert got == want


def test_file_kinds(spark, tmp_path):
    (tmp_path / "A.GPX").write_text(GPX.format(""))
    (tmp_path / "b.txt").write_text("x")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in workouts.read_files(spark, str(tmp_path)).collect()}
    assert kinds == {"A.GPX": "gpx", "b.txt": None}
    assert workouts.rejects(workouts.read_files(spark, str(tmp_path))).count() == 1


def test_json_rows_are_handed_over_in_pieces():
    """A batch of many files gives frames that don't grow with it, and every point once."""
    import json

    import pandas as pd

    from trainlake.sources import workouts as w

    n, each = 150, 400
    files = pd.DataFrame({"path": [f"f{i}" for i in range(n)], "content": [json.dumps({"points": [{"time": t, "hr": i} for t in range(each)]}) for i in range(n)]})
    frames = list(w._json_records(iter([files]), 6, 50, 200))
    sizes = [sum(map(len, f["points"])) for f in frames]
    assert len(sizes) > 2 and max(sizes) < w.JSON_POINTS + each and sum(sizes) == n * each
    assert [p for f in frames for p in f["path"]] == files["path"].tolist()
