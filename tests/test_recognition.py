from datetime import datetime

from trainlake import queries as core
from trainlake.operators import recognition

SCHEMA = "image_id long, blocks array<struct<text:string,conf:double,bbox:array<array<double>>>>"


def plain(*texts):
    return [(t, 0.9, None) for t in texts]


def box(text, x, y, w=80.0, h=30.0):
    x, y = float(x), float(y)
    return (text, 0.9, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]])


def test_plain_blocks(spark):
    blocks = plain("户外跑步", "2026/09/14 20:27", "5.68", "公里", "00:34:51", "运动时间", "170次/分", "平均心率", "181次/分", "最大心率", "99167步/分", "步频", "97厘米", "步幅", "15米", "累计爬升", "454", "千卡")
    r = recognition.recognise(spark.createDataFrame([(1, blocks), (2, []), (3, plain("随便"))], SCHEMA), 2026).orderBy("image_id").collect()
    a = r[0]
    assert (a.sport_type, a.distance_km, a.duration_min, a.avg_hr, a.max_hr, a.avg_cadence_spm, a.avg_stride_m, a.elev_gain_m, a.calories) == ("running", 5.68, 34.85, 170, 181, 167, 0.97, 15, 454)
    assert a.start_time == datetime(2026, 9, 14, 20, 27) and a.notes == []
    assert "distance_km" in r[1].notes and "heart_rate" in r[2].notes


def test_boxes_below_and_beside(spark):
    blocks = [box("最大心率", 10, 10), box("步频", 300, 10), box("181", 10, 50), box("165", 300, 50), box("用时", 10, 200), box("1:02:30", 200, 200)]
    got = {r.field: r.value for r in recognition.fields(spark.createDataFrame([(1, blocks)], SCHEMA)).collect()}
    assert got == {"max_hr": 181.0, "avg_cadence_spm": 165.0, "duration_min": 62.5}


def test_glued_dates(spark):
    rows = [(1, plain("2026/9/519:45")), (2, plain("9月5日", "07:30")), (3, plain("2026/13/5")), (4, plain("2026/09/05"))]
    got = {r.image_id: (r.date, r.start_time) for r in recognition.start_times(spark.createDataFrame(rows, SCHEMA), 2026).collect()}
    assert got == {1: ("2026-09-05", datetime(2026, 9, 5, 19, 45)), 2: ("2026-09-05", datetime(2026, 9, 5, 7, 30)), 4: ("2026-09-05", None)}


def test_images_stay_in_their_rows(spark):
    """No join, window or shuffle moves blocks, and what stands under a null or a repeated id keeps its own fields."""
    rows = [(None, plain("15米", "累计爬升")), (7, plain("16米", "累计爬升", "2026/9/5")), (7, plain("454", "千卡"))]
    found = recognition.recognise(spark.createDataFrame(rows, SCHEMA), 2026)
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join", "Window"))
    got = {(r.image_id, r.elev_gain_m, r.calories, r.date) for r in found.collect()}
    assert got == {(None, 15.0, None, None), (7, 16.0, None, "2026-09-05"), (7, None, 454.0, None)}


def test_boxed_images_are_dealt_as_keys(spark, sf_dir):
    """The file of one row group keeps all cores at work, and its keys are all that is moved."""
    found = core.queries()["rec02_boxes"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
