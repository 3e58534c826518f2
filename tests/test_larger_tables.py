"""Queries on tables repeated with shifted keys: ids are larger, addresses come more than once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trainlake import queries as core

from .compare import assert_same


@pytest.fixture(scope="module")
def larger(spark, sf_dir, tmp_path_factory):
    """Folder of events whose ids pass the seconds of four days, and of pages with repeated and missing addresses; and its SQL views."""
    top = tmp_path_factory.mktemp("larger")
    e, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "pages"))
    for t, df in {
        "events": e.withColumn("event_id", F.col("event_id") + 86_300).unionByName(e.withColumns({"event_id": F.col("event_id") + 400_000, "user_id": F.col("user_id") + 1})),
        "pages": p.unionByName(p.withColumns({"page_id": F.col("page_id") + 10_001, "html": F.concat("html", F.lit("!")), "url": F.when(F.col("page_id") % 5 != 0, F.col("url"))})),
    }.items():
        df.write.parquet(f"file://{top}/{t}.parquet")
    c = duckdb.connect()
    for t in ("events", "pages"):
        c.execute(f"create view {t} as select * from '{top}/{t}.parquet/*.parquet'")
    return f"file://{top}", c


@pytest.mark.parametrize("name", ["src07_csv", "src07_quoted", "src27_fallback"])
def test_query(spark, larger, name):
    folder, duck = larger
    assert_same(core.queries()[name](spark, folder), duck.execute(core.oracle_sql()[name]))
