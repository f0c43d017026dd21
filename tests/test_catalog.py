"""Every registered query of the domain against its SQL, and the plans that matter."""

import datetime
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, QUERIES
from tidemark.operators import analytics, sinks, state
from tidemark.sources.crosswalk import match_events, posts
from tidemark.streaming import ingest
from tests.helpers import events

DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_pushed_below_the_window(spark):
    rows = state.topic_matches(match_events(spark, DIR)).filter("tenant_id = 't1'")
    text = plan(rows)
    assert "WindowGroupLimit" in text and text.index("Window") < text.rindex("Filter")


def test_scans_read_what_they_need(spark):
    text = plan(posts(spark, DIR).groupBy("platform").agg(F.count("*")))
    assert "text:string" not in text
    feed = plan(analytics.feed(match_events(spark, DIR), posts(spark, DIR), analytics.Filter("t1", "q1", datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 9))))
    assert "TakeOrderedAndProject" in feed and "NestedLoop" not in feed


def test_months_are_pruned(spark, tmp_path):
    sinks.write_monthly(match_events(spark, DIR).drop("media"), str(tmp_path / "m"), "published_at", ["tenant_id", "published_at"])
    assert "PartitionFilters: [isnotnull(ym" in plan(sinks.read_months(spark, str(tmp_path / "m"), "202401", "202401"))


def test_a_replayed_batch_counts_once(spark, tmp_path):
    rows = match_events(spark, DIR)
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    for _ in range(2):  # the second run finds nothing new
        ingest.drain(ingest.read_stream(spark, path, rows.schema), str(tmp_path / "out"), str(tmp_path / "check"), key=ingest.EVENT_KEY)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == rows.count()
    first = out.filter("batch_id = 0").drop("batch_id")
    sinks.write_batch(spark.createDataFrame(first.collect(), first.schema), str(tmp_path / "out"), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_late_rows_are_kept(spark, tmp_path):
    days = [30, 31, 2, 3, 2, 30]
    for n, day in enumerate(days):
        rows = [{"post_id": f"p{day}-{i}", "published_at": datetime.datetime(2024, 1, day, i)} for i in range(8)]
        events(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), match_schema(spark), files_per_batch=1)
    ingest.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"), key=ingest.EVENT_KEY)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("post_id").distinct().count() == 32


def match_schema(spark):
    return events(spark).schema


def test_windows_in_update_mode(spark, tmp_path):
    events = match_events(spark, DIR)
    events.write.parquet(str(tmp_path / "in"))
    rows = ingest.tumbling(ingest.read_stream(spark, str(tmp_path / "in"), events.schema), "1 day")
    query = rows.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("tumbled").agg(F.sum("posts")).first()[0] == events.agg(F.sum("sign")).first()[0]
