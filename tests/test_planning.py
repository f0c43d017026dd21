"""Golden cases of planning: gaps by the order of results, watermarks, intervals, budgets; and plans that must scale."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from tidemark.operators import evalkit, ops, planning, sinks

T = dt.datetime(2026, 9, 27, 10)
at = lambda m: T + dt.timedelta(minutes=m)
RUN = "plan_id string, run_id long, status string, kind string, window_from timestamp, window_to timestamp, min_published_at timestamp, max_published_at timestamp, result_order string, finished_at timestamp"
now = lambda: F.lit(at(120))


def test_gaps_follow_the_order_of_results(spark):
    row = lambda i, order, lo=at(20), hi=at(40), status="partial", kind="incremental", start=at(0): ("a", i, status, kind, start, at(60), lo, hi, order, at(i))
    runs = spark.createDataFrame([row(1, "desc"), row(2, "asc"), row(3, None), row(4, "desc", lo=None), row(5, "asc", hi=None), row(6, "desc", status="succeeded"), row(7, "desc", kind="backfill"), row(8, "desc", start=None)], RUN)
    got = {r.run_id: (r.gap_start, r.gap_end) for r in planning.gaps(runs).collect()}
    assert got == {1: (at(0), at(20)), 2: (at(40), at(60)), 3: (at(0), at(60)), 4: (at(0), at(60)), 5: (at(0), at(60))}
    assert {r.run_id for r in planning.gaps(runs, 2).collect()} == {4, 5}


def test_only_whole_runs_move_the_watermark_and_never_back(spark):
    runs = spark.createDataFrame([(p, i, s, k, None, None, None, hi, None, None) for i, (p, s, k, hi) in enumerate([("a", "succeeded", "incremental", at(5)), ("a", "partial", "incremental", at(50)), ("a", "succeeded", "backfill", at(60)), ("b", "succeeded", "incremental", at(1))])], RUN)
    plans = spark.createDataFrame([("a", None, 300), ("b", at(9), 900), ("c", None, 300)], "plan_id string, high_watermark timestamp, interval_s int")
    got = {r.plan_id: (r.high_watermark, r.since) for r in planning.windows(planning.watermarks(plans, runs), now()).collect()}
    assert got == {"a": (at(5), at(4)), "b": (at(9), at(6)), "c": (None, at(60))}


def test_intervals(spark):
    plans = spark.createDataFrame([(i, p, i, "t", 600, at(200), s) for i, (p, s) in enumerate([("x", "active"), ("y", "active"), ("x", "disabled"), ("z", "active")])], "plan_id int, platform string, topic_id int, tenant_id string, interval_s int, next_run_at timestamp, status string")
    topics = spark.createDataFrame([(i, 700) for i in range(4)], "topic_id int, default_interval_s int")
    offices = spark.createDataFrame([("t", 120, {"y": 60})], "tenant_id string, min_interval_s int, platform_intervals map<string,int>")
    platforms = spark.createDataFrame([("x", 500), ("y", 500)], "platform string, crawl_interval_s int")
    chosen = spark.createDataFrame([], "topic_id int, platform string, chosen_s int")
    got = {r.plan_id: (r.interval_s, r.next_run_at) for r in planning.resynced(plans, topics, offices, platforms, chosen, now()).collect()}
    assert got == {0: (500, at(120) + dt.timedelta(seconds=500)), 1: (120, at(122)), 2: (600, at(200)), 3: (600, at(200))}


def test_comments_keep_to_the_budget(spark):
    matches = spark.createDataFrame([("t", "q", "x", f"p{i}", "reply" if i == 9 else "post", 100 + i, at(-i)) for i in range(10)], "tenant_id string, topic_id string, platform string, post_id string, content_type string, engagement int, published_at timestamp")
    fetched = spark.createDataFrame([("q", "x", "p8", at(0))], "topic_id string, platform string, post_id string, fetched_at timestamp")
    got = {r.post_id for r in planning.comment_plan(matches, fetched, now(), per_day=4).collect()}
    assert got == {"p7", "p6", "p5"}


def test_refresh_runs_hold_fifty(spark):
    matches = spark.range(120).select(F.lit("x").alias("platform"), F.format_string("p%03d", "id").alias("post_id"), F.lit(at(0)).alias("published_at"))
    none = spark.createDataFrame([], "platform string, post_id string, captured_at timestamp")
    got = planning.refresh_plan(matches, none, now(), per_platform=110).groupBy("run").count().collect()
    assert {r.run: r["count"] for r in got} == {0: 50, 1: 50, 2: 10}


def test_crossings_by_blocks_are_those_of_the_whole_log(spark):
    log = spark.range(400).selectExpr("id % 3 as k", "id as n", "id % 7 as amount")
    whole = lambda block: {tuple(r) for r in ops.crossings(log, ["k"], ["n"], "amount", 300, [50, 80, 100, 101], block=block).collect()}
    assert whole(F.expr("n div 10")) == whole(F.lit(0)) and len(whole(F.lit(0))) == 12


def test_strata_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id", "id % 2 as s")
    out = evalkit.stratified_sample(rows, "s", "id", 100, 10)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 100


def test_csv_begins_with_a_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("=1", "é")], "a string, b string").coalesce(1), str(tmp_path / "c"))
    data = b"".join(open(p, "rb").read() for p in glob.glob(str(tmp_path / "c/*.csv")))
    assert data == "﻿a,b\r\n'=1,é\r\n".encode()


def test_search_takes_wildcards_as_they_are(spark):
    rows = spark.createDataFrame([("50% off",), ("50 off",), ("a_b",), ("aXb",), ("c\\d",)], "name string")
    found = lambda t: [r.name for r in ops.searched(rows, "name", t).collect()]
    assert found("0% O") == ["50% off"] and found("A_B") == ["a_b"] and found("\\") == ["c\\d"] and len(found("")) == 5
