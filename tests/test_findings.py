"""What a reviewer found on larger tables."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import events
from tidemark.catalog import QUERIES
from tidemark.catalog.book import plain
from tidemark.functions import text as X
from tidemark.functions.text import upper_each
from tidemark.operators import aggregates, analytics, kept, ops, sharing
from tidemark.operators.sinks import once_each


def test_account_years_of_many_authors(spark):
    one = events(spark, {}).drop("author_id", "author_created_year")
    many = one.crossJoin(spark.range(20_000).selectExpr("concat('a', id) as author_id", "cast(2020 as int) as author_created_year"))
    f = analytics.Filter("A", "T", datetime(2026, 9, 27), datetime(2026, 9, 28))
    assert [tuple(r) for r in analytics.author_created_year(analytics.Tables(many), f).collect()] == [("2020", 20_000)]


def test_cost_split_of_decimals_is_exact(spark):
    runs = spark.createDataFrame([("r", Decimal(70_000_003))], "run_id string, cost decimal(18,0)")
    weights = spark.createDataFrame([("r", "A", 1), ("r", "B", 6)], "run_id string, tenant_id string, matches long")
    got = {r.tenant_id: r.cost for r in ops.allocate(runs, weights, ["cost"]).collect()}
    assert got == {"A": Decimal("10000000.428571429"), "B": Decimal("60000002.571428571")}


def test_needles_whose_case_depends_on_their_place(spark):
    posts = spark.createDataFrame([(1, "ΟΔΟΣΑ straße İzmir")], "id int, text string")
    needles = spark.createDataFrame([("ΔΟΣ",), ("İZM",), ("aße",)], "needle string").select(F.when(F.col("needle") == "aße", upper_each(F.col("needle"))).otherwise(F.col("needle")).alias("needle"))
    assert {r.needle for r in analytics.needle_hits(posts, needles, ["id"]).collect()} == {"δοσ", "izm", "aße"}


def test_far_years_have_no_sign(spark):
    row = plain(spark.sql("select timestamp'9999-12-31 10:00:00' + interval 1 day as t")).first()
    assert row.t == "10000-01-01 10:00:00"


def test_a_stream_reads_what_its_table_needs(spark):
    e = events(spark, {}, {"post_id": "q", "issues": ["i"], "hashtags": ["H"], "parent_author_id": "b", "content_type": "repost"})
    for name in ("agg_topic_1h", "agg_emotion_1d", "agg_author_1d", "agg_issue_1h", "agg_reposted_author_1d", "agg_geo_1d"):
        few = e.select(*aggregates.takes(e, name))
        assert len(few.columns) < 15 and sorted(aggregates.build(few, name).collect()) == sorted(aggregates.build(e, name).collect())
    plan = once_each(e, ["post_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan.split("Exchange")[1]


def test_a_batch_of_kept_rows_is_dealt_out_once(spark):
    rows = kept.dealt(events(spark, {}, {"seq": 2, "sentiment": "positive"}, {"post_id": "q"}), kept.MATCHES)
    out = kept.newest(rows.unionByName(rows), kept.MATCHES)
    assert sorted((r.post_id, r.seq) for r in out.collect()) == [("p", 2), ("q", 0)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_latin_texts_stay_in_the_jvm(spark):
    plain = X.plain_characters()
    texts = [plain, plain[::-1], *plain, *(a + b for a, b in zip(plain, plain[1:])), "e\u0301t\u0130", "\ufb01n \u200bx", "abc\u2028", "\u039f\u03a3 a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumns({"f": X.normalize_text(F.col("t")), "c": X.compose(F.col("t")), "p": F.col("t").rlike(X.PLAIN)})
    rows = df.collect()
    assert [(r.f, r.c) for r in rows] == [(X.fold(t), X.composed(t)) for t in texts]
    assert [r.p for r in rows[-5:]] == [False, False, False, False, True] and all(r.p for r in rows[:-5]) and {"\u00e9", "\u00d1", "\u2013"} <= set(plain)


def test_counters_that_one_sample_reads_are_summed_together(spark):
    rng = random.Random(8)
    some = lambda: rng.choice([None, *range(12)])
    log = [(s, t, some(), some()) for s in ("a", "b", None) for t in [*range(40), *range(0, 40, 3), None]]
    last = lambda x: (x is None, x or 0)
    want = {}
    for s in ("a", "b", None):
        rows = sorted((r[1:] for r in log if r[0] == s), key=lambda r: [last(x) for x in r])
        steps = [(x, y) for a, b in zip(rows, rows[1:], strict=False) for x, y in [(a[1:], b[1:])]]
        want[s] = tuple(sum(0 if y[i] is None or x[i] is None else y[i] if y[i] < x[i] else y[i] - x[i] for x, y in steps) for i in (0, 1))
    df = spark.createDataFrame(log, "s string, t int, v long, u long")
    for block in ("t div 7", "t", "0 * t"):
        got = ops.increase_totals(df, ["s"], "t", ["v", "u"], F.expr(block)).collect()
        assert {r.s: (r.v, r.u) for r in got} == want and len(got) == 3


@pytest.mark.parametrize("name", ["counter_increase", "histogram_quantile"])
def test_samples_of_counters_are_sorted_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Join" not in plan and plan.count("Scan parquet") == 1 and "Generate" not in plan.split("Window")[-1]


def test_plans_of_equal_terms_are_one_node(spark, monkeypatch):
    nodes, components = [], sharing.components
    monkeypatch.setattr(sharing, "components", lambda edges, *names: nodes.append(edges.select(names[0]).distinct().count()) or components(edges, *names))
    terms = "case id % 3 when 0 then array('a', 'b') when 1 then array('b', 'a', 'b') else array('c') end as terms"
    plans = spark.range(300).selectExpr("id as plan_id", "'t' as tenant_id", "'p' as platform", "'o' as operation", "60 as interval_s", "false as own_account", terms)
    want = {(i, f"p|o|*|60|{2 if i % 3 == 2 else 0}", 60, False) for i in range(300)}
    for most in (0, 50_000):
        monkeypatch.setattr(sharing, "MERGED", most)
        assert {tuple(r) for r in sharing.shared(plans).collect()} == want
    assert nodes == [2, 2]
