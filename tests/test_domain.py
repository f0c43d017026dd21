"""Golden numbers of aggregates, corrections, feeds, alerts and evaluation."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import events
from tidemark.operators import aggregates, analytics, enrich, evalkit, ops, state
from tidemark.sources import items

F1 = analytics.Filter("A", "T", datetime(2026, 9, 27, 0, 0), datetime(2026, 9, 27, 23, 0))


def stream(spark):
    """Three posts, one delivered again, one corrected from negative to positive with more followers."""
    p1 = {"post_id": "p1", "issues": ["town hall"], "hashtags": ["CityDemo"], "media": [("image", "https://i", "t")]}
    p2 = {"post_id": "p2", "content_type": "reply", "sentiment": "neutral", "engagement": 0, "engagement_known": 0, "author_gender": "unknown", "author_age_range": "unknown"}
    p3 = {"post_id": "p3", "content_type": "repost", "sentiment": "positive", "author_id": "a2", "author_handle": "ani", "geo_region_code": "31", "parent_author_id": "orig", "parent_author_handle": "Origin", "hashtags": ["citydemo"]}
    base = events(spark, p1, p2, p3)
    at = datetime(2026, 9, 27, 11, 0)
    change = spark.createDataFrame([("A", "T", "x", "p1", at, "positive", 150, "human")], "tenant_id string, topic_id string, platform string, post_id string, at timestamp, sentiment string, author_followers long, model_version string")
    return base.unionByName(state.corrections(base, change, keep_human=True))


def table(spark, name, *cols):
    return {tuple(r) for r in aggregates.build(stream(spark), name).select(*cols).collect()}


def test_aggregates_after_a_correction(spark):
    posts = {r.sentiment: r.n for r in aggregates.build(stream(spark), "agg_topic_1h").groupBy("sentiment").agg(F.sum("posts").alias("n")).collect()}
    assert posts == {"negative": 0, "neutral": 1, "positive": 2}
    day = aggregates.build(stream(spark), "agg_topic_1d").agg(F.sum("engagement_known_posts"), F.sum("engagement")).first()
    assert tuple(day) == (2, 20)
    assert table(spark, "agg_hashtag_1d", "hashtag", "sentiment", "posts") == {("citydemo", "negative", 0), ("citydemo", "positive", 2)}
    sums = analytics.top_accounts(analytics.Tables(stream(spark)), F1, "engagement").select("author_id", "posts", "replies", "reposts", "followers").collect()
    assert {tuple(r) for r in sums} == {("a1", 1, 1, 0, 150), ("a2", 0, 0, 1, 100)}
    assert {("negative", 0), ("positive", 1)} <= table(spark, "agg_author_1d", "sentiment", "posts") and table(spark, "agg_issue_1h", "issue", "sentiment", "mentions") == {("town hall", "negative", 0), ("town hall", "positive", 1)}
    assert table(spark, "agg_reposted_author_1d", "parent_author_id", "reposts", "handle") == {("orig", 1, "Origin")}
    assert table(spark, "agg_geo_1d", "region", "posts") == {("", 2), ("31", 1)}
    assert ("male", "positive", 2) in table(spark, "agg_psycho_gender_1d", "author_gender", "sentiment", "posts")
    net = aggregates.media_items(stream(spark)).groupBy("post_id").agg(F.sum("sign").alias("n")).collect()
    assert [(r.post_id, r.n) for r in net] == [("p1", 1)]
    assert {r.post_id: r.sentiment for r in state.topic_matches(stream(spark)).collect()}["p1"] == "positive"


def test_authors_sketch(spark):
    rows = aggregates.build(stream(spark), "agg_topic_uniq_1h")
    assert rows.agg(F.hll_sketch_estimate(F.hll_union_agg("authors"))).first()[0] == 2


def test_authors_are_counted_exactly(spark):
    e = stream(spark).filter("sign = 1").limit(1).drop("author_id", "author_created_year").crossJoin(spark.range(20_000).selectExpr("concat('a', id) as author_id", "cast(2020 as int) as author_created_year"))
    for name in aggregates.AUTHORS_OF:
        assert [r.authors for r in aggregates.distinct_authors(e.unionByName(e), name).collect()] == [20_000]


def test_parts_add_up_to_the_whole(spark):
    e = stream(spark)
    for name in ("agg_topic_5m", "agg_issue_1h", "agg_emotion_1h", "agg_psycho_age_1d", "agg_author_1d", "agg_reposted_author_1d"):
        parts = aggregates.parts(e.filter("seq = 0"), name).unionByName(aggregates.parts(e.filter("seq <> 0"), name))
        merged = aggregates.finished(aggregates.merge(parts, name), name)
        assert merged.exceptAll(aggregates.build(e, name).select(*merged.columns)).count() == 0


def test_human_labels_stay(spark):
    e = stream(spark)
    change = e.filter("post_id = 'p1' and seq = 0").select(*state.MATCH_KEY).withColumns({"at": F.lit(datetime(2026, 9, 28)), "sentiment": F.lit("neutral"), "model_version": F.lit("sent-v2")})
    assert state.corrections(e, change, keep_human=True).count() == 0
    assert state.corrections(e, change, keep_human=False).count() == 2


def test_proportions_round_up_at_the_half(spark):
    rows = [{"post_id": f"n{i}"} for i in range(2)] + [{"post_id": "p", "sentiment": "positive"}]
    got = {r.sentiment: (r["count"], r.pct) for r in analytics.sentiment_proportion(analytics.Tables(events(spark, *rows)), F1).collect()}
    assert got == {"negative": (2, 66.67), "positive": (1, 33.33)}
    assert spark.range(1).select(analytics.rounded(F.lit(-2.5), 0)).first()[0] == -2


def test_series_are_filled(spark):
    rows = analytics.sentiment_timeline(analytics.Tables(stream(spark)), F1)
    assert rows.count() == 3 * 24
    assert {r.key: r.n for r in rows.groupBy("key").agg(F.sum("n").alias("n")).collect()} == {"negative": 0, "neutral": 1, "positive": 2}


def test_feed_takes_the_newest_row_before_it_filters(spark):
    e = stream(spark)
    assert analytics.feed_count(e, F1, analytics.Feed(sentiment="negative")).first().n == 0
    assert analytics.feed_count(e, F1, analytics.Feed(hashtag="#CITYDEMO")).first().n == 2
    assert analytics.feed_count(e, F1, analytics.Feed(content="reposts", region="31")).first().n == 1
    assert analytics.feed_count(e, analytics.Filter("B", "T", F1.start, F1.end)).first().n == 0


def hourly(spark, rows):
    return spark.createDataFrame([("A", "T", *r) for r in rows], "tenant_id string, topic_id string, bucket timestamp, sentiment string, posts long")


@pytest.mark.parametrize("posts, negative, fires", [(100, 62, True), (10, 9, False), (100, 40, False)])
def test_negative_ratio(spark, posts, negative, fires):
    now = datetime(2026, 1, 2, 12, 30)
    rows = hourly(spark, [(datetime(2026, 1, 2, 11), "negative", negative), (datetime(2026, 1, 2, 12), "neutral", posts - negative)])
    got = ops.negative_ratio(rows, F.lit(now), threshold=60).collect()
    assert [r.negative_pct for r in got] == ([62.0] if fires else [])


@pytest.mark.parametrize("now_posts, before, factor", [(45, 1680, 4.5), (25, 1680, None), (35, 2016, None)])
def test_volume_spike(spark, now_posts, before, factor):
    rows = hourly(spark, [(datetime(2026, 1, 8, 12), "neutral", now_posts), (datetime(2026, 1, 5, 12), "neutral", before)])
    got = ops.volume_spike(rows, F.lit(datetime(2026, 1, 8, 12, 30))).collect()
    assert [r.factor for r in got] == ([factor] if factor else [])


def test_cost_split(spark):
    runs = spark.createDataFrame([("r", 4.0, 42.0, 0.4), ("e", 1.0, 0.0, 1.0)], "run_id string, requests double, results double, cost double")
    weights = spark.createDataFrame([("r", "A", 30), ("r", "B", 10), ("r", "C", 0), ("e", "A", 0), ("e", "B", 0), ("e", "C", 0)], "run_id string, tenant_id string, matches long")
    got = {(r.run_id, r.tenant_id): (r.basis, r.requests, r.results, r.cost) for r in ops.allocate(runs, weights, ["requests", "results", "cost"]).collect()}
    assert got.pop(("r", "A")) == ("matches", 3.0, 31.5, 0.3) and got.pop(("r", "B")) == ("matches", 1.0, 10.5, 0.1)
    assert {k: v[3] for k, v in got.items()} == {("e", "A"): 0.333333333, ("e", "B"): 0.333333333, ("e", "C"): 0.333333334}
    assert {v[0] for v in got.values()} == {"even_split"}


@pytest.mark.parametrize("runs, want", [([(0, 60, None)], 300), ([(0, 60, None), (0, 60, None)], 5), ([(60, 30, None), (60, 30, None)], 180), ([(5, 30, 5), (0, 3000, 5)], 20), ([(3, 30, 5), (0, 3000, 5)], 5), ([(0, 0, None), (9, 60, None)], 300)])
def test_adaptive_items(spark, runs, want):
    rows = spark.createDataFrame([("k", i, *r) for i, r in enumerate(runs)], "plan string, at int, items_new int, window_min int, max_items int")
    assert ops.adaptive_most(rows, ["plan"], F.asc("at"), 1800).first().max_items == want


def test_percentiles_take_the_floor_index(spark):
    rows = spark.createDataFrame([("k", v) for v in [10, 20, 30, 40]] + [("one", 7), ("ties", 1), ("ties", 1), ("ties", 2)], "k string, v int")
    got = {r.k: (r.n, r.p50, r.p95) for r in ops.percentiles(rows, "v", ["k"], [50, 95]).collect()}
    assert got == {"k": (4, 30, 40), "one": (1, 7, 7), "ties": (3, 1, 2)}


def test_health_labels(spark):
    rows = [("good", "success", 10)] * 10 + [("slow", "success", 800)] * 10 + [("bad", "success", 10)] * 3 + [("bad", "failed", 10)] * 7 + [("none", None, None)] + [("down", "failed", 5)]
    got = {r.k: (r.score, r.label) for r in ops.health(spark.createDataFrame(rows, "k string, status string, latency int"), ["k"], 200.0).collect()}
    assert got == {"good": (100, "healthy"), "slow": (50, "degraded"), "bad": (30, "unhealthy"), "none": (None, "unknown"), "down": (0, "unhealthy")}


def test_accounts_of_two_platforms_stay_apart(spark):
    rows = events(spark, {"post_id": "1"}, {"post_id": "2", "platform": "y"}, {"post_id": "3", "platform": "y", "sentiment": "positive"})
    got = analytics.top_accounts(analytics.Tables(rows), F1)
    assert {(r.platform, r.author_id, r.posts) for r in got.collect()} == {("x", "a1", 1), ("y", "a1", 2)}
    assert {(r.platform, r.posts) for r in analytics.top_accounts(analytics.Tables(rows), F1, sentiment="positive").collect()} == {("y", 1)}


POSTS = "platform string, post_id string, version int, text string, lang string, media string, author_name string, author_followers long, url string"


def test_gallery_shows_the_newest_version(spark):
    gif = '[{"type":"gif","url":"https://g","thumb":"http://t"},{"type":"image","url":"http://no"}]'
    posts = spark.createDataFrame([(*p, None, None, None) for p in [("x", "p1", 1, "old", "en", gif), ("x", "p1", 2, "new", "en", "[]"), ("x", "p2", 1, "gif", "en", gif), ("x", "p3", 1, "plain", "en", None)]], POSTS)
    rows = events(spark, {"post_id": "p1"}, {"post_id": "p2", "engagement_known": 0}, {"post_id": "p3"})
    got = analytics.gallery(rows, posts, F1, media="image").collect()
    assert [(r.post_id, r.engagement, r.has_more, [tuple(m) for m in r.media]) for r in got] == [("p2", None, False, [("gif", "https://g", None)])]
    assert analytics.gallery(rows, posts, F1, media="video").count() == 0


def test_exports_are_in_order_and_say_what_is_cut(spark):
    rows = events(spark, *[{"post_id": f"p{i}", "published_at": datetime(2026, 9, 27, i)} for i in range(6)])
    posts = spark.createDataFrame([("x", f"p{i}", 1, str(i), "en", None, f"Name {i}", 7, f"https://s/{i}") for i in range(6)], POSTS)
    snaps = spark.createDataFrame([("x", "p5", datetime(2026, 9, 28), 1, None, 2, 3), ("x", "p5", datetime(2026, 9, 27), 9, 9, 9, 9)], "platform string, post_id string, captured_at timestamp, likes long, comments long, shares long, views long")
    got = analytics.export_rows(rows, posts, snaps, F1, most=4).collect()
    assert [(r.place, r.post_id, r.truncated) for r in got] == [(i + 1, f"p{5 - i}", True) for i in range(4)]
    assert (got[0].likes, got[0].comments, got[0].shares) == (1, 9, 2)  # each metric's newest known value
    assert (got[0].author_name, got[0].author_followers, got[0].url) == ("Name 5", 7, "https://s/5")
    assert not analytics.export_rows(rows, posts, snaps, F1).first().truncated


def test_a_refresh_writes_followers_on_both_rows(spark):
    rows = events(spark, {"post_id": "p1"}, {"post_id": "p2"}, {"post_id": "p3"})
    snaps = spark.createDataFrame(
        [("x", "p1", datetime(2026, 9, 28), 12, 150), ("x", "p2", datetime(2026, 9, 28), None, 150), ("x", "p3", datetime(2026, 9, 28), 10, 100)], "platform string, post_id string, captured_at timestamp, likes long, author_followers long"
    ).selectExpr("*", *[f"cast(null as bigint) as {c}" for c in ("comments", "shares", "quotes", "saves")])
    got = {(r.post_id, r.sign, r.engagement, r.author_followers) for r in state.refreshed(rows, snaps).collect()}
    assert got == {("p1", -1, 10, 150), ("p1", 1, 12, 150), ("p2", -1, 10, 150), ("p2", 1, 10, 150)}


def test_stored_aggregates(spark, tmp_path):
    e = stream(spark)
    aggregates.write(e.filter("seq = 0"), str(tmp_path), part="a")
    aggregates.write(e.filter("seq <> 0"), str(tmp_path), part="b")
    aggregates.write(e.filter("seq <> 0"), str(tmp_path), part="b")
    stored, built = analytics.Tables(e, str(tmp_path)), analytics.Tables(e)
    for name in aggregates.TABLES:
        a, b = stored.read(name, F1), built.read(name, F1)
        if "authors" in b.columns:
            a, b = a.withColumn("authors", F.hll_sketch_estimate("authors")), b.withColumn("authors", F.hll_sketch_estimate("authors"))
        assert a.select(*b.columns).exceptAll(b).count() == b.exceptAll(a.select(*b.columns)).count() == 0
    plan = stored.read("agg_topic_1h", F1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "tenant_id" in plan.split("PushedFilters")[1][:120]
    raw = built.read("agg_topic_1h", F1)._jdf.queryExecution().optimizedPlan().toString()
    assert "published_at" in raw and ">=" in raw


def test_evaluation(spark):
    def rows(*pairs):
        return spark.createDataFrame([(*p, c) for p, c in pairs], "gold string, pred string, confidence double")

    same = rows((("a", "a"), 1.0), (("b", "b"), 1.0))
    assert evalkit.cohen_kappa(same).first().kappa == 1.0
    assert evalkit.cohen_kappa(rows((("a", "b"), 1.0), (("b", "a"), 1.0))).first().kappa == -1.0
    assert evalkit.ece(same).first().ece == 0.0
    assert evalkit.ece(rows((("a", "b"), 0.9))).first().ece == pytest.approx(0.9)
    curve = evalkit.coverage_curve(rows((("a", "a"), 0.9), (("a", "b"), 0.4)), [0.5]).first()
    assert (curve.coverage, curve.accuracy) == (0.5, 1.0)
    three = rows((("a", "a"), 1.0), (("b", "b"), 1.0), (("a", None), 1.0))
    assert (round(evalkit.accuracy(three).first().accuracy, 4), evalkit.accuracy(three).first().missing) == (0.6667, 1)


def test_gazetteer(spark):
    regions = spark.createDataFrame([("31", "DKI Jakarta", ["Jakarta"]), ("32", "Jawa Barat", ["Jabar", "Bandung"]), ("91", "Papua", ["kota x"]), ("92", "Papua Barat", ["kota x"])], "code string, name string, aliases array<string>")
    rows = [(1, "Jakarta", None), (2, None, "JABAR"), (3, None, "I moved to Bandung in 2011"), (4, None, "Kab. Papua Barat"), (5, None, "bandungan"), (6, None, "kota x"), (7, None, None)]
    got = {r.id: (r.region, r.confidence) for r in enrich.infer_region(spark.createDataFrame(rows, "id long, place string, profile string"), regions, key=["id"], place="place", profile="profile").collect()}
    assert got == {1: ("31", 0.8), 2: ("32", 0.5), 3: ("32", 0.3), 4: ("92", 0.3)}


def test_items_without_required_fields_go(spark, tmp_path):
    lines = [
        '{"platform":"X","id":"1","created_at":"2024-01-01T00:00:00+07:00","author":{"id":"a","handle":"@Budi"},"metrics":{"likes":"3"}}',
        '{"platform":"X","id":"2","created_at":"2024-01-01T00:00:00","author":{"id":"a","handle":"b"}}',
        '{"platform":"X","id":"3","created_at":"1704067200","author":{"id":null,"handle":"b"}}',
        "{broken",
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    raw = items.read_items(spark, str(tmp_path))
    assert raw.filter("_bad is not null").select("id", "_bad").collect()[0]._bad == "{broken"
    (row,) = items.normalized(items.read_items(spark, str(tmp_path))).collect()
    assert (row.post_id, row.author_handle, row.likes, row.comments, row.content_type) == ("1", "budi", 3, None, "post")
    assert str(row.published_at) == "2023-12-31 17:00:00"
