"""Tables that batches bring up to date: kept state, keys of a stream, retention."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import events
from tidemark.operators import aggregates, analytics, kept, state, upkeep
from tidemark.schemas import EVENT, POST
from tidemark.streaming import ingest, keys

F1 = analytics.Filter("A", "T", datetime(2026, 9, 1), datetime(2026, 9, 30))


def files(path):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


SHOWN = ["tenant_id", "topic_id", "platform", "post_id", "sentiment", "engagement", "event_at", "seq"]


def test_batches_in_any_order_leave_the_newest_rows(spark, tmp_path):
    rng = random.Random(1)
    made = [
        {"tenant_id": rng.choice("AB"), "post_id": f"p{rng.randrange(25)}", "seq": s, "sign": -1 if s == 1 else 1, "engagement": rng.randrange(99), "event_at": datetime(2026, 10, 1 + rng.randrange(9), rng.randrange(24), s)}
        for _ in range(60)
        for s in (0, 1, 2)
    ]
    for r in made:  # a post's time never changes
        r["published_at"] = datetime(2026, 7 + int(r["post_id"][1:]) % 3, 3)
    made = list({(r["tenant_id"], r["post_id"], r["event_at"], r["seq"]): r for r in made}.values())
    want = rows_of(state.topic_matches(events(spark, *made)), *SHOWN)
    path = str(tmp_path / "m")
    rng.shuffle(made)
    for i in range(0, len(made), 45):
        kept.upsert(events(spark, *made[i : i + 45]).filter("sign = 1"), path, kept.MATCHES)
    kept.upsert(events(spark, *made[:30]).filter("sign = 1"), path, kept.MATCHES)  # a replay
    current = kept.Current(path, kept.MATCHES, EVENT)
    assert rows_of(current.rows(spark), *SHOWN) == want
    kept.rebuild(events(spark, *made).filter("sign = 1"), path, kept.MATCHES)
    assert rows_of(current.rows(spark), *SHOWN) == want
    kept.upsert(events(spark).filter("sign = 0"), path, kept.MATCHES)  # an empty batch


def test_a_batch_rewrites_its_own_partitions_only(spark, tmp_path):
    path = str(tmp_path / "m")
    kept.upsert(events(spark, *[{"post_id": f"p{i}", "published_at": datetime(2026, 1 + i % 9, 5)} for i in range(40)]), path, kept.MATCHES)
    before = files(path)
    kept.upsert(events(spark, {"post_id": "p3", "published_at": datetime(2026, 4, 5), "event_at": datetime(2027, 1, 1)}), path, kept.MATCHES)
    after = files(path)
    assert len(before.keys() - after.keys()) == 1 and all(after[p] == t for p, t in before.items() if p in after)


def test_feeds_of_kept_tables(spark, tmp_path):
    made = [{"post_id": f"p{i}", "published_at": datetime(2026, 8 + i % 2, 1 + i), "topic_id": "TU"[i % 3 == 0]} for i in range(12)]
    e = events(spark, *made, *[m | {"seq": 2, "sentiment": "positive", "event_at": datetime(2026, 10, 1)} for m in made[::2]])
    posts = spark.createDataFrame([("x", f"p{i}", v, f"text {v}", "en", "a", None, None, None, datetime(2026, 8 + i % 2, 1 + i), None, None, "s") for i in range(12) for v in (1, 2)], POST)
    kept.upsert(e, str(tmp_path / "m"), kept.MATCHES)
    kept.upsert(posts, str(tmp_path / "p"), kept.POSTS)
    now, texts = kept.Current(str(tmp_path / "m"), kept.MATCHES, EVENT), kept.Current(str(tmp_path / "p"), kept.POSTS, POST)
    for what in (analytics.Feed(), analytics.Feed(sentiment="positive")):
        got = analytics.feed(now, texts, F1, what)
        assert got.collect() == analytics.feed(e, posts, F1, what).collect()
        assert analytics.feed_count(now, F1, what).first() == analytics.feed_count(e, F1, what).first()
    plan = analytics.feed_matches(now, F1, analytics.Feed())._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "topic_part" in plan.split("PartitionFilters")[1][:200] and "ym" in plan.split("PartitionFilters")[1][:200]


def test_stored_accounts_in_parts(spark, tmp_path):
    made = [{"post_id": f"p{i}", "author_handle": f"h{i}", "author_followers": None if i % 2 else i, "event_at": datetime(2026, 9, 27, 12, i), "sentiment": ("negative", "positive")[i % 2]} for i in range(8)]
    e = events(spark, *made)
    for part, rows in enumerate((e.filter("post_id > 'p4'"), e.filter("post_id <= 'p4'"))):
        aggregates.write(rows, str(tmp_path), ["agg_author_1d", "agg_topic_1d"], str(part))
    f = analytics.Filter("A", "T", datetime(2026, 9, 27), datetime(2026, 9, 27, 23))
    stored, built = analytics.Tables(e, str(tmp_path)), analytics.Tables(e)
    assert analytics.top_accounts(stored, f).collect() == analytics.top_accounts(built, f).collect()
    assert {r.sentiment: (r.handle, r.followers) for r in stored.read("agg_author_1d", f).collect()} == {"negative": ("h6", 6), "positive": ("h7", None)}
    plan = analytics.top_accounts(stored, f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "ym" in plan.split("PartitionFilters")[1][:120]


# --- keys of a stream ---


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_levels_hold_every_batch_once(fan):
    for n in range(400):
        blocks = keys.levels(n, fan)
        assert [i for s, b in blocks for i in range(b * fan**s, (b + 1) * fan**s)] == list(range(n))
        assert len(blocks) <= (fan - 1) * 9
        if found := keys.merged_at(n, fan):
            level, parts = found
            assert sorted(i for s, b in parts for i in range(b * fan**s, (b + 1) * fan**s)) == list(range(n - fan**level, n))


def test_two_hundred_batches_need_few_folders():
    assert max(len(keys.levels(n)) for n in range(200)) <= 26


def small_batches(spark, n):
    rng = random.Random(4)
    pool = [{"post_id": f"p{i}", "published_at": datetime(2026, 9, 1 + i % 20, 3)} for i in range(120)]
    return [[rng.choice(pool) for _ in range(6)] for _ in range(n)]


def test_keys_are_merged_and_each_counts_once(spark, tmp_path):
    path, seen = str(tmp_path / "keys"), []
    batches = small_batches(spark, 14)
    for n, rows in enumerate(batches):
        for again in (False, True) if n in (0, 4, 9) else (False,):  # a replay finds what it found before
            fresh = ingest.claimed(events(spark, *rows), n, path, ingest.EVENT_KEY, "published_at", datetime(2026, 10, 1, 0, n), fan=3)
            got = sorted(r.post_id for r in fresh.collect())
            fresh.unpersist()
            assert not again or got == last
            last = got
        seen += got
    assert sorted(seen) == sorted({r["post_id"] for b in batches for r in b})
    assert len(glob.glob(f"{path}/level=*/block=*")) <= 12


def test_keys_are_forgotten_by_when_they_came(spark, tmp_path):
    path, life, old = str(tmp_path / "keys"), timedelta(days=14), {"post_id": "late", "published_at": datetime(2020, 1, 1)}

    def counted(n, now):
        fresh = ingest.claimed(events(spark, old), n, path, ingest.EVENT_KEY, "published_at", now, fan=2, life=life)
        return fresh.count()

    day = datetime(2026, 10, 1)
    assert [counted(0, day), counted(1, day + timedelta(days=13)), counted(2, day + timedelta(days=15)), counted(3, day + timedelta(days=16))] == [1, 0, 1, 0]


def test_a_stream_keeps_state_besides(spark, tmp_path):
    batches = small_batches(spark, 5)
    for b in batches:
        events(spark, *b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), events(spark).schema, files_per_batch=1)
    path = str(tmp_path / "m")
    ingest.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"), key=ingest.EVENT_KEY, also=[lambda b: kept.upsert(b.filter("sign = 1"), path, kept.MATCHES)])
    posts = {r["post_id"] for b in batches for r in b}
    assert sorted(r.post_id for r in kept.Current(path, kept.MATCHES, EVENT).rows(spark).collect()) == sorted(posts)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(posts)


def test_of_equal_keys_the_same_row_stays(spark):
    rows = events(spark, {"post_id": "a", "engagement": 5}, {"post_id": "a", "engagement": 3}, {"post_id": "b", "issues": ["z"]}, {"post_id": "b", "issues": ["y"]})
    got = {(r.post_id, r.engagement, tuple(r.issues)) for r in ingest.once_each(rows, ingest.EVENT_KEY).collect()}
    assert got == {("a", 3, ()), ("b", 10, ("y",))}


# --- retention ---

ROW = "tenant_id string, n int, published_at timestamp"
NOW = datetime(2026, 10, 15, 12)


def monthly(spark, path, rows):
    df = spark.createDataFrame(rows, ROW).withColumn("ym", F.date_format("published_at", "yyyyMM").cast("int"))
    df.write.partitionBy("ym").parquet(path)


@pytest.mark.parametrize("days", [35, 180, 400])
def test_only_border_months_are_rewritten(spark, tmp_path, days):
    path = str(tmp_path / "t")
    times = [NOW - timedelta(days=d, hours=1) for d in range(0, 500, 3)]
    monthly(spark, path, [("A", i, t) for i, t in enumerate(times)])
    before = files(path)
    limit = NOW - timedelta(days=days)
    done = upkeep.purge_table(spark, path, ["ym"], ROW, "published_at", NOW, most_days=days)
    assert sorted(r.n for r in spark.read.schema(f"{ROW}, ym int").parquet(path).collect()) == [i for i, t in enumerate(times) if t >= limit]
    assert done["rewritten"] == [limit.strftime("%Y%m")]
    assert sorted(done["dropped"]) == sorted({t.strftime("%Y%m") for t in times if t.strftime("%Y%m") < limit.strftime("%Y%m")})
    after = files(path)
    newer = {p for p in before if int(p.split("ym=")[1][:6]) > int(limit.strftime("%Y%m"))}
    assert newer and all(after[p] == before[p] for p in newer)
    again = files(path)
    assert upkeep.purge_table(spark, path, ["ym"], ROW, "published_at", NOW, most_days=days) == {"dropped": [], "rewritten": []} and files(path) == again


def test_tenants_have_their_own_days(spark, tmp_path):
    path = str(tmp_path / "t")
    ages = [1, 29, 31, 59, 61, 100, 399, 401]
    monthly(spark, path, [(t, d, NOW - timedelta(days=d)) for t in "ABC" for d in ages])
    tenants = spark.createDataFrame([("A", 5), ("B", 60)], "tenant_id string, days int")
    upkeep.purge_table(spark, path, ["ym"], ROW, "published_at", NOW, tenants=tenants)
    left = {}
    for r in spark.read.schema(f"{ROW}, ym int").parquet(path).collect():
        left.setdefault(r.tenant_id, []).append(r.n)
    assert {t: sorted(v) for t, v in left.items()} == {"A": [1, 29], "B": [1, 29, 31, 59], "C": ages}
    assert upkeep.purge_table(spark, path, ["ym"], ROW, "published_at", NOW) == {"dropped": [], "rewritten": []}


def test_stored_aggregates_lose_old_months(spark, tmp_path):
    e = events(spark, *[{"post_id": f"p{i}", "published_at": NOW - timedelta(days=20 * i)} for i in range(6)])
    for part in ("0", "1"):
        aggregates.write(e, str(tmp_path), ["agg_topic_5m"], part)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aggregates.parts(e, "agg_topic_5m").schema)
    done = upkeep.purge_table(spark, f"{tmp_path}/agg_topic_5m", ["part", "ym"], schema, "bucket", NOW, most_days=upkeep.TABLE_DAYS["agg_topic_5m"])
    f = analytics.Filter("A", "T", NOW - timedelta(days=150), NOW)
    assert analytics.Tables(e, str(tmp_path)).read("agg_topic_5m", f).agg(F.sum("posts")).first()[0] == 4  # two posts, written by both parts
    assert set(done["dropped"]) == {"202607", "202608"} and {r.split("/")[1] for r in done["rewritten"]} == {"202609"} if done["rewritten"] else True


def test_posts_without_matches_go(spark, tmp_path):
    path = str(tmp_path / "p")
    ages = {"new": 3, "never": 31, "once": 399, "gone": 401, "now": 900}
    posts = spark.createDataFrame([("x", k, 1, k, "en", "a", None, None, None, NOW - timedelta(days=d), None, None, "s") for k, d in ages.items()], POST)
    kept.upsert(posts, path, kept.POSTS)
    keyed = lambda *ids: spark.createDataFrame([("x", i) for i in ids], "platform string, post_id string")
    upkeep.purge_posts(spark, path, kept.POSTS.parts, POST, NOW, keyed("once", "gone", "now"), keyed("now"))
    assert sorted(r.post_id for r in kept.Current(path, kept.POSTS, POST).rows(spark).collect()) == ["new", "now", "once"]
