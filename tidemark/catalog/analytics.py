"""The analytics queries, for one tenant and topic as the domain asks for."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.book import Book
from tidemark.catalog.state import AGG_SQL
from tidemark.operators import aggregates, kept
from tidemark.operators import analytics as A
from tidemark.schemas import EMOTIONS, EVENT, POST, REPLIES, SENTIMENTS
from tidemark.sources.crosswalk import EVENTS_SQL, POSTS_SQL, SNAPSHOTS_SQL, STATE_SQL, match_events, posts, snapshots
from tidemark.sources.store import fresh_path, table

BOOK = Book()
DAYS = A.Filter("t1", "q1", datetime(2024, 1, 15, 6, 30), datetime(2024, 1, 25, 12, 30))
EARLY = A.Filter("t1", "q1", datetime(2024, 1, 1), datetime(2024, 1, 8, 12, 30))  # when posts have texts
HOURS = A.Filter("t1", "q1", datetime(2024, 1, 10, 6, 30), datetime(2024, 1, 12, 12, 30), ("click", "view", "purchase"))


def scope(f: A.Filter) -> str:
    platforms = f" AND platform IN ({', '.join(repr(p) for p in f.platforms)})" if f.platforms else ""
    return f"tenant_id = '{f.tenant}' AND topic_id = '{f.topic}'{platforms}"


def within(f: A.Filter, column: str, daily: bool) -> str:
    return f"{column} BETWEEN DATE '{f.start.date()}' AND DATE '{f.end.date()}'" if daily else f"{column} BETWEEN TIMESTAMP '{f.start}' AND TIMESTAMP '{f.end}'"


def read(name: str, f: A.Filter) -> str:
    return f"(SELECT * FROM ({AGG_SQL[name]}) WHERE {scope(f)} AND {within(f, 'bucket', name.endswith('_1d'))})"


def spine(f: A.Filter, grain: str) -> str:
    if grain == "1h":
        first = f.start.replace(minute=0, second=0)
        return f"(SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{f.end}', INTERVAL 1 HOUR)) AS bucket)"
    return f"(SELECT unnest(generate_series(DATE '{f.start.date()}', DATE '{f.end.date()}', INTERVAL 1 DAY))::DATE AS bucket)"


def series(rows: str, f: A.Filter, grain: str, keys: list[str] | None = None) -> str:
    names = f"(SELECT unnest({keys}) AS key)" if keys else "(SELECT DISTINCT key FROM r WHERE n <> 0)"
    return f"WITH {EVENTS_SQL}, r AS ({rows}) SELECT key, bucket::VARCHAR AS bucket, coalesce(n, 0)::BIGINT AS n FROM {spine(f, grain)} s CROSS JOIN {names} k LEFT JOIN (SELECT * FROM r WHERE n <> 0) r USING (key, bucket)"


def tabled(work, f):
    return lambda s, d: work(A.Tables(match_events(s, d)), f)


def e(sql: str) -> str:
    return f"WITH {EVENTS_SQL} {sql}"


def up(x: str, places: int) -> str:
    return f"floor(({x}) * {10**places} + 0.5) / {10**places}"


for _name, _f, _g in (("", DAYS, "1d"), ("_hourly", HOURS, "1h")):
    for _mode in ("posts", "engagement"):
        BOOK.add(f"exposure_{_mode}{_name}", tabled(lambda t, f, m=_mode: A.exposure(t, f, m), _f), series(f"SELECT platform AS key, bucket, sum({_mode}) AS n FROM {read(f'agg_topic_{_g}', _f)} GROUP BY ALL", _f, _g))
    BOOK.add(f"emotion_timeline{_name}", tabled(A.emotion_timeline, _f), series(f"SELECT emotion AS key, bucket, sum(posts) AS n FROM {read(f'agg_emotion_{_g}', _f)} WHERE emotion <> 'unknown' GROUP BY ALL", _f, _g, EMOTIONS))
    BOOK.add(f"sentiment_timeline{_name}", tabled(A.sentiment_timeline, _f), series(f"SELECT sentiment AS key, bucket, sum(posts) AS n FROM {read(f'agg_topic_{_g}', _f)} GROUP BY ALL", _f, _g, SENTIMENTS))

BOOK.add("active_accounts", tabled(A.active_accounts, DAYS), series(f"SELECT 'accounts' AS key, bucket, count(DISTINCT author_id) AS n FROM (SELECT author_id, bucket, sum(posts + replies + reposts) AS c FROM {read('agg_author_1d', DAYS)} GROUP BY ALL HAVING c <> 0) GROUP BY ALL", DAYS, "1d", ["accounts"]))
BREAKDOWN = f"SELECT platform, content_type, sum(posts)::BIGINT AS count, sum(engagement)::BIGINT AS engagement FROM {read('agg_topic_1d', DAYS)} GROUP BY ALL HAVING sum(posts) <> 0"
BOOK.add("platform_breakdown", tabled(A.platform_breakdown, DAYS), e(BREAKDOWN))
BOOK.add("per_platform", tabled(lambda t, f: A.per_platform(t, f, REPLIES), DAYS), e(f"SELECT platform, sum(count)::BIGINT AS count FROM ({BREAKDOWN}) WHERE content_type IN ('reply', 'comment') GROUP BY platform"))
BOOK.add(
    "avg_engagement",
    tabled(A.average_engagement, DAYS),
    e(f"SELECT sum(count)::BIGINT AS posts, sum(engagement)::BIGINT AS engagement, coalesce(sum(count) FILTER (content_type IN ('reply', 'comment')), 0)::BIGINT AS replies, coalesce(sum(count) FILTER (content_type IN ('repost', 'quote')), 0)::BIGINT AS reposts, floor(sum(engagement) / sum(count) + 0.5)::BIGINT AS average FROM ({BREAKDOWN})"),
)
BOOK.add("reposted_accounts", tabled(A.reposted_accounts, DAYS), e(f"SELECT platform, parent_author_id, sum(reposts)::BIGINT AS reposts, arg_max(handle, {{'b': bucket, 'v': handle}}) FILTER (handle IS NOT NULL) AS handle FROM {read('agg_reposted_author_1d', DAYS)} GROUP BY platform, parent_author_id HAVING sum(reposts) > 0 ORDER BY reposts DESC, platform, parent_author_id LIMIT 20"))
BOOK.add("activity_heatmap", tabled(A.activity_heatmap, DAYS), e(f"SELECT isodow(bucket + INTERVAL 7 HOUR)::INT AS dow, hour(bucket + INTERVAL 7 HOUR)::INT AS hour, sum(posts)::BIGINT AS n FROM {read('agg_topic_1h', DAYS)} GROUP BY ALL HAVING sum(posts) <> 0"))
BOOK.add("author_created_year_exact", tabled(lambda t, f: A.author_created_year(t, f, exact=True), HOURS), e(f"SELECT coalesce(author_created_year::VARCHAR, 'unknown') AS year, count(DISTINCT author_id)::BIGINT AS authors FROM e WHERE tenant_id = 't1' AND topic_id = 'q1' AND sign = 1 AND {within(HOURS, 'published_at', False)} GROUP BY ALL"))
BOOK.add("author_created_year", tabled(A.author_created_year, DAYS), e(f"SELECT coalesce(author_created_year::VARCHAR, 'unknown') AS year, count(DISTINCT author_id)::BIGINT AS authors FROM e WHERE tenant_id = 't1' AND topic_id = 'q1' AND sign = 1 AND {within(DAYS, 'published_at::DATE', True)} GROUP BY ALL"))
for _name, _key in (("sentiment_proportion", "sentiment"), ("emotion_proportion", "emotion")):
    _table = "agg_topic_1d" if _key == "sentiment" else "agg_emotion_1d"
    BOOK.add(_name, tabled(getattr(A, _name), DAYS), e(f"SELECT {_key}, n::BIGINT AS count, {up('n * 100 / sum(n) OVER ()', 2)} AS pct FROM (SELECT {_key}, sum(posts) AS n FROM {read(_table, DAYS)} GROUP BY ALL) WHERE n <> 0"))
BOOK.add("model_versions", tabled(A.model_versions, DAYS), e(f"SELECT DISTINCT model_version FROM e WHERE {scope(DAYS)} AND sign = 1 AND {within(DAYS, 'published_at', False)} ORDER BY 1 LIMIT 10"))
for _s in (None, "negative"):
    _where = f"WHERE sentiment = '{_s}'" if _s else ""
    BOOK.add(f"hashtags{'_' + _s if _s else ''}", tabled(lambda t, f, s=_s: A.hashtags(t, f, 5, s), DAYS), e(f"SELECT hashtag, sum(posts)::BIGINT AS count, sum(engagement)::BIGINT AS engagement FROM {read('agg_hashtag_1d', DAYS)} {_where} GROUP BY ALL HAVING sum(posts) > 0 ORDER BY count DESC, hashtag LIMIT 5"))
ISSUES = f"SELECT issue, sum(mentions)::BIGINT AS count, sum(engagement)::BIGINT AS engagement FROM {read('agg_issue_1h', DAYS)} GROUP BY ALL HAVING sum(mentions) > 0"
BOOK.add("issues", tabled(lambda t, f: A.issues(t, f, 8), DAYS), e(f"{ISSUES} ORDER BY count DESC, issue LIMIT 8"))
BOOK.add("issues_by_engagement", tabled(lambda t, f: A.issues(t, f, 8, "engagement"), DAYS), e(f"{ISSUES} ORDER BY engagement DESC, count DESC, issue LIMIT 8"))
BOOK.add(
    "issue_delta",
    tabled(lambda t, f: A.issue_delta(t, f, 8), DAYS),
    e(f", cur AS ({ISSUES} ORDER BY count DESC, issue LIMIT 8), prev AS (SELECT issue, sum(mentions) AS n FROM {read('agg_issue_1h', DAYS.previous())} GROUP BY ALL) SELECT issue, count, coalesce(n, 0)::BIGINT AS previous, CASE WHEN n > 0 THEN floor((count - n) * 100 / n + 0.5) END AS change_pct FROM cur LEFT JOIN prev USING (issue)"),
)
NEWEST_OF = "arg_max({c}, {{'b': bucket, 'v': {c}}}) FILTER ({c} IS NOT NULL) AS {c}"
for _by, _s in (("posts", None), ("engagement", None), ("posts", "negative")):
    _where = f"WHERE sentiment = '{_s}'" if _s else ""
    BOOK.add(
        f"top_accounts_{_by}{'_' + _s if _s else ''}",
        tabled(lambda t, f, b=_by, s=_s: A.top_accounts(t, f, b, 10, s), DAYS),
        e(f"SELECT platform, author_id, sum(posts)::BIGINT AS posts, sum(replies)::BIGINT AS replies, sum(reposts)::BIGINT AS reposts, sum(engagement)::BIGINT AS engagement, {NEWEST_OF.format(c='handle')}, {NEWEST_OF.format(c='followers')} FROM {read('agg_author_1d', DAYS)} {_where} GROUP BY platform, author_id HAVING sum({_by}) > 0 ORDER BY {_by} DESC, platform, author_id LIMIT 10"),
    )
BOOK.add("issues_negative", tabled(lambda t, f: A.issues(t, f, 8, sentiment="negative"), DAYS), e(f"SELECT issue, sum(mentions)::BIGINT AS count, sum(engagement)::BIGINT AS engagement FROM {read('agg_issue_1h', DAYS)} WHERE sentiment = 'negative' GROUP BY ALL HAVING sum(mentions) > 0 ORDER BY count DESC, issue LIMIT 8"))


def stored(spark, sf_dir, work, f, names):
    """The same over stored tables, written in two parts, corrections in both and before what they correct."""
    events, path = match_events(spark, sf_dir), fresh_path(spark, "aggregates")
    for part in ("0", "1"):
        aggregates.write(events.filter(F.pmod(F.crc32("post_id") + F.col("seq"), F.lit(2)) == int(part)), path, names, part)
    return work(A.Tables(events, path), f)


def locations(spark, sf_dir):
    names = table(spark, sf_dir, "nation").selectExpr("concat('r', n_nationkey) as region", "n_name as name")
    return A.locations(A.Tables(match_events(spark, sf_dir)), DAYS, names)


BOOK.add("locations", locations, e(f", g AS (SELECT region, sum(posts) AS n, sum(engagement) AS g FROM {read('agg_geo_1d', DAYS)} GROUP BY ALL HAVING n <> 0) SELECT region, n::BIGINT AS count, g::BIGINT AS engagement, {up('(SELECT sum(n) FILTER (region <> ' + repr('') + ') * 100 / sum(n) FROM g)', 1)} AS coverage_pct, n_name AS name FROM g LEFT JOIN nation ON region = 'r' || n_nationkey WHERE region <> ''"))


def summary_sql() -> str:
    def one(f: A.Filter, name: str) -> str:
        return f"SELECT '{name}' AS period, sum(posts)::BIGINT AS posts, sum(engagement)::BIGINT AS engagement, sum(posts) FILTER (sentiment = 'negative')::BIGINT AS negative, sum(posts) FILTER (sentiment = 'positive')::BIGINT AS positive, (SELECT count(DISTINCT author_id) FROM (SELECT platform, author_id, bucket FROM {read('agg_author_1d', f)} GROUP BY ALL HAVING sum(posts) <> 0)) AS authors FROM {read('agg_topic_1d', f)}"

    deltas = ", ".join(f"CASE WHEN period = 'current' THEN {up(f'({c} - lag({c}) OVER w) * 100 / lag({c}) OVER w', 1)} END AS {c}_delta_pct" for c in ("posts", "engagement", "authors"))
    return e(f"SELECT *, {deltas} FROM ({one(DAYS, 'current')} UNION ALL {one(DAYS.previous(), 'previous')}) WINDOW w AS (ORDER BY period DESC)")


BOOK.add("summary", tabled(A.summary, DAYS), summary_sql())
for _name, _work, _f, _tables in (
    ("exposure_posts", A.exposure, DAYS, ["agg_topic_1d"]),
    ("sentiment_timeline_hourly", A.sentiment_timeline, HOURS, ["agg_topic_1h"]),
    ("platform_breakdown", A.platform_breakdown, DAYS, ["agg_topic_1d"]),
    ("top_accounts_posts", lambda t, f: A.top_accounts(t, f, "posts", 10), DAYS, ["agg_author_1d"]),
    ("top_accounts_posts_negative", lambda t, f: A.top_accounts(t, f, "posts", 10, "negative"), DAYS, ["agg_author_1d"]),
    ("active_accounts", A.active_accounts, DAYS, ["agg_author_1d"]),
    ("reposted_accounts", A.reposted_accounts, DAYS, ["agg_reposted_author_1d"]),
    ("summary", A.summary, DAYS, ["agg_topic_1d", "agg_author_1d"]),
):
    BOOK.add(f"stored_{_name}", lambda s, d, w=_work, f=_f, n=_tables: stored(s, d, w, f, n), BOOK.oracles[_name])


def psycho_sql(name: str, column: str) -> str:
    return f"SELECT key, negative, neutral, positive, n::BIGINT AS count, {up('sum(n) FILTER (key <> ' + repr('unknown') + ') OVER () * 100 / sum(n) OVER ()', 1)} AS coverage_pct, {up('n * 100 / sum(n) FILTER (key <> ' + repr('unknown') + ') OVER ()', 1)} AS pct, '{column}' AS \"group\" FROM (SELECT {column} AS key, {', '.join(f'coalesce(sum(posts) FILTER (sentiment = {s!r}), 0)::BIGINT AS {s}' for s in SENTIMENTS)}, sum(posts) AS n FROM {read(name, DAYS)} GROUP BY ALL) QUALIFY key <> 'unknown'"


BOOK.add("psychography", tabled(A.psychography, DAYS), e(f"SELECT * FROM ({psycho_sql('agg_psycho_gender_1d', 'author_gender')}) UNION ALL SELECT * FROM ({psycho_sql('agg_psycho_age_1d', 'author_age_range')})"))

# feeds: scope, then the newest row of each match, then every other filter
FM = f"WITH {EVENTS_SQL}, {STATE_SQL}, {POSTS_SQL}, {SNAPSHOTS_SQL}, fm AS (SELECT * FROM m WHERE {scope(EARLY)} AND {within(EARLY, 'published_at', False)})"
FEEDS = {
    "feed": (A.Feed(), "true"),
    "feed_negative": (A.Feed(sentiment="negative"), "sentiment = 'negative'"),
    "feed_drill": (A.Feed(hashtag="#TAG3", region="r3"), "len(list_filter(hashtags, lambda h: lower(h) = 'tag3')) > 0 AND geo_region_code = 'r3'"),
    "feed_issue": (A.Feed(issue="iss3", emotion="anger"), "list_contains(issues, 'iss3') AND emotion = 'anger'"),
    "feed_replies": (A.Feed(content="replies"), "content_type IN ('reply', 'comment')"),
}
for _name, (_feed, _where) in FEEDS.items():
    for _sort, _order in (("latest", "published_at DESC"), ("engagement", "engagement DESC, published_at DESC")):
        BOOK.add(
            f"{_name}_{_sort}",
            lambda s, d, w=_feed, o=_sort: A.feed(match_events(s, d), posts(s, d), EARLY, w, o, 20, 5),
            f"{FM}, page AS (SELECT *, row_number() OVER (ORDER BY {_order}, platform, post_id)::INT AS place FROM fm WHERE {_where}) SELECT place, page.platform, page.post_id, page.published_at::VARCHAR AS published_at, sentiment, emotion, engagement, author_handle, text, lang FROM page LEFT JOIN pl ON page.platform = pl.platform AND page.post_id = pl.post_id WHERE place BETWEEN 6 AND 25",
        )
    BOOK.add(f"{_name}_count", lambda s, d, w=_feed: A.feed_count(match_events(s, d), EARLY, w), f"{FM} SELECT count(*) AS n FROM fm WHERE {_where}")
GALLERY = {
    "gallery": (A.Feed(), None, "engagement", 3, 0, "true", "engagement DESC, published_at DESC"),
    "gallery_image": (A.Feed(sentiment="negative"), "image", "latest", 5, 2, "sentiment = 'negative' AND (media LIKE '%\"image\"%' OR media LIKE '%\"gif\"%')", "published_at DESC"),
    "gallery_video": (A.Feed(), "video", "latest", 5, 0, "media LIKE '%\"video\"%'", "published_at DESC"),
}
for _name, (_feed, _media, _sort, _limit, _offset, _where, _order) in GALLERY.items():
    BOOK.add(
        _name,
        lambda s, d, w=_feed, m=_media, o=_sort, n=_limit, k=_offset: A.gallery(match_events(s, d), posts(s, d), EARLY, w, m, o, n, k).withColumn("media", F.to_json("media")),
        f"""{FM}, rows AS (SELECT fm.platform, fm.post_id, fm.published_at, sentiment, engagement, engagement_known, author_handle, substr(text, 1, 280) AS text, pl.media FROM fm JOIN pl ON fm.platform = pl.platform AND fm.post_id = pl.post_id WHERE pl.media IS NOT NULL AND pl.media <> '[]'),
          page AS (SELECT *, row_number() OVER (ORDER BY {_order}, platform, post_id)::INT - {_offset} AS place FROM rows WHERE {_where})
          SELECT place, platform, post_id, published_at::VARCHAR AS published_at, sentiment, CASE WHEN engagement_known = 1 THEN engagement END AS engagement, author_handle, text, CASE WHEN contains(media, 'video') THEN media ELSE '[{{"type":"image","url":"' || regexp_extract(media, 'https://[^"]+') || '"}}]' END AS media,
          (SELECT count(*) > {_limit + _offset} FROM page) AS has_more FROM page WHERE place BETWEEN 1 AND {_limit}""",
    )
for _name, _most in (("export_rows", A.MOST_EXPORTED), ("export_rows_truncated", 7)):
    BOOK.add(
        _name,
        lambda s, d, n=_most: A.export_rows(match_events(s, d), posts(s, d), snapshots(s, d), EARLY, most=n).withColumns({c: F.array_join(c, ",") for c in ("issues", "hashtags")}),
        f"""{FM}, ls AS (SELECT platform, post_id, {", ".join(f"arg_max({c}, captured_at) FILTER ({c} IS NOT NULL) AS {c}" for c in ("likes", "comments", "shares", "views"))} FROM s GROUP BY ALL),
          page AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, platform, post_id)::INT AS place FROM fm)
          SELECT place, (SELECT count(*) > {_most} FROM fm) AS truncated, page.platform, page.post_id, page.published_at::VARCHAR AS published_at, content_type, author_handle, engagement, engagement_known, sentiment, emotion,
          array_to_string(issues, ',') AS issues, array_to_string(hashtags, ',') AS hashtags, text, lang, author_name, pl.author_followers AS author_followers, url, likes, comments, shares, views
          FROM page LEFT JOIN pl ON page.platform = pl.platform AND page.post_id = pl.post_id LEFT JOIN ls ON page.platform = ls.platform AND page.post_id = ls.post_id WHERE place <= {_most}""",
    )


def kept_tables(spark, sf_dir):
    """Matches and posts kept by batches: corrections and late days first, every third row twice."""
    events, every = match_events(spark, sf_dir), posts(spark, sf_dir)
    base = fresh_path(spark, "kept")
    late = F.dayofmonth("published_at") > 20
    for rows in (events.filter((F.col("seq") > 0) | late), events.filter((F.col("seq") == 0) & ~late), events.filter(F.pmod(F.crc32("post_id"), F.lit(3)) == 0)):
        kept.upsert(rows.filter("sign = 1"), f"{base}/matches", kept.MATCHES)
    for version in (2, 1):
        kept.upsert(every.filter(F.col("version") == version), f"{base}/posts", kept.POSTS)
    return kept.Current(f"{base}/matches", kept.MATCHES, EVENT), kept.Current(f"{base}/posts", kept.POSTS, POST)


BOOK.add("kept_matches", lambda s, d: kept_tables(s, d)[0].rows(s).select("tenant_id", "topic_id", "platform", "post_id", "sentiment", "seq"), f"WITH {EVENTS_SQL}, {STATE_SQL} SELECT tenant_id, topic_id, platform, post_id, sentiment, seq FROM m")
BOOK.add("kept_feed_negative_engagement", lambda s, d: A.feed(*kept_tables(s, d), EARLY, FEEDS["feed_negative"][0], "engagement", 20, 5), BOOK.oracles["feed_negative_engagement"])
BOOK.add("kept_gallery", lambda s, d: A.gallery(*kept_tables(s, d), EARLY, A.Feed(), None, "engagement", 3, 0).withColumn("media", F.to_json("media")), BOOK.oracles["gallery"])
BOOK.add("kept_export_rows", lambda s, d: A.export_rows(*kept_tables(s, d), snapshots(s, d), EARLY).withColumns({c: F.array_join(c, ",") for c in ("issues", "hashtags")}), BOOK.oracles["export_rows"])
NEEDLES, TAGS, FROM = ["worthless", "DISGUSTING", "trash"], ["abc"], datetime(2024, 1, 1)
CAND = f"WITH {POSTS_SQL}, h AS (SELECT * FROM p WHERE regexp_matches(lower(text), 'worthless|disgusting|trash') OR list_has_any(list_transform(regexp_extract_all(lower(text), '#([\\p{{L}}\\p{{N}}_]+)', 1), lambda t: replace(t, '_', '')), ['abc']))"
BOOK.add("preview_counts", lambda s, d: A.preview(posts(s, d), NEEDLES, TAGS, FROM)[0], f"{CAND} SELECT platform, count(DISTINCT post_id) AS n FROM h GROUP BY ALL")
BOOK.add("preview_sample", lambda s, d: A.preview(posts(s, d), NEEDLES, TAGS, FROM, 50)[1], f"{CAND} SELECT platform, post_id, arg_max(text, version) AS text, arg_max(lang, version) AS lang, max(published_at)::VARCHAR AS published_at FROM h GROUP BY platform, post_id ORDER BY max(published_at) DESC, platform, post_id LIMIT 50")
BOOK.add("preview_platforms", lambda s, d: A.preview(posts(s, d), NEEDLES, TAGS, FROM, platforms=("click", "view"))[0], f"{CAND} SELECT platform, count(DISTINCT post_id) AS n FROM h WHERE platform IN ('click', 'view') GROUP BY ALL")
BOOK.add(
    "preview_estimate",
    lambda s, d: A.preview_estimate(*A.preview(posts(s, d), NEEDLES, TAGS, FROM, 50), F.col("lang") == "en"),
    f"{CAND}, c AS (SELECT platform, count(DISTINCT post_id) AS n FROM h GROUP BY ALL), s AS (SELECT platform, post_id, arg_max(lang, version) AS lang FROM h GROUP BY platform, post_id ORDER BY max(published_at) DESC, platform, post_id LIMIT 50), k AS (SELECT platform, count(*) AS seen, count(*) FILTER (lang = 'en') AS hits FROM s GROUP BY ALL) SELECT platform, n, coalesce(seen, 0)::BIGINT AS seen, coalesce(hits, 0)::BIGINT AS hits, CASE WHEN seen > 0 THEN {up('n * hits / seen / 7', 1)} ELSE 0.0 END AS per_day FROM c LEFT JOIN k USING (platform)",
)
