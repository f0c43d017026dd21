"""The analytics queries: filters in, small DataFrames out, over the pre-aggregated tables.

Hourly tables compare the bucket with the raw times, daily ones with the dates, both ends included. Ratios are rounded
as ``floor(x * k + 0.5) / k``. Orders have a last key, so that results can be compared.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import lower_each
from tidemark.operators.aggregates import build, read_stored
from tidemark.operators.kept import Current
from tidemark.operators.state import POST_KEY, latest_per_key, topic_matches
from tidemark.schemas import EMOTIONS, REPLIES, REPOSTS, SENTIMENTS, UNKNOWN

#: A series has at most so many buckets.
MOST_BUCKETS = 2000

#: Fixed value: rows of an export; beyond it ``truncated`` is set.
MOST_EXPORTED = 50_000


@dataclass(frozen=True)
class Filter:
    tenant: str
    topic: str
    start: datetime
    end: datetime
    platforms: tuple[str, ...] = ()

    def grain(self) -> str:
        return "1h" if self.end - self.start <= timedelta(days=3) else "1d"

    def previous(self) -> Filter:
        return replace(self, start=self.start - (self.end - self.start), end=self.start - timedelta(seconds=1))

    def scope(self) -> Column:
        """Tenant, topic and platforms; every public entry point applies it."""
        c = (F.col("tenant_id") == self.tenant) & (F.col("topic_id") == self.topic)
        return c & F.col("platform").isin(*self.platforms) if self.platforms else c

    def within(self, column: str, daily: bool) -> Column:
        if daily:
            return F.col(column).between(F.lit(self.start.date()), F.lit(self.end.date()))
        return F.col(column).between(F.lit(self.start), F.lit(self.end))


    def raw(self, daily: bool) -> Column:
        """The times that the buckets within may hold, for the scan of raw events."""
        floor = {"minute": 0, "second": 0, "microsecond": 0} | ({"hour": 0} if daily else {})
        end = self.end.replace(**floor) + (timedelta(days=1) if daily else timedelta(hours=1))
        return (F.col("published_at") >= F.lit(self.start.replace(**floor))) & (F.col("published_at") < F.lit(end))


def rounded(x: Column, places: int) -> Column:
    k = 10**places
    return F.floor(x * k + 0.5) / k


def pct(part: Column, whole: Column, places: int) -> Column:
    return F.when(whole != 0, rounded(part * 100 / whole, places)).otherwise(F.lit(0.0))


class Tables:
    """Aggregate tables of one event stream: stored ones (``aggregates.write``) where a folder is given, else built when asked for."""

    def __init__(self, events: DataFrame, stored: str | None = None):
        self.events, self.stored = events, stored

    def read(self, name: str, f: Filter) -> DataFrame:
        daily = name.endswith("_1d")
        if self.stored:
            rows = read_stored(self.events.sparkSession, self.stored, name, f.start, f.end).filter(f.scope())
        else:
            rows = build(self.events.filter(f.scope() & f.raw(daily)), name)
        return rows.filter(f.within("bucket", daily))


def buckets(f: Filter, grain: str) -> Column:
    """Every bucket from the start's to the end, MOST_BUCKETS at most, as an array."""
    if grain == "1h":
        first = f.start.replace(minute=0, second=0, microsecond=0)
        n = min(int((f.end - first).total_seconds() // 3600), MOST_BUCKETS - 1)
        return F.sequence(F.lit(first), F.lit(first + timedelta(hours=n)), F.expr("interval 1 hour"))
    n = min((f.end.date() - f.start.date()).days, MOST_BUCKETS - 1)
    return F.sequence(F.lit(f.start.date()), F.lit(f.start.date() + timedelta(days=n)), F.expr("interval 1 day"))


def series(rows: DataFrame, f: Filter, grain: str, keys: list[str] | None = None) -> DataFrame:
    """(key, bucket, n) with every bucket of every key; keys are those given, or those that the rows have. The rows are read once."""
    per = rows.filter("n <> 0").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("long")))).alias("known"))  # MOST_BUCKETS at most
    if keys:
        per = rows.sparkSession.createDataFrame([(k,) for k in keys], "key string").join(per, "key", "left")
    each = per.select("key", "known", F.explode(buckets(f, grain)).alias("bucket"))
    return each.select("key", "bucket", F.coalesce(F.try_element_at("known", F.col("bucket")), F.lit(0).cast("long")).alias("n"))


def exposure(t: Tables, f: Filter, mode: str = "posts") -> DataFrame:
    g = f.grain()
    rows = t.read(f"agg_topic_{g}", f).groupBy(F.col("platform").alias("key"), "bucket").agg(F.sum(mode).alias("n"))
    return series(rows, f, g)


def emotion_timeline(t: Tables, f: Filter) -> DataFrame:
    g = f.grain()
    rows = t.read(f"agg_emotion_{g}", f).filter(F.col("emotion") != UNKNOWN).groupBy(F.col("emotion").alias("key"), "bucket").agg(F.sum("posts").alias("n"))
    return series(rows, f, g, EMOTIONS)


def sentiment_timeline(t: Tables, f: Filter) -> DataFrame:
    g = f.grain()
    rows = t.read(f"agg_topic_{g}", f).groupBy(F.col("sentiment").alias("key"), "bucket").agg(F.sum("posts").alias("n"))
    return series(rows, f, g, SENTIMENTS)


def active_accounts(t: Tables, f: Filter) -> DataFrame:
    """Distinct authors of each day whose posts, replies and reposts don't cancel out."""
    own = t.read("agg_author_1d", f).groupBy("author_id", "bucket").agg(F.sum(F.expr("posts + replies + reposts")).alias("c")).filter("c <> 0")
    rows = own.groupBy("bucket").agg(F.count_distinct("author_id").alias("n")).withColumn("key", F.lit("accounts"))
    return series(rows, f, "1d", ["accounts"])


def platform_breakdown(t: Tables, f: Filter) -> DataFrame:
    rows = t.read("agg_topic_1d", f).groupBy("platform", "content_type").agg(F.sum("posts").alias("count"), F.sum("engagement").alias("engagement"))
    return rows.filter(F.col("count") != 0).orderBy(F.desc("count"), "platform", "content_type")


def per_platform(t: Tables, f: Filter, types: list[str]) -> DataFrame:
    rows = platform_breakdown(t, f).filter(F.col("content_type").isin(types))
    return rows.groupBy("platform").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "platform")


def average_engagement(t: Tables, f: Filter) -> DataFrame:
    total = platform_breakdown(t, f).agg(
        F.sum("count").alias("posts"),
        F.sum("engagement").alias("engagement"),
        F.sum(F.when(F.col("content_type").isin(REPLIES), F.col("count")).otherwise(0)).alias("replies"),
        F.sum(F.when(F.col("content_type").isin(REPOSTS), F.col("count")).otherwise(0)).alias("reposts"),
    )
    return total.withColumn("average", F.when(F.col("posts") > 0, F.floor(F.col("engagement") / F.col("posts") + 0.5).cast("long")))


def merged_newest(name: str) -> Column:
    """The value of the newest bucket that has one; within a bucket the largest."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct("bucket", F.col(name).alias("value"))))


def top(rows: DataFrame, by: str, tie: list[str], k: int) -> DataFrame:
    return rows.filter(F.col(by) > 0).orderBy(F.desc(by), *tie).limit(k)


def reposted_accounts(t: Tables, f: Filter, k: int = 20) -> DataFrame:
    rows = t.read("agg_reposted_author_1d", f).groupBy("platform", "parent_author_id").agg(F.sum("reposts").alias("reposts"), merged_newest("handle").alias("handle"))
    return top(rows, "reposts", ["platform", "parent_author_id"], k)


def activity_heatmap(t: Tables, f: Filter, zone: str = "Asia/Jakarta") -> DataFrame:
    """ISO weekday (Monday 1) and hour in a time zone."""
    local = F.from_utc_timestamp("bucket", zone)
    rows = t.read("agg_topic_1h", f).groupBy((F.weekday(local) + 1).alias("dow"), F.hour(local).alias("hour"))
    return rows.agg(F.sum("posts").alias("n")).filter("n <> 0")


def author_created_year(t: Tables, f: Filter, *, exact: bool = False) -> DataFrame:
    """Distinct authors by the year of their account, of whole days or (``exact``) of the very times; 0 is unknown. By design for all platforms."""
    f = replace(f, platforms=())
    year = F.when(F.col("year") == 0, UNKNOWN).otherwise(F.col("year").cast("string")).alias("year")
    if exact:
        rows = t.events.filter(f.scope() & (F.col("sign") == 1)).filter(f.within("published_at", False)).withColumn("year", F.coalesce("author_created_year", F.lit(0)))
        return rows.groupBy("year").agg(F.count_distinct("author_id").alias("authors")).select(year, "authors")
    rows = t.read("agg_author_year_1d", f).groupBy("year").agg(F.count_distinct("author_id").alias("authors"))
    return rows.select(year, "authors")


def proportions(rows: DataFrame, key: str) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy())  # a row per label
    return rows.filter(F.col("count") != 0).withColumn("pct", pct(F.col("count"), total, 2)).select(key, "count", "pct")


def sentiment_proportion(t: Tables, f: Filter) -> DataFrame:
    return proportions(t.read("agg_topic_1d", f).groupBy("sentiment").agg(F.sum("posts").alias("count")), "sentiment")


def emotion_proportion(t: Tables, f: Filter) -> DataFrame:
    return proportions(t.read("agg_emotion_1d", f).groupBy("emotion").agg(F.sum("posts").alias("count")), "emotion")


def model_versions(t: Tables, f: Filter, k: int = 10) -> DataFrame:
    rows = t.events.filter(f.scope() & f.within("published_at", False) & (F.col("sign") == 1))
    return rows.select("model_version").distinct().orderBy("model_version").limit(k)


def hashtags(t: Tables, f: Filter, k: int = 20, sentiment: str | None = None) -> DataFrame:
    rows = of_sentiment(t.read("agg_hashtag_1d", f), sentiment)
    return top(rows.groupBy("hashtag").agg(F.sum("posts").alias("count"), F.sum("engagement").alias("engagement")), "count", ["hashtag"], k)


def of_sentiment(rows: DataFrame, sentiment: str | None) -> DataFrame:
    return rows.filter(F.col("sentiment") == sentiment) if sentiment else rows


def issues(t: Tables, f: Filter, k: int = 20, by: str = "count", sentiment: str | None = None) -> DataFrame:
    rows = of_sentiment(t.read("agg_issue_1h", f), sentiment)
    rows = rows.groupBy("issue").agg(F.sum("mentions").alias("count"), F.sum("engagement").alias("engagement")).filter("count > 0")
    return rows.orderBy(F.desc(by), F.desc("count"), "issue").limit(k)


def issue_delta(t: Tables, f: Filter, k: int = 20) -> DataFrame:
    """This period's top issues against the period of equal length before."""
    before = t.read("agg_issue_1h", f.previous()).groupBy("issue").agg(F.sum("mentions").alias("previous"))
    both = issues(t, f, k).select("issue", "count").join(before, "issue", "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    return both.withColumn("change_pct", F.when(F.col("previous") > 0, rounded((F.col("count") - F.col("previous")) * 100 / F.col("previous"), 0)))


def top_accounts(t: Tables, f: Filter, by: str = "posts", k: int = 20, sentiment: str | None = None) -> DataFrame:
    """Accounts of a platform: the same id on another platform is another account."""
    sums = [F.sum(c).alias(c) for c in ("posts", "replies", "reposts", "engagement")]
    last = [merged_newest(c).alias(c) for c in ("handle", "followers")]
    rows = of_sentiment(t.read("agg_author_1d", f), sentiment)
    return top(rows.groupBy("platform", "author_id").agg(*sums, *last), by, ["platform", "author_id"], k)


def locations(t: Tables, f: Filter, regions: DataFrame | None = None) -> DataFrame:
    rows = t.read("agg_geo_1d", f).groupBy("region").agg(F.sum("posts").alias("count"), F.sum("engagement").alias("engagement")).filter("count <> 0")
    all_rows = Window.partitionBy()  # a row per region
    known = F.sum(F.when(F.col("region") != "", F.col("count")).otherwise(0)).over(all_rows)
    rows = rows.withColumn("coverage_pct", pct(known, F.sum("count").over(all_rows), 1)).filter("region <> ''")
    return rows.join(regions, "region", "left") if regions is not None else rows


def summary(t: Tables, f: Filter) -> DataFrame:
    """This period and the one before in one row each, with the change of this one in per cent. Each table is read once for both."""
    before = f.previous()
    whole = replace(f, start=before.start)
    periods = {"current": f.within("bucket", True), "previous": before.within("bucket", True)}

    def cells(name: str, value: Column) -> list[Column]:
        return [F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long").alias(f"{p}_{name}") for p, cond in periods.items()]

    of = lambda s: F.when(F.col("sentiment") == s, F.col("posts"))
    posts = t.read("agg_topic_1d", whole).agg(*cells("posts", F.col("posts")), *cells("engagement", F.col("engagement")), *cells("negative", of("negative")), *cells("positive", of("positive")))
    # an author's sentiments of a day first come together, so that posts that cancel out don't count
    daily = t.read("agg_author_1d", whole).groupBy("platform", "author_id", "bucket").agg(F.sum("posts").alias("posts")).filter("posts <> 0")
    authors = daily.agg(*[F.count_distinct(F.when(cond, F.col("author_id"))).alias(f"{p}_authors") for p, cond in periods.items()])
    names = ["posts", "engagement", "negative", "positive", "authors"]
    row = posts.crossJoin(authors)  # one row each
    both = row.select(F.explode(F.array(*[F.struct(F.lit(p).alias("period"), *[F.col(f"{p}_{c}").alias(c) for c in names], *[F.col(f"previous_{c}").alias(f"old_{c}") for c in names]) for p in periods])).alias("r")).select("r.*")
    for c in ("posts", "engagement", "authors"):
        old = F.when(F.col("period") == "current", F.col(f"old_{c}"))
        both = both.withColumn(f"{c}_delta_pct", F.when(old != 0, rounded((F.col(c) - old) * 100 / old, 1)))
    return both.drop(*[f"old_{c}" for c in names])


def psychography(t: Tables, f: Filter) -> DataFrame:
    """Shares of the known groups and their sentiments; coverage is known over all."""

    def one(table: str, column: str) -> DataFrame:
        rows = t.read(table, f).groupBy(F.col(column).alias("key"), "sentiment").agg(F.sum("posts").alias("n")).filter("n <> 0")
        wide = rows.groupBy("key").pivot("sentiment", SENTIMENTS).agg(F.sum("n")).na.fill(0, SENTIMENTS)
        wide = wide.withColumn("count", F.expr("negative + neutral + positive"))
        every = Window.partitionBy()  # a row per group
        known = F.sum(F.when(F.col("key") != UNKNOWN, F.col("count")).otherwise(0)).over(every)
        wide = wide.withColumn("coverage_pct", pct(known, F.sum("count").over(every), 1)).withColumn("pct", pct(F.col("count"), known, 1))
        return wide.filter(F.col("key") != UNKNOWN).withColumn("group", F.lit(column))

    return one("agg_psycho_gender_1d", "author_gender").unionByName(one("agg_psycho_age_1d", "author_age_range"))


@dataclass(frozen=True)
class Feed:
    """Optional filters of feeds and exports."""

    sentiment: str | None = None
    emotion: str | None = None
    hashtag: str | None = None
    issue: str | None = None
    author: str | None = None
    region: str | None = None
    content: str | None = None

    def where(self) -> Column:
        groups = {"replies": REPLIES, "reposts": REPOSTS}
        tag = (self.hashtag or "").removeprefix("#").lower()
        conditions = [
            self.sentiment and F.col("sentiment") == self.sentiment,
            self.emotion and F.col("emotion") == self.emotion,
            self.hashtag and F.exists("hashtags", lambda h: F.lower(h) == tag),
            self.issue and F.array_contains("issues", self.issue),
            self.author and F.col("author_id") == self.author,
            self.region and F.col("geo_region_code") == self.region,
            self.content and F.col("content_type").isin(groups.get(self.content, [self.content])),
        ]
        return reduce(lambda a, b: a & b, [c for c in conditions if c is not None and not isinstance(c, str)], F.lit(True))


def feed_matches(events: DataFrame | Current, f: Filter, feed: Feed) -> DataFrame:
    """Current matches in the range; scope first (key columns), then the newest row, then every other filter.

    Of a kept table only the topic's partitions of the range's months are read, and each row is the newest already.
    """
    inside = f.scope() & f.within("published_at", False)
    if isinstance(events, Current):
        rows = events.rows(SparkSession.active(), f.start, f.end, tenant_id=f.tenant, topic_id=f.topic).filter(inside)
    else:
        rows = topic_matches(events.filter(inside))
    return rows.filter(feed.where())


def ordered(df: DataFrame, sort: str) -> DataFrame:
    first = [F.desc("engagement"), F.desc("published_at")] if sort == "engagement" else [F.desc("published_at")]
    return df.orderBy(*first, "platform", "post_id")


def newest_of(rows: DataFrame | Current, page: DataFrame, version: str, f: Filter) -> DataFrame:
    """The newest row of each post on a page: rows of other posts drop out before the window. A kept table needs no window; a post is as old as its match."""
    if isinstance(rows, Current):
        return rows.rows(page.sparkSession, f.start, f.end).join(page.select(*POST_KEY), POST_KEY, "left_semi")
    return latest_per_key(rows.join(page.select(*POST_KEY), POST_KEY, "left_semi"), POST_KEY, [version])


def placed(df: DataFrame, sort: str, start: int = 0) -> DataFrame:
    """A page with each row's place from ``start`` + 1, in order: a join above a limit keeps no order."""
    first = [F.desc("engagement"), F.desc("published_at")] if sort == "engagement" else [F.desc("published_at")]
    order = Window.partitionBy().orderBy(*first, *POST_KEY)  # the rows of one page
    return df.withColumn("place", F.row_number().over(order) + start)


def feed(events: DataFrame | Current, posts: DataFrame | Current, f: Filter, what: Feed = Feed(), sort: str = "latest", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of matches with their posts, in order of ``place``: the limit stands below the join."""
    page = placed(ordered(feed_matches(events, f, what), sort).offset(offset).limit(limit), sort, offset)
    page = page.select("place", "platform", "post_id", "published_at", "sentiment", "emotion", "engagement", "author_handle")
    newest = newest_of(posts, F.broadcast(page), "version", f).select(*POST_KEY, "text", "lang")
    return page.join(newest, POST_KEY, "left").orderBy("place")


def feed_count(events: DataFrame | Current, f: Filter, what: Feed = Feed()) -> DataFrame:
    return feed_matches(events, f, what).agg(F.count("*").alias("n"))


#: What a media filter lets through.
MEDIA_TYPES = {"image": ("image", "gif"), "video": ("video",)}


def gallery(events: DataFrame | Current, posts: DataFrame | Current, f: Filter, what: Feed = Feed(), media: str | None = None, sort: str = "engagement", limit: int = 24, offset: int = 0) -> DataFrame:
    """A page of matches whose newest post has media (of a type, if asked for), in order of ``place``.

    One row more than the limit tells whether there are more. Of the media, https ones are shown, 4 at most; a page's
    posts without any are left out. Unknown engagement is null.
    """
    now = feed_matches(events, f, what).select(*POST_KEY, "published_at", "sentiment", "engagement", "engagement_known", "author_handle")
    newest = newest_of(posts, now, "version", f).withColumn("m", F.from_json("media", "array<struct<type:string,url:string,thumb:string>>"))
    # the newest version decides: filters on media stand above it
    having = newest.filter(F.size("m") > 0)
    if media:
        having = having.filter(F.exists("m", lambda x: x["type"].isin(*MEDIA_TYPES[media])))
    rows = now.join(having.select(*POST_KEY, F.substring("text", 1, 280).alias("text"), "m"), POST_KEY)
    page = placed(ordered(rows, sort).offset(offset).limit(limit + 1), sort)
    page = page.withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).filter(F.col("place") <= limit)
    https = lambda c: F.coalesce(c.startswith("https://"), F.lit(False))
    shown = F.transform(F.slice(F.filter("m", lambda x: https(x["url"])), 1, 4), lambda x: F.struct(F.coalesce(x["type"], F.lit("image")).alias("type"), x["url"].alias("url"), F.when(https(x["thumb"]), x["thumb"]).alias("thumb")))
    page = page.withColumn("media", shown).withColumn("engagement", F.when(F.col("engagement_known") == 1, F.col("engagement")))
    return page.filter(F.size("media") > 0).select("place", *POST_KEY, "published_at", "sentiment", "engagement", "author_handle", "text", "media", "has_more").orderBy("place")


def export_rows(events: DataFrame | Current, posts: DataFrame | Current, snapshots: DataFrame, f: Filter, what: Feed = Feed(), most: int = MOST_EXPORTED) -> DataFrame:
    """Matches with their posts and each metric's newest known value, newest first by ``place``; ``truncated`` if there were more than ``most``. Followers are the post's."""
    page = placed(ordered(feed_matches(events, f, what), "latest").limit(most + 1), "latest")
    page = page.withColumn("truncated", F.max("place").over(Window.partitionBy()) > most).filter(F.col("place") <= most)
    shown = ["content_type", "author_handle", "engagement", "engagement_known", "sentiment", "emotion", "issues", "hashtags"]
    page = page.select("place", "truncated", *POST_KEY, "published_at", *shown)
    newest = newest_of(posts, page, "version", f).select(*POST_KEY, "text", "lang", "author_name", "author_followers", "url")
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("captured_at"))).alias(c) for c in ("likes", "comments", "shares", "views")]
    metrics = snapshots.join(page.select(*POST_KEY), POST_KEY, "left_semi").groupBy(*POST_KEY).agg(*known)
    return page.join(newest, POST_KEY, "left").join(metrics, POST_KEY, "left").orderBy("place")


def hashtags_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)), lambda t: F.replace(t, F.lit("_"), F.lit("")))


def needle_search(posts: DataFrame, needles: list[str], tags: list[str]) -> Column:
    """Any of the needles in the text, whatever the case, or any of the hashtags; without either nothing."""
    text = F.lower("text")
    found = reduce(lambda a, b: a | b, [text.contains(n.lower()) for n in needles], F.lit(False))
    return found | F.arrays_overlap(hashtags_of(F.col("text")), F.array(*map(F.lit, [t.lower() for t in tags]))) if tags else found


#: Needles and their keys are broadcast up to so many bytes, counted first; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def grams(text: Column, least: int) -> Column:
    """The distinct stretches of three characters, and of fewer down to ``least``."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * k}))"), F.lit(1)) for k in range(least, 4)]))


def needle_hits(posts: DataFrame, needles: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``needle``: which of many needles (a column of that name) each text holds, whatever the case of each character.

    A needle's key is that of its stretches of three characters which fewest texts have (a shorter needle is its own key).
    Texts are joined with needles by the key and then looked at, so that a text costs its own length and what its
    keys point to, not the number of needles. A null or empty needle is in no text. Which stretches are rare is told from
    every tenth text by hash; it decides nothing but the work to do.
    """
    low = needles.select(lower_each(F.col("needle")).alias("needle")).filter("needle <> ''").distinct()
    size = low.agg(F.coalesce(F.sum(F.octet_length("needle") * 4 + 64), F.lit(0)).alias("bytes"), F.coalesce(F.min(F.length("needle")), F.lit(3)).alias("least")).first()
    ready = (lambda t: F.broadcast(t)) if size.bytes <= BROADCAST_BYTES else (lambda t: t)
    own = posts.select(*keys, lower_each(F.col(text)).alias("_text"))
    some = own.filter(F.pmod(F.xxhash64("_text"), F.lit(10)) == 0)
    each = some.select(F.explode(grams(F.col("_text"), min(size.least, 3))).alias("key"))
    candidates = low.select("needle", F.explode(F.when(F.length("needle") >= 3, grams(F.col("needle"), 3)).otherwise(F.array("needle"))).alias("key"))
    often = each.join(ready(candidates.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("df"))
    chosen = candidates.join(often, "key", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("k"))
    pairs = own.select(*keys, "_text", F.explode(grams(F.col("_text"), min(size.least, 3))).alias("key")).join(ready(chosen.select("needle", F.col("k.key").alias("key"))), "key")
    return pairs.filter(F.contains("_text", F.col("needle"))).select(*keys, "needle")


def preview(posts: DataFrame, needles: list[str], tags: list[str], since: datetime, sample: int = 2000, platforms: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Distinct candidates per platform (of those asked for), and the newest ``sample`` of them with their newest text."""
    recent = posts.filter(F.col("published_at") >= F.lit(since))
    recent = recent.filter(F.col("platform").isin(*platforms)) if platforms else recent
    hits = recent.filter(needle_search(posts, needles, tags))
    counts = hits.groupBy("platform").agg(F.count_distinct("post_id").alias("n"))
    newest = hits.groupBy(*POST_KEY).agg(F.max_by("text", "version").alias("text"), F.max_by("lang", "version").alias("lang"), F.max("published_at").alias("published_at"))
    return counts, newest.orderBy(F.desc("published_at"), *POST_KEY).limit(sample)


def preview_estimate(counts: DataFrame, sampled: DataFrame, matched: Column, days: int = 7) -> DataFrame:
    """Expected matches a day: candidates times the sample's share of hits, over the days."""
    seen = sampled.groupBy("platform").agg(F.count("*").alias("seen"), F.count_if(matched).alias("hits"))
    both = counts.join(seen, "platform", "left").na.fill(0, ["seen", "hits"])
    return both.withColumn("per_day", F.when(F.col("seen") > 0, rounded(F.col("n") * F.col("hits") / F.col("seen") / days, 1)).otherwise(F.lit(0.0)))
