"""The pre-aggregated tables: one builder, one row of ``TABLES`` each.

Measures are sums of ``sign * x``, so tables built from parts of the stream add up to the table of the whole, and late
rows just add to their bucket. A newest value is stored with what makes it the newest, so that the later of two parts wins in
whatever order they come. Keys are never null: an unknown region is '', an unknown year 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import REPLIES, REPOSTS

BUCKETS = {
    "5m": lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(c) / 300) * 300),
    "1h": lambda c: F.date_trunc("hour", c),
    "1d": lambda c: F.to_date(c),
}


def signed(x: Column | int = 1) -> Column:
    return F.sum(F.col("sign") * x).cast("long")


@dataclass(frozen=True)
class Measure:
    """How a part of a measure is built from events, merged with other parts, and read; and the columns of events that it takes."""

    build: Callable[[], Column]
    merge: Callable[[str], Column] = F.sum
    read: Callable[[Column], Column] = staticmethod(lambda c: c)
    takes: tuple[str, ...] = ("sign",)


def total(x: str | None = None) -> Measure:
    return Measure(lambda: signed(F.col(x)) if x else signed(), takes=("sign", x) if x else ("sign",))


def newest(name: str) -> Measure:
    """The newest value that isn't null; ties go to the later correction, then the larger post id, then the larger value."""
    part = lambda: F.max(F.when(F.col(name).isNotNull(), F.struct("event_at", "seq", "post_id", F.col(name).alias("value"))))
    return Measure(part, F.max, lambda c: c["value"], ("event_at", "seq", "post_id", name))


def of_type(kinds: list[str]) -> Measure:
    return Measure(lambda: F.sum(F.when(F.col("content_type").isin(kinds), F.col("sign")).otherwise(0)).cast("long"), takes=("sign", "content_type"))


POSTS = {"posts": total()}
ENGAGEMENT = POSTS | {"engagement": total("engagement")}
KNOWN = ENGAGEMENT | {"engagement_known_posts": total("engagement_known")}
MENTIONS = {"mentions": total(), "engagement": total("engagement")}
AUTHOR = {
    "posts": of_type(["post"]),
    "replies": of_type(REPLIES),
    "reposts": of_type(REPOSTS),
    "engagement": total("engagement"),
    "handle": newest("author_handle"),
    "followers": newest("author_followers"),
}


@dataclass(frozen=True)
class Table:
    """What a table is grouped by besides tenant, topic, platform and bucket (SQL by name), and what it measures."""

    bucket: str
    keys: dict[str, str] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=lambda: ENGAGEMENT)
    explode: str | None = None
    where: str | None = None


GEO = "coalesce(geo_region_code, '')"
YEAR = "coalesce(author_created_year, 0)"
SKETCH = {"authors": Measure(lambda: F.hll_sketch_agg("author_id"), F.hll_union_agg, takes=("author_id",))}

#: Tables that hold each author of a group once: they count exactly, and add up as any other.
AUTHORS_OF = {"agg_topic_uniq_1h": "agg_topic_author_1h", "agg_author_age_1d": "agg_author_year_1d"}

TABLES = {
    **{f"agg_topic_{b}": Table(b, {"sentiment": "sentiment", "content_type": "content_type"}, KNOWN) for b in BUCKETS},
    "agg_topic_uniq_1h": Table("1h", {}, SKETCH, where="sign = 1"),
    "agg_issue_1h": Table("1h", {"issue": "item", "sentiment": "sentiment"}, MENTIONS, explode="issues"),
    "agg_author_1d": Table("1d", {"author_id": "author_id", "sentiment": "sentiment"}, AUTHOR),
    "agg_reposted_author_1d": Table("1d", {"parent_author_id": "parent_author_id"}, {"reposts": of_type(REPOSTS), "handle": newest("parent_author_handle")}, where="parent_author_id is not null"),
    "agg_geo_1d": Table("1d", {"region": GEO}),
    "agg_author_age_1d": Table("1d", {"year": YEAR}, SKETCH, where="sign = 1"),
    "agg_topic_author_1h": Table("1h", {"author_id": "author_id"}, POSTS, where="sign = 1"),
    "agg_author_year_1d": Table("1d", {"year": YEAR, "author_id": "author_id"}, POSTS, where="sign = 1"),
    **{f"agg_emotion_{b}": Table(b, {"emotion": "emotion"}) for b in ("1h", "1d")},
    **{f"agg_hashtag_{b}": Table(b, {"hashtag": "lower(item)", "sentiment": "sentiment"}, explode="hashtags") for b in ("1h", "1d")},
    "agg_psycho_gender_1d": Table("1d", {"author_gender": "author_gender", "sentiment": "sentiment"}, POSTS),
    "agg_psycho_age_1d": Table("1d", {"author_age_range": "author_age_range", "sentiment": "sentiment"}, POSTS),
}

COMMON = ["tenant_id", "topic_id", "platform"]


def takes(events: DataFrame, name: str) -> list[str]:
    """The columns of events that the table ``name`` is made from."""
    t = TABLES[name]
    words = set(re.findall(r"\w+", " ".join([*t.keys.values(), t.explode or "", t.where or ""])))
    words |= {*COMMON, "published_at", *(c for m in t.measures.values() for c in m.takes)}
    return [c for c in events.columns if c in words]


def parts(events: DataFrame, name: str) -> DataFrame:
    """The table ``name`` of these events, as it is stored and merged: one partial and one final aggregation, one shuffle."""
    t = TABLES[name]
    if t.where:
        events = events.filter(t.where)
    if t.explode:
        events = events.withColumn("item", F.explode(t.explode))
    keys = [F.expr(v).alias(k) for k, v in t.keys.items()]
    bucket = BUCKETS[t.bucket]("published_at").alias("bucket")
    return events.groupBy(*COMMON, *keys, bucket).agg(*[m.build().alias(n) for n, m in t.measures.items()])


def merge(rows: DataFrame, name: str) -> DataFrame:
    """Parts of the table ``name`` as one, in any order."""
    keys = [*COMMON, *TABLES[name].keys, "bucket"]
    return rows.groupBy(*keys).agg(*[m.merge(n).alias(n) for n, m in TABLES[name].measures.items()])


def finished(rows: DataFrame, name: str) -> DataFrame:
    """Parts as they are read: newest values without what makes them so."""
    return rows.withColumns({n: m.read(F.col(n)) for n, m in TABLES[name].measures.items()})


def build(events: DataFrame, name: str) -> DataFrame:
    """The table ``name`` of these events."""
    return finished(parts(events, name), name)


def distinct_authors(events: DataFrame, name: str) -> DataFrame:
    """The table ``name`` of these events with exact counts in place of its sketches, which only estimate large groups."""
    keys = [*COMMON, *TABLES[name].keys, "bucket"]
    return build(events, AUTHORS_OF[name]).groupBy(*keys).agg(F.count("author_id").alias("authors"))


def write(events: DataFrame, path: str, names: list[str] | None = None, part: str = "0") -> None:
    """Add the aggregates of these events to the tables below ``path``, by month; the same ``part`` again replaces itself."""
    for name in names or TABLES:
        rows = parts(events, name).withColumn("ym", F.date_format("bucket", "yyyyMM").cast("int"))
        rows.repartition("ym", *COMMON).sortWithinPartitions(*COMMON, "bucket").write.mode("overwrite").partitionBy("ym").parquet(f"{path}/{name}/part={part}")


def read_stored(spark: SparkSession, path: str, name: str, start: datetime, end: datetime) -> DataFrame:
    """A stored table's months from ``start`` to ``end``; parts are added up."""
    ym = lambda t: t.year * 100 + t.month
    stored = spark.read.parquet(f"{path}/{name}").filter(F.col("ym").between(ym(start), ym(end)))
    return finished(merge(stored, name), name)


def media_items(events: DataFrame) -> DataFrame:
    """One row per medium of a match, with its place from 0."""
    each = events.select(*COMMON, "post_id", "published_at", "sign", F.posexplode("media").alias("idx", "m"))
    return each.select(*COMMON, "post_id", "published_at", "sign", "idx", "m.type", "m.url", "m.thumb")
