"""Current state from append-only tables, and corrections that keep every sum right.

A correction is a pair: a -1 copy of the newest row and a +1 row with the new values, at the same time; ``seq`` orders
them. Sums of ``sign * x`` then need no update in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH_KEY = ["tenant_id", "topic_id", "platform", "post_id"]
POST_KEY = ["platform", "post_id"]


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark limits each partition's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key. Filter by anything but the keys after this, never before."""
    return top_n_per_key(df, keys, [F.col(v).desc() for v in version])


def topic_matches(events: DataFrame) -> DataFrame:
    """The current row of each match."""
    return latest_per_key(events.filter("sign = 1"), MATCH_KEY, ["event_at", "seq"])


def corrections(events: DataFrame, changes: DataFrame, *, keep_human: bool, on_both: tuple[str, ...] = ()) -> DataFrame:
    """The pairs that carry ``changes`` (key columns, ``at`` and the columns to replace) into the stream.

    The -1 row repeats the old values, but for the columns ``on_both``, which no sum is made of. With ``keep_human`` rows labelled by a person, or by the same model already, stay.
    """
    names = [c for c in changes.columns if c not in (*MATCH_KEY, "at")]
    now = topic_matches(events)
    both = now.join(changes.withColumnsRenamed({c: f"new_{c}" for c in names}), MATCH_KEY)
    if keep_human:
        both = both.filter((F.col("model_version") != "human") & (F.col("model_version") != F.col("new_model_version")))
    pair = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.lit(1).alias("seq")), F.struct(F.lit(1).alias("sign"), F.lit(2).alias("seq"))))
    both = both.drop("sign", "seq").withColumn("p", pair)
    out = [
        F.when((F.col("p.sign") > 0) | F.lit(c in on_both), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) if c in names else F.col("p." + c).alias(c) if c in ("sign", "seq") else F.col("at").alias(c) if c == "event_at" else F.col(c)
        for c in events.columns
    ]
    return both.select(*out)


def engagement(row: str = "") -> tuple[Column, Column]:
    """Engagement of a snapshot and whether any part of it is known; views don't count."""
    parts = [F.col(row + c) for c in ("likes", "comments", "shares", "quotes", "saves")]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return total, F.coalesce(*parts).isNotNull()


def refreshed(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Correction pairs from each post's newest snapshot. What is unknown there keeps its old value; a new follower count stands on both rows."""
    latest = latest_per_key(snapshots, POST_KEY, ["captured_at"])
    total, known = engagement()
    latest = latest.select(*POST_KEY, F.col("captured_at").alias("at"), F.when(known, total).alias("engagement"), F.when(known, 1).alias("engagement_known"), "author_followers")
    names = ["engagement", "engagement_known", "author_followers"]
    old = topic_matches(events).select(*MATCH_KEY, *[F.col(c).alias(f"old_{c}") for c in names])
    both = old.join(latest, POST_KEY)
    other = [F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in names]
    changes = both.filter(other[0] | other[1] | other[2]).select(*MATCH_KEY, "at", *names)
    return corrections(events, changes, keep_human=False, on_both=("author_followers",))


def not_fresh(candidates: DataFrame, snapshots: DataFrame, since: Column) -> DataFrame:
    """Candidates without a snapshot since then. An anti join on the key, not NOT IN, which would be a nested loop."""
    fresh = snapshots.filter(F.col("captured_at") >= since).select(*POST_KEY)
    return candidates.join(fresh, POST_KEY, "left_anti")


def retained(posts: DataFrame, matches: DataFrame, now: Column, *, unmatched_days: int = 30, most_days: int = 400) -> DataFrame:
    """Posts that stay: matched ones for ``most_days``, others for ``unmatched_days``."""
    age = F.datediff(now, F.col("published_at"))
    marked = posts.join(matches.select(*POST_KEY).distinct().withColumn("matched", F.lit(True)), POST_KEY, "left")
    return marked.filter(F.when(F.col("matched"), age <= most_days).otherwise(age <= unmatched_days)).drop("matched")


def retained_by_tenant(rows: DataFrame, days: DataFrame, now: Column, *, time: str = "published_at", least: int = 30) -> DataFrame:
    """Rows within their tenant's days, ``least`` at least; rows of tenants without a number of days stay."""
    kept = rows.join(days.select("tenant_id", "days"), "tenant_id", "left")
    return kept.filter(F.col("days").isNull() | (F.col(time) >= now - F.make_interval(days=F.greatest(F.col("days"), F.lit(least))))).drop("days")
