"""Upkeep of stored tables: what is too old goes, and a rebuilt table is compared with what was backed up.

Retention drops whole months by their folders and rewrites only partitions that lie across a limit and do hold rows that
go; all other files stay as they are. A manifest has a count and a checksum of each table and month that no order of rows
changes.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.state import POST_KEY
from tidemark.sources.store import folders, remove

# Days that tables are kept, whatever a tenant has ordered; the others follow their tenants alone.
TABLE_DAYS = {
    **{name: 400 for name in ("agg_topic_1h", "agg_topic_uniq_1h", "agg_issue_1h", "agg_author_1d", "agg_reposted_author_1d", "agg_author_age_1d", "agg_emotion_1h", "agg_hashtag_1h", "agg_psycho_gender_1d", "agg_psycho_age_1d")},
    "agg_topic_5m": 35,
    "engagement_snapshots": 180,
    "provider_call_log": 180,
}

# Days of posts that never matched, of posts that no match refers to any more, and a tenant's least.
UNMATCHED_DAYS, UNREFERENCED_DAYS, LEAST_DAYS = 30, 400, 30


def month_start(ym: int) -> date:
    return date(ym // 100, ym % 100, 1)


def next_month(ym: int) -> date:
    return (month_start(ym) + timedelta(days=32)).replace(day=1)


def month_of(folder: str) -> int:
    return int(next(p for p in folder.split("/") if p.startswith("ym=")).removeprefix("ym="))


def month_folders(spark: SparkSession, path: str, parts: list[str]) -> list[str]:
    """The month folders of a table partitioned by ``parts``, as far down as ``ym``."""
    return folders(spark, "/".join([path, *(f"{p}=*" for p in parts[: parts.index("ym") + 1])]))


def purge(spark: SparkSession, path: str, parts: list[str], schema: str, *, whole: datetime | None, border: datetime, expired: Callable[[DataFrame], DataFrame]) -> dict[str, list[str]]:
    """Drop the months that end before ``whole``, and of those that begin before ``border`` the rows that ``expired`` marks in ``_expired``.

    ``schema`` has the columns but those of ``parts``. Returns what was ``dropped`` and ``rewritten``: months, and partitions
    (values joined by /). Partitions without a row that goes keep their files.
    """
    done: dict[str, list[str]] = {"dropped": [], "rewritten": []}
    months = month_folders(spark, path, parts)
    for folder in months:
        ym = month_of(folder)
        if ym and whole and next_month(ym) <= whole.date():
            remove(spark, folder)
            done["dropped"].append(str(ym))
    left = sorted({ym for f in months if (ym := month_of(f)) and str(ym) not in done["dropped"] and month_start(ym) < border.date() + timedelta(days=1)})
    if not left:
        return done
    typed = ", ".join(f"{p} {'int' if p != 'part' else 'string'}" for p in parts)
    rows = spark.read.schema(f"{schema}, {typed}").parquet(path).filter(F.col("ym").isin(left))
    marked = expired(rows)
    name = F.concat_ws("/", *[F.col(p).cast("string") for p in parts])
    state = marked.groupBy(name.alias("p")).agg(F.count_if("_expired").alias("gone"), F.count("*").alias("n")).filter("gone > 0").collect()  # partitions of border months
    mixed = [r.p for r in state if r.gone < r.n]
    if mixed:
        kept = marked.filter(name.isin(mixed) & ~F.col("_expired")).select(*rows.columns)
        kept.hint("rebalance", *parts).sortWithinPartitions(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for r in state:
        if r.gone == r.n:
            remove(spark, "/".join([path, *(f"{p}={v}" for p, v in zip(parts, r.p.split("/"), strict=True))]))
    done["rewritten"] = sorted(r.p for r in state)
    return done


def purge_table(spark: SparkSession, path: str, parts: list[str], schema: str, time: str, now: datetime, *, most_days: int | None = None, tenants: DataFrame | None = None) -> dict[str, list[str]]:
    """Rows older than ``most_days``, or than their tenant's days (``tenants``: tenant_id, days; LEAST_DAYS at least), go."""
    shortest = most_days
    if tenants is not None:
        least = tenants.agg(F.min(F.greatest(F.col("days"), F.lit(LEAST_DAYS)))).first()[0]
        shortest = min(d for d in (most_days, least) if d is not None) if (most_days or least) else None
    if shortest is None:
        return {"dropped": [], "rewritten": []}

    def expired(rows: DataFrame) -> DataFrame:
        days = F.lit(most_days).cast("int")
        if tenants is not None:
            own = tenants.select("tenant_id", F.greatest(F.col("days"), F.lit(LEAST_DAYS)).alias("_days"))
            rows, days = rows.join(own, "tenant_id", "left"), F.least(days, F.col("_days"))
        old = F.col(time).cast("timestamp") < F.lit(now).cast("timestamp") - F.make_interval(days=days)
        return rows.withColumn("_expired", F.coalesce(old, F.lit(False)))

    return purge(spark, path, parts, schema, whole=now - timedelta(days=most_days) if most_days else None, border=now - timedelta(days=shortest), expired=expired)


def purge_posts(spark: SparkSession, path: str, parts: list[str], schema: str, now: datetime, ever: DataFrame, current: DataFrame) -> dict[str, list[str]]:
    """Posts that never matched (``ever``: keys of all that did) go after UNMATCHED_DAYS, those that no current match refers to after UNREFERENCED_DAYS."""

    def expired(rows: DataFrame) -> DataFrame:
        age = lambda days: F.col("published_at") < F.lit(now - timedelta(days=days))
        flag = lambda keys, name: keys.select(*POST_KEY).distinct().withColumn(name, F.lit(True))
        both = rows.join(flag(ever, "_ever"), POST_KEY, "left").join(flag(current, "_now"), POST_KEY, "left")
        gone = (F.col("_ever").isNull() & age(UNMATCHED_DAYS)) | (F.col("_now").isNull() & age(UNREFERENCED_DAYS))
        return both.withColumn("_expired", F.coalesce(gone, F.lit(False)))

    return purge(spark, path, parts, schema, whole=None, border=now - timedelta(days=UNMATCHED_DAYS), expired=expired)


# --- manifests ---


def manifest(rows: DataFrame, table: str, time: str) -> DataFrame:
    """(table, ym, n, checksum) per month: rows, and the sum of their hashes over all columns, which are taken by name."""
    names = sorted(rows.columns)
    each: Column = F.xxhash64(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").isNull() for c in names]).cast("decimal(38,0)")
    month = F.coalesce(F.date_format(time, "yyyyMM"), F.lit("none"))
    return rows.groupBy(month.alias("ym")).agg(F.count("*").alias("n"), F.sum(each).alias("checksum")).select(F.lit(table).alias("table"), "ym", "n", "checksum")


def compared(saved: DataFrame, found: DataFrame) -> DataFrame:
    """(table, ym, saved, found, status): ``same``, ``lost`` or ``extra`` rows, or as many rows but ``changed`` ones."""
    both = saved.select("table", "ym", F.col("n").alias("saved"), F.col("checksum").alias("a")).join(found.select("table", "ym", F.col("n").alias("found"), F.col("checksum").alias("b")), ["table", "ym"], "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(n("found") < n("saved"), "lost").when(n("found") > n("saved"), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return both.select("table", "ym", n("saved").alias("saved"), n("found").alias("found"), status.alias("status"))
