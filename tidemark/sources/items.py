"""Canonical items from source files: read with a schema, quarantine what breaks it, normalise, drop what lacks a required field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import count_metric, to_utc
from tidemark.schemas import CANONICAL
from tidemark.sources.store import exists, fresh_path, remove


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (gzip or not) in the declared schema; broken lines come with ``_bad``."""
    return spark.read.schema(CANONICAL).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)


def write_items(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "gzip").json(path)


def content_type() -> Column:
    """comment, repost, quote, reply or post, in that order."""
    return F.when(F.col("is_comment"), "comment").when(F.col("is_repost"), "repost").when(F.col("is_quote"), "quote").when(F.col("reply_to").isNotNull(), "reply").otherwise("post")


def normalized(raw: DataFrame, also: list[str] = []) -> DataFrame:
    """One canonical row per raw item; unknown is null, never a guess. Rows without id, time or author are gone. ``also``: columns to hand on."""
    rows = raw.filter(F.col("_bad").isNull()) if "_bad" in raw.columns else raw
    rows = rows.select(
        F.lower("platform").alias("platform"),
        F.col("id").alias("post_id"),
        content_type().alias("content_type"),
        F.col("reply_to").alias("parent_post_id"),
        F.coalesce("root", F.when(F.col("is_comment"), F.col("reply_to"))).alias("root_post_id"),
        "text",
        "lang",
        to_utc(F.col("created_at")).alias("published_at"),
        F.col("author.id").alias("author_id"),
        F.lower(F.regexp_replace("author.handle", "^@", "")).alias("author_handle"),
        count_metric(F.col("author.followers")).alias("author_followers"),
        *[count_metric(F.col(f"metrics.{m}")).alias(m) for m in ("likes", "comments", "shares", "views")],
        F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"),
        *also,
    )
    return rows.filter("post_id is not null and published_at is not null and author_id is not null and author_handle is not null")


def rejected(raw: DataFrame, by: list[str] = []) -> DataFrame:
    """(reason, n), per ``by``: the raw items that ``normalized`` leaves out, counted by the first thing that they lack."""
    bad = F.col("_bad").isNotNull() if "_bad" in raw.columns else F.lit(False)
    why = F.when(bad, "broken").when(F.col("id").isNull(), "id").when(to_utc(F.col("created_at")).isNull(), "time").when(F.col("author.id").isNull() | F.col("author.handle").isNull(), "author")
    return raw.groupBy(*by, why.alias("reason")).agg(F.count("*").alias("n")).filter("reason is not null")


def pages(reads: list[DataFrame], start: Column, end: Column, floor_days: int = 30) -> DataFrame:
    """Several pages as one: within the window (and never older than the floor), each post once."""
    rows = reads[0]
    for r in reads[1:]:
        rows = rows.unionByName(r)
    since = F.greatest(start, end - F.make_interval(days=F.lit(floor_days)))
    return rows.filter(F.col("published_at").between(since, end)).dropDuplicates(["platform", "post_id"])


def fetched(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items of several pages (files of JSON lines, gzip or not), each post once, and (page, items, dropped, status) per page.

    A page that is missing or breaks off does not undo the others: what could be read of it stays (``status`` is then
    ``partial`` or ``missing``). Of a page that breaks off in the midst of a line, that line counts as dropped.
    """
    there = [p for p in paths if exists(spark, p)]
    raw = spark.read.schema(CANONICAL).option("columnNameOfCorruptRecord", "_bad").option("ignoreCorruptFiles", True).json(there) if there else spark.createDataFrame([], CANONICAL)
    where = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1) if there else F.lit("")
    raw = raw.withColumn("_page", where)
    rows = normalized(raw).dropDuplicates(["platform", "post_id"])
    bad = rejected(raw, ["_page"]).groupBy("_page").agg(F.sum("n").alias("dropped"), F.max(F.when(F.col("reason") == "broken", 1)).alias("broken"))
    good = normalized(raw, ["_page"]).groupBy("_page").agg(F.count("*").alias("items"))
    asked = spark.createDataFrame([(p.rsplit("/", 1)[-1], p in there) for p in paths], "page string, there boolean")
    both = asked.join(good.withColumnRenamed("_page", "page"), "page", "left").join(bad.withColumnRenamed("_page", "page"), "page", "left")
    status = F.when(~F.col("there"), "missing").when(F.col("broken") == 1, "partial").otherwise("read")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows, both.select("page", n("items"), n("dropped"), status.alias("status"))


def without_ads(rows: DataFrame) -> DataFrame:
    """Only known advertisements go."""
    return rows.filter(~F.coalesce("is_ad", F.lit(False)))


def collected(rows: DataFrame, variant: str, paths: list[str], id_path: str) -> DataFrame:
    """Objects of a given shape at any of the known paths of a variant column, each id once."""
    each = F.concat(*[F.coalesce(F.try_variant_get(variant, p, "array<variant>"), F.array().cast("array<variant>")) for p in paths])
    one = rows.select(F.explode(each).alias("o")).withColumn("id", F.try_variant_get("o", id_path, "string"))
    return one.filter("id is not null").groupBy("id").agg(F.min(F.to_json("o")).alias("object"))


def collected_deep(rows: DataFrame, variant: str, id_key: str, required: list[str]) -> DataFrame:
    """(id, object): objects at any depth that have a text or number ``id_key`` and all ``required`` keys, each id once.

    A walk level by level, until a level holds nothing: each level is a table in the shared folder, made of the one before by
    ``variant_explode`` and then removed with it. What is found is not looked into further. Of one id's objects
    the one whose JSON sorts first stays.
    """
    spark = rows.sparkSession
    base, depth = fresh_path(spark, "walk"), 0
    level = rows.select(F.col(variant).alias("v")).filter("v is not null")
    while True:
        at = f"{base}/level-{depth}"
        has = [F.try_variant_get("v", f"$['{k}']", "variant").isNotNull() for k in required]
        name = F.try_variant_get("v", f"$['{id_key}']", "string")
        found = (F.coalesce(name, F.lit("")) != "") & ~F.schema_of_variant(F.coalesce(F.try_variant_get("v", f"$['{id_key}']", "variant"), F.parse_json(F.lit("null")))).rlike("^(OBJECT|ARRAY)")
        for c in has:
            found = found & c
        level.select("v", F.when(found, name).alias("id")).write.parquet(at)
        if depth:
            remove(spark, f"{base}/in-{depth}")
        here = spark.read.schema("v variant, id string").parquet(at)
        here.filter("id is not null").select("id", F.to_json("v").alias("object")).write.mode("append").parquet(f"{base}/found")
        depth += 1
        below = f"{base}/in-{depth}"
        here.filter("id is null").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("value").write.parquet(below)
        remove(spark, at)
        level = spark.read.schema("value variant").parquet(below).select(F.col("value").alias("v"))
        if level.isEmpty():
            remove(spark, below)
            break
    return spark.read.schema("id string, object string").parquet(f"{base}/found").groupBy("id").agg(F.min("object").alias("object"))
