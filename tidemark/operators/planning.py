"""What crawl runs leave behind and what they are planned from: owners, watermarks, gaps, intervals, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import overlap
from tidemark.operators.state import POST_KEY, top_n_per_key

# Gaps that a plan keeps, hours after which a gap is given up, posts of one refresh run, the longest interval.
MOST_GAPS, GAP_HOURS, PER_RUN, LONGEST = 20, 24, 50, 86_400


def with_owner(runs: DataFrame, plans: DataFrame, streams: DataFrame) -> DataFrame:
    """Runs with the platform of their plan or else of their shared stream; runs of neither are gone."""
    both = runs.join(plans.select("plan_id", F.col("platform").alias("_plan")), "plan_id", "left")
    both = both.join(streams.select("stream_id", F.col("platform").alias("_stream")), "stream_id", "left")
    return both.withColumn("platform", F.coalesce("_plan", "_stream")).drop("_plan", "_stream").filter("platform is not null")


def watermarks(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """Plans with ``high_watermark`` advanced to the newest item of their incremental runs that succeeded in full; it never goes back."""
    done = runs.filter((F.col("status") == "succeeded") & (F.col("kind") == "incremental")).groupBy("plan_id").agg(F.max("max_published_at").alias("_newest"))
    return plans.join(done, "plan_id", "left").withColumn("high_watermark", F.greatest("high_watermark", "_newest")).drop("_newest")


def windows(plans: DataFrame, now: Column, lookback_s: int = 3600) -> DataFrame:
    """Plans with the window that they fetch next: from the watermark less the overlap, or from ``lookback_s`` ago, to now."""
    earlier = lambda at, s: F.timestamp_seconds(F.unix_timestamp(at) - s)
    since = F.coalesce(earlier(F.col("high_watermark"), overlap(F.col("interval_s"))), earlier(now, F.lit(lookback_s)))
    return plans.withColumns({"since": since, "until": now})


def gaps(runs: DataFrame, k: int = MOST_GAPS) -> DataFrame:
    """(plan_id, run_id, gap_start, gap_end, created_at): what partial incremental runs missed, the k newest of each plan.

    Newest first, a run missed what is before its oldest item; oldest first, what is after its newest; in an unknown
    order it may have missed anything in its window.
    """
    cut = runs.filter((F.col("status") == "partial") & (F.col("kind") == "incremental") & F.col("window_from").isNotNull())
    end, order = F.coalesce("window_to", "finished_at"), F.col("result_order")
    cut = cut.select(
        "plan_id",
        "run_id",
        F.when(order == "asc", F.coalesce("max_published_at", "window_from")).otherwise(F.col("window_from")).alias("gap_start"),
        F.when(order == "desc", F.coalesce("min_published_at", end)).otherwise(end).alias("gap_end"),
        F.col("finished_at").alias("created_at"),
    )
    return top_n_per_key(cut, ["plan_id"], [F.desc("created_at"), F.desc("run_id")], k)


def given_up(now: Column, hours: int = GAP_HOURS) -> Column:
    """Whether a gap is too old and no run is filling it."""
    return F.col("backfill_run").isNull() & (F.col("created_at") < now - F.make_interval(hours=F.lit(hours)))


def lost_gaps(found: DataFrame, plans: DataFrame, now: Column, hours: int = GAP_HOURS) -> DataFrame:
    """Gaps given up per platform: data known to be missing."""
    return found.filter(given_up(now, hours)).join(plans.select("plan_id", "platform"), "plan_id").groupBy("platform").agg(F.count("*").alias("lost"))


def next_backfill(found: DataFrame, now: Column, hours: int = GAP_HOURS) -> DataFrame:
    """One gap of each plan to fill next: the oldest that nobody fills and that is not given up."""
    waiting = found.filter(F.col("backfill_run").isNull() & ~given_up(now, hours))
    return top_n_per_key(waiting, ["plan_id"], [F.asc("created_at"), F.asc("run_id")])


def resynced(plans: DataFrame, topics: DataFrame, offices: DataFrame, platforms: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """All plans, with the interval that now holds for those that are not disabled, and a next run no later than that.

    The topic's own interval for the platform comes first (``chosen``), then the office's, the platform's, the topic's
    default; never below the office's minimum, a day at most. Plans without topic or platform stay as they are.
    """
    rows = plans.join(topics.select("topic_id", "default_interval_s"), "topic_id", "left")
    rows = rows.join(offices.select("tenant_id", "min_interval_s", "platform_intervals"), "tenant_id", "left")
    rows = rows.join(platforms.select("platform", "crawl_interval_s"), "platform", "left")
    rows = rows.join(chosen.select("topic_id", "platform", "chosen_s"), ["topic_id", "platform"], "left")
    wanted = F.coalesce("chosen_s", F.try_element_at("platform_intervals", F.col("platform")), "crawl_interval_s", "default_interval_s")
    due = F.least(F.lit(LONGEST), F.greatest(F.coalesce("min_interval_s", F.lit(60)), wanted))
    known = F.col("default_interval_s").isNotNull() & F.col("crawl_interval_s").isNotNull() & (F.col("status") != "disabled")
    rows = rows.withColumn("_due", F.when(known, due).otherwise(F.col("interval_s")))
    soon = F.timestamp_seconds(F.unix_timestamp(now) + F.col("_due"))
    rows = rows.withColumn("next_run_at", F.when(F.col("_due") != F.col("interval_s"), F.least("next_run_at", soon)).otherwise(F.col("next_run_at")))
    return rows.withColumn("interval_s", F.col("_due")).select(*plans.columns)


def refresh_plan(matches: DataFrame, snapshots: DataFrame, now: Column, *, most_hours: int = 24, fresh_s: int = 7200, per_platform: int = 500) -> DataFrame:
    """(platform, post_id, run): young posts without a fresh snapshot, the newest of each platform, PER_RUN posts to a run."""
    young = matches.filter(F.col("published_at") >= now - F.make_interval(hours=F.lit(most_hours)))
    fresh = snapshots.filter(F.col("captured_at") >= now - F.make_interval(secs=F.lit(fresh_s))).select(*POST_KEY)
    each = young.join(fresh, POST_KEY, "left_anti").groupBy(*POST_KEY).agg(F.max("published_at").alias("newest"))
    place = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("newest"), "post_id"))
    ranked = each.withColumn("place", place).filter(F.col("place") <= per_platform)
    return ranked.select(*POST_KEY, F.expr(f"cast((place - 1) div {PER_RUN} as int)").alias("run"))


def comment_plan(matches: DataFrame, fetched: DataFrame, now: Column, *, per_day: int = 20, gap_hours: int = 24, most_days: int = 3) -> DataFrame:
    """The young posts of most engagement whose comments were not fetched lately, of each tenant's topic and platform
    as many as its daily budget has left."""
    recent = fetched.filter(F.col("fetched_at") >= now - F.make_interval(hours=F.lit(gap_hours))).select("topic_id", *POST_KEY)
    today = fetched.filter(F.col("fetched_at") >= now - F.make_interval(hours=F.lit(24))).groupBy("topic_id", "platform").agg(F.count("*").alias("_used"))
    young = (F.col("content_type") == "post") & (F.col("published_at") >= now - F.make_interval(days=F.lit(most_days)))
    place = F.row_number().over(Window.partitionBy("tenant_id", "topic_id", "platform").orderBy(F.desc("engagement"), F.desc("published_at"), "post_id"))
    open_ = matches.filter(young).join(recent, ["topic_id", *POST_KEY], "left_anti")
    ranked = open_.withColumn("_place", place).filter(F.col("_place") <= per_day)  # Spark limits the groups before the shuffle
    left = per_day - F.coalesce("_used", F.lit(0))
    return ranked.join(today, ["topic_id", "platform"], "left").filter(F.col("_place") <= left).drop("_place", "_used")
