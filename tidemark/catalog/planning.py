"""Planning of crawls, directories of people and the corpus of labels. Orders stand in for runs, customers for topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.book import Book
from tidemark.catalog.state import SNAPSHOTS_SQL, snapshots
from tidemark.operators import enrich, ops, planning, sinks, state
from tidemark.operators.state import topic_matches
from tidemark.sources import items
from tidemark.sources.crosswalk import EVENTS_SQL, STATE_SQL, match_events
from tidemark.sources.store import fresh_path, table

BOOK = Book()
at = lambda t: F.lit(t).cast("timestamp")
NOW = "2001-08-01 00:00:00"


def runs(s, d):
    t = "cast(o_orderdate as timestamp)"
    return table(s, d, "orders").selectExpr(
        "o_orderkey as run_id",
        "case when o_orderkey % 3 > 0 then o_custkey % 50 end as plan_id",
        "case when o_orderkey % 3 = 0 then o_custkey % 20 end as stream_id",
        "case o_orderstatus when 'F' then 'succeeded' when 'O' then 'partial' else 'failed' end as status",
        "case when o_orderkey % 4 = 0 then 'backfill' else 'incremental' end as kind",
        f"case when o_orderkey % 11 > 0 then {t} end as window_from",
        f"{t} + interval 2 hours as window_to",
        f"case when o_orderkey % 5 > 0 then {t} + make_interval(0, 0, 0, 0, 0, o_orderkey % 60) end as min_published_at",
        f"case when o_orderkey % 7 > 0 then {t} + make_interval(0, 0, 0, 0, 0, 60 + o_orderkey % 60) end as max_published_at",
        "element_at(array('desc', 'asc', cast(null as string)), cast(o_orderkey % 3 + 1 as int)) as result_order",
        f"{t} + interval 3 hours as finished_at",
        f"{t} as scheduled_for",
    )


RUNS = """r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 50 END AS plan_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 20 END AS stream_id,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'backfill' ELSE 'incremental' END AS kind,
  CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate::TIMESTAMP END AS window_from, o_orderdate::TIMESTAMP + INTERVAL 2 HOUR AS window_to,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::TIMESTAMP + INTERVAL 1 MINUTE * (o_orderkey % 60) END AS min_published_at,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::TIMESTAMP + INTERVAL 1 MINUTE * (60 + o_orderkey % 60) END AS max_published_at,
  (['desc', 'asc', NULL])[o_orderkey % 3 + 1] AS result_order, o_orderdate::TIMESTAMP + INTERVAL 3 HOUR AS finished_at, o_orderdate::TIMESTAMP AS scheduled_for FROM orders)"""


def plans(s, d):
    return table(s, d, "customer").selectExpr(
        "c_custkey as plan_id", "concat('p', c_custkey % 5) as platform", "c_custkey as topic_id", "concat('t', c_nationkey) as tenant_id", "300 + c_custkey * 60 as interval_s",
        "case when c_custkey % 4 > 0 then timestamp'2000-01-01 00:00:00' + make_interval(0, 0, 0, c_custkey * 10) end as high_watermark",
        "timestamp'2001-08-01 00:00:00' + make_interval(0, 0, 0, 0, c_custkey % 3) as next_run_at", "case when c_custkey % 6 = 0 then 'disabled' else 'active' end as status",
    )


PLANS = """p AS (SELECT c_custkey AS plan_id, 'p' || c_custkey % 5 AS platform, c_custkey AS topic_id, 't' || c_nationkey AS tenant_id, 300 + c_custkey * 60 AS interval_s,
  CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * (c_custkey * 10) END AS high_watermark, TIMESTAMP '2001-08-01' + INTERVAL 1 HOUR * (c_custkey % 3) AS next_run_at,
  CASE WHEN c_custkey % 6 = 0 THEN 'disabled' ELSE 'active' END AS status FROM customer)"""


def streams(s, d):
    return table(s, d, "supplier").selectExpr("s_suppkey as stream_id", "concat('p', s_suppkey % 4) as platform")


OWNED = f"{RUNS}, {PLANS}, o AS (SELECT r.*, coalesce(p.platform, s.platform) AS platform FROM r LEFT JOIN p USING (plan_id) LEFT JOIN (SELECT s_suppkey AS stream_id, 'p' || s_suppkey % 4 AS platform FROM supplier) s USING (stream_id) WHERE coalesce(p.platform, s.platform) IS NOT NULL)"
owned = lambda s, d: planning.with_owner(runs(s, d), plans(s, d), streams(s, d))
BOOK.add("stream_or_plan", lambda s, d: ops.crawl_monitor(owned(s, d).withColumn("results", F.lit(1)), ["platform"], ["succeeded", "partial", "failed"]).drop("new", "last_success"), f"WITH {OWNED} SELECT platform, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed FROM o GROUP BY platform")
BOOK.add("recent_runs", lambda s, d: ops.recent_by_status(owned(s, d), at(NOW), 24 * 365), f"WITH {OWNED} SELECT platform, status, count(*) AS n FROM o WHERE scheduled_for >= TIMESTAMP '{NOW}' - INTERVAL 8760 HOUR GROUP BY ALL")
BOOK.add(
    "watermark_run",
    lambda s, d: planning.windows(planning.watermarks(plans(s, d), runs(s, d)), at(NOW)).select("plan_id", "high_watermark", "since", "until"),
    f"WITH {RUNS}, {PLANS}, w AS (SELECT plan_id, max(max_published_at) AS newest FROM r WHERE status = 'succeeded' AND kind = 'incremental' GROUP BY plan_id), h AS (SELECT plan_id, interval_s, greatest(high_watermark, newest) AS hw FROM p LEFT JOIN w USING (plan_id)) SELECT plan_id, hw::VARCHAR AS high_watermark, coalesce(hw - INTERVAL 1 SECOND * greatest(60, floor(interval_s * 0.2 + 0.5)::BIGINT), TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)::VARCHAR AS since, '{NOW}' AS until FROM h",
)
GAPS = "g AS (SELECT plan_id, run_id, CASE WHEN result_order = 'asc' THEN coalesce(max_published_at, window_from) ELSE window_from END AS gap_start, CASE WHEN result_order = 'desc' THEN coalesce(min_published_at, window_to) ELSE window_to END AS gap_end, finished_at AS created_at FROM r WHERE status = 'partial' AND kind = 'incremental' AND window_from IS NOT NULL QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY finished_at DESC, run_id DESC) <= 20), b AS (SELECT *, CASE WHEN run_id % 10 = 1 THEN run_id END AS backfill_run FROM g WHERE plan_id IS NOT NULL)"
owned_gaps = lambda s, d: planning.gaps(runs(s, d).filter("plan_id is not null")).withColumn("backfill_run", F.when(F.col("run_id") % 10 == 1, F.col("run_id")))
SINCE = "2000-06-01 00:00:00"
BOOK.add("gap_windows", owned_gaps, f"WITH {RUNS}, {GAPS} SELECT plan_id, run_id, gap_start::VARCHAR AS gap_start, gap_end::VARCHAR AS gap_end, created_at::VARCHAR AS created_at, backfill_run FROM b")
BOOK.add("gaps_lost", lambda s, d: planning.lost_gaps(owned_gaps(s, d), plans(s, d), at(SINCE)), f"WITH {RUNS}, {PLANS}, {GAPS} SELECT platform, count(*) AS lost FROM b JOIN p USING (plan_id) WHERE backfill_run IS NULL AND created_at < TIMESTAMP '{SINCE}' - INTERVAL 24 HOUR GROUP BY platform")
BOOK.add("next_backfill", lambda s, d: planning.next_backfill(owned_gaps(s, d), at(SINCE)).select("plan_id", "run_id"), f"WITH {RUNS}, {GAPS} SELECT plan_id, run_id FROM b WHERE backfill_run IS NULL AND created_at >= TIMESTAMP '{SINCE}' - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY created_at, run_id) = 1")


def resynced(s, d):
    topics = table(s, d, "customer").filter("c_custkey <> 7").selectExpr("c_custkey as topic_id", "c_custkey * 100 as default_interval_s")
    offices = table(s, d, "nation").filter("n_nationkey % 5 > 0").selectExpr("concat('t', n_nationkey) as tenant_id", "case when n_nationkey % 2 = 0 then 1800 end as min_interval_s", "case when n_nationkey % 3 = 0 then map('p1', 900, 'p2', 200000) end as platform_intervals")
    sources = table(s, d, "nation").filter("n_nationkey < 4").selectExpr("concat('p', n_nationkey) as platform", "n_nationkey * 1000 + 60 as crawl_interval_s")
    chosen = table(s, d, "customer").filter("c_custkey % 4 = 1").selectExpr("c_custkey as topic_id", "concat('p', c_custkey % 5) as platform", "c_custkey * 10 as chosen_s")
    return planning.resynced(plans(s, d), topics, offices, sources, chosen, at(NOW)).select("plan_id", "interval_s", "next_run_at")


BOOK.add(
    "resync_intervals",
    resynced,
    f"""WITH {PLANS}, x AS (SELECT p.*, least(86400, greatest(coalesce(CASE WHEN n % 5 > 0 AND n % 2 = 0 THEN 1800 END, 60), coalesce(CASE WHEN topic_id % 4 = 1 THEN topic_id * 10 END, CASE WHEN n % 5 > 0 AND n % 3 = 0 AND platform = 'p1' THEN 900 WHEN n % 5 > 0 AND n % 3 = 0 AND platform = 'p2' THEN 200000 END, (plan_id % 5) * 1000 + 60))) AS iv
      FROM (SELECT *, substr(tenant_id, 2)::INT AS n FROM p) p WHERE status <> 'disabled' AND plan_id % 5 < 4 AND topic_id <> 7)
      SELECT p.plan_id, coalesce(iv, p.interval_s) AS interval_s, CASE WHEN iv <> p.interval_s THEN least(p.next_run_at, TIMESTAMP '{NOW}' + INTERVAL 1 SECOND * iv) ELSE p.next_run_at END::VARCHAR AS next_run_at FROM p LEFT JOIN x USING (plan_id)""",
)
BOOK.add(
    "refresh_runs",
    lambda s, d: planning.refresh_plan(topic_matches(match_events(s, d)), snapshots(s, d), at("2024-01-20"), most_hours=240, fresh_s=86400 * 2, per_platform=70),
    f"""WITH {EVENTS_SQL}, {STATE_SQL}, {SNAPSHOTS_SQL}, c AS (SELECT platform, post_id, max(published_at) AS newest FROM m WHERE published_at >= TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM s WHERE s.platform = m.platform AND s.post_id = m.post_id AND captured_at >= TIMESTAMP '2024-01-18') GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY newest DESC, post_id) AS place FROM c) SELECT platform, post_id, ((place - 1) // 50)::INT AS run FROM k WHERE place <= 70""",
)
BOOK.add(
    "comment_planner",
    lambda s, d: planning.comment_plan(
        topic_matches(match_events(s, d)),
        table(s, d, "events").filter("event_id % 3 = 0").selectExpr("concat('q', event_id % 5) as topic_id", "event_type as platform", "cast(event_id as string) as post_id", "cast(ts as timestamp) as fetched_at"),
        at("2024-01-30"), per_day=12, gap_hours=240, most_days=15,
    ).select("tenant_id", "topic_id", "platform", "post_id", "engagement"),
    f"""WITH {EVENTS_SQL}, {STATE_SQL}, f AS (SELECT 'q' || event_id % 5 AS topic_id, event_type AS platform, event_id::VARCHAR AS post_id, ts FROM events WHERE event_id % 3 = 0), u AS (SELECT topic_id, platform, count(*) AS used FROM f WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY ALL),
      c AS (SELECT tenant_id, topic_id, platform, post_id, engagement, row_number() OVER (PARTITION BY tenant_id, topic_id, platform ORDER BY engagement DESC, published_at DESC, post_id) AS place FROM m WHERE content_type = 'post' AND published_at >= TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM f WHERE f.topic_id = m.topic_id AND f.platform = m.platform AND f.post_id = m.post_id AND ts >= TIMESTAMP '2024-01-20'))
      SELECT tenant_id, topic_id, platform, post_id, engagement FROM c LEFT JOIN u USING (topic_id, platform) WHERE place <= 12 - coalesce(used, 0)""",
)
BOOK.add(
    "tenant_retention",
    lambda s, d: state.retained_by_tenant(match_events(s, d), s.createDataFrame([("t0", 10), ("t1", 35)], "tenant_id string, days int"), at("2024-02-10")).groupBy("tenant_id").agg(F.count("*").alias("n")),
    f"WITH {EVENTS_SQL} SELECT tenant_id, count(*) AS n FROM e WHERE published_at >= CASE tenant_id WHEN 't0' THEN TIMESTAMP '2024-01-11' WHEN 't1' THEN TIMESTAMP '2024-01-06' ELSE TIMESTAMP '2000-01-01' END GROUP BY ALL",
)


def offices(s, d):
    users = table(s, d, "customer").selectExpr("c_custkey as user_id", "c_name", "c_custkey % 10 = 0 as is_operator")
    members = table(s, d, "orders").selectExpr("o_custkey as user_id", "concat('t', o_orderkey % 25) as tenant_id", "o_orderstatus as role").distinct()
    there = table(s, d, "nation").selectExpr("concat('t', n_nationkey) as tenant_id", "n_name as name", "case when n_nationkey % 4 = 0 then 'platform' else 'office' end as kind", "case when n_nationkey % 7 = 0 then date'2024-01-01' end as deleted_at")
    return ops.user_offices(users, members, there).select("user_id", F.array_join(F.transform("offices", lambda o: F.concat_ws(":", o["name"], o["tenant_id"], o["role"])), ",").alias("offices"))


BOOK.add(
    "user_offices",
    offices,
    "WITH m AS (SELECT DISTINCT o_custkey, o_orderkey % 25 AS t, o_orderstatus AS role FROM orders), o AS (SELECT o_custkey, string_agg(n_name || ':t' || t || ':' || role, ',' ORDER BY n_name, 't' || t, role) AS offices FROM m JOIN nation ON n_nationkey = t WHERE t % 4 > 0 AND t % 7 > 0 GROUP BY ALL) SELECT c_custkey AS user_id, coalesce(offices, '') AS offices FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_custkey % 10 > 0",
)
BOOK.add(
    "escaped_search",
    lambda s, d: ops.searched(table(s, d, "part").withColumn("name", F.expr("concat(p_name, case p_partkey % 3 when 0 then ' 100%_x' when 1 then ' 100AB_x' else '' end)")), "name", "Et 100%_X")
    .join(table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "name"),
    "SELECT p_partkey, name FROM (SELECT *, p_name || CASE p_partkey % 3 WHEN 0 THEN ' 100%_x' WHEN 1 THEN ' 100AB_x' ELSE '' END AS name FROM part) WHERE name ILIKE '%et 100\\%\\_x%' ESCAPE '\\' AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')",
)
BOOK.add("outbox_age", lambda s, d: ops.oldest_waiting(table(s, d, "orders").selectExpr("cast(o_orderdate as timestamp) as created_at", "case when o_orderstatus <> 'P' then o_orderdate end as published_at"), at(NOW)), f"SELECT count(*) AS n, coalesce(date_diff('second', min(o_orderdate)::TIMESTAMP, TIMESTAMP '{NOW}'), 0)::BIGINT AS age_s FROM orders WHERE o_orderstatus = 'P'")
BOOK.add("error_ratio", lambda s, d: ops.error_ratio(table(s, d, "lineitem").selectExpr("l_suppkey as route", "case when l_quantity > 49 then 503 when l_quantity > 45 then 404 else 200 end as code"), ["route"]), "SELECT l_suppkey AS route, count(*) AS requests, count(*) FILTER (l_quantity > 49) AS errors FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_quantity > 49) > 0.02 * count(*)")


def corpus(s, d):
    rows = table(s, d, "labels").selectExpr(
        "doc_id", "case when quality = 1 then 'positive' else 'negative' end as sentiment", "case when toxic = 1 then 'anger' else 'joy' end as emotion", "if(doc_id % 3 = 0, array('a b', 'c'), array()) as issues",
        "0.5D as sentiment_confidence", "0.25D as emotion_confidence", "case when doc_id % 5 = 0 then 'rule:short-text' when doc_id % 7 > 0 then 'm1' end as model_version",
    )
    path = fresh_path(s, "label-corpus")
    for month in ("2024-01-05", "2024-02-05"):
        sinks.append_monthly(enrich.label_corpus(rows.filter(F.col("doc_id") % 2 == int(month[6]) - 1), ["doc_id"], at(month)), path, "created_at")
    return sinks.read_months(s, path, "202401", "202402").groupBy("ym", "task", "label", "source", "model_version").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence")).withColumn("ym", F.col("ym").cast("string"))


BOOK.add(
    "label_corpus",
    corpus,
    """WITH l AS (SELECT * FROM labels WHERE doc_id % 5 > 0 AND doc_id % 7 > 0), t AS (SELECT doc_id, 'sentiment' AS task, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, 0.5::DOUBLE AS c FROM l UNION ALL SELECT doc_id, 'emotion', CASE WHEN toxic = 1 THEN 'anger' ELSE 'joy' END, 0.25 FROM l UNION ALL SELECT doc_id, 'keyphrase', 'a b | c', 0.5 FROM l WHERE doc_id % 3 = 0)
      SELECT CASE WHEN doc_id % 2 = 0 THEN '202401' ELSE '202402' END AS ym, task, label, 'llm' AS source, 'm1' AS model_version, count(*) AS n, sum(c) AS confidence FROM t GROUP BY ALL""",
)
RAW = "'x' as platform", "case when turn % 3 > 0 then cast(turn as string) end as id", "case when conv_id % 4 > 0 then '1700000000' else 'yesterday' end as created_at", "named_struct('id', role, 'handle', case when turn % 2 = 0 then role end) as author", "case when conv_id % 9 = 0 then '{' end as _bad"
BOOK.add("rejected_items", lambda s, d: items.rejected(table(s, d, "conversations").selectExpr(*RAW)), "SELECT CASE WHEN conv_id % 9 = 0 THEN 'broken' WHEN turn % 3 = 0 THEN 'id' WHEN conv_id % 4 = 0 THEN 'time' WHEN turn % 2 > 0 THEN 'author' END AS reason, count(*) AS n FROM conversations WHERE conv_id % 9 = 0 OR turn % 3 = 0 OR conv_id % 4 = 0 OR turn % 2 > 0 GROUP BY ALL")
