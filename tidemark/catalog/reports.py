"""Operational reports, alerts and evaluation. Orders stand in for runs, line items for attempts, labels for gold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.book import Book
from tidemark.catalog.state import AGG_SQL
from tidemark.functions import values
from tidemark.operators import aggregates, evalkit, ops, relational
from tidemark.sources.crosswalk import EVENTS_SQL, match_events
from tidemark.sources.store import table

BOOK = Book()

ATTEMPT = {
    "run_id": "l_orderkey",
    "connector": "concat('c', l_suppkey % 10)",
    "account": "concat('a', l_suppkey % 25)",
    "tenant_id": "concat('t', l_orderkey % 3)",
    "status": "case l_returnflag when 'N' then 'success' when 'R' then 'failed' else 'partial' end",
    "requests": "cast(l_linenumber as bigint)",
    "results": "cast(l_quantity as bigint)",
    "cost": "cast(round(l_extendedprice * 100) as bigint)",
    "latency": "cast(l_quantity * 10 + l_linenumber as bigint)",
    "at": "cast(l_shipdate as timestamp)",
}
RUN = {
    "run_id": "o_orderkey",
    "platform": "concat('p', o_custkey % 5)",
    "plan_id": "o_custkey % 200",
    "tenant_id": "concat('t', o_orderkey % 3)",
    "status": "case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'queued' end",
    "finished_at": "cast(o_orderdate as timestamp)",
    "results": "o_orderkey % 50",
    "message": "repeat(o_orderpriority, 40)",
    "cost": "cast(round(o_totalprice * 100) as bigint)",
}


def duck(spec: dict[str, str], source: str, name: str) -> str:
    plain = ", ".join(f"{v} AS {k}" for k, v in spec.items())
    return f"{name} AS (SELECT {plain} FROM {source})"


A, R = duck(ATTEMPT, "lineitem", "a"), duck(RUN, "orders", "r")


def attempts(s, d):
    return table(s, d, "lineitem").selectExpr(*[f"{v} as {k}" for k, v in ATTEMPT.items()])


def runs(s, d):
    return table(s, d, "orders").selectExpr(*[f"{v} as {k}" for k, v in RUN.items()])


USAGE = "count(*) AS attempts, sum(requests)::BIGINT AS requests, sum(results)::BIGINT AS results, sum(cost)::BIGINT AS cost, count(*) FILTER (status = 'success') AS successes"
for _by in ("connector", "account"):
    BOOK.add(f"usage_by_{_by}", lambda s, d, b=_by: ops.usage(attempts(s, d), [b]), f"WITH {A} SELECT {_by}, {USAGE} FROM a GROUP BY ALL")
BOOK.add("usage_by_tenant", lambda s, d: ops.usage_by_tenant(attempts(s, d), runs(s, d)), f"WITH {A}, {R} SELECT tenant_id, count(*) AS rows, sum(cost)::BIGINT AS cost FROM (SELECT tenant_id, cost FROM a UNION ALL SELECT tenant_id, cost FROM r) GROUP BY ALL")
STATES = ["success", "failed", "queued"]
BOOK.add("crawl_monitor", lambda s, d: ops.crawl_monitor(runs(s, d), ["platform"], STATES), f"WITH {R} SELECT platform, count(*) AS total, {', '.join(f'count(*) FILTER (status = {x!r}) AS {x}' for x in STATES)}, sum(results)::BIGINT AS new, (max(finished_at) FILTER (status = 'success'))::VARCHAR AS last_success FROM r GROUP BY ALL")


def failures(s, d):
    owner = table(s, d, "orders").selectExpr("o_orderkey as run_id", "o_custkey as c_custkey").join(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    return ops.recent_failures(runs(s, d), [(owner.select("run_id", "c_name"), "run_id")]).select("run_id", "finished_at", "message", "c_name")


BOOK.add("recent_failures", failures, f"WITH {R} SELECT run_id, finished_at::VARCHAR AS finished_at, substr(message, 1, 300) AS message, c_name FROM (SELECT * FROM r WHERE status = 'failed' ORDER BY finished_at DESC, run_id LIMIT 30) LEFT JOIN orders ON run_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
BOOK.add(
    "health_by_state",
    lambda s, d: ops.counts_by_state(attempts(s, d), ["connector"], "status").select("connector", F.to_json("by_state").alias("by_state")),
    f"WITH {A} SELECT connector, '{{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}}' AS by_state FROM (SELECT connector, status, count(*) AS n FROM a GROUP BY ALL) GROUP BY connector",
)
BOOK.add(
    "office_list",
    lambda s, d: ops.grouped_names(table(s, d, "region").join(table(s, d, "nation"), F.expr("r_regionkey = n_regionkey"), "left"), "r_name", "n_name").withColumn("names", F.array_join("names", ",")),
    "SELECT r_name, count(n_name) AS n, coalesce(string_agg(DISTINCT n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
)
BOOK.add("state_metrics", lambda s, d: ops.state_metrics(runs(s, d), F.lit("2002-01-01").cast("timestamp")), f"WITH {R} SELECT platform, count(*) AS runs, date_diff('second', max(finished_at) FILTER (status = 'success'), TIMESTAMP '2002-01-01')::BIGINT AS success_age_s FROM r GROUP BY ALL")


def guarded(s, d):
    spent = runs(s, d).select("tenant_id", "cost", F.date_format("finished_at", "yyyy-MM").alias("period"))
    policies = spent.select("tenant_id", "period").distinct().withColumn("most", F.lit(1_000_000_000))
    return ops.cost_guard(policies, spent)


# soft caps whose period begins when it does in the policy's own time zone
CAP_NOW = "1998-07-31 20:30:00"


def caps(s, d):
    policies = table(s, d, "customer").selectExpr(
        "c_custkey as policy_id", "element_at(array('global', 'tenant', 'topic'), cast(c_custkey % 3 + 1 as int)) as scope_type", "case when c_custkey % 3 > 0 then concat('s', c_nationkey) end as scope_id",
        "case when c_custkey % 2 = 0 then 'day' else 'month' end as period", "'usd' as unit", "cast(c_custkey % 40 * 10 as bigint) as most", "element_at(array('UTC', 'Asia/Jakarta', 'America/Bogota'), cast(c_custkey % 7 % 3 + 1 as int)) as reset_tz",
        "c_custkey % 11 > 0 as enabled", "c_custkey % 13 = 0 as hard", "case when c_custkey % 5 = 0 then 'earlier' end as throttled_since",
    )
    spent = table(s, d, "orders").selectExpr("element_at(array('global', 'tenant', 'topic'), cast(o_orderkey % 3 + 1 as int)) as scope_type", "case when o_orderkey % 3 > 0 then concat('s', o_orderkey % 25) end as scope_id", "case when o_orderkey % 2 = 0 then 'day' else 'month' end as period", "'usd' as unit", "cast(date_trunc(case when o_orderkey % 2 = 0 then 'day' else 'month' end, date_add(date'1998-06-15', cast(o_orderkey % 50 as int))) as date) as period_start")
    return ops.soft_caps(policies, spent.groupBy(*spent.columns).agg(F.count("*").alias("used")), F.lit(CAP_NOW).cast("timestamp")).select("policy_id", "period_start", "used", "breached", "change")


BOOK.add(
    "cost_guard_zones",
    caps,
    f"""WITH p AS (SELECT c_custkey AS policy_id, (['global', 'tenant', 'topic'])[c_custkey % 3 + 1] AS st, CASE WHEN c_custkey % 3 > 0 THEN 's' || c_nationkey ELSE '*' END AS si, CASE WHEN c_custkey % 2 = 0 THEN 'day' ELSE 'month' END AS period, c_custkey % 40 * 10 AS most,
        TIMESTAMP '{CAP_NOW}' + INTERVAL 1 HOUR * ([0, 7, -5])[c_custkey % 7 % 3 + 1] AS at_home, c_custkey % 5 = 0 AS was FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 13 > 0),
      u AS (SELECT (['global', 'tenant', 'topic'])[o_orderkey % 3 + 1] AS st, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey % 25 ELSE '*' END AS si, CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'month' END AS period,
        date_trunc(CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'month' END, DATE '1998-06-15' + (o_orderkey % 50)::INT)::DATE AS ps, count(*) AS used FROM orders GROUP BY ALL),
      j AS (SELECT policy_id, date_trunc(p.period, at_home)::DATE AS ps, coalesce(used, 0) AS used, coalesce(used, 0) >= most AS breached, was FROM p LEFT JOIN u ON u.st = p.st AND u.si = p.si AND u.period = p.period AND u.ps = date_trunc(p.period, at_home)::DATE)
      SELECT policy_id, ps::VARCHAR AS period_start, used, breached, CASE WHEN breached AND NOT was THEN 'throttled' WHEN was AND NOT breached THEN 'released' END AS change FROM j""",
)


# failures with five dimensions: customers as plans, suppliers as streams, nations as topics, regions as tenants, parts as connectors
def reported(s, d):
    rows = table(s, d, "orders").selectExpr(
        "o_orderkey as run_id", "cast(o_orderdate as timestamp) as scheduled_for", "case o_orderstatus when 'O' then 'failed' else 'succeeded' end as status", "case when o_orderkey % 4 = 0 then 'backfill' else 'incremental' end as kind",
        "case when o_orderkey % 3 > 0 then o_custkey end as plan_id", "case when o_orderkey % 3 = 0 then o_custkey % 120 end as stream_id", "o_orderkey % 7 as tenant_id", "o_orderkey % 2500 as connector_id", "o_orderpriority as error_code", "repeat(o_orderpriority, 60) as message",
    )
    plans = table(s, d, "customer").selectExpr("c_custkey as plan_id", "c_mktsegment as platform", "c_nationkey as topic_id")
    streams = table(s, d, "supplier").selectExpr("s_suppkey as stream_id", "concat('p', s_nationkey) as platform")
    topics = table(s, d, "nation").selectExpr("n_nationkey as topic_id", "n_name as topic_name")
    tenants = table(s, d, "region").selectExpr("r_regionkey as tenant_id", "r_name as tenant_name")
    connectors = table(s, d, "part").selectExpr("p_partkey as connector_id", "p_name as connector")
    return ops.failure_report(rows, plans, streams, topics, tenants, connectors, F.lit("1996-01-01").cast("timestamp"))


BOOK.add(
    "failure_report",
    reported,
    """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30)
      SELECT o_orderkey AS run_id, o_orderdate::VARCHAR AS scheduled_for, CASE WHEN o_orderkey % 4 = 0 THEN 'backfill' ELSE 'incremental' END AS kind, coalesce(c_mktsegment, 'p' || s_nationkey) AS platform, o_orderpriority AS error_code, substr(repeat(o_orderpriority, 60), 1, 300) AS message, p_name AS connector, n_name AS topic_name, r_name AS tenant_name
      FROM f LEFT JOIN customer ON o_orderkey % 3 > 0 AND c_custkey = o_custkey LEFT JOIN supplier ON o_orderkey % 3 = 0 AND s_suppkey = o_custkey % 120 LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = o_orderkey % 7 LEFT JOIN part ON p_partkey = o_orderkey % 2500""",
)


# what can serve a platform: policies, rules, connectors, providers, capabilities
def served(s, d):
    policies = table(s, d, "customer").selectExpr("c_custkey as policy_id", "concat('p', c_nationkey) as platform", "c_mktsegment as operation", "case when c_custkey % 3 = 0 then concat('t', c_custkey) end as tenant_id", "c_custkey as created_at", "c_custkey % 2 = 0 as allow_unverified", "c_custkey % 7 > 0 as enabled")
    rules = table(s, d, "orders").selectExpr("o_custkey as policy_id", "o_orderkey % 100 as connector_id", "o_orderkey % 3 as priority", "o_orderkey % 4 as weight", "o_orderstatus <> 'P' as enabled")
    connectors = table(s, d, "supplier").selectExpr("s_suppkey as connector_id", "s_nationkey as provider_id", "s_suppkey % 6 > 0 as enabled")
    providers = table(s, d, "nation").selectExpr("n_nationkey as provider_id", "n_nationkey % 8 > 0 as enabled")
    segments = table(s, d, "customer").select(F.col("c_mktsegment").alias("operation")).distinct()
    able = table(s, d, "supplier").select("s_suppkey").join(segments, F.expr("s_suppkey % 9 <> length(operation)")).selectExpr("s_suppkey as connector_id", "operation", "element_at(array('verified', 'declared', 'off'), cast((s_suppkey + length(operation)) % 3 + 1 as int)) as status")
    return ops.usable(policies, rules, connectors, providers, able).select("platform", "operation", "policy_id", "connector_id", "priority", "weight", "capability")


BOOK.add(
    "usable_connectors",
    served,
    """WITH pol AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 3 <> 0, c_custkey) AS rn FROM customer WHERE c_custkey % 7 > 0) WHERE rn = 1),
      cap AS (SELECT s_suppkey, o, (['verified', 'declared', 'off'])[(s_suppkey + length(o)) % 3 + 1] AS status FROM supplier, (SELECT DISTINCT c_mktsegment AS o FROM customer) WHERE s_suppkey % 9 <> length(o))
      SELECT 'p' || c_nationkey AS platform, c_mktsegment AS operation, c_custkey AS policy_id, o_orderkey % 100 AS connector_id, o_orderkey % 3 AS priority, o_orderkey % 4 AS weight, status AS capability
      FROM pol JOIN orders ON o_custkey = c_custkey AND o_orderkey % 4 > 0 AND o_orderstatus <> 'P' JOIN supplier s ON s.s_suppkey = o_orderkey % 100 AND s.s_suppkey % 6 > 0 JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 8 > 0
      JOIN cap ON cap.s_suppkey = s.s_suppkey AND cap.o = c_mktsegment WHERE status = 'verified' OR (c_custkey % 2 = 0 AND status = 'declared')""",
)


BOOK.add("cost_guard", guarded, f"WITH {R} SELECT tenant_id, strftime(finished_at, '%Y-%m') AS period, 1000000000 AS most, sum(cost)::BIGINT AS used, sum(cost) >= 1000000000 AS breached FROM r GROUP BY ALL")


def allocated(s, d):
    weights = attempts(s, d).withColumn("tenant_id", F.concat(F.lit("t"), F.col("results") % 4)).groupBy("run_id", "tenant_id").agg(F.sum(F.col("requests") % 3).alias("matches"))
    used = attempts(s, d).groupBy("run_id").agg(*[F.sum(c).cast("decimal(18,0)").alias(c) for c in ("requests", "results", "cost")])
    out = ops.allocate(used, weights, ["requests", "results", "cost"])
    return out.groupBy("tenant_id", "basis").agg(F.count("*").alias("runs"), *[(F.round(F.sum(c), 3) * 1000).cast("long").alias(c) for c in ("requests", "results", "cost")])


PARTS = ", ".join(f"u.{c}::DOUBLE * n / total AS {c}" for c in ("requests", "results", "cost"))
BOOK.add(
    "cost_allocation",
    allocated,
    f"""WITH {A}, w AS (SELECT run_id, 't' || results % 4 AS tenant_id, sum(requests % 3) AS matches FROM a GROUP BY ALL), u AS (SELECT run_id, sum(requests) AS requests, sum(results) AS results, sum(cost) AS cost FROM a GROUP BY run_id),
      b AS (SELECT *, sum(n) OVER (PARTITION BY run_id) AS total FROM (SELECT run_id, tenant_id, CASE WHEN every > 0 THEN matches ELSE 1 END AS n, CASE WHEN every > 0 THEN 'matches' ELSE 'even_split' END AS basis FROM (SELECT *, sum(matches) OVER (PARTITION BY run_id) AS every FROM w) WHERE matches > 0 OR every = 0)),
      z AS (SELECT tenant_id, basis, {PARTS} FROM b JOIN u USING (run_id)) SELECT tenant_id, basis, count(*) AS runs, {", ".join(f"floor(sum({c}) * 1000 + 0.5)::BIGINT AS {c}" for c in ("requests", "results", "cost"))} FROM z GROUP BY ALL""",
)
BOOK.add(
    "map_merge_sum",
    lambda s, d: table(s, d, "events").select("event_id", F.to_json(ops.merge_maps(F.expr("map('a', user_id, 'b', event_id)"), F.expr("map('b', 1L, 'c', user_id % 2)"))).alias("m")),
    "SELECT event_id, '{\"a\":' || user_id || ',\"b\":' || (event_id + 1) || ',\"c\":' || user_id % 2 || '}' AS m FROM events",
)
BOOK.add("dup_invariant", lambda s, d: ops.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]), "SELECT l_orderkey, l_partkey, count(*) AS c FROM lineitem GROUP BY ALL HAVING c > 1")
BOOK.add(
    "percentile_health",
    lambda s, d: ops.health(attempts(s, d).withColumns({"latency": F.col("latency") + F.col("run_id") % 900, "status": F.expr("case when connector <> 'c3' then case when connector = 'c4' and run_id % 5 > 0 then 'failed' else status end end")}), ["connector"], 200.0).drop("rate"),
    f"""WITH {A}, x AS (SELECT connector, latency + run_id % 900 AS latency, CASE WHEN connector <> 'c3' THEN CASE WHEN connector = 'c4' AND run_id % 5 > 0 THEN 'failed' ELSE status END END AS status FROM a),
      h AS (SELECT connector, count(status) AS n, avg((status = 'success')::INT) AS rate, (quantile_disc(latency, 0.95) FILTER (status = 'success'))::DOUBLE AS p95 FROM x GROUP BY ALL), z AS (SELECT *, floor(100 * rate * coalesce(least(1.0, 400.0 / p95), 1.0) + 0.5)::BIGINT AS score FROM h)
      SELECT connector, n, p95, score, CASE WHEN score IS NULL THEN 'unknown' WHEN score < 40 THEN 'unhealthy' WHEN score >= 80 THEN 'healthy' ELSE 'degraded' END AS label FROM z""",
)
BOOK.add(
    "loadtest_percentiles",
    lambda s, d: ops.percentiles(attempts(s, d), "latency", ["connector"], [50, 95, 99]),
    f"WITH {A}, x AS (SELECT connector, latency, row_number() OVER (PARTITION BY connector ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY connector) AS n FROM a) SELECT connector, max(n) AS n, {', '.join(f'max(latency) FILTER (i = least(n - 1, floor({p} * n / 100.0))) AS p{p}' for p in (50, 95, 99))} FROM x GROUP BY connector",
)
BOOK.add("histogram_metric", lambda s, d: ops.histogram(attempts(s, d), "latency", ["status"], [50, 100, 250, 500]), f"WITH {A} SELECT status, {', '.join(f'count(*) FILTER (latency <= {b}) AS le_{b}' for b in (50, 100, 250, 500))}, count(*) AS count, sum(latency)::BIGINT AS sum FROM a GROUP BY ALL")
BOOK.add("ratio_rules", lambda s, d: ops.failing(runs(s, d), ["plan_id"], 0.4), f"WITH {R} SELECT plan_id, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed FROM r GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (status = 'failed') > 0.4 * count(*)")


def projected(s, d):
    rows = runs(s, d).groupBy("platform").agg(F.sum("results").alias("used")).withColumns({"per_day": F.when(F.col("platform") != "p3", F.col("used") / 10), "most": F.when(F.col("platform") == "p2", 0).otherwise(500_000), "period": F.when(F.col("platform") == "p0", "day").otherwise("month")})
    return ops.quota_projection(rows, F.lit("2024-02-10").cast("timestamp"))


BOOK.add(
    "quota_projection",
    projected,
    f"WITH {R}, q AS (SELECT platform, sum(results)::BIGINT AS used, CASE WHEN platform <> 'p3' THEN sum(results) / 10 END AS per_day, CASE WHEN platform = 'p2' THEN 0 ELSE 500000 END AS most, CASE WHEN platform = 'p0' THEN 'day' ELSE 'month' END AS period FROM r GROUP BY platform), z AS (SELECT *, used + per_day * CASE WHEN period = 'day' THEN 1 ELSE 20 END AS projected FROM q) SELECT *, CASE WHEN projected IS NOT NULL THEN CASE WHEN most > 0 THEN floor(projected * 100 / most + 0.5)::BIGINT ELSE 100 END END AS pct FROM z",
)


def estimated(s, d):
    plans = "p_partkey as plan_id", "p_size * 60 as interval_s", "p_size % 3 + 1 as queries", "op", "p_size % 4 + op as parts", "case when op = 1 then 2 end as pages", "case when p_size % 5 = 0 then null else p_size * 10 end as matches", "1.5D as overhead"
    prices = "case when op = 1 then 0.25D end as per_request", "case when p_size % 7 > 0 then 2.0D end as per_thousand", "case when op = 2 then 0.5D end as per_run", "p_size"
    rows = table(s, d, "part").withColumn("op", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter("op <= 2 or p_size % 2 = 0").selectExpr(*plans, *prices)
    return ops.cost_estimate(rows)


BOOK.add(
    "cost_estimate",
    estimated,
    """WITH x AS (SELECT *, 86400 / (p_size * 60) AS per_day, CASE WHEN p_size % 5 > 0 THEN floor(p_size * 10 * 1.5 + 0.5) END AS res, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS ops FROM part, (SELECT unnest([1, 2, 3]) AS op) WHERE op <= 2 OR p_size % 2 = 0),
      y AS (SELECT p_partkey, op, p_size, (p_size % 3 + 1) * per_day AS runs, (p_size % 4 + op) * per_day * CASE WHEN op = 1 THEN 2 ELSE 1 END AS req, res, ops FROM x)
      SELECT p_partkey AS plan_id, floor(sum(req) + 0.5)::BIGINT AS requests, floor(sum(runs) + 0.5)::BIGINT AS runs, max(res)::BIGINT AS results,
      CASE WHEN bool_and(op < 3 OR p_size % 7 > 0) THEN floor(sum(CASE WHEN op = 1 THEN req * 0.25 ELSE 0 END + CASE WHEN op = 2 THEN runs * 0.5 ELSE 0 END + coalesce(res / ops * CASE WHEN p_size % 7 > 0 THEN 2.0 ELSE 0 END / 1000, 0)) * 100 + 0.5) / 100 END AS usd FROM y GROUP BY p_partkey""",
)
BOOK.add(
    "empty_streak",
    lambda s, d: ops.empty_streak(runs(s, d).withColumn("new", F.when(F.col("run_id") % 4 == 0, F.col("results")).otherwise(0)), ["plan_id"], F.desc("run_id"), "new"),
    f"WITH {R}, x AS (SELECT plan_id, row_number() OVER w AS rn, max((CASE WHEN run_id % 4 = 0 THEN results ELSE 0 END > 0)::INT) OVER (PARTITION BY plan_id ORDER BY run_id DESC ROWS UNBOUNDED PRECEDING) AS seen FROM r WINDOW w AS (PARTITION BY plan_id ORDER BY run_id DESC)) SELECT plan_id, count(*) FILTER (seen = 0) AS streak FROM x WHERE rn <= 6 GROUP BY ALL",
)
BOOK.add(
    "adaptive_max_items",
    lambda s, d: ops.adaptive_most(runs(s, d).selectExpr("plan_id", "run_id", "results as items_new", "run_id % 4 * 10 as window_min", "case when run_id % 3 > 0 then 40 end as max_items"), ["plan_id"], F.desc("run_id"), 1800).select("plan_id", "samples", "max_items"),
    f"""WITH {R}, x AS (SELECT plan_id, run_id, results AS n, run_id % 4 * 10 AS win, CASE WHEN run_id % 3 > 0 THEN 40 END AS asked FROM r QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY run_id DESC) <= 6),
      y AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY run_id DESC) AS rn FROM x WHERE win > 0), g AS (SELECT plan_id, count(*) AS samples, sum(n) / sum(win) AS rate, max(CASE WHEN rn = 1 AND n >= 0.8 * asked THEN asked * 4 END) AS grown FROM y GROUP BY plan_id)
      SELECT plan_id, samples, (CASE WHEN samples < 2 THEN 300 ELSE least(300, greatest(5, ceil(3 * rate * 30.0), coalesce(grown, 0))) END)::BIGINT AS max_items FROM g""",
)
BOOK.add(
    "gap_topk",
    lambda s, d: ops.newest_gaps(runs(s, d).filter("status = 'failed'").selectExpr("plan_id", "run_id as gap_start", "run_id + results as gap_end"), ["plan_id"], 4).select("plan_id", F.array_join(F.transform("gaps", lambda g: F.concat_ws("-", g["gap_start"].cast("string"), g["gap_end"].cast("string"))), " ").alias("gaps")),
    f"WITH {R}, x AS (SELECT plan_id, run_id AS a, run_id + results AS b, row_number() OVER (PARTITION BY plan_id ORDER BY run_id + results DESC, run_id DESC) AS rn FROM r WHERE status = 'failed') SELECT plan_id, string_agg(a || '-' || b, ' ' ORDER BY a, b) AS gaps FROM x WHERE rn <= 4 GROUP BY ALL",
)
BOOK.add(
    "threshold_crossing",
    lambda s, d: ops.crossings(runs(s, d).select("plan_id", "run_id", "results"), ["plan_id"], ["run_id"], "results", 1000, [50, 80, 100], block=F.expr("run_id div 100")),
    f"WITH {R}, x AS (SELECT plan_id, run_id, results, sum(results) OVER (PARTITION BY plan_id ORDER BY run_id)::BIGINT AS used FROM r) SELECT plan_id, run_id, threshold::INT AS threshold, used FROM x, (SELECT unnest([50, 80, 100]) AS threshold) WHERE used - results < threshold * 10 AND used >= threshold * 10",
)
BOOK.add(
    "due_filter",
    lambda s, d: ops.due(runs(s, d).selectExpr("run_id as plan_id", "case when status = 'queued' then 'active' else 'paused' end as status", "finished_at as next_run_at"), attempts(s, d).filter("requests = 7").select(F.col("run_id").alias("plan_id")).distinct(), F.lit("1997-01-01").cast("timestamp"), 50).select("plan_id", "next_run_at"),
    f"WITH {R}, {A} SELECT run_id AS plan_id, finished_at::VARCHAR AS next_run_at FROM r WHERE status = 'queued' AND finished_at <= TIMESTAMP '1997-01-01' AND run_id NOT IN (SELECT run_id FROM a WHERE requests = 7) ORDER BY finished_at, run_id LIMIT 50",
)
BOOK.add(
    "as_of_policy",
    lambda s, d: ops.preferred(table(s, d, "customer").selectExpr("c_nationkey", "c_mktsegment", "case when c_custkey % 3 = 0 then concat('t', c_custkey) end as tenant_id", "c_custkey as created_at"), ["c_nationkey", "c_mktsegment"]).join(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"),
    "SELECT c_nationkey, c_mktsegment, tenant_id, created_at, n_name FROM (SELECT c_nationkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey END AS tenant_id, c_custkey AS created_at, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 3 <> 0, c_custkey) AS rn FROM customer) JOIN nation ON c_nationkey = n_nationkey WHERE rn = 1",
)
BOOK.add(
    "lateral_unnest",
    lambda s, d: relational.unnest_json(table(s, d, "events").withColumn("j", F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))), "j", "struct<k:int>", "x").groupBy("x.k").agg(F.count("*").alias("n")),
    "SELECT json_extract_string(props, '$.k')::INT AS k, 2 * count(*) AS n FROM events GROUP BY ALL",
)
BOOK.add("offset_page", lambda s, d: relational.page(table(s, d, "part"), [("p_size", "desc"), ("p_partkey", "asc")], 20, 40).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 40")
BOOK.add("deterministic_sample", lambda s, d: relational.hashed_sample(table(s, d, "documents"), "doc_id", 100).select("doc_id"), "SELECT doc_id FROM documents ORDER BY sha1(doc_id::VARCHAR), doc_id LIMIT 100")
BOOK.add(
    "merge_sorted",
    lambda s, d: relational.merge_sorted([table(s, d, "customer").selectExpr("c_name as name", "c_acctbal as bal"), table(s, d, "supplier").selectExpr("s_name as name", "s_acctbal as bal")], [("bal", "desc"), ("name", "asc")], 25),
    "SELECT * FROM (SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier) ORDER BY bal DESC, name LIMIT 25",
)
BOOK.add("compare_ids", lambda s, d: attempts(s, d).groupBy("connector").agg(F.max_by(F.col("run_id").cast("string"), values.compare_key(F.col("run_id").cast("string"))).alias("newest")), f"WITH {A} SELECT connector, max(run_id)::VARCHAR AS newest FROM a GROUP BY ALL")
BOOK.add("subset_test", lambda s, d: match_events(s, d).filter(relational.subset_of(F.col("issues"), F.array(*[F.lit(f"iss{i}") for i in range(6)]))).groupBy("platform").agg(F.count("*").alias("n")), f"WITH {EVENTS_SQL} SELECT platform, count(*) AS n FROM e WHERE len(list_filter(issues, lambda x: x NOT IN ('iss0', 'iss1', 'iss2', 'iss3', 'iss4', 'iss5'))) = 0 GROUP BY ALL")
BOOK.add("set_difference", lambda s, d: relational.without(table(s, d, "orders").select(F.col("o_orderkey").alias("id")), attempts(s, d).select(F.col("run_id").alias("id")), ["id"]), "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
BOOK.add("null_order", lambda s, d: match_events(s, d).select("geo_region_code").distinct().orderBy(*relational.ordering([("geo_region_code", "asc nulls last")])).limit(8), f"WITH {EVENTS_SQL} SELECT DISTINCT geo_region_code FROM e ORDER BY geo_region_code NULLS LAST LIMIT 8")

# numbers and times
BOOK.add(
    "scalar_rules",
    lambda s, d: table(s, d, "part").select(
        "p_partkey",
        values.backoff(F.col("p_size"), F.col("p_partkey") % 5 + 1).alias("backoff"),
        values.overlap(F.col("p_size") * 60).alias("overlap"),
        values.clamp_interval(F.col("p_size") * 100).alias("interval"),
        values.count_metric((F.col("p_retailprice") - 950).cast("string")).alias("metric"),
    ),
    """SELECT p_partkey, least(p_size * pow(2, p_partkey % 5), p_size * 4)::BIGINT AS backoff, greatest(60, floor(p_size * 12.0 + 0.5))::BIGINT AS overlap,
      CASE WHEN p_size * 100 <= 300 THEN 300 WHEN p_size * 100 <= 900 THEN 900 WHEN p_size * 100 <= 1800 THEN 1800 WHEN p_size * 100 <= 2700 THEN 2700 ELSE 3600 END AS interval,
      CASE WHEN p_retailprice - 950 >= 0 THEN floor(p_retailprice - 950) END::BIGINT AS metric FROM part""",
)
BOOK.add(
    "period_info",
    lambda s, d: table(s, d, "events").select("event_id", *[values.period_start(F.col("ts").cast("timestamp"), "Asia/Jakarta", u).alias(u) for u in ("day", "month")]),
    "SELECT event_id, (date_trunc('day', ts + INTERVAL 7 HOUR) - INTERVAL 7 HOUR)::VARCHAR AS day, (date_trunc('month', ts + INTERVAL 7 HOUR)::TIMESTAMP - INTERVAL 7 HOUR)::VARCHAR AS month FROM events",
)
CLASSIC = "concat('Wed ', date_format(ts, 'MMM dd HH:mm:ss'), ' +0700 ', date_format(ts, 'yyyy'))"
BOOK.add(
    "to_utc_iso",
    lambda s, d: table(s, d, "events").selectExpr("event_id", f"case event_id % 5 when 0 then {CLASSIC} when 1 then cast(unix_timestamp(cast(ts as timestamp)) as string) when 2 then cast(unix_timestamp(cast(ts as timestamp)) * 1000 as string) when 3 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+07:00'\") else '2 hours ago' end as raw").select("event_id", values.to_utc(F.col("raw")).alias("at")),
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN (date_trunc('second', ts) - INTERVAL 7 HOUR)::VARCHAR WHEN 3 THEN (date_trunc('second', ts) - INTERVAL 7 HOUR)::VARCHAR WHEN 4 THEN NULL ELSE date_trunc('second', ts)::VARCHAR END AS at FROM events",
)
BOOK.add(
    "first_valid_time",
    lambda s, d: table(s, d, "events").selectExpr("event_id", "case when event_id % 3 > 0 then 'soon' when event_id % 2 = 0 then cast(unix_timestamp(cast(ts as timestamp)) as string) end as a", "case when event_id % 5 > 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end as b").select("event_id", values.first_time(F.col("a"), F.col("b")).alias("at")),
    "SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 5 > 0 THEN date_trunc('second', ts)::VARCHAR END AS at FROM events",
)

# alerts, at a time within the data
NOW = datetime(2024, 1, 20, 12, 30)
T1H = f"h AS ({AGG_SQL['agg_topic_1h']})"


def hourly(s, d, name="agg_topic_1h"):
    return aggregates.build(match_events(s, d), name)


BOOK.add("alert_negative_ratio", lambda s, d: ops.negative_ratio(hourly(s, d), F.lit(NOW), 24, 5, 30), f"WITH {EVENTS_SQL}, {T1H}, g AS (SELECT tenant_id, topic_id, sum(posts)::BIGINT AS posts, sum(CASE WHEN sentiment = 'negative' THEN posts ELSE 0 END)::BIGINT AS negative FROM h WHERE bucket BETWEEN TIMESTAMP '2024-01-19 12:00' AND TIMESTAMP '{NOW}' GROUP BY ALL) SELECT *, floor(negative * 100 / posts * 10 + 0.5) / 10 AS negative_pct FROM g WHERE posts >= 5 AND floor(negative * 100 / posts * 10 + 0.5) / 10 >= 30")
BOOK.add(
    "alert_volume_spike",
    lambda s, d: ops.volume_spike(hourly(s, d), F.lit(NOW), 12, 5, 1.1),
    f"WITH {EVENTS_SQL}, {T1H}, g AS (SELECT tenant_id, topic_id, sum(posts) FILTER (bucket >= TIMESTAMP '2024-01-20 00:00')::BIGINT AS posts, sum(posts) FILTER (bucket < TIMESTAMP '2024-01-20 00:00') AS before FROM h WHERE bucket BETWEEN TIMESTAMP '2024-01-13 00:00' AND TIMESTAMP '{NOW}' GROUP BY ALL) SELECT tenant_id, topic_id, posts, floor(before / 14 * 10 + 0.5) / 10 AS baseline, floor(posts / greatest(before / 14, 1) * 10 + 0.5) / 10 AS factor FROM g WHERE posts >= 5 AND posts >= 1.1 * greatest(before / 14, 1)",
)
BOOK.add(
    "alert_new_issue",
    lambda s, d: ops.new_issues(hourly(s, d, "agg_issue_1h").withColumn("issue", F.concat_ws("-", "issue", "platform", F.hour("bucket"))), F.lit(NOW), 6, 1),
    f"WITH {EVENTS_SQL}, h AS ({AGG_SQL['agg_issue_1h']}), g AS (SELECT tenant_id, topic_id, issue || '-' || platform || '-' || hour(bucket) AS issue, sum(CASE WHEN bucket >= TIMESTAMP '2024-01-20 06:00' THEN mentions ELSE 0 END)::BIGINT AS mentions, sum(CASE WHEN bucket < TIMESTAMP '2024-01-20 06:00' THEN mentions ELSE 0 END) AS before FROM h WHERE bucket BETWEEN TIMESTAMP '2024-01-13 06:00' AND TIMESTAMP '{NOW}' GROUP BY ALL) SELECT tenant_id, topic_id, issue, mentions FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, topic_id ORDER BY mentions DESC, issue) AS rn FROM g WHERE mentions >= 1 AND before = 0) WHERE rn <= 5",
)
BOOK.add(
    "alert_cooldown",
    lambda s, d: ops.cooled_down(table(s, d, "customer").selectExpr("c_custkey as rule_id", "c_nationkey * 100 as cooldown_min"), table(s, d, "events").selectExpr("user_id as rule_id", "cast(ts as timestamp) as fired_at"), F.lit("2024-01-31").cast("timestamp")),
    "SELECT c_custkey AS rule_id, c_nationkey * 100 AS cooldown_min FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND ts > TIMESTAMP '2024-01-31' - INTERVAL 1 MINUTE * (c_nationkey * 100))",
)

# evaluation: the label of quality against a rule of thumb
PAIRS = "pairs AS (SELECT doc_id AS id, lang AS stratum, quality::VARCHAR AS gold, (n_chars % 3 > 0)::INT::VARCHAR AS pred, (n_chars % 11) / 10 AS confidence FROM labels JOIN documents USING (doc_id))"


def pairs(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.selectExpr("doc_id as id", "lang as stratum", "cast(quality as string) as gold", "cast(cast(n_chars % 3 > 0 as int) as string) as pred", "(n_chars % 11) / 10 as confidence")


CLASS_SQL = "c AS (SELECT label, sum(g)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM (SELECT gold AS label, 1 AS g, 0 AS p, (gold = pred)::INT AS h FROM pairs UNION ALL SELECT pred, 0, 1, 0 FROM pairs) GROUP BY ALL), f AS (SELECT label, support, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS \"precision\", CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall, CASE WHEN hits > 0 THEN 2.0::DOUBLE * hits / (support + predicted) ELSE 0.0 END AS f1 FROM c)"
BOOK.add("confusion", lambda s, d: evalkit.confusion(pairs(s, d)), f"WITH {PAIRS} SELECT gold, pred, count(*) AS n FROM pairs GROUP BY ALL")
BOOK.add("per_class", lambda s, d: evalkit.per_class(pairs(s, d)), f"WITH {PAIRS}, {CLASS_SQL} SELECT * FROM f")
r9 = lambda df: df.select(*[F.floor(F.col(c) * 1e9 + 0.5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
N9 = "floor({} * 1e9 + 0.5)::BIGINT"
BOOK.add("macro_f1", lambda s, d: r9(evalkit.macro_f1(pairs(s, d))), f"WITH {PAIRS}, {CLASS_SQL} SELECT {N9.format('avg(f1)')} AS macro_f1 FROM f WHERE support > 0")
BOOK.add("accuracy", lambda s, d: r9(evalkit.accuracy(pairs(s, d))), f"WITH {PAIRS} SELECT {N9.format('avg((gold = pred)::INT)')} AS accuracy, count(*) FILTER (pred IS NULL) AS missing FROM pairs")
BOOK.add(
    "cohen_kappa",
    lambda s, d: r9(evalkit.cohen_kappa(pairs(s, d))),
    f"WITH {PAIRS}, pe AS (SELECT sum(x * y) AS xy FROM (SELECT gold AS l, count(*) AS x FROM pairs GROUP BY ALL) JOIN (SELECT pred AS l, count(*) AS y FROM pairs GROUP BY ALL) USING (l)), k AS (SELECT avg((gold = pred)::INT) AS po, (SELECT xy FROM pe) / (count(*) * count(*)) AS pe FROM pairs) SELECT {N9.format('(po - pe) / (1 - pe)')} AS kappa FROM k",
)
BOOK.add("ece", lambda s, d: r9(evalkit.ece(pairs(s, d))), f"WITH {PAIRS}, b AS (SELECT greatest(ceil(confidence * 10) - 1, 0) AS bin, count(*) AS n, avg(confidence) AS c, avg((gold = pred)::INT) AS a FROM pairs GROUP BY ALL) SELECT {N9.format('(sum(n * abs(c - a)) / sum(n))')} AS ece FROM b")
BOOK.add("coverage_curve", lambda s, d: evalkit.coverage_curve(pairs(s, d), [0.25, 0.5, 0.75]), f"WITH {PAIRS} SELECT t::DOUBLE AS tau, count(*) FILTER (confidence >= t) / count(*) AS coverage, coalesce(count(*) FILTER (confidence >= t AND gold = pred) / nullif(count(*) FILTER (confidence >= t), 0), 0.0) AS accuracy, 1 - count(*) FILTER (confidence >= t) / count(*) AS to_llm_pct FROM pairs, (SELECT unnest([0.25, 0.5, 0.75]) AS t) GROUP BY t")
BOOK.add(
    "stratified_sample",
    lambda s, d: evalkit.stratified_sample(pairs(s, d), "stratum", "id", 200, 20).select("id", "stratum"),
    f"WITH {PAIRS}, c AS (SELECT stratum, count(*) AS c FROM pairs GROUP BY ALL), k AS (SELECT stratum, least(c, greatest(20, round_even(200 * c / (SELECT sum(c) FROM c), 0))) AS k FROM c) SELECT id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha1(id::VARCHAR), id) AS rn FROM pairs) JOIN k USING (stratum) WHERE rn <= k",
)
BOOK.add("frozen_split", lambda s, d: pairs(s, d).select("id", evalkit.frozen_split(F.col("id")).alias("split")), f"WITH {PAIRS} SELECT id, CASE WHEN ('0x' || substr(sha1(id::VARCHAR), 1, 8))::BIGINT % 100 < 50 THEN 'dev' ELSE 'test' END AS split FROM pairs")
BOOK.add("merge_annotators", lambda s, d: evalkit.merge_annotators(pairs(s, d).selectExpr("id", "gold as label"), pairs(s, d).selectExpr("id", "pred as label")), f"WITH {PAIRS} SELECT id, CASE WHEN gold = pred THEN gold END AS label, CASE WHEN gold = pred THEN 'agreed' ELSE 'adjudicate' END AS status FROM pairs")
PARTS = [f"({BOOK.oracles[n]})" for n in ("macro_f1", "accuracy", "cohen_kappa", "ece")]
BOOK.add("evaluate", lambda s, d: r9(evalkit.evaluate(pairs(s, d))), f"SELECT * FROM {', '.join(PARTS)}, (WITH {PAIRS} SELECT {N9.format('(count(*) FILTER (confidence >= 0.5) / count(*))')} AS coverage FROM pairs)")
