"""Walks of nested objects, quantiles of histograms, manifests, retention, needles, shared streams and long place names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.book import Book
from tidemark.functions.text import upper_each
from tidemark.operators import analytics, enrich, ops, sharing, upkeep
from tidemark.sources import items
from tidemark.sources.store import fresh_path, spread, table

BOOK = Book()

# objects at one to ten levels, in objects and lists by turns; some lack a key, some stand in one that was found
NESTED = """concat('[', repeat('{"x":[', event_id % 6), '{"aid":"', user_id, '","t":1,"d":null,"in":{"aid":"inner","t":1,"d":1}}', repeat(']}', event_id % 6),
  ',{"aid":', event_id % 9, ',"t":0,"d":""},{"aid":"half', event_id % 3, '","t":1},{"aid":"","t":1,"d":1},{"aid":{"t":1,"d":1},"t":1,"d":{"aid":"', event_type, '","t":null,"d":2}}]')"""
BOOK.add(
    "collect_any_depth",
    lambda s, d: items.collected_deep(table(s, d, "events").selectExpr(f"parse_json({NESTED}) as v"), "v", "aid", ["t", "d"]).select("id"),
    "SELECT DISTINCT user_id::VARCHAR AS id FROM events UNION SELECT (event_id % 9)::VARCHAR FROM events UNION SELECT event_type FROM events",
)

# counters: one series per connector and bound, read at each line item, begun anew now and then
BOUNDS = "10, 20, 30, 40"
COUNTER = "l_suppkey % 10 AS connector, l_orderkey * 10 + l_linenumber AS moment"


def counted(s, d):
    """(connector, le, increase): what each bound's counter grew by; one sample reads the counters of all bounds."""
    bounds = [*BOUNDS.split(", "), "infinity"]
    rows = table(s, d, "lineitem").selectExpr("l_suppkey % 10 as connector", "l_orderkey * 10 + l_linenumber as at", "l_orderkey div 500 as block", *(f"l_partkey % 500 * {i} as n{i}" for i, _ in enumerate(bounds, 1)))
    totals = ops.increase_totals(rows, ["connector"], "at", [f"n{i}" for i, _ in enumerate(bounds, 1)], F.col("block"))
    each = F.array(*(F.struct(F.lit(b).cast("double").alias("le"), F.col(f"n{i}").alias("increase")) for i, b in enumerate(bounds, 1)))
    return totals.select("connector", F.inline(each))


SAMPLES = f"""x AS (SELECT {COUNTER}, unnest([{{'le': 10.0::DOUBLE, 'k': 1}}, {{'le': 20, 'k': 2}}, {{'le': 30, 'k': 3}}, {{'le': 40, 'k': 4}}, {{'le': 'inf'::DOUBLE, 'k': 5}}]) AS b, l_partkey % 500 AS v FROM lineitem),
  g AS (SELECT connector, b.le AS le, v * b.k AS n, lag(v * b.k) OVER (PARTITION BY connector, b.le ORDER BY moment, v * b.k) AS p FROM x),
  h AS (SELECT connector, le, sum(CASE WHEN p IS NULL THEN 0 WHEN n < p THEN n ELSE n - p END)::DOUBLE AS c FROM g GROUP BY ALL)"""
BOOK.add(
    "counter_increase",
    lambda s, d: counted(s, d).select("connector", "le", F.col("increase").cast("double").alias("c")),
    f"WITH {SAMPLES} SELECT * FROM h",
)
BOOK.add(
    "histogram_quantile",
    lambda s, d: ops.histogram_quantile(counted(s, d), ["connector"], "le", "increase", 0.55).select("connector", "n", F.floor(F.col("quantile") * 1e6 + 0.5).alias("micro")),
    f"""WITH {SAMPLES}, r AS (SELECT *, max(c) FILTER (le = 'inf'::DOUBLE) OVER w * 0.55 AS rank, max(c) FILTER (le = 'inf'::DOUBLE) OVER w AS n, lag(le, 1, 0) OVER o AS low, lag(c, 1, 0) OVER o AS under FROM h WINDOW w AS (PARTITION BY connector), o AS (PARTITION BY connector ORDER BY le)),
      f AS (SELECT connector, n, rank, arg_min({{'le': le, 'c': c, 'low': low, 'under': under}}, le) AS b FROM r WHERE c >= rank GROUP BY ALL)
      SELECT connector, n, CASE WHEN n > 0 THEN floor(CASE WHEN b.le = 'inf'::DOUBLE THEN 40 ELSE b.low + (b.le - b.low) * (rank - b.under) / (b.c - b.under) END * 1e6 + 0.5)::BIGINT END AS micro FROM f""",
)


# a table restored with rows lost, doubled and changed
def verified(s, d):
    orders = table(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    ym, third = F.date_format("o_orderdate", "yyyyMM"), F.col("o_orderkey") % 3 == 0
    found = orders.filter(~((ym == "199502") & third))
    found = found.unionByName(orders.filter((ym == "199603") & third))
    found = found.withColumn("o_totalprice", F.col("o_totalprice") + F.when((ym == "199704") & third, 1).otherwise(0))
    swapped = F.when((ym == "199805") & third, F.col("o_custkey") + 1).when((ym == "199805") & (F.col("o_orderkey") % 3 == 1), F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    path = fresh_path(s, "restored")
    found.withColumn("o_custkey", swapped).repartition(5).write.parquet(path)
    return upkeep.compared(upkeep.manifest(orders, "orders", "o_orderdate"), upkeep.manifest(s.read.parquet(path), "orders", "o_orderdate"))


BOOK.add(
    "backup_manifest",
    verified,
    """SELECT 'orders' AS "table", strftime(o_orderdate, '%Y%m') AS ym, count(*) AS saved, count(*) + CASE ym WHEN '199502' THEN -1 WHEN '199603' THEN 1 ELSE 0 END * count(*) FILTER (o_orderkey % 3 = 0) AS found,
      CASE WHEN ym = '199502' AND bool_or(o_orderkey % 3 = 0) THEN 'lost' WHEN ym = '199603' AND bool_or(o_orderkey % 3 = 0) THEN 'extra' WHEN ym = '199704' AND bool_or(o_orderkey % 3 = 0) THEN 'changed' WHEN ym = '199805' AND bool_or(o_orderkey % 3 < 2) THEN 'changed' ELSE 'same' END AS status
      FROM orders GROUP BY ym""",
)

# retention by rewriting: orders by month and tenant
NOW = datetime(1998, 7, 15, 6)
OLD_ORDER = "tenant_id string, o_orderkey bigint, published_at timestamp"


def purged(s, d):
    path = fresh_path(s, "retained")
    rows = table(s, d, "orders").selectExpr("concat('t', o_custkey % 4) as tenant_id", "o_orderkey", "cast(o_orderdate as timestamp) as published_at").withColumn("ym", F.date_format("published_at", "yyyyMM").cast("int"))
    rows.hint("rebalance", "ym").write.partitionBy("ym").parquet(path)
    tenants = s.createDataFrame([("t0", 90), ("t1", 10), ("t2", 800)], "tenant_id string, days int")
    upkeep.purge_table(s, path, ["ym"], OLD_ORDER, "published_at", NOW, most_days=400, tenants=tenants)
    return s.read.schema(f"{OLD_ORDER}, ym int").parquet(path).groupBy("tenant_id", "ym").agg(F.count("*").alias("n"), F.min("published_at").alias("oldest"))


BOOK.add(
    "retention_rewrite",
    purged,
    f"SELECT 't' || o_custkey % 4 AS tenant_id, strftime(o_orderdate, '%Y%m')::INT AS ym, count(*) AS n, min(o_orderdate)::VARCHAR AS oldest FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY * (CASE o_custkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 30 ELSE 400 END) GROUP BY ALL",
)


# many needles against whole texts
NEEDLE = "CASE WHEN item_id % 5 = 0 THEN substr(text, 1, 2) WHEN item_id % 5 = 1 THEN upper(substr(text, 3, 9)) ELSE substr(text, 5, 20) END"


def needled(s, d):
    needle = F.when(F.expr("item_id % 5 = 0"), F.expr("substr(text, 1, 2)")).when(F.expr("item_id % 5 = 1"), upper_each(F.expr("substr(text, 3, 9)"))).otherwise(F.expr("substr(text, 5, 20)"))
    needles = table(s, d, "benchmark").select(needle.alias("needle"))
    return analytics.needle_hits(spread(table(s, d, "documents").select("doc_id", "text")), needles, ["doc_id"])


BOOK.add("needle_hits", needled, f"SELECT doc_id, needle FROM documents JOIN (SELECT DISTINCT lower({NEEDLE}) AS needle FROM benchmark) ON contains(lower(text), needle) WHERE needle <> ''")

# plans whose queries share terms
CLASSES = (300, 900, 3600)
PLAN = f"""c_custkey AS plan_id, 'p' || c_nationkey % 2 AS platform, 'search' AS operation, 't' || c_custkey % 5 AS tenant_id, c_custkey % 5 = 0 AS own_account,
  CASE c_custkey % 3 WHEN 0 THEN {CLASSES[0]} WHEN 1 THEN {CLASSES[1]} ELSE {CLASSES[2]} END AS interval_s"""
TERMS = ["'w' || (c_custkey * 7919 + c_nationkey) % 300", "'w' || (c_custkey * 31 + 7) % 300"]


def plan_rows(s, d):
    one, two = (t.replace("'w' || ", "concat('w', ") + ")" for t in TERMS)
    plan = PLAN.replace("'p' || c_nationkey % 2", "concat('p', c_nationkey % 2)").replace("'t' || c_custkey % 5", "concat('t', c_custkey % 5)")
    terms = F.expr(f"case when c_custkey % 7 = 0 then null when c_custkey % 4 = 0 then array({one}) else array({one}, {two}) end")
    return table(s, d, "customer").select(F.expr(f"struct({plan})").alias("p"), terms.alias("terms")).select("p.*", "terms")


def sharing_sql() -> str:
    parts = [
        f"""p AS (SELECT {PLAN}, CASE WHEN c_custkey % 4 = 0 THEN [{TERMS[0]}] ELSE list_distinct([{', '.join(TERMS)}]) END AS terms FROM customer WHERE c_custkey % 7 <> 0),
        t AS (SELECT plan_id, interval_s, platform || '|' || operation || '|' || CASE WHEN own_account THEN tenant_id ELSE '*' END AS g, len(terms) AS need, unnest(terms) AS term FROM p)"""
    ]
    for i, c in enumerate(CLASSES):
        faster = " UNION ALL ".join(f"SELECT stream, {CLASSES[j]} AS every, g, term FROM s{j}" for j in range(i)) or "SELECT '' AS stream, 0 AS every, '' AS g, '' AS term WHERE false"
        parts.append(f"""
        r{i} AS (SELECT plan_id, min({{'e': every, 's': stream}}) AS st FROM (SELECT plan_id, stream, every FROM t JOIN ({faster}) f USING (g, term) WHERE interval_s = {c} GROUP BY plan_id, stream, every, need HAVING count(*) = need) GROUP BY plan_id),
        m{i} AS (SELECT * FROM t WHERE interval_s = {c} AND plan_id NOT IN (SELECT plan_id FROM r{i})),
        e{i} AS (SELECT DISTINCT a.plan_id AS a, b.plan_id AS b FROM m{i} a JOIN m{i} b USING (g, term)),
        c{i} AS (SELECT plan_id AS n, plan_id AS c FROM m{i} UNION SELECT e.b, c.c FROM c{i} c JOIN e{i} e ON e.a = c.n WHERE c.c < e.b),
        k{i} AS (SELECT n AS plan_id, min(c) AS c FROM c{i} GROUP BY n),
        s{i} AS (SELECT g || '|{c}|' || c AS stream, g, c, term FROM m{i} JOIN k{i} USING (plan_id) WHERE c IN (SELECT c FROM k{i} GROUP BY c HAVING count(*) > 1) GROUP BY g, c, term)""")
    rows = " UNION ALL ".join(
        f"SELECT plan_id, st.s AS stream, st.e AS stream_interval_s, true AS rides FROM r{i} UNION ALL SELECT plan_id, stream, {c}, false FROM k{i} JOIN (SELECT DISTINCT stream, c FROM s{i}) USING (c)" for i, c in enumerate(CLASSES)
    )
    return f"WITH RECURSIVE {', '.join(parts)} {rows}"


BOOK.add("shared_streams", lambda s, d: sharing.shared(plan_rows(s, d)), sharing_sql())

# place names of one to twelve words, each also within a longer one
LONG = "array_join(transform(sequence(1, n_nationkey % 12 + 1), i -> concat('kota', n_nationkey div 12, 'x', i)), ' ')"


def long_names(s, d):
    names = table(s, d, "nation").selectExpr("cast(n_nationkey as string) as code", f"{LONG} as name", "cast(null as array<string>) as aliases")
    people = table(s, d, "customer").join(table(s, d, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr("c_custkey as id", f"case when c_custkey % 3 = 0 then upper({LONG}) end as place", f"case c_custkey % 4 when 0 then {LONG} when 1 then concat('Saya tinggal di ', {LONG}, ', raya') when 2 then concat('kota', n_nationkey div 12, 'x2') end as profile")
    return enrich.infer_region(people, names, key=["id"], place="place", profile="profile")


BOOK.add(
    "geo_long_names",
    long_names,
    "SELECT c_custkey AS id, c_nationkey::VARCHAR AS region, CASE WHEN c_custkey % 3 = 0 THEN 0.8 WHEN c_custkey % 4 = 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 < 2",
)
