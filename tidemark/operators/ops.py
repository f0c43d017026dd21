"""Operational reports: usage, cost, run health, pacing, quotas and thresholds, as aggregations and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.analytics import rounded
from tidemark.operators.state import top_n_per_key

#: Cost is split to this many decimals.
COST_SCALE = 9


def usage(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, requests, results, cost and successes per group."""
    return attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.sum("requests").alias("requests"),
        F.sum("results").alias("results"),
        F.sum("cost").alias("cost"),
        F.count_if(F.col("status") == "success").alias("successes"),
    )


def usage_by_tenant(direct: DataFrame, allocated: DataFrame) -> DataFrame:
    """Direct attempts and costs allocated from shared runs, added up."""
    both = direct.select("tenant_id", "cost").unionByName(allocated.select("tenant_id", "cost"))
    return both.groupBy("tenant_id").agg(F.count("*").alias("rows"), F.sum("cost").alias("cost"))


def crawl_monitor(runs: DataFrame, by: list[str], states: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in states]
    return runs.groupBy(*by).agg(F.count("*").alias("total"), *counts, F.sum("results").alias("new"), F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"))


def recent_failures(runs: DataFrame, dims: list[tuple[DataFrame, str]], k: int = 30) -> DataFrame:
    """The newest failures with what the dimensions say of them: the limit stands below the joins."""
    out = runs.filter(F.col("status") == "failed").orderBy(F.desc("finished_at"), "run_id").limit(k)
    for dim, key in dims:
        out = out.join(dim, key, "left")
    return out.withColumn("message", F.substring("message", 1, 300))


def failure_report(runs: DataFrame, plans: DataFrame, streams: DataFrame, topics: DataFrame, tenants: DataFrame, connectors: DataFrame, since: Column, k: int = 30) -> DataFrame:
    """The newest failures since then with platform (of the plan, else of the shared stream), topic, tenant and connector; the limit stands below the five joins."""
    own = runs.filter((F.col("status") == "failed") & (F.col("scheduled_for") >= since)).orderBy(F.desc("scheduled_for"), "run_id").limit(k)
    out = own.join(plans.select("plan_id", F.col("platform").alias("_p"), "topic_id"), "plan_id", "left").join(streams.select("stream_id", F.col("platform").alias("_s")), "stream_id", "left")
    out = out.join(topics.select("topic_id", "topic_name"), "topic_id", "left").join(tenants.select("tenant_id", "tenant_name"), "tenant_id", "left").join(connectors.select("connector_id", "connector"), "connector_id", "left")
    shown = ["run_id", "scheduled_for", "kind", F.coalesce("_p", "_s").alias("platform"), "error_code", F.substring("message", 1, 300).alias("message"), "connector", "topic_name", "tenant_name"]
    return out.select(*shown).orderBy(F.desc("scheduled_for"), "run_id")


def counts_by_state(rows: DataFrame, by: list[str], state: str) -> DataFrame:
    """A map of state to count per group."""
    one = rows.groupBy(*by, state).agg(F.count("*").alias("n"))
    return one.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(state), F.col("n"))))).alias("by_state"))


def grouped_names(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Count and sorted distinct names per group; null names don't count."""
    return rows.groupBy(by).agg(F.count(name).alias("n"), F.sort_array(F.collect_set(name)).alias("names"))


def user_offices(users: DataFrame, members: DataFrame, offices: DataFrame) -> DataFrame:
    """Users but operators, each with its offices and roles there by the office's name; those without any have an empty list."""
    there = offices.filter("kind = 'office' and deleted_at is null").select("tenant_id", "name")
    own = members.join(there, "tenant_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("name", "tenant_id", "role"))).alias("offices"))
    out = users.filter(~F.col("is_operator")).join(own, "user_id", "left")
    return out.withColumn("offices", F.coalesce("offices", F.array().cast("array<struct<name:string,tenant_id:string,role:string>>")))


def searched(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column holds the text, in either case; its wildcards are plain characters."""
    plain = "".join("\\" + c if c in "\\%_" else c for c in text)
    return rows.filter(F.col(column).ilike(f"%{plain}%"))


def recent_by_status(runs: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    since = now - F.make_interval(hours=F.lit(hours))
    return runs.filter(F.col("scheduled_for") >= since).groupBy("platform", "status").agg(F.count("*").alias("n"))


def oldest_waiting(outbox: DataFrame, now: Column) -> DataFrame:
    """How many rows wait to be sent, and for how many seconds the oldest does."""
    waiting = outbox.filter("published_at is null")
    return waiting.agg(F.count("*").alias("n"), F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(F.min("created_at")), F.lit(0)).alias("age_s"))


def error_ratio(requests: DataFrame, by: list[str], most: float = 0.02) -> DataFrame:
    """Groups of requests of which more than that share failed on the server's side."""
    rows = requests.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.col("code").between(500, 599)).alias("errors"))
    return rows.filter(F.col("errors") > most * F.col("requests"))


def state_metrics(runs: DataFrame, now: Column) -> DataFrame:
    since = F.max(F.when(F.col("status") == "success", F.col("finished_at")))
    return runs.groupBy("platform").agg(F.count("*").alias("runs"), (F.unix_timestamp(now) - F.unix_timestamp(since)).alias("success_age_s"))


def cost_guard(policies: DataFrame, spent: DataFrame) -> DataFrame:
    """Policies with what was used of them in their period; breached from the limit on."""
    used = spent.groupBy("tenant_id", "period").agg(F.sum("cost").alias("used"))
    out = policies.join(used, ["tenant_id", "period"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.withColumn("breached", F.col("used") >= F.col("most"))


def period_start(now: Column, period: Column, zone: Column) -> Column:
    """The first day of the day or month that it is in a time zone."""
    local = F.from_utc_timestamp(now, zone)
    return F.when(period == "day", F.to_date(local)).otherwise(F.to_date(F.date_trunc("month", local)))


def soft_caps(policies: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """Enabled soft policies with what was used of their current period, as their own time zone has it, and what changes: ``throttled`` or ``released``.

    ``policies``: policy_id, scope_type, scope_id (null: everything), period, unit, most, reset_tz, enabled, hard,
    throttled_since. ``usage``: scope_type, scope_id, period, unit, period_start, used.
    """
    own = policies.filter(F.col("enabled") & ~F.col("hard")).withColumn("period_start", period_start(now, F.col("period"), F.col("reset_tz")))
    own = own.withColumn("_scope", F.coalesce("scope_id", F.lit("*")))
    used = usage.select("scope_type", F.coalesce("scope_id", F.lit("*")).alias("_scope"), "period", "unit", "period_start", "used")
    out = own.join(used, ["scope_type", "_scope", "period", "unit", "period_start"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    out = out.withColumn("breached", F.col("used") >= F.col("most"))
    change = F.when(F.col("breached") & F.col("throttled_since").isNull(), "throttled").when(~F.col("breached") & F.col("throttled_since").isNotNull(), "released")
    return out.withColumn("change", change).drop("_scope")


def allocate(runs: DataFrame, weights: DataFrame, amounts: list[str]) -> DataFrame:
    """(run_id, tenant_id, matches, basis, amounts): what a run used, by its tenants' matches.

    Tenants without matches get nothing where others have some; where none has any, all get the same (``even_split``).
    The last tenant by name takes what rounding leaves. Amounts that are decimals (below 1e11, as are matches below 1e9) are
    shared out as such, so that their sums are the same in any order.
    """
    exact = {c for c, t in runs.dtypes if t.startswith("decimal")}
    w = Window.partitionBy("run_id")  # the tenants of one run
    both = runs.join(weights, "run_id").withColumn("all", F.sum("matches").over(w)).filter((F.col("matches") > 0) | (F.col("all") <= 0))
    even = F.col("all") <= 0
    both = both.withColumns({"n": F.when(even, 1).otherwise(F.col("matches")), "basis": F.when(even, "even_split").otherwise("matches")}).withColumn("total", F.sum("n").over(w))
    order, last = w.orderBy("tenant_id"), F.row_number().over(w.orderBy(F.desc("tenant_id"))) == 1
    for c in amounts:
        share = F.expr(f"cast(cast({c} as decimal(20, {COST_SCALE})) * cast(n as decimal(9, 0)) as decimal(28, {COST_SCALE})) / cast(total as decimal(9, 0))") if c in exact else F.col(c) * F.col("n") / F.col("total")
        both = both.withColumn(f"part_{c}", F.round(share, COST_SCALE))
    out = []
    for c in amounts:
        before = F.coalesce(F.sum(f"part_{c}").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = before.cast(f"decimal(20, {COST_SCALE})") if c in exact else before
        out.append(F.round(F.when(last, F.col(c) - before).otherwise(F.col(f"part_{c}")), COST_SCALE).alias(c))
    return both.select("run_id", "tenant_id", F.when(even, 0).otherwise(F.col("matches")).alias("matches"), "basis", *out)


def merge_maps(a: Column, b: Column) -> Column:
    """Two maps of counts, added up by key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1")


def health(attempts: DataFrame, by: list[str], reference_ms: float) -> DataFrame:
    """Success rate, nearest-rank p95 of successes, the score 100 * rate * min(1, 2 * reference / p95), and a label: unknown without attempts, unhealthy below 40, degraded below 80."""
    ran = F.col("status").isNotNull()
    rows = attempts.groupBy(*by).agg(
        F.count_if(ran).alias("n"),
        F.avg(F.when(ran, (F.col("status") == "success").cast("int"))).alias("rate"),
        F.expr("percentile_disc(0.95) within group (order by latency) filter (where status = 'success')").alias("p95"),
    )
    slow = F.when(F.col("p95") > 0, F.least(F.lit(1.0), 2 * F.lit(reference_ms) / F.col("p95"))).otherwise(1.0)
    rows = rows.withColumn("score", F.floor(100 * F.col("rate") * slow + 0.5).cast("long"))
    label = F.when(F.col("score").isNull(), "unknown").when(F.col("score") < 40, "unhealthy").when(F.col("score") >= 80, "healthy").otherwise("degraded")
    return rows.withColumn("label", label)


def percentiles(rows: DataFrame, value: str, by: list[str], points: list[int]) -> DataFrame:
    """The values at place floor(p / 100 * n) from 0, the last at most: of n sorted values the first with more than that many at or before it."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("many"))  # equal values together, so that a window holds distinct ones
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"n": F.sum("many").over(w), "upto": F.sum("many").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n") / 100))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p}") for p in points])


def histogram(rows: DataFrame, value: str, by: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative counts below each bound, count and sum."""
    below = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*by).agg(*below, F.count("*").alias("count"), F.sum(value).alias("sum"))


def increases(samples: DataFrame, series: list[str], at: str, value: str, block: Column) -> DataFrame:
    """``samples`` with ``increase``: how much a counter grew since the sample before it; after a reset it began at 0. A series' first sample grew by nothing.

    ``block`` never falls along a series (a day, say): samples are put in order within blocks, and a block's first one
    takes the last value of the block before, so that no series is in one task as a whole. Of samples at one time the
    smaller value comes first.
    """
    rows = samples.withColumn("_block", block)
    inside = Window.partitionBy(*series, "_block").orderBy(at, value)
    rows = rows.withColumn("_before", F.lag(value).over(inside))
    ends = rows.groupBy(*series, "_block").agg(F.max(F.struct(at, value))[value].alias("_last"))
    blocks = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*series).orderBy("_block"))).drop("_last")
    rows = rows.join(blocks, [*series, "_block"], "left").withColumn("_before", F.coalesce("_before", "_carried"))
    grown = F.when(F.col("_before").isNull(), F.lit(0)).when(F.col(value) < F.col("_before"), F.col(value)).otherwise(F.col(value) - F.col("_before"))
    return rows.withColumn("increase", grown).drop("_block", "_before", "_carried")


def increase_totals(samples: DataFrame, series: list[str], at: str, values: list[str], block: Column) -> DataFrame:
    """``series`` and, for each of ``values``, the sum of what ``increases`` says of it: counters that one sample reads together.

    Samples are shuffled once, with all their counters, and put in order within blocks; a block leaves one row (its sum, its first
    and its last values), and only those rows are put in order along a series. Of samples at one time the smaller values come first.
    Nulls come last, as in SQL; a null grew by nothing, nor does the sample after it.
    """

    def grown(now: Column, before: Column) -> Column:
        return F.when(before.isNull(), F.lit(0)).when(now < before, now).otherwise(now - before)

    inside = Window.partitionBy(*series, "_block").orderBy(*(F.asc_nulls_last(c) for c in (at, *values)))
    rows = samples.select(*series, at, *values, block.alias("_block"))
    rows = rows.withColumns({f"_before_{v}": F.lag(v).over(inside) for v in values} | {"_begins": F.lag(F.lit(1)).over(inside).isNull(), "_ends": F.lead(F.lit(1)).over(inside).isNull()})
    inner = [F.sum(F.when(~F.col("_begins"), grown(F.col(v), F.col(f"_before_{v}")))).alias(f"_inner_{v}") for v in values]
    edges = [F.max(F.when(F.col(f"_{edge}"), F.col(v))).alias(f"_{edge}_{v}") for edge in ("begins", "ends") for v in values]
    blocks = rows.groupBy(*series, "_block").agg(*inner, *edges)
    along = Window.partitionBy(*series).orderBy(F.asc_nulls_last("_block"))
    blocks = blocks.withColumns({f"_carried_{v}": F.lag(f"_ends_{v}").over(along) for v in values})
    return blocks.groupBy(*series).agg(*(F.sum(F.coalesce(f"_inner_{v}", F.lit(0)) + F.coalesce(grown(F.col(f"_begins_{v}"), F.col(f"_carried_{v}")), F.lit(0))).alias(v) for v in values))


def histogram_quantile(rows: DataFrame, by: list[str], bound: str, count: str, q: float) -> DataFrame:
    """``by``, ``n`` and ``quantile`` from cumulative counts at or below each bound, of which the last is infinite.

    The value is taken to lie evenly between the bounds around its rank, the lowest bucket beginning at 0 if its bound is
    above; in the last bucket it is the highest finite bound. Without an infinite bound, with fewer than two bounds or
    without values it is unknown. Counts of one bound are added up.
    """
    added = rows.groupBy(*by, F.col(bound).cast("double").alias("le")).agg(F.sum(count).cast("double").alias("c"))
    each = added.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("le", "c"))).alias("b"))  # a histogram's bounds
    last = F.element_at("b", -1)
    rank = F.lit(q) * last["c"]
    place = F.array_position(F.transform("b", lambda x: x["c"] >= rank), True).cast("int")  # from 1
    here, before = F.get("b", place - 1), F.get("b", place - 2)
    low, under = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["c"], F.lit(0.0))
    inner = F.when((place == 1) & (here["le"] <= 0), here["le"]).otherwise(low + (here["le"] - low) * (rank - under) / (here["c"] - under))
    value = F.when(place == F.size("b"), F.element_at("b", -2)["le"]).otherwise(inner)
    known = (last["le"] == float("inf")) & (last["c"] > 0) & (F.size("b") > 1)
    return each.select(*by, last["c"].alias("n"), F.when(known, value).alias("quantile"))


def failing(runs: DataFrame, by: list[str], ratio: float = 0.5, least: int = 3) -> DataFrame:
    rows = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.filter((F.col("runs") >= least) & (F.col("failed") > ratio * F.col("runs")))


def quota_projection(rows: DataFrame, at: Column) -> DataFrame:
    """Used, and what the period comes to at this pace (today counts), with its share of the limit; a limit of 0 is full. What has no pace stays unknown."""
    left = F.dayofmonth(F.last_day(at)) - F.dayofmonth(at) + 1
    out = rows.withColumn("projected", F.col("used") + F.col("per_day") * F.when(F.col("period") == "day", 1).otherwise(left))
    return out.withColumn("pct", F.when(F.col("projected").isNotNull(), F.when(F.col("most") > 0, F.floor(F.col("projected") * 100 / F.col("most") + 0.5)).otherwise(100).cast("long")))


def cost_estimate(operations: DataFrame) -> DataFrame:
    """Requests, runs, results and money a day per plan, from a row per operation of it.

    Results are the plan's expected matches times its overhead, shared evenly by its operations for the price. Money is
    unknown where an operation has no price at all; unknown matches leave the price of results out.
    """
    rows = operations.withColumn("per_day", F.lit(86_400) / F.col("interval_s"))
    rows = rows.withColumns({"o_runs": F.col("queries") * F.col("per_day"), "o_requests": F.col("parts") * F.col("per_day") * F.coalesce("pages", F.lit(1))})
    rows = rows.withColumn("o_results", F.floor(F.col("matches") * F.col("overhead") + 0.5)).withColumn("ops", F.count("*").over(Window.partitionBy("plan_id")))  # a plan's operations
    priced = F.coalesce("per_request", "per_thousand", "per_run").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    usd = F.col("o_requests") * zero("per_request") + F.col("o_runs") * zero("per_run") + F.coalesce(F.col("o_results") / F.col("ops") * zero("per_thousand") / 1000, F.lit(0.0))
    out = rows.groupBy("plan_id").agg(
        F.floor(F.sum("o_requests") + 0.5).alias("requests"),
        F.floor(F.sum("o_runs") + 0.5).alias("runs"),
        F.max("o_results").cast("long").alias("results"),
        F.when(F.every(priced), rounded(F.sum(usd), 2)).alias("usd"),
    )
    return out


def empty_streak(runs: DataFrame, key: list[str], order: Column, value: str, most: int = 6) -> DataFrame:
    """How many of the newest runs, up to the first with results, brought nothing."""
    newest = Window.partitionBy(*key).orderBy(order)
    seen = F.max(F.when(F.col(value) > 0, 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    last = runs.withColumn("_rn", F.row_number().over(newest)).withColumn("_seen", seen).filter(F.col("_rn") <= most)
    return last.groupBy(*key).agg(F.count_if(F.col("_seen") == 0).alias("streak"))


def adaptive_most(runs: DataFrame, key: list[str], order: Column, interval_s: int, least: int = 5, most: int = 300) -> DataFrame:
    """Items to ask for next: 3 times the rate of the last 6 runs that had a window, and 4 times what the newest of them asked for
    if it brought 80 % of that or more; within bounds, ``most`` below two samples."""
    six = top_n_per_key(runs, key, [order], 6).filter("window_min > 0")
    newest = Window.partitionBy(*key).orderBy(order)
    six = six.withColumn("newest", F.row_number().over(newest) == 1)
    rows = six.groupBy(*key).agg(
        F.count("*").alias("samples"),
        (F.sum("items_new") / F.sum("window_min")).alias("rate"),
        F.max(F.when(F.col("newest") & (F.col("items_new") >= 0.8 * F.col("max_items")), F.col("max_items") * 4)).alias("grown"),
    )
    want = F.greatest(F.lit(least), F.ceil(3 * F.col("rate") * (interval_s / 60)), F.coalesce("grown", F.lit(0)))
    return rows.withColumn("max_items", F.when(F.col("samples") < 2, most).otherwise(F.least(want, F.lit(most))).cast("long"))


def newest_gaps(gaps: DataFrame, key: list[str], k: int = 20) -> DataFrame:
    """The k newest gaps of each plan, oldest first."""
    kept = top_n_per_key(gaps, key, [F.desc("gap_end"), F.desc("gap_start")], k)
    return kept.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("gap_start", "gap_end"))).alias("gaps"))


def crossings(log: DataFrame, key: list[str], order: list[str], amount: str, limit: float, thresholds: list[int], *, block: Column) -> DataFrame:
    """Rows of an ordered log at which the running total passes a share of the limit; amounts are not negative.

    ``block`` never falls along the order (a day, say). Totals run over the blocks first; only blocks in which a threshold
    lies are put in order row by row, so that a key's log is never in one task as a whole.
    """
    log = log.withColumn("_block", block)
    blocks = log.groupBy(*key, "_block").agg(F.sum(amount).alias("_sum"))
    running = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("_end", F.sum("_sum").over(running)).withColumn("_start", F.col("_end") - F.col("_sum"))
    passed = [(F.col("_start") < t * limit / 100) & (F.col("_end") >= t * limit / 100) for t in thresholds]
    hit = blocks.filter(reduce(lambda a, b: a | b, passed)).select(*key, "_block", "_start")
    w = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    log = log.join(hit, [*key, "_block"]).withColumn("used", F.col("_start") + F.sum(amount).over(w)).withColumn("before", F.col("used") - F.col(amount))
    each = log.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    at = F.col("threshold") * F.lit(limit) / 100
    return each.filter((F.col("before") < at) & (F.col("used") >= at)).select(*key, *order, "threshold", "used")


def due(plans: DataFrame, served: DataFrame, now: Column, k: int) -> DataFrame:
    """Active plans whose time has come and that no shared stream serves, in order."""
    ready = plans.filter((F.col("status") == "active") & (F.col("next_run_at") <= now))
    return ready.join(served, "plan_id", "left_anti").orderBy("next_run_at", "plan_id").limit(k)


def preferred(rows: DataFrame, key: list[str]) -> DataFrame:
    """A tenant's own policy before the global one (tenant null)."""
    return top_n_per_key(rows, key, [F.col("tenant_id").isNull().cast("int").asc(), F.col("created_at").asc()])


def usable(policies: DataFrame, rules: DataFrame, connectors: DataFrame, providers: DataFrame, capabilities: DataFrame) -> DataFrame:
    """What can serve each platform and operation: a tenant's own policy before the global one, then its rules, their connectors and providers, and what these can do.

    Only what is enabled counts, with a weight, and verified (declared is enough where the policy allows it).
    """
    chosen = preferred(policies.filter("enabled"), ["platform", "operation"]).select("policy_id", "platform", "operation", "allow_unverified")
    out = chosen.join(rules.filter("enabled and weight > 0").select("policy_id", "connector_id", "priority", "weight"), "policy_id")
    out = out.join(connectors.filter("enabled").select("connector_id", "provider_id"), "connector_id").join(providers.filter("enabled").select("provider_id"), "provider_id")
    out = out.join(capabilities.select("connector_id", "operation", F.col("status").alias("capability")), ["connector_id", "operation"])
    return out.filter((F.col("capability") == "verified") | (F.col("allow_unverified") & (F.col("capability") == "declared")))


# --- alerts, over the hourly tables ---


def negative_ratio(hourly: DataFrame, now: Column, hours: int = 3, least: int = 20, threshold: float = 50) -> DataFrame:
    since = F.date_trunc("hour", now - F.make_interval(hours=F.lit(hours)))
    rows = hourly.filter(F.col("bucket").between(since, now)).groupBy("tenant_id", "topic_id")
    rows = rows.agg(F.sum("posts").alias("posts"), F.sum(F.when(F.col("sentiment") == "negative", F.col("posts")).otherwise(0)).alias("negative"))
    share = F.when(F.col("posts") != 0, rounded(F.col("negative") * 100 / F.col("posts"), 1)).otherwise(F.lit(0.0))
    return rows.withColumn("negative_pct", share).filter((F.col("posts") >= least) & (F.col("negative_pct") >= threshold))


def volume_spike(hourly: DataFrame, now: Column, hours: int = 1, least: int = 30, factor: float = 3) -> DataFrame:
    """The window against the average window of the 7 days before."""
    start = now - F.make_interval(hours=F.lit(hours))
    since, earlier = F.date_trunc("hour", start), F.date_trunc("hour", start - F.make_interval(days=F.lit(7)))
    rows = hourly.filter(F.col("bucket").between(earlier, now)).groupBy("tenant_id", "topic_id")
    rows = rows.agg(F.sum(F.when(F.col("bucket") >= since, F.col("posts")).otherwise(0)).alias("posts"), F.sum(F.when(F.col("bucket") < since, F.col("posts")).otherwise(0)).alias("before"))
    average = F.greatest(F.col("before") / (7 * 24 / hours), F.lit(1.0))
    rows = rows.filter((F.col("posts") >= least) & (F.col("posts") >= factor * average))
    return rows.withColumns({"baseline": rounded(F.col("before") / (7 * 24 / hours), 1), "factor": rounded(F.col("posts") / average, 1)}).drop("before")


def new_issues(hourly: DataFrame, now: Column, hours: int = 6, least: int = 10, k: int = 5) -> DataFrame:
    """Issues of the window that nobody mentioned in the 7 days before, the top k of each topic."""
    start = now - F.make_interval(hours=F.lit(hours))
    since, earlier = F.date_trunc("hour", start), F.date_trunc("hour", start - F.make_interval(days=F.lit(7)))
    rows = hourly.filter(F.col("bucket").between(earlier, now)).groupBy("tenant_id", "topic_id", "issue")
    rows = rows.agg(F.sum(F.when(F.col("bucket") >= since, F.col("mentions")).otherwise(0)).alias("mentions"), F.sum(F.when(F.col("bucket") < since, F.col("mentions")).otherwise(0)).alias("before"))
    rows = rows.filter((F.col("mentions") >= least) & (F.col("before") == 0)).drop("before")
    return top_n_per_key(rows, ["tenant_id", "topic_id"], [F.desc("mentions"), F.asc("issue")], k)


def cooled_down(rules: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """Rules that did not fire within their cooldown: an anti join on the rule with a range."""
    recent = F.expr("rules.rule_id = fired.rule_id") & (F.col("fired.fired_at") > now - F.make_interval(mins=F.col("rules.cooldown_min")))
    return rules.alias("rules").join(fired.alias("fired"), recent, "left_anti")
