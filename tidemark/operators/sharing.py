"""Shared streams: plans whose queries look for the same terms are fetched once.

Plans are grouped by platform, operation and who may see the results (a tenant with an account of its own keeps to
itself). From the shortest interval to the longest: a plan whose terms a faster stream covers rides on it; the others that
share terms, directly or through others, are a stream of their own if they are two or more. Terms are rows of tables:
covering is a join by term and a count, and connected plans are found by passing least ids along shared terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import fresh_path, remove

GROUP = ["platform", "operation", "visibility"]

#: Tables of more nodes than this are joined by merging; Spark may send smaller ones through the driver, each round anew.
MERGED = 50_000


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, node: str, hub: str) -> DataFrame:
    """(``node``, component): the least node that each can reach through shared hubs.

    Each round a hub takes the least label of its nodes and a node that of its hubs, and then the label of its label, so
    that long chains grow short; the table of labels is the only thing that goes from round to round.
    """
    spark = edges.sparkSession
    base, turn = fresh_path(spark, "components"), 0
    edges = written(edges.select(node, hub).distinct(), f"{base}/edges")
    labels = written(edges.groupBy(node).agg(F.min(node).alias("label")), f"{base}/labels-0")
    many = labels.count() > MERGED
    side = lambda df: df.hint("merge") if many else df
    while True:
        hubs = edges.join(side(labels), node).groupBy(hub).agg(F.min("label").alias("least"))
        near = edges.join(hubs, hub).groupBy(node).agg(F.min("least").alias("next"))
        jump = labels.select(F.col(node).alias("next"), F.col("label").alias("further"))
        new = labels.join(side(near), node).join(side(jump), "next", "left").select(node, F.least("next", "further").alias("label"), (F.least("next", "further") < F.col("label")).alias("moved"))
        turn += 1
        new = written(new, f"{base}/labels-{turn}")
        remove(spark, f"{base}/labels-{turn - 1}")
        labels = new.select(node, "label")
        if new.filter("moved").isEmpty():
            remove(spark, f"{base}/edges")
            return labels.withColumnRenamed("label", "component")


def covered(plans: DataFrame, streams: DataFrame) -> DataFrame:
    """(plan_id, stream): plans all of whose terms a stream of their group has; of several the fastest, then the least name."""
    need = plans.select("plan_id", *GROUP, F.size("terms").alias("need"), F.explode("terms").alias("term"))
    have = streams.select(*GROUP, "stream", "stream_interval_s", F.explode("stream_terms").alias("term"))
    both = need.join(have, [*GROUP, "term"]).groupBy("plan_id", "stream", "stream_interval_s", "need").agg(F.count("*").alias("n")).filter("n = need")
    return both.groupBy("plan_id").agg(F.min(F.struct("stream_interval_s", "stream")).alias("s")).select("plan_id", "s.stream")


STREAM = "platform string, operation string, visibility string, stream string, stream_interval_s int, stream_terms array<string>"


def shared(plans: DataFrame) -> DataFrame:
    """(plan_id, stream, stream_interval_s, rides) of the plans that a shared stream serves.

    ``plans``: plan_id, tenant_id, platform, operation, interval_s, own_account, terms (null or empty where a query has
    no terms that any match must contain; such plans stay alone). A stream's name is that of its group, interval and
    least plan. Intervals are few fixed classes; the loop is over them.
    """
    spark = plans.sparkSession
    able = plans.filter(F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0)
    able = able.withColumns({"terms": F.array_sort(F.array_distinct("terms")), "visibility": F.when(F.col("own_account"), F.col("tenant_id")).otherwise("*")})
    base = fresh_path(spark, "shared")
    able = written(able.select("plan_id", *GROUP, F.col("interval_s").cast("int").alias("interval_s"), "terms"), f"{base}/plans")
    streams: DataFrame | None = None
    served: DataFrame | None = None
    for n, row in enumerate(able.select("interval_s").distinct().orderBy("interval_s").collect()):  # the classes
        here = able.filter(F.col("interval_s") == row.interval_s)
        rest = here
        if streams is not None:
            riders = written(covered(here, streams), f"{base}/riders-{n}")
            ride = riders.join(streams.select("stream", "stream_interval_s"), "stream").select("plan_id", "stream", "stream_interval_s", F.lit(True).alias("rides"))
            served, rest = served.unionByName(ride), here.join(riders.hint("merge"), "plan_id", "left_anti")
        rest = rest.withColumn("g", F.concat_ws("|", *GROUP))
        alike = written(rest.groupBy("g", "terms").agg(F.min("plan_id").alias("node")), f"{base}/alike-{n}")  # plans of equal terms are one node
        edges = alike.select("node", "g", F.explode("terms").alias("term")).select("node", F.concat_ws("|", "g", "term").alias("hub"))
        found = alike.join(components(edges, "node", "hub"), "node").select("g", "terms", "component")
        together = rest.join(found, ["g", "terms"]).drop("g")
        terms = together.select("component", *GROUP, "plan_id", F.explode("terms").alias("term"))
        made = terms.groupBy("component", *GROUP).agg(F.count_distinct("plan_id").alias("members"), F.sort_array(F.collect_set("term")).alias("stream_terms")).filter("members > 1")
        name = F.concat_ws("|", *GROUP, F.lit(str(row.interval_s)), F.col("component").cast("string"))
        new = written(made.select("component", *GROUP, name.alias("stream"), F.lit(row.interval_s).alias("stream_interval_s"), "stream_terms"), f"{base}/streams-{n}")
        joined = together.select("plan_id", "component").join(new.select("component", "stream", "stream_interval_s"), "component").select("plan_id", "stream", "stream_interval_s", F.lit(False).alias("rides"))
        streams = new.drop("component") if streams is None else streams.unionByName(new.drop("component"))
        served = joined if served is None else served.unionByName(joined)
    return served if served is not None else spark.createDataFrame([], "plan_id long, stream string, stream_interval_s int, rides boolean")
