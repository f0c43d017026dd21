"""Evaluation of labels: agreement, scores, calibration, sampling and splits, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    sides = F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    each = pairs.select((F.col("gold") == F.col("pred")).alias("same"), F.explode(sides).alias("s")).filter("s.label is not null")
    rows = each.groupBy("s.label").agg(F.sum("s.g").alias("support"), F.sum("s.p").alias("predicted"), F.count_if(F.col("same") & (F.col("s.g") == 1)).alias("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"precision": ratio("hits", "predicted"), "recall": ratio("hits", "support")})
    f1 = F.when(F.col("hits") > 0, 2.0 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(F.lit(0.0))
    return rows.withColumn("f1", f1).select("label", "support", "precision", "recall", "f1")


def macro_f1(pairs: DataFrame) -> DataFrame:
    return per_class(pairs).filter("support > 0").agg(F.avg("f1").alias("macro_f1"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("int")).alias("accuracy"), F.count_if(F.col("pred").isNull()).alias("missing"))


def cohen_kappa(pairs: DataFrame, a: str = "gold", b: str = "pred") -> DataFrame:
    """Agreement beyond chance; 1 where chance alone agrees. The tables joined here have a row per label."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("po"))
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.count("*").alias("x"))
    right = pairs.groupBy(F.col(b).alias("label")).agg(F.count("*").alias("y"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    both = n.crossJoin(chance).withColumn("pe", F.col("xy") / (F.col("n") * F.col("n")))
    return both.select(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def ece(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (lower, upper]; the first holds 0."""
    b = F.greatest(F.ceil(F.col("confidence") * bins) - 1, F.lit(0))
    rows = pairs.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("conf"), F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("acc"))
    return rows.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def coverage_curve(pairs: DataFrame, taus: list[float]) -> DataFrame:
    """Share of rows at or above each threshold, their accuracy (0 without any), and the share that would go on to a larger model: one aggregation for all thresholds."""
    cells = []
    for t in taus:
        above = F.col("confidence") >= t
        hit = F.count_if(above & (F.col("gold") == F.col("pred")))
        share = F.coalesce(F.try_divide(F.count_if(above), F.count("*")), F.lit(0.0))
        cells.append(F.struct(F.lit(t).alias("tau"), share.alias("coverage"), F.coalesce(F.try_divide(hit, F.count_if(above)), F.lit(0.0)).alias("accuracy"), (1 - share).alias("to_llm_pct")))
    return pairs.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def stratified_sample(rows: DataFrame, by: str, key: str, n: int, least: int = 50) -> DataFrame:
    """About n rows, each stratum by its share but ``least`` at least, in the order of a hash of the key."""
    counts = rows.groupBy(by).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    take = counts.crossJoin(total).select(by, F.least(F.col("c"), F.greatest(F.lit(least), F.bround(F.lit(n) * F.col("c") / F.col("t")))).cast("int").alias("k"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.sha1(F.col(key).cast("string")), key))
    # no stratum takes more, and a fixed bound lets Spark limit the strata before the shuffle
    first = rows.withColumn("_rn", place).filter(F.col("_rn") <= max(n, least))
    return first.join(take, by).filter(F.col("_rn") <= F.col("k")).drop("_rn", "k")


def frozen_split(key: Column) -> Column:
    """dev or test, by a hash of the key alone."""
    return F.when(F.conv(F.substring(F.sha1(key.cast("string")), 1, 8), 16, 10).cast("long") % 100 < 50, "dev").otherwise("test")


def merge_annotators(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, label, status): what both say, or adjudication."""
    both = a.select("id", F.col("label").alias("one")).join(b.select("id", F.col("label").alias("two")), "id")
    same = F.col("one") == F.col("two")
    return both.select("id", F.when(same, F.col("one")).alias("label"), F.when(same, "agreed").otherwise("adjudicate").alias("status"))


def evaluate(pairs: DataFrame, taus: list[float] = [0.5]) -> DataFrame:
    """One row of the report: macro F1, accuracy, kappa, calibration, coverage at the first threshold."""
    return macro_f1(pairs).crossJoin(accuracy(pairs)).crossJoin(cohen_kappa(pairs)).crossJoin(ece(pairs)).crossJoin(coverage_curve(pairs, taus[:1]).select("coverage"))
