"""Sinks: batches that can be written twice without harm, partitioned tables, CSV for spreadsheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import safe_text


def once_each(batch: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with the same key the least one by its other columns, so that every evaluation takes the same. They are dealt out by key first, so that no task sorts a whole file."""
    rest = [c for c in batch.columns if c not in key]
    least = batch.repartition(*key).groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return least.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in batch.columns])


def append_new(batch: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a batch whose key isn't there yet; within the batch each key once, as ``once_each`` says."""
    return once_each(batch, key).join(existing.select(*key).distinct(), key, "left_anti")


def write_batch(batch: DataFrame, path: str, batch_id: int | str) -> None:
    """Rows of a batch in a folder of its own: the same batch again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_monthly(rows: DataFrame, path: str, time: str, order: list[str]) -> None:
    """Partitioned by month, sorted within files, so that filters on time prune folders and row groups."""
    month = rows.withColumn("ym", F.date_format(time, "yyyyMM"))
    month.repartition("ym", F.pmod(F.xxhash64(*order), F.lit(16))).sortWithinPartitions(*order).write.partitionBy("ym").mode("overwrite").parquet(path)


def append_monthly(rows: DataFrame, path: str, time: str) -> None:
    """Append to a table partitioned by month."""
    rows.withColumn("ym", F.date_format(time, "yyyyMM")).write.partitionBy("ym").mode("append").parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Months ``first`` to ``last`` (yyyyMM): folders of other months are not read."""
    return spark.read.parquet(path).filter(F.col("ym").cast("string").between(first, last))


def for_spreadsheet(rows: DataFrame) -> DataFrame:
    """Every column as text; text that would be a formula is quoted."""
    return rows.select(*[safe_text(F.col(f"`{c}`").cast("string")).alias(c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a byte order mark, a header, quotes doubled, and lines ended as spreadsheets expect. Spark writes one file per partition."""
    marked = for_spreadsheet(rows).toDF("\ufeff" + rows.columns[0], *rows.columns[1:])
    marked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def tables_of(spark: SparkSession, prefix: str) -> DataFrame:
    """(name, columns, rows) of the catalog's tables and views with a prefix, each read for its count alone."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
    if not names:
        return spark.createDataFrame([], "name string, columns int, rows long")
    each = [spark.table(n).agg(F.lit(n).alias("name"), F.lit(len(spark.table(n).columns)).alias("columns"), F.count("*").alias("rows")) for n in names]
    return reduce(lambda a, b: a.unionByName(b), each)
