"""Kept state: tables that hold the newest row of each key only, so that feeds read no superseded one.

A table is partitioned by month and by hashes of its key; a batch reads and rewrites the partitions that it touches and no
others (dynamic partition overwrite). The newest version wins, whatever the order of batches: late rows and replays change
nothing. A key's time never changes, so that its rows fall on one partition. What a driver loses while it replaces partitions
can be made again from the append-only stream with ``rebuild``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.state import MATCH_KEY, POST_KEY, latest_per_key
from tidemark.sources.store import exists, remove


@dataclass(frozen=True)
class Kind:
    """Key and version of the rows, their time, the hashes that deal them out (by name, over columns), and the order within files."""

    key: tuple[str, ...]
    version: tuple[str, ...]
    time: str
    deal: dict[str, tuple[tuple[str, ...], int]]
    order: tuple[str, ...]

    @property
    def parts(self) -> list[str]:
        return ["ym", *self.deal]


#: A topic's rows lie in few partitions of a month, yet a topic that has most rows is split by post.
MATCHES = Kind(tuple(MATCH_KEY), ("event_at", "seq"), "published_at", {"topic_part": (("tenant_id", "topic_id"), 16), "post_part": (("platform", "post_id"), 4)}, ("tenant_id", "topic_id", "published_at"))
POSTS = Kind(tuple(POST_KEY), ("version",), "published_at", {"post_part": (("platform", "post_id"), 16)}, tuple(POST_KEY))


# Fixed value: into how many slices, by hash, a partition's keys are dealt at most.
SLICES = 16


def bucket(values: list[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(n)).cast("int")


def dealt(rows: DataFrame, kind: Kind) -> DataFrame:
    """``rows`` with the columns of their partition. A null time is a month of its own."""
    cells = {name: bucket([F.col(c) for c in columns], n) for name, (columns, n) in kind.deal.items()}
    return rows.withColumns({"ym": F.coalesce(F.date_format(kind.time, "yyyyMM").cast("int"), F.lit(0)), **cells})


def partition_name(parts: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(p).cast("string") for p in parts])


def newest(rows: DataFrame, kind: Kind) -> DataFrame:
    """The newest row of each key of ``rows`` (a column of partition each), sorted as files are.

    Rows are dealt out once, by partition and slices of its keys: a key's rows meet in one task, which keeps those that
    stay, and a hot partition is split into several files.
    """
    cells = [*kind.parts, "_slice"]
    even = rows.withColumn("_slice", bucket([F.col(c) for c in kind.key], SLICES)).repartition(*cells)
    return latest_per_key(even, [*cells, *kind.key], list(kind.version)).drop("_slice").sortWithinPartitions(*kind.parts, *kind.order)


def put(rows: DataFrame, path: str, kind: Kind) -> None:
    """Replace the partitions of ``rows`` by the newest row of each key."""
    newest(rows, kind).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*kind.parts).parquet(path)


def upsert(rows: DataFrame, path: str, kind: Kind) -> None:
    """Bring the table below ``path`` up to date with a batch: only its partitions, told first from its keys and times, are read and written."""
    spark = rows.sparkSession
    new = dealt(rows, kind)
    touched = [r[0] for r in new.select(partition_name(kind.parts)).distinct().collect()]  # partitions of one batch
    if not touched:
        return
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).filter(partition_name(kind.parts).isin(touched))
        new = old.select(*new.columns).unionByName(new)
    put(new, path, kind)


def rebuild(rows: DataFrame, path: str, kind: Kind) -> None:
    """The table anew from the whole stream."""
    remove(rows.sparkSession, path)
    put(dealt(rows, kind), path, kind)


@dataclass(frozen=True)
class Current:
    """A kept table as a source of feeds."""

    path: str
    kind: Kind
    schema: str

    def rows(self, spark: SparkSession, start: datetime | None = None, end: datetime | None = None, **values: str) -> DataFrame:
        """The rows of the months from ``start`` to ``end``; ``values`` of hashed columns prune the partitions of others."""
        out = spark.read.schema(f"{self.schema}, ym int, {', '.join(f'{name} int' for name in self.kind.deal)}").parquet(self.path)
        month = lambda t: t.year * 100 + t.month
        if start and end:
            out = out.filter(F.col("ym").between(month(start), month(end)))
        for name, (columns, n) in self.kind.deal.items():
            if set(columns) <= set(values):
                out = out.filter(F.col(name) == bucket([F.lit(values[c]) for c in columns], n))
        return out.drop(*self.kind.parts)
