"""Keys that a stream has written, so that each counts once: merged as they grow, and forgotten a stated time after they came.

Every batch writes the keys that were new in it, partitioned by the day of their rows. As in a number written to the base
``FAN``, sixteen folders of a level become one of the next, so a stream of n batches has at most 15 folders a level and
log16(n) levels, and each key is written again once a level. Which folders are read follows from the number of the batch
alone; nothing is listed. A merged folder replaces the ones it was made of only when the batch after has begun, so that a
batch that is done again finds what it found before.

Keys are forgotten by when they came (``ARRIVED``), not by the time of their rows: a late row is never taken for an old one.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import exists, remove

FAN = 16

# Fixed value: days after which a key that came is forgotten.
LIFE_DAYS = 14

ARRIVED, DAY = "_arrived", "_day"


def levels(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, block) of the folders that hold the keys of the batches before ``batch``: block b of level l holds fan**l batches from b * fan**l on."""
    out, level = [], 0
    while fan**level <= batch:
        level += 1
    begin = 0
    for step in range(level, -1, -1):
        width = fan**step
        while begin + width <= batch:
            out.append((step, begin // width))
            begin += width
    return out


def merged_at(batch: int, fan: int = FAN) -> tuple[int, list[tuple[int, int]]] | None:
    """The level that is complete as ``batch`` begins, and the folders that its newest block is made of."""
    level = 0
    while batch and batch % fan ** (level + 1) == 0:
        level += 1
    if not level:
        return None
    begin = batch - fan**level
    return level, [(s, b) for s, b in levels(batch - 1, fan) if b * fan**s >= begin] + [(0, batch - 1)]


def folder(path: str, level: int, block: int) -> str:
    return f"{path}/level={level}/block={block}"


def read(spark: SparkSession, path: str, parts: list[tuple[int, int]], schema: str) -> DataFrame | None:
    """The keys in these folders; a batch without new keys has no files."""
    paths = [p for level, block in parts if exists(spark, p := folder(path, level, block))]
    if not paths:
        return None
    return spark.read.schema(f"{schema}, level int, block long").option("basePath", path).parquet(*paths).drop("level", "block")


def write(rows: DataFrame, path: str, level: int, block: int) -> None:
    rows.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(folder(path, level, block))


def tidy(spark: SparkSession, path: str, batch: int, schema: str, now: datetime, *, fan: int = FAN, life: timedelta = timedelta(days=LIFE_DAYS)) -> None:
    """Before ``batch``: merge what has become complete, without the keys whose time is over; remove what the batch before has merged."""
    if batch and (last := merged_at(batch - 1, fan)):
        for level, block in last[1]:
            remove(spark, folder(path, level, block))
    if found := merged_at(batch, fan):
        level, parts = found
        block = batch // fan**level - 1
        if exists(spark, f"{folder(path, level, block)}/_SUCCESS"):
            return
        rows = read(spark, path, parts, schema)
        if rows is not None:
            write(rows.filter(F.col(ARRIVED) >= F.lit(now - life)), path, level, block)


def known(spark: SparkSession, path: str, batch: int, schema: str, first: object, last: object, now: datetime, *, fan: int = FAN, life: timedelta = timedelta(days=LIFE_DAYS)) -> DataFrame | None:
    """The keys of the batches before, of the days from ``first`` to ``last`` and of rows without a day."""
    rows = read(spark, path, levels(batch, fan), schema)
    if rows is None:
        return None
    within = F.col(DAY).isNull() if first is None else F.col(DAY).between(F.lit(first), F.lit(last)) | F.col(DAY).isNull()
    return rows.filter(within & (F.col(ARRIVED) >= F.lit(now - life)))
