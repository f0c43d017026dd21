"""A list of queries: a name, what gives its rows, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text, so that rows compare alike whatever the client's time zone; years above 9999 without a sign."""
    return df.select(*[F.ltrim(F.col(f"`{c}`").cast("string"), F.lit("+")).alias(c) if t in ("timestamp", "date", "timestamp_ntz") else F.col(f"`{c}`") for c, t in df.dtypes])


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: plain(make(spark, sf_dir))
        if sql:
            self.oracles[name] = sql
