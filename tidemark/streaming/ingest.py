"""The ingest stream: files in, each match once, batches that can be replayed, sums at read time.

Late rows are kept, however late: a batch drops the rows whose keys earlier batches have written, by an anti join with
the table of keys (``streaming.keys``), not by a watermark. A batch is read once, and reads the keys of the days that it
spans. It appends its rows; aggregates are summed when read, and kept tables take its newest rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.sinks import once_each, write_batch
from tidemark.operators.state import MATCH_KEY
from tidemark.streaming import keys as K

EVENT_KEY = [*MATCH_KEY, "seq"]


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(rows: DataFrame, width: str, time: str = "published_at") -> DataFrame:
    """Signed posts per tenant, topic and window, for update mode."""
    w = F.window(time, width)
    return rows.groupBy("tenant_id", "topic_id", w.start.alias("bucket")).agg(F.sum("sign").cast("long").alias("posts"))


def claimed(batch: DataFrame, batch_id: int, path: str, key: list[str], time: str, now: datetime | None = None, *, fan: int = K.FAN, life: timedelta = timedelta(days=K.LIFE_DAYS)) -> DataFrame:
    """The rows of ``batch`` whose key no earlier batch has had within ``life``, persisted; their keys are written. A replay finds the same."""
    spark, now = batch.sparkSession, now or datetime.now(UTC).replace(tzinfo=None)
    rows = once_each(batch, key).withColumn(K.DAY, F.to_date(time)).persist()
    first, last = rows.agg(F.min(K.DAY), F.max(K.DAY)).first()
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in key), f"{K.ARRIVED} timestamp", f"{K.DAY} date"])
    K.tidy(spark, path, batch_id, schema, now, fan=fan, life=life)
    known = K.known(spark, path, batch_id, schema, first, last, now, fan=fan, life=life)
    fresh = rows if known is None else rows.join(known.select(*key), key, "left_anti").persist()
    K.write(fresh.select(*key, F.lit(now).cast("timestamp").alias(K.ARRIVED), K.DAY), path, 0, batch_id)
    if fresh is not rows:
        rows.unpersist()
    return fresh


def drain(rows: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None, *, key: list[str] | None = None, time: str = "published_at", also: list[Callable[[DataFrame], None]] | None = None) -> None:
    """Process what is there and stop. With ``key`` each key counts once. A batch that is replayed after a failure replaces its own folder.

    ``time`` never changes with a redelivery, so that both deliveries fall on one day; a null time is a day of its own.
    ``also`` takes each batch's rows besides; it must not mind to get them twice (as ``kept.upsert``).
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        fresh = claimed(batch, batch_id, f"{checkpoint}-keys", key, time) if key else batch
        batch = fresh.drop(K.DAY)
        write_batch(work(batch) if work else batch, path, batch_id)
        for other in also or []:
            other(batch)
        fresh.unpersist()

    query = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
