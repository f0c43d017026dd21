"""The ingest stream, drained: what it leaves must equal the batch result, whatever was delivered twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.book import Book
from tidemark.catalog.state import AGG_SQL
from tidemark.operators import aggregates
from tidemark.sources.crosswalk import EVENTS_SQL, match_events
from tidemark.sources.store import fresh_path
from tidemark.streaming import ingest

BOOK = Book()


def drained(spark, sf_dir, name: str):
    """Two deliveries of the same events, one of them again, late days after early ones, each in two batches at most: each match counts once.

    Files are as many as the parts that events lie in. The stream reads the columns that the table and the keys need, no others.
    """
    base = fresh_path(spark, "stream")
    events = match_events(spark, sf_dir)
    late = F.dayofmonth("published_at") % 2 == 0
    for part in (events.filter(late), events.filter(~late), events.filter(F.col("seq") == 0)):
        part.write.mode("append").parquet(f"{base}/in")
    needed = [c for c in events.columns if c in {*aggregates.takes(events, name), *ingest.EVENT_KEY}]
    rows = ingest.read_stream(spark, f"{base}/in", events.select(*needed).schema, files_per_batch=-(-events.rdd.getNumPartitions() // 2))
    ingest.drain(rows, f"{base}/out", f"{base}/offsets", lambda batch: aggregates.parts(batch, name), key=ingest.EVENT_KEY)
    return aggregates.finished(aggregates.merge(spark.read.parquet(f"{base}/out"), name), name)


for _name in ("agg_topic_1h", "agg_emotion_1d", "agg_author_1d"):
    BOOK.add(f"stream_{_name}", lambda s, d, n=_name: drained(s, d, n), f"WITH {EVENTS_SQL} SELECT * REPLACE (bucket::VARCHAR AS bucket) FROM ({AGG_SQL[_name]})")
