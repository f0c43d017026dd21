"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import fresh_path, remove, ship, spread

#: Words of every contract: runs of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that a Python helper takes at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 19


#: Tables made since each open ``scratch`` began, the innermost last.
_made: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    path = fresh_path(spark, name)
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables made within are removed at the end. What it yields writes a result that stays, and must be used for all that outlives them."""
    _made.append([])

    def staying(df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(spark, name)
        if len(_made) > 1:
            _made[-2].append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield staying
    finally:
        for path in _made.pop():
            remove(spark, path)


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents", *, as_stored: bool = False) -> DataFrame:
    """A table; where it lies in fewer parts than there are cores it is dealt out, unless wanted ``as_stored``."""
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if as_stored else spread(rows)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about CHUNK_BYTES at most; rows stay whole and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        del batch  # or it would stay while the next one is read
        pa.default_memory_pool().release_unused()


def per_chunk(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` over chunks bounded in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, column):
            yield work(chunk)

    return df.mapInArrow(run, schema)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, from 0; a null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
