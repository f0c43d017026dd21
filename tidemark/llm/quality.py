"""Quality classifier: naive Bayes features in a linear support vector machine.

Features are indicators of n-grams: words, word pairs, and up to four runs of character classes in a row (the shapes of
words and what stands between them). Each indicator is scaled by the log ratio of its smoothed class counts, then a
hinge-loss linear model is fitted by dual coordinate descent.

The model is fitted on at most SAMPLE labelled rows per class, chosen by a hash of the id, each read whole. Null and
empty texts have no n-gram and get the score of the bias and the empty text's own features. Without labels of both
classes every score is the share of label 1 (0.5 without any label). Duplicate labels of an id: the least counts.
Repeated rows repeat their result; a tie (0.5) is label 1. Scoring is one scan without a shuffle. The operator reads the id and
text columns only (``keep_good`` hands on all others), so other columns may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, flat_bytes, text_chunks
from tidemark.llm.grams import U, fit_hinge, mixed, windows, word_hashes
from tidemark.llm.language import fold

#: Labelled rows per class to fit on: a bound that does not grow with the input.
SAMPLE = 2500

#: Hashed features.
SIZE = 1 << 17

#: Smoothing of the class counts.
ALPHA = 1.0

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
SHAPE[9:14] = 10
SHAPE[128:] = ord("a")


def hashed(x: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(x + U(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> U(64 - SIZE.bit_length() + 1)).astype(np.int32)


def features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text."""
    data, offsets = flat_bytes(texts)
    n = len(offsets) - 1
    words, at = word_hashes(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(at))
    found, who = [hashed(words, 1)], [owner]
    pairs, pair_owner = windows(words, at, 2)
    found.append(hashed(pairs, 2))
    who.append(pair_owner)
    shapes = SHAPE[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.append(True, (shapes[1:] != shapes[:-1]) | (owner[1:] != owner[:-1])) if len(shapes) else np.zeros(0, bool)
    shapes, owner = shapes[keep].astype(U), owner[keep]
    gram = np.zeros(len(shapes), U)
    for k in range(1, 5):
        if len(shapes) < k:
            break
        gram = gram[: len(shapes) - k + 1] << U(8) | shapes[k - 1 :]
        inside = owner[: len(gram)] == owner[k - 1 :]
        found.append(hashed(gram[inside], 4 + k))
        who.append(owner[: len(gram)][inside])
    every, whose = np.concatenate(found), np.concatenate(who)
    key = np.unique(whose.astype(np.int64) * SIZE + every)
    cuts = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * SIZE)
    key = (key % SIZE).astype(np.int32)
    return [key[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Model:
    """score(features) is the probability-like sigmoid of the margin."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.weights = None
        if 0 < self.share < 1:
            counts = [np.full(SIZE, ALPHA), np.full(SIZE, ALPHA)]
            for row, label in zip(rows, labels, strict=True):
                counts[label][row] += 1
            ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
            norm = [max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]
            scaled = [(r, ratio[r] / m) for r, m in zip(rows, norm, strict=True)]
            weights, self.bias = fit_hinge(scaled, np.where(labels == 1, 1.0, -1.0), SIZE, np.full(len(rows), 10.0))
            self.ratio, self.weights = ratio, weights * ratio

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.share)
        out = np.array([float(self.weights[r].sum()) / max(1e-9, float(np.sqrt((self.ratio[r] ** 2).sum()))) for r in rows]) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(2.0 * out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled ids per class, each with the features of one of its texts: SIZE numbers at most.

    The chosen ids (a bounded table) are broadcast to the texts. Of an id with two labels or texts the lesser counts.
    """
    marks = labels.filter(labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 24))
    share = [int(min(1.0, 1.2 * sample / max(1, counts.get(k, 0))) * (1 << 24)) for k in (0, 1)]
    chosen = marks.withColumn("draw", draw).filter(F.col("draw") < F.when(F.col("label") == 0, share[0]).otherwise(share[1]))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id").select("label", "draw", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("label"), chunk.column("draw"), chunk.column("id").cast(pa.string()), pa.array(features(chunk.column("text")), pa.list_(pa.int32()))], names=["label", "draw", "id", "at"])

    # an id counts once, however often it is repeated, so that the sample bounds what is gathered
    drawn = texts.mapInArrow(run, "label int, draw bigint, id string, at array<int>").groupBy("label", "draw", "id").agg(F.min("at").alias("at"))
    table = drawn.toArrow()
    order = sorted(zip(table["label"].to_pylist(), table["draw"].to_pylist(), table["id"].to_pylist(), range(table.num_rows), strict=True))
    at = table["at"].combine_chunks()
    rows, marked, taken = [], [], [0, 0]
    for label, _, _, i in order:
        taken[label] += 1
        if taken[label] <= sample:
            rows.append(at[i].values.to_numpy())
            marked.append(label)
    return Model(rows, np.array(marked, dtype=np.int64))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` and ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            score = shared.value.score(features(chunk.column("text")))
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, text_col):
            score = shared.value.score(features(chunk.column(chunk.schema.get_field_index(text_col))))
            yield chunk.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; learnt from labels outside the held-out fold."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    return predict(docs, model).select(F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "score", "predicted")
