"""A training-data pipeline: the stages in order, each over all rows that the stage before it kept.

1. ``quality``: documents that the quality classifier rejects go. It is fitted on all labels.
2. ``near_duplicates``: of each group of near duplicates, the document with the least id stays.
3. ``secrets``: secrets in the texts give way to their kinds in angle brackets; ``n_chars`` follows.
4. ``mixing``: documents are repeated or left out so that sources meet their target weights.
5. ``bpe``: token ids of each row, and the text that they decode to.

All but the last return the columns of ``documents``, and columns besides them, whatever their names. An empty table passes
through as an empty one. Null and empty texts are texts without words: the classifier judges them by what little they have,
no two of them are near duplicates, they hold no secret, weigh nothing in the mix (which takes them as often as the others of
their source) and have no ids. Repeated rows are as many documents, but for the mix, which counts each; near duplicates of one id stay as often as they
are. A text of any length is one text in every stage. Ties: the least id of a group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, neardup, quality, secrets
from tidemark.llm.common import documents, scratch
from tidemark.sources.store import fresh_path, remove


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their secrets."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row and the text that they decode to."""
    out = bpe.round_trip(docs)
    return out.selectExpr("id AS doc_id", "cast(size(ids) AS bigint) AS n_tokens", "ids", "decoded AS text")


STAGES = [
    ("quality", good),
    ("near_duplicates", unlike),
    ("secrets", redacted),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: A trained classifier is among the stages, so no SQL gives these rows; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as a table and read again; a stage's own tables, and the one before it, are then removed."""
    docs, last, path = documents(spark, sf_dir), len(STAGES) - 1, ""
    for i, (name, stage) in enumerate(STAGES):
        if i == last:
            return stage(spark, docs, sf_dir)
        before, path = path, fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
    return docs
