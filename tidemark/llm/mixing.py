"""Mix sources to target weights by repeating documents.

Words are summed per source; a source's target is its weighted share of all words, at most ``most`` times its own,
the excess shared out again by weight; its rate is target over own words. Each document is emitted floor(rate) times
and once more if a hash of its id falls below the rate's fraction. Everything is a DataFrame function.

Only the table of sources (one row each) is ordered as a whole. It is joined by broadcast while it has at most
BROADCAST_SOURCES rows and by a shuffle that AQE splits on hot sources beyond that. A null text has no words; a null
source is a source of its own, ordered last; an empty table gives an empty mix. Documents with the same id draw the
same coin. Long texts are counted whole; sources whose limits tie are taken by name. Columns of the input are kept
whatever their names; where one is named as an output of ``with_copies`` (OUT), the output takes its place there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, persisted

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)

#: No source is repeated more than this often.
MOST = 3

SEED = 20240607

#: A source's row is below 1 kB, so that a broadcast table stays below 10 MB.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the key: the first 13 hexadecimal digits of SHA-256 over 2^52."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (mix_source, mix_size) rows: per source its words, target and rate.

    The targets are min(most * own, level * weight) with the level at which they share all words: sources are taken
    by rising ``most * own / weight``; the first that stays below its limit has the level, the highest of those that do.
    """
    own = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("own"))
    rank = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = own.select("mix_source", "own", weight.cast("double").alias("weight"), (F.col("own") * most).cast("double").alias("limit"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    before, upto_end = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = (
        ranked.withColumn("all", F.sum("own").over(everything).cast("double"))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(upto_end))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
        .withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    rate = F.when(F.col("own") > 0, F.least(target / F.col("own"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return leveled.select("mix_source", F.col("own").alias("mix_source_size"), target.alias("mix_target"), rate.alias("mix_rate"))


#: What ``with_copies`` adds.
OUT = ["mix_source_size", "mix_target", "mix_rate", "mix_copies"]


def copied(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, seed: int = SEED) -> DataFrame:
    """(mix_row, OUT columns): every row of ``docs`` as a struct, and what the mix takes of it."""
    size = docs[size_col] if size_col else words(docs[text_col])
    sources = persisted(targets(docs.select(docs[source_col].alias("mix_source"), size.alias("mix_size"))), "mix-sources")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("mix_row"), docs[source_col].alias("mix_own"), docs[id_col].alias("mix_id"))
    joined = rows.join(sources, F.expr("mix_own <=> mix_source"))
    fraction = F.col("mix_rate") - F.floor("mix_rate")
    more = F.coalesce(coin(F.col("mix_id"), seed), F.lit(0.0)) < fraction
    return joined.withColumn("mix_copies", F.floor("mix_rate").cast("long") + more.cast("long")).select("mix_row", *OUT)


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its source's words, target and rate, and ``mix_copies``, how often the mix takes the row."""
    return copied(docs, **options).select(*[F.col(f"mix_row.`{c}`") for c in docs.columns if c.lower() not in OUT], *OUT)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    copies = F.explode(F.expr("case when mix_copies > 0 then sequence(1, mix_copies) else array() end"))
    return copied(docs, **options).withColumn("mix_copy", copies).select(*[F.col(f"mix_row.`{c}`") for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    sized = persisted(documents(spark, sf_dir).select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    out = with_copies(sized, size_col="size")
    return out.select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), own AS (
  SELECT source, sum(size)::BIGINT AS own, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), ranked AS (
  SELECT source, own, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, (own * {MOST})::DOUBLE AS lim FROM own
), leveled AS (
  SELECT *, (sum(own) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM ranked
), level AS (
  SELECT max(lvl) AS lvl FROM leveled WHERE lvl * weight <= lim
), target AS (
  SELECT source, own, least(lim, coalesce((SELECT lvl FROM level) * weight, lim)) AS target, lim FROM ranked
), rated AS (
  SELECT source, own, target, CASE WHEN own > 0 THEN least(target / own, {float(MOST)}) ELSE 0.0 END AS rate FROM target
), taken AS (
  SELECT doc_id, size, own, target, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / {1 << 52}.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
)
SELECT doc_id, size, own AS source_size, target, size * copies AS taken, copies FROM taken
"""
