"""Runs: the maximal periodic stretches of a text's words, and the text without their repetitions.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and two periods long, that neither neighbour
extends. Every run holds, for an order of the words or for the opposite one, the longest Lyndon word that begins at
some position, with the run's period as its length. So the words are scanned from right to left, once under each order, with
a stack of Lyndon words: the word at hand takes in the words on the stack while the suffix that begins with it is smaller
than the one that begins with them, and what it has grown to is extended to both sides. Suffixes are compared, and stretches
extended, by their longest common extension: a few words directly, then by binary search over hashes of prefixes; the
words found equal are compared directly, so that a collision of hashes is found and mended, and the next two differ.
A stretch within a run found already (same distance) is known without a search, so texts of one repeated word take
linear time as well. There is no suffix array.

A document is done whole in one task, in memory in proportion to its words; nothing is shuffled, so no hot key hurts. A
null or blank text has no words and no runs. Repeated rows give repeated results; ids of any type, null too, are carried. An
empty table gives an empty result. Only the two columns named are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, per_chunk, sha256_of

#: Least number of words of a run.
LEAST = 12

#: Words compared directly before hashes are asked.
NEAR = 8

# A prime and a base of the hashes.
PRIME, BASE = (1 << 31) - 1, 1_000_003

RUNS = "array<struct<start:int,length:int,period:int>>"


class Powers:
    """BASE to the 0th, 1st, ... power, for the longest text so far."""

    def __init__(self) -> None:
        self.array = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.array) < n:
            by = np.uint64(pow(BASE, len(self.array), PRIME))
            self.array = np.concatenate([self.array, self.array * by % np.uint64(PRIME)])
        return self.array[:n]


class Extensions:
    """Longest common extensions of two places i < j of a text, to the right and to the left."""

    def __init__(self, words: list[int], powers: Powers):
        self.words, self.n, self.powers = words, len(words), powers
        self.prefix: list[int] | None = None
        self.known: dict[int, tuple[int, int]] = {}  # by period, the newest stretch with it: start and end

    def hashes(self) -> None:
        array = np.array(self.words, dtype=np.int32)
        self.bytes = array.tobytes()
        self.power = self.powers.upto(self.n + 1)
        terms = (array.astype(np.uint64) + np.uint64(1)) * self.power[: self.n] % np.uint64(PRIME)
        self.prefix = [0, *(np.cumsum(terms) % np.uint64(PRIME)).tolist()]

    def same(self, i: int, j: int, k: int, shift: int) -> bool:
        """Whether hashes say that the k words from i and from j are equal; ``shift`` is BASE ** (j - i)."""
        p = self.prefix
        return ((p[i + k] - p[i]) * shift - (p[j + k] - p[j])) % PRIME == 0

    def equal(self, i: int, j: int, k: int) -> bool:
        return self.bytes[4 * i : 4 * (i + k)] == self.bytes[4 * j : 4 * (j + k)]

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on."""
        s, most = self.words, self.n - j
        k, near = 0, min(NEAR, most)
        while k < near and s[i + k] == s[j + k]:
            k += 1
        if k < NEAR or k == most:
            return k
        run = self.known.get(j - i)
        if run and run[0] <= i and j <= run[1]:
            return run[1] - j
        if self.prefix is None:
            self.hashes()
        shift, step = int(self.power[j - i]), k
        while k + step <= most and self.same(i + k, j + k, step, shift):
            k += step
            step *= 2
        while step:  # binary search of the rest
            if k + step <= most and self.same(i + k, j + k, step, shift):
                k += step
            step //= 2
        if not self.equal(i, j, k):
            k = next(x for x in range(k) if s[i + x] != s[j + x])
        return k

    def left(self, i: int, j: int) -> int:
        """How many words up to i, itself included, equal those up to j."""
        s, most = self.words, i + 1
        k, near = 0, min(NEAR, most)
        while k < near and s[i - k] == s[j - k]:
            k += 1
        if k < NEAR or k == most:
            return k
        run = self.known.get(j - i)
        if run and run[0] <= i and j < run[1]:
            return i - run[0] + 1
        if self.prefix is None:
            self.hashes()
        shift, step = int(self.power[j - i]), k
        while k + step <= most and self.same(i + 1 - k - step, j + 1 - k - step, step, shift):
            k += step
            step *= 2
        while step:
            if k + step <= most and self.same(i + 1 - k - step, j + 1 - k - step, step, shift):
                k += step
            step //= 2
        if not self.equal(i + 1 - k, j + 1 - k, k):
            k = next(x for x in range(k) if s[i - x] != s[j - x])
        return k


def scan(s: list[int], ext: Extensions, found: set[tuple[int, int, int]]) -> None:
    """Add (start, period, length) of every run that holds a longest Lyndon word under the order of ``s``."""
    n, known = len(s), ext.known
    stack = [n]
    for i in range(n - 1, -1, -1):
        c, e, k = s[i], stack[-1], 0
        while e < n:
            b = s[e]
            if c > b:
                break
            if c == b:
                k = ext.right(i, e)
                if e + k == n or s[i + k] > s[e + k]:
                    break
                k = 0
            stack.pop()
            e = stack[-1]
        stack.append(i)
        period = e - i
        need = period - k  # words to the left that make two periods
        if need > 0 and (need > i or s[i - need] != s[e - need] or s[i - 1] != s[e - 1]):
            continue
        left = ext.left(i - 1, e - 1) if i and s[i - 1] == s[e - 1] else 0
        if left >= need:
            known[period] = (i - left, e + k)
            if left + period + k >= LEAST:
                found.add((i - left, period, left + period + k))


def runs_of(words: list[int], powers: Powers) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs, by start, then period."""
    ext, found = Extensions(words, powers), set()
    scan(words, ext, found)
    scan([-w for w in words], ext, found)
    return sorted(found)


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, period, length in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``runs`` by start and period, ``collapsed``: the words that stay, joined by one space."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    powers = Powers()

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        sizes, runs, kept = [], [], []
        for text in chunk.column("text").cast(pa.large_binary()).to_pylist():
            words = text.split()  # of bytes: at blanks, tabs, line ends, vertical tabs and form feeds
            codes: dict[bytes, int] = {}
            found = runs_of([codes.setdefault(w, len(codes)) for w in words], powers)
            if found:
                words = [words[i] for i in np.flatnonzero(collapsed(len(words), found)).tolist()]
            kept.append(b" ".join(words).decode())
            runs.append([{"start": a, "length": n, "period": q} for a, q, n in found])
            sizes.append(len(text.split()))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))
        return pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(sizes, pa.int32()), pa.array(runs, kind), pa.array(kept, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return per_chunk(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, n_words int, runs {RUNS}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``: where crc32 of the id ends in 0, the words from a place on repeat a stretch that begins there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    spec = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).withColumn("h", h)
    chosen = (F.col("h") % 10 == 0) & F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    words = spec.withColumn("w", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    words = words.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.col("g") % F.col("n"))
    words = words.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    loop = F.expr("array_join(transform(sequence(0L, n - 1L), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return words.select("doc_id", F.when(chosen, loop).otherwise(F.col("text")).alias("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the text without repetitions."""
    found = find(looped(documents(spark, sf_dir)))
    ranked: Column = F.array_min(F.expr("transform(runs, r -> struct(-r.length AS back, r.start AS start, r.period AS period))"))
    best = found.withColumn("best", ranked)
    start, period, length = F.col("best.start").cast("long"), F.col("best.period").cast("long"), (-F.col("best.back")).cast("long")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return best.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        sha256_of(lines).alias("runs_sha256"),
        sha256_of(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: Equal stretches of six words at a distance d, joined to stretches as long as they go on: each run has some, as its length less its period is six or more.
ORACLE = rf"""
WITH ids AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda t: CASE WHEN t % 8 = 0 THEN CAST(ascii(CAST(doc_id AS VARCHAR)[t // 8 + 1]) AS BIGINT) ELSE 0 END),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) AS h FROM documents),
spec AS (SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS looped, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM ids),
places AS (SELECT doc_id, w, looped, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM spec),
words AS MATERIALIZED (SELECT doc_id, i, w[CASE WHEN looped AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM places),
grams AS MATERIALIZED (SELECT doc_id, i, word, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4, lead(word, 5) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM grams x JOIN grams y USING (doc_id, word, w1, w2, w3, w4, w5) WHERE x.i < y.i AND x.w5 IS NOT NULL),
stretches AS (SELECT doc_id, d, min(i) AS start, count(*) + 5 AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS part FROM pairs) GROUP BY doc_id, d, part),
runs AS MATERIALIZED (SELECT doc_id, start, k + d AS length, min(d) AS period FROM stretches WHERE k >= d AND k + d >= {LEAST} GROUP BY doc_id, start, k + d),
facts AS (SELECT doc_id, count(*) AS n_runs, min((-length, start, period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
  CAST(1000 * -best[1] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN facts USING (doc_id) LEFT JOIN kept USING (doc_id)"""
