"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Pass one measures every text (words, characters, symbols, repeated lines and 8-word windows). A sketch of each
measure per (language, source) is a table of counts of log-linear buckets (BITS significant bits, so a relative error
below 1 / 2^(BITS - 1)): counts add up, so sketches merge exactly in any order.

The limits of a group are quantiles of its sketch (the tails in LIMITS, in thousandths of its texts), each rounded
outwards by its bucket. So that few texts don't make a limit by themselves, a group's quantile is averaged with that of
its language, and a language's with that of all texts, as if PRIOR texts of the wider set were added: no group size
switches anything, and a large group keeps to its own sketch. A text is dropped if it fails the base rule or a measure
lies beyond a limit.

DataFrame functions only. Sketch rows are pre-aggregated before their shuffle, so a hot source costs no more than
another. The limits (a row per group) are broadcast while there are at most BROADCAST_GROUPS; beyond that they are
joined by a shuffle that AQE splits on hot groups.

A null text has no words and fails the base rule. Null languages and sources are groups of their own. Repeated rows
count as often as they are; texts with equal measures (ties) share their verdict, and a group of equal texts drops none
of them. Long texts are measured whole, in time that is linear in their words but for sorting them. An empty table
gives an empty result. Columns of the input are kept whatever their names, apart from the text; where one is named as
an output (``rule_n_words`` ...), the output takes its place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, persisted

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Words of a window whose repeats count.
WINDOW = 8

#: Significant bits of a bucket's edge.
BITS = 7

#: Texts of the wider set that a group's quantiles are averaged with.
PRIOR = 100

#: A group's limits take some 300 bytes, so that a broadcast stays below 10 MB.
BROADCAST_GROUPS = 10_000


@dataclass(frozen=True)
class Limit:
    """A measure in whole units (``value`` is SQL over the counts), and the quantiles, in thousandths, that limit it."""

    name: str
    value: str
    low: int | None = None
    high: int | None = None

    def sides(self) -> list[tuple[str, int]]:
        return [(side, part) for side, part in (("low", self.low), ("high", self.high)) if part is not None]


LIMITS = [
    Limit("word_length", "rule_word_chars * 100 div rule_n_words", low=10, high=970),
    Limit("symbols", "rule_n_symbols * 1000 div rule_n_words", high=950),
    Limit("dup_lines", "rule_n_dup_lines * 1000 div rule_n_lines", high=970),
    Limit("repeats", "rule_n_repeat_words * 1000 div rule_n_words", high=930),
]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def windows(words: Column, n: int = WINDOW) -> Column:
    """A hash of every n words in a row, in order."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, n)))


def places(hashes: Column) -> Column:
    """Places (from 0, sorted) of the hashes that occur twice or more: sorted with their places, equal ones are neighbours."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
    before, after = F.concat(F.array(last), placed), F.concat(F.slice(placed, 2, F.size(placed)), F.array(last))
    sides = F.arrays_zip(placed.alias("p"), before.alias("b"), after.alias("a"))
    twice = F.filter(sides, lambda s: (s["p"]["h"] == s["b"]["h"]) | (s["p"]["h"] == s["a"]["h"]))
    return F.sort_array(F.transform(twice, lambda s: s["p"]["i"]))


def covered(places: Column, n: int = WINDOW) -> Column:
    """Words under windows of n words that begin at these sorted places."""
    nexts = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(2**31 - 1)))
    steps = F.zip_with(places, nexts, lambda a, b: F.least(b - a, F.lit(n)))
    return F.when(F.size(places) > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(rule_row, rule_lang, rule_source, rule_* counts) of each whole text; ``rule_row`` holds the other columns of ``docs``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    other = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    keys = ["rule_row", "rule_lang", "rule_source"]
    row = F.struct(*other) if other else F.lit(None).cast("struct<none:int>")
    rows = docs.select(row.alias("rule_row"), docs[lang_col].alias("rule_lang"), docs[source_col].alias("rule_source"), text.alias("rule_text"))
    words = F.filter(F.split("rule_text", BLANKS, -1), lambda w: w != "")
    lines = F.filter(F.split("rule_text", "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    counted = rows.select(
        *keys,
        words.alias("rule_words"),
        lines.alias("rule_lines"),
        (F.length("rule_text") - F.regexp_count("rule_text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("rule_word_chars"),
        F.regexp_count("rule_text", F.lit(SYMBOLS)).cast("long").alias("rule_n_symbols"),
    )
    counted = counted.select(
        *keys,
        "rule_word_chars",
        "rule_n_symbols",
        F.size("rule_words").cast("long").alias("rule_n_words"),
        F.size("rule_lines").cast("long").alias("rule_n_lines"),
        (F.size("rule_lines") - F.size(F.array_distinct("rule_lines"))).cast("long").alias("rule_n_dup_lines"),
        windows(F.col("rule_words")).alias("rule_windows"),
    )
    some = F.size(F.array_distinct("rule_windows")) < F.size("rule_windows")
    twice = F.when(some, places(F.col("rule_windows"))).otherwise(F.array().cast("array<int>"))
    counted = counted.withColumn("rule_places", twice).drop("rule_windows")
    counted = counted.withColumn("rule_n_repeat_words", covered(F.col("rule_places")))
    return counted.select(*keys, *[f"rule_{c}" for c in COUNTS])


def shift(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))


def bucket(value: Column) -> Column:
    """The lower edge of the value's bucket: its first BITS binary digits."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift(value)), shift(value))


def top_of(edge: Column) -> Column:
    """The largest value of the bucket with this lower edge."""
    return edge + F.call_function("shiftleft", F.lit(1).cast("long"), shift(edge)) - 1


def sketches(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group columns, measure, bucket, many): the sketch of every measure of every group. Texts without words don't count."""
    values = F.array(*[F.struct(F.lit(x.name).alias("measure"), bucket(F.expr(x.value)).alias("bucket")) for x in LIMITS])
    each = rows.filter("rule_n_words > 0").select(*group, F.explode(values).alias("m"))
    return each.groupBy(*group, "m.measure", "m.bucket").agg(F.count("*").alias("many"))


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Sketches added up over all other columns."""
    return sketch.groupBy(*group, "measure", "bucket").agg(F.sum("many").alias("many"))


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group columns, measure, many, low, high): texts of each group, and the edges of the buckets where its tails begin."""
    # a sketch has some hundred buckets, so that a window holds no more rows than that
    key = Window.partitionBy(*group, "measure")
    run = key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("many").over(run)).withColumn("all", F.sum("many").over(key))
    part = lambda side: F.element_at(F.create_map(*[F.lit(v) for x in LIMITS for s, p in x.sides() if s == side for v in (x.name, p)]), F.col("measure"))
    first = lambda side: F.min(F.when(F.col("upto") * 1000 >= F.col("all") * part(side), F.col("bucket")))
    ends = ranked.groupBy(*group, "measure").agg(F.first("all").alias("many"), first("low").alias("low"), first("high").alias("high"))
    return ends.withColumn("high", top_of(F.col("high")))


def shrunk(own: DataFrame, wide: DataFrame, on: Column) -> DataFrame:
    """``own`` quantiles averaged with the ``wide`` ones, which count as PRIOR texts."""
    both = own.alias("o").join(wide.alias("w"), on)
    mean = lambda side: F.expr(f"(o.{side} * o.many + w.{side} * {PRIOR}) div (o.many + {PRIOR})").alias(side)
    return both.select("o.*", mean("low").alias("new_low"), mean("high").alias("new_high")).drop("low", "high").withColumnsRenamed({"new_low": "low", "new_high": "high"})


def limits(rows: DataFrame) -> DataFrame:
    """(rule_lang, rule_source, low and high limit of each measure) of every group with words."""
    own = persisted(sketches(rows, ["rule_lang", "rule_source"]), "rule-sketches")
    total = quantiles(merged(own, []), [])
    langs = shrunk(quantiles(merged(own, ["rule_lang"]), ["rule_lang"]), F.broadcast(total), F.expr("o.measure = w.measure"))  # a row per measure
    ends = shrunk(quantiles(own, ["rule_lang", "rule_source"]), langs, F.expr("o.measure = w.measure and o.rule_lang <=> w.rule_lang"))
    cells = [F.max(F.when(F.col("measure") == x.name, F.col(side))).alias(f"rule_{side}_{x.name}") for x in LIMITS for side, _ in x.sides()]
    return ends.groupBy("rule_lang", "rule_source").agg(*cells)


def judged(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``rule_*`` counts, ``rule_base_failed``, ``rule_broken`` (names of broken limits) and ``rule_kept``."""
    rows = persisted(measured(docs, lang_col=lang_col, source_col=source_col, text_col=text_col), "rule-measures")
    bounds = persisted(limits(rows).withColumnsRenamed({"rule_lang": "rule_l", "rule_source": "rule_s"}), "rule-limits")
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    joined = rows.join(bounds, F.expr("rule_lang <=> rule_l and rule_source <=> rule_s"), "left")
    base = (F.col("rule_n_words") < 20) | (100 * F.col("rule_n_repeat_words") > 30 * F.col("rule_n_words"))
    broken = []
    for x in LIMITS:
        value = F.expr(x.value)
        beyond = {"low": lambda c, v=value: v < c, "high": lambda c, v=value: v > c}
        out = [F.coalesce(beyond[side](F.col(f"rule_{side}_{x.name}")), F.lit(False)) for side, _ in x.sides()]
        broken.append(F.when((F.col("rule_n_words") > 0) & reduce(lambda a, b: a | b, out), F.lit(x.name)))
    joined = joined.withColumns({"rule_base_failed": base, "rule_broken": F.array_join(F.array_compact(F.array(*broken)), ",")})
    joined = joined.withColumn("rule_kept", ~F.col("rule_base_failed") & (F.col("rule_broken") == ""))
    names = [f"rule_{c}" for c in (*COUNTS, "base_failed", "broken", "kept")]
    kept = [F.col(f"rule_row.`{c}`") for c in docs.columns if c != text_col and c.lower() not in names]
    return joined.select(*kept, *names)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = judged(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken"]
    return out.select("doc_id", *[F.col(f"rule_{n}").alias(n) for n in names])


def oracle() -> str:
    """DuckDB SQL for op9's rows."""
    value = {x.name: x.value.replace("rule_", "").replace(" div ", " // ") for x in LIMITS}
    shift = lambda v: f"greatest(length(bin({v})) - {BITS}, 0)"
    each = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS measure, ({v})::BIGINT AS v FROM m WHERE n_words > 0" for n, v in value.items())

    def first(side: str) -> str:
        part = " ".join(f"WHEN '{x.name}' THEN {p}" for x in LIMITS for s, p in x.sides() if s == side)
        return f"min(CASE WHEN upto * 1000 >= total * (CASE measure {part} END) THEN bucket END)"

    def ends(name: str, group: str) -> str:
        keys = f"{group}, measure" if group else "measure"
        return f"""{name} AS (SELECT *, edge + (1::BIGINT << {shift("edge")}) - 1 AS high FROM (SELECT {keys}, max(total)::BIGINT AS many, {first("low")} AS low, {first("high")} AS edge FROM (
          SELECT *, sum(many) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(many) OVER (PARTITION BY {keys}) AS total
          FROM (SELECT {keys}, bucket, sum(many) AS many FROM sketch GROUP BY ALL)) GROUP BY {keys}))"""

    mean = lambda o, w: ", ".join(f"((o.{c} * o.many + {w}.{c} * {PRIOR}) // (o.many + {PRIOR}))::BIGINT AS {c}" for c in ("low", "high"))
    sides, breaks = [], []
    for x in LIMITS:
        sides += [f"max(CASE WHEN measure = '{x.name}' THEN {s} END) AS {s}_{x.name}" for s, _ in x.sides()]
        beyond = " OR ".join(f"coalesce({value[x.name]} {'<' if s == 'low' else '>'} {s}_{x.name}, false)" for s, _ in x.sides())
        breaks.append(f"CASE WHEN n_words > 0 AND ({beyond}) THEN '{x.name}' END")
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(nxt - i, {WINDOW}))::BIGINT AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), 1000000000) AS nxt FROM twice) GROUP BY rid),
m AS MATERIALIZED (SELECT doc_id, lang, source, rid, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
v AS ({each}),
sketch AS MATERIALIZED (SELECT lang, source, measure, ((v >> {shift("v")}) << {shift("v")})::BIGINT AS bucket, count(*)::BIGINT AS many FROM v GROUP BY ALL),
{ends("total", "")}, {ends("own_lang", "lang")}, {ends("own", "lang, source")},
langs AS (SELECT o.lang, o.measure, {mean("o", "w")} FROM own_lang o JOIN total w ON o.measure = w.measure),
q AS (SELECT o.lang, o.source, o.measure, {mean("o", "w")} FROM own o JOIN langs w ON o.measure = w.measure AND o.lang IS NOT DISTINCT FROM w.lang),
bounds AS (SELECT lang, source, {", ".join(sides)} FROM q GROUP BY lang, source),
out AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {", ".join(breaks)}) AS broken
  FROM m LEFT JOIN bounds b ON m.lang IS NOT DISTINCT FROM b.lang AND m.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM out
"""
