"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

1. The base patterns' matches are seeds. Other tokens that overlap no seed are candidates if they hold a digit or, between
   letters, one of ``@._%+-``, however short they are. A word of letters only is none: nothing tells it from prose.
2. Every seed and candidate induces lexical patterns: the word before it, the two words before it, the word after it,
   and the words on both sides, as far as they are whole within NEAR characters, whatever was matched there.
3. Patterns and distinct values form a graph, scored in rounds. A value is trusted as one kind: a seed wholly, a
   candidate as the good patterns around it say. A pattern is for the kind of which it has most trusted values. It is
   good with SUPPORT of them or more and a score of CONFIDENCE or more, the mean trust of all its values; the values of
   good patterns are trusted with their mean score. So found values support further patterns, which find further
   values. A pattern once good stays so, with its first score; rounds go on until one finds no other, so they end.
4. Candidates beside a good pattern become spans ``like_<kind>``.

DataFrame functions only. Scores are whole millionths, so that results don't depend on the order of sums. The graph
is grouped by (pattern, value), pre-aggregated before the shuffle; joins are equi-joins that AQE splits on hot
patterns, and the patterns of a round are grouped, never collected. Texts are read once: spans are kept in a table with
a row number, not the texts.

A null text is empty; a text without a match has no spans; an empty table gives an empty result. Repeated rows count
once as values and each get their spans. Ties between kinds and patterns go to the name that sorts first. Long texts
are read whole, in time that grows with their length. The operator reads the id and text columns only, so other columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, persisted, shared_path
from tidemark.llm.spans import NEAR, PLACED, SPAN, Rule, all_found, count, digest, found, masked, once, running
from tidemark.sources.store import remove

#: Distinct trusted values of one kind that make a pattern worth scoring.
SUPPORT = 10

#: Scores are in millionths.
UNIT = 1_000_000

#: The least score of a good pattern.
CONFIDENCE = 750_000

#: Rounds that the SQL writes out; Spark's go on until nothing is found.
SQL_ROUNDS = 6


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") >= 5, 1).otherwise(0)),
    )
    return F.aggregate(places, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def octets(match: Column) -> Column:
    """Each part at most 255, leading zeros aside."""
    return F.forall(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def card(match: Column) -> Column:
    digits = digits_of(match)
    return F.length(digits).between(14, 19) & luhn(digits)


# The base patterns, written so that a long run of their characters takes linear time: a match starts where a run
# does or where the match before ended, and repeated groups are possessive. They match what the plain ones match.
BASE = [
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "@[A-Za-z0-9-]++\\."),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", card, r"[0-9](?:[\x20-]?[0-9]){13}"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits_of(m)).between(10, 15), r"\+[0-9][\x20().0-9-]"),
]

# The plain base patterns, for SQL and tests.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Whole tokens of identifier characters that hold a digit, or a mark between letters.
TOKEN = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9]|[@._%+-]*+[A-Za-z]++[@._%+-]++[A-Za-z])[A-Za-z0-9@._%+-]++"
CANDIDATE = Rule("candidate", TOKEN, None, "[0-9]|[A-Za-z][@._%+-]++[A-Za-z]")


def contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: its last word before, last two before, first after, and one on both sides."""
    blank, whole = r"[^\x20\x09-\x0D]+", lambda c: F.length(c) < NEAR
    left = F.when(whole(before), before).otherwise(F.regexp_replace(before, "^" + blank, ""))
    right = F.when(whole(after), after).otherwise(F.regexp_replace(after, blank + "$", ""))
    b, a = (F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)) for c in (left, right))
    last, next_ = F.try_element_at(b, F.lit(-1)), F.try_element_at(a, F.lit(1))
    marks = [F.concat(F.lit("< "), last), F.concat(F.lit("<< "), F.try_element_at(b, F.lit(-2)), F.lit(" "), last), F.concat(F.lit("> "), next_), F.concat(F.lit("<> "), last, F.lit(" "), next_)]
    return F.array_compact(F.array(*marks))


def apart(candidates: Column, base: Column) -> Column:
    """The candidates (sorted) that overlap no base span (sorted), in linear time."""
    is_new = lambda s: s["rank"] >= len(BASE)
    far = F.lit(2**31 - 1)

    def free(both: Column) -> Column:
        ends = running(both, F.lit(0), lambda at, s: (F.when(is_new(s), at).otherwise(F.greatest(at, s["end"])), at), "int")
        begins = F.reverse(running(F.reverse(both), far, lambda at, s: (F.when(is_new(s), at).otherwise(s["start"]), at), "int"))
        told = F.zip_with(F.zip_with(both, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), begins, lambda p, b: F.struct(p["s"].alias("s"), ((p["s"]["start"] >= p["e"]) & (p["s"]["end"] <= b)).alias("free")))
        return F.transform(F.filter(told, lambda p: is_new(p["s"]) & p["free"]), lambda p: p["s"])

    return once(F.sort_array(F.concat(candidates, base)), free)  # a base span sorts before a candidate with the same start


#: A span with its patterns.
MARKED = f"struct<span:{SPAN},patterns:array<string>>"


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, base, candidates) of every row: sorted spans with their patterns; ``row`` numbers the rows of this table."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # with a digit or an at sign nowhere in the text there is no seed
    none = F.array().cast(f"array<{PLACED}>")
    base = F.when(F.rlike("text", F.lit("[0-9@]")), all_found(F.col("text"), BASE, placed=True)).otherwise(none)
    rows = rows.select("id", base.alias("base"), found(F.col("text"), CANDIDATE, len(BASE), placed=True).alias("new"))
    rows = rows.select("id", "base", F.when(F.size("new") > 0, apart(F.col("new"), F.col("base"))).otherwise(none).alias("new"))
    mark = lambda s: F.struct(F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")]).alias("span"), contexts(s["before"], s["after"]).alias("patterns"))
    marked = [F.when(F.size(c) > 0, F.transform(c, mark)).otherwise(F.array().cast(f"array<{MARKED}>")).alias(n) for c, n in (("base", "base"), ("new", "candidates"))]
    return persisted(rows.select(F.monotonically_increasing_id().alias("row"), "id", *marked), "pii-scan")


def graph(table: DataFrame) -> DataFrame:
    """The distinct (pattern, value, kind) edges; the kind of a candidate is empty."""
    each = table.filter(F.size("base") + F.size("candidates") > 0).select(F.explode(F.concat("base", "candidates")).alias("m"))
    kind = F.when(F.col("m.span.rank") < len(BASE), F.col("m.span.kind")).otherwise(F.lit(""))
    return each.select(F.explode("m.patterns").alias("pattern"), F.lower("m.span.value").alias("value"), kind.alias("kind")).distinct()


def good_of(votes: DataFrame, totals: DataFrame, support: int, confidence: int) -> DataFrame:
    """(pattern, aim, score) of the good patterns, from (pattern, aim, trust) votes."""
    per = votes.groupBy("pattern", "aim").agg(F.count("*").alias("n"), F.sum("trust").alias("trust")).filter(F.col("n") >= support)
    best = per.groupBy("pattern").agg(F.min(F.struct((-F.col("n")).alias("least"), "aim", "trust")).alias("b"))
    scored = best.join(totals, "pattern").select("pattern", "b.aim", F.expr("b.trust div (many + 1)").alias("score"))
    return scored.filter(F.col("score") >= confidence)


def trusted(fresh: DataFrame, good: DataFrame) -> DataFrame:
    """(value, aim, trust) of the candidates beside good patterns, one kind each."""
    per = fresh.join(good, "pattern").groupBy("value", "aim").agg(F.expr("sum(score) div count(*)").alias("trust"))
    return per.groupBy("value").agg(F.min(F.struct((-F.col("trust")).alias("least"), "aim", "trust")).alias("b")).select("value", "b.aim", "b.trust")


def patterns(edges: DataFrame, *, support: int = SUPPORT, confidence: int = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """(pattern, aim, score) of the good patterns once a round has found no other; ``rounds`` stops earlier."""
    spark = edges.sparkSession
    totals = persisted(edges.groupBy("pattern").agg(F.count("*").alias("many")), "pii-totals")
    seeds = edges.filter("kind <> ''").select("pattern", F.col("kind").alias("aim"), F.lit(UNIT).cast("long").alias("trust"))
    fresh = edges.filter("kind = ''").select("pattern", "value")
    path, good, many, turn = "", None, 0, 0
    while rounds is None or turn < rounds:
        if good is None:
            found = good_of(seeds, totals, support, confidence)
        else:
            votes = seeds.unionByName(fresh.join(trusted(fresh, good), "value").select("pattern", "aim", "trust"))
            found = good.unionByName(good_of(votes, totals, support, confidence).join(good.select("pattern"), "pattern", "left_anti"))
        last, path = path, shared_path(spark, "pii-patterns")
        found.write.parquet(path)
        if last:
            remove(spark, last)
        good, turn = spark.read.schema(found.schema).parquet(path), turn + 1
        before, many = many, good.count()
        if many == before:
            break
    return good


def discovered(table: DataFrame, good: DataFrame) -> DataFrame:
    """(row, more): the new spans of each row that has any; of several patterns the best counts."""
    each = table.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("m"))
    each = each.select("row", "m.span", F.explode("m.patterns").alias("pattern"))
    best = each.join(good, "pattern").groupBy("row", "span").agg(F.min(F.struct((-F.col("score")).alias("least"), F.col("pattern"), F.col("aim"))).alias("b"))
    span = F.col("span").withField("kind", F.concat(F.lit("like_"), F.col("b.aim")))
    return best.groupBy("row").agg(F.collect_list(span.cast(SPAN)).alias("more"))


def extract(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: int = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """``id`` and ``spans`` (base and discovered, sorted) of every row."""
    table = scanned(docs, id_col=id_col, text_col=text_col)
    edges = persisted(graph(table), "pii-edges")
    more = discovered(table, patterns(edges, support=support, confidence=confidence, rounds=rounds))
    joined = table.select("row", "id", F.transform("base", lambda m: m["span"]).alias("base")).join(more, "row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return joined.select("id", F.sort_array(F.concat("base", F.coalesce("more", none))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets."""
    return masked(text, spans, lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))


def told(docs: DataFrame) -> DataFrame:
    """The contract's columns of the personal data in ``docs``."""
    spans, base = F.col("spans"), [r.kind for r in BASE]
    return extract(docs).select(
        F.col("id").alias("doc_id"),
        *[count(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(digest(spans, base), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return told(documents(spark, sf_dir))


# Sentences with identifiers after every document: known kinds, unknown ones after the same words, and unknown ones
# that only stand beside those. In Spark and in SQL.
PLANTED = """concat(coalesce(text, ''), CASE WHEN doc_id % 16 < 7 THEN concat(' Contact our desk at user', doc_id, '@mail', doc_id % 50, '.example for more')
  WHEN doc_id % 16 = 7 THEN concat(' contact our desk at user', doc_id, '_at_mail for more, or page user', doc_id, '_at_mail tonight') WHEN doc_id % 16 < 15 THEN concat(' ring home on +49 30 ', 5550000 + doc_id, ' any day')
  ELSE concat(' ring home on ', 7770000 + doc_id, ' any day') END, CASE WHEN doc_id % 128 = 9 THEN concat(' or page helper', doc_id, '_x tonight') ELSE '' END)"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op3``, of the documents with identifiers planted, so that patterns are learnt, and values found, in several rounds."""
    return told(documents(spark, sf_dir).selectExpr("doc_id", f"{PLANTED} AS text"))


def _spans_sql(rank: int, kind: str, pattern: str, keep: str) -> str:
    return f"""SELECT doc_id, rid, {rank} AS rank, '{kind}' AS kind, m, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM (
      SELECT doc_id, rid, ms[i] AS m, list_sum([length(x) FOR x IN gs[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS s
      FROM (SELECT doc_id, rid, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))) WHERE {keep}"""


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for the rows of ``told``, with SQL_ROUNDS rounds written out."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    double = "list_sum([CASE WHEN i % 2 = 1 THEN x::INT ELSE (x::INT * 2) % 10 + (x::INT >= 5)::INT END FOR x, i IN string_split(reverse({d}), '')])".format(d=digits)
    keep = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')::HUGEINT > 255)) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {double} % 10 = 0",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    base = " UNION ALL ".join(_spans_sql(i, r.kind, PLAIN[r.kind], keep[r.kind]) for i, r in enumerate(BASE))
    tokens = _spans_sql(len(BASE), "candidate", "[A-Za-z@._%+-]*[0-9][A-Za-z0-9@._%+-]*|[@._%+-]*[A-Za-z]+[@._%+-]+[A-Za-z][A-Za-z@._%+-]*", "true")
    run = r"[^\x20\x09-\x0D]+"
    before = f"CASE WHEN s < {NEAR} THEN substr(t, 1, s) ELSE regexp_replace(substr(t, s - {NEAR} + 1, {NEAR}), '^{run}', '') END"
    after = f"CASE WHEN length(t) - e < {NEAR} THEN substr(t, e + 1) ELSE regexp_replace(substr(t, e + 1, {NEAR}), '{run}$', '') END"
    marks = "list_filter(['< ' || b[-1], '<< ' || b[-2] || ' ' || b[-1], '> ' || a[1], '<> ' || b[-1] || ' ' || a[1]], lambda x: x IS NOT NULL)"
    line = "kind || ':' || s || ':' || e, ',' ORDER BY s, rank"
    seeds = f"SELECT pattern, kind AS aim, {UNIT} AS trust FROM edges WHERE kind <> ''"
    rounds = []
    for n in range(SQL_ROUNDS):
        votes = f"{seeds} UNION ALL SELECT pattern, aim, trust FROM edges JOIN value{n - 1} USING (value) WHERE kind = ''" if n else seeds
        earlier = f"SELECT pattern, aim, score FROM good{n - 1} UNION ALL " if n else ""
        other = f"AND pattern NOT IN (SELECT pattern FROM good{n - 1})" if n else ""
        rounds.append(
            f"""good{n} AS MATERIALIZED ({earlier}SELECT pattern, aim, trust // (many + 1) AS score FROM (SELECT pattern, aim, count(*) AS n, sum(trust)::BIGINT AS trust FROM ({votes}) GROUP BY pattern, aim HAVING count(*) >= {SUPPORT}
              QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY count(*) DESC, aim) = 1) JOIN totals USING (pattern) WHERE trust // (many + 1) >= {CONFIDENCE} {other})"""
        )
        rounds.append(
            f"""value{n} AS MATERIALIZED (SELECT value, aim, sum(score)::BIGINT // count(*) AS trust FROM edges JOIN good{n} USING (pattern) WHERE kind = '' GROUP BY value, aim
              QUALIFY row_number() OVER (PARTITION BY value ORDER BY sum(score)::BIGINT // count(*) DESC, aim) = 1)"""
        )
    chosen = "'" + "', '".join(r.kind for r in BASE) + "'"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {source} AS given),
base AS MATERIALIZED ({base}), tokens AS MATERIALIZED ({tokens}),
fresh AS MATERIALIZED (SELECT * FROM tokens WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = tokens.rid AND base.s < tokens.e AND tokens.s < base.e)),
spans AS (SELECT *, kind AS seed FROM base UNION ALL SELECT *, '' AS seed FROM fresh),
ctx AS MATERIALIZED (SELECT *, {marks} AS pats FROM (SELECT spans.*, regexp_extract_all(lower({before}), '{run}') AS b, regexp_extract_all(lower({after}), '{run}') AS a FROM spans JOIN (SELECT rid, t FROM d) USING (rid))),
edges AS MATERIALIZED (SELECT DISTINCT unnest(pats) AS pattern, lower(m) AS value, seed AS kind FROM ctx),
totals AS MATERIALIZED (SELECT pattern, count(*) AS many FROM edges GROUP BY pattern),
{", ".join(rounds)},
more AS (SELECT doc_id, rid, rank, 'like_' || aim AS kind, s, e FROM (SELECT doc_id, rid, rank, s, e, unnest(pats) AS pattern FROM ctx WHERE seed = '') JOIN good{SQL_ROUNDS - 1} USING (pattern)
  QUALIFY row_number() OVER (PARTITION BY rid, s ORDER BY score DESC, pattern) = 1),
every AS (SELECT rid, rank, kind, s, e FROM base UNION ALL SELECT rid, rank, kind, s, e FROM more),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg({line}) FILTER (kind IN ({chosen})) AS base, string_agg({line}) AS spans FROM every GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
