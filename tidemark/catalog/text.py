"""Text functions, topic queries and enrichment over documents and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.book import Book
from tidemark.functions import text as X
from tidemark.operators import enrich, sinks
from tidemark.plans import topics
from tidemark.sources.store import fresh_path, spread, table

BOOK = Book()


def docs(s, d):
    return spread(table(s, d, "documents").select("doc_id", "text", "lang"))


def on_text(work):
    return lambda s, d: docs(s, d).select("doc_id", work(F.col("text")).alias("out"))


def hashed(work):
    """A digest instead of a long text."""
    return lambda s, d: docs(s, d).select("doc_id", F.sha2(F.coalesce(work(F.col("text")), F.lit("")), 256).alias("out"))


BOOK.add("normalize_text", hashed(X.normalize_text), "SELECT doc_id, sha256(coalesce(strip_accents(lower(text)), '')) AS out FROM documents")
TOKENS = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
BOOK.add("tokenize", on_text(lambda t: F.size(X.tokenize(X.normalize_text(t)))), f"SELECT doc_id, len({TOKENS})::INT AS out FROM documents")
BOOK.add("hashtags_in", on_text(lambda t: F.array_join(X.hashtags_in(X.normalize_text(t)), ",")), r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(strip_accents(lower(text)), '#([\p{L}\p{N}_]+)', 1), lambda t: replace(t, '_', '')), ',') AS out FROM documents")
LANGS = "CASE doc_id % 6 WHEN 0 THEN 'in' WHEN 1 THEN 'EN-us' WHEN 2 THEN 'und' WHEN 3 THEN NULL WHEN 4 THEN 'zlm' ELSE lang END"
BOOK.add("normalize_lang", lambda s, d: docs(s, d).select("doc_id", X.normalize_lang(F.expr(LANGS)).alias("out")), "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'id' WHEN 1 THEN 'en' WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'ms' ELSE lang END AS out FROM documents")
NUMBERS = r"\b(?:\d{5,}|[03-9]\d{3}|1[0-8]\d{2}|2[1-9]\d{2})\b"
PSEUDO = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:https?://|www\.)\S+', '<url>', 'g'), '(^|[^\w@])@[A-Za-z0-9_.]{{1,30}}', '\1<user>', 'g'), '{NUMBERS}', '<num>', 'g'), '\s+', ' ', 'g'))"
BOOK.add("pseudonymize", hashed(X.pseudonymize), f"SELECT doc_id, sha256(coalesce({PSEUDO}, '')) AS out FROM documents")
TAG = "regexp_replace({text}, '[^A-Za-z0-9_]+', ''{all})"


def split_sql(tag: str) -> str:
    """Blanks where case changes and before digits, without looking around."""
    for pair in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])"):
        tag = f"regexp_replace({tag}, '{pair}', '\\1 \\2', 'g')"
    return f"lower(replace({tag}, '_', ' '))"


BOOK.add("split_hashtag", hashed(lambda t: X.split_hashtag(F.regexp_replace(t, "[^A-Za-z0-9_]+", ""))), f"SELECT doc_id, sha256(coalesce({split_sql(TAG.format(text='text', all=', ' + repr('g')))}, '')) AS out FROM documents")
TAGGED = "concat('see #BanjirJakarta at www.x.org @bob_1 no ', doc_id, ' #covid19_', lang, ' ', text)"
CLEAN = PSEUDO.replace("regexp_replace(text,", "regexp_replace(t,")
BOOK.add(
    "preprocess",
    lambda s, d: docs(s, d).select("doc_id", F.sha2(F.coalesce(X.preprocess(F.expr(TAGGED))[0], F.lit("")), 256).alias("out"), F.array_join(X.preprocess(F.expr(TAGGED))[1], ",").alias("tags")),
    rf"""WITH c AS (SELECT doc_id, {CLEAN} AS c FROM (SELECT doc_id, CASE WHEN text IS NOT NULL AND lang IS NOT NULL THEN {TAGGED} END AS t FROM documents)),
      p AS (SELECT doc_id, regexp_extract_all(c, '#([\p{{L}}\p{{N}}_]+)', 1) AS tags, string_split_regex(c, '#[\p{{L}}\p{{N}}_]+') AS pieces FROM c)
      SELECT doc_id, sha256(coalesce(trim(regexp_replace(array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce({split_sql('tags[i]')}, '')), ''), '\s+', ' ', 'g')), '')) AS out, array_to_string(tags, ',') AS tags FROM p""",
)
BOOK.add("is_short", on_text(X.is_short), r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda t: t NOT IN ('', '<url>', '<user>', '<num>'))) < 3 AS out FROM documents")
BOOK.add("safe_text", hashed(X.safe_text), r"SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END) AS out FROM documents")
def redact_sql(text: str) -> str:
    """The patterns without what looks ahead: what is replaced twice stays the same."""
    for pattern, kept in X.SECRET_PATTERNS:
        after = "@" if "(?=@)" in pattern else ""
        pattern = pattern.replace("(?=@)", "@").replace(r"(?!\[REDACTED\])", "").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{kept.replace('$', chr(92))}[REDACTED]{after}', 'g')"
    return text


LOGGED = "concat(text, ' Bearer abcdef123456== at https://u:pw', doc_id, '@h/?key=k', doc_id, '&x=1 ghp_abcdefghijklmnopqrstuv password: \"p', doc_id, '\" eyJabcdef.eyJghijkl.mnopqrs', chr(10), 'params: a@b.c,1', chr(10), 'end')"
LOG_MAP = "map('Set-Cookie', 'a=b', 'user_TOKEN', concat('t', doc_id), 'X-API-key', 'k', 'note', concat(text, ' password: p', doc_id), 'tokens', cast(doc_id as string), 'E-Mail', 'x', 'phone_numbers', '1', 'emailing', 'y')"
BOOK.add(
    "redact_keys",
    lambda s, d: docs(s, d).filter("text is not null").withColumn("m", X.without_personal(X.redact_map(F.expr(LOG_MAP)))).select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.expr("concat(m['Set-Cookie'], m['user_TOKEN'], m['X-API-key'], m['tokens'])").alias("values"), F.sha2(F.expr("m['note']"), 256).alias("note")),
    f"SELECT doc_id, 'Set-Cookie,X-API-key,emailing,note,tokens,user_TOKEN' AS keys, '[REDACTED][REDACTED][REDACTED]' || doc_id AS values, sha256({redact_sql('t')}) AS note FROM (SELECT doc_id, text || ' password: p' || doc_id AS t FROM documents WHERE text IS NOT NULL)",
)
BOOK.add("redact", lambda s, d: docs(s, d).select("doc_id", F.sha2(F.coalesce(X.redact(F.expr(LOGGED)), F.lit("")), 256).alias("out")), f"SELECT doc_id, sha256(coalesce({redact_sql('t')}, '')) AS out FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {LOGGED} END AS t FROM documents)")
RAW_ISSUES = ["upper(p_name)", "p_type || ' <b>!'", "p_type", "' x '", "p_brand || ' https://a.b/c'", "'a b c d e'"]
BOOK.add(
    "clean_issues",
    lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(X.clean_issues(F.array(*map(F.expr, RAW_ISSUES))), ",").alias("out")),
    rf"""WITH x AS (SELECT p_partkey, list_transform([{", ".join(RAW_ISSUES)}], lambda v: trim(regexp_replace(regexp_replace(regexp_replace(lower(v), '<[^>]*>|https?://\S+|[#@]', ' ', 'g'), '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+', ' ', 'g'))) AS l FROM part),
      y AS (SELECT p_partkey, list_filter(l, lambda v: length(v) BETWEEN 3 AND 60 AND len(string_split(v, ' ')) <= 4) AS l FROM x)
      SELECT p_partkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:3], ',') AS out FROM y""",
)

# topic queries
QUERIES = [
    topics.compiled("a", '"the and" OR worthless', topic="t1"),
    topics.compiled("b", "(trash OR idiot) AND NOT moron", topic="t1"),
    topics.compiled("c", "der -das", topic="t2", languages=["de"], known=["en", "de", "fr", "es"]),
    topics.compiled("d", "que AND (eaux OR ment) NOT \"de la\"", topic="t2"),
    topics.compiled("e", "disgusting", topic="t3", keywords=["moron", "of the"]),
    topics.compiled("f", "#tag OR @someone OR año", topic="t3"),
]


def node_sql(n: topics.Node) -> str:
    if n.kind in ("and", "or"):
        return "(" + f" {n.kind.upper()} ".join(map(node_sql, n.kids)) + ")"
    if n.kind == "not":
        return f"NOT {node_sql(n.kids[0])}"
    v = n.value.replace("'", "''")
    if v[0] == "@":
        return "false"
    if v[0] == "#":
        return f"list_contains(tags, '{v[1:]}')"
    return f"(contains(joined, ' {v} ') OR list_contains(tags, '{v.replace(' ', '')}'))"


MATCH_SQL = rf"""i AS MATERIALIZED (SELECT doc_id, lang, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS joined, len(list_filter(string_split_regex(regexp_replace(strip_accents(lower(text)), '#[\p{{L}}\p{{N}}_]+', ' ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS words,
  list_transform(regexp_extract_all(strip_accents(lower(text)), '#([\p{{L}}\p{{N}}_]+)', 1), lambda t: replace(t, '_', '')) AS tags FROM documents),
hits AS ({' UNION ALL '.join(f"SELECT doc_id, '{q.name}' AS query, '{q.topic}' AS topic FROM i WHERE {node_sql(q.tree)}" + (f" AND (words < 3 OR lang IN ({', '.join(repr(x) for x in q.languages)}))" if q.languages else '') for q in QUERIES)})"""


def found(s, d):
    return topics.matches(topics.prepared(docs(s, d)), QUERIES, ["doc_id"])


BOOK.add("match_join", found, f"WITH {MATCH_SQL} SELECT doc_id, query, topic FROM hits")
BOOK.add("first_match_per_topic", lambda s, d: topics.first_per_topic(found(s, d), ["doc_id"]), f"WITH {MATCH_SQL} SELECT doc_id, topic, min(query) AS query FROM hits GROUP BY ALL")
BOOK.add("match_query", lambda s, d: topics.prepared(docs(s, d)).select("doc_id", topics.reason(QUERIES[2]).alias("reason")), f"WITH {MATCH_SQL} SELECT doc_id, CASE WHEN NOT (words < 3 OR lang = 'de') THEN 'language' WHEN {node_sql(QUERIES[2].tree)} THEN 'match' ELSE 'query' END AS reason FROM i")
BOOK.add("prepare_item", lambda s, d: topics.prepared(docs(s, d)).select("doc_id", F.sha2("q_joined", 256).alias("joined"), "q_words", F.array_join("q_hashtags", ",").alias("tags")), f"WITH {MATCH_SQL} SELECT doc_id, sha256(joined) AS joined, words::INT AS q_words, array_to_string(list_transform(list_distinct(tags), lambda t: t), ',') AS tags FROM i")
# query texts that stand in a table, one of ten of them broken
QUERY_TEXT = """concat(case when doc_id % 10 = 3 then '(' else '' end, '(w', doc_id, ' OR \"w', doc_id, ' ', coalesce(source, 'none'), '\") AND -', coalesce(lang, 'xx'), 'x #T', doc_id % 9)"""
BOOK.add(
    "query_catalog",
    lambda s, d: topics.catalog(table(s, d, "documents").selectExpr("doc_id", f"{QUERY_TEXT} as text"), "doc_id"),
    """WITH q AS (SELECT doc_id, 'w' || doc_id AS w, lower(coalesce(source, 'none')) AS src, lower(coalesce(lang, 'xx')) || 'x' AS l, '#t' || doc_id % 9 AS t FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN sha256('{"ast": {"children": [{"children": [{"type": "term", "value": "' || l || '"}], "type": "not"}, {"children": [{"type": "phrase", "value": "' || w || ' ' || src || '"}, {"type": "term", "value": "' || w || '"}], "type": "or"}, {"type": "term", "value": "' || t || '"}], "type": "and"}, "languages": [], "media": [], "not": []}') END AS digest,
      CASE WHEN doc_id % 10 <> 3 THEN 7 END AS nodes, CASE WHEN doc_id % 10 <> 3 THEN 'and,group,not,or,phrase,term' END AS features, CASE WHEN doc_id % 10 <> 3 THEN t END AS keys, CASE WHEN doc_id % 10 = 3 THEN 'a parenthesis is not closed' END AS error FROM q""",
)

# enrichment: nations as a gazetteer
PLACES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Nation ' || c_nationkey END AS place,
  CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'I live in nation ' || c_nationkey || ' since 2010' WHEN 2 THEN 'nation' ELSE NULL END AS profile, c_nationkey FROM customer"""


def regions(s, d):
    places = table(s, d, "customer").selectExpr("c_custkey as id", "case when c_custkey % 3 = 0 then concat('Nation ', c_nationkey) end as place", "case c_custkey % 4 when 0 then concat('NATION_', c_nationkey) when 1 then concat('I live in nation ', c_nationkey, ' since 2010') when 2 then 'nation' else null end as profile")
    names = table(s, d, "nation").selectExpr("cast(n_nationkey as string) as code", "n_name as name", "array('nation', concat('N', n_nationkey)) as aliases")
    return enrich.infer_region(places, names, key=["id"], place="place", profile="profile")


BOOK.add("geo_gazetteer", regions, f"WITH p AS ({PLACES}) SELECT id, c_nationkey::VARCHAR AS region, CASE WHEN place IS NOT NULL THEN 0.8::DOUBLE WHEN id % 4 = 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM p WHERE place IS NOT NULL OR id % 4 IN (0, 1)")


def demographics(s, d):
    rows = table(s, d, "customer").selectExpr("c_custkey as id", "element_at(array('male', 'female', 'unknown'), cast(c_custkey % 3 + 1 as int)) as g", "c_custkey % 10 / 10 as gc", "element_at(array('22_30', 'below_18', 'unknown', '31_45'), cast(c_custkey % 4 + 1 as int)) as a", "c_custkey % 7 / 7 as ac")
    cells = enrich.demographics(F.col("g"), F.col("gc"), F.col("a"), F.col("ac"))
    return rows.select("id", *[v.alias(k) for k, v in cells.items()])


BOOK.add(
    "demographics",
    demographics,
    "SELECT id, CASE WHEN gc >= 0.75 THEN g ELSE 'unknown' END AS gender, CASE WHEN a <> 'below_18' AND ac >= 0.65 THEN a ELSE 'unknown' END AS age_range, CASE WHEN a = 'below_18' THEN 0.0 ELSE ac END AS age_conf, a = 'below_18' AS minor_suppressed FROM (SELECT c_custkey AS id, (['male', 'female', 'unknown'])[c_custkey % 3 + 1] AS g, c_custkey % 10 / 10 AS gc, (['22_30', 'below_18', 'unknown', '31_45'])[c_custkey % 4 + 1] AS a, c_custkey % 7 / 7 AS ac FROM customer)",
)


def labelled(s, d):
    marks = table(s, d, "labels").selectExpr("doc_id", "case when quality = 1 then 'positive' else 'negative' end as sentiment", "case when toxic = 1 then 'anger' else 'joy' end as emotion", "'m1' as model_version")
    return enrich.labelled(docs(s, d), marks, ["doc_id"]).select("doc_id", "sentiment", "emotion", "model_version")


BOOK.add(
    "label_assembly",
    labelled,
    r"SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'neutral' WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'anger' ELSE 'joy' END AS emotion, CASE WHEN l.doc_id IS NOT NULL THEN 'm1' WHEN len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda t: t NOT IN ('', '<url>', '<user>', '<num>'))) < 3 THEN 'rule:short-text' ELSE 'unlabeled' END AS model_version FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)


def exported(s, d):
    path = fresh_path(s, "csv")
    sinks.write_csv(table(s, d, "part").selectExpr("p_partkey", "case when p_partkey % 3 = 0 then concat('=', p_name) else concat(p_name, ', \"', p_brand, '\"') end as name"), path)
    return s.read.option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


BOOK.add("export_csv", exported, "SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name ELSE p_name || ', \"' || p_brand || '\"' END AS name FROM part")
