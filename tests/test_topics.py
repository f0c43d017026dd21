"""Topic queries: reading, meaning, and the index join against brute force."""

import random
import re

import pytest

from tidemark.plans import topics as T


@pytest.mark.parametrize("text", ["", "(", "()", "a )", "or a", "a or", "not", '"open', "-", "not a", "a and", "!!", "(" * 12 + "a" + ")" * 12, "a " * 1200])
def test_bad_queries(text):
    with pytest.raises(T.QueryError):
        T.parse(text)


@pytest.mark.parametrize(
    "a, b",
    [("a b", "a AND b"), ("a or b and c", "a OR (b AND c)"), ("NOT NOT a", "a"), ("b a", "a b"), ("a (b (c d))", "d c b a"), ("-x a", "a NOT x"), ("covid-19", '"covid 19"'), ("A or a", "a"), ("Café", "cafe")],
)
def test_same_meaning(a, b):
    assert T.compiled("q", a).digest() == T.compiled("q", b).digest()


@pytest.mark.parametrize("text, want", [('mayor AND ("tram" OR "new city hall")', {"mayor"}), ("a or b", {"a", "b"}), ("a or not b", None), ("aa not b", {"aa"})])
def test_cover(text, want):
    found = T.cover(T.parse(text))
    assert (None if found is None else {x.value for x in found}) == want


def test_keywords_stay_under_the_nots():
    q = T.compiled("q", '("tram" OR "bus") AND NOT "2019"', keywords=["night train"])
    assert q.tree.kind == "and" and q.tree.kids[1].kind == "not"
    assert {x.value for x in T.cover(q.tree)} == {"tram", "bus", "night train"}


def holds(node, words, tags):
    if node.kind == "and":
        return all(holds(k, words, tags) for k in node.kids)
    if node.kind == "or":
        return any(holds(k, words, tags) for k in node.kids)
    if node.kind == "not":
        return not holds(node.kids[0], words, tags)
    if node.value[0] == "#":
        return node.value[1:] in tags
    return f" {node.value} " in f" {' '.join(words)} " or node.value.replace(" ", "") in tags


@pytest.mark.parametrize("most", [2000, 0])
def test_index_join_is_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(T, "MOST_LITERAL_KEYS", most)
    random.seed(7)
    names = ["banjir", "jakarta", "demo", "dpr", "kopi", "gaji", "naik", "é", "ab"]
    queries = [T.compiled(f"q{i}", q) for i, q in enumerate(["banjir jakarta", '"demo dpr" or kopi', "gaji -naik", "#demo or ab", "not kopi demo", "(banjir or demo) (jakarta or dpr)", "é", '"gaji naik" not #dpr', "kopi or ab"])]
    rows = [(i, " ".join(random.choice(["", "#"]) + random.choice(names) for _ in range(random.randrange(7)))) for i in range(400)]
    items = T.prepared(spark.createDataFrame(rows, "id long, text string"), lang=None)
    got = {(r.id, r.query) for r in T.matches(items, queries, ["id"]).collect()}
    want = set()
    for i, text in rows:
        text = text.replace("é", "e")
        words, tags = [w for w in re.split(r"\W+", text) if w], set(re.findall(r"#(\w+)", text))
        want |= {(i, q.name) for q in queries if holds(q.tree, words, tags)}
    assert got == want


def test_language_and_tags(spark):
    rows = [(1, "satu dua tiga empat", "en"), (2, "satu dua", "en"), (3, "satu dua tiga", None), (4, "satu dua tiga", "in"), (5, "satu #iklan dua tiga", "id"), (6, "lain sama sekali", "id")]
    q = T.compiled("q", "satu", languages=["id"], not_media_tags=["Iklan"])
    got = {r.id: r.r for r in T.prepared(spark.createDataFrame(rows, "id long, text string, lang string")).select("id", T.reason(q).alias("r")).collect()}
    assert got == {1: "language", 2: "match", 3: "match", 4: "match", 5: "not_media_tags", 6: "query"}


@pytest.mark.parametrize("most", [2000, 0])
def test_rows_of_queries_mean_what_columns_mean(spark, monkeypatch, most):
    monkeypatch.setattr(T, "MOST_LITERAL_KEYS", most)
    rows = [(i, t, lang, a, tags) for i, (t, lang, a, tags) in enumerate([("satu dua tiga", "en", "@Bob", ["Iklan"]), ("satu dua tiga #kopi", "id", None, None), ("kopi susu enak sekali", None, "ann", ["promo"]), ("", None, "bob", None), (None, None, None, None), ("susu #satu", "en", "bob", [])])]
    items = T.prepared(spark.createDataFrame(rows, "id long, text string, lang string, author string, tags array<string>"), author="author", tags="tags")
    make = [("a", "satu or @bob", {}), ("b", "satu", {"languages": ["id"]}), ("c", "kopi or susu", {"media_tags": ["promo", "kopi"]}), ("d", "(satu or susu) not (kopi or @bob)", {"not_media_tags": ["iklan"]}), ("e", "satu or not kopi", {})]
    queries = [T.compiled(n, q, **k) for n, q, k in make]
    got = {(r.id, r.query) for r in T.matches(items, queries, ["id"]).collect()}
    want = {(r.id, q.name) for q in queries for r in items.filter(T.reason(q) == "match").select("id").collect()}
    assert got == want and len(want) > 8


def test_five_thousand_queries(spark):
    queries = [T.compiled(f"q{i}", f"(w{i} or w{i + 1}) and not w{i + 2}") for i in range(5000)]
    items = T.prepared(spark.createDataFrame([(i, f"w{i * 7} x w{i * 7 + 5}") for i in range(300)], "id long, text string"), lang=None)
    got = {(r.id, r.query) for r in T.matches(items, queries, ["id"]).collect()}
    has = {i: {i * 7, i * 7 + 5} for i in range(300)}
    assert got == {(i, f"q{n}") for i, ws in has.items() for w in ws for n in (w - 1, w) if 0 <= n < 5000 and n + 2 not in ws}


@pytest.mark.parametrize("text, want", [("a", {"term"}), ('a "b c"', {"and", "term", "phrase"}), ("a (b or c)", {"and", "or", "group", "term"}), ("a not (b c)", {"and", "not", "group", "term"})])
def test_features(text, want):
    assert T.features(T.parse(text)) == want


def test_limits_of_keywords_and_languages():
    for bad in ({"keywords": ["k"] * 51}, {"keywords": ["k" * 101]}, {"languages": ["xx"]}):
        with pytest.raises(T.QueryError):
            T.compiled("q", "a", **bad)


def test_a_table_of_queries(spark):
    texts = {1: "b OR a", 2: "(a OR b)", 3: "a OR", 4: None, 5: "NOT x", 6: '"one two" AND c'}
    rows = {r.k: r for r in T.catalog(spark.createDataFrame(list(texts.items()), "k long, q string"), "k", "q").collect()}
    assert rows[1].digest == rows[2].digest == T.compiled("", "a OR b").digest() and rows[1].nodes == 3
    assert all(rows[k].digest is None and rows[k].error for k in (3, 4, 5)) and rows[6].error is None
    assert (rows[6].features, rows[6].keys) == ("and,phrase,term", "#onetwo,two")  # a phrase is more special than a short term
