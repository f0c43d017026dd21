"""Boolean topic queries compiled to Columns, and the join of many queries with many items.

``parse`` reads terms, phrases, #tags, @authors, AND/OR/NOT (any case), a leading minus and parentheses; side by side
means AND. One query becomes one Column over prepared items, so that Catalyst simplifies and compiles it. Many queries
are rows of a table: ``matches`` joins items with it through the keys that any match must contain (equi-joins), then
evaluates each candidate's tree from its row, so that the plan is the same for six queries and for many thousands.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import fold, hashtags_in, normalize_lang, normalize_text, tokenize

# Limits of a query.
MOST_CHARACTERS, MOST_DEPTH, MOST_NODES = 2000, 10, 200
MOST_KEYWORDS, MOST_KEYWORD = 50, 100
LANGUAGES = ("id", "en", "ms")

#: Index keys that are written into the plan itself.
MOST_LITERAL_KEYS = 2000

#: A table of queries is broadcast up to so many bytes, which the driver counts as it writes them.
BROADCAST_BYTES = 32 << 20

#: A query as a row: its tree in ``nodes``, kids before parents, by their places.
PROGRAM = "q_no int, query string, topic string, q_keys array<string>, nodes array<struct<kind:string,value:string,tag:string,kids:array<int>>>, languages array<string>, media array<string>, not_media array<string>"

TOKEN = re.compile(r"""\s*(?:(?P<open>\()|(?P<close>\))|["“”](?P<phrase>[^"“”]*)["“”]|(?P<minus>-(?=\S))|(?P<word>[^\s()"“”]+))""")
AUTHOR = re.compile(r"@([A-Za-z0-9._]{1,64})")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """``kind`` is term, phrase, not, and, or."""

    kind: str
    value: str = ""
    kids: tuple[Node, ...] = ()

    def plain(self):
        return {"type": self.kind, "value": self.value} if self.kind in ("term", "phrase") else {"type": self.kind, "children": [k.plain() for k in self.kids]}


def words_of(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", fold(text)) if t]


def leaf(text: str, quoted: bool) -> Node:
    if not quoted and (m := AUTHOR.fullmatch(text)):
        return Node("term", "@" + m[1].lower())
    words = words_of(text)
    if not words:
        raise QueryError(f"no letter or digit in {text!r}")
    if len(words) > 1:
        return Node("phrase", " ".join(words))
    return Node("term", ("#" if text.startswith("#") and not quoted else "") + words[0])


def group(kind: str, parts: list[Node]) -> Node:
    """One node of the parts; parts of the same kind are taken apart."""
    flat = [k for p in parts for k in (p.kids if p.kind == kind else (p,))]
    return flat[0] if len(flat) == 1 else Node(kind, kids=tuple(flat))


def negated(node: Node) -> Node:
    return node.kids[0] if node.kind == "not" else Node("not", kids=(node,))


def tokens(text: str) -> list[tuple[str, str]]:
    if len(text) > MOST_CHARACTERS:
        raise QueryError("the query is too long")
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"a quote is not closed at {at + 1}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "minus" and m.start("minus") > 0 and text[m.start("minus") - 1] not in " \t\n(":
            raise QueryError(f"a stray minus at {m.start('minus') + 1}")
        if kind == "word" and value.upper() in ("AND", "OR", "NOT"):
            kind = value.lower()
        out.append(("not" if kind == "minus" else kind, value))
        at = m.end()
    return out


def parse(text: str) -> Node:
    rest = tokens(text)[::-1]

    def ahead() -> str:
        return rest[-1][0] if rest else ""

    def either(depth: int) -> Node:
        parts = [both(depth)]
        while ahead() == "or":
            rest.pop()
            parts.append(both(depth))
        return group("or", parts)

    def both(depth: int) -> Node:
        parts = [single(depth)]
        while ahead() in ("and", "word", "phrase", "open", "not"):
            if ahead() == "and":
                rest.pop()
            parts.append(single(depth))
        return group("and", parts)

    def single(depth: int) -> Node:
        if depth > MOST_DEPTH:
            raise QueryError("too many levels of parentheses")
        if not rest:
            raise QueryError("the query ends where a word is due")
        kind, value = rest.pop()
        if kind == "not":
            return negated(single(depth))
        if kind in ("word", "phrase"):
            return leaf(value, kind == "phrase")
        if kind != "open":
            raise QueryError(f"{value!r} is out of place")
        inner = either(depth + 1)
        if not rest or rest.pop()[0] != "close":
            raise QueryError("a parenthesis is not closed")
        return inner

    tree = either(0)
    if rest:
        raise QueryError(f"{rest[-1][1]!r} is out of place")
    checked(tree)
    return tree


def leaves(node: Node, positive: bool = True) -> list[tuple[Node, bool]]:
    if node.kind in ("term", "phrase"):
        return [(node, positive)]
    return [x for k in node.kids for x in leaves(k, positive != (node.kind == "not"))]


def size(node: Node) -> int:
    return 1 + sum(map(size, node.kids))


def checked(node: Node) -> None:
    if size(node) > MOST_NODES:
        raise QueryError("the query has too many parts")
    if not any(positive for _, positive in leaves(node)):
        raise QueryError("the query needs something to look for")


def merge_keywords(tree: Node, keywords: list[str]) -> Node:
    """Keywords as alternatives of the positive part, so that its NOTs still hold."""
    if not keywords:
        return tree
    if len(keywords) > MOST_KEYWORDS or any(len(k) > MOST_KEYWORD for k in keywords):
        raise QueryError("too many keywords, or one is too long")
    extra = [leaf(k, True) if " " in k else leaf(k, False) for k in keywords]
    parts = list(tree.kids) if tree.kind == "and" else [tree]
    nots, core = [p for p in parts if p.kind == "not"], [p for p in parts if p.kind != "not"]
    return group("and", [group("or", [group("and", core), *extra] if core else extra), *nots])


def features(node: Node, depth: int = 0) -> set[str]:
    """What a source must be able to do for this query; a nested AND or OR needs groups."""
    own = {node.kind, "group"} if node.kind in ("and", "or") and depth else {node.kind}
    return own.union(*(features(k, depth + 1) for k in node.kids))


def canonical(node: Node) -> Node:
    if not node.kids:
        return node
    kids = sorted({json.dumps(k.plain(), ensure_ascii=False): k for k in map(canonical, node.kids)}.items())
    return kids[0][1] if len(kids) == 1 and node.kind != "not" else Node(node.kind, kids=tuple(k for _, k in kids))


def cover(node: Node) -> tuple[Node, ...] | None:
    """The fewest (then most special) leaves of which any match contains one; None where there are none."""
    if node.kind in ("term", "phrase"):
        return (node,)
    if node.kind == "not":
        return None
    parts = [cover(k) for k in node.kids]
    if node.kind == "or":
        return None if None in parts else tuple(dict.fromkeys(x for p in parts for x in p))
    # What a leaf, a phrase and a letter count for
    cost = lambda ls: 1000 * len(ls) - sum(100 * (x.kind == "phrase") + len(x.value) for x in ls)
    return min((p for p in parts if p is not None), key=cost, default=None)


@dataclass(frozen=True)
class Query:
    """A compiled topic query and its filters."""

    name: str
    tree: Node
    topic: str = ""
    languages: tuple[str, ...] = ()
    media_tags: tuple[str, ...] = ()
    not_media_tags: tuple[str, ...] = ()

    def digest(self) -> str:
        """Equal for queries of the same meaning."""
        what = {"ast": canonical(self.tree).plain(), "languages": sorted(self.languages), "media": sorted(self.media_tags), "not": sorted(self.not_media_tags)}
        return hashlib.sha256(json.dumps(what, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def compiled(name: str, text: str, *, topic: str = "", keywords: list[str] = (), languages=(), media_tags=(), not_media_tags=(), known=LANGUAGES) -> Query:
    """A query; ``languages`` must be among the ``known`` ones."""
    if not set(languages) <= set(known):
        raise QueryError("an unknown language")
    tags = lambda ts: tuple("".join(words_of(t)) for t in ts)
    return Query(name, merge_keywords(parse(text), list(keywords)), topic or name, tuple(languages), tags(media_tags), tags(not_media_tags))


def prepared(items: DataFrame, *, text: str = "text", lang: str | None = "lang", author: str | None = None, hashtags: str | None = None, tags: str | None = None) -> DataFrame:
    """``items`` with ``q_joined``, ``q_words``, ``q_hashtags``, ``q_lang``, ``q_tags`` and ``q_author``.

    All but language and author are never null, and say so: else conditions on them would have the optimizer look for
    nulls below, preparing each item a second time.
    """
    sure = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "")) if c else F.array().cast("array<string>")
    out = items.withColumn("q_text", normalize_text(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("q_hashtags", sure(F.array_distinct(F.concat(clean(hashtags), hashtags_in(F.col("q_text"))))))
    return out.withColumns(
        {
            "q_joined": F.coalesce(F.concat(F.lit(" "), F.array_join(tokenize(F.col("q_text")), " "), F.lit(" ")), F.lit("  ")),
            "q_words": F.size(tokenize(F.regexp_replace("q_text", r"#[\p{L}\p{N}_]+", " "))),
            "q_lang": normalize_lang(F.col(lang)) if lang else F.lit(None).cast("string"),
            "q_tags": sure(F.array_distinct(F.concat(clean(tags), F.col("q_hashtags")))),
            "q_author": F.regexp_replace(F.lower(F.col(author)), "^@", "") if author else F.lit(None).cast("string"),
        }
    ).drop("q_text")


def to_column(node: Node) -> Column:
    """The tree as a condition on a prepared item."""
    if node.kind in ("and", "or"):
        parts = map(to_column, node.kids)
        return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), parts)
    if node.kind == "not":
        return ~to_column(node.kids[0])
    v = node.value
    if v.startswith("@"):
        return F.coalesce(F.col("q_author") == v[1:], F.lit(False))
    if v.startswith("#"):
        return F.array_contains("q_hashtags", v[1:])
    return F.col("q_joined").contains(f" {v} ") | F.array_contains("q_hashtags", v.replace(" ", ""))


def reason(q: Query) -> Column:
    """``match``, or the first filter that an item fails. An unknown language passes, as does that of a short text."""
    out = F.when(to_column(q.tree), "match").otherwise("query")
    if q.not_media_tags:
        out = F.when(F.arrays_overlap("q_tags", F.array(*map(F.lit, q.not_media_tags))), "not_media_tags").otherwise(out)
    if q.media_tags:
        out = F.when(~F.arrays_overlap("q_tags", F.array(*map(F.lit, q.media_tags))), "media_tags").otherwise(out)
    if q.languages:
        out = F.when(F.col("q_lang").isNotNull() & (F.col("q_words") >= 3) & ~F.col("q_lang").isin(*q.languages), "language").otherwise(out)
    return out


def index_keys(q: Query) -> list[str]:
    """Keys of which any match has one: a token, a joined hashtag, an @author; '' where the query needs a look at every item."""
    found = cover(q.tree)
    if found is None:
        return [""]
    keys = []
    for x in found:
        if x.kind == "phrase":
            keys += [max(x.value.split(" "), key=lambda w: (len(w), w)), "#" + x.value.replace(" ", "")]
        else:
            keys += [x.value] if x.value[0] in "@#" else [x.value, "#" + x.value]
    return sorted(set(keys))


def program(node: Node) -> list[tuple[str, str, str, list[int]]]:
    """The nodes of a tree as rows, kids before parents; the root is the last."""
    out: list[tuple[str, str, str, list[int]]] = []

    def put(n: Node) -> int:
        kids = [put(k) for k in n.kids]
        v = n.value
        kind = n.kind if kids else {"@": "author", "#": "tag"}.get(v[:1], "text")
        out.append((kind, v[1:] if kind in ("author", "tag") else f" {v} ", v.replace(" ", ""), kids))
        return len(out) - 1

    put(node)
    return out


def holds(nodes: Column) -> Column:
    """``to_column`` for a tree that stands in a row: each node's value from those before it."""

    def step(done: Column, n: Column) -> Column:
        at = lambda k: F.get(done, k)
        text = F.col("q_joined").contains(n["value"]) | F.array_contains(F.col("q_hashtags"), n["tag"])
        own = F.when(n["kind"] == "text", text).when(n["kind"] == "tag", F.array_contains(F.col("q_hashtags"), n["value"]))
        own = own.when(n["kind"] == "author", F.coalesce(F.col("q_author") == n["value"], F.lit(False)))
        own = own.when(n["kind"] == "and", F.forall(n["kids"], at)).when(n["kind"] == "or", F.exists(n["kids"], at))
        return F.concat(done, F.array(own.otherwise(~at(F.get(n["kids"], F.lit(0))))))

    return F.element_at(F.aggregate(nodes, F.array().cast("array<boolean>"), step), -1)


def passes() -> Column:
    """``reason(q) == 'match'`` for a query that stands in the item's row."""
    any_of = lambda c: F.arrays_overlap(F.col("q_tags"), F.col(c))
    lang = (F.size("languages") == 0) | F.col("q_lang").isNull() | (F.col("q_words") < 3) | F.array_contains(F.col("languages"), F.col("q_lang"))
    return lang & ((F.size("media") == 0) | any_of("media")) & ~any_of("not_media") & holds(F.col("nodes"))


def with_small(rows: DataFrame, many: int, small: DataFrame, key: str) -> DataFrame:
    """An equi-join with a table of queries of ``many`` bytes."""
    return rows.join(F.broadcast(small) if many <= BROADCAST_BYTES else small, key)


def matches(items: DataFrame, queries: list[Query], keys: list[str]) -> DataFrame:
    """(item key columns, query, topic) of every match; ``items`` are prepared.

    Up to MOST_LITERAL_KEYS index keys each item is looked at on its own and nothing is shuffled: the item goes on for
    each key that it has, and of a query's several keys only the first in the item counts. Beyond that the items' keys
    alone are joined with the index, and what they find is joined back to the items.
    """
    spark = items.sparkSession
    per_query = [index_keys(q) for q in queries]
    index_rows = [(k, i) for i, ks in enumerate(per_query) for k in ks]
    program_rows = [(i, q.name, q.topic, ks, program(q.tree), list(q.languages), list(q.media_tags), list(q.not_media_tags)) for i, (q, ks) in enumerate(zip(queries, per_query, strict=True))]
    index_bytes = sum(len(k.encode()) + 64 for k, _ in index_rows)
    program_bytes = sum(512 + sum(len(k.encode()) + 16 for k in r[3]) + sum(2 * len(n[1].encode()) + 4 * len(n[3]) + 96 for n in r[4]) for r in program_rows)
    index, programs = spark.createDataFrame(index_rows, "q_key string, q_no int"), spark.createDataFrame(program_rows, PROGRAM)
    own = F.concat(F.split(F.trim("q_joined"), " "), F.transform("q_hashtags", lambda t: F.concat(F.lit("#"), t)), F.array(F.concat(F.lit("@"), F.coalesce("q_author", F.lit(""))), F.lit("")))
    known = sorted({k for k, _ in index_rows})
    if len(known) <= MOST_LITERAL_KEYS:
        each = F.flatten(F.transform(F.array(F.array_intersect(own, F.array(*map(F.lit, known)))), lambda ks: F.transform(ks, lambda k: F.struct(k.alias("q_key"), ks.alias("q_found")))))
        # outer, as no filter is then inferred, which would prepare each item a second time; the join drops items without a key
        found = items.withColumn("q_hit", F.explode_outer(each)).select(*items.columns, "q_hit.q_key", "q_hit.q_found")
        found = with_small(with_small(found, index_bytes, index, "q_key"), program_bytes, programs, "q_no")
        found = found.filter(F.get(F.array_intersect("q_keys", "q_found"), F.lit(0)) == F.col("q_key"))
    else:
        pairs = with_small(items.select(*keys, F.explode(F.array_distinct(own)).alias("q_key")), index_bytes, index, "q_key")
        found = with_small(items.join(pairs.select(*keys, "q_no").distinct(), keys), program_bytes, programs, "q_no")
    return found.filter(passes()).select(*keys, "query", "topic")


CATALOG = "digest string, nodes int, features string, keys string, error string"


def catalog(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and what each query text of a table is: digest (equal for equal meanings), number of parts, what a source must be able to do, index keys; or what is wrong with it.

    Query texts are short; they are parsed in Arrow batches, where the table lies.
    """
    kind = texts.schema[key].dataType.simpleString()

    def told(value: str | None) -> tuple:
        try:
            q = compiled("", value or "")
        except QueryError as e:
            return (None, None, None, None, str(e))
        return (q.digest(), size(q.tree), ",".join(sorted(features(q.tree))), ",".join(index_keys(q)), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([told(v) for v in b["text"]], columns=["digest", "nodes", "features", "keys", "error"])
            out.insert(0, key, b[key].to_numpy())
            yield out.astype({"nodes": "Int32"})

    return texts.select(F.col(key), F.col(text).alias("text")).mapInPandas(run, f"`{key}` {kind}, {CATALOG}")


def first_per_topic(found: DataFrame, keys: list[str]) -> DataFrame:
    """One match of each topic: the query that sorts first."""
    return found.groupBy(*keys, "topic").agg(F.min("query").alias("query"))
