"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by SHA-256. The ledger, a table that is only appended to, has one row
per blob and batch of rules that the blob was scanned with; a scan reads only the pairs of blob and rule version that it
lacks (``updated``), and the findings are joined back to all paths with that blob. DataFrame functions only.

A null text is the empty blob. Copies are scanned once, however many there are: they meet in a grouping that is
pre-aggregated before the shuffle. Texts are shuffled once for that; a blob's least row alone could be shuffled instead,
but its text would then have to come by a join of the same size. Findings return by an equi-join on the blob and a salt
from the path, so that a hot blob is spread over SALTS tasks. Paths may repeat; a path's several texts are versions of it, and
spans that start together (ties) are in the order of the rules. A row that was appended twice counts once. Long texts are
scanned whole. An empty table gives an empty result. The operator reads the id and text columns only, so other columns
may have any name, also in ``redact``, which keeps them all.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, shared_path
from tidemark.llm.spans import SPAN, Rule, count, digest, found, masked

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 18, "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
# A whole private key: its headers, then all up to the END line; where that is missing, the body if it begins like one.
# Neither part can hold a hyphen, so that it ends before the next marker and a long text takes linear time.
PEM = (
    r"-----BEGIN(?: [A-Z]+)* PRIVATE KEY-----(?:[\x20\x09-\x0D\\rn]*(?:Proc-Type|DEK-Info):\x20*[A-Za-z0-9,-]*){0,4}"
    r"(?:[^-]*-----END(?: [A-Z]+)* PRIVATE KEY-----|[\x20\x09-\x0D\\rn]*[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\x20\x09-\x0D\\]*)?"
)
EXTRA = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", guard="gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", guard="eyJ"),
    Rule("pem", PEM, guard="-----BEGIN"),
]
RULES = BASE + EXTRA

#: Parts of a blob's paths.
SALTS = 16

LEDGER = f"blob binary, rules array<string>, findings array<{SPAN}>"


def version(rule: Rule) -> str:
    """A rule's name in the ledger: its kind and a digest of its patterns, so that a changed pattern is another rule. ``keep`` is code: who changes that raises ``version``."""
    told = "\0".join([rule.pattern, rule.guard or "", rule.version])
    return f"{rule.kind}-{hashlib.sha256(told.encode()).hexdigest()[:12]}"


def versions(docs: DataFrame, *, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, content) of every version of every path."""
    content = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[path_col].alias("path"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("blob"), content.alias("content"))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """New ledger rows: the unseen blobs of ``history``, each with the rules it lacked and their findings."""
    names = [version(r) for r in rules]
    blobs = history.groupBy("blob").agg(F.first("content").alias("content"))
    todo = F.array(*map(F.lit, names))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        # what was scanned already drops out before texts are moved
        done = seen.filter(F.size(F.array_except(todo, F.col("seen"))) == 0).select("blob")
        blobs = history.join(done, "blob", "left_anti").groupBy("blob").agg(F.first("content").alias("content"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.select("blob", "content", todo.alias("rules"))
    none = F.array().cast(f"array<{SPAN}>")
    each = [F.when(F.array_contains("rules", n), found(F.col("content"), r, i)).otherwise(none) for i, (r, n) in enumerate(zip(rules, names, strict=True))]
    return blobs.select("blob", "rules", F.concat(*each).alias("findings"))


def findings(ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, spans) of the blobs that have any, under the present rules' versions."""
    names = [version(r) for r in rules]
    kinds = F.transform(F.array_intersect("rules", F.array(*map(F.lit, names))), lambda n: F.regexp_replace(n, "-[^-]*$", ""))
    present = ledger.withColumn("findings", F.filter("findings", lambda s: F.array_contains(kinds, s["kind"]))).filter(F.size("findings") > 0)
    return present.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("spans"))


def updated(history: DataFrame, path: str, rules: list[Rule] = RULES) -> DataFrame:
    """The ledger at ``path`` (begun where there is none) with all of ``history`` scanned under ``rules``; only what it lacked is read and appended."""
    spark = history.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    scan(history, spark.read.schema(LEDGER).parquet(path), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def joined(many: DataFrame, hits: DataFrame, path: str, blob: str) -> DataFrame:
    """``many`` with ``spans`` of its blob, or null: the few blobs with findings are repeated per salt, each row has one."""
    salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = many.withColumn("salt", F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int"))
    return rows.join(salted.withColumnRenamed("blob", "hit"), (F.col(blob) == F.col("hit")) & (rows["salt"] == salted["salt"]), "left").drop("salt", "hit")


def attach(history: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(path, blob, spans) of ``history``: the spans of each row's blob; paths without a finding have none."""
    rows = joined(history.select("path", "blob"), findings(ledger, rules), "path", "blob")
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def redact(docs: DataFrame, *, path_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", rules: list[Rule] = RULES, ledger_path: str | None = None) -> DataFrame:
    """``docs`` with each secret replaced by its kind in angle brackets; rows and columns stay.

    The ledger at ``ledger_path`` is used and updated; without one it is a new one in the shared folder.
    """
    spark = docs.sparkSession
    ledger = updated(versions(docs, path_col=path_col, text_col=text_col), ledger_path or shared_path(spark, "secret-ledger"), rules)
    blob = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[path_col].alias("path"), blob.alias("blob"))
    rows = joined(rows, findings(ledger, rules), "path", "blob")
    text = F.col(f"row.`{text_col}`")
    clean = masked(text, F.col("spans"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))
    rows = rows.select("row", "spans", F.when(F.col("spans").isNull(), text).otherwise(clean).alias("clean"))
    cells = {c: F.col(f"row.`{c}`") for c in docs.columns}
    cells[text_col] = F.col("clean").alias(text_col)
    if length_col and length_col in docs.columns:
        cells[length_col] = F.when(F.col("spans").isNull(), cells[length_col]).otherwise(F.length("clean").cast("long")).alias(length_col)
    return rows.select(*cells.values())


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, found through a ledger that begins empty."""
    history = versions(documents(spark, sf_dir))
    ledger = updated(history, shared_path(spark, "secret-ledger"))
    spans, base = F.col("spans"), [r.kind for r in BASE]
    return attach(history, ledger).select(
        F.col("path").alias("doc_id"),
        *[count(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(digest(spans, base), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL for op1's rows: pieces between matches and the matches' lengths add up to places."""
    parts = []
    for rank, (rule, keep) in enumerate([(r, {"assign": "length(regexp_extract(m, p, 2)) >= 12", "access": "length(m) >= 18"}.get(r.kind, "true")) for r in RULES]):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
              SELECT doc_id, p, ms[i] AS m, list_sum([length(x) FOR x IN gs[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS s
              FROM (SELECT doc_id, p, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, '{pattern}' AS p, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))) WHERE {keep}"""
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    line = "kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg({line}) FILTER (kind IN ({base})) AS base, string_agg({line}) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
