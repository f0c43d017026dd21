"""Language identification by hierarchical discrimination.

A text's family is predicted first, then one-versus-one linear support vector machines separate the languages within
that family. Features are the shares of a text's byte bigrams and trigrams (letters only, lower case, hashed).

Models are fitted on at most SAMPLE labelled texts, shared equally by the languages and chosen by a hash of the id,
each read whole. A text that is null or has no letter is ``und`` with score 0; ties go to the language that sorts
first. With no labelled text at all every text is ``und``; with one language every text with a letter is that one.
Repeated rows repeat their result; a text of any length is read whole; one scan, no shuffle. The operator reads the id,
language and text columns only, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, flat_bytes, text_chunks
from tidemark.llm.grams import U, fit_hinge

#: Labelled texts to fit on, over all languages: a bound that does not grow with the input.
SAMPLE = 2400

#: Hashed features.
SIZE = 1 << 14

#: Shares of n-grams are small; this brings rows to a norm near one.
SCALE = 25.0

UNKNOWN = "und"

# Families of language codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr tt ug uz",
    "uralic": "et fi hu se",
    "indic": "bn gu hi mr ne pa ur",
    "malay": "id jv ms su tl",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in order, and n + 1 offsets of the texts among them."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(texts, "")), "", " ")
    data, offsets = flat_bytes(padded)
    data = LETTERS[data]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = (data != 32) | np.append(True, (data[:-1] != 32) | (owner[1:] != owner[:-1]))
    data, owner = data[keep].astype(U), owner[keep]
    pair = data[:-1] << U(8) | data[1:]
    triple = pair[:-1] << U(8) | data[2:]
    multiply, shift = U(0x9E3779B97F4A7C15), U(64 - SIZE.bit_length() + 1)
    two = ((pair + U(1 << 30)) * multiply >> shift).astype(np.int32)
    three = (triple * multiply >> shift).astype(np.int32)
    in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    at = np.concatenate([two[in_two], three[in_three]])
    who = np.concatenate([owner[:-1][in_two], owner[:-2][in_three]])
    order = np.argsort(who, kind="stable")
    return at[order], np.searchsorted(who[order], np.arange(len(texts) + 1))


def has_letter(texts: pa.Array) -> np.ndarray:
    plain = np.asarray(pc.match_substring_regex(pc.fill_null(texts, ""), "[A-Za-z]").to_numpy(zero_copy_only=False), dtype=bool)
    for i in np.flatnonzero(~plain):
        plain[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return plain


class Models:
    """A linear model for each pair of families, and for each pair of languages within a family."""

    def __init__(self, labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]]):
        langs = sorted(set(labels))
        self.members: dict[str, list[str]] = {}
        for lang in langs:
            self.members.setdefault(FAMILY.get(lang, lang), []).append(lang)
        self.families = sorted(self.members)
        family = [FAMILY.get(x, x) for x in labels]
        self.pairs = {("family", *p): self.fit(family, rows, *p) for p in combinations(self.families, 2)}
        for members in self.members.values():
            self.pairs |= {("lang", *p): self.fit(labels, rows, *p) for p in combinations(members, 2)}

    @staticmethod
    def fit(labels: list[str], rows: list, one: str, other: str) -> tuple[np.ndarray, float]:
        chosen = [i for i, x in enumerate(labels) if x in (one, other)]
        signs = np.array([1.0 if labels[i] == one else -1.0 for i in chosen])
        share = {s: max(1, int((signs == s).sum())) for s in (1.0, -1.0)}
        cost = np.array([10.0 * len(chosen) / (2 * share[s]) for s in signs])
        weights, bias = fit_hinge([rows[i] for i in chosen], signs, SIZE, cost)
        return (weights * SCALE).astype(np.float32), bias

    def margins(self, at: np.ndarray, offsets: np.ndarray, key: tuple) -> np.ndarray:
        weights, bias = self.pairs[key]
        sums = np.append(0.0, np.cumsum(weights[at], dtype=np.float64))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, np.diff(offsets)) + bias

    def choose(self, at: np.ndarray, offsets: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The name with most won pairs for each text, and the least of its sigmoid margins."""
        n = len(offsets) - 1
        wins, certain = np.zeros((len(names), n)), np.ones((len(names), n))
        for (i, one), (j, other) in combinations(enumerate(names), 2):
            p = 1.0 / (1.0 + np.exp(-np.clip(3.0 * self.margins(at, offsets, (level, one, other)), -30, 30)))
            wins[i] += p >= 0.5
            wins[j] += p < 0.5
            certain[i], certain[j] = np.minimum(certain[i], p), np.minimum(certain[j], 1.0 - p)
        best = np.argmax(wins + 1e-6 * certain, axis=0)
        return best, certain[best, np.arange(n)]

    def predict(self, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        family, score = self.choose(at, offsets, "family", self.families)
        out = np.full(n, UNKNOWN, dtype=object)
        for f, name in enumerate(self.families):
            mine, members = family == f, self.members[name]
            if mine.any():
                best, certain = self.choose(at, offsets, "lang", members)
                out[mine] = np.array(members, dtype=object)[best[mine]]
                score[mine] *= certain[mine]
        return out, score


def train(labelled: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> Models | None:
    """Fit on at most ``sample`` rows of ``labelled`` (rows without text or language don't count)."""
    rows = labelled.select(labelled[id_col].cast("string").alias("id"), labelled[lang_col].alias("lang"), labelled[text_col].alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(sample).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 24))
    limits = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.2 * each / n) * (1 << 24))))])
    chosen = rows.withColumn("draw", draw).filter(F.col("draw") < F.element_at(limits, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            at, offsets = grams(chunk.column("text"))
            found = [np.unique(at[a:b], return_counts=True) for a, b in zip(offsets, offsets[1:], strict=False)]
            shares = [(n / max(1, n.sum())).astype(np.float32) for _, n in found]
            yield pa.RecordBatch.from_arrays([chunk.column("lang"), chunk.column("draw"), chunk.column("id"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "draw", "id", "at", "share"])

    # bounded: 1.2 times the sample on average, each row the n-grams of one text, SIZE at most; an id counts once per
    # language, however often it is repeated
    found = chosen.select("lang", "draw", "id", "text").mapInArrow(run, "lang string, draw bigint, id string, at array<int>, share array<float>")
    found = found.groupBy("lang", "draw", "id").agg(F.min(F.struct("at", "share")).alias("x"))
    table = found.select("lang", "draw", "id", "x.at", "x.share").toArrow()
    order = sorted(zip(table["lang"].to_pylist(), table["draw"].to_pylist(), table["id"].to_pylist(), range(table.num_rows), strict=True))
    taken: dict[str, int] = {}
    labels, features = [], []
    at, share = table["at"].combine_chunks(), table["share"].combine_chunks()
    for lang, _, _, i in order:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= each and len(at[i].values):
            labels.append(lang)
            features.append((at[i].values.to_numpy(), share[i].values.to_numpy().astype(np.float64) * SCALE))
    return Models(labels, features) if labels else None


def predict(docs: DataFrame, models: Models | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a few weights per pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for chunk in text_chunks(batches):
            texts = chunk.column("text")
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if models is not None:
                lang, score = models.predict(*grams(texts))
                silent = ~has_letter(texts)
                lang[silent], score[silent] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learnt from those outside the held-out fold."""
    docs = documents(spark, sf_dir)
    models = train(docs.filter(fold(F.col("doc_id"), 5) != 0))
    return predict(docs, models).select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score")
