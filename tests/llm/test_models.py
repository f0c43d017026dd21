"""Language and quality models: held-out accuracy, and odd inputs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import language, quality

DIR = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "1234 !!"), (4, "x"), (5, "a" * 400_000), (None, "the end of the day"), (4, "x")]
SCHEMA = "doc_id long, text string, score string, at string"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = language.op2(spark, DIR).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("held_out and n > 40")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], SCHEMA)
    models = language.train(spark.read.parquet(f"{DIR}/documents.parquet"), sample=200)
    got = language.predict(docs, models).collect()
    assert len(got) == len(ODD)
    assert {r.id for r in got if r.lang_pred == language.UNKNOWN} == {1, 2, 3}
    assert all(0 <= r.score <= 1 for r in got)
    assert language.predict(docs.limit(0), models).collect() == []
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {language.UNKNOWN}
    one = language.train(spark.createDataFrame([(1, "en", "some text")], "doc_id long, lang string, text string"))
    assert {r.lang_pred for r in language.predict(docs, one).collect()} == {language.UNKNOWN, "en"}


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    out = quality.op5(spark, DIR).join(labels, "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_quality_odd_rows(spark):
    random.seed(3)
    docs = [(i, " ".join(random.choice(["good", "fine", "text"] if i % 2 else ["bad", "###", "junk"]) for _ in range(30)), "c", "c") for i in range(100, 160)]
    table = spark.createDataFrame(docs + [(*r, "c", "c") for r in ODD], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(100, 150)] + [(100, 0, 1), (101, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels)
    got = quality.predict(table, model).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.id % 2 for r in got if r.id is not None and r.id >= 150)
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 100} == {i for i in range(101, 160, 2)}
    assert {r.score for r in quality.predict(table, quality.train(table, labels.limit(0))).collect()} == {0.5}
    assert quality.predict(table.limit(0), model).collect() == []


def test_one_id_repeated_very_often(spark):
    """An id counts once, so that what is gathered stays within the sample."""
    rows = [(i, "the end of the day is near and so it is" if i % 2 else "das Ende der Tage ist nah und so ist es", "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = docs.union(docs.filter("doc_id = 7").crossJoin(spark.range(20_000)).select("doc_id", "text", "lang"))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    a, b = quality.train(docs, labels), quality.train(often, labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    probe = docs.limit(6)
    scores = [[(r.id, r.lang_pred, round(r.score, 6)) for r in language.predict(probe, m).collect()] for m in (language.train(docs, sample=4000), language.train(often, sample=40_000))]
    assert scores[0] == scores[1]


def dual(rows, labels, cost):
    """The hinge-loss dual by projected gradient steps over all coordinates, without the package's solver."""
    x = np.zeros((len(rows), quality.SIZE + 1))
    for i, (at, value) in enumerate(rows):
        x[i, at], x[i, -1] = value, 1.0
    x = x[:, (x != 0).any(axis=0)]
    gram = (x @ x.T) * np.outer(labels, labels)
    alpha = np.zeros(len(rows))
    for _ in range(3000):
        for i in range(len(rows)):
            alpha[i] = min(cost, max(0.0, alpha[i] - (gram[i] @ alpha - 1) / gram[i, i]))
    return x @ (x.T @ (alpha * labels))


def test_margins_equal_those_of_a_plain_solver():
    random.seed(5)
    words = ["good", "fine", "text", "here", "bad", "###", "junk", "spam"]
    texts = [" ".join(random.choice(words[:6] if i % 2 else words[2:]) for _ in range(12)) for i in range(40)]
    labels = np.array([i % 2 for i in range(40)])
    rows = quality.features(pa.array(texts))
    model = quality.Model(rows, labels)
    scaled = [(r, model.ratio[r] / max(1e-9, float(np.sqrt((model.ratio[r] ** 2).sum())))) for r in rows]
    want = dual(scaled, np.where(labels == 1, 1.0, -1.0), 10.0)
    got = np.array([float(model.weights[r].sum()) / float(np.sqrt((model.ratio[r] ** 2).sum())) for r in rows]) + model.bias
    assert np.abs(got - want).max() < 0.05 and (np.sign(got) == np.where(labels == 1, 1, -1)).all()


# --- language: pairs by a plain solver, families and votes by loops ---


def plain_margins(rows, signs, cost, probe):
    """The hinge-loss dual with a bound for each row, by steps over all coordinates, in dense numbers."""
    wide = lambda rs: np.array([np.append(np.bincount(at, weights=v, minlength=language.SIZE), 1.0) for at, v in rs])
    x, z = wide(rows), wide(probe)
    gram = (x @ x.T) * np.outer(signs, signs)
    alpha = np.zeros(len(rows))
    for _ in range(2000):
        for i in range(len(rows)):
            alpha[i] = min(cost[i], max(0.0, alpha[i] - (gram[i] @ alpha - 1) / gram[i, i]))
    return z @ (x.T @ (alpha * signs))


def plain_vote(names, margin):
    """Most won pairs, then the surest: ``margin(one, other)`` is above 0 where the first wins."""
    sure = lambda m: 1 / (1 + np.exp(-3 * m))
    wins = {n: [sure(margin(n, o) if n < o else -margin(o, n)) for o in names if o != n] for n in names}
    return max(sorted(names), key=lambda n: (sum(p > 0.5 or (p == 0.5 and n < min(o for o in names if o != n)) for p in wins[n]), min(wins[n], default=1.0)))


def test_language_against_a_plain_solver():
    rng = random.Random(13)
    words = {"en": "the of and house water with that they from", "de": "der die und haus wasser mit dass sie von", "nl": "de het en huis water met dat zij van", "fr": "le la et maison eau avec que ils de", "es": "el la y casa agua con que ellos de", "ru": "и в дом вода с что они из на"}
    text = lambda lang: " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(6, 20)))
    labels = [lang for lang in words for _ in range(7)]
    probe_labels = [lang for lang in words for _ in range(5)]

    def features(texts):
        at, offsets = language.grams(pa.array(texts))
        found = [np.unique(at[a:b], return_counts=True) for a, b in zip(offsets, offsets[1:], strict=False)]
        return [(i, n / n.sum() * language.SCALE) for i, n in found], at, offsets

    rows, _, _ = features([text(lang) for lang in labels])
    probe, at, offsets = features([text(lang) for lang in probe_labels])
    models = language.Models(labels, rows)
    family = [language.FAMILY.get(x, x) for x in labels]
    want = {}
    for level, one, other in models.pairs:
        of = family if level == "family" else labels
        chosen = [i for i, x in enumerate(of) if x in (one, other)]
        signs = np.array([1.0 if of[i] == one else -1.0 for i in chosen])
        cost = np.array([10.0 * len(chosen) / (2 * (signs == s).sum()) for s in signs])
        want[level, one, other] = plain_margins([rows[i] for i in chosen], signs, cost, probe)
        got = models.margins(at, offsets, (level, one, other))
        assert np.abs(got - want[level, one, other]).max() < 0.1, (level, one, other)
    assert set(models.members) == {"germanic", "romance", "slavic"} and sum(level == "lang" for level, _, _ in models.pairs) == 4
    predicted, score = models.predict(at, offsets)
    for i in range(len(probe)):
        f = plain_vote(models.families, lambda a, b, i=i: want["family", a, b][i])
        assert predicted[i] == plain_vote(models.members[f], lambda a, b, i=i: want["lang", a, b][i])
    assert (predicted == np.array(probe_labels, dtype=object)).mean() > 0.9 and ((score > 0) & (score <= 1)).all()
