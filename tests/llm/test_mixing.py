import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_rate string"


def brute(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, held, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(mixing.MOST * sizes[s] for s in held)
        target = {s: mixing.MOST * sizes[s] for s in held} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > mixing.MOST * sizes[s]}
        if not over:
            return target
        held |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 900, None: 40, "é": 7, "z": 0}, {"a": 1}, {"x": 10, "y": 10, "w": 10, "v": 10}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.mix_source: r for r in mixing.targets(spark.createDataFrame(rows, "mix_source string, mix_size long")).collect()}
    for s, want in brute(sizes).items():
        assert got[s].mix_target == pytest.approx(want)
        assert got[s].mix_rate <= mixing.MOST


def test_mix(spark):
    rows = [(i, "one two three\x0bfour", "en", "big" if i % 3 else None, 3, "kept") for i in range(600)]
    rows += [(1000, None, None, "small", None, None), (1001, "", None, "small", 0, None), (1001, "a  b", None, "small", 0, None)]
    docs = spark.createDataFrame(rows, SCHEMA).drop("mix_rate").withColumn("note", F.lit("kept"))
    counted = {(r.doc_id, r.text): r for r in mixing.with_copies(docs).collect()}
    assert all(0 <= r.mix_copies <= mixing.MOST for r in counted.values())
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.mix_copies for r in counted.values())
    taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    want = {r.source: r.mix_target for r in counted.values()}
    assert taken["big"] == pytest.approx(want["big"], rel=0.1)
    assert out.exceptAll(mixing.mix(docs)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_clashing_names_and_long_texts(spark):
    names = ["MIX_SOURCE", "mix_target", "mix_size", "mix_row", "mix_own", "mix_id", "mix_copies", "mix_copy", "mix.rate"]
    docs = spark.createDataFrame([(1, "w " * 300_000, None, *["own"] * len(names)), (2, "a b", "s", *[None] * len(names))], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r.doc_id: r for r in mixing.with_copies(docs).collect()}
    assert got[1].mix_source_size == 300_000 and got[1]["mix_row"] == "own" and isinstance(got[1].mix_copies, int)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r["mix_copies"] for r in out.collect()} <= {"own", None}
    assert out.filter("doc_id = 1").count() == got[1].mix_copies
