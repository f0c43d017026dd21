"""Text and value functions on single cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V


def out(spark, value, work, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(work(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("see https://a.b/c?d and www.x.org now", "see <url> and <url> now"),
        ("hi @bob_1 and a@b", "hi <user> and a@b"),
        ("call 081234567 in 2024, not 1899 or 20245", "call <num> in 2024, not <num> or <num>"),
        ("  a \n\t b ", "a b"),
        ("12 123 x1234 1234x", "12 123 x1234 1234x"),
        ("ﬁne\u200b ＷＷＷ.x.org １２３４５ é@bob.b", "fine <url> <num> é@bob.b"),
        (None, None),
    ],
)
def test_pseudonymize(spark, raw, want):
    assert out(spark, raw, X.pseudonymize) == want


@pytest.mark.parametrize("raw, want", [("Ünï​cödé ﬁ", "unicode fi"), ("ABC", "abc"), ("", ""), (None, None), ("É1", "e1")])
def test_normalize_text(spark, raw, want):
    assert out(spark, raw, X.normalize_text) == want


@pytest.mark.parametrize("raw, want", [("SaveTheTrees", "save the trees"), ("vote2024now", "vote 2024now"), ("plain", "plain"), ("DPRGagal_total", "dpr gagal total")])
def test_split_hashtag(spark, raw, want):
    assert out(spark, raw, X.split_hashtag) == want


def test_preprocess(spark):
    lexicon = {"gk": "nggak"}
    got = spark.createDataFrame([("gk suka #SaveTheTrees, @joe #a_b",), ("no tags",), (None,)], "v string").select(*X.preprocess(F.col("v"), lexicon)).collect()
    assert [tuple(r) for r in got] == [("nggak suka save the trees, <user> a b", ["SaveTheTrees", "a_b"]), ("no tags", []), (None, None)]


@pytest.mark.parametrize("raw, want", [("<user> ok", True), ("one two three", False), ("<url> a b <num>", True), ("", True)])
def test_is_short(spark, raw, want):
    assert out(spark, raw, X.is_short) is want


def test_clean_issues(spark):
    raw = ["Ｇaji <b>Kopdes</b>!", "a", "gaji kopdes", "#Harga-BBM @x naik", "one two three four five", "see https://a.b/c now", "last"]
    assert out(spark, raw, X.clean_issues, "array<string>") == ["gaji kopdes", "harga-bbm x naik", "see now"]
    assert out(spark, [], X.clean_issues, "array<string>") == []


def test_lexicon(spark):
    assert out(spark, "gr8 Stuff u know", lambda c: X.with_lexicon(c, {"gr8": "great", "u": "you"})) == "great Stuff you know"
    assert out(spark, "as it is", lambda c: X.with_lexicon(c, {})) == "as it is"


@pytest.mark.parametrize("raw, want", [("=1+1", "'=1+1"), ("-x", "'-x"), ("@a", "'@a"), ("a=1", "a=1"), ("\tx", "'\tx")])
def test_safe_text(spark, raw, want):
    assert out(spark, raw, X.safe_text) == want


REDACTED = [
    ("Authorization: Bearer abc.def-123==", "Authorization: Bearer [REDACTED]"),
    ("basic QWxhZGRpbjpvcGVu", "basic [REDACTED]"),
    ("jwt eyJhbGciOi.eyJzdWIi.SflKxwRJ end", "jwt [REDACTED] end"),
    ("sk-ant-abcd1234efgh", "[REDACTED]"),
    ("postgres://bob:s3cret@db/x", "postgres://bob:[REDACTED]@db/x"),
    ("GET /a?x=1&sig=abc#f", "GET /a?x=1&sig=[REDACTED]#f"),
    ("Failed query\nparams: a@b.id,1\nat", "Failed query\nparams: [REDACTED]\nat"),
    ('{"client_secret":"x y","n":1}', '{"client_secret":"[REDACTED] y","n":1}'),
    ("access_token=abc, next", "access_token=[REDACTED], next"),
    ("no secrets here", "no secrets here"),
]


@pytest.mark.parametrize("raw, want", REDACTED)
def test_redact(spark, raw, want):
    assert out(spark, raw, X.redact) == want


@pytest.mark.parametrize("raw, want", [("3", 3), ("3.9", 3), ("-1", None), ("x", None), (None, None), ("0", 0)])
def test_count_metric(spark, raw, want):
    assert out(spark, raw, V.count_metric) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Wed Oct 10 20:19:24 +0000 2018", "2018-10-10 20:19:24"),
        ("2024-02-03T04:05:06+07:00", "2024-02-02 21:05:06"),
        ("2024-02-03T04:05:06Z", "2024-02-03 04:05:06"),
        ("2024-02-03T04:05:06", None),
        ("1700000000", "2023-11-14 22:13:20"),
        ("1700000000000", "2023-11-14 22:13:20"),
        ("yesterday", None),
        (None, None),
    ],
)
def test_to_utc(spark, raw, want):
    assert out(spark, raw, lambda c: V.to_utc(c).cast("string")) == want


def test_compare_key_orders_numbers_by_value(spark):
    ids = ["9", "10", "0100", "a", "B", "100000000000000000000"]
    rows = spark.createDataFrame([(i,) for i in ids], "v string").orderBy(V.compare_key(F.col("v"))).collect()
    assert [r.v for r in rows] == ["9", "10", "0100", "100000000000000000000", "B", "a"]
