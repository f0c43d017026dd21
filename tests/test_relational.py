"""Relational steps, keys that are secret, pages that break off."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, values
from tidemark.operators import ops
from tidemark.operators import relational as R
from tidemark.sources import items

ROWS = [("a", 1, 0.5), ("a", 2, None), ("b", 1, 2.0), (None, 1, 1.0), ("b", 1, 2.0)]


def table(spark):
    return spark.createDataFrame(ROWS, "k string, n int, v double")


@pytest.mark.parametrize("most", [1000, 1])
def test_by_keys(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_LITERAL_KEYS", most)
    rows = table(spark)
    got = lambda keys, *cols: sorted((tuple(r) for r in R.by_keys(rows, list(cols), keys).collect()), key=str)
    assert got([("b",), ("b",), ("z",)], "k") == [("b", 1, 2.0)] * 2
    assert got([("a", 1), ("b", 1), ("a", None)], "k", "n") == [("a", 1, 0.5), ("b", 1, 2.0), ("b", 1, 2.0)]
    assert got([], "k") == [] == got([(None,)], "k")
    assert got(rows.filter("n = 2"), "k") == sorted((r for r in ROWS if r[0] == "a"), key=str)


def test_star_replace(spark):
    out = R.star_replace(table(spark), {"n": F.col("n") + F.lit(10)})
    assert out.columns == ["k", "n", "v"] and sorted(r.n for r in out.collect()) == [11, 11, 11, 11, 12]
    with pytest.raises(ValueError, match="nowhere"):
        R.star_replace(table(spark), {"nowhere": F.lit(1)})


def test_unnest(spark):
    rows = spark.createDataFrame([(1, '[{"k":1},{"k":2}]'), (2, "[]"), (3, None), (4, "broken")], "id int, j string")
    assert sorted((r.id, r.x.k) for r in R.unnest_json(rows, "j", "struct<k:int>", "x").collect()) == [(1, 1), (1, 2)]
    assert {r.id for r in R.unnest_json(rows, "j", "struct<k:int>", "x", keep_empty=True).collect()} == {1, 2, 3, 4}


def test_pages_and_samples(spark):
    rows = spark.range(300)
    assert [r.id for r in R.page(rows, [("id", "desc")], 3, 2).collect()] == [297, 296, 295]
    assert R.page(rows, [("id", "asc")], 5000).count() == 100 and R.page(rows, [("id", "asc")], 0, -4).first().id == 0
    small, large = ({r.id for r in R.hashed_sample(rows.repartition(n), "id", k).collect()} for n, k in ((3, 20), (7, 60)))
    assert small < large and len(large) == 60


def test_orders_and_lists(spark):
    rows = table(spark)
    first = lambda how: [r.k for r in rows.orderBy(*R.ordering([("k", how), ("n", "asc"), ("v", "asc")])).collect()]
    assert first("asc")[0] is None and first("asc nulls last")[-1] is None and first("desc")[0] is None and first("desc nulls last")[0] == "b"
    lists = [spark.createDataFrame([(i,) for i in part], "i int") for part in ([5, 1, 9], [2, 8], [])]
    assert [r.i for r in R.merge_sorted(lists, [("i", "asc")], 4).collect()] == [1, 2, 5, 8]


def test_sets(spark):
    rows = spark.createDataFrame([([1, 2],), ([],), ([3],), ([2, 2],)], "a array<int>")
    assert [r.x for r in rows.select(R.subset_of(F.col("a"), F.array(F.lit(1), F.lit(2))).alias("x")).collect()] == [True, True, False, True]
    assert sorted((r.k, r.n) for r in R.without(table(spark).filter("k is not null"), table(spark).filter("n = 2"), ["k"]).collect()) == [("b", 1)] * 2


def test_keys_that_are_secret(spark):
    keys = {"Authorization": True, "set-cookie": True, "SET_COOKIE": True, "my_api_key": True, "db-password": True, "tokens": False, "otp": True, "note": False, "secretary": False}
    rows = spark.createDataFrame([({k: "Bearer abcdefgh1" for k in keys},)], "m map<string,string>")
    got = rows.select(text.redact_map(F.col("m")).alias("m")).first().m
    assert {k: v == "[REDACTED]" for k, v in got.items()} == keys and got["note"] == "Bearer [REDACTED]"
    personal = {"Email": 0, "e-mails": 0, "phone_number": 0, "addresses": 0, "birthDay": 0, "bio_links": 0, "bio_link": 1, "emailing": 1, "bio": 1}
    rows = spark.createDataFrame([({k: "x" for k in personal},)], "m map<string,string>")
    assert set(rows.select(text.without_personal(F.col("m")).alias("m")).first().m) == {k for k, v in personal.items() if v}


def test_first_valid_time(spark):
    rows = spark.createDataFrame([("soon", "1700000000"), (None, None), ("2024-01-01T00:00:00Z", "1700000000")], "a string, b string")
    assert [str(r[0]) for r in rows.select(values.first_time(F.col("a"), F.col("b"))).collect()] == ["2023-11-14 22:13:20", "None", "2024-01-01 00:00:00"]


def line(i, **more):
    return json.dumps({"platform": "x", "id": str(i), "created_at": "1700000000", "author": {"id": "a", "handle": "h"}} | more)


def test_pages_that_break_off(spark, tmp_path):
    whole = "\n".join(line(i, text="some text " * 50 + str(random.Random(i).random())) for i in range(400)) + "\n"
    (tmp_path / "1.jsonl").write_text(line(1) + "\n" + line(2, author=None) + "\n")
    (tmp_path / "2.jsonl.gz").write_bytes(gzip.compress(whole.encode()))
    cut = gzip.compress(whole.encode())
    (tmp_path / "3.jsonl").write_text(line(900) + "\n" + line(901)[:30])
    (tmp_path / "4.jsonl.gz").write_bytes(cut[: len(cut) // 2])
    paths = [f"file:{tmp_path}/{n}" for n in ("1.jsonl", "2.jsonl.gz", "3.jsonl", "4.jsonl.gz", "5.jsonl")]
    rows, report = items.fetched(spark, paths)
    got = {r.page: (r.items, r.dropped, r.status) for r in report.collect()}
    assert got["1.jsonl"] == (1, 1, "read") and got["2.jsonl.gz"] == (400, 0, "read")
    assert got["3.jsonl"] == (1, 1, "partial") and got["5.jsonl"] == (0, 0, "missing")
    ids = [r.post_id for r in rows.collect()]
    assert len(ids) == len(set(ids)) and {"1", "900", *map(str, range(400))} == set(ids)
    assert items.fetched(spark, paths[4:])[0].collect() == []


def test_comments_carry_parent_and_root(spark, tmp_path):
    lines = [line(1, is_comment=True, is_repost=True, reply_to="v"), line(2, is_comment=True, reply_to="c1", root="v"), line(3, reply_to="p"), line(4)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = {r.post_id: (r.content_type, r.parent_post_id, r.root_post_id) for r in items.normalized(items.read_items(spark, str(tmp_path))).collect()}
    assert got == {"1": ("comment", "v", "v"), "2": ("comment", "c1", "v"), "3": ("reply", "p", None), "4": ("post", None, None)}


def test_soft_caps_begin_at_home(spark):
    now = F.lit("2026-03-31 18:00:00").cast("timestamp")
    policies = [("j", "month", "Asia/Jakarta", 5, None), ("u", "month", "UTC", 5, None), ("d", "day", "Asia/Jakarta", 5, "before"), ("f", "day", "UTC", 5, "before")]
    p = spark.createDataFrame([(i, "tenant", "t", period, "usd", most, zone, True, False, was) for i, period, zone, most, was in policies], "policy_id string, scope_type string, scope_id string, period string, unit string, most long, reset_tz string, enabled boolean, hard boolean, throttled_since string")
    u = spark.createDataFrame([("tenant", "t", "month", "usd", "2026-03-01", 9), ("tenant", "t", "day", "usd", "2026-04-01", 5)], "scope_type string, scope_id string, period string, unit string, period_start string, used long").withColumn("period_start", F.to_date("period_start"))
    got = {r.policy_id: (str(r.period_start), r.used, r.change) for r in ops.soft_caps(p, u, now).collect()}
    assert got == {"j": ("2026-04-01", 0, None), "u": ("2026-03-01", 9, "throttled"), "d": ("2026-04-01", 5, None), "f": ("2026-03-31", 0, "released")}
