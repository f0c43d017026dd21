"""Manifests, nested objects, histograms, needles, shared streams, long place names: against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import analytics, enrich, ops, sharing, upkeep
from tidemark.sources import items


def test_manifests_tell_what_is_wrong(spark):
    rows = [(i, f"2024-0{1 + i % 5}-03", float(i), None if i % 4 else "x") for i in range(40)]
    schema = "id int, day string, v double, t string"
    good = spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("day"))
    broken = list(rows)
    broken.remove(rows[0])  # January: lost
    broken.append(rows[1])  # February: one row twice
    broken[broken.index(rows[2])] = (2, rows[2][1], 2.5, rows[2][3])  # March: changed
    broken.remove(rows[3])  # April: one lost and one doubled
    broken.append(rows[8])
    random.Random(1).shuffle(broken)
    found = spark.createDataFrame(broken, schema).withColumn("at", F.to_timestamp("day")).select("at", "t", "v", "day", "id")
    got = {r.ym: r.status for r in upkeep.compared(upkeep.manifest(good, "t", "at"), upkeep.manifest(found.repartition(3), "t", "at")).collect()}
    assert got == {"202401": "lost", "202402": "extra", "202403": "changed", "202404": "changed", "202405": "same"}
    gone = upkeep.compared(upkeep.manifest(good, "t", "at"), upkeep.manifest(good.filter("id % 5 > 0"), "t", "at")).collect()
    assert [(r.ym, r.found) for r in gone if r.status == "lost"] == [("202401", 0)]


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, None, "text", [], {}, True, 2.5])
    if rng.random() < 0.4:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    out = {rng.choice("abcde"): nested(rng, depth - 1) for _ in range(rng.randrange(4))}
    if rng.random() < 0.5:
        out |= {"id": rng.choice([rng.randrange(40), str(rng.randrange(40)), "", None, {"x": 1}]), "t": rng.choice([None, 1]), "d": ""}
        if rng.random() < 0.2:
            del out["t"]
    return out


def walk(x, found):
    if isinstance(x, list):
        for v in x:
            walk(v, found)
    elif isinstance(x, dict):
        name = x.get("id")
        if isinstance(name, (str, int)) and not isinstance(name, bool) and str(name) and "t" in x and "d" in x:
            found.add(str(name))
            return
        for v in x.values():
            walk(v, found)


def test_objects_at_any_depth(spark):
    rng, want, texts = random.Random(3), set(), []
    for _ in range(60):
        x = [nested(rng, rng.randint(1, 7))]
        walk(x, want)
        texts.append((json.dumps(x),))
    rows = spark.createDataFrame([*texts, (None,)], "j string").select(F.try_parse_json("j").alias("v"))
    got = items.collected_deep(rows, "v", "id", ["t", "d"]).collect()
    assert {r.id for r in got} == want and len(got) == len(want) > 10
    assert items.collected_deep(rows.limit(0), "v", "id", []).collect() == []


def plain_quantile(buckets, q):
    """(bound, cumulative count) in order, the last bound infinite."""
    if len(buckets) < 2 or buckets[-1][0] != float("inf") or buckets[-1][1] == 0:
        return None
    rank = q * buckets[-1][1]
    i = next(n for n, (_, c) in enumerate(buckets) if c >= rank)
    if i == len(buckets) - 1:
        return buckets[-2][0]
    low, under = buckets[i - 1] if i else (0.0, 0.0)
    return buckets[i][0] if not i and buckets[0][0] <= 0 else low + (buckets[i][0] - low) * (rank - under) / (buckets[i][1] - under)


@pytest.mark.parametrize("q", [0.05, 0.5, 0.95, 1.0])
def test_histogram_quantiles(spark, q):
    rng, cases = random.Random(5), {}
    inf = float("inf")
    for k in range(40):
        bounds = sorted(rng.sample([-1.0, 0.0, 0.1, 0.5, 1.0, 2.5, 10.0], rng.randint(0, 5))) + ([inf] if k % 9 else [5000.0])
        counts = sorted(rng.randrange(0, 50) for _ in bounds)
        cases[k] = list(zip(bounds, counts, strict=True))
    rows = spark.createDataFrame([(k, b, c) for k, bs in cases.items() for b, c in bs], "k int, le double, c long")
    got = {r.k: r.quantile for r in ops.histogram_quantile(rows, ["k"], "le", "c", q).collect()}
    for k, bs in cases.items():
        want = plain_quantile(bs, q)
        assert got[k] == (want if want is None else pytest.approx(want)), bs


def test_counters_begin_anew(spark):
    rng = random.Random(6)
    log = [(s, t, rng.randrange(0, 30)) for s in "ab" for t in range(60)]
    want = {}
    for s in "ab":
        values = [v for k, _, v in log if k == s]
        want[s] = sum(y if y < x else y - x for x, y in zip(values, values[1:], strict=False))
    rows = spark.createDataFrame(log, "s string, t int, v long")
    got = ops.increases(rows, ["s"], "t", "v", F.expr("t div 7")).groupBy("s").agg(F.sum("increase").alias("n")).collect()
    assert {r.s: r.n for r in got} == want


def test_needles(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("aAbBc é🙂#\n") for _ in range(n))
    texts = [(i, text(rng.choice([0, 1, 2, 5, 80, 400]))) for i in range(60)] + [(99, None)]
    needles = [text(rng.choice([1, 2, 3, 4, 6])) for _ in range(80)] + ["", None, "zzz", "A"]
    got = sorted((r.id, r.needle) for r in analytics.needle_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"), ["id"]).collect())
    low = {n.lower() for n in needles if n}
    assert got == sorted((i, n) for i, t in texts if t for n in low if n in t.lower())
    none = spark.createDataFrame([], "needle string")
    assert analytics.needle_hits(spark.createDataFrame(texts, "id int, text string"), none, ["id"]).collect() == []


def test_no_needles_match_nothing(spark):
    rows = spark.createDataFrame([("one #abc",), ("two",)], "text string")
    assert rows.filter(analytics.needle_search(rows, [], [])).count() == 0
    assert [r.text for r in rows.filter(analytics.needle_search(rows, [], ["ABC"])).collect()] == ["one #abc"]


def test_previews_of_some_platforms(spark):
    from datetime import datetime

    rows = spark.createDataFrame([("x", "1", 1, "a demo", "en", datetime(2026, 1, 2)), ("y", "2", 1, "demo b", "en", datetime(2026, 1, 2))], "platform string, post_id string, version int, text string, lang string, published_at timestamp")
    counts, sample = analytics.preview(rows, ["DEMO"], [], datetime(2026, 1, 1), platforms=("y",))
    assert [tuple(r) for r in counts.collect()] == [("y", 1)] and [r.post_id for r in sample.collect()] == ["2"]


def plain_shared(plans):
    """(plan, interval of its stream, its stream's least plan, rides), with lists and sets."""
    out, groups = {}, {}
    for p in plans:
        if p["terms"]:
            groups.setdefault((p["platform"], p["operation"], p["tenant_id"] if p["own_account"] else "*"), []).append(p)
    for members in groups.values():
        streams = []
        for every in sorted({m["interval_s"] for m in members}):
            rest, new = [], []
            for m in members:
                if m["interval_s"] == every:
                    host = next((s for s in sorted(streams) if set(m["terms"]) <= set(s[2])), None)
                    if host:
                        out[m["plan_id"]] = (host[0], host[1], True)
                    else:
                        rest.append(m)
            while rest:
                part, terms = [rest.pop(0)], set()
                while True:
                    terms = {t for m in part for t in m["terms"]}
                    more = [m for m in rest if terms & set(m["terms"])]
                    if not more:
                        break
                    part += more
                    rest = [m for m in rest if m not in more]
                if len(part) > 1:
                    least = min(m["plan_id"] for m in part)
                    new.append((every, least, tuple(sorted(terms))))
                    for m in part:
                        out[m["plan_id"]] = (every, least, False)
            streams += new
    return out


def test_shared_streams(spark):
    rng = random.Random(8)
    for terms in (6, 25, 200):
        plans = [
            {"plan_id": i, "tenant_id": rng.choice("AB"), "platform": rng.choice("xy"), "operation": "search", "interval_s": rng.choice([300, 900, 3600]), "own_account": rng.random() < 0.2, "terms": rng.choice([None, [], *([[f"w{rng.randrange(terms)}" for _ in range(rng.randint(1, 3))]] * 6)])}
            for i in range(70)
        ]
        df = spark.createDataFrame([tuple(p.values()) for p in plans], "plan_id long, tenant_id string, platform string, operation string, interval_s int, own_account boolean, terms array<string>")
        got = {r.plan_id: (r.stream_interval_s, int(r.stream.split("|")[-1]), r.rides) for r in sharing.shared(df).collect()}
        assert got == plain_shared(plans)
    assert sharing.shared(df.limit(0)).collect() == []


def test_long_chains_are_one_component(spark):
    n = 120
    order = list(range(n))
    random.Random(9).shuffle(order)
    edges = [(order[i], f"h{i}") for i in range(n)] + [(order[i + 1], f"h{i}") for i in range(n - 1)] + [(500, "z"), (501, "z"), (502, "y")]
    got = {r.n: r.component for r in sharing.components(spark.createDataFrame(edges, "n int, h string"), "n", "h").collect()}
    assert got == {**{i: 0 for i in range(n)}, 500: 500, 501: 500, 502: 502}


def plain_region(aliases, place, profile):
    def norm(s):
        return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())

    def exact(s):
        codes = {c for a, c in aliases if a == norm(s)}
        return codes.pop() if len(codes) == 1 else None

    def part(s):
        hits = [(a, c) for a, c in aliases if f" {a} " in f" {norm(s)} "]
        codes = {c for a, c in hits if len(a) == max(len(x) for x, _ in hits)}
        return codes.pop() if len(codes) == 1 else None

    for s, sure, fuzzy in ((place, 0.8, 0.8), (profile, 0.5, 0.3)):
        if s:
            if c := exact(s):
                return c, sure
            if c := part(s):
                return c, fuzzy
    return None


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_aliases_of_any_length(spark, most):
    rng = random.Random(10)
    word = lambda: rng.choice(["kota", "barat", "utara", "dua", "satu", "x"])
    names = {f"r{i}": [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(3)] for i in range(30)}
    aliases = sorted({(a, c) for c, own in names.items() for a in own})
    some = lambda: rng.choice([None, "", "?", *[" ".join([word() for _ in range(rng.randint(0, 4))] + [rng.choice(aliases)[0].upper().replace(" ", ", ")] + [word() for _ in range(rng.randint(0, 4))]) for _ in range(6)], rng.choice(aliases)[0]])
    people = [(i, some(), some()) for i in range(150)]
    regions = spark.createDataFrame([(c, own[0], own[1:]) for c, own in names.items()], "code string, name string, aliases array<string>")
    rows = spark.createDataFrame(people, "id int, place string, profile string")
    got = {r.id: (r.region, r.confidence) for r in enrich.infer_region(rows, regions, key=["id"], place="place", profile="profile", broadcast_bytes=most).collect()}
    want = {i: r for i, a, b in people if (r := plain_region(aliases, a, b))}
    assert got == want and len(want) > 50
    assert enrich.infer_region(rows, regions.limit(0), key=["id"], place="place", profile="profile").collect() == []
