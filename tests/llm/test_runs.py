import hashlib
import itertools
import random
import zlib

import pytest

from tidemark.llm import runs

SCHEMA = "doc_id long, text string, runs string, n_words int, w string"


def brute(s):
    """Stretches of words that equal those q later, for every q; of one stretch the smallest q."""
    n, best = len(s), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t + q < n:
            u = t
            while u + q < n and s[u] == s[u + q]:
                u += 1
            length = u - t + q
            if u > t and length >= max(runs.LEAST, 2 * q):
                best[t, length] = min(q, best.get((t, length), q))
            t = u + 1
    return sorted((a, q, n) for (a, n), q in best.items())


def kept(words, found):
    gone = {i for a, q, n in found for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(rng, k, n):
    s = [rng.randrange(k) for _ in range(n)]
    for _ in range(2):
        if n > 30:
            q, a = rng.randint(1, n // 3), rng.randrange(n // 2)
            for i in range(a + q, min(n, a + q * rng.randint(2, 5))):
                s[i] = s[i - q]
    return s


@pytest.mark.parametrize("least", [2, 12])
def test_every_short_text(monkeypatch, least):
    monkeypatch.setattr(runs, "LEAST", least)
    powers = runs.Powers()
    for n in range(13):
        for s in itertools.product(range(2), repeat=n):
            assert runs.runs_of(list(s), powers) == brute(s)


def test_longer_texts():
    rng, powers = random.Random(2), runs.Powers()
    for _ in range(800):
        s = planted(rng, rng.choice([1, 2, 3, 9, 500]), rng.randint(0, 150))
        assert runs.runs_of(s, powers) == brute(s)
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert runs.runs_of(b, powers) == brute(b)


def test_colliding_hashes_are_mended(monkeypatch):
    monkeypatch.setattr(runs, "PRIME", 7)
    rng = random.Random(3)
    for _ in range(200):
        s = planted(rng, 2, 100)
        assert runs.runs_of(s, runs.Powers()) == brute(s)


def test_long_periodic_texts_take_linear_time():
    n = 100_000
    assert runs.runs_of([0] * n, runs.Powers()) == [(0, 1, n)]
    assert (0, 3, 3 * n) in runs.runs_of([0, 1, 1] * n, runs.Powers())


def test_find(spark):
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "la la la x y " * 6 + "end", "x" * 100_000, "é ü \x0b" * 20, "one word " * 12]
    docs = spark.createDataFrame([(i, t, "z", 1, "q") for i, t in enumerate(texts)] + [(6, texts[6], "z", 1, "q"), (None, "b " * 30, "z", 1, "q")], SCHEMA)
    rows = runs.find(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = ((texts[r.id] if r.id is not None else "b " * 30) or "").encode().split()
        want = brute(words)
        assert [(x.start, x.period, x.length) for x in r.runs] == want and r.n_words == len(words)
        assert r.collapsed == b" ".join(kept(words, want)).decode()
    assert runs.find(docs.limit(0)).collect() == []


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    facts = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (len(found), *facts, sha("".join(f"{a},{n},{q}\n" for a, q, n in found).encode()), sha(b" ".join(kept(words, found))))


def test_op13_with_loops(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "ç", "d e"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(150)] + [(None, "a " * 40), (7, None), (8, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in runs.op13(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150))
