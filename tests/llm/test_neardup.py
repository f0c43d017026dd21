import random

import numpy as np
import pyarrow as pa

from tidemark.llm import neardup

SCHEMA = "doc_id long, text string, source string, component_id long"


def brute(rows):
    """Components by comparing all pairs of sets."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for doc, text in rows:
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(lower)).split(" ") if w]
        sets.append((doc, {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())))
    parent = {doc: doc for doc, _ in sets if doc is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((doc, len(s), find(doc) if doc is not None else None) for doc, s in sets), key=str)


def texts(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    passage = random.choices(words, k=60)
    rows, n = [], 0
    for _ in range(60):
        base = random.choices(words, k=random.choice([3, 5, 8, 9, 20, 80, 300]))
        if random.random() < 0.4:
            base = base + passage
        for _ in range(random.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(random.choice([0, 1, 1, 2, len(base) // 30])):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((n, random.choice([" ", "\n", "  "]).join(copy)))
            n += 1
    hub = random.choices(words, k=120)
    for i in range(60):  # a chain: each differs a little from the one before
        hub[random.randrange(120)] = f"x{i}"
        rows.append((n, " ".join(hub)))
        n += 1
    return rows


def test_components_match_all_pairs(spark):
    rows = texts(3) + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE"), (5005, "one"), (None, "one")]
    rows += [(6000, "a b c d e f g"), (6000, "h i j k l m n"), (6001, "h i j k l m n"), (6002, "A B C D E F G"), (5003, "one")]
    rows += [(7000, "abc def " * 3000), (7001, "abc def " * 3001), (7002, "é é ü" * 50)]
    # an id with two texts, one of them also a lesser id's; its other text has a near copy
    one, two = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    rows += [(8005, one), (8005, two), (8003, two), (8006, one + " more")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in neardup.components_of(docs).collect()), key=str)
    assert got == brute(rows)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == sorted({c for d, _, c in brute(rows) if d == c} | {None}, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert neardup.components_of(docs).collect() == []
    assert neardup.one_of_each(docs).collect() == []


def test_similar_sets_share_enough_blocks():
    """The pigeonhole bound: at least ``slack`` blocks of the smaller set's band agree for every similar pair."""
    random.seed(1)
    for n in (4, 5, 9, 37, 150, 800):
        for _ in range(20):
            whole = random.sample(range(10**9), n)
            other = list(whole)
            for _ in range(n // 9 if n < 9 else n * 2 // 19):
                other[random.randrange(n)] = random.randrange(10**9, 2 * 10**9)
            a, b = set(whole), set(other)
            if 100 * len(a & b) < 80 * len(a | b):
                continue
            small, large = sorted((len(a), len(b)))
            bands = [neardup.bands(np.array([x]), role) for x, role in ((small, 0), (large, 0), (large, 1))]
            band, blocks, slack = bands[0]
            assert any(x[0] == band and x[1] == blocks for x in bands[1:])
            assert not blocks[0] or blocks[0] - len(a ^ b) >= slack[0] or not len(a ^ b)


def test_hamming_never_exceeds_difference():
    sets = pa.array(["a b c d e f g h i j", "a b c d e f g h i k", "z y x w v u t s r q"])
    found, owner = neardup.shingles(sets)
    assert np.bincount(owner).tolist() == [6, 6, 6]
