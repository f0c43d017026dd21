import hashlib
import random

import numpy as np

from tidemark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, v string, cluster int, id string"


def plain(rows, k, rounds, seed, dim):
    """Every distance in every round, in Python's integers."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
                if own:
                    centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((str(i), v, c, d) for (i, v), (d, c) in zip(kept, found, strict=True)), key=str), centres


def clustered(spark, rows, k, rounds, dim=4):
    data = spark.createDataFrame([(i, v, "x", 9, "y") for i, v in rows], SCHEMA)
    found = centroids.fit(data, k, rounds, seed="s", dim=dim)
    got = found.vectors.collect()
    return sorted(((str(r.id), list(r.v), r.cluster, r.distance) for r in got), key=str), found.centres.tolist(), got


def test_same_as_all_distances(spark):
    random.seed(3)
    blobs = [[random.uniform(-2, 2) for _ in range(4)] for _ in range(6)]
    rows = [(i, [random.gauss(m, 0.3) for m in random.choice(blobs)]) for i in range(400)]
    for k, rounds in [(1, 2), (6, 5), (40, 3)]:
        got, centres, raw = clustered(spark, rows, k, rounds)
        want, want_centres = plain([(i, np.float32(v).tolist()) for i, v in rows], k, rounds, "s", 4)
        assert got == want and centres == want_centres
    few = clustered(spark, rows, 6, 5)[2]
    assert min(r.full_scans for r in few) < 6  # bounds spare some vectors


def test_ties_repeats_and_rows_left_out(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 1.0, 1.0]), (6, [nan, 0.0, 0.0, 0.0]), (7, [0.0, -inf, 0.0, 0.0])]
    grid = [(10 + i, [float(i % 2), float(i // 2 % 2), 0.0, -0.0]) for i in range(16)] * 3 + [(None, [0.5] * 4), (None, [0.25] * 4)]
    got, centres, _ = clustered(spark, odd + grid, 5, 4)
    want, want_centres = plain(odd + grid, 5, 4, "s", 4)
    assert got == want and centres == want_centres and len(got) == 50


def test_fewer_vectors_than_centres_and_none(spark):
    got, centres, _ = clustered(spark, [(1, [1.0] * 4), (2, [2.0] * 4)], 5, 2)
    assert [g[2:] for g in got] in ([(0, 0), (1, 0)], [(1, 0), (0, 0)]) and len(centres) == 2
    assert clustered(spark, [(1, None)], 5, 2)[0] == []


def test_large_components_are_held(spark):
    got, _, _ = clustered(spark, [(1, [3e38, -3e38, 0.0, 1.0])], 1, 1)
    assert got[0][1] == [centroids.MOST, -centroids.MOST, 0, 256] and got[0][3] == 0


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 8))
    centres = x[:20].copy()
    cluster, upper, lower = np.zeros(500, np.int32), np.full(500, np.inf), np.zeros(500)
    centroids.assign(x, cluster, upper, lower, centres, centroids.gaps(centres))
    for _ in range(4):
        after = centres + rng.integers(-9, 9, centres.shape)
        moved, others = centroids.drifts(centres, after)
        upper, lower, centres = upper + moved[cluster], np.maximum(lower - others[cluster], 0), after
        d = np.sqrt(centroids.scan(x, centres).astype(float))
        assert (d[np.arange(500), cluster] <= upper + 1e-9).all()
        d[np.arange(500), cluster] = np.inf
        assert (d.min(axis=1) >= lower - 1e-9).all()
        centroids.assign(x, cluster, upper, lower, centres, centroids.gaps(centres))
        assert (cluster == centroids.scan(x, centres).argmin(axis=1)).all()
