"""Centroid clustering with Hamerly's bounds, in exact integers.

Every vector keeps its centroid, one upper bound on the distance to it and one lower bound on the distance to any
other. A round loosens both by how far centroids have moved. A vector whose upper bound stays below its lower bound,
or below half the gap between its centroid and the nearest other one, keeps its centroid without any distance. For
the rest the upper bound is made tight first; those still ambiguous are compared with all centroids, in integers.
Bounds are doubles rounded outwards, so that they decide only what is certain; ties always come to the full scan,
which takes the smaller number.

Vectors and bounds are a table in the shared folder, written anew each round without a shuffle; the round before is
then removed. Sums per centroid are added up in each task, then by Spark, so that a centroid that holds most vectors is
no hot key. Only the centroids (``k`` times ``dim`` numbers) pass through the driver.

Vectors that are null, have another number of components, or a component that is null or not finite are left out. A
component x becomes floor(256 * x), held to +-(2^27 - 1), beyond which squared distances would not fit a long. Repeated
rows are as many vectors; a repeated id starts as many centroids as it has rows among the first. A null id is kept and
never starts a centroid before an id that is not null. With fewer than ``k`` vectors each starts a centroid; with none
the result is empty. Only the two columns named are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, shared_path
from tidemark.sources.store import remove

#: Components: x becomes floor(SCALE * x), within +-MOST.
SCALE = 256
MOST = (1 << 27) - 1

#: Vectors that a task compares with all centroids at a time.
BLOCK = 4096

#: Relative slack of a bound: more than the few roundings that made it.
SLACK = 2.0**-50

STATE = "cluster int, upper double, lower double, full_scans int"


@dataclass(frozen=True)
class Clusters:
    """``vectors``: id, v, cluster, distance, full_scans. ``centres``: the final centroids. ``path``: the table behind ``vectors``."""

    vectors: DataFrame
    centres: np.ndarray
    path: str


def integers(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``id``, ``v``: the vectors with ``dim`` finite components, in integers."""
    x = vectors[vec_col]
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.where(x.isNotNull() & (F.size(x) == dim)).where(finite)
    held = F.transform(whole[vec_col], lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * scale))).cast("int"))
    return whole.select(whole[id_col].alias("id"), held.alias("v"))


def first_centres(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ``seed`` and id have the smallest hashes; k rows pass through the driver."""
    key: Column = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "id", "v").orderBy(F.asc_nulls_last("key"), "id", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.int64)
    return flat.reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def scan(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``x`` to all centres."""
    return (x**2).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres**2).sum(axis=1)[None, :]


def gaps(centres: np.ndarray) -> np.ndarray:
    """Half the distance from each centre to the nearest other one, rounded down."""
    if len(centres) < 2:
        return np.full(len(centres), np.inf)
    d = np.array([squared(centres, c) for c in centres]).astype(float)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(axis=1)) * (0.5 * (1 - SLACK))


def drifts(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centre has moved at most, and how far any other one has."""
    moved = np.sqrt(squared(before, after).astype(float)) * (1 + SLACK)
    others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])
    return moved, others


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Bring ``cluster``, ``upper`` and ``lower`` up to date in place; which vectors needed a full scan."""
    sure = np.maximum(lower, half[cluster])
    maybe = np.flatnonzero(~(upper < sure))
    upper[maybe] = np.sqrt(squared(x[maybe], centres[cluster[maybe]]).astype(float)) * (1 + SLACK)
    open_ = maybe[~(upper[maybe] < sure[maybe])]
    for at in range(0, len(open_), BLOCK):
        some = open_[at : at + BLOCK]
        d = scan(x[some], centres)
        rows, near = np.arange(len(some)), d.argmin(axis=1)  # of equal ones the first
        best = d[rows, near]
        cluster[some] = near
        upper[some] = np.sqrt(best.astype(float)) * (1 + SLACK)
        if len(centres) > 1:
            d[rows, near] = np.iinfo(np.int64).max
            lower[some] = np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK)
        else:
            lower[some] = np.inf
    return open_


def assigned(state: DataFrame, before: np.ndarray | None, centres: np.ndarray) -> DataFrame:
    """The state after one assignment. ``before``: the centres of the state's bounds; None where there are no bounds yet."""
    half = gaps(centres)
    moved, others = (None, None) if before is None else drifts(before, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            cluster, upper, lower, scans = (np.array(batch.column(name)) for name in ("cluster", "upper", "lower", "full_scans"))
            if moved is not None:
                upper = (upper + moved[cluster]) * (1 + SLACK)
                lower = np.maximum(lower - others[cluster], 0.0) * (1 - SLACK)
            scans[assign(x, cluster, upper, lower, centres, half)] += 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cluster), pa.array(upper), pa.array(lower), pa.array(scans)], names=batch.schema.names)

    return state.mapInArrow(run, state.schema)


def moved_centres(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The floor of each centre's mean vector; a centre without vectors stays."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = np.asarray(batch.column("cluster"))
            order = np.argsort(cluster, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0))
            sums[cluster[order][at]] += np.add.reduceat(matrix(batch.column("v"))[order], at, axis=0)
            n += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    whole = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centres.copy()
    for r in whole.collect():  # k times dim rows
        out[r.cluster, r.place] = r.total // r.n
    return out


def fit(vectors: DataFrame, k: int, rounds: int, *, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = SCALE, seed: str = "") -> Clusters:
    """``rounds`` times assign and move the centres, then assign once more."""
    spark = vectors.sparkSession
    kept = integers(vectors, id_col, vec_col, dim, scale)
    centres = first_centres(kept, k, seed)
    free = "0 AS cluster, double('inf') AS upper, 0D AS lower, 0 AS full_scans"
    state, before, path = kept.selectExpr("id", "v", *free.split(", ")), None, None
    for turn in range(rounds + 1 if len(centres) else 0):
        last, path = path, shared_path(spark, f"centroids-{turn}")
        new = assigned(state, before, centres)
        new.write.parquet(path)
        if last:
            remove(spark, last)
        state = spark.read.schema(new.schema).parquet(path)
        if turn < rounds:
            before, centres = centres, moved_centres(state, centres)
    return Clusters(measured(state, centres), centres, path or "")


def measured(state: DataFrame, centres: np.ndarray) -> DataFrame:
    """``state`` with the exact squared distance of each vector to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(matrix(batch.column("v")), centres[np.asarray(batch.column("cluster"))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "cluster")), pa.array(d), batch.column("full_scans")], names=["id", "v", "cluster", "distance", "full_scans"])

    return state.mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, v array<int>, cluster int, distance long, full_scans int")


K, ROUNDS, SEED = 40, 5, "2:"


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster, distance, the inertias and a digest of its centroid."""
    found = fit(documents(spark, sf_dir, "embeddings"), K, ROUNDS, seed=SEED)
    inertia = found.vectors.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # K rows at most
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centres]
    whole = sum(r.cluster_inertia for r in inertia)
    rows = [(r.cluster, r.cluster_inertia, whole, digest[r.cluster]) for r in inertia]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    both = found.vectors.join(F.broadcast(facts), "cluster")
    return both.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, seed: str = SEED, dim: int = 64) -> str:
    """The same without bounds: every distance in every round."""
    steps = [
        f"""long AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), vec_id) AS n, vec_id, unnest(range({dim})) AS place, unnest(embedding) AS x
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  v AS MATERIALIZED (SELECT n, vec_id, place, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM long),
  c0 AS MATERIALIZED (SELECT CAST(n - 1 AS INTEGER) AS cluster, place, x FROM v WHERE n <= {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (
  SELECT n, cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{i} c USING (place) GROUP BY n, cluster),
  a{i} AS MATERIALIZED (SELECT n, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY n)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.place, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM v JOIN a{i} USING (n) GROUP BY cluster, place) m
  USING (cluster, place))""")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, s.centroid_sha256
FROM a{rounds} a JOIN (SELECT DISTINCT n, vec_id FROM v) v USING (n)
JOIN (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) s USING (cluster)"""
