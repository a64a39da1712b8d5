"""Centroid clustering of vectors with Elkan's bounds, exact to the last integer.

Components become integers, so every distance that decides is an exact long and results don't depend on the order of sums. Each
vector keeps, from round to round, an upper bound of the distance to its centroid and a lower bound of that to each other one.
When centroids move, bounds move with them. A centroid j is left out for a vector whose upper bound is strictly below the lower
bound of j, or strictly below half the distance between its centroid and j; only the others are measured. Bounds are doubles
rounded away from the truth, and skips are strict, so a tie is always measured and goes to the smaller number.

At scale: the vectors and their bounds are one table in the shared folder; a round is a map over it, which writes the next one, and
a sum of at most k * dims rows a task. Nothing is shuffled but those sums, and the table before is removed, so a lost executor
repeats its tasks of one round. Only centroids (k * dims longs) pass through the driver.

Defined cases: vectors of another length, null, or with a null or non-finite component have no part and no row in the result; nor
have those with a component of RANGE or more after scaling, since distances to them need more than a long. Rows that share an id
are vectors of their own; a null id counts as an empty text in the draw of the start. With fewer vectors than centroids there are
as many centroids as vectors; equal vectors can start several centroids, of which the later stay empty and where they are. A sum of
distances beyond a long is null. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, written

DIMS, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Scaled components are below this, so that a squared distance over 64 of them is below 2 ** 62.
RANGE = 1 << 27
#: Relative slack of a bound: some units in the last place of every rounding that it went through.
SLACK = 2.0**-48
STATE = "vec_id {0}, vec binary, cluster int, upper double, lower binary"


def above(x):
    return x * (1 + SLACK)


def below(x):
    return np.maximum(x, 0.0) * (1 - SLACK)


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Binary values of one length as the rows of a matrix, without copying."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty((0, width), dtype)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(column), width)


def binaries(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _scaler(dims: int, scale: int, schema: pa.Schema):
    def scaled(batches):
        for batch in batches:
            vectors = batch.column(1)
            right = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == dims)
            flat = vectors.take(pa.array(right)).flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(len(right), dims)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(x * float(scale))
                kept = np.abs(whole).max(axis=1, initial=0.0) < RANGE  # false for nan
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[kept])), binaries(whole[kept].astype(np.int32))], schema=schema)

    return scaled


def distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared, exact."""
    away = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", away, away)


def gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each pair of centroids, from below."""
    return below(np.sqrt(np.array([distances(centroids, c) for c in centroids], float)) / 2)


def first_bounds(vectors: np.ndarray, centroids: np.ndarray):
    squares = np.stack([distances(vectors, c) for c in centroids], axis=1)
    cluster = squares.argmin(axis=1)
    roots = np.sqrt(squares.astype(float))
    return cluster.astype(np.int32), above(roots[np.arange(len(vectors)), cluster]), below(roots)


def next_bounds(vectors, cluster, upper, lower, centroids, half, moved):
    """Clusters and bounds after the centroids moved; `moved` bounds their ways from above. Also how many distances were measured."""
    cluster, upper, lower = cluster.copy(), above(upper + moved[cluster]), below(lower - moved)
    others = np.where(np.eye(len(centroids), dtype=bool), np.inf, half)
    rows = np.flatnonzero(upper >= others[cluster].min(axis=1, initial=np.inf))
    open_ = lambda rows: (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= others[cluster[rows]])
    rows = rows[open_(rows).any(axis=1)]
    best = np.empty(len(rows), np.int64)
    for c in range(len(centroids)):
        own = cluster[rows] == c
        best[own] = distances(vectors[rows[own]], centroids[c])
    lower[rows, cluster[rows]] = below(np.sqrt(best.astype(float)))
    upper[rows] = above(np.sqrt(best.astype(float)))
    to_measure, found, measured = open_(rows), cluster[rows], len(rows)
    for c in range(len(centroids)):
        at = np.flatnonzero(to_measure[:, c])
        square = distances(vectors[rows[at]], centroids[c])
        lower[rows[at], c] = below(np.sqrt(square.astype(float)))
        nearer = (square < best[at]) | ((square == best[at]) & (c < found[at]))
        best[at[nearer]], found[at[nearer]] = square[nearer], c
        measured += len(at)
    cluster[rows] = found
    upper[rows] = above(np.sqrt(best.astype(float)))
    return cluster, upper, lower, measured


def _assigner(dims: int, centroids: np.ndarray, before: np.ndarray | None, schema: pa.Schema):
    k = len(centroids)
    half = gaps(centroids)
    moved = None if before is None else above(np.sqrt(np.array([distances(b[None], c)[0] for b, c in zip(before, centroids, strict=True)], float)))

    def assigned(batches):
        for batch in batches:
            vectors = matrix(batch.column(1), np.int32, dims)
            if moved is None:
                cluster, upper, lower = first_bounds(vectors, centroids)
            else:
                cluster, upper, lower, _ = next_bounds(vectors, np.asarray(batch.column(2)), np.asarray(batch.column(3)), matrix(batch.column(4), np.float64, k), centroids, half, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(upper), binaries(lower)], schema=schema)

    return assigned


def _summer(dims: int, k: int):
    def summed(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            vectors, cluster = matrix(batch.column(0), np.int32, dims), np.asarray(batch.column(1))
            for c in range(k):
                own = vectors[cluster == c]
                n[c] += len(own)
                total[c] += own.sum(axis=0, dtype=np.int64)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(met, dims + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dims), len(met)), pa.int32()), pa.array(np.hstack([n[met, None], total[met]]).ravel())], ["cluster", "dim", "total"])

    return summed


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors, by components; empty ones stay."""
    k, dims = centroids.shape
    sums = state.select("vec", "cluster").mapInArrow(_summer(dims, k), "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"))
    found = {(r.cluster, r.dim): r.total for r in sums.collect()}  # k * (dims + 1) rows
    return np.array([[found[c, d] // found[c, -1] if (c, -1) in found else int(centroids[c, d]) for d in range(dims)] for c in range(k)], np.int64).reshape(k, dims)


def _measurer(dims: int, centroids: np.ndarray, schema: pa.Schema):
    def measured(batches):
        for batch in batches:
            vectors, cluster = matrix(batch.column(1), np.int32, dims), np.asarray(batch.column(2))
            out = np.zeros(len(cluster), np.int64)
            for c, centroid in enumerate(centroids):
                own = cluster == c
                out[own] = distances(vectors[own], centroid)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], schema=schema)

    return measured


def clusters(table: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; see above for those that aren't."""
    spark, kind = table.sparkSession, table.schema[id].dataType
    id_field = pa.field("vec_id", to_arrow_type(kind))
    scaled = pa.schema([id_field, ("vec", pa.binary())])
    kind = kind.simpleString()
    kept = written(table.select(F.col(f"`{id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vec")).mapInArrow(_scaler(dims, scale, scaled), f"vec_id {kind}, vec binary"), "vectors")
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(lot, "vec").limit(k).collect()
    centroids = np.array([np.frombuffer(r.vec, np.int32) for r in start], np.int64).reshape(len(start), dims)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    schema = pa.schema([*scaled, ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary())])
    state, before = kept, None
    for done in range(rounds + 1):
        last, state = state, written(state.mapInArrow(_assigner(dims, centroids, before, schema), STATE.format(kind)), "bounds")
        discard(last)
        if done < rounds:
            before, centroids = centroids, moved_centroids(state, centroids)
    out = pa.schema([id_field, ("cluster", pa.int32()), ("distance", pa.int64())])
    measured = written(state.mapInArrow(_measurer(dims, centroids, out), f"vec_id {kind}, cluster int, distance long"), "clusters")
    discard(state)
    inertia = {r.cluster: r.d for r in measured.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # k rows
    whole = sum(v for v in inertia.values()) if all(v is not None for v in inertia.values()) else None
    whole = whole if whole is not None and whole < 2**63 else None
    about = [(c, inertia[c], whole, hashlib.sha256(",".join(str(x) for x in centroids[c]).encode()).hexdigest()) for c in inertia]
    rows = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(dims: int = DIMS, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rows in SQL, with all distances measured; a step a round."""
    ties = "row_number() OVER (PARTITION BY v.row ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.cluster)"
    near = "a{r} AS MATERIALIZED (SELECT row, cluster, distance FROM (SELECT v.row, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance, " + ties + " AS place FROM v JOIN c{r} c ON v.dim = c.dim GROUP BY v.row, c.cluster) WHERE place = 1)"
    move = (
        "c{n} AS MATERIALIZED (SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT a.cluster, v.dim, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x "
        "FROM a{r} a JOIN v ON a.row = v.row GROUP BY a.cluster, v.dim) m ON c.cluster = m.cluster AND c.dim = m.dim)"
    )
    steps = []
    for r in range(rounds + 1):
        steps.append(near.format(r=r))
        if r < rounds:
            steps.append(move.format(r=r, n=r + 1))
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(floor({scale}.0::DOUBLE * CAST(x AS DOUBLE))) < {RANGE})) = {dims}),
v AS MATERIALIZED (SELECT row, dim, CAST(floor({scale}.0::DOUBLE * CAST(embedding[dim] AS DOUBLE)) AS BIGINT) AS x FROM e, range(1, {dims + 1}) d(dim)),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS cluster FROM e QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT CAST(s.cluster AS INTEGER) AS cluster, v.dim, v.x FROM s JOIN v ON s.row = v.row),
{("," + chr(10)).join(steps)},
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT e.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN e ON a.row = e.row JOIN h ON a.cluster = h.cluster
"""
