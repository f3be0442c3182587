"""Centroid clustering with a pivot table (LAESA).

Each vector's distances to a few fixed pivots are stored once, beside it. In each round the centroids' distances to the same
pivots are taken; by the triangle inequality, the difference of two distances to one pivot is a lower bound of the
distance between vector and centroid. A vector visits the centroids by rising bounds, and stops at the first one above the best distance found; those visited
get exact integer distances. Bounds are rounded down, so no nearest centroid is lost, and ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import discard, materialize, small_batches, table
from scenetables.llm.vectors import LONG_MAX, as_longs, exact, matrix, scaled, usable, whole_sum

SCALE, DIMENSION = 64, 64
CENTROIDS, ROUNDS, PIVOTS = 16, 3, 8
_SLACK = 1e-9  # what rounding may do to a distance, as its share, many times over
_CHUNK = 4096  # vectors whose bounds a task holds at a time
_SUM = pa.decimal128(38, 0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return (d * d).sum(axis=-1)


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors to pivots, in floating point."""
    v, p = exact(vectors.shape[1], vectors, pivots)
    return np.stack([np.sqrt(_squares(v, x).astype(float)) for x in p], axis=1)


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, squared distance and number of exact distances for each vector. table and rows: the distances to pivots of the vectors and
    of the centroids."""
    v, c = exact(vectors.shape[1], vectors, centroids)
    low = np.zeros((len(v), len(c)))
    for a, b in zip(table.T, rows.T):
        np.maximum(low, np.abs(a[:, None] - b) - _SLACK * (a[:, None] + b), out=low)
    low *= low * (1 - _SLACK)
    order = np.argsort(low, axis=1, kind="stable")
    best = order[:, 0].copy()
    d = _squares(v, c[best])
    tested = np.ones(len(v), dtype=int)
    left = np.arange(len(v))
    for step in range(1, len(c)):
        left = left[low[left, order[left, step]] <= d[left]]
        if not len(left):
            break
        x = order[left, step]
        new = _squares(v[left], c[x])
        tested[left] += 1
        better = (new < d[left]) | ((new == d[left]) & (x < best[left]))
        best[left[better]], d[left[better]] = x[better], new[better]
    return best, d, tested


def chosen_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of a few vectors, one at least, each as far as possible from those before it."""
    picked = [0]
    least = to_pivots(vectors, vectors[:1])[:, 0]
    while len(picked) < min(n, len(vectors)) and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, to_pivots(vectors, vectors[picked[-1:]])[:, 0])
    return vectors[picked]


def pivot_table(vectors: DataFrame, pivots: np.ndarray, dimension: int) -> DataFrame:
    """(id, v, far): vectors (id, v: array of longs of one length) with their distances to the pivots, stored in the scratch folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = to_pivots(matrix(b.column("v"), dimension), pivots)
            far = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), far], ["id", "v", "far"])

    kind = vectors.schema["id"].dataType.simpleString()
    return materialize(small_batches(vectors.select("id", "v")).mapInArrow(run, f"id {kind}, v array<long>, far array<double>"), "pivots")


def _blocks(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, centroids: np.ndarray) -> Iterator[tuple]:
    """Chunks of the pivot table with their vectors and what nearest() finds."""
    at = to_pivots(centroids, pivots)
    for b in batches:
        for k in range(0, b.num_rows, _CHUNK):
            part = b.slice(k, _CHUNK)
            v = matrix(part.column("v"), centroids.shape[1])
            yield part, v, *nearest(v, matrix(part.column("far"), len(pivots)), centroids, at)


def means(stored: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; those without vectors stay. A task sends a row of sums for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), dtype=int), np.zeros(centroids.shape, dtype=object)
        for _, v, best, _, _ in _blocks(batches, pivots, centroids):
            v = exact(len(v) ** 2, v)[0]
            for c in np.unique(best):
                mine = v[best == c]
                n[c] += len(mine)
                sums[c] += mine.sum(axis=0).astype(object)
        used = np.flatnonzero(n)
        rows = [[Decimal(int(x)) for x in sums[c]] for c in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(rows, pa.list_(_SUM))], ["c", "n", "s"])

    part = small_batches(stored).select("v", "far").mapInArrow(run, "c int, n long, s array<decimal(38,0)>")
    new = centroids.copy()
    for r in part.groupBy("c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(centroids.shape[1]))).alias("s")).collect():
        new[r["c"]] = [int(x) // r["n"] for x in r["s"]]
    return new


def assigned(stored: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, tested): tested is the number of exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, d, tested in _blocks(batches, pivots, centroids):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best, pa.int32()), as_longs(d), pa.array(tested, pa.int32())], ["id", "cluster", "distance", "tested"])

    return small_batches(stored).mapInArrow(run, f"id {stored.schema['id'].dataType.simpleString()}, cluster int, distance long, tested int")


def _first(vectors: DataFrame, n: int) -> np.ndarray:
    """The n vectors whose ids have the smallest hashes, in their order; equal ids by their components. A null id starts no centroid."""
    key: Column = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = vectors.filter("id IS NOT NULL").orderBy(key, "v").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per kept vector, repeated rows too.

    Vectors that are null, of another length or with null, NaN or infinite components are left out. Fewer vectors than k give fewer centroids;
    without any, or without an id among them, the result is empty. Only the id and the vector are read, so other columns may have any names. Components are held within 64
    bits; a distance or a sum that does not fit in a long is null. Tasks hold a chunk of vectors and the k centroids; k rows of sums go to the driver in a round."""
    kept = vectors.filter(usable(vector_col) & (F.size(vector_col) == dimension)).select(F.col(id_col).alias("id"), scaled(vector_col, scale).alias("v"))
    centroids = _first(kept, k)
    names = "cluster_inertia long, inertia long, centroid_sha256 string"
    spark = vectors.sparkSession
    if not len(centroids):
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, {names}")
    fixed = chosen_pivots(centroids, pivots)
    stored = pivot_table(kept, fixed, dimension)
    for _ in range(rounds):
        centroids = means(stored, fixed, centroids)
    found = materialize(assigned(stored, fixed, centroids), "clusters")
    discard(stored)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(whole_sum("distance").alias("s")).collect()}
    every = None if None in sums.values() or sum(sums.values()) > LONG_MAX else sum(sums.values())
    sha = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    few = spark.createDataFrame([(c, s, every, sha[c]) for c, s in sums.items()], f"cluster int, {names}")  # k rows at most
    return found.join(F.broadcast(few), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", *few.columns[1:])


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector of embeddings."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """SQL of the assignment to the centroids k, and of the centroids after it, without any bound."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT rid, min(d) AS d, arg_min(c, d * {CENTROIDS} + c) AS c
  FROM (SELECT rid, c, sum((x - y) * (x - y)) AS d FROM comps JOIN c{k} USING (pos) GROUP BY rid, c) GROUP BY rid),
m{k} AS (SELECT c, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM comps JOIN a{k} USING (rid) GROUP BY c, pos),
c{k + 1} AS MATERIALIZED (SELECT c, pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{k} LEFT JOIN m{k} USING (c, pos)),"""


#: The same by all distances of each round.
OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
comps AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range({DIMENSION})) AS pos FROM kept),
firsts AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range({DIMENSION})) AS pos FROM firsts),
{"".join(map(_round, range(ROUNDS + 1)))}
shas AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{ROUNDS} USING (rid) JOIN shas USING (c)
"""
