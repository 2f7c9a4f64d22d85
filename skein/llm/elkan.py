"""Operator 12: k-means over integer vectors with Elkan's bounds, exact and without regard to the order of rows.

Components become integers, floor(SCALE * x). The first centroids are the vectors of the k smallest sha256 of seed and id.
Each round is one pass over a table that holds, for each vector, its cluster, an upper bound of the distance to its
centroid and k lower bounds of the distances to all centroids. When centroids move, the bounds move by as much. A vector
is left alone if its upper bound is below half the distance from its centroid to the nearest other one; a centroid is left
out if the upper bound is below its lower bound, or below half the distance between both centroids. All bounds are rounded away
from the distances and pruning is strict, so a centroid that ties is always looked at; what is looked at is compared by
exact squared distances, ties going to the smaller number. Sums are of integers, and only k sums go through the driver.

Defined results: vectors that are null, of another length, or with null or non-finite components take no part; zero vectors do; a
null id is hashed as no digits; rows of equal id and vector are separate vectors, and equal hashes are ordered by the vector; with
fewer vectors than k there are as many centroids; an empty table gives no rows. Components so large that a squared distance
doesn't fit into 62 bits raise an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

SCALE, CENTROIDS, ROUNDS, SEED, DIMENSION = 256, 40, 5, 2, 64
#: Below this, dot products of vectors of DIMENSION components are exact in double precision.
SMALL = 1 << 22
#: Rounds a bound in double precision to the safe side.
MARGIN = 1e-12


def largest(dimension: int) -> int:
    """The largest component for which every squared distance fits into 62 bits."""
    return math.isqrt((1 << 60) // dimension)


def integers(v: Column, dimension: int, scale: int = SCALE) -> Column:
    """The vector as integers."""
    most = largest(dimension)
    scaled = lambda x: F.floor(x.cast("double") * scale)
    return F.transform(v, lambda x: F.when(F.abs(x.cast("double") * scale) <= most, scaled(x)).otherwise(F.raise_error(F.lit(f"a component times {scale} exceeds {most}")).cast("bigint")))


def whole(v: Column, dimension: int) -> Column:
    """Whether the vector has so many components, all finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors and a centroid, or of pairs of both."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < SMALL and v.shape[-1] <= DIMENSION and c.ndim == 1:
        x = v.astype(np.float64)
        return ((x * x).sum(axis=1) - 2 * (x @ c.astype(np.float64)) + float((c * c).sum())).astype(np.int64)
    d = v - c
    return (d * d).sum(axis=-1)


def above(squared: np.ndarray) -> np.ndarray:
    """Single-precision numbers not below the root."""
    return np.nextafter((np.sqrt(squared.astype(np.float64)) * (1 + MARGIN)).astype(np.float32), np.float32(np.inf))


def below(squared: np.ndarray) -> np.ndarray:
    """Single-precision numbers not above the root."""
    return np.maximum(np.nextafter((np.sqrt(squared.astype(np.float64)) * (1 - MARGIN)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Centroids:
    """Centroids, half the distances between them, and how far each has moved since the round before."""

    def __init__(self, rows: np.ndarray, before: np.ndarray | None = None):
        self.rows, n = rows, len(rows)
        self.half = np.empty((n, n))
        for c in range(n):
            self.half[c] = np.sqrt(squares(rows, rows[c]).astype(np.float64)) * (0.5 * (1 - MARGIN))
        np.fill_diagonal(self.half, np.inf)
        self.near = self.half.min(axis=1, initial=np.inf)
        moved = np.zeros(n, np.int64) if before is None else squares(rows - before, np.zeros(rows.shape[1], np.int64))
        self.moved = np.sqrt(moved.astype(np.float64)) * (1 + MARGIN)


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple:
    """cluster, upper and lower after the centroids have moved; `computed` counts exact distances."""
    half, k = centroids.half, len(centroids.rows)
    up = np.nextafter((upper.astype(np.float64) + centroids.moved[cluster]).astype(np.float32), np.float32(np.inf))
    low = np.nextafter((lower.astype(np.float64) - centroids.moved).astype(np.float32), np.float32(-np.inf))
    cluster, low = cluster.copy(), np.maximum(low, np.float32(0))
    rows = np.flatnonzero(~(up < centroids.near[cluster]))
    possible = ~(up[rows, None] < low[rows]) & ~(up[rows, None] < half[cluster[rows]])
    possible[np.arange(len(rows)), cluster[rows]] = False
    rows = rows[possible.any(axis=1)]
    own, best = cluster[rows], np.empty(len(rows), np.int64)
    for c in np.unique(own):
        mine = own == c
        best[mine] = squares(v[rows[mine]], centroids.rows[c])
    chosen, u, computed = own.copy(), above(best), len(rows)
    low[rows, own] = below(best)
    for c in range(k):
        at = np.flatnonzero((own != c) & ~(u < low[rows, c]) & ~(u < half[chosen, c]))
        if not len(at):
            continue
        d = squares(v[rows[at]], centroids.rows[c])
        computed += len(at)
        low[rows[at], c] = below(d)
        better = (d < best[at]) | ((d == best[at]) & (c < chosen[at]))
        at = at[better]
        best[at], chosen[at] = d[better], c
        u[at] = above(best[at])
    cluster[rows], up[rows] = chosen, u
    return cluster, up, low, computed


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def _round(state: DataFrame, centroids: Centroids, last: bool) -> DataFrame:
    """One assignment of all vectors; the last one gives distances instead of bounds."""

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), np.int64)
            n, k = len(v), len(centroids.rows)
            if "cluster" in batch.schema.names:
                cluster, upper = (batch.column(c).to_numpy() for c in ("cluster", "upper"))
                lower = _matrix(batch.column("lower"), np.float32)
            else:
                cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
            cluster, upper, lower, _ = reassigned(v, cluster, upper, lower, centroids)
            names, columns = ["id", "cluster"], [batch.column("id"), pa.array(cluster, pa.int32())]
            if last:
                names, columns = [*names, "distance"], [*columns, pa.array(squares(v, centroids.rows[cluster]))]
            else:
                names, columns = [*names, "v", "upper", "lower"], [*columns, batch.column("v"), pa.array(upper), _lists(lower)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rest = "distance long" if last else "v array<bigint>, upper float, lower array<float>"
    return state.mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, cluster int, {rest}")


def _partial_sums(batches):
    """Sums of the vectors of each cluster in a batch, and their number behind them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v, cluster = _matrix(batch.column("v"), np.int64), batch.column("cluster").to_numpy()
        order = np.argsort(cluster, kind="stable")
        first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
        sums = np.add.reduceat(np.column_stack((v, np.ones(len(v), np.int64)))[order], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(cluster[order][first], pa.int32()), _lists(sums)], ["cluster", "sums"])


def moved(state: DataFrame, rows: np.ndarray) -> np.ndarray:
    """The floors of the mean vectors; a centroid without vectors stays. At most k times the dimension sums reach the driver."""
    parts = state.select("cluster", "v").mapInArrow(_partial_sums, "cluster int, sums array<bigint>")
    each = parts.select("cluster", F.posexplode("sums").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x"))
    sums = np.zeros((len(rows), rows.shape[1] + 1), object)
    for r in each.collect():
        sums[r["cluster"], r["place"]] = r["x"]
    out = rows.copy()
    for c in range(len(rows)):
        if sums[c, -1]:
            out[c] = [int(x) // int(sums[c, -1]) for x in sums[c, :-1]]
    return out


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of all whole vectors in `vectors` (id, vector), and the centroids, which are at most k."""
    spark, tables = vectors.sparkSession, common.Tables(vectors.sparkSession)
    common.bound_batches(spark)
    common.tidy_shuffles(spark)
    kept = vectors.where(whole(F.col("vector"), dimension)).select("id", integers(F.col("vector"), dimension, scale).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r["v"] for r in kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"), np.zeros((0, dimension), np.int64)
    rows = np.array(first, np.int64)
    state, centroids = kept, Centroids(rows)
    for _ in range(rounds):
        new = tables.write(_round(state, centroids, False), "bounds")
        tables.drop(state)
        state, rows = new, moved(new, rows)
        centroids = Centroids(rows, centroids.rows)
    out = common.written(_round(state, centroids, True), "clusters")
    tables.drop(state)
    return out, rows


def op12(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found, rows = cluster_vectors(table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")))
    digests = [(c, hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()) for c, r in enumerate(rows.tolist())]
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    named = [(c, sums.get(c, 0), sum(sums.values()), d) for c, d in digests]
    per = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(per), "cluster")  # a row for each of the k centroids


def _oracle() -> str:
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    finite = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, "
        f"list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMENSION} AND {finite})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v FROM kept ORDER BY h, v LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        near = f"SELECT x.r, x.vec_id, x.v, c.c, {square} AS d FROM kept x, c{i} c"
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM ({near}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        sums = f"SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i"
        means = f"SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM ({sums}) GROUP BY c"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN ({means}) m USING (c))")
    last = f"a{ROUNDS}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, "
        f"sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(o.v, lambda x: x::VARCHAR), ',')) AS centroid_sha256 "
        f"FROM {last} a JOIN c{ROUNDS} o USING (c)"
    )


ORACLE = _oracle()
