"""Operator 4: nearest neighbours by an inverted multi-index.

Both halves of the normalised vectors are quantised separately with CENTROIDS centroids each, fitted on a bounded sample.
A vector lies in the cell of its two nearest centroids, so there are CENTROIDS**2 cells, whose sizes are counted over all
vectors. For each query a heap yields pairs of centroids by increasing sum of the two distances; their cells are taken
until they hold SHARE of all vectors. The entries of those cells are reranked by exact cosine in double precision.

Equal vectors are one entry with their k + 1 smallest ids (no other id of them can be a result), so groups of copies
cost nothing. Entries lie in blocks of a first-half centroid and a hash, of some BLOCK entries, and so do queries; a
block of queries meets a block of entries as a matrix product, of which each query keeps its k best.

Defined results: null, zero and non-finite vectors, and those of another length than most have, take no part (they are
neither queries nor candidates); with fewer than k candidates all are returned; ties go to the smaller id; a repeated id
is one vector (rows of it with different vectors are separate candidates); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common

CENTROIDS = 32
#: Vectors that the centroids are fitted on: those with the smallest hash of their id.
SAMPLE = 8000
#: The share of all vectors in the cells that a query visits. Neighbours that are hardly nearer than other vectors need
#: a large one: on the test tables 0.5 finds 95 of 100 neighbours.
SHARE = 0.6
BLOCK = 4096
SALTS = 16


def fit_centroids(x: np.ndarray, k: int, steps: int = 10, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(axis=1)


def visit(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, wanted: float):
    """Pairs of centroids by increasing one[i] + two[j], until their cells hold `wanted` entries."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, got = [(one[a[0]] + two[b[0]], 0, 0)], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        got += sizes[a[i], b[j]]
        if j + 1 < len(b):
            heapq.heappush(heap, (one[a[i]] + two[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (one[a[i + 1]] + two[b[0]], i + 1, 0))


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """vector, ids: each distinct vector with its k smallest ids, sorted. Salted, so that a hot vector's rows spread."""
    salted = rows.withColumn("h", F.xxhash64("vector")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for key in (["h", "vector", "salt"], ["h", "vector"]):
        order = Window.partitionBy(*key).orderBy("id")
        salted = salted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    return salted.groupBy("h", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).drop("h")  # k ids at most


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)  # first, so that squares of tiny numbers don't vanish
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = finite & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & good & ((F.size(v) == dim) if dim else F.lit(True)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: id, vector (usable ones of one length); a query isn't its own result."""
    spark = vectors.sparkSession
    common.bound_batches(spark)
    common.tidy_shuffles(spark)
    tables = common.Tables(spark)
    distinct = tables.write(smallest_ids(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")), k + 1), "distinct")
    sample = distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(SAMPLE).select("vector").toArrow()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], empty)
    x = unit(matrix(sample["vector"]))
    half = (x.shape[1] + 1) // 2
    one, two = fit_centroids(x[:, :half], centroids), fit_centroids(x[:, half:], centroids, seed=1) if x.shape[1] > 1 else np.zeros((1, 0))

    def assign(batches):
        for batch in batches:
            v = unit(matrix(batch.column("vector")))
            cells = [pa.array(nearest(x, c), pa.int32()) for x, c in ((v[:, :half], one), (v[:, half:], two))]
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("vector"), *cells], ["ids", "vector", "c1", "c2"])

    entries = common.written(distinct.mapInArrow(assign, "ids array<bigint>, vector array<double>, c1 int, c2 int"), "entries")
    tables.drop(distinct)
    sizes = np.zeros((len(one), len(two)), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # at most CENTROIDS ** 2 rows
        sizes[r["c1"], r["c2"]] = r["count"]
    total, n_queries = int(sizes.sum()), queries.count()
    blocks = [max(1, math.ceil(n / BLOCK)) for n in sizes.sum(axis=1).tolist()]
    query_blocks = max(1, math.ceil(n_queries / BLOCK))

    def traverse(batches):
        for batch in batches:
            v = unit(matrix(batch.column("vector")))
            d1, d2, ids = distances(v[:, :half], one), distances(v[:, half:], two), batch.column("id").to_pylist()
            c1s, masks, rows = [], [], []
            for q in range(len(v)):
                cells: dict[int, list[int]] = {}
                for i, j in visit(d1[q], d2[q], sizes, min(total, max(share * total, k + 1))):
                    cells.setdefault(i, []).append(j)
                rows += [q] * len(cells)
                c1s += cells.keys()
                masks += cells.values()
            take = pa.array(rows, pa.int64())
            columns = [pa.array(ids, pa.int64()).take(take), batch.column("vector").take(take)]
            columns += [pa.array(c1s, pa.int32()), pa.array(masks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "c1", "cells"])

    n_blocks = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("c1") + 1)
    q_block = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked = queries.select("id", vector).mapInArrow(traverse, "id long, vector array<double>, c1 int, cells array<int>")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumn("q", q_block)
    held = entries.withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), n_blocks).cast("int"))
    held = held.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def rerank(queries_: pa.Table, entries_: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if queries_.num_rows and entries_.num_rows:
            own, e = queries_["id"].to_numpy(), unit(matrix(entries_["vector"]))
            cell, ids = entries_["c2"].to_numpy(), entries_["ids"].to_pylist()
            first = np.array([x[0] for x in ids])
            for a in range(0, len(own), 512):
                v = unit(matrix(queries_["vector"].slice(a, 512)))
                score = v @ e.T
                for q, cells in enumerate(queries_["cells"].slice(a, 512).to_pylist()):
                    inside = np.flatnonzero(np.isin(cell, cells))
                    s = score[q, inside]
                    if len(inside) > k + 1:  # the k best and all ties with the last of them; one more, the query's own
                        inside = inside[s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - 1e-12]
                    exact = (e[inside] * v[q]).sum(axis=1).clip(-1, 1)
                    best = np.lexsort((first[inside], -exact))
                    pairs = sorted((-exact[j], i) for j in best for i in ids[inside[j]] if i != own[a + q])[:k]
                    found[0] += [own[a + q]] * len(pairs)
                    found[1] += [i for _, i in pairs]
                    found[2] += [-s for s, _ in pairs]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(found, kinds, strict=True)], ["query_id", "vec_id", "score"])

    key = ["c1", "block", "q"]
    near = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    common_length = table.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = usable(table, "embedding", common_length["n"] if common_length else None).where("vec_id is not null")
    rows = good.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, rows.where(F.col("id") % 50 == 0))
