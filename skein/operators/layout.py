"""Few coordinates for many vectors by their neighbour graph: nearest neighbours, memberships on each vector's own scale, the fuzzy
union of both directions, and a layout by sampled gradient steps.

Each step moves all points at once: of a pair of neighbours that a hash of the step draws, with a chance that goes with its
membership, both ends come nearer, and each end is pushed from a few points of a bounded sample. Points are a table of
their own after every step.

Defined results: vectors that are not whole, or not of the commonest length, take no part; fewer than four vectors, or of at most three
components, stay as they are (normalised to principal axes otherwise); equal vectors may part; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import storage
from skein.operators import mixtures, postings

NEIGHBOURS, STEPS, RATE = 15, 30, 1.0
#: The curve 1 / (1 + A d^(2 B)) of membership by distance in the layout, for points that may come as near as 0.1.
A, B = 1.577, 0.895
#: Points that push others, per step, and how many of them push one end of a pair.
SAMPLE, PUSHES, MOST_STEP = 1000, 5, 4.0


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """id, other, distance (one less cosine), rank of the k nearest other vectors of vectors (id, vector)."""
    named = vectors.select(F.col("id").alias("chunk_id"), F.col("vector").alias("embedding"))
    near = postings.vector_many(named, named.withColumnRenamed("chunk_id", "question_id"), k + 1).where("question_id <> chunk_id")
    rows = near.select(F.col("question_id").alias("id"), F.col("chunk_id").alias("other"), F.greatest(1 - F.col("similarity"), F.lit(0.0)).alias("distance"), "rank")
    return rows.where(F.col("rank") <= k + 1)


def scales(distances: np.ndarray, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For rows of sorted distances (nan behind them): the smallest, and the scale by bisection at which memberships add up to the
    logarithm of their number."""
    known = ~np.isnan(distances)
    nearest = np.nanmin(np.where(known, distances, np.inf), axis=1)
    beyond = np.where(known, np.maximum(distances - nearest[:, None], 0), np.inf)
    target = np.log2(np.maximum(known.sum(axis=1), 2))
    low, high = np.zeros(len(distances)), np.full(len(distances), np.inf)
    scale = np.ones(len(distances))
    for _ in range(steps):
        many = np.exp(-beyond / scale[:, None]).sum(axis=1) > target
        high, low = np.where(many, scale, high), np.where(many, low, scale)
        scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
    floor = 1e-3 * np.nanmean(np.where(known, distances, np.nan), axis=1)
    return nearest, np.maximum(scale, np.maximum(floor, 1e-12))


def memberships(near: DataFrame) -> DataFrame:
    """a, b (a < b), weight: the fuzzy union of both directions, x + y - x y."""

    def weigh(batches):
        for batch in batches:
            size = batch.column("rows").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("rows").flatten()
            other, distance = flat.field("other"), flat.field("distance").to_numpy(zero_copy_only=False)
            table = np.full((len(size), int(size.max(initial=1))), np.nan)
            at = (np.repeat(np.arange(len(size)), size), np.arange(len(distance)) - np.repeat(np.cumsum(size) - size, size))
            table[at] = distance
            nearest, scale = scales(table)
            weight = np.exp(-np.maximum(table - nearest[:, None], 0) / scale[:, None])[at]
            ids = batch.column("id").take(pa.array(at[0]))
            yield pa.RecordBatch.from_arrays([ids, other, pa.array(weight)], ["id", "other", "weight"])

    kind = near.schema["id"].dataType.simpleString()
    listed = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("rows"))  # NEIGHBOURS each
    one_way = listed.mapInArrow(weigh, f"id {kind}, other {kind}, weight double")
    pairs = one_way.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    both = pairs.agg(F.sum("weight").alias("s"), F.min("weight").alias("x"), F.max("weight").alias("y"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", (F.col("s") - F.when(F.col("n") > 1, F.col("x") * F.col("y")).otherwise(0.0)).alias("weight"))


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -MOST_STEP, MOST_STEP)


def _pushes(sample: np.ndarray, seed: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "y"))
            d2 = ((x - y) ** 2).sum(axis=1, keepdims=True)
            pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0.0)
            move = _clipped(pull * (x - y))
            rng = np.random.default_rng(seed + int(batch.column("mark")[0].as_py()) % (1 << 31))
            for _ in range(PUSHES):
                z = sample[rng.integers(0, len(sample), batch.num_rows)]
                d2 = ((x - z) ** 2).sum(axis=1, keepdims=True)
                move += np.where(d2 > 0, _clipped(2 * B / ((0.001 + d2) * (1 + A * d2**B)) * (x - z)), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(move.tolist(), pa.list_(pa.float64()))], ["id", "move"])

    return run


def laid_out(vectors: DataFrame, most: int = 5, k: int = NEIGHBOURS, steps: int = STEPS, seed: int = 42) -> DataFrame:
    """id, point of all whole vectors (id, vector): at most `most` coordinates that keep neighbours together."""
    vectors = storage.written(mixtures.usable(vectors).select("id", F.col("vector").cast("array<double>").alias("vector")), "vectors")
    points = storage.written(mixtures.reduced(vectors, most), "points")
    size = points.select(F.max(F.size("point")).alias("d"), F.max(F.array_max(F.transform("point", lambda x: F.abs(x)))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if size["n"] <= 3 or vectors.select(F.max(F.size("vector"))).first()[0] <= 3:
        return points
    points = points.select("id", F.transform("point", lambda x: x * (10.0 / (size["m"] or 1.0))).alias("point"))
    pairs = memberships(neighbours(vectors, max(2, min(k, size["n"] - 1))))
    edges = storage.written(pairs.union(pairs.select("b", "a", "weight")).toDF("id", "other", "weight"), "neighbours")
    kind = vectors.schema["id"].dataType.simpleString()
    for step in range(steps):
        drawn = edges.where(_uniform(step, seed) < F.col("weight"))
        ends = drawn.join(points.withColumnRenamed("point", "x"), "id").join(points.toDF("other", "y"), "other")
        sample = np.array([r["point"] for r in points.orderBy(F.xxhash64(F.lit(step), "id")).limit(SAMPLE).collect()])
        moves = ends.select("id", "x", "y", F.xxhash64("id", "other").alias("mark")).mapInArrow(_pushes(sample, seed + step), f"id {kind}, move array<double>")
        each = [F.sum(F.get("move", F.lit(j))).alias(f"m{j}") for j in range(size["d"])]
        total = points.join(moves.groupBy("id").agg(*each), "id", "left")
        rate = RATE * (1 - step / steps)
        near = lambda j: F.greatest(F.lit(-MOST_STEP), F.least(F.lit(MOST_STEP), F.coalesce(f"m{j}", F.lit(0.0))))
        points = storage.written(total.select("id", F.array(*[F.get("point", F.lit(j)) + near(j) * rate for j in range(size["d"])]).alias("point")), "points")
    return points


def _uniform(step: int, seed: int) -> Column:
    return (F.xxhash64(F.lit(seed), F.lit(step), "id", "other").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")


def preserved(vectors: DataFrame, points: DataFrame, k: int = NEIGHBOURS) -> float:
    """The share of the vectors' k nearest neighbours, by cosine, that are among the k nearest points, by distance. Points lifted to
    one more coordinate, their squared length, are near by cosine of directions from afar as they are near by distance."""
    true = neighbours(vectors, k).where(F.col("rank") <= k + 1).select("id", "other")
    far = 1e4
    square = F.aggregate("point", F.lit(0.0), lambda s, x: s + x * x)
    lifted = points.select("id", F.concat(F.transform("point", lambda x: x / far), F.array(F.sqrt(F.greatest(1 - square / far**2, F.lit(0.0))))).alias("vector"))
    shown = neighbours_by_distance(lifted, far, k)
    both = true.join(shown.select("id", "other"), ["id", "other"]).count()
    return both / max(1, true.count())


def neighbours_by_distance(lifted: DataFrame, far: float, k: int) -> DataFrame:
    """Nearest on a large sphere: the chord between two lifted points is their distance, up to its square over `far`."""
    named = lifted.select(F.col("id").alias("chunk_id"), F.col("vector").alias("embedding"))
    near = postings.vector_many(named, named.withColumnRenamed("chunk_id", "question_id"), k + 1, digits=15).where("question_id <> chunk_id")
    return near.select(F.col("question_id").alias("id"), F.col("chunk_id").alias("other"), "rank")
