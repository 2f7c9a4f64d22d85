"""Soft clusters of one large set of vectors: principal axes and Gaussian mixtures by sums that tasks make and Spark adds up.

All numbers of components are fitted side by side: one pass over the points gives, for every component of every mixture, the sums
of probabilities, of points and of their products, from which the driver makes the next means and covariances. The first
ones come from a bounded sample, the START points of smallest hash of their id. Levels are built one by one, each as tables.

Defined results: points with null, non-finite or missing components, or of another length, take no part; fewer than three points are
one cluster; equal points are equal members; an empty table has no clusters.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import storage
from skein.functions import vectors as vx
from skein.operators.clustering import RIDGE, _log_densities, _start, bic

START, STEPS, TOLERANCE, AXES = 2000, 100, 1e-3, 5


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _added(parts: DataFrame) -> dict:
    """Sums of arrays of one length (keys, values) by their key: as many rows as keys reach the driver."""
    each = parts.select("key", F.posexplode("values").alias("place", "x")).groupBy("key", "place").agg(F.sum("x").alias("x"))
    rows = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).select("key", F.col("v.x").alias("v"))
    return {r["key"]: np.array(r["v"]) for r in rows.collect()}


def _kept(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], ["key", "values"])


def reduced(points: DataFrame, most: int = AXES) -> DataFrame:
    """id, point of points (id, vector): normalised vectors on at most `most` principal axes, whose signs are fixed."""

    def moments(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                v = _unit(_rows(batch.column("vector")))
                total = total + np.concatenate(([len(v)], v.sum(axis=0), (v.T @ v).ravel()))
        if not np.isscalar(total):
            yield _kept({"all": total})

    sums = _added(points.select("vector").mapInArrow(moments, "key string, values array<double>")).get("all")
    if sums is None or sums[0] <= 3:
        return points.select("id", F.col("vector").cast("array<double>").alias("point"))
    n, d = sums[0], round((-1 + np.sqrt(4 * len(sums) - 3)) / 2)
    mean = sums[1 : d + 1] / n
    if d <= 3:
        return points.select("id", F.col("vector").cast("array<double>").alias("point"))
    values, axes = np.linalg.eigh(sums[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[: max(2, min(most, int(n) - 2, d))]].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                p = (_unit(_rows(batch.column("vector"))) - mean) @ axes.T
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p.tolist(), pa.list_(pa.float64()))], ["id", "point"])

    return points.select("id", "vector").mapInArrow(project, f"id {points.schema['id'].dataType.simpleString()}, point array<double>")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


class Mixture:
    """Shares, means and covariances of k components, and what the last pass said of them."""

    def __init__(self, mass: np.ndarray, sums: np.ndarray, products: np.ndarray):
        d = sums.shape[1]
        mass = mass + 1e-12
        self.share, self.means = mass / mass.sum(), sums / mass[:, None]
        outer = self.means[:, :, None] * self.means[:, None, :]
        self.covariances = products / mass[:, None, None] - outer + RIDGE * np.eye(d)
        self.log_likelihood, self.done = -np.inf, False

    @classmethod
    def of(cls, x: np.ndarray, probabilities: np.ndarray) -> Mixture:
        return cls(probabilities.sum(axis=0), probabilities.T @ x, np.einsum("nk,ni,nj->kij", probabilities, x, x))

    def logs(self, x: np.ndarray) -> np.ndarray:
        return _log_densities(x, self.means, self.covariances) + np.log(self.share)


def fit(points: DataFrame, most: int = 20, seed: int = 42, steps: int = STEPS) -> tuple[dict[int, Mixture], int]:
    """Mixtures of 1 to `most` components over points (id, point), and the number of points."""
    n = points.count()
    if not n:
        return {}, 0
    sample = points.orderBy(F.xxhash64("id"), "id").limit(START).select("point").toArrow()  # START rows at most
    x = _rows(sample["point"].combine_chunks())
    fits = {k: Mixture.of(x, _start(x, k, np.random.default_rng(seed))) for k in range(1, max(1, min(most, n // 2, len(x))) + 1)}
    for _ in range(steps):
        open_ = {k: m for k, m in fits.items() if not m.done}
        if not open_:
            break
        found = _pass(points, open_)
        for k, old in open_.items():
            total = sum(found[f"{k}:{j}"][-1] for j in range(k))
            parts = np.array([found[f"{k}:{j}"][:-1] for j in range(k)])
            d = old.means.shape[1]
            if abs(total / n - old.log_likelihood) < TOLERANCE:
                old.log_likelihood, old.done = total, True
                continue
            new = Mixture(parts[:, 0], parts[:, 1 : d + 1], parts[:, d + 1 :].reshape(k, d, d))
            new.log_likelihood = total / n
            fits[k] = new
    for m in fits.values():
        if not m.done:
            m.log_likelihood *= n
    return fits, n


def _pass(points: DataFrame, fits: dict[int, Mixture]) -> dict:
    """For each component of each mixture its sums; the log likelihood of the mixture stands behind those of its first component."""

    def run(batches):
        out: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("point"))
            for k, m in fits.items():
                logs = m.logs(x)
                total = np.logaddexp.reduce(logs, axis=1)
                p = np.exp(logs - total[:, None])
                products = np.einsum("nk,ni,nj->kij", p, x, x).reshape(k, -1)
                sums = np.column_stack((p.sum(axis=0), p.T @ x, products, np.where(np.arange(k) == 0, total.sum(), 0.0)))
                for j in range(k):
                    out[f"{k}:{j}"] = out.get(f"{k}:{j}", 0) + sums[j]
        if out:
            yield _kept(out)

    return _added(points.select("point").mapInArrow(run, "key string, values array<double>"))


def best(fits: dict[int, Mixture], n: int) -> int:
    """The number of components of the smallest criterion."""
    return min(fits, key=lambda k: (bic(fits[k].log_likelihood, k, n, fits[k].means.shape[1]), k))


def members(points: DataFrame, fitted: Mixture, threshold: float = 0.1) -> DataFrame:
    """id, cluster, probability: a point belongs to each cluster of at least the threshold, else to its likeliest."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            logs = fitted.logs(_rows(batch.column("point")))
            p = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
            inside = p >= threshold
            none = ~inside.any(axis=1)
            inside[np.flatnonzero(none), p[none].argmax(axis=1)] = True
            r, c = np.nonzero(inside)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(r)), pa.array(c, pa.int32()), pa.array(p[r, c])], ["id", "cluster", "probability"])

    return points.mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, cluster int, probability double")


def usable(vectors: DataFrame) -> DataFrame:
    """The whole vectors of the commonest length."""
    size = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return vectors.where(vx.valid(F.col("vector"), size["d"] if size else -1))


def tree(vectors: DataFrame, most: int = 20, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes (level, node, vector) and edges (level, parent, child, probability) of a hierarchy over all vectors (id, vector): the
    vectors are level 0 under their ids, which are numbers, and each cluster of a level is a node of the next one at its members' mean.
    It ends when a level has one node, doesn't shrink, or is the last one."""
    here = storage.written(usable(vectors).select("id", F.col("vector").cast("array<double>").alias("vector")), "level")
    nodes, edges, count = [here.select(F.lit(0).alias("level"), F.col("id").alias("node"), "vector")], [], here.count()
    for level in range(1, levels):
        if count <= 1:
            break
        points = storage.written(reduced(here), "points")
        if count > 2:
            fits, n = fit(points, most)
            found = members(points, fits[best(fits, n)])
        else:
            found = points.select("id", F.lit(0).alias("cluster"), F.lit(1.0).alias("probability"))
        found = storage.written(found, "members")
        edges.append(found.select(F.lit(level).alias("level"), F.col("cluster").cast("long").alias("parent"), F.col("id").alias("child"), "probability"))
        each = found.join(here, "id").select("cluster", F.posexplode("vector").alias("place", "x")).groupBy("cluster", "place").agg(F.avg("x").alias("x"))
        means = each.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
        here = storage.written(means.select(F.col("cluster").cast("long").alias("id"), F.col("v.x").alias("vector")), "level")
        before, count = count, here.count()
        nodes.append(here.select(F.lit(level).alias("level"), F.col("id").alias("node"), "vector"))
        if count >= before:
            break
    empty = vectors.sparkSession.createDataFrame([], "level int, parent long, child long, probability double")
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges, empty)
