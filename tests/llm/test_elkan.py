import hashlib

import numpy as np
import pytest

from skein.llm import elkan


def brute(rows, k, rounds, seed=2):
    kept = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), [int(np.floor(256 * float(x))) for x in v], i) for i, v in rows)
    centres = [v for _, v, _ in kept[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    return sorted((i, near(v)[1], near(v)[0]) for _, v, i in kept), centres


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<double>")


@pytest.mark.parametrize("kind", ["normal", "grid", "copies"])
def test_equals_brute_force_with_ties(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 150, 4
    v = {"normal": rng.normal(size=(n, d)), "grid": rng.integers(-1, 2, (n, d)) / 256.0, "copies": np.repeat(rng.normal(size=(10, d)), 15, axis=0)}[kind]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    got, centres = elkan.cluster_vectors(table(spark, rows).repartition(3), 12, 5, d)
    want, expected = brute(rows, 12, 5)
    assert sorted(tuple(r) for r in got.collect()) == want and centres.tolist() == expected


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    rows = rng.integers(-300, 300, (12, 8))
    v = (rows[rng.integers(0, 12, 2000)] + rng.integers(-60, 60, (2000, 8))).astype(np.int64)
    centroids = elkan.Centroids(rows)
    cluster, upper, lower, computed = elkan.reassigned(v, np.zeros(2000, np.int32), np.full(2000, np.inf, np.float32), np.zeros((2000, 12), np.float32), centroids)
    for _ in range(6):
        exact = np.stack([elkan.squares(v, c) for c in centroids.rows], axis=1)
        assert (cluster == exact.argmin(axis=1)).all()
        root = np.sqrt(exact.astype(float))
        assert (upper >= root[np.arange(2000), cluster]).all() and (lower <= root).all()
        new = centroids.rows + rng.integers(-4, 5, rows.shape)
        centroids = elkan.Centroids(new, centroids.rows)
        cluster, upper, lower, computed = elkan.reassigned(v, cluster, upper, lower, centroids)
        assert computed < 0.5 * v.shape[0] * 12


def test_large_components_are_exact_or_refused(spark):
    big = elkan.largest(2) // 256
    rows = [(1, [float(big), 0.5]), (2, [-float(big), 0.25]), (3, [float(big) - 1, 0.125])]
    got, _ = elkan.cluster_vectors(table(spark, rows), 2, 2, 2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 2)[0]
    with pytest.raises(Exception, match="exceeds"):
        elkan.cluster_vectors(table(spark, [(1, [1e30, 0.0])]), 2, 2, 2)


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0])]
    got, centres = elkan.cluster_vectors(table(spark, rows), 40, 5, 2)
    assert sorted((r.id is None, r.id, r.distance) for r in got.collect()) == [(False, 7, 0), (False, 7, 0), (True, None, 0)] and len(centres) == 3
    got, centres = elkan.cluster_vectors(table(spark, rows[:3]), 40, 5, 2)
    assert got.count() == 0 and len(centres) == 0
