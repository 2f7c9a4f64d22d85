import math

import numpy as np

from skein.llm import multi_index


def brute(rows, k):
    unit = {i: multi_index.unit(np.array([v], float))[0] for i, v in rows}
    out = []
    for q in unit:
        best = sorted((-float(np.clip((unit[q] * unit[i]).sum(), -1, 1)), i) for i in unit if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def test_exact_when_all_cells_are_visited(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)] + [(100 + k, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    rows = [(r.id, r.vector) for r in df.collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.search(df, df, share=1.0, centroids=4).collect())
    for g, w in zip(got, sorted(brute(rows, 5)), strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], abs_tol=1e-12)


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 50)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16)) * 2
    rows = [(k, (centres[k % 5] + rng.normal(size=16)).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.query_id, r.vec_id) for r in multi_index.search(df, df.where("id % 3 = 0"), centroids=8).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 5) if q % 3 == 0}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_awkward_vectors(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (6, [2.0, 2.0]), (7, [1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    good = multi_index.usable(df, "vector", 2)
    assert sorted(r.id for r in good.collect()) == [5, 6]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in multi_index.search(good, good).collect()) == [(5, 1, 6), (6, 1, 5)]
    assert multi_index.search(good.limit(0), good.limit(0)).count() == 0


def test_few_distinct_vectors_are_all_found(spark):
    for n in (4, 7):
        df = spark.createDataFrame([(k, [float(k), 9.0 - k, float(k * k)]) for k in range(1, n + 1)], "id long, vector array<double>")
        assert multi_index.search(df, df).count() == n * min(5, n - 1)


def test_pairs_come_by_increasing_sum():
    rng = np.random.default_rng(2)
    one, two = rng.random(7), rng.random(5)
    pairs = list(multi_index.visit(one, two, np.ones((7, 5), int), 35))
    sums = [one[i] + two[j] for i, j in pairs]
    assert len(set(pairs)) == 35 and sums == sorted(sums)


def test_hot_vector_ties_and_extra_columns(spark):
    """A vector that a third of all rows have, in all salts; ties at rank 5 go to the smallest ids; columns of the operator's names."""
    hot = [(k, [1.0, 2.0, 3.0]) for k in range(0, 300, 3)]
    ring = [(k, [float(np.cos(k)), float(np.sin(k)), 0.0]) for k in range(1, 300, 3)]
    tied = [(k, [-1.0, -2.0, 3.0 if k % 2 else 3.5]) for k in range(2, 300, 3)]
    rows = [(i, v, "x", 1, "y") for i, v in hot + ring + tied]
    df = spark.createDataFrame(rows, "id long, vector array<double>, h string, salt int, ids string")
    asked = df.where("id in (0, 1, 2, 3, 5, 150)")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in multi_index.search(df, asked, share=1.0, centroids=3).collect())
    want = [w[:3] for w in brute([(i, v) for i, v, *_ in rows], 5) if w[0] in (0, 1, 2, 3, 5, 150)]
    assert got == sorted(want)
