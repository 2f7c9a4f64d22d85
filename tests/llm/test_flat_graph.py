import numpy as np
import pytest

from skein.llm import flat_graph as fg
from skein.llm.multi_index import unit

SCHEMA = "id long, vector array<double>, label string"


def brute(rows, threshold=0.98):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {k: unit(np.array([rows[k][1]], float))[0] for k in good}
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= threshold:
                links[i].add(j)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        head = min(ids) if ids else None
        out.append((rows[k][0], len(links[k]), head, rows[k][0] == head))
    return sorted(out, key=str)


def groups(rng, n, d, sizes):
    x = rng.normal(size=(n, d))
    at = 0
    for s in sizes:
        x[at : at + s] = rng.normal(size=d) + 0.1 * rng.normal(size=(s, d))
        at += s
    return x


def got(df, **args):
    return sorted((tuple(r) for r in fg.near_duplicates(df, **args).collect()), key=str)


@pytest.mark.parametrize("capacity", [4096, 120])
def test_equals_brute_force(spark, capacity):
    rng = np.random.default_rng(5)
    x = np.concatenate((groups(rng, 500, 16, [90, 20, 2, 2, 2, 3]), groups(rng, 200, 16, [5, 5])))
    rows = [(int(i), v.tolist(), "a" if k < 500 else "b") for k, (i, v) in enumerate(zip(rng.permutation(700), x, strict=True))]
    rows += [(1000 + k, rows[0][1], "a") for k in range(40)] + [(2000 + k, rows[600][1], "b") for k in range(3)]
    assert got(spark.createDataFrame(rows, SCHEMA), capacity=capacity) == brute(rows)


def test_chains_across_shards_lose_few_links(spark):
    angle = np.arange(300) * 0.1
    spiral = np.stack((np.cos(angle), np.sin(angle), angle * 0.05), axis=1)
    rows = [(k, v.tolist(), "x") for k, v in enumerate(spiral)]
    found, true = got(spark.createDataFrame(rows, SCHEMA), capacity=60), brute(rows)
    assert [r[2] for r in found] == [r[2] for r in true] and all(f[1] <= t[1] for f, t in zip(found, true, strict=True))
    assert sum(r[1] for r in found) >= fg.WANTED * sum(r[1] for r in true) - fg.AUDITED


def test_degrees_and_pruning():
    rng = np.random.default_rng(6)
    x = unit(groups(rng, 400, 12, [80, 30]))
    wide = fg.range_of(0.98)
    edges = fg.built(x, wide, 32)
    assert edges.shape == (400, fg.NEAR + fg.DEGREE) and not (edges == np.arange(400)[:, None]).any()
    picked = fg.pruned(x, np.arange(100), np.tile(np.arange(400), (100, 1)), wide)
    for p in range(100):
        d = np.linalg.norm(x - x[p], axis=1)
        for part, inside in ((picked[p][: fg.NEAR], True), (picked[p][fg.NEAR :], False)):
            kept = part[part >= 0]
            assert len(set(kept)) == len(kept) and all((x[v] @ x[p] >= wide) == inside for v in kept)
            for i, v in enumerate(kept):
                assert all(fg.ALPHA * np.linalg.norm(x[v] - x[w]) > d[v] for w in kept[:i])
        assert np.argsort(d)[1] in picked[p]


def test_audit_notices_lost_links(spark):
    rng = np.random.default_rng(7)
    x = groups(rng, 60, 8, [30])
    nodes = spark.createDataFrame([(k, "a", v.tolist()) for k, v in enumerate(x)], "node long, label string, vector array<double>")
    true = [(k, sum(1 for j in range(60) if j != k and unit(x)[k] @ unit(x)[j] >= 0.98)) for k in range(60)]
    right = spark.createDataFrame(true, "node long, near long")
    assert fg.audited_recall(nodes, right, 0.98) == 1.0
    half = spark.createDataFrame([(k, c // 2) for k, c in true], "node long, near long")
    assert fg.audited_recall(nodes, half, 0.98) < 0.6


def test_awkward_vectors(spark):
    bad = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(k, v, "a") for k, v in enumerate(bad)] + [(k + 6, v, "a") for k, v in enumerate(bad)]
    rows += [(20, [1.0, 1.0], None), (21, [1.0, 1.0], None), (22, [1.0, 1.0], "a"), (22, [1.0, 1.0], "a"), (23, [1.0, 1.0, 0.0], "a"), (None, [2.0, 2.0], "a"), (None, [0.0, 1.0], "b")]
    rows += [(30, [1e-200, 1e-200], "c"), (31, [1e200, 1e200], "c")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_large_group_of_near_copies_keeps_all_links(spark):
    """A group beyond a shard's capacity: parts of it by centroids would lose the links between them."""
    rng = np.random.default_rng(8)
    x = groups(rng, 900, 32, [400])
    x[:400] = x[0] + 0.05 * rng.normal(size=(400, 32))
    rows = [(k, v.tolist(), "a") for k, v in enumerate(x)]
    assert got(spark.createDataFrame(rows, SCHEMA), capacity=100, attempts=((1, 32),)) == brute(rows)
