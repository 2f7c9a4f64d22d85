import numpy as np

from skein.operators import layout, mixtures

F = layout.F


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(2)


def groups(n=160, g=8, d=24):
    rng = np.random.default_rng(2)
    return 3 * rng.normal(size=(g, d))[np.arange(n) % g] + rng.normal(size=(n, d))


def test_scales_by_bisection():
    rng = np.random.default_rng(1)
    d = np.sort(rng.random((40, 15)), axis=1)
    d[3, 10:] = np.nan
    nearest, scale = layout.scales(d)
    beyond = np.maximum(d - nearest[:, None], 0)
    total = np.nansum(np.exp(-beyond / scale[:, None]), axis=1)
    assert np.allclose(nearest, np.nanmin(d, axis=1)) and np.allclose(total, np.log2((~np.isnan(d)).sum(axis=1)), atol=1e-6)


def test_union_of_both_directions(spark):
    near = [(1, 2, 0.1, 1), (1, 3, 0.4, 2), (2, 1, 0.1, 1), (2, 3, 0.2, 2), (3, 2, 0.2, 1), (3, 4, 0.3, 2), (4, 3, 0.3, 1), (4, 2, 0.9, 2)]
    df = spark.createDataFrame(near, "id long, other long, distance double, rank int")
    got = {(r.a, r.b): r.weight for r in layout.memberships(df).collect()}
    way = {}
    for i in range(1, 5):
        d = np.array([[r[2] for r in near if r[0] == i]])
        nearest, scale = layout.scales(d)
        for r in (r for r in near if r[0] == i):
            way[r[0], r[1]] = float(np.exp(-max(r[2] - nearest[0], 0) / scale[0]))
    want = {tuple(sorted(k)): 0.0 for k in way}
    for a, b in want:
        x, y = way.get((a, b), 0.0), way.get((b, a), 0.0)
        want[a, b] = x + y - x * y
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_neighbours_stay_together_better_than_on_axes(spark):
    df = table(spark, groups(240, 20))
    two = layout.preserved(df, layout.laid_out(df, 2, steps=15), 10)
    axes = layout.preserved(df, mixtures.reduced(df, 2), 10)
    assert two > axes + 0.15, (two, axes)


def test_preserved_is_exact(spark):
    x = groups(60, 4, 6)
    df = table(spark, x)
    points = mixtures.reduced(df, 2)
    p = {r.id: np.array(r.point) for r in points.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.round(u @ u.T, 6)
    hits = 0
    for i in range(60):
        true = sorted((j for j in range(60) if j != i), key=lambda j: (-cosine[i, j], j))[:5]
        shown = sorted((j for j in range(60) if j != i), key=lambda j: np.linalg.norm(p[i] - p[j]))[:5]
        hits += len({*true} & {*shown})
    assert abs(layout.preserved(df, points, 5) - hits / 300) < 0.01


def test_awkward_vectors(spark):
    assert layout.laid_out(spark.createDataFrame([], "id long, vector array<double>")).count() == 0
    rows = [(1, None), (2, [1.0, 2.0, 3.0, 4.0]), (3, [float("nan")] * 4), (4, [0.0, 1.0, 0.0, 1.0])]
    assert layout.laid_out(spark.createDataFrame(rows, "id long, vector array<double>")).count() == 2
    same = spark.createDataFrame([(k, [1.0, 2.0, 3.0, 4.0]) for k in range(12)], "id long, vector array<double>")
    assert layout.laid_out(same, steps=2).count() == 12
