import numpy as np

from skein.operators import clustering, contexts, mixtures, summary_tree

F = mixtures.F


def table(spark, x, parts=3):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(parts)


def three_groups(n=300, d=8):
    rng = np.random.default_rng(1)
    centres = 4 * rng.normal(size=(3, d))
    return centres[np.arange(n) % 3] + 0.3 * rng.normal(size=(n, d))


def test_axes_equal_those_of_one_machine(spark):
    x = three_groups()
    got = {r.id: r.point for r in mixtures.reduced(table(spark, x)).collect()}
    want = clustering.reduced(x)
    assert np.allclose([got[k] for k in range(len(x))], want, atol=1e-8)


def test_likelihoods_equal_those_of_one_machine(spark):
    x = three_groups()
    points = mixtures.reduced(table(spark, x))
    fits, n = mixtures.fit(points, 5)
    order = [r.id for r in points.orderBy(F.xxhash64("id"), "id").collect()]
    local = clustering.reduced(x)[order]
    for k, m in fits.items():
        p, ll = clustering.mixture(local, k, 42)
        assert abs(ll - m.log_likelihood) < 1e-6 * abs(ll), k
    assert mixtures.best(fits, n) == 3
    found = {}
    for r in mixtures.members(points, fits[3]).collect():
        found.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == sorted([k for k in range(300) if k % 3 == g] for g in range(3))


def test_a_tree_over_all_vectors(spark):
    nodes, edges = mixtures.tree(table(spark, three_groups()), 6)
    per = {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}
    assert per[0] == 300 and per[1] == 3 and per[max(per)] <= 3
    assert edges.where("level = 1").select("child").distinct().count() == 300
    up = {r.parent for r in edges.where("level = 1").collect()}
    assert up == {r.node for r in nodes.where("level = 1").collect()}


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    nodes, edges = mixtures.tree(df)
    assert sorted((r.level, r.node) for r in nodes.collect()) == [(0, 5), (0, 6), (1, 0)] and edges.count() == 2
    nodes, edges = mixtures.tree(df.limit(0))
    assert nodes.count() == 0 and edges.count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0, 3.0, 4.0]) for k in range(20)], "id long, vector array<double>")
    assert mixtures.tree(same)[0].where("level = 0").count() == 20


def test_contexts_of_clusters_equal_the_column_version(spark):
    texts = ["a  b\tc", "", "x" * 60, "y" * 50 + " z", "tail of some words", "more"]
    for most in (60, 110, 130, 170, 210, 300, 400):
        rows = spark.createDataFrame([(1, [(0, t) for t in texts])], "id int, m array<struct<level:int,text:string>>")
        want = rows.select(contexts.cluster_context(F.col("m"), most).alias("t")).first().t
        parts = summary_tree.within_context(texts, 0, most)
        found = [b.split("\n", 1)[1] for b in want.split("\n\n")] if want else []
        assert parts == found, most
