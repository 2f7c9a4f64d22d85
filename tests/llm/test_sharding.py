import numpy as np
import pytest
import xxhash

from skein.llm import sharding
from tests.llm.docs import COLUMNS, docs


def check(rows, n, shards):
    sizes = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert len(rows) == n and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_exact_sizes_with_awkward_rows(spark):
    df = docs(spark, [None, "", "x", "x", "x", "long " * 5000, "y"]).union(docs(spark, ["x"] * 3))
    out = sharding.hypergeometric_shards(df, 4)
    check(out.collect(), 10, 4)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert sharding.hypergeometric_shards(spark.createDataFrame([], COLUMNS), 4).count() == 0


def test_parts_of_large_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 20)
    check(sharding.hypergeometric_shards(spark.range(1000).withColumnRenamed("id", "doc_id"), 7).collect(), 1000, 7)


def test_matrix_sums_and_mean():
    total = np.zeros((5, 3))
    for seed in range(300):
        m = sharding.communication_matrix([10, 0, 30, 5, 15], [20, 20, 20], seed)
        assert m.sum(axis=1).tolist() == [10, 0, 30, 5, 15] and m.sum(axis=0).tolist() == [20, 20, 20]
        total += m
    assert np.abs(total / 300 - np.outer([10, 0, 30, 5, 15], [1, 1, 1]) / 3).max() < 0.6


def test_large_hypergeometric_matches_the_mean_and_spread():
    rng = np.random.default_rng(1)
    x = np.array([sharding.draw_hypergeometric(rng, 2 * 10**9, 10**10, 12_000) for _ in range(3000)])
    assert abs(x.mean() - 2000) < 5 and abs(x.std() - np.sqrt(12_000 * (1 / 6) * (5 / 6))) < 2


def test_shuffles_are_uniform(spark):
    """Over many seeds, each row comes to each shard and slot about equally often, and neighbours are no likelier to stay together."""
    df, n, shards, runs = spark.range(12).withColumnRenamed("id", "doc_id").coalesce(1), 12, 3, 40
    seen, together = np.zeros((n, shards * 4)), 0
    for seed in range(runs):
        rows = sharding.hypergeometric_shards(df, shards, seed=seed * 11).collect()
        where = {r.doc_id: r.shard for r in rows}
        together += sum(where[k] == where[k + 1] for k in range(n - 1))
        for r in rows:
            seen[r.doc_id, r.shard * 4 + r.slot] += 1
    expected = runs / (shards * 4)
    chi = ((seen - expected) ** 2 / expected).sum()
    assert chi < 121 + 5 * np.sqrt(2 * 121)  # 11 * 11 degrees of freedom
    assert abs(together / runs / (n - 1) - 3 / 11) < 0.05


def test_null_ids(spark):
    df = docs(spark, ["a", "b"]).union(spark.createDataFrame([(None, None, None, None, None, None, None)] * 5, COLUMNS))
    check(sharding.hypergeometric_shards(df, 3).collect(), 7, 3)


def spark_hash(salt, row):
    """xxhash64 of an int and a long, as Spark chains them."""
    first = xxhash.xxh64(int(salt).to_bytes(4, "little", signed=True), seed=42).intdigest()
    h = xxhash.xxh64(int(row).to_bytes(8, "little", signed=True), seed=first).intdigest()
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("n, shards, per", [(57, 4, 1000), (230, 3, 20), (2, 5, 1000)])
def test_equals_the_shuffle_row_by_row(spark, monkeypatch, n, shards, per):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", per)
    seed, blocks = 42, max(64, -(-n // per))
    of = [[r for r in range(n) if spark_hash(seed, r) % blocks == b] for b in range(blocks)]
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = sharding.communication_matrix([len(x) for x in of], sizes, seed)
    sent = {}
    for b in range(blocks):
        rows = iter(sorted(of[b], key=lambda r: (spark_hash(seed + 1, r), r)))
        for s in range(shards):
            sent.setdefault(s, []).extend(next(rows) for _ in range(matrix[b, s]))
    parts, want = max(1, -(-n // shards // per)) if n % shards == 0 else max(1, int(np.ceil(n / shards / per))), []
    for s, rows in sent.items():
        rows.sort(key=lambda r: (spark_hash(seed + 2, r) % parts, spark_hash(seed + 3, r), r))
        want += [(r, s, k) for k, r in enumerate(rows)]
    got = sharding.hypergeometric_shards(spark.range(n).coalesce(1).withColumnRenamed("id", "doc_id"), shards, seed).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted(want)
