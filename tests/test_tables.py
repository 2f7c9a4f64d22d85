import os
import random

import pytest
from pyspark.sql import functions as F

from skein import storage
from skein.operators import chunking, contexts, embedding, hierarchy
from skein.sources.buckets import Conflict, Table
from skein.streaming import embeddings as streamed

KV = "k long, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_changes_are_whole_and_touch_their_buckets_only(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    first = [(k % 40, f"a{k}") for k in range(100)] + [(None, "n1"), (None, "n2")]
    table.create(spark.createDataFrame(first, KV), "k", 8)
    assert rows(table.read()) == sorted(first, key=str)
    before = table._manifest()["folders"]
    table.upsert(spark.createDataFrame([(3, "new"), (3, "newer"), (99, "x")], KV))
    want = [r for r in first if r[0] != 3] + [(3, "new"), (3, "newer"), (99, "x")]
    assert rows(table.read()) == sorted(want, key=str) and rows(table.read(1)) == sorted(first, key=str)
    after = table._manifest()["folders"]
    assert 1 <= sum(after.get(b) != f for b, f in before.items()) <= 2
    table.replace(spark.createDataFrame([(None,), (5,)], "k long"), spark.createDataFrame([(7, "more")], KV))
    want = [r for r in want if r[0] not in (None, 5)] + [(7, "more")]
    assert rows(table.read()) == sorted(want, key=str)
    table.delete(spark.createDataFrame([(k,) for k in range(100)], "k long"))
    assert rows(table.read()) == [] and table.versions() == [1, 2, 3, 4]
    table.vacuum()
    assert table.versions() == [4] and rows(table.read()) == []


def test_a_job_that_dies_leaves_the_old_table(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    table.create(spark.createDataFrame([(1, "a"), (2, "b")], KV), "k", 2)
    broken = spark.range(10).select("id", F.when(F.col("id") == 7, F.raise_error(F.lit("gone"))).otherwise("z").alias("v")).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="gone"):
        table.upsert(broken)
    assert rows(table.read()) == [(1, "a"), (2, "b")] and table.versions() == [1]
    two = Table(spark, table.path)
    commit = table._commit

    def late(version, manifest):
        two.upsert(spark.createDataFrame([(2, "first")], KV))
        commit(version, manifest)

    table._commit = late
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(2, "second")], KV))
    assert rows(two.read()) == [(1, "a"), (2, "first")]


def test_rechunking_replaces_the_chunks_of_documents(spark):
    docs = spark.createDataFrame([(1, "one. " * 400), (2, "two. " * 10)], "doc_id long, text string")
    table = Table(spark, storage.new_path(spark, "chunks"))
    table.create(chunking.chunks(docs), "doc_id", 4)
    changed = spark.createDataFrame([(1, "other")], "doc_id long, text string")
    table.replace(changed.select("doc_id"), chunking.chunks(changed))
    assert rows(table.read().select("doc_id", "chunk_text")) == [(1, "other"), (2, ("two. " * 10).strip())]


def test_closure_of_chains_cycles_and_shared_children(spark):
    edges = [(k, k + 1) for k in range(9)] + [(0, 5), (20, 21), (21, 22), (22, 20), (30, 30), (0, 1)]
    got = rows(hierarchy.closure(spark.createDataFrame(edges, "parent long, child long")))
    want = {(a, b) for a in range(10) for b in range(a + 1, 10)} | {(a, b) for a in (20, 21, 22) for b in (20, 21, 22)} | {(30, 30)}
    assert got == sorted(want, key=str)
    assert rows(hierarchy.closure(spark.createDataFrame([], "parent long, child long"))) == []


def test_beams_of_many_questions(spark):
    rng = random.Random(1)
    vectors = {k: [rng.gauss(0, 1) for _ in range(4)] for k in range(120)}
    edges = [((k - 3) // 3, k) for k in range(3, 120)] + [(1, 50), (2, 50)]
    asked = {q: [rng.gauss(0, 1) for _ in range(4)] for q in range(6)}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    near = lambda q, k: -round(sum(a * b for a, b in zip(asked[q], vectors[k], strict=True)) / norm(asked[q]) / norm(vectors[k]), 6)
    want = {}
    for q in asked:
        frontier = sorted(range(3), key=lambda k: (near(q, k), k))[:2]
        seen = dict.fromkeys(frontier, 0)
        for d in range(1, 4):
            best = {c for p in frontier for c in sorted({c for a, c in edges if a == p}, key=lambda k: (near(q, k), k))[:2]}
            for c in best:
                seen.setdefault(c, d)
            frontier = sorted(best, key=lambda k: (near(q, k), k))[:2]
        want |= {(q, k): d for k, d in seen.items()}
    nodes = spark.createDataFrame(list(vectors.items()), "node_id long, embedding array<double>")
    questions = spark.createDataFrame(list(asked.items()), "question_id long, embedding array<double>")
    got = hierarchy.beam_search_many(nodes, spark.createDataFrame(edges, "parent long, child long"), questions, 2, 2, 4)
    assert {(r.question_id, r.node_id): r.depth for r in got.collect()} == want


def test_contexts_of_null_and_large_keys(spark):
    data = [(None, 1, "a"), (None, 2, "b"), (2**53 + 1, 1, "c"), (2**53, 1, "d"), (5, 1, None), (5, 2, "e" * 30), (5, 3, "f")]
    df = spark.createDataFrame(data, "k long, turn int, text string").repartition(3)
    got = {r.k: r.context for r in contexts.folded(df, "k", "turn", "text", 20, 3).collect()}
    assert got == {None: "a\n\nb", 2**53 + 1: "c", 2**53: "d", 5: "e" * 20}


def test_the_newest_file_of_a_batch_counts(spark, tmp_path):
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    seen = set()
    for k, text in enumerate(("first words", "second words", "third words")):
        spark.createDataFrame([(1, text), (10 + k, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        for path in set((tmp_path / "in").glob("part-*")) - seen:
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
            seen.add(path)
    for _ in range(2):
        streamed.follow(spark, source, target, checkpoint, embedding.offline(4), 4, availableNow=True).awaitTermination(120)
        got = {r.doc_id: r.text for r in streamed.latest(spark, target).collect()}
        assert got == {1: "third words", 10: "first words", 11: "second words", 12: "third words"}
