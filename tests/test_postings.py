import random

import pytest

from skein.operators import postings, retrieval
from skein.plans import search_plan

F = postings.F
WORDS = "alpha beta gamma delta garantie offre montant prix reference site".split()


def cover_rank(tokens, groups):
    """Shortest runs by brute force: every pair of ends, without another run inside, one for each end on the left."""
    places = [i for i, t in enumerate(tokens) if any(t in g for g in groups)]
    runs = [(i, j) for i in places for j in places if i <= j and all(any(tokens[k] in g for k in range(i, j + 1)) for g in groups)]
    shortest = [r for r in runs if not any(r != s and r[0] <= s[0] and s[1] <= r[1] for s in runs)]
    return sum(0.1 / (1 + (j - i) - sum(i < p <= j for p in places)) for i, j in shortest)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice([*WORDS, "x", "y"]) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "Alpha! BÊTA, alpha"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")


def test_positions(spark, table):
    texts, df = table
    index = postings.build(df)
    got = {(r.term, r.chunk_id): r.positions for r in index.postings.collect()}
    want = {}
    for k, t in enumerate(texts):
        for i, w in enumerate(search_plan.re.findall("[0-9a-z]+", search_plan.fold(t or ""))):
            want.setdefault((w, k), []).append(i)
    assert got == want
    assert {r.term: r.df for r in index.terms.collect()} == {w: sum(1 for x, _ in want if x == w) for w in {x for x, _ in want}}


def test_many_questions_equal_a_scan_for_each(spark, table):
    texts, df = table
    asked = ["alpha beta", "garantie offre", "reference du site", "montant", "nowhere alpha", "", None, "le la", "delta delta gamma alpha"]
    index = postings.build(df)
    found = postings.lexical_many(index, postings.wanted_terms(spark.createDataFrame(list(enumerate(asked)), "question_id long, text string")), 7).collect()
    chunks = df.where("text is not null").withColumn("chunk_index", F.lit(0))
    for q, text in enumerate(asked):
        plan = search_plan.plan(text or "")
        want = [(r.chunk_id, r.base_score, r.lexical_score, r.lexical_rank) for r in retrieval.lexical_candidates(chunks, plan, 7).collect()] if plan.groups else []
        got = sorted(((r.chunk_id, r.base_score, r.lexical_score, r.rank) for r in found if r.question_id == q), key=lambda r: r[3])
        assert got == sorted(want, key=lambda r: r[3]), text
        for c, _, score, _ in got:
            tokens = search_plan.re.findall("[0-9a-z]+", search_plan.fold(texts[c]))
            assert abs(score - cover_rank(tokens, [set(g) for g in plan.groups])) < 2e-6


def test_search_reads_partitions_of_its_terms_only(spark, table):
    index = postings.build(table[1])
    wanted = postings.wanted_terms(spark.createDataFrame([(1, "alpha")], "question_id long, text string"))
    plan = postings.lexical_many(index, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_french_configuration(spark):
    df = spark.createDataFrame([(1, "Les garanties continuaient à l'été"), (2, "la garantie continue"), (3, "garant")], "chunk_id long, text string")
    index = postings.build(df, config="french")
    asked = spark.createDataFrame([(1, "continuer garanties")], "question_id long, text string")
    assert [r.chunk_id for r in postings.lexical_many(index, postings.wanted_terms(asked, "french")).orderBy("rank").collect()] == [1, 2]
    assert not postings.lexical_many(postings.build(df), postings.wanted_terms(asked)).collect()
    assert postings.build(df, config="klingon").config == "simple"
    assert {r.term: r.positions for r in index.postings.where("chunk_id = 1").collect()} == {"garant": [1], "continu": [2], "à": [3], "l": [4], "été": [5]}


def test_vectors_of_many_questions(spark, monkeypatch):
    monkeypatch.setattr(postings, "VECTOR_BYTES", 200)
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for k in range(150)] + [(500, None), (501, [1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(k, rows[k][1]) for k in range(20)] + [(99, None)], "question_id long, embedding array<double>")
    got = postings.vector_many(df, asked, 6).collect()
    for q in range(20):
        mine = sorted(((r.rank, r.chunk_id, r.similarity) for r in got if r.question_id == q))
        norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
        each = [(-round(sum(a * b for a, b in zip(v, rows[q][1], strict=True)) / norm(v) / norm(rows[q][1]), 6) + 0.0, k) for k, v in rows[:150]]
        assert [(c, s) for _, c, s in mine] == [(k, -s + 0.0) for s, k in sorted(each)[:6]]


def test_hybrid_equals_one_question_at_a_time(spark, table):
    texts, df = table
    rng = random.Random(5)
    vectors = {k: [rng.random() for _ in range(3)] for k in range(len(texts))}
    e = spark.createDataFrame(list(vectors.items()), "chunk_id long, embedding array<double>")
    asked = [(1, "alpha beta", vectors[5]), (2, "nothing here", vectors[6]), (3, "garantie", None)]
    got = postings.hybrid_many(postings.build(df), e, spark.createDataFrame(asked, "question_id long, text string, embedding array<double>"), 5).collect()
    chunks = df.withColumn("chunk_index", F.lit(0)).where("text is not null")
    for q, text, v in asked[:2]:
        lexical = retrieval.lexical_candidates(chunks, search_plan.plan(text))
        both = retrieval.reciprocal_rank_fusion(retrieval.vector_top(e, v, 20), lexical)
        want = sorted((-r.hybrid_score, r.lexical_rank or 10**6, r.vector_rank or 10**6, r.chunk_id) for r in both.collect())[:5]
        assert [x[3] for x in want] == [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.final_rank)]
    assert {r.vector_rank for r in got if r.question_id == 3} == {None}


@pytest.mark.parametrize("config", ["simple", "french"])
def test_build_lists_words_where_texts_are_read(spark, table, monkeypatch, config):
    """A posting moves once, whatever the size of the slices; rows of one chunk_id are one chunk."""
    monkeypatch.setattr(postings, "CHARS", 300)
    texts = [*table[0], "Les garanties continuaient à l'été"]
    rows = [(k % 180, t) for k, t in enumerate(texts)] + [(500, t) for t in texts[:3]]
    for some in (rows, rows[:180]):
        index = postings.build(spark.createDataFrame(some, "chunk_id long, text string").repartition(3), config=config)
        words = spark.createDataFrame(some, "chunk_id long, text string").select("chunk_id", F.posexplode(postings.terms_of(F.col("text"), config)).alias("p", "term")).collect()
        want = {}
        for r in words:
            want.setdefault((r.term, r.chunk_id), []).append(r.p) if r.term is not None else None
        assert {(r.term, r.chunk_id): r.positions for r in index.postings.collect()} == {k: sorted(v) for k, v in want.items()}
        assert index.postings.count() == len(want) and {r.term: r.df for r in index.terms.collect()} == {w: sum(1 for x, _ in want if x == w) for w in {x for x, _ in want}}


def test_words_of_a_text_do_not_move_one_by_one(spark, table):
    """Without repeated chunk_ids only packed postings are shuffled: one exchange before the write, none of single words."""
    packed = postings._packed(table[1], "simple")
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    words = sum(len(search_plan.re.findall("[0-9a-z]+", search_plan.fold(t or ""))) for t in table[0])
    assert packed.count() < words / 10


@pytest.mark.parametrize("k", [1, 6, 40])
def test_vectors_by_small_parts_with_many_ties(spark, monkeypatch, k):
    """Vectors meet the questions in parts of bounded size, and each question holds k rows at most meanwhile."""
    monkeypatch.setattr(postings, "ROWS", 7)
    monkeypatch.setattr(postings, "BLOCK", 5)
    rng = random.Random(6)
    rows = [(k, [float(rng.choice([-1, 1])) for _ in range(3)]) for k in range(160)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").coalesce(2)
    asked = spark.createDataFrame(rows[:30], "question_id long, embedding array<double>")
    got = postings.vector_many(df, asked, k).collect()
    for q, v in rows[:30]:
        each = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / 3, 6), c) for c, w in rows)[:k]
        assert [(-r.similarity, r.chunk_id) for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.rank)] == each
