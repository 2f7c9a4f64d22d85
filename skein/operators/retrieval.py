"""Retrieval over chunks and their embeddings: vector, lexical and fused ranking, all as lazy DataFrame operations.

Chunks have chunk_id, text; embeddings have chunk_id, embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import signals as sg
from skein.functions import text as tx
from skein.functions import vectors as vx
from skein.operators import fuzzy
from skein.plans.search_plan import SearchPlan

RRF_CONSTANT = 60


def vector_top(embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """chunk_id, similarity, vector_rank of the k nearest; ties by id. Top k per task first, then of those."""
    near = embeddings.select("chunk_id", F.round(vx.cosine_to(F.col("embedding"), query), 6).alias("similarity"))
    return _ranked(near, [F.desc("similarity"), F.col("chunk_id")], k, "vector_rank")


def vector_top_of_each(embeddings: DataFrame, queries: dict[int, list[float]], k: int) -> DataFrame:
    """query, chunk_id, similarity, rank of the k nearest of each of a few queries, in one scan; a task keeps k rows of each."""
    each = F.array(*[F.struct(F.lit(q).alias("query"), F.round(vx.cosine_to(F.col("embedding"), v), 6).alias("similarity")) for q, v in sorted(queries.items())])
    near = embeddings.select("chunk_id", F.explode(each).alias("x")).select("x.query", "chunk_id", "x.similarity")
    return best_per_key(near, "query", [F.desc("similarity"), F.col("chunk_id")], k)


def tokenised(chunks: DataFrame) -> DataFrame:
    """chunks with `tokens`. The generator keeps filters and counts from computing them again."""
    return chunks.select("*", F.explode(F.array(tx.tokens(F.col("text")))).alias("tokens"))


def _strings(terms: list[str]):
    return F.array(*[F.lit(x) for x in terms]).cast("array<string>")


def matching(chunks: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Tokenised chunks with a term of every group."""
    found = tokenised(chunks)
    for g in groups:
        found = found.where(F.arrays_overlap("tokens", _strings(g)))
    return found


def hits(terms: list[str]):
    """How many tokens are one of the terms."""
    return F.size(F.filter("tokens", lambda x: F.array_contains(_strings(terms), x)))


def lexical_top(chunks: DataFrame, groups: list[list[str]], k: int) -> DataFrame:
    """chunk_id, hits, lexical_rank of chunks with a term of every group; more matching tokens first."""
    every = list(dict.fromkeys(x for g in groups for x in g))
    found = matching(chunks.select("chunk_id", "text"), groups).select("chunk_id", hits(every).alias("hits"))
    return _ranked(found, [F.desc("hits"), F.col("chunk_id")], k, "lexical_rank")


#: Weight of a position in a rank by covers.
POSITION_WEIGHT = 0.1


def cover_density(places, n_groups, weight: float = POSITION_WEIGHT):
    """Rank by covers: each shortest run of tokens that has a term of every group adds a weight that falls with the number of
    other tokens in it. Places are (position, groups) of tokens that are terms, in order. The state is the last place of each
    group; whenever the earliest of these moves on, a shortest run leads from there to here."""
    nowhere = F.struct(F.lit(-1).alias("k"), F.lit(-1).alias("p"))
    start = F.struct(F.array_repeat(nowhere, n_groups).alias("last"), F.lit(0).alias("k"), F.lit(-1).alias("before"), F.lit(0.0).alias("total"))

    def step(state, place):
        here = F.struct(state["k"].alias("k"), place["position"].alias("p"))
        last = F.transform(state["last"], lambda x, g: F.when(F.array_contains(place["groups"], g), here).otherwise(x))

        def follow(last):
            first = F.array_min(last)
            noise = (place["position"] - first["p"]) - (state["k"] - first["k"])
            add = F.when(first["k"] > state["before"], F.lit(weight) / (1 + noise)).otherwise(0.0)
            return F.struct(last.alias("last"), (state["k"] + 1).alias("k"), F.greatest(state["before"], first["k"]).alias("before"), (state["total"] + add).alias("total"))

        return tx.bound(last, follow)

    return F.aggregate(places, start, step, lambda s: s["total"])


def places_of(tokens, groups: list[list[str]]):
    """(position, groups) of the tokens that are terms of some groups."""
    of = lambda t: F.array_compact(F.array(*[F.when(F.array_contains(_strings(g), t), F.lit(k)) for k, g in enumerate(groups)]))
    return F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("position"), of(t).alias("groups"))), lambda x: F.size(x["groups"]) > 0)


def lexical_candidates(chunks: DataFrame, plan: SearchPlan, k: int = 20) -> DataFrame:
    """chunk_id, chunk_index, base_score, lexical_score, lexical_rank of chunks with a term of every group of the plan. Both
    scores are cover densities; that of the base terms, any of which will do, is the weight of each of their places."""
    rank = cover_density(places_of(F.col("tokens"), plan.groups), F.lit(len(plan.groups))) if plan.groups else F.lit(0.0)
    found = matching(chunks.select("chunk_id", "chunk_index", "text"), plan.groups)
    scored = found.select("chunk_id", "chunk_index", F.round(hits(plan.base) * POSITION_WEIGHT, 6).alias("base_score"), F.round(rank, 6).alias("lexical_score"))
    return _ranked(scored, [F.desc("base_score"), F.desc("lexical_score"), F.col("chunk_index"), F.col("chunk_id")], k, "lexical_rank")


def hybrid_search(chunks: DataFrame, plan: SearchPlan, query: list[float], k: int = 5, candidates: int = 20, fuzzy_k: int = 8, scan: int | None = 200, rerank: bool = True) -> DataFrame:
    """The k best of vector, lexical and fuzzy candidates by reciprocal ranks and the rerank score of their text.

    chunks: chunk_id, chunk_index, text, embedding. Fuzzy candidates are looked for among the first `scan` chunks that have no
    lexical rank (None: among all) and are ranked behind those. Missing ranks sort last."""
    vector = vector_top(chunks, query, candidates)
    lexical = lexical_candidates(chunks, plan, candidates)
    near = fuzzy.fuzzy_candidates(chunks, plan.fuzzy, lexical, fuzzy_k, scan)
    ranked = lexical.select("chunk_id", "lexical_score", "lexical_rank").unionByName(
        near.crossJoin(lexical.agg(F.count(F.lit(1)).cast("int").alias("before")))
        .select("chunk_id", F.col("fuzzy_score").alias("lexical_score"), (F.col("fuzzy_rank") + F.col("before")).alias("lexical_rank"))
    )
    fused = reciprocal_rank_fusion(vector.drop("similarity"), ranked)
    similarity = F.round(vx.cosine_to(F.col("embedding"), query), 6)
    rows = chunks.join(F.broadcast(fused), "chunk_id").withColumn("similarity", similarity).drop("embedding")
    rows = rows.withColumn("signals", sg.signals(F.col("text"), plan)).withColumn("rerank_score", sg.score(F.col("signals"), rerank))
    rows = rows.withColumn("final_score", F.round(F.col("hybrid_score") + F.col("rerank_score"), 9))
    order = [F.desc("final_score"), F.desc("hybrid_score"), F.coalesce("lexical_rank", F.lit(10**6)), F.coalesce("vector_rank", F.lit(10**6)), F.col("chunk_index"), F.col("chunk_id")]
    return _ranked(rows, order, k, "position")


def _ranked(rows: DataFrame, order: list, k: int, name: str) -> DataFrame:
    """The k first rows with their rank; only k rows are ever sorted in one place."""
    return rows.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(vector: DataFrame, lexical: DataFrame, constant: int = RRF_CONSTANT) -> DataFrame:
    """Both rankings in one, with hybrid_score, the sum of 1 / (constant + rank)."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return vector.join(lexical, "chunk_id", "full_outer").withColumn("hybrid_score", F.round(part("vector_rank") + part("lexical_rank"), 9))


def hybrid_top(chunks: DataFrame, embeddings: DataFrame, query: list[float], groups: list[list[str]], k: int, candidates: int = 20) -> DataFrame:
    """The k best of the fused candidates; missing ranks sort last."""
    fused = reciprocal_rank_fusion(vector_top(embeddings, query, candidates), lexical_top(chunks, groups, candidates))
    order = [F.desc("hybrid_score"), F.coalesce("lexical_rank", F.lit(10**6)), F.coalesce("vector_rank", F.lit(10**6)), F.col("chunk_id")]
    return _ranked(fused, order, k, "final_rank")


def stale_embeddings(chunks: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """chunk_id, state: current, stale (other text or an invalid vector) or missing."""
    joined = chunks.select("chunk_id", F.sha2("text", 256).alias("text_sha256")).join(embeddings, "chunk_id", "left")
    ok = (F.col("chunk_sha256") == F.col("text_sha256")) & vx.valid(F.col("embedding"), dimension)
    return joined.select("chunk_id", F.when(F.col("chunk_sha256").isNull(), "missing").when(ok, "current").otherwise("stale").alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both; where both have a key, the new one's."""
    n, o = new.withColumn("_new", F.lit(True)).alias("n"), old.alias("o")
    joined = o.join(n, key, "full_outer")
    return joined.select(key, *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def best_per_key(rows: DataFrame, key: str, order: list, k: int = 1, name: str = "rank") -> DataFrame:
    """The k first rows of each key; Spark keeps k rows of a key in each task before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)
