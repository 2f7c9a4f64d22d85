"""From a question to an answer with evidence: the steps of the other modules in their order.

Chunks have chunk_id, chunk_index, text, embedding. `embed` gives a text's vector, `answer` an answer to (question, context);
both are the caller's. What is collected is one question's results, as many as a search returns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import questions as qs
from skein.operators import answers, contexts, evidence, hierarchy, retrieval
from skein.plans import search_plan

NOT_FOUND = "Information not found in the provided document."


class AskError(ValueError):
    """A question that can't be asked; the message is its code."""


@dataclass(frozen=True)
class Parts:
    text: str
    strategy: str
    subqueries: list[str]
    search_text: str | None


def understood(spark, question: str, most: int = 1000) -> Parts:
    """The question, checked and taken apart."""
    row = spark.range(1).select(F.lit(question).alias("q")).select(qs.checked(F.col("q"), most).alias("c")).select("c.*", qs.decompose(F.col("c.text")).alias("d")).first()
    if row.error:
        raise AskError(row.error)
    return Parts(row.text, row.d.strategy, list(row.d.subqueries), row.d.search_text)


def search(chunks: DataFrame, question: str, embed: Callable[[str], list[float]], k: int = 5, **options) -> DataFrame:
    """The k best chunks for one text that is searched for."""
    return retrieval.hybrid_search(chunks, search_plan.plan(question), embed(question), k, **options)


def retrieve(chunks: DataFrame, question: str, embed: Callable[[str], list[float]], k: int = 5, per_query: int = 5, **options) -> DataFrame:
    """chunk_id, chunk_index, text, similarity, score, position: of one search, or of one for each subquery, merged."""
    parts = understood(chunks.sparkSession, question)
    if not parts.subqueries:
        found = search(chunks, parts.search_text, embed, k, **options)
        return found.select("chunk_id", "chunk_index", "text", "similarity", F.col("final_score").alias("score"), "position")
    each = [
        search(chunks, q, embed, per_query, **options).select(F.lit(i).alias("query"), "chunk_id", F.col("position").alias("rank"), F.col("final_score").alias("score"), "similarity")
        for i, q in enumerate(parts.subqueries)
    ]
    results = each[0]
    for r in each[1:]:
        results = results.unionByName(r)
    results = results.cache()  # a few rows for each subquery
    chosen = answers.select_merged(results.drop("similarity"), k, len(each))
    near = results.groupBy("chunk_id").agg(F.max("similarity").alias("similarity"))
    texts = chunks.select("chunk_id", "chunk_index", "text").join(F.broadcast(chosen.join(near, "chunk_id")), "chunk_id")
    return texts.select("chunk_id", "chunk_index", "text", "similarity", F.col("merged_score").alias("score"), "position")


def ask(chunks: DataFrame, question: str, embed, answer: Callable[[str, str], str], k: int = 5, most: int = 6000, **options) -> dict:
    """answer, sources, context, evidence and coverage for one question. Without a context the answer is NOT_FOUND and nobody is asked;
    an answer with a claim that no text supports isn't given, after up to three more searches for what supports it."""
    spark = chunks.sparkSession
    rows = sorted(retrieve(chunks, question, embed, k, **options).collect(), key=lambda r: r.position)
    listed = spark.createDataFrame([([(r.chunk_index, r.text) for r in rows],)], "r array<struct<chunk_index:int,text:string>>")
    context = listed.select(contexts.retrieval_context(F.col("r"), most).alias("c")).select("c.*").first()
    if not context.text:
        return {"answer": NOT_FOUND, "sources": [], "context": context.asDict(), "evidence": [], "coverage": None}
    said = answer(question, context.text)
    schema = "question_id string, question string, answer string, rank int, text string, similarity double"

    def judged(found: list) -> tuple:
        candidates = spark.createDataFrame([("q", question, said, i, r.text, r.similarity) for i, r in enumerate(found)], schema)
        chosen = evidence.select_evidence(candidates)
        return candidates, chosen, evidence.coverage(candidates, chosen).first()

    candidates, chosen, covered = judged(rows)
    if covered.blocked:
        asked = evidence.recovery_queries(spark.createDataFrame([covered]), candidates.select("question_id", "question").distinct())
        more = [r for q in asked.orderBy("attempt").collect() for r in search(chunks, q.search_text, embed, 3, **options).collect()]
        if more:
            candidates, chosen, covered = judged([*rows, *more])
    items = [] if covered.blocked else [r.asDict() for r in evidence.items(chosen).orderBy("item").collect()]
    sources = [{"source": f"source_{i}", "chunk_id": r.chunk_id, "chunk_index": r.chunk_index, "similarity": r.similarity} for i, r in enumerate(rows, 1)]
    return {"answer": covered.answer, "sources": sources[: context.included], "context": context.asDict(), "evidence": items, "coverage": covered.asDict()}


def ask_document(text: str, question: str, answer: Callable[[str, str], str], spark, prompt: str = "", **options) -> dict:
    """The answer from the longest start of a whole document that fits."""
    parts = understood(spark, question)
    size = len(prompt) + len(parts.text)
    row = spark.createDataFrame([(text,)], "t string").select(contexts.full_context(F.col("t"), size, **options).alias("c")).select("c.*").first()
    if row.error:
        raise AskError(row.error)
    return {"answer": answer(parts.text, row.text) if row.text else NOT_FOUND, "strategy": row.strategy, "tokens": row.tokens}


def sub_questions(spark, question: str) -> list[str]:
    """What a question to the hierarchy is taken apart into."""
    return list(spark.range(1).select(qs.sub_intents(F.lit(question)).alias("s")).first().s.subintents)


def tree_tokens(spark, question: str) -> list[str]:
    from skein.functions import text as tx

    return list(spark.range(1).select(tx.tree_tokens(F.lit(question)).alias("t")).first().t)


def retrieve_tree(nodes: DataFrame, edges: DataFrame, question: str, k: int = 6, top_down: bool = True) -> DataFrame:
    """The k nodes chosen for one question: by a beam from the roots or by levels, together with the leaves whose values fit.

    nodes: node_id, level, node_index, text, similarity, distance (to the question)."""
    tokens = tree_tokens(nodes.sparkSession, question)
    base = nodes.withColumn("selection_score", F.col("similarity"))
    if top_down:
        visited = hierarchy.beam_search(nodes, edges)
        found = base.join(visited, "node_id").withColumn("reason", F.when(F.col("depth") == 0, "top_down_root").otherwise("top_down_child")).drop("depth")
    else:
        ranked = retrieval.best_per_key(base, "level", [F.desc("similarity"), F.col("node_index"), F.col("node_id")], hierarchy.level_limit(k))
        found = ranked.drop("rank").withColumn("reason", F.lit("level"))
    factual = hierarchy.factual_candidates(nodes.where("level = 0"), tokens) if hierarchy.value_intents(tokens) else None
    both = hierarchy.better_of_two(found, factual.select(found.columns)) if factual is not None else found
    return hierarchy.final_selection(both, k)


def ask_tree(spark, nodes_for: Callable[[str], DataFrame], edges: DataFrame, question: str, answer: Callable[[str, str], str], k: int = 6, most: int = 6000) -> dict:
    """answer, nodes (in their order), context and coverage of one question to a hierarchy. `nodes_for` gives the nodes with their
    similarity to a question; each part of a question is searched for by itself."""
    parts = sub_questions(spark, understood(spark, question).text)
    found = [retrieve_tree(nodes_for(q), edges, q, k).withColumn("intent", F.lit(i)) for i, q in enumerate(parts, 1)]
    names = ["intent", "node_id", "level", "node_index", "text", "similarity", "distance", "selection_score"]
    if len(parts) > 1:
        results = found[0].select(names)
        for f in found[1:]:
            results = results.unionByName(f.select(names))
        chosen = hierarchy.select_intents(results.cache(), len(parts), k)  # k rows for each part
        coverage = {r.intent: r.covered for r in hierarchy.intent_coverage(chosen, len(parts)).collect()}
    else:
        chosen = found[0].withColumn("intents", F.array().cast("array<int>"))
        coverage = {1: not chosen.isEmpty()}
    rows = chosen.orderBy("position").select("node_id", "level", "node_index", "intents", "similarity", "text").collect()
    leaf = lambda r, v: v if r.level == 0 else None
    listed = [(r.node_id, r.level, leaf(r, r.node_id), leaf(r, r.node_index), None, r.intents, r.similarity, r.text) for r in rows]
    kind = "array<struct<node_id:long,level:int,chunk_id:long,chunk_index:int,parent:long,subintents:array<int>,similarity:double,text:string>>"
    context = spark.createDataFrame([(listed,)], f"r {kind}").select(contexts.hierarchy_context(F.col("r"), most).alias("c")).select("c.*").first()
    said = answer(question, context.text) if context.text else NOT_FOUND
    return {"answer": said, "nodes": [r.node_id for r in rows], "context": context.asDict(), "coverage": coverage}
