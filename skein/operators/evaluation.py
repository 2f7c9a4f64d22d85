"""Retrieval metrics over (question, rank, item) rows and (question, item) expectations, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_and_reciprocal_rank(ranking: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """question, recall (of expected items within the first k) and reciprocal_rank (0 if none is found)."""
    hits = expected.join(ranking, ["question", "item"], "left")
    found = F.count(F.when(F.col("rank") <= k, 1))
    return hits.groupBy("question").agg(
        F.round(found / F.count(F.lit(1)), 4).alias("recall"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 4).alias("reciprocal_rank")
    )


def inclusion(questions: DataFrame, expected: DataFrame, included: DataFrame) -> DataFrame:
    """question, success: whether all items expected are among those included; true where nothing is expected."""
    seen = included.select("question", "item").distinct().withColumn("hit", F.lit(True))
    per = expected.select("question", "item").distinct().join(seen, ["question", "item"], "left").groupBy("question").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all"))
    return questions.select("question").join(per, "question", "left").select("question", F.coalesce("all", F.lit(True)).alias("success"))


def stage_ranks(stages: DataFrame, expected: DataFrame) -> DataFrame:
    """question, then for each stage the first rank of an expected item; null where none is found."""
    names = ["vector", "lexical", "rrf", "rerank", "final"]
    hits = expected.join(stages, ["question", "item"], "left")
    return hits.groupBy("question").agg(*[F.min(F.when(F.col("stage") == n, F.col("rank"))).alias(f"{n}_rank") for n in names])


def aggregated(reports: DataFrame) -> DataFrame:
    """Cases, successes, failures and mean metrics (nulls don't count) by dataset, and over all (dataset null)."""
    mean = lambda c: F.bround(F.avg(c), 4).alias(f"avg_{c}")
    return reports.rollup("dataset").agg(
        F.count(F.lit(1)).cast("int").alias("cases"), F.count_if("success").cast("int").alias("successes"),
        F.count_if(~F.col("success")).cast("int").alias("failures"), mean("recall"), mean("reciprocal_rank"),
    )


def summary_fidelity(summaries: DataFrame, leaves: DataFrame, texts: DataFrame, facts: DataFrame) -> DataFrame:
    """node_id, fact_id, preserved: facts whose value a leaf below a summary has, and whether the summary has it."""
    below = leaves.join(texts.withColumnRenamed("node_id", "leaf"), "leaf")
    found = below.join(F.broadcast(facts), F.contains(F.col("text"), F.col("value"))).select(F.col("ancestor").alias("node_id"), "fact_id", "value").distinct()
    return found.join(summaries.select("node_id", F.col("text").alias("summary")), "node_id").select("node_id", "fact_id", F.contains("summary", "value").alias("preserved"))


def improvement(rag_failures: Column, tree_failures: Column, fidelity: Column, over_limit: Column) -> list[Column]:
    """What the failures of an evaluation call for."""
    case = lambda c, yes, no="NON JUSTIFIEE": F.when(c, yes).otherwise(no)
    tested, look = "JUSTIFIEE PAR LES TESTS", "A INVESTIGUER"
    return [
        case(rag_failures > 0, tested).alias("rag_context_budget"),
        case(rag_failures > 0, look).alias("rag_fuzzy_matching"),
        case(tree_failures > 0, look).alias("tree_top_down"),
        case(tree_failures > 0, tested).alias("tree_context_budget"),
        case(F.coalesce(fidelity < 1.0, F.lit(False)), tested).alias("tree_summary_guard"),
        case(over_limit > 0, "STRUCTURAL LIMIT").alias("prompt_above_window"),
    ]
