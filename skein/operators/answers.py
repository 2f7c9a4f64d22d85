"""Merging of several queries' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what a further matching query adds.
MATCHED_QUERY = 0.006


def merge_queries(results: DataFrame) -> DataFrame:
    """chunk_id, n_matched, best_score, merged_score of rows (query, chunk_id, score): one row a chunk."""
    merged = results.groupBy("chunk_id").agg(F.count_distinct("query").cast("int").alias("n_matched"), F.max("score").alias("best_score"))
    return merged.withColumn("merged_score", F.round(F.col("best_score") + MATCHED_QUERY * (F.col("n_matched") - 1), 6))


def select_merged(results: DataFrame, limit: int, n_queries: int) -> DataFrame:
    """The chunks chosen from rows (query, chunk_id, rank, score): each query's first chunk that no earlier query (by number) took,
    then by merged score. chunk_id, merged_score, position."""
    merged = merge_queries(results)
    taken = None
    for q in range(n_queries):
        mine = results.where(F.col("query") == q)
        if taken is not None:
            mine = mine.join(taken, "chunk_id", "left_anti")
        first = mine.orderBy("rank", "chunk_id").limit(1).select("chunk_id", F.lit(q).alias("turn"))
        taken = first if taken is None else taken.union(first)
    order = [F.coalesce("turn", F.lit(n_queries)), F.desc("merged_score"), F.desc("n_matched"), F.col("chunk_id")]
    chosen = merged.join(taken, "chunk_id", "left").orderBy(*order).limit(limit)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("chunk_id", "merged_score", "position")
