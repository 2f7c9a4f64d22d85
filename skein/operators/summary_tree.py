"""A hierarchy of summaries for each document: leaves are its chunks, clusters of a level are summarised into the next one.

Documents are built side by side, each by one task; a document has at most MOST_LEAVES chunks, larger ones get an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.clustering import soft_clusters

MOST_LEVELS, MOST_LEAVES, MOST_NODES = 4, 300, 1000
CONTEXT_CHARS, SUMMARY_CHARS = 12_000, 2000
_NODES = "doc_id long, level int, node_index int, chunk_id long, text string, embedding array<double>, children array<int>, error string"


def extract(texts: list[str], most: int = SUMMARY_CHARS) -> str:
    """A summary without a language model: the first sentence of each text, as many as fit."""
    firsts = (t.strip().split(". ")[0].strip() for t in texts)
    return " ".join(dict.fromkeys(f for f in firsts if f))[:most].rstrip()


def within_context(texts: list[str], level: int, most: int = CONTEXT_CHARS, least: int = 20) -> list[str]:
    """The texts of a cluster, without control characters and spare blanks, as far as they fit under their headers into the context of one
    summary; the last one is cut, and none follows once hardly any room is left."""
    out, used = [], 0
    for i, text in enumerate(texts, 1):
        clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"[\x00-\x08\x0b-\x1f]", "", text))).strip()
        if not clean:
            continue
        room = most - used - (2 if out else 0) - len(f"[cluster_item_{i}; level={level}]\n")
        if room <= least:
            break
        out.append(clean if len(clean) <= room else clean[:room].rstrip(" "))
        used = most - room + len(out[-1])
        if used >= most:
            break
    return out


def _levels(doc: pd.DataFrame, summarise, embed, levels: int, most_nodes: int):
    """Rows (level, node_index, chunk_id, text, vector, children) of one document."""
    items = [(t, np.asarray(v, float)) for t, v in zip(doc["text"], doc["embedding"], strict=True)]
    for k, (chunk, (text, v)) in enumerate(zip(doc["chunk_id"], items, strict=True)):
        yield 0, k, chunk, "", v, []
    level, nodes = 0, len(items)
    while len(items) > 1 and level + 1 < levels:
        clusters, level = soft_clusters(np.array([v for _, v in items])), level + 1
        made = []
        for k, members in enumerate(clusters):
            text = summarise(within_context([items[m][0] for m in members], level - 1))[:SUMMARY_CHARS].rstrip()
            vector = embed(text, np.array([items[m][1] for m in members]))
            made.append((text, vector))
            yield level, k, None, text, vector, members
        nodes += len(made)
        if nodes > most_nodes:
            raise ValueError("too_many_raptor_nodes")
        if len(made) >= len(items):
            break  # no further: this level stays, as roots
        items = made


def mean_vector(text: str, vectors: np.ndarray) -> np.ndarray:
    v = vectors.mean(axis=0)
    return v / max(1e-12, float(np.linalg.norm(v)))


def build(chunks: DataFrame, summarise: Callable = extract, embed: Callable = mean_vector, levels: int = MOST_LEVELS, most_leaves: int = MOST_LEAVES, most_nodes: int = MOST_NODES) -> DataFrame:
    """Nodes of the hierarchies of all documents: chunks are doc_id, chunk_id, chunk_index, text, embedding. children are
    node_index numbers of the level below. A document that fails has one row with an error and a null level."""
    def one(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values(["chunk_index", "chunk_id"])
        doc_id = doc["doc_id"].iloc[0]
        names = ["level", "node_index", "chunk_id", "text", "embedding", "children"]
        try:
            rows = pd.DataFrame(list(_levels(doc, summarise, embed, levels, most_nodes)), columns=names)
            rows["error"] = None
        except ValueError as e:
            rows = pd.DataFrame([(None, None, None, None, None, None, str(e))], columns=[*names, "error"])
        rows.insert(0, "doc_id", doc_id)
        for c in ("level", "node_index", "chunk_id"):
            rows[c] = rows[c].astype("Int64")
        return rows

    size = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("missing"))
    fault = F.when(F.col("n") > most_leaves, "too_many_chunks_for_raptor").when(F.col("missing") > 0, "embeddings_not_found")
    size = size.select("doc_id", fault.alias("error"))
    good = chunks.join(size.where("error is null").select("doc_id"), "doc_id", "left_semi")
    nodes = good.select("doc_id", "chunk_id", "chunk_index", "text", F.col("embedding").cast("array<double>").alias("embedding")).groupBy("doc_id").applyInPandas(one, _NODES)
    empty = [F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in _NODES.split(", ")[1:-1]]
    return nodes.unionByName(size.where("error is not null").select("doc_id", *empty, "error"))


def edges(nodes: DataFrame) -> DataFrame:
    """doc_id, parent_level, parent_index, child_rank, child_index of nodes."""
    return nodes.where("level > 0").select("doc_id", F.col("level").alias("parent_level"), F.col("node_index").alias("parent_index"), F.posexplode("children").alias("child_rank", "child_index"))


def status(nodes: DataFrame) -> DataFrame:
    """doc_id, status, error, level_count, leaf_count, summary_count, total_count, nodes_per_level of each document. A last
    level that has as many nodes as the one below counts in the total only."""
    per = nodes.groupBy("doc_id", "level").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("error").alias("error"))
    rows = per.groupBy("doc_id").agg(
        F.max("error").alias("error"), F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0)).cast("int").alias("total_count"),
        F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "n")))).alias("levels"),
    )
    counted = F.filter("levels", lambda x, i: (i == 0) | (x["n"] < F.try_element_at("levels", i)["n"]))
    rows = rows.withColumn("levels", counted)
    n = F.aggregate("levels", F.lit(0), lambda s, x: s + x["n"])
    leaves = F.coalesce(F.try_element_at("levels", F.lit(1))["n"], F.lit(0))
    return rows.select(
        "doc_id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", F.size("levels").alias("level_count"),
        leaves.alias("leaf_count"), (n - leaves).alias("summary_count"), "total_count", F.map_from_entries("levels").alias("nodes_per_level"),
    )
