"""Embedding runs: which chunks need a vector, batches for a provider, and what a run has done."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors as vx
from skein.operators.retrieval import stale_embeddings

BATCH, MOST_CHUNKS, RETRIES, BACKOFF = 16, 200, 2, 0.25


def offline_vector(text: str, dimension: int) -> list[float]:
    """A vector that depends on the text's words only: each adds to the places that its hash gives. Needs no network."""
    out = np.full(dimension, 1e-3)
    for word in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out[h % dimension] += 1.0 if h >> 32 & 1 else 0.5
    return (out / np.linalg.norm(out)).tolist()


def offline(dimension: int) -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [offline_vector(t, dimension) for t in texts]


def with_retries(provider, texts: list[str], retries: int = RETRIES, backoff: float = BACKOFF, sleep=time.sleep):
    """The provider's answer; a timeout or a refusal for the moment is tried again after a pause that doubles."""
    for attempt in range(retries + 1):
        try:
            return provider(texts)
        except (TimeoutError, ConnectionError):
            if attempt == retries:
                raise
            sleep(backoff * 2**attempt)


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = BATCH) -> DataFrame:
    """chunk_id, embedding, status, error, chunk_sha256 of chunks (chunk_id, text). A batch fails as a whole, the others stay."""
    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), batch):
                some = frame.iloc[a : a + batch]
                try:
                    vectors, error = with_retries(provider, some["text"].tolist()), None
                    if len(vectors) != len(some):
                        raise ValueError("malformed_embedding_response")
                    if any(len(v) != dimension or not np.isfinite(np.asarray(v, float)).all() for v in vectors):
                        raise ValueError("invalid_embedding_vector")
                except (ValueError, TimeoutError, ConnectionError) as e:
                    known = isinstance(e, ValueError) and e.args
                    vectors, error = [None] * len(some), str(e.args[0]) if known else "embedding_provider_failed"
                yield pd.DataFrame({"chunk_id": some["chunk_id"], "embedding": vectors, "error": error, "chunk_sha256": some["chunk_sha256"]})

    rows = chunks.select("chunk_id", "text", F.sha2("text", 256).alias("chunk_sha256"))
    made = rows.mapInPandas(run, "chunk_id long, embedding array<double>, error string, chunk_sha256 string")
    return made.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed"))


def due(chunks: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """Chunks whose embedding is missing or stale."""
    states = stale_embeddings(chunks.select("chunk_id", "text"), embeddings, dimension)
    return chunks.join(states.where("state <> 'current'").select("chunk_id"), "chunk_id", "left_semi")


def run_report(chunks: DataFrame, embeddings: DataFrame, dimension: int, most: int = MOST_CHUNKS) -> DataFrame:
    """doc_id, chunks, reused, generated, error: what a run does for each document."""
    states = stale_embeddings(chunks.select("chunk_id", "text"), embeddings, dimension)
    per = chunks.select("doc_id", "chunk_id").join(states, "chunk_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("chunks"), F.count_if(F.col("state") == "current").cast("int").alias("reused")
    )
    over = F.when(F.col("chunks") > most, "too_many_chunks_for_embedding")
    return per.select("doc_id", "chunks", "reused", (F.col("chunks") - F.col("reused")).alias("generated"), over.alias("error"))


def status_summary(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """doc_id, chunk_count, embedding_count, failed_count."""
    joined = chunks.select("doc_id", "chunk_id").join(embeddings.select("chunk_id", "status"), "chunk_id", "left")
    return joined.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("chunk_count"), F.count_if(F.col("status") == "completed").cast("int").alias("embedding_count"),
        F.count_if(F.col("status") == "failed").cast("int").alias("failed_count"),
    )


def valid(embeddings: DataFrame, dimension: int) -> DataFrame:
    return embeddings.where(vx.valid(F.col("embedding"), dimension))
