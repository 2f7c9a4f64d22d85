"""Who may read what, which embeddings are current, and the forms in which results leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import lexicon
from skein.functions import vectors as vx


def owned(documents: DataFrame, owner: int) -> DataFrame:
    """Documents of one owner; others are as if they weren't there."""
    return documents.where(F.col("owner_id") == owner)


def current(embeddings: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """Completed embeddings of one provider, model and dimension that have a vector."""
    of = (F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimension") == dimension)
    return embeddings.where((F.col("status") == "completed") & of & F.col("embedding").isNotNull())


def searchable(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """Chunks with their current embedding."""
    return chunks.join(current(embeddings, provider, model, dimension).select("chunk_id", "embedding"), "chunk_id")


def documents_with(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have chunks."""
    return documents.join(chunks.select("doc_id"), "doc_id", "left_semi")


def gate(extraction_status: Column, has_text: Column, has_chunks: Column, has_embeddings: Column) -> Column:
    """The first reason why a document can't be searched; null if it can."""
    none = lambda c: ~F.coalesce(c, F.lit(False))
    case = F.when(extraction_status.isNull(), "extraction_not_found").when(extraction_status != "completed", "extraction_not_completed")
    return case.when(none(has_text), "no_text").when(none(has_chunks), "chunks_not_found").when(none(has_embeddings), "embeddings_not_found")


def index_gate(status: Column, provider: Column, model: Column, dimension: Column, want: tuple[str, str, int]) -> Column:
    """Why a summary index can't be asked: none, not ready, or built with another embedding model; null if it can."""
    same = (provider == want[0]) & (model == want[1]) & (dimension == want[2])
    case = F.when(status.isNull(), "raptor_index_not_found").when(status != "completed", "raptor_index_not_ready")
    return case.when(~F.coalesce(same, F.lit(False)), "raptor_embedding_model_mismatch")


def violations(rows: DataFrame, checks: dict[str, Column], keys: dict[str, list[str]]) -> DataFrame:
    """constraint, violations: rows that break each check (null counts as kept), and rows beyond the first of each key."""
    broken = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(k) for k, c in checks.items()])
    out = broken.select(F.explode(F.array(*[F.struct(F.lit(k).alias("constraint"), F.col(k).alias("violations")) for k in checks])).alias("x")).select("x.*")
    for name, key in keys.items():
        again = rows.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(again.select(F.lit(name).alias("constraint"), "violations"))
    return out


def contains_text(c: Column, part: str) -> Column:
    """Whether a text has a part, whatever the case of letters."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def first_filled(metadata: Column, keys: list[str]) -> Column:
    """The first value of a map that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in keys])


def page_of(metadata: Column) -> Column:
    return first_filled(metadata, lexicon.PAGE_KEYS)


def section_of(metadata: Column) -> Column:
    return first_filled(metadata, lexicon.SECTION_KEYS)


def result_score(final: Column, hybrid: Column, similarity: Column) -> Column:
    return F.coalesce(final, hybrid, similarity, F.lit(0.0))


def node_text(level: Column, chunk_text: Column, own_text: Column) -> Column:
    """A leaf's text is its chunk's, a summary's its own."""
    return F.when((level == 0) & chunk_text.isNotNull(), chunk_text).otherwise(own_text)


def node_type(level: Column) -> Column:
    return F.when(level == 0, "leaf").otherwise("summary")


# The fields of a search result; vectors never leave.
RESULT_FIELDS = (
    "chunk_id doc_id extraction_result_id embedding_id chunk_index text character_start character_end text_length text_sha256 chunk_metadata "
    "cosine_distance similarity vector_rank lexical_rank lexical_score hybrid_score rerank_score final_score signals"
).split()


def result(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in RESULT_FIELDS if c in rows.columns])


def source_payload(rows: DataFrame, *keys: str) -> DataFrame:
    """source (source_1, ... by position), chunk_id, chunk_index, similarity of ranked rows, and their keys."""
    return rows.select(*keys, F.concat(F.lit("source_"), F.col("position").cast("string")).alias("source"), "chunk_id", "chunk_index", "similarity")


def valid_vector(v: Column, dimension: int) -> Column:
    return vx.valid(v, dimension)
