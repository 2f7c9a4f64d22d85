"""A corpus pipeline of five operators: toxicity, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs.
All but the last return the columns of documents, whatever these are; columns whose names an operator uses, too, keep their
values. Defined results: an empty table stays empty; null ids, sources and languages are ordinary values; a null or empty
text isn't toxic, has no language (the second stage drops it) and no words; repeated rows are separate documents until the
third stage, which keeps one of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common, jaccard_join, language, mixing, packing, toxicity


def _wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """Whole rows as one column beside the columns that an operator reads, so that its own columns clash with none."""
    return docs.select(F.struct("*").alias("_row"), *names)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; the field learns from the labels that operator 6 may see, as far as their documents
    are there. Without labels none is dropped; null and empty texts stay."""
    field = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(_wrapped(docs, "text"), field).where("predicted = 0").select("_row.*")


def drop_unknown_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters of some language; null texts and those without a letter go. The languages are those that the
    remaining documents are labelled with; if none is labelled, nothing can be told and nothing but these goes either."""
    model = language.trained(docs)
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.identify_languages(_wrapped(docs, "text"), model).where("lang_pred <> 'und'").select("_row.*")


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts that link at a similarity of 0.8 in five-word shingles. Ties of
    ids are broken by a hash of the text; documents without words stay, one for each pair of id and text."""
    return jaccard_join.first_of_each(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by Poisson replication towards weights that go with the root of each source's rows; a null source is one, too. As many
    rows are expected as there were, in an order by hash."""
    return mixing.poisson_mixture(_wrapped(docs, "doc_id", "text", "source")).select("_row.*")


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence of at most 1024 tokens and its place there; a null text is empty."""
    return packing.best_fit_pack(docs, common.byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes as soon as the next one is written."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.Tables(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, tables.write(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
