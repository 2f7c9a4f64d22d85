"""Keeps a table of chunk embeddings up to date with a folder into which documents are written.

The table is keyed by chunk and changes as a whole with each batch of the stream, in the buckets that the batch touches. A batch that
runs twice finds its chunks there already and changes nothing. Of several versions of a document in one batch the one in the file
that was written last counts; of several in one file, the last by SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein import storage
from skein.operators import chunking, embedding
from skein.sources.buckets import Table

#: Versions of the table that readers may still be at.
KEPT_VERSIONS = 3
SCHEMA = "doc_id long, chunk_index int, chunk_id long, text string, embedding array<double>, status string, error string, chunk_sha256 string"


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The chunks as they are now."""
    return Table(spark, target).read()


def changed(docs: DataFrame, known: DataFrame | None, provider: Callable, dimension: int) -> DataFrame:
    """Rows of SCHEMA for the chunks of docs that are new or have another text, and rows without a text for those that are gone."""
    made = chunking.chunks(docs).select(
        "doc_id", "chunk_index", F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), F.col("chunk_text").alias("text"), F.col("text_sha256").alias("chunk_sha256")
    )
    if known is None:
        due, gone = made, None
    else:
        same = known.where("status = 'completed'").select("chunk_id", "chunk_sha256")
        due = made.join(same, ["chunk_id", "chunk_sha256"], "left_anti")
        gone = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").join(made.select("chunk_id"), "chunk_id", "left_anti")
    rows = embedding.embed(due, provider, dimension).drop("chunk_sha256").join(due, "chunk_id").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    if gone is None:
        return rows
    empty = [F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in SCHEMA.split(", ")[3:]]
    return rows.unionByName(gone.select("doc_id", "chunk_index", "chunk_id", *empty))


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, provider: Callable, dimension: int, schema: str = "doc_id long, text string", **trigger) -> StreamingQuery:
    """Starts the stream. trigger: arguments of Spark's trigger, for example availableNow=True to end when all that is there is done."""
    def merge(docs: DataFrame, batch: int) -> None:
        session = docs.sparkSession
        table = Table(session, target)
        there = bool(table.versions())
        order = Window.partitionBy("doc_id").orderBy(F.desc("_written"), F.desc("_file"), F.desc(F.sha2("text", 256)))
        newest = docs.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "_written", "_file")
        rows = storage.written(changed(newest, table.read() if there else None, provider, dimension), "changed")  # the provider is asked once
        if there:
            table.replace(rows.select("chunk_id"), rows.where("text is not null"))
            table.vacuum(KEPT_VERSIONS)
        else:
            table.create(rows, "chunk_id")

    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_modification_time").alias("_written"), F.col("_metadata.file_path").alias("_file"))
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
