"""Operator 3: packs documents into sequences of fixed size by sum-of-squares packing.

Documents are tokenised where they lie; longer ones are cut into full pieces and a first piece that may be shorter. A
full piece is a sequence of its own. Shorter ones are dealt by hash into groups of some ROWS_PER_GROUP; within a group
they are placed, longest first, where the sum of the squared counts of open sequences per residual gap becomes
smallest, and a new sequence is opened only if no open one has room. Groups are even whatever the documents are, and
in each at most one sequence is less than half full.

Defined results: a null or empty text has only the end id; repeated rows and doc_ids are separate documents; a null
doc_id is kept; the result has the same columns whatever further columns there are; an empty table stays empty.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

CAPACITY = 1024
END_ID = 2
ROWS_PER_GROUP = 8192


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. With n(g) open bins of gap g, a length s moves a bin from g to g - s and changes
    the sum of squares by 2 (n(g - s) - n(g)) + 2, or by 1 - 2 n(s) if it fills the bin."""
    lengths = np.asarray(lengths, np.int64)
    n, open_bins, used = np.zeros(capacity, np.int64), [[] for _ in range(capacity)], 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        here = n[s:]
        change = np.where(here > 0, 2 * (n[: capacity - s] - here) + 2, 1 << 60)
        if s < capacity and here[0]:
            change[0] = 1 - 2 * here[0]
        best = int(change.argmin()) if s < capacity else 0
        if s < capacity and here[best]:
            gap = s + best
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            n[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def pieces_of(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    @F.pandas_udf("struct<n:bigint,crcs:array<bigint>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        ns, crcs, tok = [], [], common.tokenizer(tokenizer_path)
        for a, b in common.batches_of_bytes(texts.tolist()):
            for ids in tok.ids(texts.iloc[a:b]):
                ids = np.append(ids, end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                ns.append(len(ids))
                crcs.append([zlib.crc32(ids[max(0, k - capacity) : k]) for k in range(first, len(ids) + 1, capacity)])
        return pd.DataFrame({"n": ns, "crcs": crcs})

    common.bound_batches(docs.sparkSession)
    first = (F.col("c.n") - 1) % capacity + 1
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * capacity)
    length = F.when(F.col("piece") == 0, F.col("first")).otherwise(capacity)
    return (
        docs.select("doc_id", cut(F.col(text)).alias("c"))
        .select("doc_id", first.alias("first"), F.posexplode("c.crcs").alias("piece", "ids_crc32"))
        .select("doc_id", "piece", start.cast("long").alias("start"), length.cast("long").alias("length"), "ids_crc32")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a `length` of at most capacity, and for each its sequence_id and offset."""
    group, row = common.fresh(pieces, "group", "row")
    common.tidy_shuffles(pieces.sparkSession)
    pieces = common.written(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    short, full = pieces.where(F.col("length") < capacity), pieces.where(F.col("length") >= capacity)
    groups = max(1, math.ceil(short.count() / ROWS_PER_GROUP))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(table: pa.Table) -> pa.Table:
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        names = (table[group].to_numpy().astype(np.int64) << 32) | bins
        return table.drop_columns([group]).append_column("sequence_id", pa.array(names)).append_column("offset", pa.array(offsets))

    placed = short.withColumn(group, F.pmod(F.xxhash64(row), F.lit(groups)).cast("int")).groupBy(group).applyInArrow(place, schema)
    alone = full.withColumns({"sequence_id": -1 - F.col(row), "offset": F.lit(0).cast("long")})
    return placed.unionByName(alone).drop(row)


def best_fit_pack(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces_of(docs, tokenizer_path, text))


def op3(spark, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), common.byte_bpe())
