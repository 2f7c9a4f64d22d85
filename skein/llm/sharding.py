"""Operator 10: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows fall into blocks; a matrix drawn on the driver says how many rows of each block go to each shard, so that shard
sizes are exact and every assignment is equally likely. Each block is permuted and cut by its row of the matrix, the
rows are exchanged, and each shard is permuted again. Only DataFrame functions touch the rows.

Defined results: an empty table gives an empty result; null ids and texts are ordinary values (a null text has 0 bytes
and crc32 0); repeated rows are separate rows; further columns are kept; clashing names are avoided.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common

#: Rows of a block or of a part of a shard that one task permutes.
ROWS_PER_BLOCK = 20_000
#: At most so many rows has the matrix (each is 8 bytes a shard); blocks get larger beyond.
MOST_BLOCKS = 16_384


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` rows taken from good + bad are good ones; numpy's own sampler ends below 10**9."""
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), max(0, sample - bad)), min(sample, good))
    sigma = math.sqrt(sample * (good / total) * (bad / total) * max(total - sample, 1) / total)
    reach = int(14 * sigma) + 64
    lo, hi = max(0, sample - bad, mode - reach), min(sample, good, mode + reach)
    up = np.arange(mode, hi, dtype=float)  # weight of k + 1 over weight of k
    ups = np.cumprod((good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1)))
    down = np.arange(mode, lo, -1, dtype=float)  # weight of k - 1 over weight of k
    downs = np.cumprod(down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1)))
    weights = np.concatenate((downs[::-1], [1.0], ups))
    return lo + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right").clip(0, len(weights) - 1))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """counts[b, s]: rows of block b for shard s, drawn from the law of a uniform shuffle; row and column sums are exact."""
    assert sum(block_rows) == sum(shard_rows)
    rng = np.random.default_rng(seed)
    left, out = [int(x) for x in shard_rows], np.zeros((len(block_rows), len(shard_rows)), np.int64)
    for b, rows in enumerate(block_rows):
        need, rest = int(rows), sum(left)
        for s in range(len(left)):
            rest -= left[s]
            out[b, s] = draw_hypergeometric(rng, left[s], rest, need)
            need -= int(out[b, s])
        for s in range(len(left)):
            left[s] -= int(out[b, s])
    return out


def hypergeometric_shards(rows: DataFrame, n_shards: int, seed: int = 42) -> DataFrame:
    """The rows with `shard` (0 to n_shards - 1, sizes at most one apart) and `slot` (0, 1, ... in each shard)."""
    spark, (row, block, place, cuts) = rows.sparkSession, common.fresh(rows, "row", "block", "place", "cuts")
    common.tidy_shuffles(spark)
    tables = common.Tables(spark)
    numbered = tables.write(rows.withColumn(row, F.monotonically_increasing_id()), "shard-rows")
    base, n = numbered, numbered.count()
    n_blocks = min(MOST_BLOCKS, max(64, math.ceil(n / ROWS_PER_BLOCK)))
    base = base.withColumn(block, F.pmod(F.xxhash64(F.lit(seed), row), F.lit(n_blocks)).cast("int"))
    found = {r[0]: r[1] for r in base.groupBy(block).count().collect()}  # at most MOST_BLOCKS rows
    block_rows = [found.get(b, 0) for b in range(n_blocks)]
    shard_rows = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    upto = np.cumsum(communication_matrix(block_rows, shard_rows, seed), axis=1)
    matrix = spark.createDataFrame([(b, [int(x) for x in upto[b]]) for b in range(n_blocks)], f"`{block}` int, `{cuts}` array<bigint>")
    first = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 1), row), row)
    sent = (
        base.withColumn(place, F.row_number().over(first) - 1)
        .join(matrix, block)
        .withColumn("shard", F.size(F.filter(cuts, lambda c: c <= F.col(place))))
        .drop(block, place, cuts)
    )
    # A shard is permuted in parts, so that no task needs to hold a whole shard: parts are dealt by hash and numbered in turn.
    parts = max(1, math.ceil(n / n_shards / ROWS_PER_BLOCK))
    part, before = common.fresh(rows, "part", "before")
    sent = common.written(sent.withColumn(part, F.pmod(F.xxhash64(F.lit(seed + 2), row), F.lit(parts)).cast("int")), "shard-sent")
    tables.drop(numbered)
    sizes = sent.groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", part, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(before))
    second = Window.partitionBy("shard", part).orderBy(F.xxhash64(F.lit(seed + 3), row), row)
    return (
        sent.withColumn("slot", F.row_number().over(second) - 1)
        .join(sizes, ["shard", part])
        .withColumn("slot", F.col("slot") + F.col(before))
        .select(*rows.columns, F.col("shard").cast("int"), F.col("slot").cast("long"))
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    shards = hypergeometric_shards(rows, 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
