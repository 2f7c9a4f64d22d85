"""Operator 5: mixes sources to target weights by Poisson replication.

Each source has a mean repetition rate (its share of the wanted rows over its rows). A document's number of copies is
the inverse of the Poisson distribution with that mean at a uniform number that a hash of seed, doc_id, text and a number
among equal rows gives; the row is exploded by that number, and the copies are put in the order of a second hash, a global shuffle: the hash is
uniform, so equal ranges of it are the partitions, and no sampling draws the copies twice. A mean above
MOST_MEAN is split into equal parts that are drawn one by one and added, which gives the same law with short tables.

Rows that are equal in all columns are told apart by numbers from 0, so each has a draw of its own. A count of hashes of
rows finds those that occur more than once; one row of each such group is spread by its numbers, in blocks that are dealt to
tasks before they are spread, so a group that holds a third of all rows is no one task's work.

Defined results: null sources are a source of their own; a null doc_id hashes as the word null, a null text as an empty one; rows
of one doc_id have draws of their own unless id and text are equal and another column isn't; sources without a weight (or of
weight 0) vanish; an empty table stays empty; other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

MOST_MEAN = 8.0
#: Entries of a cumulative table; a Poisson number of mean 8 exceeds it with probability below 1e-30.
STEPS = 60
#: Rates of up to so many sources are broadcast (some 500 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 4096
SEED = 20
#: Equal rows of a block.
BLOCK = 10_000
#: Rows of a partition of the result, on average, if there are more than spark.sql.shuffle.partitions of them.
PART_ROWS = 200_000


def uniform(*parts):
    """A number in [0, 1) from the first 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(mean):
    """P(X <= k), k = 0, 1, ..., STEPS - 1, of the Poisson distribution, as an array."""
    def step(acc, k):
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), first, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, rows: float | None = None) -> DataFrame:
    """source, its rows n, mean rate; by default weights go with the square root of a source's rows and as many rows as there are."""
    spark = docs.sparkSession
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.sqrt("n"))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        counts = counts.alias("c").join(given.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "n", "w")
    sums = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    wanted = float(rows) if rows is not None else sums["n"] or 0.0
    rate = F.col("w") / F.lit(sums["w"] or 1.0) * F.lit(wanted) / F.col("n")
    return counts.where(F.col("w") > 0).select("source", "n", rate.alias("rate"))


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs with a number among equal rows. Only rows that have an equal one move."""
    one, two, times, block = common.fresh(docs, "hash_one", "hash_two", "times", "block")
    keyed = docs.select("*", F.xxhash64(F.lit(1), *docs.columns).alias(one), F.xxhash64(F.lit(2), *docs.columns).alias(two))
    counts = keyed.groupBy(one, two).agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1)
    counts = common.written(counts, "repeated")
    if counts.isEmpty():
        return docs.withColumn(number, F.lit(0).cast("long"))
    once = keyed.join(counts.select(one, two), [one, two], "left_anti").drop(one, two).withColumn(number, F.lit(0).cast("long"))
    every = keyed.join(counts.select(one, two), [one, two], "left_semi").select(one, two, F.struct(*docs.columns).alias("row"))
    kept = every.groupBy(one, two).agg(F.any_value("row").alias("row")).join(counts, [one, two])
    blocks = kept.select("row", one, times, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(BLOCK).cast("long"))).alias(block))
    dealt = blocks.repartition(F.col(one), F.col(block))
    last = F.least(F.col(times), F.col(block) + BLOCK) - 1
    return once.unionByName(dealt.select("row.*", F.explode(F.sequence(F.col(block), last)).alias(number)))


def poisson_mixture(
    docs: DataFrame, weights: dict[str | None, float] | None = None, rows: float | None = None, seed: int = SEED
) -> DataFrame:
    """The rows of docs with `replica` (0, 1, ...) and `shuffle_key`, in the order of that key."""
    copies, table, pieces, name, number, given = common.fresh(docs, "copies", "cumulative", "pieces", "name", "number", "given_source")
    spark = docs.sparkSession
    common.tidy_shuffles(spark)
    rates = common.written(source_rates(docs, weights, rows), "rates")
    expected = rates.agg(F.sum(F.col("n") * F.col("rate")).alias("x")).first()["x"] or 0.0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(expected / PART_ROWS))
    rates = rates.withColumn(pieces, F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int"))
    rates = rates.withColumn(table, cumulative(F.col("rate") / F.col(pieces))).select(F.col("source").alias(given), pieces, table)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(pieces)),
        F.lit(0),
        lambda acc, k: acc + F.size(F.filter(table, lambda c: c <= uniform(F.lit(str(seed)), F.col(name), k.cast("string")))),
    )
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest, F.col(number).cast("string"))
    return (
        numbered(docs, number)
        .withColumn(name, named)
        .join(rates, F.col("source").eqNullSafe(F.col(given)))
        .withColumn(copies, drawn)
        .where(F.col(copies) > 0)
        .withColumn("replica", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col(name), F.col("replica").cast("string"))))
        .select(*docs.columns, "replica", "shuffle_key")
        .repartitionById(parts, F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("int"))
        .sortWithinPartitions("shuffle_key")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return poisson_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE counts AS (SELECT source, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
pieces AS (SELECT source, rate, greatest(ceil(rate / {MOST_MEAN}), 1)::INT AS pieces FROM rates),
poisson AS (
  SELECT source, pieces, rate / pieces AS mean, 0 AS k, exp(-(rate / pieces)) AS p, exp(-(rate / pieces)) AS c FROM pieces
  UNION ALL
  SELECT source, pieces, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM poisson WHERE k + 1 < {STEPS}),
tables AS (SELECT source, any_value(pieces) AS pieces, list(c) AS cs FROM poisson GROUP BY source),
named AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' ||
    (row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1) AS name FROM documents),
draws AS (
  SELECT d.*, (SELECT sum(len(list_filter(t.cs, lambda x: x <= ('0x' || substr(md5('{SEED}:' || d.name || ':' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))
               FROM range(1, t.pieces + 1) r(k)) AS copies
  FROM named d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, replica::INT AS replica, md5('{SEED}-order:' || name || ':' || replica) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies::INT)) AS replica FROM draws WHERE copies > 0)
"""
