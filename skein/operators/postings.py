"""A positional inverted index, and searching it for many questions at once.

The index is a table of postings (term, chunk_id, positions) under a folder, partitioned by a hash of the term. Positions are
sorted, and Parquet's second writer version stores them, like the ids, as differences. A term that fills more than one file's worth is
split over several files of its partition, by Spark's rebalancing on write. A search reads the partitions of the terms it is after.
A chunk's words are put together where its text is read, so that a posting moves once; only those of repeated chunk_ids meet again.

Defined results: a null or empty text has no postings; a chunk_id that occurs twice is one chunk whose postings are those of all its
rows together; a question without terms finds nothing; ties go to the smaller chunk_id.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import storage
from skein.functions import french
from skein.functions import signals as sg
from skein.functions import text as tx
from skein.operators import retrieval
from skein.plans import search_plan

PARTITIONS = 64
#: Bytes of questions' vectors that go to all executors at once; more questions take several scans.
VECTOR_BYTES = 16 << 20
#: Bytes of texts whose words a task lists at once; a longer text is taken whole.
CHARS = 2 << 20
#: Questions and vectors that meet at once.
BLOCK, ROWS = 512, 2048


def configuration(name: str | None) -> str:
    """french or simple; anything else falls back to simple."""
    return name if name in ("french", "simple") else "simple"


def terms_of(c: Column, config: str) -> Column:
    """The words of a text in their order; null where one isn't indexed."""
    return french.stems(french.words(c)) if configuration(config) == "french" else tx.tokens(c)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTITIONS)).cast("int")


class Index:
    """postings (bucket, term, chunk_id, positions) and document frequencies (term, df)."""

    def __init__(self, spark: SparkSession, path: str):
        self.config = configuration(path.rsplit("-", 1)[-1])
        self.postings = spark.read.parquet(f"{path}/postings")
        self.terms = spark.read.parquet(f"{path}/terms")


def build(chunks: DataFrame, path: str | None = None, config: str = "simple") -> Index:
    """Writes the index of chunks (chunk_id, text) and opens it."""
    spark = chunks.sparkSession
    path = f"{path or storage.new_path(spark, 'postings')}-{configuration(config)}"
    ids = storage.written(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"), "repeated")
    packed = _packed(chunks, configuration(config))
    if ids.isEmpty():
        placed = packed.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket").select("bucket", "term", _unpacked())
    else:
        lists = packed.select("term", _unpacked())
        again = lists.join(ids, "chunk_id").groupBy("term", "chunk_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        lists = lists.join(ids, "chunk_id", "left_anti").unionByName(again)
        placed = lists.select(bucket(F.col("term")).alias("bucket"), "term", "chunk_id", "positions").hint("rebalance", "bucket")
    out = placed.sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").option("parquet.writer.version", "PARQUET_2_0")
    out.parquet(f"{path}/postings")
    counted = spark.read.schema("term string, bucket int").parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted.write.parquet(f"{path}/terms")
    return Index(spark, path)


def _unpacked() -> Column:
    """chunk_id, positions of packed rows."""
    one = lambda c, i: F.struct(c.alias("chunk_id"), F.slice("places", F.get("starts", i) + 1, F.get("starts", i + 1) - F.get("starts", i)).alias("positions"))
    return F.inline(F.transform("ids", one))


def _packed(chunks: DataFrame, config: str) -> DataFrame:
    """term, ids (of chunks), starts, places of chunks (chunk_id, text), a row for each term of some texts together: what moves. The positions in
    chunk ids[i] are places[starts[i]] to places[starts[i + 1] - 1]."""
    french_ = config == "french"
    find = re.compile(french.WORD if french_ else tx.TOKEN).findall

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("chunk_id"), batch.column("text")
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, CHARS)), len(texts)))
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                if b > a:
                    yield listed(ids.slice(a, b - a), texts.slice(a, b - a).to_pylist())

    def listed(ids, texts: list) -> pa.RecordBatch:
        words = [find(t) if t else [] for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        coded = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row, place = np.repeat(np.arange(len(size)), size), np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        if french_:  # words with an equal stem are one term, stop words none
            stems = pa.array([french.indexed(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
            terms, of = stems.dictionary, pa.compute.fill_null(stems.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = of[code]
            row, place, code = row[code >= 0], place[code >= 0], code[code >= 0]
        key = code * max(1, len(texts)) + row
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))  # of each posting in `order`
        of = code[order[first]]
        begin = np.flatnonzero(np.diff(of, prepend=-1))  # of each term among the postings
        end, start = np.append(begin, len(first)), np.append(first, len(order))
        size = np.diff(end)
        inner = np.repeat(start[begin], size + 1)
        starts = start[np.arange(len(first) + len(begin)) - np.repeat(np.arange(len(begin)), size + 1)] - inner
        as_list = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
        columns = [
            terms.take(pa.array(of[begin])), as_list(end, ids.take(pa.array(row[order[first]]))),
            as_list(end + np.arange(len(end)), pa.array(starts.astype(np.int32))), as_list(start[end], pa.array(place[order].astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "ids", "starts", "places"])

    text = F.lower("text") if french_ else tx.fold(F.col("text"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", text.alias("text")).mapInArrow(run, f"term string, ids array<{kind}>, starts array<int>, places array<int>")


def wanted_terms(questions: DataFrame, config: str = "simple", expand: bool = True) -> DataFrame:
    """question_id, term, groups (numbers of the groups that the term stands in), base (whether it is one of the question's own words),
    n_groups, of questions (question_id, text)."""
    stemmed = configuration(config) == "french"

    def plan(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            p = search_plan.plan(t or "", expand)
            groups = [[french.stem(x) for x in g] if stemmed else g for g in p.groups]
            base = {french.stem(x) if stemmed else x for x in p.base}
            each = sorted({x for g in groups for x in g} | base)
            out.append([(x, [k for k, g in enumerate(groups) if x in g], x in base, len(groups)) for x in each])
        return pd.Series(out, dtype=object)

    planned = F.pandas_udf(plan, "array<struct<term:string,groups:array<int>,base:boolean,n_groups:int>>")
    return questions.select("question_id", F.inline(planned(F.col("text"))))


def lexical_many(index: Index, wanted: DataFrame, k: int = 20) -> DataFrame:
    """question_id, chunk_id, base_score, lexical_score, rank of the k best chunks with a term of every group of each question.

    Chunks are looked for by each question's rarest group, and only they ask for the positions of the other terms; so a
    frequent term's postings move once, not once for each question."""
    wanted = storage.written(wanted, "wanted")
    terms = wanted.select("term", bucket(F.col("term")).alias("bucket")).distinct().where(F.length("term") > 0)
    postings = index.postings.join(terms, ["bucket", "term"]).drop("bucket")
    groups = wanted.select("question_id", "term", F.explode("groups").alias("g")).join(index.terms, "term", "left")
    sizes = groups.groupBy("question_id", "g").agg(F.sum(F.coalesce("df", F.lit(0))).alias("df"))
    rarest = sizes.groupBy("question_id").agg(F.min(F.struct("df", "g")).alias("x")).where("x.df > 0").select("question_id", F.col("x.g").alias("g"))
    entry = groups.join(rarest, ["question_id", "g"]).select("question_id", "term")
    found = postings.select("term", "chunk_id").join(entry, "term").select("question_id", "chunk_id").distinct()
    asked = found.join(wanted, "question_id")
    hits = asked.join(postings, ["term", "chunk_id"])
    each = hits.groupBy("question_id", "chunk_id", "n_groups").agg(F.collect_list(F.struct("groups", "base", "positions")).alias("terms"))
    reached = F.size(F.array_distinct(F.flatten(F.col("terms.groups"))))
    places = F.flatten(F.transform("terms", lambda t: F.transform(t["positions"], lambda p: F.struct(p.alias("position"), t["groups"].alias("groups")))))
    own = F.aggregate("terms", F.lit(0), lambda n, t: n + F.when(t["base"], F.size(t["positions"])).otherwise(0))
    of_groups = F.filter(places, lambda x: F.size(x["groups"]) > 0)
    scored = each.where(reached == F.col("n_groups")).select(
        "question_id", "chunk_id", F.round(own * retrieval.POSITION_WEIGHT, 6).alias("base_score"),
        F.round(retrieval.cover_density(F.sort_array(of_groups), F.col("n_groups")), 6).alias("lexical_score"),
    )
    return retrieval.best_per_key(scored, "question_id", [F.desc("base_score"), F.desc("lexical_score"), F.col("chunk_id")], k)


def vector_many(embeddings: DataFrame, questions: DataFrame, k: int = 20, digits: int = 6) -> DataFrame:
    """question_id, chunk_id, similarity, rank of the k nearest of embeddings (chunk_id, embedding) for each of questions (question_id,
    embedding), all of one length, with similarities of so many digits. A task keeps k rows of each question over all its batches, before anything is shuffled."""
    known = questions.where(F.col("embedding").isNotNull()).select("question_id", F.col("embedding").cast("array<double>").alias("embedding"))
    known = storage.written(known, "questions")
    size = known.agg(F.sum(F.size("embedding") * F.lit(8)).alias("bytes")).first()["bytes"] or 0
    slices = max(1, -(-int(size) // VECTOR_BYTES))
    parts = [_nearest(embeddings, known.where(F.pmod(F.xxhash64("question_id"), F.lit(slices)) == i), k, digits) for i in range(slices)]
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    return retrieval.best_per_key(near, "question_id", [F.desc("similarity"), F.col("chunk_id")], k)


def _nearest(embeddings: DataFrame, questions: DataFrame, k: int, digits: int) -> DataFrame:
    table = questions.toArrow()  # at most VECTOR_BYTES of vectors, on average
    ids = table["question_id"].to_numpy()
    q = _unit(_rows(table["embedding"].combine_chunks()))

    def search(batches):
        held, kth = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)  # a question's rows so far, and its k-th score once it has k
        scores, chunks = np.empty((len(ids), k)), None
        for batch in batches:
            chunk = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            chunks = np.empty((len(ids), k), chunk.dtype) if chunks is None else chunks
            for at in range(0, len(chunk), ROWS):
                x, own = _unit(_rows(batch.column("embedding").slice(at, ROWS))), chunk[at : at + ROWS]
                for a in range(0, len(ids), BLOCK):
                    s = np.round(q[a : a + BLOCK] @ x.T, digits)
                    better = ~(s < kth[a : a + BLOCK, None])
                    for i in np.flatnonzero(better.any(axis=1)).tolist():
                        j, n = np.flatnonzero(better[i]), held[a + i]
                        if len(j) > 4 * k:  # all that tie with the k-th stay for the moment
                            j = j[s[i, j] >= -np.partition(-s[i, j], k - 1)[k - 1]]
                        c, v = np.concatenate((chunks[a + i, :n], own[j])), np.concatenate((scores[a + i, :n], s[i, j]))
                        order = np.lexsort((c, -v))[:k]
                        n = held[a + i] = len(order)
                        chunks[a + i, :n], scores[a + i, :n] = c[order], v[order]
                        kth[a + i] = scores[a + i, k - 1] if n == k else -np.inf
        for a in range(0, len(ids), ROWS):
            some = np.arange(k) < held[a : a + ROWS, None]
            if some.any():
                columns = [np.repeat(ids[a : a + ROWS], held[a : a + ROWS]), chunks[a : a + ROWS][some], scores[a : a + ROWS][some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["question_id", "chunk_id", "similarity"])

    kind = embeddings.schema["chunk_id"].dataType.simpleString()
    rows = embeddings.where(F.size("embedding") == (q.shape[1] if len(q) else -1)).select("chunk_id", "embedding")
    return rows.mapInArrow(search, f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id {kind}, similarity double")


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def hybrid_many(index: Index, embeddings: DataFrame, questions: DataFrame, k: int = 5, candidates: int = 20, expand: bool = True) -> DataFrame:
    """question_id, chunk_id, both ranks, hybrid_score and final_rank of the k best by reciprocal ranks for every question (question_id,
    text, embedding); either side may be missing."""
    lexical = lexical_many(index, wanted_terms(questions.select("question_id", "text"), index.config, expand), candidates)
    vector = vector_many(embeddings, questions.select("question_id", "embedding"), candidates)
    return fused_many(vector.withColumnRenamed("rank", "vector_rank"), lexical.withColumnRenamed("rank", "lexical_rank"), k)


def reranked_many(fused: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = 5, expand: bool = True) -> DataFrame:
    """The k best of fused candidates (question_id, chunk_id, hybrid_score, both ranks) by their scores and the signals of their texts
    for each question, with rerank_score, final_score and position. chunks: chunk_id, text; questions: question_id, text."""

    def plan(texts: pd.Series) -> pd.DataFrame:
        plans = [search_plan.plan(t or "", expand) for t in texts]
        asked = [sorted({*p.intents, *(["time"] if "date" in p.intents else [])}) for p in plans]
        return pd.DataFrame({"base": [p.base for p in plans], "concept": [p.concept for p in plans], "asked": asked})

    planned = F.pandas_udf(plan, "struct<base:array<string>,concept:string,asked:array<string>>")
    wanted = storage.written(questions.select("question_id", planned(F.col("text")).alias("plan")), "plans")
    rows = fused.join(wanted, "question_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    signals = sg.signals_for(F.col("text"), F.col("plan.base"), F.col("plan.concept"), F.col("plan.asked"), full=False)
    rows = rows.withColumn("rerank_score", sg.score(signals)).withColumn("final_score", F.round(F.col("hybrid_score") + F.col("rerank_score"), 9))
    order = [F.desc("final_score"), F.desc("hybrid_score"), F.coalesce("lexical_rank", F.lit(10**6)), F.coalesce("vector_rank", F.lit(10**6)), F.col("chunk_id")]
    return retrieval.best_per_key(rows.drop("plan", "text"), "question_id", order, k, "position")


def fused_many(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(retrieval.RRF_CONSTANT) + F.col(c)), F.lit(0.0))
    both = vector.join(lexical, ["question_id", "chunk_id"], "full_outer")
    both = both.withColumn("hybrid_score", F.round(part("vector_rank") + part("lexical_rank"), 9))
    order = [F.desc("hybrid_score"), F.coalesce("lexical_rank", F.lit(10**6)), F.coalesce("vector_rank", F.lit(10**6)), F.col("chunk_id")]
    return retrieval.best_per_key(both, "question_id", order, k, "final_rank")


def search_report(questions: DataFrame, fused: DataFrame, results: DataFrame, k: int = 5, candidates: int = 20) -> DataFrame:
    """What is said of each question's search beside its results: how many chunks each side found, how many both and either did, how
    many are returned, the best score, and the limits; zeros for a question that found nothing."""
    found = fused.groupBy("question_id").agg(
        F.count("vector_rank").cast("int").alias("vector_candidates"), F.count("lexical_rank").cast("int").alias("lexical_candidates"),
        F.count_if(F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull()).cast("int").alias("in_both"), F.count(F.lit(1)).cast("int").alias("candidates"),
    )
    shown = results.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("returned"), F.max("final_score").alias("best_score"))
    rows = questions.select("question_id").join(found, "question_id", "left").join(shown, "question_id", "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("vector_candidates", "lexical_candidates", "in_both", "candidates", "returned")]
    return rows.select("question_id", *numbers, "best_score", F.lit(k).alias("top_k"), F.lit(candidates).alias("candidate_limit"))
