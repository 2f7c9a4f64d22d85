"""Operator 1: language proportions of each document by expectation-maximisation over n-gram likelihoods.

The model has, for each language, smoothed probabilities of hashed character trigrams, counted over a bounded sample of
labelled rows, by one task a language; only the counts reach the driver. A document is a mixture: expectation-maximisation finds the proportions of the languages that make its
trigrams likeliest. The language set is chosen by penalised likelihood: languages join one by one while the gain in log
likelihood is larger than PENALTY times log(number of trigrams). The largest proportion names the document.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the first language by name;
without labelled rows everything is `und`; equal texts have equal results; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.hashing import mix

BUCKETS = 1 << 15
#: Of each language so many labelled rows are counted at most, those with the smallest hash of their id, and of these, in the same
#: order, as many as have SAMPLE_BYTES together, but one at least. Texts are taken whole, long ones too.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 16 << 20
#: The languages with the most labelled rows are learned, at most so many.
MOST_LANGUAGES = 512
SMOOTHING = 0.1
#: Trigrams overlap, so a third of their number counts; each further language costs this times the log of that.
PENALTY = 3.0
STEPS = 40
_FORMER, _LATTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def trigrams(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of each text's letter trigrams; a run of other characters counts as one space, and so do a
    text's ends. So any text with a letter has a trigram, and a text's trigrams don't depend on the texts around it."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.cumsum([0, *(len(t) + 2 for t in low)])
    known = np.unique(code)
    letter = np.zeros(int(known[-1]) + 1, bool)
    letter[known] = [chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in known.tolist()]
    is_letter = letter[code]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one separator after each run of letters
    keep[begin[:-1][begin[:-1] < len(code)]] = True
    place = np.flatnonzero(keep)
    c = np.where(is_letter[place], code[place], 32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = mix(c[:-2] * _FORMER + c[1:-1]) * _LATTER + c[2:] if len(c) > 2 else np.empty(0, np.uint64)
        bucket = (mix(h) >> np.uint64(49)).astype(np.int64)
    first = np.searchsorted(place, begin)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = np.bincount(bucket[a : max(a, b - 2)], minlength=1)
        ids = np.flatnonzero(n)
        out.append((ids, n[ids].astype(float)))
    return out


def proportions(likelihood: np.ndarray, counts: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages and the log likelihood that expectation-maximisation reaches.
    likelihood: a row for each trigram, scaled so that each row's largest value is 1."""
    part, total = likelihood[:, chosen], counts.sum()
    pi, before = np.full(len(chosen), 1 / len(chosen)), -np.inf
    for _ in range(STEPS):
        mixed = part @ pi
        value = float(counts @ np.log(mixed))
        if value - before < 1e-6 * total:
            break
        before = value
        pi = pi * (part.T @ (counts / mixed)) / total
    return pi, value


def choose(likelihood: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of all languages; 0 for those that the penalised likelihood leaves out."""
    k, pi = likelihood.shape[1], np.zeros(likelihood.shape[1])
    alone = counts @ np.log(likelihood)
    chosen, value, share = [int(alone.argmax())], float(alone.max()), np.ones(1)
    cost = penalty * 3 * np.log(max(2.0, counts.sum() / 3))
    if k > 1 and proportions(likelihood, counts, list(range(k)))[1] - value > cost:  # else no set can gain enough
        while len(chosen) < k:
            tries = [(proportions(likelihood, counts, [*chosen, j]), j) for j in range(k) if j not in chosen]
            (pis, best), j = max(tries, key=lambda t: (t[0][1], -t[1]))
            if best - value <= cost:
                break
            chosen, value, share = [*chosen, j], best, pis
    pi[chosen] = share
    return pi


class Model:
    """Languages by name and, for each bucket, the likelihood of its trigrams under each language, scaled to at most 1."""

    def __init__(self, labelled: list[tuple[str, str]] = (), counted: dict[str, np.ndarray] | None = None):
        """From labelled texts, or from the counts of each language's trigrams."""
        if counted is None:
            counted = {name: bucket_counts([t for lang, t in labelled if lang == name]) for name in {lang for lang, _ in labelled}}
        self.names = sorted(counted)
        counts = np.full((BUCKETS, max(1, len(self.names))), SMOOTHING)
        for j, name in enumerate(self.names):
            counts[:, j] += counted[name]
        p = counts / counts.sum(axis=0)
        self.likelihood = np.maximum(p / p.max(axis=1, keepdims=True), 1e-4)

    def predict(self, texts) -> list[tuple[str, float, list[float]]]:
        out = []
        for ids, n in trigrams(texts):
            if not self.names or not len(ids):
                out.append(("und", 0.0, [0.0] * len(self.names)))
                continue
            pi = choose(self.likelihood[ids], n)
            j = int(pi.argmax())
            out.append((self.names[j], float(min(1.0, pi[j])), pi.tolist()))
        return out


def sampled(docs: DataFrame, text: str, lang: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text: the labelled texts that are learned from.

    A histogram of the hashes, finer towards small ones, tells how far each language's rows are needed, so the window that
    ranks them gets little more than `rows` of each language, whatever the table's size, and no language loses any."""
    from pyspark.sql import Window

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    h = F.xxhash64(F.lit(5), F.coalesce(F.col("doc_id").cast("string"), F.col(text)))
    known = known.select("doc_id", F.col(lang).alias("lang"), h.alias("h"), F.col(text).alias("text"))
    known = known.withColumn("step", F.floor(4 * F.log2(F.col("h").cast("double") + F.lit(2.0**63 + 1))))
    steps = known.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("step")) - F.col("n")
    last = steps.select("lang", "step", "n", before.alias("before")).groupBy("lang")
    last = last.agg(F.max(F.when(F.col("before") < rows, F.col("step"))).alias("last"), F.sum("n").alias("n"))
    last = last.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang", "last")
    thin = known.join(F.broadcast(last), "lang").where(F.col("step") <= F.col("last"))  # MOST_LANGUAGES rows at most
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    ranked = thin.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    sizes = ranked.withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sizes.where((F.col("bytes") <= most_bytes) | (F.col("k") == 1)).select("lang", "text")


def labelled_sample(docs: DataFrame, text: str, lang: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """The sample itself, to look at; training leaves it in Spark."""
    return [(r["lang"], r["text"]) for r in sampled(docs, text, lang, rows, most_bytes).collect()]


def bucket_counts(texts: list[str]) -> np.ndarray:
    """How often the trigrams of each bucket occur."""
    counts = np.zeros(BUCKETS)
    for a, b in common.batches_of_bytes(texts):
        for ids, n in trigrams(texts[a:b]):
            counts[ids] += n
    return counts


def _counted(rows: pa.Table) -> pa.Table:
    counts = bucket_counts(rows["text"].to_pylist())
    return pa.table([rows["lang"].slice(0, 1), pa.array([counts.tolist()])], ["lang", "counts"])


def identify_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (its proportion) and proportions (of the model's languages, by name)."""
    (column,) = common.fresh(docs, "language")
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    @F.pandas_udf("struct<lang_pred:string,score:double,proportions:array<double>>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows, texts = [], texts.tolist()
        for a, b in common.batches_of_bytes(texts):
            rows += shared.value.predict(texts[a:b])
        return pd.DataFrame(rows, columns=["lang_pred", "score", "proportions"])

    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("lang_pred", "score", "proportions")]
    return docs.withColumn(column, predict(F.col(text))).selectExpr(*kept, f"`{column}`.*")


def held_out():
    return F.coalesce(common.crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))


def trained(docs: DataFrame) -> Model:
    """The model of the labelled rows that aren't held out; at most MOST_LANGUAGES times BUCKETS numbers come to the driver."""
    common.bound_batches(docs.sparkSession)
    counted = sampled(docs.where(~held_out()), "text", "lang").groupBy("lang").applyInArrow(_counted, "lang string, counts array<double>").toArrow()
    return Model(counted={k: np.array(v.as_py()) for k, v in zip(counted["lang"].to_pylist(), counted["counts"], strict=True)})


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "proportions")
