"""Operator 6: a linear-chain conditional random field tags toxic spans; its marginals give document scores.

Training. One task fits the field to a bounded sample of documents labelled toxic or not. It gives token labels: a token of a toxic document is toxic if
one of its features (hash of the word or of its first letters) is, over the sample, found in toxic documents almost
only. The field is fitted to these tokens, and the sum of a document's largest marginals is calibrated to its label.

Scoring. Forward-backward recursions over all tokens of a text (many texts at once, step by step) give each token's
probability of being toxic; a text's score is the calibrated sum of the largest ones, and runs of tokens with
a marginal of at least 0.5 are its offending spans (offsets in code points).

Defined results: a null or empty text is scored as one without toxic tokens; without labelled rows, or with no
toxic ones among them, every score is below 1e-20; a document with several labels counts as toxic if one of them is; of
several texts of one labelled id the one with the smallest hash is learned from;
equal texts have equal scores; other columns are kept; an empty table stays empty.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.hashing import LOWER_WORDS, Words

BUCKETS = 1 << 20
#: Of each label so many labelled documents are learned from at most, those with the smallest hash of their id, and of these, in the
#: same order, as many as have SAMPLE_BYTES together, but one at least. Texts are taken whole, long ones too.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 12 << 20
#: A feature tells a toxic token if so large a share of the sample's documents that have it are toxic, and if they are so
#: many that the chance of any feature doing so by luck is below CHANCE, and at least LEAST_PART of the toxic documents
#: (groups of copies of one document make its words look telling).
LEAST_SHARE, CHANCE, LEAST_PART = 0.95, 0.01, 0.025
CHAIN = 64
#: So many marginals of a document count for its score.
LARGEST = 8
#: Features of fewer documents have no weight, so that rare and unseen words look alike to the field.
LEAST_DOCS = 5
PREFIXES = (3, 4, 5, 6)


def token_features(words: Words) -> np.ndarray:
    """Buckets of each word: its own, and those of its first 3, 4, 5 and 6 bytes (of its own if it is shorter)."""
    length = words.end - words.start
    out = np.empty((len(PREFIXES) + 1, len(length)), np.int32)
    out[0] = words.hashes(salt=1) >> np.uint64(44)
    for k, n in enumerate(PREFIXES, 1):
        out[k] = words.hashes(words.start, words.start + np.minimum(length, n), salt=n) >> np.uint64(44)
    return out.T


def _softplus(x):
    return np.logaddexp(0.0, x)


class Field:
    """Two labels; a token's emission is the sum of its features' weights plus a bias, transitions are 2 x 2 scores."""

    def __init__(self, weights: np.ndarray, bias: float, move: np.ndarray, calibration=(-60.0, 0.0)):
        self.weights, self.bias, self.move, self.calibration = weights, bias, move, np.asarray(calibration, float)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.full(len(features), self.bias, np.float64)
        for column in features.T:  # one at a time: memory for one number a token
            out += self.weights[column]
        return out

    def marginals(self, emission: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(toxic) of each token; `counts` has the tokens of each chain."""
        ahead, back = self.messages(emission, counts)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))

    def messages(self, emission: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log ratio of both labels' messages, forwards (with the token's emission) and backwards, one step of all chains
        that are long enough at a time."""
        (m00, m01), (m10, m11) = self.move
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        size = counts[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
        ahead, back = np.empty(len(emission)), np.zeros(len(emission))
        r = np.zeros(len(size))
        for t in range(steps):
            k = active[t]
            at = begin[:k] + t
            r = emission[at] if t == 0 else emission[at] + np.logaddexp(m01, r[:k] + m11) - np.logaddexp(m00, r[:k] + m10)
            ahead[at] = r
        r = np.zeros(0)
        last = begin + size - 1
        for t in range(1, steps):
            k = active[t]  # chains of more than t tokens
            after = last[:k] - t + 1
            x = emission[after] + back[after]
            back[after - 1] = np.logaddexp(m10, x + m11) - np.logaddexp(m00, x + m01)
        return ahead, back

    def neighbours(self, ahead: np.ndarray, emission: np.ndarray, back: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """2 x 2 expected numbers of the labels of a token before `inner` and the one at it."""
        out = np.zeros(4)
        for k in range(0, len(inner), 1 << 16):  # few at a time: four numbers for each
            some = inner[k : k + (1 << 16)]
            one, two = ahead[some - 1], emission[some] + back[some]
            logs = np.stack([self.move[a, b] + a * one + b * two for a in (0, 1) for b in (0, 1)])
            w = np.exp(logs - logs.max(axis=0))
            out += (w / w.sum(axis=0)).sum(axis=1)
        return out.reshape(2, 2)

    def gradient(self, features: np.ndarray, label: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Of the log likelihood of the labels, by weights, bias and moves; and the marginals."""
        emission = self.emissions(features)
        ahead, back = self.messages(emission, counts)
        p = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
        off = label - p
        inner = np.ones(len(label), bool)
        inner[(np.cumsum(counts) - counts)[counts > 0]] = False
        inner = np.flatnonzero(inner)
        seen = np.bincount((2 * label[inner - 1] + label[inner]).astype(np.int8), minlength=4).reshape(2, 2)
        g = np.zeros(len(self.weights))
        for column in features.T:
            g += np.bincount(column, off, minlength=len(self.weights))
        return g, float(off.sum()), seen - self.neighbours(ahead, emission, back, inner), p

    def document_scores(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.calibrated(_sums(p, counts))

    def calibrated(self, total: np.ndarray) -> np.ndarray:
        """P(a document is toxic) from the sum of the squares of its largest marginals."""
        return 1 / (1 + np.exp(-np.clip(_document_features(total) @ self.calibration, -60, 60)))


def _sums(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the squares of the LARGEST largest marginals of each document; small ones would else add up in long texts."""
    ends = np.cumsum(counts).tolist()
    each = (p[b - n : b] ** 2 for n, b in zip(counts.tolist(), ends, strict=True))
    return np.array([float((np.partition(x, -LARGEST)[-LARGEST:] if len(x) > LARGEST else x).sum()) for x in each])


def _document_features(total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log(total + 0.1)], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 25, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    c, weight = np.zeros(x.shape[1]), 1 / len(y)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (y - q)) - l2 * c
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + l2 * np.eye(len(c))
        c = c + np.clip(np.linalg.solve(h, g), -2, 2)
    return c


def _labelled_tokens(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token labels from document labels, by features that toxic documents have almost alone; which features are common."""
    told, common_ones = np.zeros(len(features), bool), np.zeros(BUCKETS, bool)
    for j in range(features.shape[1]):
        pairs = np.unique(features[:, j].astype(np.int64) * len(toxic) + doc)
        bucket, of = pairs // len(toxic), toxic[pairs % len(toxic)]
        both, bad = np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, of, minlength=BUCKETS)
        least = np.log(max(2, (both > 0).sum()) / CHANCE) / np.log(1 / min(max(toxic.mean(), 1e-3), 0.9))
        tells = (bad >= max(least, LEAST_PART * toxic.sum())) & (bad >= LEAST_SHARE * both)
        told |= tells[features[:, j]]
        common_ones |= both >= LEAST_DOCS
    return told & toxic[doc].astype(bool), common_ones


def fit(texts: list[str], toxic: list[int], epochs: int = 20, rate: float = 0.6) -> Field:
    """A field fitted by gradient steps (scaled by the root of past squares) on the log likelihood of token labels."""
    if not any(toxic):
        return Field(np.zeros(BUCKETS, np.float32), -30.0, np.zeros((2, 2)))
    words, y = Words(texts, LOWER_WORDS), np.array(toxic, float)
    features = token_features(words)
    label, common_ones = _labelled_tokens(features, words.doc, y)
    n = len(features)
    share = max(1.0, label.sum()) / max(1, n)
    field = Field(np.zeros(BUCKETS, np.float64), float(np.log(share / (1 - min(share, 0.9)))), np.zeros((2, 2)))
    if not n or not label.any():
        return Field(field.weights, -30.0, field.move)
    # chains of at most CHAIN tokens, none over a text's end
    place = np.arange(n) - (np.cumsum(words.counts) - words.counts)[words.doc]
    cut = np.flatnonzero(place % CHAIN == 0)
    counts = np.diff(np.append(cut, n))
    seen_w, seen_m = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    truth = label.astype(float)
    for _ in range(epochs):
        g, off, gm, p = field.gradient(features, truth, counts)
        g = (g - 1e-3 * field.weights) * common_ones
        seen_w += g * g
        field.weights = field.weights + rate * g / np.sqrt(seen_w)
        field.bias += float(np.clip(off / max(1e-9, (p * (1 - p)).sum()), -1, 1))
        seen_m += gm * gm
        field.move = np.clip(field.move + 0.2 * rate * gm / np.sqrt(seen_m), -4, 4)
    p = field.marginals(field.emissions(features), words.counts)
    calibration = _calibrate(_document_features(_sums(p, words.counts)), y)
    return Field(field.weights.astype(np.float32), field.bias, field.move, calibration)


def sampled(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text, toxic, h, doc_id of at most `rows` documents of each label; the ids are chosen first, so few texts are moved."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.select("doc_id", "toxic", F.xxhash64(F.lit(6), "doc_id").alias("h"))
    parts = [chosen.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(rows) for k in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * rows rows
    found = docs.select("doc_id", F.col(text).alias("text")).where(F.col("text").isNotNull()).join(ids, "doc_id")
    one = found.groupBy("doc_id", "toxic", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    order = Window.partitionBy("toxic").orderBy("h", "doc_id")
    size = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sizes = one.withColumns({"bytes": size, "k": F.row_number().over(order)})
    return sizes.where((F.col("bytes") <= most_bytes) | (F.col("k") == 1)).select("text", "toxic", "h", "doc_id")


def _once(table: pa.Table) -> tuple[list[str], list[int]]:
    """Distinct texts, as copies teach nothing new, in the order of the hashes."""
    once: dict[str, int] = {}
    for r in table.sort_by([("h", "ascending"), ("doc_id", "ascending")]).to_pylist():
        once[r["text"]] = max(r["toxic"], once.get(r["text"], 0))
    return list(once), list(once.values())


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """The sample itself, to look at; training leaves it in Spark."""
    return _once(sampled(docs, labels, text, rows).toArrow())


def _fitted(rows: pa.Table) -> pa.Table:
    return pa.table([pa.array([pickle.dumps(fit(*_once(rows)))], pa.binary())], ["field"])


def score_toxicity(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with score, predicted (1 if score >= 0.5) and spans (array of from, to and mean marginal)."""
    (column,) = common.fresh(docs, "toxicity")
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS numbers

    @F.pandas_udf("struct<score:double,spans:array<struct<from:int,to:int,marginal:double>>>")
    def tag(texts: pd.Series) -> pd.DataFrame:
        scores, spans, texts, field = [], [], texts.tolist(), shared.value
        for a, b in common.batches_of_bytes(texts):
            words = Words(texts[a:b], LOWER_WORDS)
            p = field.marginals(field.emissions(token_features(words)), words.counts)
            scores += field.document_scores(p, words.counts).tolist()
            found = [[] for _ in range(b - a)]
            hit = np.flatnonzero(p >= 0.5)
            for run in np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(words.doc[hit]) > 0)) + 1) if len(hit) else []:
                d = int(words.doc[run[0]])
                origin = int(words.begins[d])
                raw = common.utf8(texts[a + d])
                start, end = int(words.start[run[0]]) - origin, int(words.end[run[-1]]) - origin
                before = len(raw[:start].decode("utf-8", "surrogatepass"))
                found[d].append((before, before + len(raw[start:end].decode("utf-8", "surrogatepass")), float(p[run].mean())))
            spans += found
        return pd.DataFrame({"score": scores, "spans": spans})

    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("score", "predicted", "spans")]
    made = [f"`{column}`.score AS score", f"CAST(`{column}`.score >= 0.5 AS int) AS predicted", f"`{column}`.spans AS spans"]
    return docs.withColumn(column, tag(F.col(text))).selectExpr(*kept, *made)


def held_out():
    return F.coalesce(common.crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    """The field, fitted by one task to at most 2 * SAMPLE_ROWS texts; only the field comes to the driver."""
    common.bound_batches(docs.sparkSession)
    sample = sampled(docs, labels.where(~held_out())).withColumn("all", F.lit(1))
    found = sample.groupBy("all").applyInArrow(_fitted, "field binary").collect()
    return pickle.loads(found[0]["field"]) if found else fit([], [])


def op6(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_toxicity(docs.select("doc_id", "text"), trained(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")
