"""Lexical matching of terms that are spelt differently.

The Ratcliff-Obershelp likeness of two words is twice the number of characters in matching blocks over the sum of lengths, so words
that reach a threshold share as many characters, counted with repeats. That bounds the lengths, and it makes an index: a
word's characters, numbered among equal ones, are put in one order for all words, rare ones first; words that share o of
them share at least k of the first l - o + k (l: its length). Words meet if they have an equal combination of k such
characters, and are then compared.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx


def ratio(term: str, token: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp likeness; 0 if the lengths differ by more than a third of the term's (at least 2), or rule out `least`."""
    if abs(len(term) - len(token)) > max(2, len(term) // 3) or 2 * min(len(term), len(token)) < least * (len(term) + len(token)):
        return 0.0
    return difflib.SequenceMatcher(None, term, token).ratio()


def most_alike(terms: pd.Series, tokens: pd.Series) -> np.ndarray:
    """A bound on each pair's likeness: by the characters that both have, counted with repeats (in 64 classes, of one character each for a
    to z and 0 to 9)."""
    codes, words = pd.factorize(pd.concat((terms, tokens), ignore_index=True))
    length = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % 64
    counts = np.zeros((len(words), 64), np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(words)), length), chars), 1)
    a, b = codes[: len(terms)], codes[len(terms) :]
    return 2.0 * np.minimum(counts[a], counts[b]).sum(axis=1) / np.maximum(length[a] + length[b], 1)


#: Characters from frequent to rare.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz0123456789"
#: Words of up to LONG characters meet by combinations of THREE characters, longer ones by single ones.
LONG, THREE = 32, 3


def least_shared(length: int, threshold: float) -> int:
    """Characters that a word of this length shares at least with any word that reaches the threshold."""
    shortest = math.ceil(length * threshold / (2 - threshold) - 1e-9)
    return math.ceil(threshold / 2 * (length + shortest) - 1e-9)


def meeting_keys(word: str, threshold: float) -> list[str]:
    """Keys of which two words that reach the threshold have one in common."""
    seen: Counter = Counter()
    numbered = []
    for c in word:
        seen[c] += 1
        numbered.append((-seen[c], -_FREQUENT.find(c), c))
    order = [f"{c}{-n}" for n, _, c in sorted(numbered)]
    shared = least_shared(len(word), threshold)
    spare, out = len(word) - shared, []
    if len(word) <= LONG:
        out += ["+".join(x) for x in combinations(order[: spare + THREE], THREE)]
    if shared < THREE or len(word) >= least_shared(LONG, threshold):  # there may be words that share fewer, or longer ones
        out += [f"{x}*" for x in order[: spare + 1]]
    return out


def likely_pairs(terms: DataFrame, tokens: DataFrame, threshold: float = 0.86) -> DataFrame:
    """term, token, likeness of all pairs of terms (term) and tokens (token) whose likeness reaches the threshold; both distinct."""
    keys = F.pandas_udf(lambda words: pd.Series([meeting_keys(w, threshold) for w in words], dtype=object), "array<string>")
    left = terms.select("term", F.length("term").alias("n"), F.explode(keys("term")).alias("key"))
    right = tokens.select("token", F.length("token").alias("m"), F.explode(keys("token")).alias("key"))
    alike = (2 * F.least("n", "m") >= threshold * (F.col("n") + F.col("m"))) & (F.abs(F.col("n") - F.col("m")) <= F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    met = left.join(right, "key").where(alike).select("term", "token").distinct()

    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        worth = most_alike(a, b) >= threshold - 1e-9
        return pd.Series([ratio(x, y, threshold) if w else 0.0 for x, y, w in zip(a, b, worth.tolist(), strict=True)], dtype=float)

    compared = met.select("term", "token", F.explode(F.array(F.pandas_udf(compare, "double")("term", "token"))).alias("likeness"))
    return compared.where(F.col("likeness") >= threshold)


def fuzzy_candidates(chunks: DataFrame, terms: list[str], taken: DataFrame, k: int = 8, scan: int | None = 200, first_tokens: int | None = 160) -> DataFrame:
    """chunk_id, matched_terms, fuzzy_score, fuzzy_rank of the k best chunks that aren't taken, of the first `scan` by chunk_index
    (None: of all), by their first tokens (None: by all)."""
    if not terms:
        return chunks.select("chunk_id", F.lit(0).alias("matched_terms"), F.lit(0.0).alias("fuzzy_score"), F.lit(0).alias("fuzzy_rank")).limit(0)
    rest = chunks.select("chunk_id", "chunk_index", "text").join(taken.select("chunk_id"), "chunk_id", "left_anti")
    rest = rest.orderBy("chunk_index", "chunk_id").limit(scan) if scan is not None else rest
    found = fuzzy_scores(rest, terms, first_tokens=first_tokens).join(rest.select("chunk_id", "chunk_index"), "chunk_id")
    order = [F.desc("fuzzy_score"), F.desc("matched_terms"), F.col("chunk_index"), F.col("chunk_id")]
    best = found.orderBy(*order).limit(k).withColumn("fuzzy_rank", F.row_number().over(Window.orderBy(*order)))
    return best.select("chunk_id", "matched_terms", "fuzzy_score", "fuzzy_rank")


def fuzzy_scores(chunks: DataFrame, terms: list[str], threshold: float = 0.86, first_tokens: int | None = None) -> DataFrame:
    """chunk_id, matched_terms, fuzzy_score: the mean over all terms of the best likeness that reaches the threshold.

    Likeness is computed once for each distinct token of all chunks that meets a term; only tokens that match go back to their chunks."""
    words = tx.tokens(F.col("text"))
    words = F.slice(words, 1, first_tokens) if first_tokens else words
    tokens = chunks.select("chunk_id", F.explode(F.array_distinct(words)).alias("token"))
    asked = chunks.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(terms)], "term string")
    near = likely_pairs(asked, tokens.select("token").distinct(), threshold)
    best = tokens.join(near, "token").groupBy("chunk_id", "term").agg(F.max("likeness").alias("best"))
    return best.groupBy("chunk_id").agg(F.count(F.lit(1)).cast("int").alias("matched_terms"), F.round(F.sum("best") / len(terms), 6).alias("fuzzy_score"))
