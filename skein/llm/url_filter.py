"""Operator 2: judges urls by rules and, where none fits, by logistic regression on hashed character n-grams.

Host and path come from the url by SQL functions; the rule that fits and has the longest text decides, else the
probability of the model, which is trained on the driver from a small labelled table (url_table).

Defined results: a null url, or one without ://, has an empty host and path and is judged by the model (which allows
it); equal urls are judged alike; further columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import common
from skein.llm.hashing import mix
from skein.llm.url_table import OTHERS, UNWANTED

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
FEATURES = 1 << 16
SIZES = (3, 4, 5)
#: The share of urls that are taken to be unwanted.
PRIOR = 0.25


def _halves(url: str) -> tuple[str, str]:
    host, slash, rest = url.partition("/")
    return host, (slash + rest).partition("?")[0]


#: (host, path, label) of the labelled table.
LABELLED = tuple((*_halves(u), label) for label, urls in ((1, UNWANTED), (0, OTHERS)) for u in urls)


def features(hosts, paths) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct n-grams of all rows: of the host with its ends marked, and of the path with its end marked."""
    out = []
    for part, texts in ((0, [f"^{h}$\n" for h in hosts]), (1, [f"{p}$\n" for p in paths])):
        data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)  # a number for each character
        row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        code = np.zeros(len(data), np.uint64)
        last = np.append(np.flatnonzero((np.diff(row) > 0)), len(data) - 1) if len(data) else np.zeros(0, int)
        room = np.repeat(last, np.bincount(row, minlength=len(texts))[np.bincount(row, minlength=len(texts)) > 0]) - np.arange(len(data))
        for k in range(max(SIZES)):
            code[: max(0, len(data) - k)] += data[k:] << np.uint64(8 * k)
            if k + 1 in SIZES:
                whole = room > k  # the line's end isn't part of a gram
                h = mix(code[whole] ^ mix(np.uint64(10 * part + k + 1)))
                out.append(row[whole] * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64))
    both = np.unique(np.concatenate(out))
    return both // FEATURES, both % FEATURES


def probabilities(hosts, paths, model: tuple[np.ndarray, float]) -> np.ndarray:
    """P(block) of each row. Each n-gram weighs 1 over the root of their number."""
    (w, b), (row, feature) = model, features(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    total = np.bincount(row, w[feature], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1))
    return 1 / (1 + np.exp(-np.clip(total + b, -60, 60)))


@lru_cache(maxsize=4)
def fit(labelled: tuple = LABELLED, steps: int = 400, rate: float = 20.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps over all rows of the table. The intercept stays at PRIOR, which urls get whose
    n-grams say nothing: half of the table is unwanted, of the web it is less."""
    row, feature = features([h for h, *_ in labelled], [p for _, p, _ in labelled])
    y = np.array([label for *_, label in labelled], float)
    value = 1 / np.sqrt(np.bincount(row, minlength=len(y)))[row]
    w, b = np.zeros(FEATURES), float(np.log(PRIOR / (1 - PRIOR)))
    for _ in range(steps):
        total = np.bincount(row, w[feature] * value, minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(total, -60, 60))) - y) / max(1, len(y))
        w -= rate * (np.bincount(feature, g[row] * value, minlength=FEATURES) + l2 * w)
    return w, b


def split_url(url):
    """(host, path) columns of a url column."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), after


def judge_urls(pages: DataFrame, url: str = "url", rules: dict[str, str] = RULES, labelled=LABELLED) -> DataFrame:
    """pages with host, path, rule, verdict and score (the model's probability of block)."""
    model = fit(tuple(labelled))  # FEATURES numbers
    common.bound_batches(pages.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        hosts, paths, out = hosts.tolist(), paths.tolist(), [np.empty(0)]
        for a, b in common.batches_of_bytes([h + p for h, p in zip(hosts, paths, strict=True)]):
            out.append(probabilities(hosts[a:b], paths[a:b], model))
        return pd.Series(np.concatenate(out))

    host, path = split_url(F.col(url))
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, start = rule.partition("/")
        fits.append(F.when(((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{start}"), F.lit(rule)))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    return (
        pages.select(*kept, host.alias("host"), path.alias("path"))
        .withColumn("rule", F.coalesce(*fits) if fits else F.lit(None).cast("string"))
        .withColumn("score", score("host", "path"))
        .withColumn("verdict", verdict)
    )


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
