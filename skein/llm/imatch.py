"""Operator 8: I-Match fingerprints over several randomised subsets of a lexicon of middling document frequency.

The document frequency of every term is counted over all documents. The lexicon is the band of terms that at least
LEAST_SHARE (and two) and at most MOST_SHARE of the documents have; a document of d distinct terms adds d to the sum of
all frequencies, so at most mean(d) / LEAST_SHARE terms can lie in the band, however many documents there are, and the
band can be sent to all tasks. Each level of RATES has SUBSETS subsets that keep one in so many terms of the lexicon,
denser ones for short texts and sparser ones for long texts: a hash deals the lexicon into that many cells, and cells
are the subsets (several hashes where there are fewer cells than subsets). A subset's value hashes the distinct terms
that the text has of it, in any order (scrambled hashes are added, so sorting them first changes nothing); 0 if it has
none. The fingerprint is all values in hex. Likeness: at each level, the share of subsets with equal values among those
that either text has terms of; the level with the best lower bound of that share counts.

Defined results: null is empty; a text without terms of the band uses all its terms, one without terms has the empty
fingerprint of zeros, alike only to itself; equal texts have equal fingerprints; repeated doc_ids are separate
documents and follow each other by text; with one document it is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.hashing import LOWER_WORDS, Words, mix

LEAST_SHARE, MOST_SHARE = 1e-4, 0.05
RATES = (2, 8, 32, 128, 512, 2048)
SUBSETS = 16
#: Parts of the order of documents; a part is sorted (with spill) and streamed, so larger parts take time, not memory.
MOST_PARTS = 1 << 16
N_VALUES = len(RATES) * SUBSETS
#: One hash each: salt, number of cells, how many of them are subsets, place of the first subset.
_DEALS = [(1 + 100 * k + j, r, min(r, SUBSETS), k * SUBSETS + j * r) for k, r in enumerate(RATES) for j in range(max(1, SUBSETS // r))]


def term_sets(texts) -> list[np.ndarray]:
    """Distinct term hashes of each text."""
    words = Words(texts, LOWER_WORDS)
    h = words.hashes()
    return [np.unique(h[a:b]) for a, b in words.slices()]


def _member(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Which terms the sorted lexicon has."""
    at = np.searchsorted(lexicon, terms)
    inside = at < len(lexicon)
    out = np.zeros(len(terms), bool)
    out[inside] = lexicon[at[inside]] == terms[inside]
    return out


def values_of(sets: list[np.ndarray], lexicon: np.ndarray) -> np.ndarray:
    """The 16-bit values of all subsets, a row for each set of terms."""
    n = len(sets)
    doc, terms = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate([np.empty(0, np.uint64), *sets])
    known = _member(terms, lexicon)
    some = known | (np.bincount(doc[known], minlength=n) == 0)[doc]
    doc, terms, out = doc[some], terms[some], np.zeros(n * N_VALUES, np.uint64)
    with np.errstate(over="ignore"):
        for salt, cells, used, first in _DEALS:
            u = mix(terms ^ mix(np.uint64(salt)))
            cell = ((u >> np.uint64(40)) % np.uint64(cells)).astype(np.int64)
            kept = cell < used
            np.add.at(out, doc[kept] * N_VALUES + first + cell[kept], mix(u[kept]))
    short = (mix(out) >> np.uint64(48)).astype(np.uint16)
    return np.where(out == 0, 0, np.maximum(short, 1)).astype(np.uint16).reshape(n, N_VALUES)


def as_hex(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    either = ((a != 0) | (b != 0)).reshape(-1, SUBSETS).sum(axis=1)
    same = ((a == b) & (a != 0)).reshape(-1, SUBSETS).sum(axis=1)
    share = same / np.maximum(either, 1)
    best = int((share - 1 / np.sqrt(either + 1)).argmax())
    return float(share[best]) if either[best] else 0.0


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (a 64-bit hash), df over all documents. Tasks add up their batches before rows move."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sets = [t for a, b in common.batches_of_bytes(texts) for t in term_sets(texts[a:b])]
            terms, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The sorted terms of the band; at most mean number of distinct terms / LEAST_SHARE."""
    n = docs.count()
    band = document_frequencies(docs, text).where(F.col("df").between(max(2.0, LEAST_SHARE * n), max(2.0, MOST_SHARE * n)))
    return np.sort(band.select("term").toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))


def next_documents(docs: DataFrame, text: str = "text", rows_per_part: int = 4000) -> tuple[DataFrame, int]:
    """The rows (doc_id, text) by part, descending doc_id within and over parts, and the number of parts. A part also has
    the first document of the next one, as guest (the last part that of the first)."""
    spark = docs.sparkSession
    n = docs.count()
    parts = min(MOST_PARTS, max(1, math.ceil(n / rows_per_part)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    cuts = sorted(set(ids.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []))
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part_of(c: pd.Series) -> pd.Series:
        """How many bounds are larger: part 0 has the largest ids."""
        return pd.Series(len(bounds) - np.searchsorted(bounds, c.to_numpy(), "right"))

    heads = {r["part"]: r["id"] for r in ids.withColumn("part", part_of(F.col("id"))).groupBy("part").agg(F.max("id").alias("id")).collect()}
    order = sorted(heads)  # part 0 has the largest ids; one row a part
    guest = [(heads[p], order[k - 1]) for k, p in enumerate(order)]
    guests = spark.createDataFrame(guest, "id long, part int") if guest else spark.createDataFrame([], "id long, part int")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(id_.alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = rows.withColumn("part", part_of(F.col("id"))).withColumn("guest", F.lit(0))
    other = rows.join(F.broadcast(guests), "id").withColumn("guest", F.lit(1)).select(own.columns)
    return own.unionByName(other), order[-1] + 1 if order else 1


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    common.tidy_shuffles(spark)
    common.bound_batches(spark, "8m")
    lexicon = spark.sparkContext.broadcast(lexicon_of(docs, text))
    rows, parts = next_documents(docs, text)

    def walk(batches):
        held = None  # (part, doc_id, text, values) of the document whose next one is still to come
        for batch in batches:
            part, guest, ids, texts = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))
            texts = [t or "" for t in texts]
            out, edited, todo = [], [], []
            values = []
            for a, b in common.batches_of_bytes(texts):
                values += list(values_of(term_sets(texts[a:b]), lexicon.value))
            for k in range(len(texts)):
                mine = (part[k], ids[k], texts[k], values[k])
                if held is not None and held[0] == mine[0]:
                    half = len(held[2]) // 2
                    edited.append(held[2][: len(held[2]) - half] + mine[2][:half])
                    todo.append((held, mine))
                held = None if guest[k] else mine
            for a, b in common.batches_of_bytes(edited):
                made = values_of(term_sets(edited[a:b]), lexicon.value)
                for (one, two), new, v in zip(todo[a:b], edited[a:b], made, strict=True):
                    digest = hashlib.sha256(common.utf8(new)).hexdigest()
                    near = likeness(one[3], v), likeness(one[3], two[3])
                    out.append((one[1], len(one[2]), digest, as_hex(one[3]), as_hex(v), *near))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    order = ["part", "guest", F.col("id").desc(), "text"]
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).select("part", "guest", "doc_id", "text").mapInArrow(walk, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
