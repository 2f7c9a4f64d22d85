"""Splits texts into overlapping chunks of bounded size; whole texts, one task's batch at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx

_EMPTY_LINE = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
VERSION = 1


@dataclass(frozen=True)
class Limits:
    """Characters of a chunk (aimed at, at most, overlap, least), chunks of a text, characters of a text."""

    target: int = 1200
    most: int = 1600
    overlap: int = 200
    least: int = 100
    chunks: int = 1000
    input: int = 1_000_000

    def __post_init__(self):
        if self.overlap >= self.most:
            raise ValueError("invalid_chunking_configuration: the overlap must be smaller than a chunk")


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), a + len(part.rstrip())


def _hard(text: str, a: int, b: int, most: int):
    """Runs of at most so many characters, cut at the last blank that fits."""
    while b - a > most:
        cut = max(text.rfind(x, a + 1, a + most) for x in " \n\t")
        cut = cut if cut > a else a + most
        yield _trimmed(text, a, cut)
        a = _trimmed(text, cut, b)[0]
    if a < b:
        yield a, b


def _spans(text: str, most: int):
    """Paragraphs, longer ones cut at sentence ends, and those at the last blank that fits."""
    ends = [0, *(x for m in _EMPTY_LINE.finditer(text) for x in m.span()), len(text)]
    for p, q in zip(ends[::2], ends[1::2], strict=True):
        p, q = _trimmed(text, p, q)
        if p >= q:
            continue
        if q - p <= most:
            yield p, q
            continue
        cuts = [p, *(x + p for m in _SENTENCE.finditer(text[p:q]) for x in m.span()), q]
        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
            a, b = _trimmed(text, a, b)
            if a < b:
                yield from _hard(text, a, b, most)


def chunk_spans(text: str, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a clean text: spans are joined up to the target, each chunk then starts up to the overlap
    earlier, or further, at a blank."""
    inner, base = limits.most - limits.overlap, []
    for a, b in _spans(text, inner):
        if base and (b - base[-1][0] <= limits.target or (base[-1][1] - base[-1][0] < limits.least and b - base[-1][0] <= inner)):
            base[-1][1] = b
        else:
            base.append([a, b])
    out = []
    for k, (a, b) in enumerate(base):
        if k and limits.overlap:
            first, last = base[k - 1]
            start = max(last - limits.overlap, first)
            while start > first and not text[start - 1].isspace():
                start -= 1
            a = min(a, start)
        out.append((a, b))
    return out


def chunked(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """doc_id, input_length, error (chunking_input_too_large, too_many_chunks, chunk_too_large or null), warning and chunks, an
    array of (start, end, text) with offsets in the clean text. The generators keep each text from being cleaned or split twice."""

    def split(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            error, made = None, []
            if len(t) > limits.input:
                error = "chunking_input_too_large"
            else:
                made = [(a, b, t[a:b].strip()) for a, b in chunk_spans(t, limits)]
                error = "too_many_chunks" if len(made) > limits.chunks else None
                error = error or ("chunk_too_large" if any(len(x) > limits.most for *_, x in made) else None)
            rows.append((error, [] if error else made))
        return pd.DataFrame(rows, columns=["error", "chunks"])

    made = F.pandas_udf(split, "struct<error:string,chunks:array<struct<character_start:int,character_end:int,text:string>>>")
    clean = docs.select("doc_id", F.explode(F.array(tx.clean_text(F.coalesce(F.col(text), F.lit(""))))).alias("clean"))
    found = clean.select("doc_id", F.length("clean").alias("input_length"), F.explode(F.array(made("clean"))).alias("m"))
    warning = F.when(F.col("input_length") == 0, "empty_extracted_text")
    return found.select("doc_id", "input_length", "m.error", warning.alias("warning"), "m.chunks")


def chunks(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A row for each chunk of the texts without an error."""
    rows = chunked(docs, text, limits).select("doc_id", F.size("chunks").alias("n"), F.posexplode("chunks").alias("chunk_index", "c"))
    first = F.col("chunk_index") == 0
    return rows.select(
        "doc_id", "chunk_index", "c.character_start", "c.character_end", F.col("c.text").alias("chunk_text"), F.length("c.text").alias("text_length"),
        F.sha2("c.text", 256).alias("text_sha256"),
        F.struct(
            F.lit(VERSION).alias("chunking_version"), tx.estimated_tokens(F.col("c.text")).alias("estimated_tokens"),
            F.when(first, 0).otherwise(limits.overlap).alias("overlap_chars"), first.alias("is_first_chunk"),
            (F.col("chunk_index") == F.col("n") - 1).alias("is_last_chunk"),
        ).alias("metadata"),
    )


def replace(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """All chunks once the documents in `rebuilt` have their new ones only."""
    return old.join(rebuilt.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
