"""Operator 11: cuts texts into prefix, middle and suffix and puts them in an order in which the middle comes last.

Units are runs up to and including a character of `ends` (lines, by default). Positions in a text are bits of one big integer: bytes.translate
turns the UTF-8 bytes into a string of 0 and 1 for each class (ends of units, bytes that begin a character), which is read
as a binary number; a shift by one and a union mark where units begin; bit_count gives their number n. The begin of unit k is
found by recursive halving: the lower half of the mask is counted, and one half is searched on.

A hash of seed and doc_id gives four numbers h1 to h4. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
units, the middle after the larger. A text is left plain if it is empty, has a sentinel, or h3 % 100 >= rate; else the
suffix comes first (spm) if h4 % 100 < spm_rate, or the prefix (psm).

Defined results: a null text is an empty one; a null doc_id hashes as no digits; repeated rows are cut alike; an empty table
gives no rows; other columns are kept, and those named like a result of this operator are replaced by it. A text is one row of
one task, however long; the masks take a quarter of its size.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from skein.llm import common

SEED, RATE, SPM_RATE = 7, 100, 50
#: Signs before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bits of a mask below which it is searched bit by bit.
SMALL = 64
RESULTS = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": BinaryType()}


def class_table(members) -> bytes:
    """For bytes.translate: the byte 1 (as a digit) for members of the class, 0 for others."""
    return bytes(ord("1") if b in members else ord("0") for b in range(256))


#: Bytes that begin a character of UTF-8.
FIRST_BYTES = class_table({b for b in range(256) if b & 0xC0 != 0x80})


def mask(raw: bytes, table: bytes) -> int:
    """Bit i is 1 if byte i is of the table's class."""
    return int(raw[::-1].translate(table), 2) if raw else 0


def unit_begins(ends: int, size: int) -> int:
    """Where units begin: at 0 and behind each end, if something follows."""
    return ((ends << 1) | 1) & ((1 << size) - 1)


def select(bits: int, rank: int) -> int:
    """The place of the one with so many ones below it."""
    at, width = 0, bits.bit_length()
    while width > SMALL:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    for _ in range(rank):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def numbers(seed: int, doc_id: int | None) -> list[int]:
    """h1 to h4."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(raw: bytes, ends: bytes, one: int, two: int) -> tuple[int, int, int]:
    """n, and the bytes before the ends of prefix and middle for two numbers drawn."""
    begins = unit_begins(mask(raw, ends), len(raw)) if raw else 0
    n = begins.bit_count()
    places = sorted((one % (n + 1), two % (n + 1)))
    return n, *(len(raw) if k == n else select(begins, k) for k in places)


def _checked(sentinels) -> list[bytes]:
    signs = [s.encode() for s in sentinels]
    if len(set(signs)) != 3 or any(not s or any(x in s[1:] for x in {t[0] for t in signs}) for s in signs):
        raise ValueError("sentinels must be three different ones, whose first characters occur nowhere else in them")
    return signs


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, ends: str = "\n", sentinels=SENTINELS) -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output (text)."""
    p, s, m = _checked(sentinels)
    if not ends or not ends.isascii():
        raise ValueError("ends must be ASCII characters")
    end_table, signs = class_table(set(ends.encode())), (p, s, m)
    common.bound_batches(docs.sparkSession)
    doc_id, text = common.fresh(docs, "fim_doc_id", "fim_text")

    def made(x: int | None, raw: bytes) -> tuple:
        h1, h2, h3, h4 = numbers(seed, x)
        n, a, b = cut(raw, end_table, h1, h2)
        if not raw or h3 % 100 >= rate or any(sign in raw for sign in signs):
            return n, "plain", None, None, raw
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        chars = [mask(x, FIRST_BYTES).bit_count() for x in (prefix, middle)]
        if h4 % 100 < spm_rate:
            return n, "spm", *chars, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", *chars, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches):
        for batch in batches:
            raws = [x or b"" for x in batch.column(text).to_pylist()]
            ids = batch.column(doc_id).to_pylist()
            rows = [made(*x) for x in zip(ids, raws, strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            kept = [c for c in batch.schema.names if c not in (doc_id, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *RESULTS])

    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    given = docs.select(*kept, F.col("doc_id").cast("long").alias(doc_id), F.col("text").cast("binary").alias(text))
    schema = StructType([*docs.select(*kept).schema, *(StructField(k, t) for k, t in RESULTS.items())])
    return given.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The text that was cut. It has no sentinel itself, so each of the output's occurs once."""
    p, s, m = _checked(sentinels)
    between = lambda a, b: F.substring_index(F.substring_index(output, b.decode(), 1), a.decode(), -1)
    middle = F.substring_index(output, m.decode(), -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).drop("text")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS hs FROM d),
c AS (SELECT *, len(l) AS n, least(hs[1] % (len(l) + 1), hs[2] % (len(l) + 1)) AS a, greatest(hs[1] % (len(l) + 1), hs[2] % (len(l) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS prefix, coalesce(array_to_string(l[a + 1:b], ''), '') AS middle,
  coalesce(array_to_string(l[b + 1:n], ''), '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain'
    WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
