import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import fill_middle as fm
from tests.llm.docs import COLUMNS, docs


def brute(doc_id, text, rate=100, spm_rate=50, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fm.SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_select_finds_each_one():
    rng = random.Random(1)
    for size in (1, 63, 64, 65, 200, 5000):
        bits = rng.getrandbits(size) | 1
        places = [i for i in range(size) if bits >> i & 1]
        assert [fm.select(bits, k) for k in range(len(places))] == places


def test_begins_of_units():
    for text in ("a", "\n", "a\n", "\n\nb", "a\nb\n\nc"):
        want, at = [], 0
        for u in re.findall(r"[^\n]*\n|[^\n]+", text):
            want.append(at)
            at += len(u)
        bits = fm.unit_begins(fm.mask(text.encode(), fm.class_table({10})), len(text))
        assert [i for i in range(len(text)) if bits >> i & 1] == want


def test_equals_brute_force_and_restores(spark):
    rng = random.Random(2)
    texts = ["", None, "\n", "a", "é\n€\n\U0001f600x", "has <S> inside\nb", "<\n<P\nS>", "a\r\nb\x0bc d\n", "x\n" * 30_000 + "é" * 100_000]
    texts += ["".join(rng.choice(["a", "\n", "é", "<", "S>", " ", "\U0001f600"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = docs(spark, texts)
    for rate in (100, 60):
        rows = fm.fill_in_middle(df, rate=rate).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.doc_id] or ""
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, text, rate), repr(text)
            assert r.back == text and r.row == "r" and r.key == "k"
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_other_units_and_signs(spark):
    out = fm.fill_in_middle(docs(spark, ["a. b! c"]), ends=".!", sentinels=("[1]", "[2]", "[3]")).first()
    assert out.n == 3 and out.output.count("[") == 3
    for bad in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fm.fill_in_middle(docs(spark, ["a"]), sentinels=bad)


def test_awkward_rows(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], COLUMNS)).count() == 0
    df = docs(spark, ["a\nb", "a\nb"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("FORM", F.lit("x")).withColumn("fim_text", F.lit("y"))
    rows = fm.fill_in_middle(df).collect()
    assert len({r.output for r in rows}) == 1 and {r.fim_text for r in rows} == {"y"} and {r.form for r in rows} <= {"psm", "spm"}
