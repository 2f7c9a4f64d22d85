import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from skein.llm import mixing
from tests.llm.docs import COLUMNS, docs


def brute(doc_id, rate, seed=mixing.SEED, text="t", number=0):
    doc_id = f"{'null' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}:{number}"
    pieces, copies = max(1, math.ceil(rate / mixing.MOST_MEAN)), 0
    for k in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        mean = rate / pieces
        p = c = math.exp(-mean)
        i = 0
        while c <= u:
            i += 1
            p *= mean / i
            c += p
        copies += i
    return copies


def test_counts_follow_inverse_poisson(spark):
    df = docs(spark, ["t"] * 400, "a").union(docs(spark, ["t"] * 40, "b").withColumn("doc_id", mixing.F.col("doc_id") + 1000))
    out = mixing.poisson_mixture(df, {"a": 1.0, "b": 3.0}, 1200.0)
    got = Counter(r.doc_id for r in out.collect())
    for i in range(400):
        assert got[i] == brute(i, 300 / 400)
    for i in range(1000, 1040):
        assert got[i] == brute(i, 900 / 40)
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys) and out.columns == [*df.columns, "replica", "shuffle_key"]


def test_awkward_rows(spark):
    assert mixing.poisson_mixture(spark.createDataFrame([], COLUMNS)).count() == 0
    df = docs(spark, [None, "", "x"]).union(docs(spark, ["y"], None)).union(spark.createDataFrame([(None, "z", None, None, None, "", "")], COLUMNS))
    assert {r.replica for r in mixing.poisson_mixture(df, rows=500.0).collect()} >= {0, 1}
    assert mixing.poisson_mixture(df, {"other": 1.0}).count() == 0


def test_rows_without_an_id_and_repeated_ids_have_their_own_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    texts = [f"t{k}" for k in range(1500)]
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 3 == 1, F.lit(5)).otherwise(F.col("doc_id"))).cast("long"))
    out = mixing.poisson_mixture(df, rows=1500.0).collect()
    got = Counter(r.text for r in out)
    ids = {r.text: r.doc_id for r in df.collect()}
    assert all(got[t] == brute(ids[t], 1.0, text=t) for t in texts)
    for some in (lambda k: k % 3 == 0, lambda k: k % 3 == 1):
        times = Counter(got[t] for k, t in enumerate(texts) if some(k))
        assert 140 <= times[0] <= 230 and 140 <= times[1] <= 230 and 60 <= times[2] <= 125
    assert len({r.shuffle_key for r in out}) == len(out)


def test_equal_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    df = docs(spark, ["same"]).withColumn("doc_id", F.lit(None).cast("long"))
    df = df.crossJoin(spark.range(950)).drop("id").union(docs(spark, ["x", "y"]))
    out = mixing.poisson_mixture(df, rows=952.0).collect()
    got = Counter(r.text for r in out)
    assert got["same"] == sum(brute(None, 1.0, text="same", number=k) for k in range(950)) and 850 < got["same"] < 1050
    assert len({r.shuffle_key for r in out}) == len(out)
    rows = mixing.numbered(df, "k").where("text = 'same'").collect()
    assert sorted(r.k for r in rows) == list(range(950)) and rows[0].doc_id is None
