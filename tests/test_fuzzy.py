import difflib
import random

import pytest

from skein.functions import text as tx
from skein.operators import fuzzy

F = tx.F


def brute(terms, tokens, threshold):
    guard = lambda a, b: abs(len(a) - len(b)) <= max(2, len(a) // 3)
    return {(a, b): r for a in terms for b in tokens if guard(a, b) and (r := difflib.SequenceMatcher(None, a, b).ratio()) >= threshold}


@pytest.mark.parametrize("threshold", [0.86, 0.7])
def test_pairs_of_varied_words_equal_brute_force(spark, threshold):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcde1") for _ in range(rng.randrange(1, 14))) for _ in range(250)}
    for w in list(words):
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice("xyz") + w[k + rng.randrange(2) :], w[:k] + w[k + 1 :], w[k:] + w[:k]}
    words |= {"a" * 30 + "b", "a" * 33, "a" * 27, "ab" * 20, "ab" * 17 + "c", "ba" * 15}
    words = sorted(words - {""})
    terms = words[::3]
    got = fuzzy.likely_pairs(spark.createDataFrame([(w,) for w in terms], "term string"), spark.createDataFrame([(w,) for w in words], "token string"), threshold)
    want = brute(terms, words, threshold)
    assert {(r.term, r.token): r.likeness for r in got.collect()} == want and len(want) > 300


def test_words_of_benchmark_against_the_vocabulary_of_documents(spark):
    def words(name):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        return {r.w for r in table.select(F.explode(tx.tokens(F.col("text"))).alias("w")).distinct().collect()}

    terms, tokens = sorted(w for w in words("benchmark") if len(w) >= 5)[:150], sorted(words("documents"))[:4000]
    got = fuzzy.likely_pairs(spark.createDataFrame([(w,) for w in terms], "term string"), spark.createDataFrame([(w,) for w in tokens], "token string"))
    assert {(r.term, r.token) for r in got.collect()} == set(brute(terms, tokens, 0.86))


def test_fewer_words_meet_than_all():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlcumwfgypbvk") for _ in range(9)) for _ in range(300)]
    keys = [set(fuzzy.meeting_keys(w, 0.86)) for w in words]
    met = sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i])
    assert met < 0.1 * 300 * 299 / 2


def test_shared_characters_bound_likeness():
    """Pairs that cannot reach the threshold are ruled out before their blocks are looked for, and no others."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé9") for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    pairs = [(a, b) for a in words for b in words]
    bound = fuzzy.most_alike(*(fuzzy.pd.Series(list(x)) for x in zip(*pairs, strict=True)))
    assert all(v >= difflib.SequenceMatcher(None, a, b).ratio() - 1e-12 for (a, b), v in zip(pairs, bound, strict=True) if a or b)
    assert fuzzy.most_alike(fuzzy.pd.Series(["abcdefgh"]), fuzzy.pd.Series(["abcdwxyz"])).tolist() == [0.5]
