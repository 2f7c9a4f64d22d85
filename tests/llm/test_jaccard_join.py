import random
import re

import numpy as np
import pytest

from skein.llm import jaccard_join as j
from tests.llm.docs import COLUMNS, docs


def brute(texts):
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return [(k, len(s), c) for k, (s, c) in enumerate(zip(sets, label, strict=True))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("rare", [1, 8])
def test_against_brute_force(spark, rare):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \n ", "a b", "A  B", "a b c d e", "a b c d e f", "x y z", "long " * 3000]
    for g in range(8):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 150, 400]))]
        texts += [" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))) for _ in range(12)]
        texts.append(" ".join(base + passage))
        texts.append(" ".join(base[: len(base) * 9 // 10]).upper())
    got = sorted(tuple(r) for r in j.jaccard_components(docs(spark, texts).repartition(3), rare=rare).collect())
    assert got == brute(texts)


def test_signatures_alone_find_the_same_components(spark, monkeypatch):
    """Without quick links, which only spare work, the prefixes of token combinations reach every component."""
    with_centres, quick = j._with_centres, []

    def none_at_first(groups, round_):
        pairs = with_centres(groups, round_)
        quick.append(round_ == 0)
        return pairs.limit(0) if round_ == 0 else pairs

    monkeypatch.setattr(j, "_with_centres", none_at_first)
    rng = random.Random(8)
    texts = []
    for g in range(10):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.choice([8, 30, 120, 300]))]
        texts += [" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))) for _ in range(10)]
    got = sorted(tuple(r) for r in j.jaccard_components(docs(spark, texts)).collect())
    assert got == brute(texts) and True in quick and len({c for *_, c in got}) < 60


def test_awkward_tables(spark):
    assert j.jaccard_components(spark.createDataFrame([], COLUMNS)).count() == 0
    df = docs(spark, ["a b c d e f"] * 3 + ["q"])
    assert sorted(tuple(r) for r in j.jaccard_components(df.union(df)).collect()) == sorted([(k, 2, 0) for k in range(3)] * 2 + [(3, 1, 3)] * 2)
    kept = j.first_of_each(df.union(df))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3] and kept.columns == df.columns


def test_repeated_rows_add_no_links(spark):
    """Texts of 100 shingles that share about half: a doubled table must not make links of them."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(104)]
    texts = [" ".join(base), " ".join(base[:52] + [f"x{k}" for k in range(52)]), " ".join([f"y{k}" for k in range(40)] + base[40:]), " ".join(edited(rng, base, 1))]
    df = docs(spark, texts)
    got = sorted(tuple(r) for r in j.jaccard_components(df.union(df)).collect())
    assert got == sorted(brute(texts) * 2) and len({c for _, _, c in got}) == 3


def test_first_of_each_keeps_rows_without_an_id_and_texts_that_share_one(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (7, words("c")), (7, words("d")), (7, words("d")), (8, words("e")), (8, None), (8, None), (None, None), (None, " \n")]
    table = spark.createDataFrame([(i, t, "en", "a", 1, "r", "k") for i, t in rows], COLUMNS).repartition(3)
    got = sorted((r.doc_id or 0, r.text or "") for r in j.first_of_each(table).collect())
    assert got == sorted([(0, words("a")), (0, words("b")), (7, words("c")), (7, words("d")), (8, words("e")), (8, ""), (0, ""), (0, " \n")])


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(-(2**62), 2**62, n))
        drop = rng.random(len(x)) < rng.random() * 0.12
        y = np.unique(np.concatenate([x[~drop], rng.integers(-(2**62), 2**62, int(rng.integers(0, 1 + n // 9)))]))
        i = len(np.intersect1d(x, y))
        if 100 * i < 80 * (len(x) + len(y) - i) or len(x) == len(y) == i:
            continue
        df = {t: int(rng.choice([2, 3, 9, 50])) for t in np.intersect1d(x, y)} | {t: int(rng.choice([1, 2, 20])) for t in np.setxor1d(x, y)}
        made = []
        for s in (x, y):
            shared = sorted((df[t], t) for t in s if df[t] > 1)
            made.append(set(j.signatures(len(s), np.array([c for c, _ in shared]), np.array([t for _, t in shared])).tolist()))
        assert made[0] & made[1]
