import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import imatch, language, toxicity
from tests.llm.docs import COLUMNS, docs

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n", "123 ... !", "ok", "same", "same", "y " * 20000, "\U0001f600 é"]


def test_language_mixture_and_awkward_texts(spark):
    rng = random.Random(0)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    en, fr = "the and thing when other there with".split(), "le une être garçon quelle vous avec".split()
    model = language.Model([("en", say(en, 200)), ("fr", say(fr, 200))] * 3)
    df = docs(spark, [say(en, 50), say(fr, 50), say(en, 60) + " " + say(fr, 60), *AWKWARD]).withColumn("score", F.lit("mine"))
    rows = sorted(language.identify_languages(df, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in rows[:2]] == ["en", "fr"] and all(0 <= r.score <= 1 for r in rows)
    assert min(rows[2].proportions) > 0.3
    assert [r.lang_pred for r in rows[3:7]] == ["und"] * 4 and rows[8].proportions == rows[9].proportions
    assert {r.lang_pred for r in language.identify_languages(df, language.Model([])).collect()} == {"und"}
    assert language.trained(spark.createDataFrame([], COLUMNS)).names == []


def brute_trigrams(text):
    """Numbers of the trigrams of a text whose runs of other characters, and ends, are single spaces."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = " ".join(low.split())
    return Counter(f" {words} "[i : i + 3] for i in range(len(words))) if words else Counter()


def test_trigrams_against_brute_force_and_in_any_batch():
    texts = ["abc", "a", "I", "née", "", None, "1 2", "  the thing. ", "the", "q!", "ab-cd", "the the the", "x" * 50]
    for k, t in enumerate(texts):
        (alone,) = language.trigrams([t])
        for batch, at in ((texts, k), (texts[k:], 0), (texts[: k + 1], k), ([t, t], 1)):
            ids, n = language.trigrams(batch)[at]
            assert ids.tolist() == alone[0].tolist() and n.tolist() == alone[1].tolist()
        assert sorted(alone[1].tolist()) == sorted(brute_trigrams(t).values())
    model = language.Model([("en", "the thing and other"), ("fr", "une chose et autre")])
    assert [p[0] == "und" for p in model.predict(texts)] == [not any(c.isalpha() for c in t or "") for t in texts]


def test_chosen_languages_against_all_sets():
    """The greedy choice reaches the best penalised likelihood of all sets of at most two languages."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        like, counts = rng.random((60, 3)) ** 3 + 1e-3, rng.integers(1, 6, 60).astype(float)
        like /= like.max(axis=1, keepdims=True)
        cost = language.PENALTY * 3 * np.log(max(2.0, counts.sum() / 3))
        sets = [[0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]]
        score = lambda c: language.proportions(like, counts, c)[1] - cost * (len(c) - 1)
        got = np.flatnonzero(language.choose(like, counts)).tolist()
        assert score(got) >= max(map(score, sets)) - cost


def test_sample_keeps_rare_languages_and_the_smallest_hashes(spark):
    """A hot language doesn't thin the others: 60,000 rows of one, 30 and 3 of two more, some without an id."""
    lang = F.when(F.col("id") < 60_000, "hot").when(F.col("id") < 60_030, "rare").otherwise("rarest")
    table = spark.range(60_033).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), lang.alias("lang"), F.concat(F.lit("t"), "id").alias("text"))
    got = language.labelled_sample(table, "text", "lang", 10)
    h = F.xxhash64(F.lit(5), F.coalesce(F.col("doc_id").cast("string"), "text"))
    hashes = sorted((r.h, r.text, r.lang) for r in table.select("text", "lang", h.alias("h")).collect())
    for name, n in (("hot", 10), ("rare", 10), ("rarest", 3)):
        assert sorted(t for x, t in got if x == name) == sorted([t for _, t, x in hashes if x == name][:n]) and len([x for x, _ in got if x == name]) == n


def test_long_texts_teach_a_language_and_bytes_are_bounded(spark):
    long = [(k, "ein zwei drei vier " * 6_000, "long") for k in range(3)] + [(k, f"one two three {k}", "short") for k in range(3, 40)]
    table = spark.createDataFrame(long, "doc_id long, text string, lang string")
    assert {x for x, _ in language.labelled_sample(table, "text", "lang")} == {"long", "short"}
    got = language.labelled_sample(table, "text", "lang", most_bytes=300_000)
    assert sorted(len(t) for x, t in got if x == "long") == [114_000] * 2 and sum(x == "short" for x, _ in got) == 37
    assert len([1 for x, _ in language.labelled_sample(table, "text", "lang", most_bytes=10) if x == "long"]) == 1
    model = language.trained(table)
    assert model.names == ["long", "short"]
    assert (model.likelihood == language.Model([(r.lang, r.text) for r in table.where(~language.held_out()).collect()]).likelihood).all()


def test_many_languages(spark):
    names = [f"l{k:03}" for k in range(200)]
    table = spark.createDataFrame([(4 * k + j, f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)}{chr(0x4E02 + 3 * k)} " * 9, n) for k, n in enumerate(names) for j in range(4)], "doc_id long, text string, lang string")
    assert language.trained(table).names == names


def brute_language(texts, labelled):
    """Languages and shares of texts by plain dictionaries: trigram shares, all sets grown one by one."""
    names = sorted({lang for lang, _ in labelled})
    seen = {n: np.zeros(language.BUCKETS) for n in names}
    for n, t in labelled:
        for bucket, c in zip(*language.trigrams([t])[0], strict=True):
            seen[n][bucket] += c
    share = {n: (c + language.SMOOTHING) / (c + language.SMOOTHING).sum() for n, c in seen.items()}
    out = []
    for t in texts:
        ids, counts = language.trigrams([t])[0]
        if not len(ids):
            out.append(("und", 0.0))
            continue
        like = np.array([[share[n][b] for n in names] for b in ids])
        like = np.maximum(like / np.array([max(share[n][b] for n in names) for b in ids])[:, None], 1e-4)

        def best(chosen):
            pi, before = [1 / len(chosen)] * len(chosen), -np.inf
            for _ in range(language.STEPS):
                mixed = [sum(p * row[j] for p, j in zip(pi, chosen, strict=True)) for row in like]
                value = sum(c * np.log(m) for c, m in zip(counts, mixed, strict=True))
                if value - before < 1e-6 * counts.sum():
                    break
                before = value
                pi = [p * sum(c * row[j] / m for c, row, m in zip(counts, like, mixed, strict=True)) / counts.sum() for p, j in zip(pi, chosen, strict=True)]
            return value, pi

        cost = language.PENALTY * 3 * np.log(max(2.0, counts.sum() / 3))
        chosen = [max(range(len(names)), key=lambda j: (best([j])[0], -j))]
        value, pi = best(chosen)
        while len(chosen) < len(names):
            j = max((j for j in range(len(names)) if j not in chosen), key=lambda j: (best([*chosen, j])[0], -j))
            more, shares = best([*chosen, j])
            if more - value <= cost:
                break
            chosen, value, pi = [*chosen, j], more, shares
        k = max(range(len(chosen)), key=lambda i: (pi[i], -chosen[i]))
        out.append((names[chosen[k]], pi[k]))
    return out


def test_languages_of_a_whole_table_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 2500")
    rows = sorted(language.identify_languages(table, language.trained(table)).collect(), key=lambda r: r.doc_id)
    labelled = [(r.lang, r.text) for r in table.where(~language.held_out()).collect() if r.lang is not None and r.text is not None]
    want = brute_language([r.text for r in rows], labelled)
    assert len(rows) > 50 and [r.lang_pred for r in rows] == [n for n, _ in want]
    assert np.allclose([r.score for r in rows], [s for _, s in want], atol=1e-6)


def test_expectation_maximisation_finds_the_likeliest_mixture():
    rng = np.random.default_rng(0)
    like, counts = rng.random((40, 2)) + 0.05, rng.integers(1, 9, 40).astype(float)
    pi, value = language.proportions(like, counts, [0, 1])
    grid = max(float(counts @ np.log(like @ np.array([p, 1 - p]))) for p in np.linspace(0.001, 0.999, 999))
    assert abs(value - grid) < 1e-2 and abs(pi.sum() - 1) < 1e-9


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify_languages(table, language.trained(table)).where(language.held_out()).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.93


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    field, e = toxicity.Field(np.zeros(1), 0.0, rng.normal(size=(2, 2))), rng.normal(size=7)
    got, at = field.marginals(e, np.array([3, 0, 4])), 0
    for n in (3, 4):
        total, each = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, each = total + w, each + w * np.array(y)
        assert np.allclose(got[at : at + n], each / total)
        at += n


def likelihood(field, features, label, counts):
    """Log likelihood of the labels by enumeration of all labellings of each chain."""
    e, at, total = field.emissions(features), 0, 0.0
    for n in counts.tolist():
        value = lambda y, a=at: sum(e[a + i] * y[i] for i in range(len(y))) + sum(field.move[u, v] for u, v in zip(y, y[1:], strict=False))
        every = [value([(code >> i) & 1 for i in range(n)]) for code in range(2**n)]
        total += value(label[at : at + n].astype(int).tolist()) - np.logaddexp.reduce(every)
        at += n
    return total


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    features, label, counts = rng.integers(0, 6, (9, 2)), rng.integers(0, 2, 9).astype(float), np.array([4, 2, 3])
    field = toxicity.Field(rng.normal(size=6), 0.3, rng.normal(size=(2, 2)))
    g, gb, gm, _ = field.gradient(features, label, counts)
    d = 1e-5
    for k in range(6):
        ends = [toxicity.Field(field.weights + s * d * (np.arange(6) == k), 0.3, field.move) for s in (1, -1)]
        assert abs((likelihood(ends[0], features, label, counts) - likelihood(ends[1], features, label, counts)) / (2 * d) - g[k]) < 1e-5
    ends = [toxicity.Field(field.weights, 0.3 + s * d, field.move) for s in (1, -1)]
    assert abs((likelihood(ends[0], features, label, counts) - likelihood(ends[1], features, label, counts)) / (2 * d) - gb) < 1e-5
    for a in (0, 1):
        for b in (0, 1):
            step = np.zeros((2, 2))
            step[a, b] = d
            ends = [toxicity.Field(field.weights, 0.3, field.move + s * step) for s in (1, -1)]
            assert abs((likelihood(ends[0], features, label, counts) - likelihood(ends[1], features, label, counts)) / (2 * d) - gm[a, b]) < 1e-5


def test_toxicity_held_out_and_empty_tables(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(toxicity.held_out())
    rows = toxicity.score_toxicity(docs_.join(held, "doc_id"), toxicity.trained(docs_, labels)).select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    assert hits >= 0.8 * sum(r.toxic for r in rows) and hits >= 0.9 * sum(r.predicted for r in rows)  # a tenth of the labels are wrong
    empty = spark.createDataFrame([], COLUMNS)
    assert toxicity.score_toxicity(empty, toxicity.trained(empty, labels)).count() == 0
    twice = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(toxicity.labelled_sample(docs(spark, ["a", "b"]), twice)[1]) == [0, 1]


def brute_toxicity(field, text):
    """The calibrated score of a text by sums over both labels of each token, step by step."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else (c if ord(c) > 127 or c.isalnum() else " ") for c in text or "")
    words = toxicity.Words([low], toxicity.LOWER_WORDS)
    e = [field.bias + sum(float(field.weights[b]) for b in row) for row in toxicity.token_features(words)]
    n, p = len(e), []
    if n:
        ahead, back = [(0.0, e[0])], [(0.0, 0.0)]
        for x in e[1:]:
            ahead.append(tuple((0.0, x)[b] + np.logaddexp(ahead[-1][0] + field.move[0][b], ahead[-1][1] + field.move[1][b]) for b in (0, 1)))
        for x in e[:0:-1]:
            back.append(tuple(np.logaddexp(field.move[a][0] + back[-1][0], field.move[a][1] + x + back[-1][1]) for a in (0, 1)))
        p = [1 / (1 + np.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, reversed(back), strict=True)]
    total = sum(x * x for x in sorted(p)[-toxicity.LARGEST :])
    return 1 / (1 + np.exp(-(field.calibration[0] + field.calibration[1] * np.log(total + 0.1))))


def test_toxicity_of_a_whole_table_against_brute_force(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = toxicity.trained(docs_, labels)
    rows = toxicity.score_toxicity(docs_.where("n_chars < 3000"), field).collect()
    assert len(rows) > 500 and sum(r.predicted for r in rows) > 5
    assert np.allclose([r.score for r in rows], [brute_toxicity(field, r.text) for r in rows], atol=1e-6)


def test_one_labelled_id_on_many_rows_and_long_texts(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = rows.union(spark.createDataFrame([(8, "long " * 30_000), (9, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 0, 1), (8, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    texts, toxic = toxicity.labelled_sample(rows, labels)
    assert sorted(toxic) == [0, 0, 1] and "long " * 30_000 in texts
    assert [len(t) for t in toxicity._once(toxicity.sampled(rows, labels, most_bytes=10).toArrow())[0]].count(150_000) <= 1


def test_toxic_spans_and_awkward_texts(spark):
    rng = random.Random(1)
    words = [f"w{k}x{rng.randrange(99)}" for k in range(60)]
    clean = lambda: [rng.choice(words) for _ in range(30)]
    texts, labels = [], []
    for k in range(240):
        t = clean()
        if k % 3 == 0:
            t[rng.randrange(30)] = "badword"
        texts.append(" ".join(t))
        labels.append(int(k % 3 == 0))
    field = toxicity.fit(texts, labels)
    df = docs(spark, ["Ünd w1 Badword, w2", "w1 w2 w3", *AWKWARD]).withColumn("predicted", F.lit("mine"))
    rows = sorted(toxicity.score_toxicity(df, field).collect(), key=lambda r: r.doc_id)
    assert [r.predicted for r in rows] == [1] + [0] * 10 and all(0 <= r.score <= 1 for r in rows)
    assert [(s["from"], s["to"]) for s in rows[0].spans] == [(7, 14)] and rows[7].score == rows[8].score
    assert toxicity.fit([], []).calibrated(np.zeros(1))[0] < 1e-20
    assert toxicity.trained(docs(spark, ["x"]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).bias < -10


def brute_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def brute_values(text, lexicon):
    """Values of all subsets, one term and one subset after the other."""
    words = set(brute_terms(text))
    words = words & lexicon or words
    hashes = [int(imatch.term_sets([w])[0][0]) for w in sorted(words)]
    out = []
    for level, rate in enumerate(imatch.RATES):
        for subset in range(imatch.SUBSETS):
            salt = 1 + 100 * level + subset // min(rate, imatch.SUBSETS)
            cell = subset % min(rate, imatch.SUBSETS)
            us = [mixed(h ^ mixed(salt)) for h in hashes]
            total = sum(mixed(u) for u in us if (u >> 40) % rate == cell) % 2**64
            out.append(max(1, mixed(total) >> 48) if total else 0)
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    best = None
    for k in range(0, len(a), imatch.SUBSETS):
        pairs = [(x, y) for x, y in zip(a[k : k + imatch.SUBSETS], b[k : k + imatch.SUBSETS], strict=True) if x or y]
        share = sum(x == y for x, y in pairs) / max(1, len(pairs))
        bound = share - 1 / np.sqrt(len(pairs) + 1)
        if best is None or bound > best[0]:
            best = (bound, share)
    return best[1]


def test_fingerprints_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [*AWKWARD, *(" ".join(f"t{rng.randrange(300)}" for _ in range(80)) for _ in range(30))]
    rows = {r.doc_id: r for r in imatch.fingerprints(docs(spark, texts).repartition(3)).collect()}
    df = Counter(w for t in texts for w in set(brute_terms(t)))
    lexicon = {w for w, n in df.items() if 2 <= n <= max(2, imatch.MOST_SHARE * len(texts))}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        text, after = text or "", texts[(k - 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (rows[k].n_chars, rows[k].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        want, edit = (brute_values(x, lexicon) for x in (text, edited))
        assert rows[k].fingerprint == "".join(f"{v:04x}" for v in want) and rows[k].edited_fingerprint == "".join(f"{v:04x}" for v in edit)
        assert rows[k].near_edited == brute_likeness(want, edit) and rows[k].near_next == brute_likeness(want, brute_values(after, lexicon))
    assert rows[5].fingerprint == rows[6].fingerprint != rows[4].fingerprint
    made = [rows[k] for k in range(len(AWKWARD), len(texts))]
    assert np.mean([r.near_edited for r in made]) > np.mean([r.near_next for r in made]) + 0.1
    assert imatch.fingerprints(spark.createDataFrame([], COLUMNS)).count() == 0
    parts, n = imatch.next_documents(docs(spark, texts), rows_per_part=5)
    assert n > 3 and parts.where("guest = 1").count() == parts.select("part").distinct().count() <= n
    some = [(3, "a b"), (3, "a b"), (3, "c d"), (2, "e f"), (None, "g h"), (None, None)] * 3  # repeated ids at the borders of parts
    table = spark.createDataFrame([(i, t, "en", "s", 1, "r", "k") for i, t in some], COLUMNS)
    monkeypatch.setattr(imatch.next_documents, "__defaults__", ("text", 2))
    got = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in imatch.fingerprints(table).collect())
    ordered = sorted(some, key=lambda r: (-(r[0] or -1), r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        want.append((i or 0, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
    assert got == sorted(want)


def test_pipeline(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs_.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs_ = corpus_pipeline.common.written(stage(spark, docs_, SF), "t")
        assert docs_.columns == columns and 0.5 * before < docs_.count() <= before
    kept = {r.doc_id for r in docs_.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.collect()} <= kept


def test_stages_with_awkward_rows_and_clashing_columns(spark):
    """Nulls in all columns, repeated rows and ids, empty and long texts, and columns with the operators' own names."""
    clash = ["score", "predicted", "spans", "lang_pred", "proportions", "replica", "shuffle_key", "n", "key", "row", "at", "k1", "label"]
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("the and thing when other there with house tree".split()) for _ in range(n))
    long, near = say(30_000), say(60)
    texts = [(1, near), (1, near), (2, near + " end"), (3, None), (None, None), (None, near), (None, say(40)), (4, ""), (5, long), (6, say(30)), (6, say(35)), (7, "12 34")]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None, *[f"v{k}"] * len(clash)) for k, (i, t) in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    table = spark.createDataFrame(rows, kind).repartition(2)
    values = {(r.doc_id, r.text): r.score for r in table.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.common.written(stage(spark, table, SF), "awkward")
        got = out.collect()
        if name != "packing":
            assert out.columns == table.columns
            assert all((r.doc_id, r.text) in values and r.score == r.label == r.replica and r.score.startswith("v") for r in got)
        if name == "language":
            assert not [r for r in got if not any(c.isalpha() for c in r.text or "")] and len(got) == 8
        if name == "near_duplicates":
            assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in got if r.text and len(r.text) < 500 and near[:20] in r.text) == [(1, near[:5])]
            assert len(got) == 9
        assert stage(spark, table.limit(0), SF).count() == 0
