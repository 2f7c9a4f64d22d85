import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import common, packing, token_files
from tests.llm.docs import COLUMNS, docs

TEXTS = [None, "", " ", "a  b", " x \n y", "\n\n  z\t q  ", "Émile d'été 12,5 % <|endoftext|> ok", "word " * 3000, "same text", "same text", "　   x", "it's we'll  'll"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(common.byte_bpe())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab'é1.,  ", max_size=30))
def test_pieces_give_the_same_ids(text):
    t = common.tokenizer(common.byte_bpe())
    assert t.ids([text])[0].tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_against_brute_force(spark, plain):
    df = docs(spark, TEXTS)
    rows = packing.best_fit_pack(df, common.byte_bpe()).collect()
    for k, text in enumerate(TEXTS):
        ids, mine = np.array([*plain(text), 2], "<u4"), sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 1024))) and all(r.length == 1024 for r in mine[1:])
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.best_fit_pack(spark.createDataFrame([], COLUMNS), common.byte_bpe()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_sum_of_squares_is_dense(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 64)
    fill = np.bincount(bins, lengths) if lengths else np.zeros(0)
    assert (fill <= 64).all() and (fill * 2 <= 64).sum() <= 1
    for b in range(len(fill)):
        mine = sorted((o, n) for x, o, n in zip(bins, offsets, lengths, strict=True) if x == b)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_code_round_trip(ranks):
    control, data = token_files.encode(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4) and token_files.decode(control, data, len(ranks)).tolist() == ranks


def test_files_against_brute_force(spark, plain, tmp_path):
    df = docs(spark, TEXTS).union(spark.createDataFrame([(None, "no id", None, None, None, "", "")], COLUMNS)).repartition(3)
    files, ids = token_files.write_token_files(df, common.byte_bpe(), f"file://{tmp_path}")
    rows = sorted(token_files.read_token_files(files, ids).collect(), key=lambda r: r.start)
    at = 0
    for r, (k, text) in zip(rows, [(None, "no id"), *enumerate(TEXTS)], strict=True):
        want = np.array([*plain(text), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (k, at, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        at += len(want)
    files, ids = token_files.write_token_files(df.limit(0), common.byte_bpe(), f"file://{tmp_path}/none")
    assert token_files.read_token_files(files, ids).count() == 0


def test_repeated_ids_and_many_files(spark, plain, tmp_path):
    """Many rows of one id and small files: the order of ids holds over all files, whatever their number."""
    rows = [(5, f"word {k}", "en", "s", 1, "r", "k") for k in range(60)] + [(k, "text " * (k % 7), "en", "s", 1, "r", "k") for k in range(40)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    files, ids = token_files.write_token_files(df, common.byte_bpe(), f"file://{tmp_path}/t", file_bytes=200)
    assert files.count() > 3 and not (tmp_path / "t" / "raw").exists()
    got = sorted(token_files.read_token_files(files, ids).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, *_ in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array([*plain(t), 0], "<u4").tobytes() for _, t, *_ in rows)


def test_packing_of_very_long_texts(spark, plain):
    text = "word " * 60_000
    rows = sorted(packing.best_fit_pack(docs(spark, [text, "short"]), common.byte_bpe()).collect(), key=lambda r: (r.doc_id, r.piece))
    ids = np.array([*plain(text), 2], "<u4")
    mine = [r for r in rows if r.doc_id == 0]
    assert sum(r.length for r in mine) == len(ids) and mine[0].length == (len(ids) - 1) % 1024 + 1
    assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    assert len({r.sequence_id for r in mine}) == len(mine)
