import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laserloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.RANKS), reason="no vocabulary")


@pytest.fixture(scope="module")
def known():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(known, enc, text):
    assert enc.encode([text])[0].tolist() == known.encode_ordinary(text)
    assert enc.count([text])[0] == len(known.encode_ordinary(text))


def plain(piece, ranks):
    """Brute force: merge the leftmost pair of least rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merge_is_the_plain_rule(piece):
    ranks = bpe.load_ranks(bpe.RANKS)
    assert bpe.merge(piece, ranks) == plain(piece, ranks)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=80))
def test_ties_go_left(word):
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aa": 4, b"aba": 5, b"abab": 6}
    assert bpe.merge(word.encode(), ranks) == plain(word.encode(), ranks)


def test_long_pieces(known, enc):
    for text in ("a" * 200_000, "ab" * 50_000, " " * 30_000 + "x", "é" * 20_000):
        assert enc.encode([text])[0].tolist() == known.encode_ordinary(text)


def test_forgetting_changes_nothing(known, enc, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 3)
    for text in ("one two three four five", "two three", "five six"):
        assert enc.encode([text])[0].tolist() == known.encode_ordinary(text)


def test_frames(spark, known):
    texts = ["", None, "Hello world", "<|endoftext|>", "x\r\n\ty", "Hello world", "long " * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' as ids", "1 as __text")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(d, "text").collect()}
    assert got == {i: known.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(d, "text").collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert bpe.encode_texts(d.limit(0), "text").count() == 0


def test_whole_table(spark, small, known):
    from laserloom.llm.queries import QUERIES

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["p6_ids"](spark, small)
    assert got.columns == ["doc_id", "ids"]
    assert {r.doc_id: r.ids for r in got.collect()} == {i: known.encode_ordinary(t) if t else [] for i, t in text.items()}
