"""Counts against the tokenizers library's Unigram model on the same vocabulary."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from wavecrawl.llm import token_counts as C


def library(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(C.MARK), normalizers.Replace(" ", C.MARK)])
    return t


@pytest.fixture(scope="module")
def full():
    pieces = C.pieces_of(C.default_vocabulary())
    return C.PieceCounter(pieces), library(pieces, True)


TEXT = st.lists(st.sampled_from(["the ", "a", " ", "  ", "tion", "é", "\n", "\t", "1", "日本", "\U0001f600", "…", "ab", "▁", "zz"]), max_size=30).map("".join)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_full_vocabulary(full, text):
    counter, ours = full
    assert counter.cut
    assert counter.total(text)[0] == len(ours.encode(text, add_special_tokens=False).ids)


SMALL = [("<unk>", 0.0), (C.MARK, -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.5), ("aba", -3.5), (C.MARK + "a", -3.0), ("abab", -5.0)]


@given(st.text("abc é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_ties_and_unknown_runs(text):
    counter, ours = C.PieceCounter(SMALL), library(SMALL, False)
    assert not counter.cut  # halves: sums in order
    assert counter.total(text)[0] == len(ours.encode(text, add_special_tokens=False).ids)


def test_table_starts_anew(monkeypatch, full):
    monkeypatch.setattr(C, "KEPT_SEGMENTS", 3)
    counter, ours = C.PieceCounter(C.pieces_of(C.default_vocabulary())), full[1]
    text = "one two three four five one two six " * 3 + "x" * 200
    assert counter.total(text)[0] == len(ours.encode(text, add_special_tokens=False).ids)
    assert len(counter) <= 3


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "the the", 7), (3, "the the", 7), (4, "word " * 100_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = sorted((r.doc_id, r.tokens.n_tokens) for r in C.count_tokens(df).collect())
    assert got[:2] == [(1, 0), (2, 0)] and got[2] == got[3] and got[4][1] >= 100_000
    assert C.count_tokens(df.limit(0)).count() == 0


def test_query(spark, sf_dir, full):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = C.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(full[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert r.n_chars == len(texts[r.doc_id] or "")
