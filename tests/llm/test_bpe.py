"""Encoding and decoding against the tokenizers library on the same file."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavecrawl.llm import bpe as B


@pytest.fixture(scope="module")
def both():
    path = B.default_vocabulary()
    return B.codec(path), Tokenizer.from_file(path)


def same(both, text):
    own, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


PIECES = ["the ", "a", " ", "   ", "tion", "é", "\n", "\t", "1", "23", "日本", "\U0001f600", "…", "'ll", "'", "<|endoftext|>", "<|endof", "|>", "\x00", "\x1c", "​", "é", "\xa0"]


@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_library(both, text):
    same(both, text)


@given(st.lists(st.integers(0, 50256), max_size=20))
@settings(max_examples=200, deadline=None)
def test_decode_any_ids(both, ids):
    """Ids that break UTF-8 sequences too."""
    own, library = both
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def lowest_first(own, ids):
    """Merges by looking at all pairs each time."""
    ids = list(ids)
    while True:
        ranked = [(own.rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in own.rank]
        if not ranked:
            return ids
        rank, k = min(ranked)
        ids[k : k + 2] = [own.made[rank]]


@given(st.text("abcdeht in", min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_segment_tree(both, word):
    own = both[0]
    ids = [own.byte_id[b] for b in word.encode()]
    assert own.merge(list(ids)) == lowest_first(own, ids)
    some = [word.encode(), word.encode()[1:], b""]
    rows = [np.frombuffer(x, np.int32).tolist() for x in own.merge_rows(some)]
    assert rows == [lowest_first(own, [own.byte_id[b] for b in x]) for x in some]


def byte_text(own, text):
    signs = B.byte_signs()
    return ["".join(signs[b] for b in w.encode()) for w in own.cut(text)]


def test_every_code_point(both):
    """Word borders agree with the library for each letter, digit, blank and sign."""
    own, library = both
    for first in range(0, 0x110000, 1024):
        signs = [chr(c) for c in range(first, first + 1024) if not 0xD800 <= c <= 0xDFFF]
        text = " ".join(f"x{c} 1{c} .{c}" for c in signs)
        signs = byte_text(own, text)
        assert signs == [w for w, _ in library.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 100_000, "ab" * 60_000, "x" * 99_999 + "é", "(" * 70_000])
def test_long_words(both, text):
    same(both, text)


def test_kept_words_start_anew(both, monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 3)
    own = B.Codec(B.read_spec(B.default_vocabulary()), both[0].words.pattern)
    for text in ["one two three", "four five one", "two six", "x" * 200, "one two three"]:
        assert own.encode(text) == both[0].encode(text)
        assert len(own.kept) <= 6 and len(own.older) <= 6 and "x" * 200 not in own.kept


def test_other_models_are_refused(both):
    spec = B.read_spec(B.default_vocabulary())
    for change in ({"normalizer": {"type": "NFC"}}, {"post_processor": {"type": "x"}}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            B.Codec(spec | change, both[0].words.pattern)


def test_slices(both, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "SLICE_BYTES", 10)
    texts = pa.record_batch([pa.array(["abcd", None, "x" * 30, "", "ab", "cd", "efghijkl"])], ["text"])
    parts = list(B._slices(iter([texts, texts.slice(0, 0)]), "text"))
    assert [v for p in parts for v in p["text"].to_pylist()] == texts["text"].to_pylist() and len(parts) > 2
    own = both[0]
    lists = B._encoded(own, texts["text"])
    assert B._decoded(own, lists).to_pylist() == [t or "" for t in texts["text"].to_pylist()]
    coded = pa.record_batch([lists], ["ids"])
    assert [v for p in B._slices(iter([coded.slice(1)]), "ids") for v in p["ids"].to_pylist()] == lists.to_pylist()[1:]


def test_rows(spark, both):
    rows = [(1, None, 5), (2, "", 6), (3, "the the", 7), (3, "the the", 7), (None, "x <|endoftext|> y", 8), (4, " " * 300_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    done = B.decode(B.encode(df), text_col="again")
    assert done.columns == ["doc_id", "text", "decoded", "ids", "again"]
    assert B.round_trip(df).columns == ["doc_id", "text", "ids", "decoded"]  # a clashing column is replaced
    got = [(r.text, list(r.ids), r.again) for r in done.collect()]
    want = [(t, both[1].encode(t or "", add_special_tokens=False).ids, t or "") for _, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert B.decode(B.encode(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [464, None, 99_999_999])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in B.decode(odd).collect()} == {1: "", 2: "", 3: both[1].decode([464])}


def test_query(spark, sf_dir, both):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = B.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = both[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        text = both[1].decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
