"""Runs against a plain comparison of every word with the word q before it, for every q."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wavecrawl.llm import periodic_runs as P


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if j > i and length >= max(12, 2 * q) and not any(all(w[k] == w[k - d] for k in range(s + d, j)) for d in range(1, q)):
                out.append((s, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeats(draw_words, start, period):
    return [draw_words[k] if k < start else draw_words[start + (k - start) % period] for k in range(len(draw_words))]


WORDS = st.one_of(
    st.lists(st.sampled_from("ab"), max_size=60),
    st.lists(st.sampled_from("abcd"), max_size=80),
    st.tuples(st.lists(st.sampled_from("abc"), min_size=20, max_size=80), st.integers(0, 15), st.integers(1, 20)).map(lambda x: repeats(*x)),
    st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=7), st.integers(1, 12)).map(lambda x: (x[0] * x[1] + ["z"]) * 2),
)


@given(WORDS)
@settings(max_examples=600, deadline=None)
def test_runs(words):
    want = plain_runs(words)
    assert [tuple(r) for r in P.runs_of(words)] == want
    every = P.runs_within([ord(w) for w in words])  # without leaving stretches out
    assert sorted((tuple(r) for r in every), key=lambda r: (r[0], r[2])) == want


@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_stretches_hold_every_run(ids, rounds):
    spans = P.repeating_stretches(np.array(ids, np.int64), rounds)
    for s, length, _ in plain_runs(ids):
        assert any(a <= s and s + length <= b for a, b in spans)


@given(st.lists(st.sampled_from([0, 1, 2]), max_size=50))
@settings(max_examples=200, deadline=None)
def test_squares_are_latest_and_longest(ids):
    """Each reported square: the longest suffix shared with the prefix that ends d words earlier."""
    found = []
    P.squares(ids, lambda i, d, longest: found.append((i, d, longest)))
    for i, d, longest in found:
        common = next((k for k in range(i - d) if ids[i - 1 - k] != ids[i - d - 1 - k]), i - d)
        assert common == longest >= d
    for s, length, q in plain_runs(ids):
        for i in range(s + 2 * q, s + length + 1):
            assert (i, q, i - s - q) in found


def test_fibonacci_and_one_word():
    a, b = ["a"], ["a", "b"]
    while len(b) < 200:
        a, b = b, b + a
    assert [tuple(r) for r in P.runs_of(b)] == plain_runs(b)
    many = ["x"] * 50_000
    assert P.runs_of(many) == [(0, 50_000, 1)] and P.collapsed(many, P.runs_of(many)) == ["x"]


def test_long_text_with_long_period():
    rng = np.random.default_rng(2)
    unit = [str(x) for x in rng.integers(0, 5000, 20_000)]
    words = ["begin", *unit, *unit, *unit[:500], "end"]
    assert P.runs_of(words) == [(1, 40_500, 20_000)]
    assert P.collapsed(words, P.runs_of(words)) == ["begin", *unit, "end"]


def row(text, doc_id):
    """The contract, word for word."""
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w) if n < 3000 else [tuple(r) for r in P.runs_of(w)]
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
    if best is None:
        return (len(runs), None, None, None, None, *digest)
    return (len(runs), best[1], -best[0], best[2], 1000 * -best[0] // best[2], *digest)


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "x " * 40, "a b " * 9 + "c " * 14, "a  b  c", "to be " * 6 + "or " + "to be " * 6, "u v w x y z " * 2, "u v w x y z q " * 2]
    rows = [(k, texts[k % len(texts)], "own") for k in range(120)] + [(7, texts[7], "own"), (None, "m " * 30, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, periodic string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, *(r[c] for c in COLUMNS)) for r in P.query(spark, str(tmp_path)).collect()]
    want = [(k, *row(t, k)) for k, t, _ in rows if k is not None]
    assert sorted((g for g in got if g[0] is not None), key=repr) == sorted(want, key=repr)
    assert [g[1:5] for g in got if g[0] is None] == [(1, 0, 30, 1)]
    out = P.find_runs(df.select("doc_id", "text", F_lit("x")))
    assert out.columns == ["doc_id", "text", "x", "periodic"]
    assert [tuple(r) for r in out.where("doc_id = 4").first().periodic.runs] == [(0, 18, 2), (18, 14, 1)]
    assert P.find_runs(df.limit(0)).count() == 0


def F_lit(name):
    from pyspark.sql import functions as F

    return F.lit(1).alias(name)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = P.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == row(texts[r.doc_id], r.doc_id), r.doc_id
    assert sum(r.n_runs > 0 for r in got) > 10
