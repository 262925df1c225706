"""Toxicity: noisy-channel restoring of disguised words, then a score of the restored text.

A word is taken as disguised when it holds a digit or sign that stands for a letter, a letter
written three times or more, or single letters set apart. Its lattice has one step for each sign
and an edge for each letter that the sign may stand for; a repeated sign may also stand for
nothing. Words may end between any two letters set apart, and in a run without blanks beside a
sign that is no letter, which may also be skipped within a word. Viterbi decoding picks the
likeliest words: a marker word by its own share, any other by a character trigram model. Work
grows with the length of the run, which has no limit. The plain words of the run are scored too.

The character model counts trigrams of every text of the corpus (one fixed-size table, summed
by Spark), and of the marker words; letters outside a-z share one class. Marker words and their weights are learned from at most
``MAX_TRAIN_DOCS`` labelled documents, the only bound. A text's margin is the summed weight of
its distinct restored marker words, mapped to 0..1 by a logistic fit.

Null and empty texts have no words and get the base score. Without labels there are no
markers, and every score is 0. Map only, apart from the counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hashed_sample, staged, table

MAX_TRAIN_DOCS = 20_000
PREDICT_AT = 0.3
MIN_DOCS, MIN_RATIO = 4, 8.0  # a marker: in so many toxic documents, and so many times likelier there
MARKER_SHARE = 0.02  # weight of the marker words in the character model, and their share of the words
KEPT_WORDS = 300_000  # decoded words remembered by a worker; then it starts anew

# What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
_MAYBE_NOISE = "!|+("  # signs that also stand beside a word, for nothing
_PLAIN = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_EDGES = ".,;:?\"'`*#%&~-_=/\\<>[]{}^"
_APART = re.compile(r"(?<![^\s\"'(])(?:[^\W_]|[@$!|+€])(?:[ .\-_*](?:[^\W_]|[@$!|+€])){2,}(?![^\s\"'),.;:!?])")
_DISGUISED = re.compile(r"[0-9@$!|+(€]|([^\W\d_])\1\1")
_BASE = 28  # 0 for the edge of a word, a-z, and one class for all other letters


def _class(ch: str) -> int:
    return ord(ch) - 96 if "`" <= ch <= "z" else _BASE - 1  # '`' comes before 'a': the edge


def _trigrams(words: dict[str, int]) -> np.ndarray:
    """Counts of three letters in a row (two edges before a word, one after), in one array."""
    out = np.zeros(_BASE**3)
    for word, n in words.items():
        a = b = 0
        for ch in word + "`":
            c = _class(ch)
            out[(a * _BASE + b) * _BASE + c] += n
            a, b = b, c
    return out


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of the letter runs of every text: each task adds up its own, Spark sums them."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_BASE**3, np.int64)
        unknown = 255
        table_ = np.full(0x110000, unknown, np.uint8)  # signs outside ASCII are looked up when they come up
        table_[:128] = 0
        table_[97:123] = np.arange(1, 27)
        table_[65:91] = np.arange(1, 27)
        for frame in frames:
            for t in frame["t"]:
                if not t:
                    continue
                at = np.frombuffer(t.encode(), np.uint8) if t.isascii() else np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
                c = table_[at]
                if (c == unknown).any():
                    for code in np.unique(at[c == unknown]).tolist():
                        table_[code] = _BASE - 1 if chr(code).isalpha() else 0
                    c = table_[at]
                # keep letters and one edge between runs; a second edge before each run
                keep = c > 0
                keep[1:] |= c[:-1] > 0
                c = np.concatenate(([0, 0], c[keep], [0])).astype(np.int64)
                b = c[1:-1]
                a = np.where(b > 0, c[:-2], 0)  # what is before an edge doesn't matter
                live = (b > 0) | (c[2:] > 0)
                total += np.bincount(((a * _BASE + b) * _BASE + c[2:])[live], minlength=_BASE**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "n": total[at]})

    rows = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_BASE**3)  # at most 28^3 rows come back
    out[rows["k"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def _plain_of(letter: str) -> str:
    """The letter without its accents."""
    return unicodedata.normalize("NFKD", letter)[0]


@dataclass
class Model:
    log_p: np.ndarray  # 28 x 28 x 28: log probability of a letter after two
    weights: dict[str, float]
    scale: float
    base: float
    known: dict[str, frozenset] = field(default_factory=dict)

    def __post_init__(self):
        self.next: list[dict[str, int]] = [{}]  # a tree of the marker words: node and letter to node
        self.ends: dict[int, tuple[str, float]] = {}  # node to the marker word that ends there, and its log share
        others = sorted({ch for w in self.weights for ch in w if _class(ch) == _BASE - 1})
        self.logs = self.log_p.tolist()
        self.one_of = -float(np.log(max(len(others), 1)))  # which letter of the class of all others
        self.accented: dict[str, str] = {}
        for ch in others:
            self.accented[_plain_of(ch)] = self.accented.get(_plain_of(ch), "") + ch
        for w in sorted(self.weights):
            node = 0
            for ch in w:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                node = self.next[node][ch]
            a = b = 0
            spelled = 0.0
            for ch in w + "`":
                c = _class(ch)
                spelled += self.logs[a][b][c] + (self.one_of if c == _BASE - 1 else 0.0)
                a, b = b, c
            share = np.logaddexp(np.log(MARKER_SHARE / len(self.weights)), np.log(1 - MARKER_SHARE) + spelled)
            self.ends[node] = w, float(share)

    def lattice(self, word: str, apart: bool) -> tuple[list[tuple[str, bool, bool]], list[bool]]:
        """Steps (letters that a sign may stand for, whether it may stand for nothing, whether it is
        a letter itself), and whether a word may begin before each step and after the last."""
        steps, cuts, cut, before = [], [], True, ""
        for ch in word:
            letters = SIGNS.get(ch, "")
            if letters:
                letters += "".join(self.accented.get(x, "") for x in letters)
            elif ch.isalpha():
                letters = ch + (_plain_of(ch) if not ch.isascii() and "a" <= _plain_of(ch) <= "z" else "")
            if letters:
                noise = ch in _MAYBE_NOISE
                steps.append((letters, noise or ch == before, ch.isalpha()))
                cuts.append(cut or noise or apart)
                cut = noise
            else:
                cut = True  # any other sign is noise
            before = ch
        return steps, [*cuts, True]

    def reached(self, steps, cuts) -> bool:
        """Whether any spelling of the lattice has a marker word between two places where words may end."""
        live: set = set()
        for i, (letters, empty, plain) in enumerate(steps):
            step = set(live) if empty else set()
            if cuts[i]:
                live.add((0, False))
            for node, has in live:
                for ch in letters:
                    if ch in self.next[node]:
                        step.add((self.next[node][ch], has or plain))
            if cuts[i + 1] and any(has and node in self.ends for node, has in step):
                return True
            live = step
        return False

    def decode(self, steps, cuts) -> set:
        """Marker words of the likeliest reading; on a tie, the reading with a marker word."""
        logs, other = self.logs, float(np.log(1 - MARKER_SHARE))
        ended = (0.0, None)  # score and marker words (a linked list) of the best reading that ends here
        words: dict = {}  # last two letters of a word that goes on: the same
        marks: dict = {}  # node in the tree, whether a letter was met: the same
        for i, (letters, empty, plain) in enumerate(steps):
            if ended:
                if (0, 0) not in words or ended[0] > words[0, 0][0]:
                    words[0, 0] = ended
                if (0, False) not in marks or ended[0] > marks[0, False][0]:
                    marks[0, False] = ended
            word_step, mark_step = (dict(words), dict(marks)) if empty else ({}, {})
            for (a, b), (p, path) in words.items():
                row = logs[a][b]
                for ch in letters:
                    c = _class(ch)
                    q = p + row[c] + (self.one_of if c == _BASE - 1 else 0.0)
                    if (b, c) not in word_step or q > word_step[b, c][0]:
                        word_step[b, c] = (q, path)
            for (node, has), (p, path) in marks.items():
                for ch in letters:
                    if ch in self.next[node]:
                        new = (self.next[node][ch], has or plain)
                        if new not in mark_step or p > mark_step[new][0]:
                            mark_step[new] = (p, path)
            words, marks, ended = word_step, mark_step, None
            if cuts[i + 1]:
                for (node, has), (p, path) in marks.items():
                    if has and node in self.ends:
                        w, share = self.ends[node]
                        if ended is None or p + share > ended[0]:
                            ended = (p + share, (path, w))
                for (a, b), (p, path) in words.items():
                    q = p + logs[a][b][0] + other if b else p
                    if ended is None or q > ended[0]:
                        ended = (q, path)
        found, path = set(), ended[1] if ended else None
        while path:
            path, w = path
            found.add(w)
        return found

    def restored(self, word: str, apart: bool = False) -> frozenset:
        """Marker words that a lower-case run holds: as it stands, and as decoded; ``apart``: its letters were set apart."""
        key = " " + word if apart else word
        got = self.known.get(key)
        if got is None:
            found = {w for w in _PLAIN.findall(word) if w in self.weights}
            if (apart or _DISGUISED.search(word)) and any(c.isalpha() for c in word):
                steps, cuts = self.lattice(word, apart)
                if self.reached(steps, cuts):
                    found |= self.decode(steps, cuts)
            got = frozenset(found)
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[key] = got
        return got

    def score(self, text: str) -> float:
        low = text.lower()
        words = set(low.split())
        found = words & self.weights.keys()
        triple = _TRIPLE.search(low) is not None
        for word in words:
            if not word.isalpha():
                core = word.strip(_EDGES)
                if not core.isalpha():
                    found |= self.restored(word)
                    continue
                if core in self.weights:
                    found.add(core)
                word = core
            if triple and _TRIPLE.search(word):
                found |= self.restored(word)
        for m in _APART.finditer(low):
            found |= self.restored(m[0][::2], True)
        margin = sum(self.weights[w] for w in sorted(found))
        return float(1 / (1 + np.exp(-(self.base + self.scale * margin))))


def _fit(margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and base of a logistic curve, by damped Newton steps; row i counts ``n[i]`` times."""
    x = np.stack([margin, np.ones(len(y))], axis=1)
    theta = np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (n * (p - y)) + 0.05 * theta
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        theta -= np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(theta[0]), 0.0), float(theta[1])


def markers(counts: dict[str, tuple[int, int]], n1: float, n0: float) -> dict[str, float]:
    """Smoothed log ratios of the words that mark toxic texts; ``counts``: toxic and other documents of a word."""
    weights = {}
    for w, (k1, k0) in sorted(counts.items()):
        ratio = ((k1 + 0.5) / (n1 + 1)) / ((k0 + 0.5) / (n0 + 1))
        # a word must also beat what chance allows for the many words tried
        if len(w) >= 3 and k1 >= MIN_DOCS and ratio >= MIN_RATIO and k1 / n1 - k0 / n0 > 6 * np.sqrt((k1 + k0) / (n1 + n0) / n1):
            weights[w] = float(np.log(ratio))
    return weights


def character_model(corpus: np.ndarray, words) -> np.ndarray:
    """Log probability of a letter after two, of the corpus' trigrams mixed with those of ``words``."""
    counts = corpus / max(corpus.sum(), 1.0) * (1 - MARKER_SHARE)
    marks = _trigrams({w: 1 for w in words})
    counts = (counts + marks / max(marks.sum(), 1.0) * MARKER_SHARE).reshape(_BASE, _BASE, _BASE) + 1e-9
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def learn(docs: DataFrame, corpus: DataFrame, labels: DataFrame, allowed: Column, text_col: str = "text") -> Model:
    """Model from the labelled rows of ``docs`` that ``allowed`` admits, and every text of ``corpus``.

    Words are counted by Spark; the driver gets those of ``MIN_DOCS`` toxic documents, and one
    margin per label and value. Null labels don't count; of a document with several labels,
    the largest counts.
    """
    marked = labels.where(F.col("toxic").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = hashed_sample(marked, MAX_TRAIN_DOCS)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("\\p{L}+"), F.lit(0)))
    rows = docs.select("doc_id", text_col).join(F.broadcast(sample), "doc_id").select("toxic", words.alias("words"))
    rows = staged(rows, "toxic-words")
    size = rows.agg(F.sum("toxic"), F.count("*")).first()
    n1, n = float(size[0] or 0), float(size[1])
    log_p = lambda w: character_model(corpus_trigrams(corpus, text_col), w)
    if not n1:
        return Model(log_p([]), {}, 0.0, -30.0)
    counted = rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    counted = counted.where((F.col("k1") >= MIN_DOCS) & (F.length("w") >= 3)).collect()
    weights = markers({r["w"]: (r["k1"], r["k0"]) for r in counted}, max(n1, 1.0), max(n - n1, 1.0))
    held = F.array_sort(F.array_intersect("words", F.array(*map(F.lit, sorted(weights))).cast("array<string>")))
    held = rows.select("toxic", held.alias("w")).groupBy("toxic", "w").agg(F.count("*").alias("n")).collect()
    margin = np.array([sum(weights[w] for w in r["w"]) for r in held])
    scale, base = _fit(margin, np.array([r["toxic"] for r in held], float), np.array([r["n"] for r in held], float))
    return Model(log_p(weights), weights, scale, base)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the double column ``score``, replacing one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 28^3 numbers and the marker words

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([shared.value.score(t if t is not None else "") for t in s], dtype=float)

    return docs.withColumn("score", run(F.col(text_col)))


def _learned(spark, docs: DataFrame, sf_dir: str) -> Model:
    allowed = fold_of(F.col("doc_id"), 4) != 2
    return learn(table(spark, sf_dir, "documents"), docs, table(spark, sf_dir, "labels"), allowed)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: learned where crc32(doc_id) mod 4 is not 2, applied to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = _learned(spark, docs, sf_dir)
    return score(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, columns as they are."""
    model = _learned(spark, docs, sf_dir)
    marked = score(docs.withColumn("__text", F.col("text")), model, "__text") if "score" not in docs.columns else None
    if marked is None:  # a clashing column: score a renamed copy
        marked = score(docs.withColumnRenamed("score", "__own"), model).withColumnRenamed("score", "__s").withColumnRenamed("__own", "score")
    else:
        marked = marked.withColumnRenamed("score", "__s")
    return marked.where(F.col("__s") < PREDICT_AT).select(*docs.columns)
