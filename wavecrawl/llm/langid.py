"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes a blank, and its character 1- to
4-grams (blanks mark word ends) are hashed into ``BUCKETS`` rows of an embedding table. The
text's vector is the mean of its subwords' rows; a linear layer and softmax give one
probability for each language. Rows and layer are learned together by stochastic gradient
descent in numpy, on at most ``MAX_TRAIN_DOCS`` labelled documents (the only bound; every
document is scored, on its whole text).

A part of the sample is kept from training to calibrate: a temperature for the
probabilities, and the least probability at which accepted predictions reach
``TARGET_PRECISION``; ``accepted`` says whether a prediction reaches it. A text with no
letter (null and empty ones too) is ``und`` with score 0, not accepted; so is every text when
there is nothing to learn from. Equal texts get equal predictions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hashed_sample, per_text, staged, table

BUCKETS = 1 << 15
DIM = 16
MAX_TRAIN_DOCS = 6_000
EPOCHS = 6
TARGET_PRECISION = 0.98
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_GRAMS = (1, 2, 3, 4)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, blanks for all but letters, a blank at both ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 0xC0)
    letter &= ~((raw >= 0x2000) & (raw <= 0x206F)) & (raw != 0xD7) & (raw != 0xF7)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one blank after each word
    return np.where(letter, raw, np.uint64(32))[keep]


def subwords(text: str) -> np.ndarray:
    """Bucket of every 1- to 4-gram of the text, in numpy."""
    c = _codes(text)
    found, h = [], np.zeros(len(c), np.uint64)
    for n in _GRAMS:
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        found.append(((h + np.uint64(n)) * _MULT) >> np.uint64(64 - BUCKETS.bit_length() + 1))
    return np.concatenate(found).astype(np.int64)


_PACKED = np.dtype([("bucket", "<u2"), ("weight", "<f4")])


def _features(text: str) -> bytes:
    """The text's buckets and weights, six bytes each, in bucket order."""
    if not _LETTER.search(text):
        return b""
    counts = np.bincount(subwords(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    packed = np.empty(len(at), _PACKED)
    packed["bucket"], packed["weight"] = at, counts[at] / counts.sum()
    return packed.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(data, _PACKED)
    return packed["bucket"], packed["weight"]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: each subword's share of the logits
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str) -> tuple[str, float, bool]:
        if not self.langs or not _LETTER.search(text):
            return UNDETERMINED, 0.0, False
        logits = self.table[subwords(text)].mean(axis=0, dtype=np.float64) + self.bias
        p = _softmax(logits / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.least)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """SGD over (language, buckets, weights) rows; every fifth row calibrates (if there are enough)."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), bias, 1.0, 1.0)
    code = {k: i for i, k in enumerate(langs)}
    out += rng.normal(0, 0.1, out.shape)
    apart = [r for i, r in enumerate(rows) if i % 5 == 4] if len(rows) >= 50 else rows
    fit = [r for i, r in enumerate(rows) if i % 5 != 4] if len(rows) >= 50 else rows
    steps, at = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            lang, where, weight = fit[i]
            rate = 0.5 * (1 - at / steps) + 0.01
            at += 1
            x = weight @ emb[where]
            g = _softmax(x @ out + bias)
            g[code[lang]] -= 1
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= 0.05 * rate * g
            # the mean's gradient is small for each row: as many times larger a step, but never one that
            # moves the mean by more than the plain gradient would (texts of one subword)
            emb[where] -= (rate * min(20.0, 1.0 / float(weight @ weight))) * weight[:, None] * back
    share = (emb @ out).astype(np.float32)
    if not np.isfinite(share).all():
        raise ArithmeticError("training diverged")
    logits = np.array([w @ share[b] + bias for _, b, w in apart])
    truth = np.array([code[r[0]] for r in apart])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / heat)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-top, kind="stable")
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= TARGET_PRECISION
    least = float(top[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(langs, share, bias, heat, least)


def learn(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``MAX_TRAIN_DOCS`` rows where ``allowed`` holds and the language is set.

    Only the sample's subword weights reach the driver, packed to six bytes a pair (at most
    ``BUCKETS`` pairs a text), one partition after the other; texts repeat in one order whatever the partitions.
    """
    named = docs.where(allowed & F.col(lang_col).isNotNull())
    sample = hashed_sample(named.select("doc_id", text_col, lang_col), MAX_TRAIN_DOCS)
    packed = per_text(F.col(text_col), lambda t: (_features(t),), "data binary")
    got = sample.select(F.col(lang_col).alias("lang"), packed["data"].alias("data"))
    got = staged(got, "langid-sample")
    # a bounded sample; partitions are fetched one by one
    rows = sorted((r.lang, bytes(r.data)) for r in got.toLocalIterator())
    return train([(lang, *_unpacked(data)) for lang, data in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``language``: lang_pred, score, accepted. Map only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    kind = "lang_pred string, score double, accepted boolean"
    return docs.withColumn("language", per_text(F.col(text_col), lambda t, m: m.predict(t), kind, lambda: shared.value))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: learned where crc32(doc_id) mod 3 is not 1, applied to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = learn(docs, ~held_out)
    return identify(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "language.*")
