"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into ``FEATURES`` numbers (lengths, character classes,
repetition, word shapes); labels, language, source and id are never among them. Trees are
grown level by level in numpy on feature histograms (quantile bins, logistic loss), on at
most ``MAX_TRAIN_DOCS`` labelled documents: the only bound, every document is scored. The
grown trees are complete, so they flatten into three arrays (feature, threshold, leaf value)
and a batch walks all trees at once by index arithmetic.

Null and empty texts have the statistics of an empty text, and get its score. With no
labelled row every score is 0.5; with one label only, the score is near that label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hashed_sample, per_text, table

FEATURES = (
    "log_chars", "log_words", "letters", "digits", "blanks", "upper", "sentence_marks", "other_ascii", "not_ascii", "newlines",
    "char_entropy", "word_mean", "word_std", "word_max", "distinct_words", "top_word", "distinct_pairs", "same_as_previous",
    "distinct_lines", "line_mean", "marked_words", "shouted_words", "long_words", "one_char_words",
)
MAX_TRAIN_DOCS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 120, 4, 64, 0.12, 2.0, 8
PREDICT_AT = 0.3
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_SENTENCE = np.frombuffer(b".,;:!?'\"-()", np.uint8)


def statistics(text: str) -> list[float]:
    """The ``FEATURES`` of a whole text; ratios are 0 where there is nothing to divide by."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    by_code = np.bincount(np.minimum(codes, 128), minlength=129).astype(float)
    ascii_ = by_code[:128]
    per = 1 / max(n, 1)
    upper, lower, digits = ascii_[65:91].sum(), ascii_[97:123].sum(), ascii_[48:58].sum()
    marks = ascii_[_SENTENCE].sum()
    blanks = ascii_[9:14].sum() + ascii_[32]
    p = by_code[by_code > 0] * per
    words = _WORDS.findall(text)
    m = len(words)
    per_word = 1 / max(m, 1)
    sizes = np.fromiter(map(len, words), float, m) if m else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 0
    # shapes of distinct words, by how often each occurs
    marked = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?'\"-)")
    shouted = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    return [
        float(np.log1p(n)), float(np.log1p(m)), (upper + lower) * per, digits * per, blanks * per, upper * per, marks * per,
        (ascii_.sum() - upper - lower - digits - marks - blanks) * per, by_code[128] * per, ascii_[10] * per,
        float(-(p * np.log2(p)).sum()) + 0.0, float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())),
        len(counts) * per_word, max(counts.values(), default=0) * per_word, pairs / max(m - 1, 1),
        sum(a == b for a, b in zip(words, words[1:])) / max(m - 1, 1),
        len(set(lines)) / max(len(lines), 1), float(np.log1p(n / max(len(lines), 1))),
        marked * per_word, shouted * per_word, float((sizes > 20).mean()), float((sizes == 1).mean()),
    ]


@dataclass
class Forest:
    """Complete trees of one depth: inner nodes in heap order, then leaves."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray  # same; a value above it goes right
    leaf: np.ndarray  # trees x 2^depth
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values for each row of ``x``; all trees descend together."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.start + self.leaf[tree, at - inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int):
    """One complete tree: (features, thresholds, leaf values, leaf of each row)."""
    rows, width = binned.shape
    node = np.zeros(rows, np.int64)
    features, thresholds = [], []
    for level in range(depth):
        nodes = 1 << level
        best = np.zeros(nodes)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS)
        for f in range(width):
            key = node * BINS + binned[:, f]
            hist = [np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (g, h, None)]
            gl, hl, nl = (x[:, :-1] for x in hist)
            ga, ha, na = (x[:, -1:] for x in hist)
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(nl < MIN_ROWS) | (na - nl < MIN_ROWS)] = 0
            at = gain.argmax(axis=1)
            value = gain[np.arange(nodes), at]
            better = value > best + 1e-9
            best[better], feature[better], cut[better] = value[better], f, at[better]
        # a node without a gain sends every row left
        edges = np.array([cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(feature, cut)])
        features.append(feature)
        thresholds.append(edges)
        node = 2 * node + (binned[np.arange(rows), feature[node]] > cut[node])
    total_g, total_h = (np.bincount(node, w, 1 << depth) for w in (g, h))
    leaf = -RATE * total_g / (total_h + L2)
    return np.concatenate(features), np.concatenate(thresholds), leaf, node


def train(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0 and 1."""
    inner = (1 << DEPTH) - 1
    if len(y) == 0:
        return Forest(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), 0.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), start)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        feature, threshold, leaf, node = _grow(binned, p - y, p * (1 - p), cuts, DEPTH)
        margin += leaf[node]
        trees.append((feature, threshold, leaf))
    return Forest(*(np.stack(part) for part in zip(*trees)), start)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, text_col: str = "text") -> Forest:
    """Trees from at most ``MAX_TRAIN_DOCS`` labelled rows of ``docs`` for which ``allowed`` holds.

    Only their statistics reach the driver. Rows with a null label don't count; of a
    document with several labels, the largest counts, and of rows that repeat a doc_id, the
    one whose statistics come first.
    """
    marked = labels.where(F.col("quality").isNotNull() & allowed).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = hashed_sample(marked, MAX_TRAIN_DOCS)
    rows = docs.select("doc_id", text_col).join(F.broadcast(sample), "doc_id").select(
        "doc_id", "quality", per_text(F.col(text_col), lambda t: (statistics(t),), "x array<double>")["x"].alias("x")
    ).groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["doc_id"].to_numpy())) if len(rows) else []
    return train(x[order] if len(rows) else x, rows["quality"].to_numpy(float)[order] if len(rows) else np.zeros(0))


def score(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``docs`` with the double column ``score``, replacing one of that name. Map only."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees x 2^(depth+1) numbers

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([statistics(t if t is not None else "") for t in s], float).reshape(len(s), len(FEATURES))
            yield pd.Series(shared.value.scores(x))

    return docs.withColumn("score", run(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: learned where crc32(doc_id) mod 5 is not 0, applied to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    forest = learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, forest).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    )
