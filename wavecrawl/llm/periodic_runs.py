"""Periodic runs of words: a suffix automaton whose link tree is a link-cut tree, accessed at each word.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST``, 2 q)
words that no neighbour extends with the same period. Words are appended to a suffix automaton one
by one. Its suffix links form a tree that is kept as a link-cut tree: preferred paths are splay
trees, new states hang below their link, a clone is put into the path above the state it splits.
After the word at i, the path from the newest state up to the root is accessed; each piece of an
older preferred path on it holds the substrings that end at i and ended last at one earlier place
p, the longest of them ``longest`` words long. Then the whole path takes the colour i. With distance
d = i - p <= longest the words before i are a square of period d, which starts at i - d - longest + 1
and can't start earlier; d is its smallest period, since a smaller one would have been a later last
end. To the right the square is extended word by word, once for each run. Pieces are O(n log n) in all.

A run of ``LEAST`` = 12 words or more repeats at least 6 words in a row inside itself, so stretches
of words whose 6-word windows occur only once among them can hold no run (hashes may collide, which
only keeps a stretch) and are not appended to an automaton. A long document is one row and one task
by nature; its memory grows with the longest stretch that repeats itself.

Null and empty texts have no words and no runs: null start, length, period, exponent; both digests
are those of the empty string. Repeated doc_ids are rows of their own, ties go to the smallest start,
then period. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LEAST = 12  # words of the shortest run
WINDOW = LEAST // 2  # words that such a run surely repeats in a row
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Run(NamedTuple):
    start: int
    length: int
    period: int


class LinkCut:
    """The link tree as preferred paths. Depth grows to the right inside a splay tree; ``up`` is the
    splay parent, or for a splay root the state above its path. ``last`` counts at splay roots: the
    newest end of every substring on the path. State 0 stands for none."""

    def __init__(self):
        self.lower, self.upper, self.up, self.last = [0], [0], [0], [0]  # upper: shallower states

    def add(self, above: int) -> None:
        """A new state below ``above``."""
        self.lower.append(0)
        self.upper.append(0)
        self.up.append(above)
        self.last.append(0)

    def splay(self, x: int) -> None:
        lower, upper, up = self.lower, self.upper, self.up
        while True:
            p = up[x]
            if not p:
                return
            if upper[p] == x:
                first = True
            elif lower[p] == x:
                first = False
            else:
                return
            g = up[p]
            side = 0
            if g:
                side = 1 if upper[g] == p else 2 if lower[g] == p else 0
            if side and (side == 1) == first:  # same side twice: the parent goes up first
                if first:
                    c = upper[g] = lower[p]
                    lower[p] = g
                else:
                    c = lower[g] = upper[p]
                    upper[p] = g
                if c:
                    up[c] = g
                above = up[p] = up[g]
                up[g] = p
                if above:
                    if upper[above] == g:
                        upper[above] = p
                    elif lower[above] == g:
                        lower[above] = p
                    else:
                        self.last[p] = self.last[g]
                else:
                    self.last[p] = self.last[g]
                g, side = above, 0
                if above:
                    side = 1 if upper[above] == p else 2 if lower[above] == p else 0
            if first:
                c = upper[p] = lower[x]
                lower[x] = p
            else:
                c = lower[p] = upper[x]
                upper[x] = p
            if c:
                up[c] = p
            up[p] = x
            up[x] = g
            if side == 1:
                upper[g] = x
            elif side == 2:
                lower[g] = x
            else:
                self.last[x] = self.last[p]
                return

    def put_above(self, q: int, clone: int) -> None:
        """``clone`` (just added) becomes the state between q and the one above q, on q's path."""
        self.splay(q)
        rest = self.upper[q]
        self.upper[clone], self.lower[clone] = rest, 0
        if rest:
            self.up[rest] = clone
        self.upper[q] = clone
        self.up[clone] = q

    def access(self, state: int, end: int, longest: list[int], found) -> None:
        """Colours the path from ``state`` up with ``end``; ``found(p, longest)`` for each older piece."""
        lower, up, last = self.lower, self.up, self.last
        below, x = 0, state
        while x:
            self.splay(x)
            p = last[x]
            if p and end - p <= longest[x]:
                found(p, longest[x])
            rest = lower[x]
            if rest:
                last[rest] = p
            lower[x] = below
            below, x = x, up[x]
        last[below] = end


def squares(words: list[int], found) -> None:
    """Appends all words; ``found(i, d, longest)`` (i from 1) for every square that ends at i."""
    tree = LinkCut()
    tree.add(0)  # state 1 is the empty substring
    longest, link = [0, 0], [0, 0]
    key, target = [-1, -1], [0, 0]  # the first transition of a state; more are in ``more``
    more: dict[int, dict[int, int]] = {}
    newest, end = 1, 0

    def seen(p: int, length: int) -> None:
        found(end, end - p, length)

    for end, w in enumerate(words, 1):
        state = len(longest)
        longest.append(end)
        link.append(0)
        key.append(-1)
        target.append(0)
        p = newest
        while p:
            if key[p] == w:
                q = target[p]
                break
            if key[p] < 0:
                key[p], target[p] = w, state
            else:
                other = more.get(p)
                if other is None:
                    more[p] = {w: state}
                elif w in other:
                    q = other[w]
                    break
                else:
                    other[w] = state
            p = link[p]
        else:
            q = 1
        if not p:
            link[state] = 1
            tree.add(1)
        elif longest[p] + 1 == longest[q]:
            link[state] = q
            tree.add(q)
        else:
            clone = state + 1
            longest.append(longest[p] + 1)
            link.append(link[q])
            key.append(key[q])
            target.append(target[q])
            if q in more:
                more[clone] = dict(more[q])
            tree.add(clone)  # the new state, below the clone
            tree.add(0)
            tree.put_above(q, clone)
            link[q] = link[state] = clone
            while p:
                if key[p] == w:
                    if target[p] != q:
                        break
                    target[p] = clone
                else:
                    other = more.get(p)
                    if other is None or other.get(w) != q:
                        break
                    other[w] = clone
                p = link[p]
        tree.access(state, end, longest, seen)
        newest = state


def runs_within(words: list[int]) -> list[Run]:
    """All runs of a list of word numbers, in no order."""
    out: list[Run] = []
    known: dict[int, int] = {}  # period -> last word (from 1) of the newest run with it
    n = len(words)

    def found(i: int, d: int, longest: int) -> None:
        if known.get(d, 0) >= i:
            return
        end = i
        while end < n and words[end] == words[end - d]:
            end += 1
        known[d] = end
        start = i - d - longest
        if end - start >= max(LEAST, 2 * d):
            out.append(Run(start, end - start, d))

    squares(words, found)
    return out


_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 % (1 << 64) for k in range(WINDOW)], np.uint64) | np.uint64(1)


def _scattered(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def repeating_stretches(ids: np.ndarray, rounds: int = 6) -> list[tuple[int, int]]:
    """Ranges of words that together hold every run: each word lies in a window that repeats within its range.

    Ranges are cut down ``rounds`` times; stopping earlier or later changes no run.
    """
    todo, out = [(0, len(ids), rounds)], []
    while todo:
        a, b, left = todo.pop()
        m = b - a - WINDOW + 1
        if b - a < LEAST:
            continue
        if not left:
            out.append((a, b))
            continue
        mixed = _scattered(ids[a:b])
        window = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            window += mixed[k : k + m] * _MIX[k]
        order = np.argsort(window)
        ranked = window[order]
        twin = np.zeros(m + 1, bool)
        twin[1:m] = ranked[1:] == ranked[:-1]
        twice = np.zeros(m, bool)
        twice[order] = twin[:-1] | twin[1:]
        if not twice.any():
            continue
        step = np.zeros(b - a + 1, np.int64)
        starts = np.flatnonzero(twice)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + WINDOW, -1)
        covered = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if s == 0 and e == b - a:
                out.append((a, b))
            else:
                todo.append((a + s, a + e, left - 1))
    return out


def runs_of(words: list[str]) -> list[Run]:
    """All runs by start, then period."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out = [
        Run(a + r.start, r.length, r.period) for a, b in repeating_stretches(ids) for r in runs_within(ids[a:b].tolist())
    ]
    return sorted(out, key=lambda r: (r.start, r.period))


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        step[r.start + r.period] += 1
        step[r.start + r.length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def repeated_tail(words: list[str], doc_id: str | None) -> list[str]:
    """The contract's words: of one document in ten, all from some word on repeat with some period (null ids: none)."""
    h = zlib.crc32((doc_id or "").encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    times, over = divmod(n - a, p)
    return words[:a] + unit * times + unit[:over]


RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, text_col: str = "text", out_col: str = "periodic") -> DataFrame:
    """``docs`` with the struct column ``periodic``: runs (by start, then period) and the collapsed text. Map only."""

    def one(text: str):
        words = words_of(text)
        runs = runs_of(words)
        return runs, " ".join(collapsed(words, runs))

    @F.pandas_udf(RESULT)  # not an iterator, so that it shares a worker with a plain one below it
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t or "") for t in texts], columns=["runs", "collapsed"])

    return docs.withColumn(out_col, run(F.col(text_col)))


def with_repeated_tails(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts that the query looks at: words joined by one space, of some documents with a repeated tail."""
    @F.pandas_udf("string")
    def run(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([" ".join(repeated_tail(words_of(t or ""), i)) for t, i in zip(texts, ids)], dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col), F.col("doc_id").cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the longest run, all runs and the collapsed text of every whole document, as digests."""
    docs = with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.col("periodic.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = find_runs(docs).select("doc_id", F.col("periodic.collapsed").alias("collapsed"), runs.alias("runs"), best.alias("best"), lines.alias("lines"))
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
