"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each
character; dynamic programming keeps, for each end, the best score and the number of
pieces on that best path, and nothing else (no back pointers, no ids).

Rules, as in the ``Unigram`` model of the ``tokenizers`` library with its metaspace
normalisation (a mark before the text and in place of each blank):

- a path's score is the sum of its pieces' scores; of equal paths into one position, the
  one whose last piece starts earliest stays;
- a character that is no piece by itself may be an unknown, at the lowest score less 10;
  with byte pieces in the vocabulary it counts as one piece for each UTF-8 byte, else a run
  of unknowns counts as one piece.

No public unigram model is on hand, so the default takes pieces and scores of the public
32k SentencePiece file as they stand; ``tests/llm`` holds the counts against the library
on the same vocabulary.

If no piece holds a mark after another character, and scores are whole numbers (so sums
don't depend on their order), a best path can be cut before every run of marks: counts of
these segments are kept in a bounded table, as words repeat. Otherwise the whole text is one
segment. Null and empty texts have 0 pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: below the lowest score
KEPT_SEGMENTS = 300_000  # segments remembered by a worker; then it starts anew
LONGEST_KEPT = 64


class PieceCounter(dict):
    """Maps a segment to complex(pieces, score): both add up in one sum."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        names = {p for p, _ in pieces}
        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.found.add_word(piece, (len(piece), float(score)))
        self.found.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        crossing = any(MARK in p.lstrip(MARK) for p in names)
        self.cut = not crossing and all(float(s).is_integer() for _, s in pieces)
        self.segments = re.compile(f"{MARK}+[^{MARK}]*")

    def __missing__(self, segment: str) -> complex:
        value = self.best(segment)
        if len(segment) <= LONGEST_KEPT:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[segment] = value
        return value

    def best(self, segment: str) -> complex:
        """Pieces and score of the best path through one segment."""
        n = len(segment)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.found.iter(segment):  # longest first at each end
            ends[end].append(match)
        score, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end, matches in enumerate(ends):
            top = many = None
            unknown, single = False, False
            for length, value in matches:
                start = end + 1 - length
                single |= length == 1
                value += score[start]
                if top is None or value > top:
                    top, many = value, count[start] + 1
            if not single:
                value = self.unknown + score[end]
                if top is None or value > top:
                    added = len(segment[end].encode("utf-8", "surrogatepass")) if self.bytes else int(not open_unknown[end])
                    top, many, unknown = value, count[end] + added, True
            score[end + 1], count[end + 1], open_unknown[end + 1] = top, many, unknown
        return complex(count[n], score[n])

    def total(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.cut:
            whole = self.best(marked)
            return int(whole.real), whole.imag
        whole = sum(map(self.__getitem__, self.segments.findall(marked)), 0j)
        return int(whole.real), whole.imag


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(pieces_of(model_path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``tokens``: n_tokens, score of the best path.

    Map only; each worker reads the vocabulary file (``vocabulary``: its path, on every node).
    """

    def load():
        return _counter(vocabulary or default_vocabulary())

    return docs.withColumn("tokens", per_text(F.col(text_col), lambda t, c: c.total(t), "n_tokens long, score double", load))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: pieces of every whole document, and the score of its best path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "tokens.n_tokens", "tokens.score"
    )
