"""Packing: ids against the tokenizers library, gapless sequences, few bins, odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wavecrawl.llm import packing as P


def test_pack(spark):
    r = random.Random(2)
    words = ["the", "of", "Übung", "schön", "x1", "\n", "<|endoftext|>", "日本", "a.b", "  "]
    rows = [(i, " ".join(r.choices(words, k=int(r.paretovariate(0.8) * 20) % 5000))) for i in range(300)] + [(900, None), (901, ""), (902, "a b"), (902, "a b"), (None, "no id"), (903, "z" * 50_000)]
    d = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, piece int")
    got = P.pack(d).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        ends = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
    have = [(str(None if x.doc_id != x.doc_id else int(x.doc_id)), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples()]
    assert sorted(have) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and (s.offset.to_numpy() == np.r_[0, s.length.cumsum().to_numpy()[:-1]]).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.02 + 1
    assert P.pack(d.limit(0)).count() == 0


def test_evolve_is_no_worse_than_best_fit():
    r = random.Random(4)
    sizes = [r.randint(1, 1023) for _ in range(400)]
    bins: list = []
    P.best_fit(sizes, sorted(range(400), key=lambda p: -sizes[p]), bins, [])
    best = P.evolve(sizes, 1)
    assert sorted(p for b in best for p in b) == list(range(400)) and len(best) <= len(bins)
    assert all(sum(sizes[p] for p in b) <= 1024 for b in best)


def test_a_million_blanks():
    from wavecrawl.llm import packing

    text = "a" + " " * 1_000_000 + "b"
    pieces = list(packing.cut(text, packing.default_vocabulary()))
    ids = packing._library(packing.default_vocabulary().replace(".tiktoken", ".json")).encode(text, add_special_tokens=False).ids
    assert sum(n for *_, n, _ in pieces) == len(ids) + 1


def test_elites_enter_the_next_island():
    """Full bins of another packing are taken over, and the result holds every piece once."""
    r = random.Random(6)
    sizes = [r.randint(1, 700) for _ in range(300)]
    own = [[p] for p in range(300)]  # the worst packing there is
    elite: list = []
    P.best_fit(sizes, sorted(range(300), key=lambda p: -sizes[p]), elite, [])
    elite = [b for b in elite if sum(sizes[p] for p in b) >= P.ELITE]
    child = P.crossover(own, elite, sizes, random.Random(1))
    assert sum(b in child for b in elite) >= len(elite) // 4
    best = P.evolve(sizes, 3, own, elite)
    assert sorted(p for b in best for p in b) == list(range(300)) and len(best) < 300


def test_islands_of_a_group(spark):
    """Islands that exchange elites give one packing of every piece, no worse than best fit."""
    r = random.Random(7)
    sizes = [r.randint(1, 900) for _ in range(500)]
    pieces = spark.createDataFrame([(k % 2, k * 3, n) for k, n in enumerate(sizes)], "group long, uid long, length long")
    got = P.grouped_search(pieces).toPandas()
    assert sorted(got.uid) == [k * 3 for k in range(500)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() == s.fill.iloc[0] <= 1024 and (s.offset.to_numpy() == np.r_[0, s.length.cumsum().to_numpy()[:-1]]).all()
    plain = 0
    for g in range(2):
        own = sizes[g::2]
        bins: list = []
        P.best_fit(own, sorted(range(len(own)), key=lambda p: -own[p]), bins, [])
        plain += len(bins)
    assert got.sequence_id.nunique() <= plain
