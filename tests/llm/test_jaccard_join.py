"""N-gram Jaccard join against brute force; R-tree bound; odd rows."""

import random
import re

import numpy as np
import pandas as pd

from wavecrawl.llm import jaccard_join as J


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b]:
                    c = len(sets[a] & sets[b])
                    if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
    return {(i, len(sets[i]), label[i]) for i in sets}


def test_against_brute_force(spark):
    r = random.Random(9)
    rows = []
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice((6, 30, 120, 300)))]
        for _ in range(r.randint(1, 8)):
            base = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                base[r.randrange(len(base))] = f"e{r.randrange(9999)}"
            rows.append(" ".join(base))
    rows += [None, "", "One two", "one  TWO", "a b c d", " \t\n", "same " * 50, "same " * 9]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, label int")
    got = {tuple(x) for x in J.join(d).collect()}
    assert got == brute(rows)


def test_every_link(spark):
    r = random.Random(5)
    rows = []
    for _ in range(6):  # near copies of one text each: most links are between two that aren't the smallest
        base = [f"w{r.randrange(3000)}" for _ in range(80)]
        for _ in range(12):
            own = list(base)
            own[r.randrange(80)] = f"e{r.randrange(9999)}"
            rows.append(" ".join(own))
    rows += [rows[3], rows[3], rows[20], "", None]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = J.links(d)
    sets = [set(J.shingle_set(t).tolist()) for t in rows]
    first = {}
    cls = [first.setdefault(frozenset(s), i) if s else i for i, s in enumerate(sets)]
    reps = [i for i in range(len(rows)) if cls[i] == i and sets[i]]
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(want) > 300
    assert sorted(map(tuple, got.pairs.collect())) == sorted(want)
    members = {m.doc_id: (m.class_id, m.n_links) for m in got.members.collect()}
    assert members == {i: (cls[i], sum(cls[i] in p for p in want)) for i in range(len(rows))}


def test_bound_never_loses_a_pair():
    r = np.random.default_rng(1)
    base = r.integers(-(2**62), 2**62, 40_000)
    sets = [np.unique(base[: n][r.random(n) > 0.08]) for n in (50, 50, 400, 400, 39_000, 40_000)]
    v, n = np.stack([J.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    found = {(a, b) for x, y in J.rtree_pairs(v, n, v, n) for a, b in zip(x, y)}
    for a in range(6):
        for b in range(6):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 7 * c >= 3 * (n[a] + n[b]):
                assert (a, b) in found


def test_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, "long " * 100_000)], "doc_id long, text string")
    got = sorted(map(tuple, J.join(d).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 2, 1), (4, 1, 4)], key=str)
    assert J.join(d.limit(0)).count() == 0


def test_fine_bound_covers_the_overlap():
    r = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(r.integers(-(1 << 63), 1 << 63, r.integers(1, 3000), dtype=np.int64))
        b = np.unique(np.concatenate([r.choice(a, r.integers(0, len(a) + 1)), r.integers(-(1 << 63), 1 << 63, r.integers(1, 500), dtype=np.int64)]))
        va, vb = (J.count_vector(x, J.fine_groups(len(x))).tobytes() for x in (a, b))
        assert len(np.intersect1d(a, b)) <= J.fine_bound(va, vb)


def test_rare_shingles_come_first():
    text = "a b c d e f g h i j k l"
    s = J.shingle_set(text)
    ranks = np.zeros(J.SLOTS, np.uint8)
    ranks[J.slots_of(s[:4])] = 8
    (got,) = J._outlines(ranks)(iter([pd.DataFrame({"doc_id": [4], "text": [text]})]))
    assert got["n"][0] == 8 and got["prefix"][0].tolist() == s[4 : 4 + J.prefix_size(8)].tolist()


def test_large_blocks_are_cut(spark, monkeypatch):
    """Tiles of a few classes give the links, components and counts of whole blocks."""
    r = random.Random(3)
    rows = []
    for size in (40, 70, 100):
        base = [f"w{r.randrange(3000)}" for _ in range(size)]
        for _ in range(30):
            own = list(base)
            own[r.randrange(size)] = f"e{r.randrange(9999)}"
            rows.append(" ".join(own + [f"t{r.randrange(99)}" for _ in range(r.randrange(size // 20))]))
    rows += ["shared passage of a great many words " * 2 + f"x{k} y{k} z{k} v{k} u{k} o{k} p{k}" for k in range(60)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(J, "TILE", 7)
    monkeypatch.setattr(J, "BUDGET", 600)
    got = J.links(d)
    sets = [set(J.shingle_set(t).tolist()) for t in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(want) > 300
    assert sorted(map(tuple, got.pairs.collect())) == sorted(want)
    assert {m.doc_id: m.n_links for m in got.members.collect()} == {i: sum(i in p for p in want) for i in range(len(rows))}
    assert {tuple(x) for x in J.join(d).collect()} == brute(list(enumerate(rows)))


def test_buckets_give_the_smallest_holder():
    """Packed first shingles, over several buckets and rows, give the blocks that plain sets give."""
    r = random.Random(8)
    held = [(i, r.randrange(5, 90), np.unique(np.array([J.xxhash.xxh3_64_intdigest(b"%d" % r.randrange(300)) for _ in range(r.randrange(9))], np.uint64).view(np.int64))) for i in r.sample(range(10**12), 150)]
    half = [J.packed(*zip(*part), 7) for part in (held[:70], held[70:])]
    got = [J.shared_keys(f) for _, f in pd.concat(half).groupby("bucket")]
    want = set()
    for i, n, keys in held:
        for k in keys:
            holders = {j: m for j, m, other in held if k in other}
            near = [j for j, m in holders.items() if j != i and 4 * min(m, n) >= 3 * max(m, n)]
            want |= {(min(holders), i, n)} if near else set()
    assert {tuple(x) for f in got for x in f.itertuples(index=False)} == want and len(want) > 50


def test_hot_shingles_and_small_buckets(spark, monkeypatch):
    """Shingles taken as rows, and buckets of a few shingles, change nothing."""
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = [" ".join(base[: r.randrange(30, 60)] + [f"e{r.randrange(50)}" for _ in range(r.randrange(6))]) for _ in range(40)]
    docs = list(enumerate(rows)) + [(90, None), (91, "a b"), (92, "A b")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(J, "KEYS", 40)
    for hot in (0, 5, 1 << 16):
        monkeypatch.setattr(J, "HOT", hot)
        assert {tuple(x) for x in J.join(d).collect()} == brute(docs)


def test_needed_blocks(spark):
    rows = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (3, 4), (5, 5), (5, 6)]  # block 2 lies in block 1, block 3 doesn't
    got = J.needed_blocks(J.staged(spark.createDataFrame([(*x, 9) for x in rows], "lo long, id long, n long"), "test"))
    assert sorted((x.lo, x.id) for x in got.collect()) == [x for x in rows if x[0] != 2]
