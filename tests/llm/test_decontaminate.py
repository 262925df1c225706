"""Benchmark decontamination against brute force over every item-sized window; odd rows."""

import random
from collections import Counter

from wavecrawl.llm import decontaminate as D


def brute(docs, items):
    out = set()
    for item_id, item in items:
        w = (item or "").lower().split()
        if not w:
            continue
        k = min(5, len(w))
        a = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        for doc_id, text in docs:
            t = (text or "").lower().split()
            for s in range(max(1, len(t) - len(w) + 1)):
                x = t[s : s + len(w)]
                b = Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
                if sum((a & b).values()) >= 0.75 * sum((a | b).values()) > 0:
                    out.add((doc_id, item_id))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(8, 50)))) for i in range(25)] + [(90, "two Words"), (91, ""), (92, None), (93, "a a a a a a a a")]
    docs = []
    for i in range(150):
        words = r.choices(vocabulary, k=r.randint(0, 120))
        if i % 2:
            part = r.choice(items[:25])[1].split()
            for _ in range(r.randint(0, 3)):
                part[r.randrange(len(part))] = "edit"
            if r.random() < 0.3:
                part.insert(len(part) // 2, "more")
            at = r.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "has TWO\twords here"), (203, "a " * 30), (204, "x " * 100_000 + items[3][1]), (204, "x " * 100_000 + items[3][1])]
    d = spark.createDataFrame([(*x, "c", 1.0) for x in docs], "doc_id long, text string, item string, start double")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(d, b).toPandas()
    pairs = set(zip(got.doc_id, got.item_id))
    assert len(got) == len(pairs)
    want = brute([x for x in docs if x[0] != 204], items) | {(204, 3)}
    assert pairs <= want and len(want - pairs) <= 0.02 * len(want), want ^ pairs
    assert D.find_leaks(d.limit(0), b).count() == 0 and D.find_leaks(d, b.limit(0)).count() == 0
    kept = D.without_ids(d, D.find_leaks(d, b).select("doc_id"), "test")
    assert kept.columns == d.columns and kept.count() == len(docs) - sum(x[0] in {p[0] for p in pairs} for x in docs)


def test_blocks_find_items_of_the_window(spark):
    """Items that share no aligned shingle rank still meet a window of their length; long items go through the index too."""
    words = ["v%d" % i for i in range(300)]
    long_item, near = " ".join(words), " ".join(words[:150] + ["edit"] + words[151:])
    d = spark.createDataFrame([(1, "before it " + near + " after it"), (2, "nothing here")], "doc_id long, text string")
    b = spark.createDataFrame([(7, long_item), (8, near), (9, "other words of no document at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, round(r.similarity, 3)) for r in D.find_leaks(d, b).collect()}
    assert got == {(1, 7, 2, round(291 / 301, 3)), (1, 8, 2, 1.0)}


def test_windows_at_every_place(spark):
    """Passages whose shingles lie elsewhere than in the item (parts in another order, words put in) and the best window's start."""
    r = random.Random(8)
    vocabulary = ["x%d" % i for i in range(500)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 5, 9, 20, 48, 60, 61, 90])))) for i in range(40)]
    docs = []
    for i in range(160):
        words, part = r.choices(vocabulary, k=r.randint(0, 60)), items[i % 40][1].split()
        cut = r.randint(0, len(part))
        part = [part[cut:] + part[:cut], part[:cut] + ["in"] + part[cut:], part[cut // 9 :], part + part[::-1] + part[3:] + part[:3]][i // 40]
        at = r.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + part + words[at:])))
    docs += [(300, docs[2][1]), (300, docs[45][1]), (None, docs[2][1]), (301, " ".join(items[4][1].split()[2:]))]
    want = {}
    for item_id, item in items:
        w = item.split()
        k = min(5, len(w))
        a = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        for doc_id, text in docs:
            t = text.split()
            for s in range(max(1, len(t) - len(w) + 1)):
                x = t[s : s + len(w)]
                b = Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
                same, all_ = sum((a & b).values()), sum((a | b).values())
                if same >= 0.75 * all_:
                    old = want.get((doc_id, item_id), (0, 0))
                    want[doc_id, item_id] = max(old, (same / all_, -s))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (round(x.similarity, 6), -x.start) for x in D.find_leaks(d, b).collect()}
    assert got == {k: (round(v[0], 6), v[1]) for k, v in want.items()}
    assert any(i is not None and i < 40 for i, _ in got), "no reordered passage was found"
