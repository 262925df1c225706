"""Codes, errors and codebooks against a plain k-means over Python integers."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wavecrawl.llm import vector_codes as V


def plain(rows, entries=V.ENTRIES):
    """rows: (vec_id, vector, label), kept ones only -> {row number: (code, error)}, sha256."""
    whole = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    order = sorted((k for k in range(len(rows)) if rows[k][0] is not None), key=lambda k: (rows[k][0], rows[k][1]))
    width = len(whole[0]) // 4
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for part in range(4):
        points = [w[part * width : (part + 1) * width] for w in whole]
        book = [list(points[k]) for k in order[:entries]]

        def nearest(p):
            return min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(book))

        for _ in range(4):
            found = [nearest(p)[1] for p in points]
            for k in set(found):
                mine = [p for p, f in zip(points, found) if f == k]
                book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        for k, p in enumerate(points):
            d, e = nearest(p)
            codes[k] += f"{e:02x}"
            errors[k] += d
        books.append(book)
    return codes, errors, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


POINTS = st.lists(st.tuples(*[st.integers(-9, 9)] * 3), min_size=1, max_size=300)


@given(POINTS, st.lists(st.tuples(*[st.integers(-9, 9)] * 3), min_size=1, max_size=12), st.sampled_from([1, 1 << 26]))
@settings(max_examples=150, deadline=None)
def test_tree_assignment(points, book, factor):
    """Ties and equal entries, small numbers and ones beyond float64's exact range."""
    p, b = np.array(points, np.int64) * factor, np.array(book, np.int64) * factor
    tree = V.build_tree(p)
    assert sorted(tree.order.tolist()) == list(range(len(p)))
    sums, counts, _, codes = V.assign(tree, b, want_codes=True)
    want = ((p[:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes == want).all()
    for k in range(len(b)):
        assert counts[k] == (want == k).sum() and (sums[k] == p[want == k].sum(axis=0)).all()


def test_balls_cache_and_are_owned():
    """Every ball holds its points; far groups are owned without visiting what lies below."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-90_000, 90_000, (6, 4))
    p = (centres[rng.integers(0, 6, 3000)] + rng.integers(-20, 20, (3000, 4))).astype(np.int64)
    tree = V.build_tree(p)
    for b in range(len(tree.start)):
        own = tree.points[tree.start[b] : tree.end[b]]
        assert (tree.total[b] == own.sum(axis=0)).all()
        assert np.sqrt(((own - tree.pivot[b]) ** 2).sum(axis=1)).max() <= tree.radius[b] + 1e-9
    _, counts, visited, _ = V.assign(tree, centres, want_codes=False)
    assert counts.sum() == 3000 and visited < len(tree.start) / 4


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")


def check(spark, rows):
    kept = [r for r in rows if r[1] is not None]
    codes, errors, sha = plain(kept)
    done = V.compress(frame(spark, [(*r, "own") for r in rows]))
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in done.rows.collect())
    assert got == sorted((r[0] is None, r[0] or 0, c, e) for r, c, e in zip(kept, codes, errors))
    assert done.sha256() == sha


def test_rows_against_plain(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i) * 3, [float(x) for x in np.float32(rng.normal(0, 0.2, 8))], int(i % 3) or None) for i in rng.permutation(700)]
    rows += [(5, rows[0][1], 1), (5, rows[1][1], 1), (None, rows[2][1], None)] + [(9000 + i, rows[3][1], 2) for i in range(400)]
    check(spark, rows)


def test_odd_rows(spark):
    good = [float(x) / 8 for x in range(8)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 6, [1.0] * 12, good[:7] + [nan], good[:7] + [inf], good[:7] + [-inf], good[:7] + [None], good[:7] + [1e30]]
    rows = [(7, good, 1, "a"), (8, good[::-1], None, "b")] + [(9 + k, v, 1, "c") for k, v in enumerate(bad)]
    done = V.compress(frame(spark, rows))
    assert [(r.vec_id, r.code, r.error) for r in done.rows.orderBy("vec_id").collect()] == [(7, "00000000", 0), (8, "01010101", 0)]
    assert V.compress(frame(spark, [])) is None and V.compress(frame(spark, [(1, None, 1, "")])) is None
    assert V.compress(frame(spark, [(None, good, 1, "")])) is None


def test_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    whole = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64)
    order = np.argsort([r[0] for r in rows], kind="stable")
    errors, codes = np.zeros(len(rows), np.int64), [""] * len(rows)
    for part in np.split(whole, 4, axis=1):
        book = part[order[:256]].copy()
        for turn in range(5):
            d = ((part[:, None] - book[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            if turn < 4:
                for k in set(near.tolist()):
                    book[k] = np.floor_divide(part[near == k].sum(axis=0), (near == k).sum())
        errors += d.min(axis=1)
        codes = [c + f"{k:02x}" for c, k in zip(codes, near)]
    by_label = {}
    for r, e in zip(rows, errors.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in V.query(spark, sf_dir).collect()}
    assert got == {r[0]: (c, e, by_label[r[2]]) for r, c, e in zip(rows, codes, errors.tolist())}
