"""Fingerprints against plain sets of paragraphs; recovery of differences of any size; odd rows."""

import hashlib
import random
import re

import pandas as pd

from wavecrawl.llm import fingerprints as P


def paragraphs(text):
    out = set()
    for line in re.split("[\r\n]+", text):
        out |= {x.strip() for x in (re.split(r"(?<=[.!?])\s+", line) if len(line) > P.LONG_LINE else [line])}
    return out - {""}


def like(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_sets(spark):
    r = random.Random(3)
    line = lambda: " ".join(r.choices(["alpha", "béta", "gamma", "δelta.", "stop!"], k=r.choice([1, 5, 12, 150])))
    rows = [(i * 700, "\n".join(line() for _ in range(r.randint(1, 30)))) for i in range(60)]
    rows += [(5_000_000, ""), (6_000_000, None), (6_000_001, "one"), (6_000_002, "a\n\n \nb\r\na"), (6_000_003, "\n".join("p%d" % i for i in range(30_000)))]
    rows += [(6_000_004, rows[3][1]), (6_000_005, "same"), (6_000_005, "same"), (None, "no id"), (6_000_006, "x" * 100_000)]
    docs = spark.createDataFrame([(*x, "z", 1, "q") for x in rows], "doc_id long, text string, h string, copies int, left string")
    got = P.fingerprints(docs).toPandas()
    assert len(got) == len(rows)
    order = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0))
    by_id = {None if pd.isna(g.doc_id) else int(g.doc_id): g for g in got.itertuples()}
    prints = {}
    for k, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        g = by_id[doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(g.near_edited - like(text, edited)) < 1e-12 and abs(g.near_next - like(text, nxt)) < 1e-12
        assert prints.setdefault(text, g.fingerprint) == g.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(7, "a\nb\nc\nd")], "doc_id long, text string")
    assert P.fingerprints(docs.limit(0)).count() == 0
    (row,) = P.fingerprints(docs).collect()
    assert row.near_next == 1.0 and row.n_chars == 7


def test_recovers_the_differing_digests(spark):
    left = spark.range(0, 5000).selectExpr("xxhash64(id) as d").groupBy().agg({"d": "collect_list"}).toDF("left")
    right = spark.range(100, 5600).selectExpr("xxhash64(id) as d").groupBy().agg({"d": "collect_list"}).toDF("right")
    (row,) = P.differences(left.join(right).selectExpr("1 as pair", "left", "right"), ["pair"]).collect()
    hashes = {i: h for i, h in spark.range(0, 5600).selectExpr("id", "xxhash64(id)").collect()}
    assert set(row.only_left) == {hashes[i] for i in range(100)} and set(row.only_right) == {hashes[i] for i in range(5000, 5600)}
    assert len(row.only_left) == 100 and len(row.only_right) == 600


def test_cells_of_a_digest_are_found_once(spark):
    """The loop over cells hashes nothing: the cost of a digest is one look at its bits per cell."""
    for args in (("ds", 3), ("ds", 3, "other")):
        over_cells = P.cells_sql(*args).split("i -> ")[1]
        assert "getbit" in over_cells and "hash" not in over_cells
    digests, other = list(range(-40, 60)), list(range(30, 90))
    df = spark.createDataFrame([(digests, other)], "ds array<bigint>, other array<bigint>")
    (row,) = df.selectExpr(f"{P.cells_sql('ds', 3)} as a", f"{P.cells_sql('other', 3)} as b", f"{P.cells_sql('ds', 3, 'other')} as c").collect()
    hashes = {d: (mixed % 2**64, check) for d, mixed, check in spark.range(-40, 90).selectExpr("id", "xxhash64(id, 3)", "hash(id)").collect()}
    bits = P.WIDTH.bit_length() - 1

    def sketch(ds):
        cells = [[0, 0, 0] for _ in range(P.CELLS)]
        for d in ds:
            for table in range(3):
                cell = cells[table * P.WIDTH + (hashes[d][0] >> bits * table) % P.WIDTH]
                cell[:] = cell[0] + 1, cell[1] ^ d, cell[2] ^ hashes[d][1]
        return [tuple(c) for c in cells]

    a, b = sketch(digests), sketch(other)
    assert [tuple(c) for c in row.a] == a and [tuple(c) for c in row.b] == b
    assert [tuple(c) for c in row.c] == [(p[0] - q[0], p[1] ^ q[1], p[2] ^ q[2]) for p, q in zip(a, b, strict=True)]
