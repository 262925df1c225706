"""Quality trees: flattened walk against a nested walk, held-out ranking, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from wavecrawl.llm import quality as Q


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def nested(forest, row):
    total = forest.start
    for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if row[f[at]] > t[at] else 1)
        total += leaf[at - len(f)]
    return total


def test_flat_walk_is_the_nested_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    forest = Q.train(x, y)
    fresh = rng.normal(size=(300, 5)).round(1)
    assert np.allclose(forest.margins(fresh), [nested(forest, r) for r in fresh])
    truth = (fresh[:, 0] > 0.3) ^ (fresh[:, 1] < -0.2)
    assert ((forest.scores(fresh) > 0.5) == truth).mean() > 0.95


def test_one_label_and_none():
    x = np.zeros((40, 3))
    assert (Q.train(x, np.ones(40)).scores(x) > 0.9).all()
    assert (Q.train(x[:0], np.zeros(0)).scores(x) == 0.5).all()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = Q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    out = got[got.held_out & got.quality.notna()]
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.85


def test_rows(spark):
    texts = [("fine words in a row, all of them different", 1), ("bad!! bad!! bad!! bad!!", 0)]
    docs = spark.createDataFrame(
        [(i, texts[i % 2][0], 0.1) for i in range(80)] + [(90, None, 0.2), (91, "", 0.3), (92, "ab " * 200_000, None), (92, "ab " * 200_000, None)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, texts[i % 2][1]) for i in range(80)] + [(90, None), (3, 0), (999, 1)], "doc_id long, quality int")
    forest = Q.learn(docs, labels, F.lit(True))
    got = sorted((r.doc_id, r.score) for r in Q.score(docs, forest).collect())
    assert len(got) == 84 and got[-1] == got[-2] and got[80][1] == got[81][1]
    assert all((s > 0.5) == (i % 2 == 0) for i, s in got[:80])
    nothing = Q.learn(docs.limit(0), labels, F.lit(True))
    assert {r.score for r in Q.score(docs, nothing).collect()} == {0.5}
    assert Q.score(docs.limit(0), forest).count() == 0


def test_repeated_ids_count_once(spark, monkeypatch):
    """A labelled doc_id of many rows gives the driver one row, the same whatever the partitions."""
    docs = spark.createDataFrame([(7, f"text {i} of many") for i in range(300)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda x, y: seen.append((x.tolist(), y.tolist())))
    for n in (1, 5):
        Q.learn(docs.repartition(n), labels, F.lit(True))
    assert seen[0] == seen[1] and seen[0][1] == [1.0, 0.0]
