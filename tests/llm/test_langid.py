"""Language identification: held-out accuracy, calibration, and defined results for odd rows."""

import numpy as np
from pyspark.sql import functions as F

from wavecrawl.llm import langid as L


def test_subwords_by_hand():
    c = L._codes("Ab, 1é!")
    assert [chr(int(x)) for x in c] == [" ", "a", "b", " ", "é", " "] or [chr(int(x)) for x in c] == [" ", "a", "b", " ", "é", " "]
    assert len(L.subwords("Ab, 1é!")) == 6 + 5 + 4 + 3
    assert (L.subwords("x y") == L.subwords("X! Y?")).all()


def test_query_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = L.query(spark, d).join(docs, "doc_id").toPandas()
    assert len(got) == docs.count()
    assert set(got.lang_pred) <= set(got.lang.dropna()) | {"und"}
    out = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (out.lang == out.lang_pred).mean() > 0.93
    ok = out[out.accepted]
    assert len(ok) > 0.7 * len(out) and (ok.lang == ok.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, k, "x") for i in range(30) for t, k in (("the cat and the dog", "en"),)] +
        [(i + 30, "le chat est sur la table", "fr", "x") for i in range(30)] +
        [(90, None, "en", "x"), (91, "", "en", None), (92, "123 !!", None, "x"), (93, "the dog", None, "x"), (93, "the dog", None, "x"),
         (None, "la table est le chat " * 50_000, None, "x")],
        "doc_id long, text string, lang string, language string")
    model = L.learn(docs, F.lit(True))
    got = [(r.doc_id, r.language.lang_pred) for r in L.identify(docs.where("doc_id >= 90 or doc_id is null"), model).collect()]
    assert sorted(got, key=str) == sorted([(90, "und"), (91, "und"), (92, "und"), (93, "en"), (93, "en"), (None, "fr")], key=str)
    none = L.learn(docs.limit(0), F.lit(True))
    assert {r.language.lang_pred for r in L.identify(docs.limit(5), none).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        true = i % 2
        seen = true if rng.random() < 0.8 else 1 - true
        rows.append(("ab"[true], np.array([seen]), np.array([1.0])))
    m = L.train(rows)
    p = L._softmax((m.table[[0, 1]] + m.bias) / m.temperature)
    assert 0.7 < p[0].max() < 0.9 and 0.7 < p[1].max() < 0.9


def test_texts_of_one_subword():
    """Steps stay bounded if a text is a single subword, and packing keeps buckets and weights."""
    rows = [("ab"[k % 2], np.array([k % 2]), np.array([1.0])) for k in range(300)]
    m = L.train(rows)
    assert np.isfinite(m.table).all() and m.table[0].argmax() == 0 and m.table[1].argmax() == 1
    where, weight = L._unpacked(L._features("Der Fluss, the river"))
    counts = np.bincount(L.subwords("Der Fluss, the river"), minlength=L.BUCKETS)
    assert where.tolist() == np.flatnonzero(counts).tolist() and abs(float(weight.sum()) - 1) < 1e-5
    assert L._features(" 12 .") == b""
