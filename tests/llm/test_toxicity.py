"""Toxicity: decoding of disguises, held-out ranking, odd rows."""

from pyspark.sql import functions as F

from wavecrawl.llm import toxicity as X

from test_quality import auc


def small_model():
    bad, fine = ("idiot", "moron", "loser"), "the tall tree stands in total silence letters and words of a fine day into the middle".split()
    weights = X.markers({w: (20, 0) for w in bad} | {w: (30, 300) for w in fine}, 40.0, 400.0)
    return X.Model(X.character_model(X._trigrams({w: 20 for w in (*bad, *fine)}), weights), weights, 1.0, -3.0)


def test_restores_disguises():
    m = small_model()
    assert {"idiot", "moron", "loser"} <= m.weights.keys()
    plain = m.score("the tall tree")
    for bad in ("1d10t", "idiooooot", "i d i o t", "m.o.r.o.n", "m0r0n!!", "l0$3r", "(idiot)", "LOSER###", "m 0 r 0 n"):
        assert m.score(f"the tall {bad} tree") >= 0.3 > plain, bad
    for fine in ("", "in 2021 at 10:30", "a b c d", "sooo tall", "€100", "x" * 100_000):
        assert m.score(fine) == plain, fine


def test_restores_disguises_within_sentences():
    m = small_model()
    plain = m.score("the tall tree")
    long = "idi" + "o" * 500 + "t"
    for bad in ("a m o r o n", "such a i d i o t", "u r a n i d i o t", "f i n e m o r o n n o w", "l o s e r i d i o t", "you...1d10t",
                "what-a-m0r0n", "x/1d10t", "fine!!1d10t", "you," + long, long, "y-" * 40 + "1d10t"):
        assert m.score(f"the tall {bad} tree") >= 0.3 > plain, bad
    assert m.restored("loseridiot", True) == {"loser", "idiot"}
    for fine in ("t h e t a l l t r e e", "fine-10.1d", "page-1-0-5-3", "tall-10532", "1 0 5 3 2 1", "x " * 20_000, "a1" * 20_000):
        assert m.score(fine) == plain, fine


def test_letters_outside_a_to_z():
    weights = X.markers({"crétin": (20, 0), "дурак": (20, 0)}, 40.0, 400.0)
    m = X.Model(X.character_model(X._trigrams({"fine": 9, "дом": 9}), weights), weights, 1.0, -3.0)
    for bad in ("cr3tin", "c r é t i n", "crétiiiin", "дураааак", "д у р а к", "д.у.р.а.к"):
        assert m.score(f"fine {bad} fine") >= 0.3 > m.score("fine дом"), bad


def test_query(spark):
    d = "/root/testdata/sf0.1"  # sf0.01 has 14 held-out positives
    got = X.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    out = got[got.held_out & got.toxic.notna()]
    assert auc(out.toxic.to_numpy(), out.score.to_numpy()) > 0.9


def test_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "fine words", None, "x") for i in range(40)] + [(50, None, None, "x"), (51, "", 0.5, None), (51, "", 0.5, None)], "doc_id long, text string, score double, extra string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, None)], "doc_id long, toxic int")
    model = X.learn(docs, docs, labels, F.lit(True))
    got = X.score(docs, model).toPandas()
    assert len(got) == 43 and ((got.score >= 0.3) == (got.doc_id % 2 == 1) & (got.doc_id < 40)).all()
    assert X.score(docs, X.learn(docs.limit(0), docs.limit(0), labels.limit(0), F.lit(True))).where("score >= 0.3").count() == 0
