"""The pipeline's stages in order: what goes, what stays, what is packed."""

import corpus_pipeline as C


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    assert C.ORACLE_SQL is None
    left = {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = C.staged(stage(spark, before, d), f"test-{name}")
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= left
        if k < 4:
            assert docs.columns == before.columns and docs.count() == len(ids)
        if k >= 3:
            assert ids == left  # the last two drop nothing
        left = ids
    assert len(left) > 100
