import datetime as dt

from wavecrawl.session import new_run_dir
from wavecrawl.sources.crawls import crawl_row, crawls_frame, derive_scopes
from wavecrawl.streaming.admit import admit_stream, run_to_table

G = "https://docs.example.com/guide/"


def test_admit_stream_with_watermark(spark):
    scopes, _ = derive_scopes(crawls_frame(spark, [crawl_row(1, G + "start")]))
    src = new_run_dir(spark, "stream-src")
    t0 = dt.datetime(2024, 1, 1)
    batches = [
        [(1, G + "a#x", t0), (1, G + "a", t0), (1, "/guide/b", t0), (1, "https://other.com/x", t0)],
        [(1, G + "a/", t0 + dt.timedelta(minutes=5)), (1, G + "c", t0 + dt.timedelta(minutes=6)),
         (1, G + "file.pdf", t0 + dt.timedelta(minutes=7))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "crawl_id long, url string, ts timestamp").coalesce(1).write.parquet(
            f"{src}/batch={i}")
    stream = (spark.readStream.schema("crawl_id long, url string, ts timestamp").option("maxFilesPerTrigger", 1)
              .parquet(f"{src}/batch=*"))
    admitted = admit_stream(stream, scopes, "url", None, "ts", "1 hour")
    run = new_run_dir(spark, "stream-out")
    out = run_to_table(admitted.select("crawl_id", "normalized_url"), f"{run}/out", f"{run}/_ckpt")
    got = sorted(r.normalized_url for r in out.collect())
    # '/guide/b' has no base (invalid), other host out of scope, .pdf binary; 'a' variants admitted once
    assert got == [G + "a", G + "c"]


def test_stream_batches_grow_with_bytes_not_files(spark, sf_dir, tmp_path):
    import glob

    from wavecrawl.plans import queries as Q
    from wavecrawl.session import ensure_state_root

    spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    runs = f"{ensure_state_root(spark)}/wavecrawl/stream-*/_checkpoint/commits/*"
    before = set(glob.glob(runs))
    assert Q.stream_admit(spark, str(tmp_path)).count() > 0
    assert len(set(glob.glob(runs)) - before) == 1
