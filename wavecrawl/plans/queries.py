"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them read the captured tables under ``sf_dir`` (or data Spark derives
from them) in full; column names match the DuckDB oracles in
``oracle_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs as G
from ..functions import urls as U
from ..operators import extract as X
from ..operators import filters as FL
from ..operators import naming as N
from ..operators.htmlpass import html_pass
from ..operators.fetch_status import classify, narrow_meta
from ..operators.sequence import dense_sequence
from ..sources import synthetic as S
from ..sources.crawls import CRAWLS_SCHEMA
from ..operators import render as R
from ..sources.responses import resolve_attempts, responses_from_pages
from ..sources.tables import read_table

# Job-wide glob lists of the ``filter_decisions`` query (fixed parameters).
FILTER_EXCLUDE = ["/*."]
FILTER_INCLUDE = ["/[A-Z]*"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return U.canonicalize(p, "url", None, "page_url")


def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return U.canonicalize(p, "url", None, "normalized_url")


def derive_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", F.col("page_url").alias("seed"))
    return p.select(
        "page_id", "seed",
        U.scope_base_url(F.col("seed"), F.lit(False)).alias("path_base_url"),
        U.scope_base_url(F.col("seed"), F.lit(True)).alias("domain_base_url"),
    )


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page_url, pos, href, link_url): distinct links per page."""
    p = _pages(spark, sf_dir).select("page_id", "page_url", "html")
    parsed = html_pass(p, "html", "page_url", ["page_id", "page_url"], want_content=False)
    ex = parsed.select("page_id", "page_url", F.explode("links").alias("l")).select(
        "page_id", "page_url", F.col("l.pos").alias("pos"), F.col("l.href").alias("href")
    )
    ex = U.canonicalize(ex, "href", "page_url", "link_url").filter(F.col("link_url").isNotNull())
    first = ex.groupBy("page_id", "page_url", "link_url").agg(F.min_by(F.struct("pos", "href"), "pos").alias("f"))
    return first.select("page_id", "page_url", "f.pos", "f.href", "link_url")


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "link_url")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _page_links(spark, sf_dir)
    # Each page seeds two crawls: path scope and domain scope.
    d = links.withColumn("mode", F.explode(F.array(F.lit("path"), F.lit("domain"))))
    d = d.withColumn("base_url", U.scope_base_url(F.col("page_url"), F.col("mode") == "domain"))
    d = d.withColumn("include_re", F.lit(G.globs_to_regex(FILTER_INCLUDE)))
    d = d.withColumn("exclude_re", F.lit(G.globs_to_regex(FILTER_EXCLUDE)))
    d = FL.decide(d, "link_url", normalize=False)
    return d.select("page_id", "mode", "pos", "link_url", F.col("page_url"),
                    F.coalesce(F.col("reject_reason"), F.lit("allowed")).alias("decision"))


def filter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("page_id", "mode", F.col("pos").cast("long").alias("pos"), "link_url",
                                            "decision")


def reject_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    return d.groupBy(U.url_host(F.col("page_url")).alias("host"), "mode", "decision").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_distinct("link_url").alias("n_targets")
    )


def page_hash_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    content = U.js_trim(F.col("text"))
    wc = X.word_count(content)
    return d.select(
        "doc_id",
        wc.cast("long").alias("word_count"),
        F.sha2(content, 256).alias("content_hash"),
        F.when(wc >= X.MIN_WORDS, F.lit("success")).otherwise(F.lit("skipped_empty")).alias("status"),
    )


ONE_HOST = "https://docs.example.com"


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL moved onto one host (paths collide), distinct, then named."""
    p = _pages(spark, sf_dir)
    moved = p.select(
        F.concat(F.lit(ONE_HOST), U.url_path(F.col("page_url")), U.url_search(F.col("page_url"))).alias("url")
    ).distinct()
    r = moved.select(
        F.lit(1).cast("long").alias("crawl_id"), "url", F.col("url").alias("final_url"),
        F.lit("success").alias("status"), F.lit(ONE_HOST + "/").alias("base_url"),
    )
    return N.assign_output_paths(r).select("url", "output_path")


def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host (one crawl each), pages in page_id order: anchor numbering."""
    p = _pages(spark, sf_dir).select("page_id", "page_url", "html")
    parsed = html_pass(p, "html", "page_url", ["page_id", "page_url"], want_content=False)
    pages = parsed.select(U.url_host(F.col("page_url")).alias("host"), "page_id",
                          F.col("page_url").alias("url"), "title").withColumnRenamed("host", "crawl_id")
    out = N.heading_anchors(pages, order="page_id")
    return out.select("page_id", F.col("crawl_id").alias("host"), "heading", "anchor")



# --- crawls over the part site ------------------------------------------------

def _part_crawls(spark: SparkSession, max_pages: int | None, depth: int | None) -> DataFrame:
    """Two crawls of the part site in one job: seed p1 (path scope), seed p2 (domain scope)."""
    rows = [(1, S.SITE + "/guide/p1", False, depth, max_pages, False, [], [], None),
            (2, S.SITE + "/guide/p2", True, depth, max_pages, False, [], [], None)]
    return spark.createDataFrame(rows, CRAWLS_SCHEMA)


def crawl_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crawl import crawl

    out = crawl(_part_crawls(spark, None, None), S.part_site(spark, sf_dir))
    return out.page_results.select("crawl_id", "url", F.col("depth").cast("int").alias("depth"), "status",
                                   "output_path")


def crawl_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default page cap (500) and depth 3: FIFO order decides which pages are processed."""
    from .crawl import crawl

    out = crawl(_part_crawls(spark, 500, 3), S.part_site(spark, sf_dir))
    return out.page_results.select("crawl_id", "seq", "url", "depth", "status", "output_path")


def queued_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly queued links per processed page of a crawl that stops after 100 pages, most of its queue unprocessed."""
    from .crawl import crawl, queued_counts

    return queued_counts(crawl(_part_crawls(spark, 100, None), S.part_site(spark, sf_dir)))


def sitemap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap URLs in depth-first order over indexes that list one another, share files and form a cycle."""
    from .crawl import discover

    w0 = discover(S.sitemap_crawls(spark, sf_dir), S.sitemap_dag_site(spark, sf_dir))
    return w0.select("crawl_id", "seq", "url", F.col("depth").cast("int").alias("depth"))


def sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crawl import discover

    w0 = discover(S.sitemap_crawls(spark, sf_dir), S.sitemap_site(spark, sf_dir))
    return w0.select("crawl_id", "seq", "url", F.col("depth").cast("int").alias("depth"))


# --- response handling over responses derived from orders / lineitem -----------

SHOP = "https://shop.example.com"


def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order URL redirects to its customer's page; priority/status decide the outcome."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                                    "o_orderdate")
    prio, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.filter(~((prio == "2-HIGH") & (st == "P"))).select(
        F.concat(F.lit(SHOP + "/orders/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit(SHOP + "/customers/"), F.col("o_custkey").cast("string")).alias("final_url"),
        F.when(prio == "5-LOW", F.lit(404)).when(prio == "4-NOT SPECIFIED", F.lit(503)).otherwise(F.lit(200)).alias(
            "status"),
        F.when(st == "P", F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.lit("<html><body>order</body></html>").alias("body"),
        F.when((prio == "1-URGENT") & (st == "P"), F.lit("ECONNRESET")).alias("error"),
        F.col("o_orderdate").alias("fetched_at"),
    )


def _order_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wave per order year: every order URL, FIFO by order key, classified."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    wave = o.select(
        F.year("o_orderdate").cast("long").alias("crawl_id"), "o_orderkey",
        F.concat(F.lit(SHOP + "/orders/"), F.col("o_orderkey").cast("string")).alias("url"),
    )
    wave = dense_sequence(wave, ["crawl_id"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 65536), "seq")
    from .snapshot import keyed_responses, winners

    meta = narrow_meta(winners(keyed_responses(order_responses(spark, sf_dir))))
    return classify(wave.select("crawl_id", "seq", "url"), meta)


def final_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_wave(spark, sf_dir).select("crawl_id", "seq", "url", "final_url", "status", "http_status", "error")


def final_url_dedup_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two waves per order year, urgent and high orders first; all filled orders redirect to one login page."""
    from ..session import new_run_dir
    from ..operators.fetch_status import claimed_finals
    from .snapshot import _write, keyed_responses, winners

    run = new_run_dir(spark, "waves")
    responses = order_responses(spark, sf_dir)
    filled = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit(SHOP + "/orders/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit(True).alias("filled"))
    responses = responses.join(filled, "url", "left").withColumn(
        "final_url", F.when(F.col("filled"), F.lit(SHOP + "/login")).otherwise(F.col("final_url"))).drop("filled")
    meta = narrow_meta(_write(winners(keyed_responses(responses)), f"{run}/meta"))  # both waves read it
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    later = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1)
    queue = o.select(
        F.year("o_orderdate").cast("long").alias("crawl_id"), later.alias("wave"), "o_orderkey",
        F.concat(F.lit(SHOP + "/orders/"), F.col("o_orderkey").cast("string")).alias("url"),
    )
    bucket = F.col("wave") * F.lit(1 << 40) + F.floor(F.col("o_orderkey") / 65536)
    queue = dense_sequence(queue, ["crawl_id"], ["wave", "o_orderkey"], bucket, "seq")
    queue.select("crawl_id", "seq", "url", "wave").write.parquet(f"{run}/queue")
    queue = spark.read.parquet(f"{run}/queue")
    prior = None
    for wave in (0, 1):
        classify(queue.filter(F.col("wave") == wave), meta, prior).write.parquet(f"{run}/results/w={wave}")
        prior = claimed_finals(spark.read.parquet(f"{run}/results/w={wave}"))
    return spark.read.parquet(f"{run}/results").select(
        "crawl_id", "seq", F.col("wave").cast("int").alias("wave"), "url", "final_url", "status", "http_status", "error")


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.col("status")
    return _order_wave(spark, sf_dir).groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st == "fetched").alias("fetched"),
        F.count_if(st.isin("skipped_filtered", "skipped_empty")).alias("skipped"),
        F.count_if(st.isin("error_http", "error_network", "error_parse")).alias("failed"),
    )


def order_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch log from lineitem: one attempt per line, numbered in a total order per order."""
    li = read_table(spark, sf_dir, "lineitem")
    order_cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "l_returnflag", "l_linestatus", "l_shipdate"]
    li = dense_sequence(li, ["l_orderkey"], order_cols, F.col("l_linenumber"), "attempt0")
    flag = F.col("l_returnflag")
    outcome = F.when(flag == "A", F.lit("timeout")).otherwise(F.lit("response"))
    status = F.when(flag == "R", F.lit(429)).when(flag == "N", F.lit(200))
    return li.select(
        F.concat(F.lit(SHOP + "/orders/"), F.col("l_orderkey").cast("string")).alias("url"),
        (F.col("attempt0") + 1).cast("int").alias("attempt"),
        outcome.alias("outcome"),
        F.concat(F.lit(SHOP + "/orders/"), F.col("l_orderkey").cast("string")).alias("final_url"),
        status.alias("status"),
        F.when(F.col("l_linestatus") == "O", F.lit("text/html; charset=utf-8")).otherwise(F.lit("text/plain")).alias(
            "content_type"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("body"),
        F.lit(None).cast("string").alias("error"),
        F.col("l_shipdate").alias("fetched_at"),
    )


def attempt_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import new_run_dir
    from .snapshot import _write

    # The log is numbered once; choosing reads its narrow columns twice and the effective rows come from it.
    log = _write(order_attempts(spark, sf_dir), f"{new_run_dir(spark, 'attempt-log')}/log")
    r = resolve_attempts(log)
    return r.select("url", "attempt", "status", "content_type", "body", "error")



# --- extraction and rendering over the captured pages -------------------------

def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_pages(responses_from_pages(read_table(spark, sf_dir, "pages")))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("url", "final_url", "canonical_url", "title", "status", "word_count",
                                            "content_hash", "error")


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_markdown(_extracted(spark, sf_dir)).select("url", "markdown")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a page file of its own, and the files read back."""
    from ..operators.sinks import export_page_files, read_page_files
    from ..session import new_run_dir

    root = new_run_dir(spark, "page-files")
    d = read_table(spark, sf_dir, "documents")
    docs = d.select(F.floor(F.col("doc_id") / 1000).alias("crawl_id"),
                    F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("output_path"),
                    F.col("text").alias("markdown"))
    export_page_files(docs, root)
    files = read_page_files(docs.select("crawl_id").distinct(), root)
    # Empty files (null or empty texts) are written but not among the rows: Spark's file listing leaves them out, too.
    return files.filter(F.col("n_bytes") > 0).select("name", "n_bytes", "sha256")


def single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged document lines, one document per host; pages in page_id order."""
    # The capture time of a page is its id (see responses_from_pages).
    page_id = F.unix_timestamp("crawled_at") - 1_700_000_000
    e = _extracted(spark, sf_dir).withColumn("page_id", page_id).withColumn("crawl_id", U.url_host(F.col("final_url")))
    e = dense_sequence(e, ["crawl_id"], ["page_id"], F.floor(F.col("page_id") / 65536), "seq")
    scopes = e.groupBy("crawl_id").agg(F.min("final_url").alias("seed"))
    return R.merged_lines(e, scopes).select("crawl_id", "part", "seq", "line", "text")




def pages_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One domain crawl per host of ``pages``, seeded at its first page, without a page cap."""
    from .crawl import crawl

    seeds = _pages(spark, sf_dir).groupBy(U.url_host(F.col("page_url")).alias("host")).agg(
        F.min_by("page_url", "page_id").alias("seed_url"))
    crawls = seeds.select(
        F.xxhash64("host").alias("crawl_id"), "seed_url", F.lit(True).alias("domain"),
        F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("max_pages"), F.lit(False).alias("sitemap"),
        F.array().cast("array<string>").alias("include"), F.array().cast("array<string>").alias("exclude"),
        F.lit(None).cast("string").alias("lang"),
    )
    out = crawl(crawls, responses_from_pages(read_table(spark, sf_dir, "pages")))
    return out.page_results.select(U.url_host(F.col("url")).alias("host"), "url", F.col("depth").cast("int"),
                                   "http_status", "error")


# --- streaming ------------------------------------------------------------------

# Bytes of page files that one batch of the stream takes (a larger file is a batch of its own).
STREAM_BATCH = 512 << 20


def stream_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a file stream: links admitted once per host crawl (domain scope)."""
    from ..session import new_run_dir
    from ..sources.crawls import derive_scopes
    from ..streaming.admit import admit_stream, page_links_stream, run_to_table

    static_pages = read_table(spark, sf_dir, "pages")
    # Batches by size, so their number grows with the bytes and not with the number of files.
    stream = (spark.readStream.schema(static_pages.schema).option("maxBytesPerTrigger", STREAM_BATCH)
              .parquet(f"{sf_dir.rstrip('/')}/pages.parquet*"))
    hosts = _pages(spark, sf_dir).select(U.url_origin(F.col("page_url")).alias("origin")).distinct()
    crawls = hosts.select(
        F.xxhash64("origin").alias("crawl_id"), F.concat("origin", F.lit("/")).alias("seed_url"),
        F.lit(True).alias("domain"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("max_pages"),
        F.lit(False).alias("sitemap"), F.array().cast("array<string>").alias("include"),
        F.array().cast("array<string>").alias("exclude"), F.lit(None).cast("string").alias("lang"),
    )
    scopes, _ = derive_scopes(crawls)
    links = page_links_stream(stream).withColumn("crawl_id", F.xxhash64(U.url_origin(F.col("page_url"))))
    admitted = admit_stream(links, scopes, "href", "page_url")
    run = new_run_dir(spark, "stream")
    out = run_to_table(admitted.select("crawl_id", "normalized_url", "page_url"), f"{run}/admitted", f"{run}/_checkpoint")
    return out.select(U.url_host(F.col("page_url")).alias("host"), F.col("normalized_url").alias("url"))


REGISTRY = {
    "normalize_urls": normalize_urls,
    "derive_scopes": derive_scopes,
    "link_extract": link_extract,
    "filter_decisions": filter_decisions,
    "reject_reason_counts": reject_reason_counts,
    "page_hash_words": page_hash_words,
    "output_paths": output_paths,
    "heading_anchors": heading_anchors,
    "crawl_reachability": crawl_reachability,
    "crawl_capped": crawl_capped,
    "queued_links": queued_links,
    "sitemap_expand": sitemap_expand,
    "sitemap_order": sitemap_order,
    "final_url_dedup": final_url_dedup,
    "final_url_dedup_waves": final_url_dedup_waves,
    "status_summary": status_summary,
    "attempt_resolution": attempt_resolution,
    "extract_pages": extract_pages,
    "page_markdown": page_markdown,
    "single_file": single_file,
    "page_files": page_files,
    "pages_crawl": pages_crawl,
    "stream_admit": stream_admit,
}
