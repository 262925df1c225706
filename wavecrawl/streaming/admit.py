"""Streaming URL admission: each canonical URL of a crawl is admitted once.

A stream of ``(crawl_id, url[, base])`` rows is canonicalised and run through
the filter cascade against the crawls' scopes (a stream-static join with the
config-sized scopes table, broadcast behind a row bound), then deduplicated
on ``(crawl_id, normalized_url)``: with an event-time column and a delay,
``dropDuplicatesWithinWatermark`` keeps the dedup state bounded; without one
the state holds every admitted URL (use the RocksDB state store at scale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import filter_urls
from ..operators.htmlpass import html_pass
from ..functions import urls as U

KEY = ["crawl_id", "normalized_url"]


def admit_stream(urls: DataFrame, scopes: DataFrame, input_col: str = "url", base_col: str | None = None,
                 event_time: str | None = None, delay: str | None = None) -> DataFrame:
    d = filter_urls(urls, scopes, input_col, base_col).filter(F.col("reject_reason").isNull())
    if event_time is not None and delay is not None:
        return d.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(KEY)
    return d.dropDuplicates(KEY)


def page_links_stream(pages: DataFrame) -> DataFrame:
    """Streaming pages (page_id, url, html) → (page_url, href) rows, via the HTML pass."""
    p = U.canonicalize(pages, "url", None, "page_url").filter(F.col("page_url").isNotNull())
    # A batch may be one file with one row group: deal its pages to all cores before they are parsed.
    p = p.select("page_url", "html").repartition(p.sparkSession.sparkContext.defaultParallelism)
    parsed = html_pass(p, "html", "page_url", ["page_url"], want_content=False)
    return parsed.select("page_url", F.explode("links").alias("l")).select("page_url", F.col("l.href").alias("href"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain the stream once (available-now trigger) into parquet; exactly-once file sink."""
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
