"""Run summary per crawl (status counts and time span)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Status buckets of the summary (fixed values).
SUCCEEDED = ("success",)
FAILED = ("error_http", "error_network", "error_parse")
STATUSES = ("success", "skipped_empty", "skipped_filtered", "error_http", "error_network", "error_parse")


def summarize(page_results: DataFrame) -> DataFrame:
    """One row per crawl: total, succeeded, skipped, failed, started/finished, duration_ms."""
    st = F.col("status")
    return page_results.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st.isin(*SUCCEEDED)).alias("succeeded"),
        F.count_if(~st.isin(*SUCCEEDED, *FAILED)).alias("skipped"),
        F.count_if(st.isin(*FAILED)).alias("failed"),
        F.min("crawled_at").alias("started_at"),
        F.max("crawled_at").alias("finished_at"),
        ((F.unix_micros(F.max("crawled_at")) - F.unix_micros(F.min("crawled_at"))) / 1000).cast("long").alias(
            "duration_ms"),
    )
