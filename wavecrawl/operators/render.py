"""Markdown rendering of crawl results, as column expressions.

* ``page_markdown``: frontmatter (title, sourceUrl, finalUrl, crawledAt,
  depth, then canonicalUrl / wordCount / contentHash when present), then the
  trimmed content and a final newline when there is content.
* ``merged_lines``: the single-file document of each crawl as ordered lines
  ``(crawl_id, part, seq, line, text)``: header, table of contents, one
  section per successful page. Joining ``text`` with newlines in that order
  gives the document; it is never built as one string per crawl.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .naming import fallback_title, heading_anchors

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def json_string(c: Column) -> Column:
    """JSON string literal of ``c`` (quotes and escapes), as in frontmatter values."""
    arr = F.to_json(F.array(c))
    return F.regexp_replace(F.regexp_replace(arr, r"^\[", ""), r"\]$", "")


def iso_time(c: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` in UTC, whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), ISO_MILLIS)


def page_markdown(results: DataFrame) -> DataFrame:
    """Add ``markdown`` for rows of a page_results-shaped frame."""
    title = F.coalesce(F.col("title"), fallback_title(F.col("url")))
    content = U.js_trim(F.coalesce(F.col("content"), F.lit("")))
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("title: "), json_string(title)),
        F.concat(F.lit("sourceUrl: "), json_string(F.col("url"))),
        F.concat(F.lit("finalUrl: "), json_string(F.col("final_url"))),
        F.concat(F.lit("crawledAt: "), json_string(iso_time(F.col("crawled_at")))),
        F.concat(F.lit("depth: "), F.col("depth").cast("string")),
        F.when(F.col("canonical_url").isNotNull(), F.concat(F.lit("canonicalUrl: "), json_string(F.col("canonical_url")))),
        F.when(F.col("word_count").isNotNull(), F.concat(F.lit("wordCount: "), F.col("word_count").cast("string"))),
        F.when(F.col("content_hash").isNotNull(), F.concat(F.lit("contentHash: "), json_string(F.col("content_hash")))),
        F.lit("---"),
        F.lit(""),
    )
    md = F.concat(front, content, F.when(content == "", F.lit("")).otherwise(F.lit("\n")))
    return results.withColumn("markdown", md)


def successful(results: DataFrame) -> DataFrame:
    return results.filter((F.col("status") == "success") & F.col("content").isNotNull())


def merged_lines(results: DataFrame, scopes: DataFrame) -> DataFrame:
    """Lines of each crawl's merged document (header, TOC, sections)."""
    ok = heading_anchors(successful(results), order="seq")
    stats = ok.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.col("crawled_at"), F.col("seq")).alias("first_at")
    )
    head = scopes.select("crawl_id", "seed").join(stats, "crawl_id", "left")
    crawled = iso_time(F.coalesce(F.col("first_at"), F.current_timestamp()))
    header_texts = [
        F.concat(F.lit("# "), U.url_host(F.col("seed"))),
        F.lit(""),
        F.concat(F.lit("<!-- crawledAt: "), crawled, F.lit(" -->")),
        F.concat(F.lit("<!-- pages: "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" -->")),
        F.lit(""),
        F.lit("## Table of contents"),
        F.lit(""),
    ]
    header = head.select(
        "crawl_id", F.posexplode(F.array(*header_texts)).alias("line", "text")
    ).select("crawl_id", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("seq"), "line", "text")
    toc = ok.select(
        "crawl_id", F.lit(1).alias("part"), "seq", F.lit(0).alias("line"),
        F.concat(F.lit("- ["), F.col("heading"), F.lit("](#"), F.col("anchor"), F.lit(")")).alias("text"),
    )
    section_texts = [
        F.lit(""), F.lit("---"), F.lit(""),
        F.concat(F.lit('<a id="'), F.col("anchor"), F.lit('"></a>')),
        F.lit(""),
        F.concat(F.lit("## "), F.col("heading")),
        F.concat(F.lit("Source: "), F.col("url")),
        F.lit(""),
        U.js_trim(F.col("content")),
    ]
    sections = ok.select(
        "crawl_id", "seq", F.posexplode(F.array(*section_texts)).alias("line", "text")
    ).select("crawl_id", F.lit(2).alias("part"), "seq", "line", "text")
    tail = head.select("crawl_id", F.lit(3).alias("part"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("line"),
                       F.lit("").alias("text"))
    return header.unionByName(toc).unionByName(sections).unionByName(tail)

