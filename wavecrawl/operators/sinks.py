"""Corpus sinks: page documents, merged documents, manifest.

* pages    – parquet table ``(crawl_id, output_path, markdown)`` of every
  success; ``export_page_files`` writes one file per row (Spark's own writers
  cannot name a file per row) through a data source writer with commits and
  ``read_page_files`` reads them back, each crawl's folder in a task.
* merged   – text files per crawl (``crawl_id=<id>/part-*``): the ordered lines
  are range-partitioned on (crawl_id, part, seq, line) and sorted within
  partitions, so concatenating a crawl's part files in name order gives its
  document, and one huge crawl is written by many tasks.
* manifest – JSON lines of ``page_results`` without ``content`` plus one
  summary object per crawl (seed, scope, start/finish, counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.summary import summarize
from .render import iso_time, merged_lines, page_markdown, successful


def page_documents(page_results: DataFrame) -> DataFrame:
    ok = successful(page_results).filter(F.col("output_path").isNotNull())
    return page_markdown(ok).select("crawl_id", "output_path", "markdown")


def write_pages(page_results: DataFrame, path: str) -> None:
    page_documents(page_results).write.mode("overwrite").partitionBy("crawl_id").parquet(path)


def export_page_files(docs: DataFrame, root: str, run: str = "pages") -> None:
    """One Markdown file per page at ``root/<run>/<crawl_id>/<output_path>``, see ``sources/page_files.py``."""
    from ..session import ship_package
    from ..sources.page_files import PageFiles

    spark = docs.sparkSession
    ship_package(spark)
    spark.dataSource.register(PageFiles)
    own = docs.select(F.col("crawl_id").cast("string").alias("crawl_id"), "output_path", "markdown")
    own.write.format("page_files").mode("append").option("run", run).save(root)


def read_page_files(crawls: DataFrame, root: str, run: str = "pages") -> DataFrame:
    """The ``.md`` files of each ``crawl_id`` of ``crawls``: name (``<crawl_id>/<output_path>``), n_bytes, sha256.

    Each task lists and reads the folders of its crawls, one file at a time; no list of files reaches the driver.
    """
    from ..session import ship_package
    from ..sources.page_files import files_of

    spark = crawls.sparkSession
    ship_package(spark)
    base = f"{root.rstrip('/')}/{run}"

    def read(batches):
        for batch in batches:
            for crawl in batch.column("crawl_id").to_pylist():
                yield from files_of(base, crawl)

    folders = crawls.select(F.col("crawl_id").cast("string").alias("crawl_id")).filter(F.col("crawl_id").isNotNull())
    tasks = 4 * spark.sparkContext.defaultParallelism
    return folders.repartition(tasks, "crawl_id").mapInArrow(read, "name string, n_bytes long, sha256 string")


def write_merged(page_results: DataFrame, scopes: DataFrame, path: str) -> None:
    lines = merged_lines(page_results, scopes)
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, "crawl_id", "part", "seq", "line").sortWithinPartitions(
        "crawl_id", "part", "seq", "line"
    )
    ordered.select("crawl_id", "text").write.mode("overwrite").partitionBy("crawl_id").text(path)


def manifest_summary(page_results: DataFrame, scopes: DataFrame) -> DataFrame:
    s = summarize(page_results)
    return scopes.select("crawl_id", F.col("seed").alias("seed_url"),
                         F.struct(F.col("base_url"), F.col("mode")).alias("scope")).join(s, "crawl_id", "left").select(
        "crawl_id", "seed_url", "scope",
        iso_time(F.col("started_at")).alias("started_at"), iso_time(F.col("finished_at")).alias("finished_at"),
        F.struct(
            F.coalesce(F.col("total"), F.lit(0)).alias("total"),
            F.coalesce(F.col("succeeded"), F.lit(0)).alias("succeeded"),
            F.coalesce(F.col("skipped"), F.lit(0)).alias("skipped"),
            F.coalesce(F.col("failed"), F.lit(0)).alias("failed"),
            F.coalesce(F.col("duration_ms"), F.lit(0)).alias("duration_ms"),
        ).alias("summary"),
    )


def manifest_results(page_results: DataFrame) -> DataFrame:
    return page_results.drop("content").withColumn("crawled_at", iso_time(F.col("crawled_at")))


def write_manifest(page_results: DataFrame, scopes: DataFrame, path: str) -> None:
    manifest_summary(page_results, scopes).write.mode("overwrite").json(f"{path}/summary")
    manifest_results(page_results).write.mode("overwrite").partitionBy("crawl_id").json(f"{path}/results")


def write_corpus(page_results: DataFrame, scopes: DataFrame, path: str, single_file: bool = False) -> None:
    """Per-page documents (or merged documents) plus the manifest."""
    if single_file:
        write_merged(page_results, scopes, f"{path}/merged")
    else:
        write_pages(page_results, f"{path}/pages")
    write_manifest(page_results, scopes, f"{path}/manifest")
