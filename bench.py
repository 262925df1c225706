"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is fully computed through Spark's ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavecrawl.plans import queries as Q  # noqa: E402
from wavecrawl.session import local_session  # noqa: E402
from wavecrawl.sources.tables import read_table  # noqa: E402

HEADLINE = [
    "normalize_urls",
    "link_extract",
    "reject_reason_counts",
    "extract_pages",
    "page_markdown",
    "page_hash_words",
    "output_paths",
    "heading_anchors",
    "final_url_dedup",
    "status_summary",
    "attempt_resolution",
    "sitemap_expand",
    "crawl_reachability",
    "crawl_capped",
    "pages_crawl",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="wavecrawl-bench")
    # Warm-up: JVM, Python workers, codegen caches (not timed).
    Q.normalize_urls(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    waves = None
    for name in HEADLINE:
        if only and name not in only:
            continue
        t = time.perf_counter()
        df = Q.REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        if name == "crawl_reachability":  # no sitemap seeds: wave k holds depth k
            waves = df.agg({"depth": "max"}).first()[0] + 1
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    n_pages = read_table(spark, sf_dir, "pages").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "pages": n_pages,
    }
    if "extract_pages" in times:
        out["extract_pages_per_sec"] = round(n_pages / times["extract_pages"], 1)
    if waves:
        out["crawl_waves"] = waves
        out["crawl_sec_per_wave"] = round(times["crawl_reachability"] / waves, 3)
    if "link_extract" in times:
        out["link_extract_pages_per_sec"] = round(n_pages / times["link_extract"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
