"""Public jobs: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions.urls import canonicalize
from .operators import extract as _x
from .operators.naming import assign_output_paths, heading_anchors
from .operators.render import merged_lines, page_markdown
from .operators.sinks import write_corpus
from .plans.crawl import CrawlOutput, crawl, discover, queued_counts
from .plans.summary import summarize
from .sources.crawls import derive_scopes
from .sources.responses import resolve_attempts
from .streaming.admit import admit_stream
from .operators.filters import filter_urls


def canonicalize_urls(df: DataFrame, url_col: str, base_col: str | None = None,
                      out: str = "normalized_url") -> DataFrame:
    """Any URL table → + canonical URL column (NULL when unparsable)."""
    return canonicalize(df, url_col, base_col, out)


def _snapshot(responses: DataFrame, want_content: bool, want_links: bool = True):
    from .plans.snapshot import prepare_snapshot
    from .session import new_run_dir

    return prepare_snapshot(responses, new_run_dir(responses.sparkSession, "snapshot"), want_content, want_links)


def extract_links(responses: DataFrame) -> DataFrame:
    """Captured responses → (url, final_url, pos, href, link_url), one row per distinct link per page."""
    return _snapshot(responses, want_content=False, want_links=False).links


def extract_page_urls(responses: DataFrame) -> DataFrame:
    """Captured responses → URL metadata rows (url, pos, kind, value, fixed_value)."""
    return _snapshot(responses, want_content=False, want_links=False).page_urls


def extract_pages(responses: DataFrame, min_words: int = _x.MIN_WORDS) -> DataFrame:
    """Captured responses → one page result per capture, without crawling (depth 0, no scope)."""
    return _x.extract_pages(responses, min_words)


render_pages = page_markdown
render_merged = merged_lines

__all__ = [
    "CrawlOutput", "admit_stream", "assign_output_paths", "canonicalize_urls", "crawl", "derive_scopes", "discover",
    "extract_links", "extract_page_urls", "extract_pages", "filter_urls", "heading_anchors", "queued_counts",
    "render_merged", "render_pages", "resolve_attempts", "summarize", "write_corpus",
]
