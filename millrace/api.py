"""The public surface in one place: functions over columns and DataFrames by what they do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dom import parse
from millrace.functions.text import clean_markdown
from millrace.functions.text import estimated_tokens as estimate_tokens
from millrace.functions.text import fingerprint as body_fingerprint
from millrace.functions.text import script_language_col as detect_language
from millrace.functions.urls import canonicalize, in_scope
from millrace.functions.urls import link_target as canonicalize_url
from millrace.operators.chunks import chunks as chunk_markdown
from millrace.operators.deadletters import newest as dead_letters
from millrace.operators.deadletters import replay_pages, replay_targets
from millrace.operators.extract import documents as parse_pages
from millrace.operators.extract import extract as extract_page
from millrace.operators.extract import raw_markdown, strip_boilerplate
from millrace.operators.jobs import cluster_metrics, job_status, prometheus_lines
from millrace.operators.sinks import export_documents, reset
from millrace.operators.sinks import newest_documents as latest_documents
from millrace.operators.submit import batch_report
from millrace.operators.submit import classified as submit
from millrace.sources.fetch import fetch, fetch_robots
from millrace.sources.seeds import seed_file
from millrace.streaming.pipeline import crawl, run_pages


def _markdown(pages: pd.Series) -> pd.Series:
    def one(html: str | None) -> str:
        root = parse(html or "")
        strip_boilerplate(root)
        return raw_markdown(root)

    return pages.map(one)


def html_to_markdown(html: Column) -> Column:
    """Markdown of the main part of a page (one Arrow stage, then the native clean-up)."""
    return clean_markdown(F.pandas_udf(_markdown, T.StringType())(html))


def extract_content(pages: DataFrame) -> DataFrame:
    """(title, meta_description, text_sample, markdown, extracted_links) of raw pages."""
    return parse_pages(pages).select("title", "meta_description", "text_sample", "markdown", "extracted_links")


__all__ = [
    "batch_report", "body_fingerprint", "canonicalize", "canonicalize_url", "chunk_markdown", "cluster_metrics", "crawl", "dead_letters",
    "detect_language", "estimate_tokens", "export_documents", "extract_content", "extract_page", "fetch", "fetch_robots", "html_to_markdown",
    "in_scope", "job_status", "latest_documents", "parse_pages", "prometheus_lines", "replay_pages", "replay_targets", "reset", "run_pages",
    "seed_file", "submit",
]
