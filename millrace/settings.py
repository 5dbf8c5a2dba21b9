"""Settings whose values are part of the results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_depth: int = 2
    priority: int = 5
    batch_urls: int = 1000
    documents_limit: int = 10
    documents_most: int = 50
    dead_letters_limit: int = 20
    replay_count: int = 100
    route_batch: int = 1000
    promote_batch: int = 500
    claim_scan: int = 50
    retry_base_ms: int = 5_000
    retry_most_ms: int = 300_000
    retry_after_most_ms: int = 3_600_000
    max_attempts: int = 3
    visibility_ms: int = 120_000
    max_redeliveries: int = 3
    politeness_ms: int = 1_000
    crawl_delay_most_ms: int = 30_000
    body_cap: int = 5 * 1024 * 1024
    robots_cap: int = 500 * 1024
    robots_ttl_ms: int = 24 * 3_600_000
    robots_error_ttl_ms: int = 3_600_000
    page_ttl_ms: int = 7 * 24 * 3_600_000
    retained_documents: int = 10_000
    chunk_words: int = 400
    chunk_overlap: int = 50
    agent: str = "millrace"


DEFAULTS = Settings()
