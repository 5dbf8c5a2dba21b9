"""Schemas of the records, as DDL."""

CRAWL_TARGET = (
    "job_id string, url string, depth int, max_depth int, priority int, stay_in_domain boolean, scope_host string,"
    " attempts int, created_at string"
)
RAW_PAGE = (
    "job_id string, url string, status_code int, content_type string, depth int, max_depth int, stay_in_domain boolean,"
    " scope_host string, html string, duration_ms long, fetched_at string"
)
PARSED_DOCUMENT = (
    "job_id string, url string, title string, meta_description string, extracted_links array<string>, text_sample string,"
    " markdown string, estimated_tokens int, raw_html_bytes long, markdown_bytes long, token_savings_pct double,"
    " parsed_at timestamp"
)
DEAD_LETTER = "payload string, reason string, failed_at_ms long"
CHUNK = "chunk_id string, index int, url string, title string, section string, content string, estimated_tokens int"
COUNTERS = ("pages_fetched", "pages_failed", "pages_skipped", "fetch_retries", "pages_parsed", "pages_duplicate", "links_enqueued")
