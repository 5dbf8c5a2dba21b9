"""Job accounting, totals, cluster metrics and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import cluster_savings_pct
from millrace.schemas import COUNTERS

# Names and help texts of the exposition.
GAUGES = (
    ("crawler_frontier_pending", "Targets waiting to be crawled (ingest + host queues)", "pending_queue"),
    ("crawler_frontier_active_hosts", "Hosts with scheduled targets or a politeness window", "active_hosts"),
    ("crawler_frontier_in_flight", "Targets claimed by a crawler worker", "in_flight_processing"),
    ("crawler_frontier_delayed", "Targets waiting for a retry", "delayed_retry"),
    ("crawler_frontier_dead_letters", "Targets in the frontier dead-letter list", "dead_letter"),
    ("crawler_raw_pages_pending", "Fetched pages waiting for the parser", "raw_pages_for_parser"),
    ("crawler_raw_pages_in_flight", "Pages being parsed", "raw_pages_in_flight"),
    ("crawler_raw_pages_dead_letters", "Pages in the parser dead-letter list", "raw_pages_dead_letter"),
    ("crawler_urls_seen", "Unique URLs recorded by the seen filter", "unique_urls_seen"),
)
TOTALS = (
    ("crawler_documents_parsed_total", "Documents parsed", "parsed_documents_total"),
    ("crawler_markdown_tokens_total", "Estimated Markdown tokens produced", "total_markdown_tokens_est"),
)


def counters(events: DataFrame, job: str = "job_id", counter: str = "counter") -> DataFrame:
    """One row for each job with its seven counters, from an event log."""
    return events.groupBy(job).agg(*[F.count_if(F.col(counter) == c).alias(c) for c in COUNTERS])


def accounting(log: DataFrame) -> DataFrame:
    """(job_id, outstanding, status, completed_at_ms) from log rows (job_id, delta, at_ms, claimed): delta is
    +1 for each enqueued or replayed item and -1 for each finished one. A job is completed when nothing is
    outstanding any more, running once something was claimed or finished, else enqueued."""
    j = log.groupBy("job_id").agg(
        F.sum("delta").alias("outstanding"),
        F.max(F.when(F.col("delta") < 0, F.col("at_ms"))).alias("last_finish"),
        F.max(F.coalesce("claimed", F.lit(False)) | (F.col("delta") < 0)).alias("began"),
    )
    done = F.col("outstanding") <= 0
    return j.select(
        "job_id",
        F.col("outstanding").cast("long").alias("outstanding"),
        F.when(done, "completed").when(F.col("began"), "running").otherwise("enqueued").alias("status"),
        F.when(done, F.col("last_finish")).alias("completed_at_ms"),
    )


def job_status(jobs: DataFrame, job_id: str) -> DataFrame:
    """The row of one job; no row if unknown."""
    return jobs.filter(F.col("job_id") == job_id)


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("raw_html_bytes"), F.lit(0)).alias("raw_html_bytes"),
        F.coalesce(F.sum("markdown_bytes"), F.lit(0)).alias("markdown_bytes"),
        F.coalesce(F.sum(F.col("estimated_tokens").cast("long")), F.lit(0)).alias("markdown_tokens"),
    )


def throughput(documents: Column, elapsed_s: Column, at_start: Column) -> Column:
    """Documents a second over at least one second, and those of this session."""
    return F.struct(
        F.round(documents / F.greatest(F.lit(1.0), elapsed_s), 1).alias("docs_per_s"),
        (documents - at_start).alias("session_documents"),
    )


def cluster_metrics(**parts: DataFrame) -> DataFrame:
    """One row from one-row parts, named by their columns; savings from the byte totals."""
    out = None
    for df in parts.values():
        out = df if out is None else out.crossJoin(df)  # each of one row
    return out.withColumn("token_savings_pct", cluster_savings_pct(F.col("markdown_bytes"), F.col("raw_html_bytes")))


def prometheus_lines(metrics: DataFrame) -> DataFrame:
    """(line_no, line): HELP, TYPE and value of every gauge and counter."""
    rows = []
    for kind, group in (("gauge", GAUGES), ("counter", TOTALS)):
        for name, help_text, field in group:
            rows += [F.lit(f"# HELP {name} {help_text}"), F.lit(f"# TYPE {name} {kind}"), F.concat(F.lit(f"{name} "), F.col(field).cast("string"))]
    return metrics.select(F.posexplode(F.array(*rows)).alias("line_no", "line"))
