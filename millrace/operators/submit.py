"""Submission of seeds: canonical form, duplicates within the batch, already seen addresses, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import canonicalize, strip, url_host
from millrace.settings import DEFAULTS, Settings


def classified(seeds: DataFrame, seen: DataFrame, url: str = "url", pos: str = "pos", force: bool = False, idn: bool = True) -> DataFrame:
    """seeds with canonical and kind: blank, invalid, duplicate (of an earlier one in the batch), seen,
    enqueued. `seen` holds canonical addresses in its column url. With force, seen ones are enqueued too,
    duplicates within the batch are not. Null seeds are blank."""
    s = seeds.withColumn("canonical", canonicalize(F.col(url), idn))
    blank = F.coalesce(strip(F.col(url)), F.lit("")) == ""
    # The first of each address by position: an aggregate with map-side combine, then one equi-join.
    firsts = s.filter("canonical is not null").groupBy("canonical").agg(F.min(pos).alias("first_pos"))
    known = seen.select(F.col("url").alias("canonical")).distinct().withColumn("known", F.lit(True))
    kind = (
        F.when(blank, "blank")
        .when(F.col("canonical").isNull(), "invalid")
        .when(F.col(pos) > F.col("first_pos"), "duplicate")
        .when(F.col("known") & F.lit(not force), "seen")
        .otherwise("enqueued")
    )
    return s.join(firsts.join(known, "canonical", "left"), "canonical", "left").withColumn("kind", kind).drop("first_pos", "known")


def targets(enqueued: DataFrame, s: Settings = DEFAULTS, job_id: Column | None = None) -> DataFrame:
    """CrawlTarget rows of the enqueued seeds; the job id is a new uuid unless given."""
    return enqueued.select(
        (job_id if job_id is not None else F.expr("uuid()")).alias("job_id"),
        F.col("canonical").alias("url"),
        F.lit(0).alias("depth"),
        F.lit(s.max_depth).alias("max_depth"),
        F.lit(s.priority).alias("priority"),
        F.lit(True).alias("stay_in_domain"),
        url_host(F.col("canonical")).alias("scope_host"),
        F.lit(0).alias("attempts"),
    )


def report(kinds: DataFrame) -> DataFrame:
    """The answer to a batch: counts over everything received. Blank seeds count as received only; seeds
    repeated in the batch and seeds seen before are both deduplicated."""
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return kinds.agg(
        F.count(F.lit(1)).alias("total_received"),
        n("enqueued").alias("enqueued_count"),
        n("duplicate", "seen").alias("deduplicated_count"),
        n("invalid").alias("invalid_count"),
    )


def batch_report(kinds: DataFrame, pos: str = "pos", url: str = "url", s: Settings = DEFAULTS) -> DataFrame:
    """report with the lists of addresses in input order, for one batch, whose size the API bounds by
    s.batch_urls: larger inputs are split into batches by position, one row each. Seeds that repeat an
    earlier one are counted but not listed."""
    b = kinds.withColumn("batch", F.floor(F.col(pos) / s.batch_urls))

    def listed(kind: str, column: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(pos, F.col(column).alias("u")))))
        return F.transform(rows, lambda r: r["u"])

    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return b.groupBy("batch").agg(
        F.count(F.lit(1)).alias("total_received"),
        n("enqueued").alias("enqueued_count"),
        n("duplicate", "seen").alias("deduplicated_count"),
        n("invalid").alias("invalid_count"),
        listed("enqueued", "canonical").alias("enqueued_urls"),
        listed("seen", "canonical").alias("deduplicated_urls"),
        listed("invalid", url).alias("invalid_urls"),
    )


def new_addresses(candidates: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Distinct candidate addresses that were not seen."""
    return candidates.select(key).distinct().join(seen.select(key), key, "left_anti")


def children(docs: DataFrame, seen: DataFrame | None = None, priority: int = DEFAULTS.priority) -> DataFrame:
    """Targets one step deeper for every link of documents that may go deeper, once for each address."""
    c = docs.filter(F.col("depth") + 1 <= F.col("max_depth")).select(
        "job_id",
        F.explode("extracted_links").alias("url"),
        (F.col("depth") + 1).alias("depth"),
        "max_depth",
        F.lit(priority).alias("priority"),
        "stay_in_domain",
        "scope_host",
    )
    # Of equal addresses the shallowest; the other columns only make the choice certain.
    first = F.min(F.struct("depth", "job_id", "max_depth", "stay_in_domain", "scope_host", "priority"))
    c = c.groupBy("url").agg(first.alias("t")).select("t.job_id", "t.depth", "t.max_depth", "t.priority", "t.stay_in_domain", "t.scope_host", "url")
    return c if seen is None else c.join(seen.select("url"), "url", "left_anti")


def distinct_addresses(urls: DataFrame, key: str = "url", approximate: bool = False) -> DataFrame:
    """How many addresses were seen: exact, or by HyperLogLog."""
    n = F.approx_count_distinct(key) if approximate else F.countDistinct(key)
    return urls.agg(n.alias("unique_urls_seen"))


