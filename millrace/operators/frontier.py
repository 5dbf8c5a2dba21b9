"""The frontier: routing, the schedule of each host, politeness, delayed retries, leases, settling.

Times are epoch milliseconds and never read from a clock here: `now_ms` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.urls import routing_host
from millrace.operators.ordered import running
from millrace.settings import DEFAULTS, Settings


def clamped_priority(priority: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(priority, F.lit(DEFAULTS.priority))))


def queue_score(priority: Column, ms: Column) -> Column:
    """Order within a host: higher priority first, then arrival."""
    return (F.lit(10) - clamped_priority(priority)).cast("long") * F.lit(10_000_000_000_000) + ms


def route(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed with `host`, unroutable as dead letters without a time)."""
    t = targets.withColumn("host", routing_host(F.coalesce("url", F.lit(""))))
    dead = t.filter(F.col("host") == "").select(
        F.to_json(F.struct(*targets.columns)).alias("payload"), F.lit("unroutable").alias("reason")
    )
    return t.filter(F.col("host") != ""), dead


def scheduled_once(routed: DataFrame, item: list[str]) -> DataFrame:
    """An identical target is scheduled once on its host."""
    return routed.dropDuplicates(["host", *item])


def next_claims(routed: DataFrame, hosts: DataFrame | None, now_ms: int, tie: str) -> DataFrame:
    """The best target of every host that is ready (hosts: host, ready_at_ms; absent hosts are ready)."""
    if hosts is not None:
        ready = F.coalesce("ready_at_ms", F.lit(0)) <= now_ms
        routed = routed.join(hosts, "host", "left").filter(ready).drop("ready_at_ms")
    best = Window.partitionBy("host").orderBy("score", tie)
    return routed.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")


def claim_order(claims: DataFrame, hosts: DataFrame, limit: int = DEFAULTS.claim_scan) -> DataFrame:
    """The hosts that one scan looks at: by ready time, then name."""
    return claims.join(hosts, "host").orderBy("ready_at_ms", "host").limit(limit)


def politeness_plan(routed: DataFrame, gap_ms: Column, tie: str, start_ms: int) -> DataFrame:
    """Earliest contact of every target: one in flight for each host, each after the gaps before it. A host
    that holds a third of all targets is cut into blocks (see ordered.running)."""
    planned = running(routed, "host", [F.col("score"), F.col(tie)], gap_ms)
    return planned.withColumn("contact_ms", (F.lit(start_ms) + F.col("before")).cast("long")).drop("before")


def next_ready(hosts: DataFrame) -> DataFrame:
    """The earliest ready time of any host."""
    return hosts.agg(F.min("ready_at_ms").alias("next_ready_ms"))


def due_retries(delayed: DataFrame, now_ms: int, tie: str, limit: int = DEFAULTS.promote_batch) -> DataFrame:
    """Delayed targets that are due, the earliest first, at most `limit` in one move."""
    return delayed.filter(F.col("not_before_ms") <= now_ms).orderBy("not_before_ms", tie).limit(limit)


def reap(processing: DataFrame, leases: DataFrame, redeliveries: DataFrame, now_ms: int, s: Settings = DEFAULTS) -> DataFrame:
    """What becomes of every item in processing and every lease: (lease_id, item, action, deadline_ms).

    processing: item; leases: lease_id (sha1 of the item), deadline_ms; redeliveries: lease_id, n. Actions:
    adopt (no lease yet: one is given), keep, requeue, dead (redelivered too often), drop (lease without
    item, expired), wait (lease without item, not expired)."""
    p = processing.withColumn("lease_id", F.sha1("item"))
    both = p.join(leases, "lease_id", "full_outer").join(redeliveries, "lease_id", "left")
    expired = F.col("deadline_ms") <= now_ms
    action = (
        F.when(F.col("item").isNull(), F.when(expired, "drop").otherwise("wait"))
        .when(F.col("deadline_ms").isNull(), "adopt")
        .when(~expired, "keep")
        .when(F.coalesce("n", F.lit(0)) + 1 > s.max_redeliveries, "dead")
        .otherwise("requeue")
    )
    deadline = F.when(action == "adopt", F.lit(now_ms + s.visibility_ms)).otherwise(F.col("deadline_ms"))
    return both.select("lease_id", "item", action.alias("action"), deadline.cast("long").alias("deadline_ms"))


def fenced(settlements: DataFrame, in_processing: DataFrame, keys: list[str]) -> DataFrame:
    """Only settlements of items that are still held count."""
    return settlements.join(in_processing.select(*keys).distinct(), keys, "left_semi")


def settle(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Outcomes by where they go: push, finish, dead, delay, release."""
    return {mode: outcomes.filter(F.col("action") == mode) for mode in ("push", "finish", "dead", "delay", "release")}


def ingest(**producers: DataFrame) -> DataFrame:
    """Ingest from all producers, with their name; retried and reaped items come before new ones."""
    order = {"due": 0, "reaped": 0, "seeds": 1, "children": 1, "replayed": 1}
    out = None
    for name, df in producers.items():
        part = df.withColumn("producer", F.lit(name)).withColumn("lane", F.lit(order.get(name, 1)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
