"""Fetch outcomes: the decision table, retries, gaps, robots rules, media types, body caps, addresses."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.urls import WS, in_scope, strip, url_host
from millrace.settings import DEFAULTS, Settings

# Address blocks that are not public, beside those that a bit test covers.
PRIVATE_V4 = ("0.0.0.0/32", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4")


def retry_after_ms(header: Column, now: Column) -> Column:
    """Retry-After as milliseconds: positive whole seconds, or an HTTP date after now; else 0."""
    seconds = strip(header).try_cast("long")
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.unix_millis(date) - F.unix_millis(now)
    return F.when(seconds > 0, seconds * 1000).when(seconds.isNull() & (until > 0), until).otherwise(F.lit(0)).cast("long")


def is_html(content_type: Column, body: Column) -> Column:
    """By media type; without a header by the first bytes of the body. Broken headers are not html."""
    ct = F.coalesce(content_type, F.lit(""))
    media = F.lower(strip(F.split_part(ct, F.lit(";"), F.lit(1))))
    sniffed = F.lower(F.coalesce(body, F.lit(""))).rlike(
        rf"^{WS}*(?:<!doctype html|<html|<head|<script|<iframe|<h1|<div|<font|<table|<a|<style|<title|<b|<body|<br|<p|<!--)[ >]"
    )
    return F.when(strip(ct) == "", sniffed).otherwise(media.isin("text/html", "application/xhtml+xml"))


def capped_body(body: Column, cap: int = DEFAULTS.body_cap) -> tuple[Column, Column]:
    """(first cap bytes as binary, whether something was cut)."""
    raw = F.encode(body, "UTF-8")
    return F.substring(raw, 1, cap), F.octet_length(body) > cap


def backoff_ms(attempt: Column, retry_after: Column, s: Settings = DEFAULTS) -> Column:
    """Wait before attempt + 1, without jitter: doubling from the base up to the cap, at least Retry-After
    up to its own cap."""
    doubled = F.least(F.lit(s.retry_base_ms).cast("long") * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))).cast("long"), F.lit(s.retry_most_ms).cast("long"))
    return F.greatest(doubled, F.least(F.coalesce(retry_after, F.lit(0)).cast("long"), F.lit(s.retry_after_most_ms).cast("long")))


def jitter_ms(backoff: Column, seed: int | None = None) -> Column:
    """Up to a fifth of the wait, at random."""
    return F.floor(F.rand(seed) * backoff / 5)


def host_gap_ms(crawl_delay: Column, s: Settings = DEFAULTS) -> Column:
    return F.greatest(F.lit(s.politeness_ms), F.least(F.coalesce(crawl_delay, F.lit(0)), F.lit(s.crawl_delay_most_ms))).cast("long")


def fetch_outcomes(fetches: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """fetches with action, counter, reason, gap_ms and delay_ms. Columns read: url, scope_host,
    stay_in_domain, attempts, robots_error, allowed, crawl_delay_ms, blocked_address, net_error, status,
    final_url, content_type, body_head, retry_after_ms. The first rule that matches wins."""
    c = F.col
    host = url_host(F.lower(strip(F.coalesce("url", F.lit("")))))
    gap = host_gap_ms(c("crawl_delay_ms"), s)
    strained = (c("status") == 429) | (c("status") >= 500)
    wait = F.least(F.coalesce("retry_after_ms", F.lit(0)).cast("long"), F.lit(s.retry_after_most_ms).cast("long"))
    boundary = F.coalesce(F.nullif(c("scope_host"), F.lit("")), host)
    away = F.coalesce("stay_in_domain", F.lit(False)) & ~in_scope(url_host(F.lower("final_url")), boundary)
    rules = [
        (host == "", "dead", None, F.lit("invalid URL"), F.lit(0)),
        (c("robots_error").isNotNull(), "retry", None, c("robots_error"), F.lit(s.politeness_ms)),
        (~F.coalesce("allowed", F.lit(True)), "finish", "pages_skipped", F.lit("robots"), F.lit(0)),
        (F.coalesce("blocked_address", F.lit(False)), "dead", None, F.lit("blocked address"), F.lit(0)),
        (c("net_error").isNotNull(), "retry", None, c("net_error"), gap),
        (strained, "retry", None, F.concat(F.lit("HTTP "), c("status").cast("string")), F.greatest(gap, wait)),
        (~c("status").between(200, 299), "finish", "pages_failed", F.concat(F.lit("HTTP "), c("status").cast("string")), gap),
        (away, "finish", "pages_skipped", F.lit("redirected out of scope"), gap),
        (~is_html(c("content_type"), c("body_head")), "finish", "pages_skipped", F.lit("not html"), gap),
    ]

    def first(pick, last: Column) -> Column:
        return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), pick(rule)).otherwise(rest), reversed(rules), last)

    kind = first(lambda r: F.lit(r[1]), F.lit("push"))
    attempt = F.coalesce("attempts", F.lit(0)) + 1
    spent = attempt >= s.max_attempts
    reason = first(lambda r: r[3], F.lit(None).cast("string"))
    heeded = first(lambda r: wait if r[0] is strained else F.lit(0).cast("long"), F.lit(0).cast("long"))
    out = fetches.withColumns(
        {"kind": kind, "why": reason, "gap_ms": first(lambda r: r[4], gap).cast("long"), "attempt": attempt.cast("long"), "heeded": heeded}
    )
    retry = c("kind") == "retry"
    return out.select(
        *fetches.columns,
        F.when(retry, F.when(spent, "dead").otherwise("delay")).otherwise(c("kind")).alias("action"),
        F.when(retry, F.when(spent, "pages_failed").otherwise("fetch_retries"))
        .when(c("kind") == "dead", "pages_failed")
        .when(c("kind") == "push", "pages_fetched")
        .otherwise(first(lambda r: F.lit(r[2]).cast("string"), F.lit(None).cast("string")))
        .alias("counter"),
        F.when(retry & spent, F.concat("why", F.lit(" (after "), c("attempt").cast("string"), F.lit(" attempts)")))
        .otherwise(c("why"))
        .alias("reason"),
        "gap_ms",
        F.when(retry & ~spent, backoff_ms(c("attempt"), c("heeded"), s)).alias("delay_ms"),
    )


def robots_status(status: Column) -> Column:
    """What the status of robots.txt says: parse, allow or disallow everything."""
    return F.when(status.between(200, 299), "parse").when(status.between(400, 499), "allow").when(status >= 500, "disallow").otherwise("allow")


def robots_rules(policies: DataFrame) -> DataFrame:
    """One row for each rule of every policy (host, body): host, agent, field, value, line. Groups open
    with their user-agent lines; a rule belongs to all agents named just before it."""
    lines = policies.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("line", "text"))
    text = strip(F.regexp_replace("text", "#.*$", ""))
    kv = lines.select(
        "host",
        "line",
        F.lower(strip(F.split_part(text, F.lit(":"), F.lit(1)))).alias("field"),
        strip(F.regexp_extract(text, r"^[^:]*:(.*)$", 1)).alias("value"),
    ).filter(F.col("field").isin("user-agent", "disallow", "allow", "crawl-delay"))
    order = Window.partitionBy("host").orderBy("line")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    grouped = kv.withColumn("opens", opens.cast("int")).withColumn("g", F.sum("opens").over(order))
    agents = grouped.filter(is_agent).select("host", "g", F.lower("value").alias("agent"))
    return grouped.filter(~is_agent).join(agents, ["host", "g"]).select("host", "agent", "field", "value", "line")


def robots_decisions(requests: DataFrame, policies: DataFrame, agent: str = DEFAULTS.agent) -> DataFrame:
    """requests (host, path) with allowed and crawl_delay_ms. The group is the one whose agent name is the
    longest that the product token begins with, else '*'; of its rules the longest match decides, allow
    before disallow; '*' and '$' work as usual. A host without policy allows everything."""
    by_status = policies.select("host", robots_status(F.col("status")).alias("says"))
    rules = robots_rules(policies.filter(robots_status(F.col("status")) == "parse"))
    fit = F.when(F.col("agent") == "*", F.lit(0)).when(F.startswith(F.lit(agent.lower()), F.col("agent")) & (F.col("agent") != ""), F.length("agent")).otherwise(F.lit(-1))
    fitting = rules.withColumn("fit", fit).filter("fit >= 0")
    own = fitting.withColumn("best", F.max("fit").over(Window.partitionBy("host"))).filter("fit = best")
    delay = own.filter("field = 'crawl-delay'").groupBy("host").agg(
        F.max((F.col("value").try_cast("double") * 1000).cast("long")).alias("crawl_delay_ms")
    )
    pattern = F.regexp_replace(F.regexp_replace("value", r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*")
    pattern = F.concat(F.lit("^"), F.regexp_replace(pattern, r"\$(?=.)", r"\\$"))
    paths = own.filter("field in ('allow', 'disallow') and value <> ''").select("host", "field", F.length("value").alias("len"), pattern.alias("pattern"))
    hit = requests.join(paths, "host").filter(F.expr("rlike(path, pattern)"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct("len", (F.col("field") == "allow").alias("yes"))).alias("b"))
    return (
        requests.join(by_status, "host", "left")
        .join(delay, "host", "left")
        .join(best, ["host", "path"], "left")
        .select(
            *requests.columns,
            F.when(F.col("says") == "disallow", F.lit(False)).when(F.col("says") == "parse", F.coalesce("b.yes", F.lit(True))).otherwise(F.lit(True)).alias("allowed"),
            F.coalesce("crawl_delay_ms", F.lit(0)).alias("crawl_delay_ms"),
        )
    )


def fresh_policies(policies: DataFrame, now_ms: int, s: Settings = DEFAULTS) -> DataFrame:
    """Policies (status, fetched_ms) whose time has not run out."""
    ttl = F.when(F.col("status") >= 500, s.robots_error_ttl_ms).otherwise(s.robots_ttl_ms)
    return policies.filter(F.col("fetched_ms") + ttl > now_ms)


def public_v4(addr: Column) -> Column:
    """Native test for dotted IPv4 addresses; null for anything else."""
    parts = F.split(addr, r"\.")
    n = reduce(lambda a, k: a * 256 + parts[k].try_cast("long"), range(1, 4), parts[0].try_cast("long"))
    good = addr.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = F.lit(False)
    for block in PRIVATE_V4:
        base, bits = block.split("/")
        low = sum(int(p) << (24 - 8 * k) for k, p in enumerate(base.split(".")))
        inside = inside | n.between(low, low + (1 << (32 - int(bits))) - 1)
    return F.when(good, ~inside)


@F.pandas_udf(T.BooleanType())
def _public(addrs: pd.Series) -> pd.Series:
    import ipaddress

    def test(a: str | None) -> bool | None:
        if a is None:
            return None
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        bad = ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_multicast or ip.is_unspecified
        return not (bad or (ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10")))

    return addrs.map(test, na_action="ignore").astype("boolean")


def public_address(addr: Column) -> Column:
    """Whether an address may be contacted; IPv6 (with mapped IPv4) passes through Arrow, IPv4 does not."""
    v4 = public_v4(addr)
    return F.when(v4.isNotNull(), v4).otherwise(_public(F.when(v4.isNull(), addr)))
