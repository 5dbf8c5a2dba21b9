"""Pages over HTTP: fetching in Arrow batches, grouped by host, for pages and robots.txt.

One session for each task keeps connections alive; redirects are followed by hand, so that every hop is
checked against the public-address rule."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import routing_host
from millrace.settings import DEFAULTS, Settings

_SCHEMA = (
    "id string, url string, final_url string, status int, content_type string, html string, truncated boolean,"
    " retry_after string, duration_ms long, fetched_ms long, blocked_address boolean, net_error string"
)
_HEADERS = {"Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8"}


def fetch(requests: DataFrame, cap: int = DEFAULTS.body_cap, timeout_s: float = 15.0, user_agent: str = DEFAULTS.agent + "/1.0", redirects: int = 5, private: bool = False, tasks: int | None = None) -> DataFrame:
    """requests (id, url) fetched. private=True lets loopback and private addresses through (tests)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ipaddress
        import socket
        from urllib.parse import urljoin, urlsplit

        import requests as http

        session = http.Session()
        session.headers.update(_HEADERS | {"User-Agent": user_agent})

        def blocked(url: str) -> bool:
            parts = urlsplit(url)
            infos = socket.getaddrinfo(parts.hostname, parts.port or 80, proto=socket.IPPROTO_TCP)
            return not private and not all(ipaddress.ip_address(i[4][0].split("%")[0]).is_global for i in infos)

        def one(i: str, url: str) -> dict:
            began, at = time.monotonic(), url
            row = dict.fromkeys(_COLUMNS) | {"id": i, "url": url, "truncated": False, "blocked_address": False, "fetched_ms": int(datetime.now(timezone.utc).timestamp() * 1000)}
            try:
                for _ in range(redirects + 1):
                    if blocked(at):
                        return row | {"blocked_address": True}
                    with session.get(at, timeout=timeout_s, allow_redirects=False, stream=True) as r:
                        if r.is_redirect:
                            at = urljoin(at, r.headers["location"])
                            continue
                        body = r.raw.read(cap + 1, decode_content=True)
                        html = body[:cap].decode(r.encoding or "utf-8", "replace")
                        return row | {
                            "final_url": at, "status": r.status_code, "content_type": r.headers.get("content-type"),
                            "html": html, "truncated": len(body) > cap, "retry_after": r.headers.get("retry-after"),
                            "duration_ms": int((time.monotonic() - began) * 1000),
                        }
                return row | {"net_error": "too many redirects"}
            except Exception as e:  # noqa: BLE001 - any failure of one fetch is its row's error
                return row | {"net_error": f"{type(e).__name__}: {e}"[:300]}

        for pdf in batches:
            yield pd.DataFrame([one(i, u) for i, u in zip(pdf["id"], pdf["url"])], columns=_COLUMNS)

    _COLUMNS = [f.split()[0] for f in _SCHEMA.split(", ")]
    rows = requests.select(F.col("id").cast("string").alias("id"), "url").withColumn("h", routing_host(F.col("url")))
    rows = rows.repartition(tasks, "h") if tasks else rows.repartition("h")
    return rows.select("id", "url").mapInPandas(run, _SCHEMA)


def robots_requests(targets: DataFrame) -> DataFrame:
    """One request for each host: (id = host, url of its robots.txt)."""
    host = routing_host(F.col("url"))
    return (
        targets.withColumn("id", host)
        .filter("id <> ''")
        .groupBy("id")
        .agg(F.min(F.concat(F.lower(F.substring_index("url", "://", 1)), F.lit("://"), host, F.lit("/robots.txt"))).alias("url"))
    )


def fetch_robots(targets: DataFrame, s: Settings = DEFAULTS, **options) -> DataFrame:
    """(host, status, body, fetched_ms, robots_error), each host once, capped."""
    got = fetch(robots_requests(targets), cap=s.robots_cap, **options)
    return got.select(F.col("id").alias("host"), "status", F.col("html").alias("body"), "fetched_ms", F.col("net_error").alias("robots_error"))
