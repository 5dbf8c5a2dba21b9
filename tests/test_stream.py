import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from millrace.sources import fetch
from millrace.streaming import pipeline
from tests_support import PAGE


def test_batches_commit_once(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    pages = [
        ("j", 1, "https://a.test/1", "<title>1</title><body><p>same text<a href='/n'>n</a></body>", False, "", 0, 2, 1),
        ("j", 2, "https://a.test/2", "<title>2</title><body><p>same text<a href='/m'>n</a></body>", False, "", 0, 2, 2),
        ("j", 3, "https://a.test/3", "<body><p>other</body>", False, "", 0, 2, 3),
    ]
    df = spark.createDataFrame(pages, PAGE)
    df.filter("page_id = 1").coalesce(1).write.mode("append").parquet(str(source))
    pipeline.run_pages(spark, str(source), df.schema, root).awaitTermination()
    df.filter("page_id > 1").coalesce(1).write.mode("append").parquet(str(source))
    pipeline.run_pages(spark, str(source), df.schema, root).awaitTermination()
    docs = pipeline.committed(spark, root, "documents")
    assert sorted(r.page_id for r in docs.collect()) == [1, 3]
    counts = pipeline.committed(spark, root, "counters").agg(*[F.sum(c).alias(c) for c in ("pages_parsed", "pages_duplicate", "links_enqueued")]).first()
    assert tuple(counts) == (2, 1, 1)
    before = docs.count()
    pipeline.commit_batch(root)(df.filter("page_id > 1"), 1)  # the same batch again
    assert pipeline.committed(spark, root, "documents").count() == before


def test_crawl_stops():
    pages = iter([3, 3, 3, 0])
    assert pipeline.crawl(lambda n: next(pages), 5) == 6
    assert pipeline.crawl(lambda n: 0, 5) == 0


def test_turns_of_a_crawl(spark):
    targets = [(1, "https://a.test/x", "a.test", 0), (2, "https://a.test/y", "a.test", 0), (3, "https://b.test/", "b.test", 2), (4, "https://c.test/", "c.test", 0)]
    t = spark.createDataFrame(targets, "target_id long, url string, host string, attempts int").withColumn("score", F.col("target_id"))
    t = t.withColumns({"scope_host": F.lit(""), "stay_in_domain": F.lit(False)})
    state = {"scheduled": t, "delayed": t.limit(0).withColumn("not_before_ms", F.lit(0).cast("long")), "hosts": spark.createDataFrame([("c.test", 5000)], "host string, ready_at_ms long")}

    def fetch(claims):
        none, busy = F.lit(None).cast("string"), F.col("host").isin("b.test", "c.test")
        return claims.withColumns(
            {"robots_error": none, "allowed": F.lit(True), "crawl_delay_ms": F.lit(0), "blocked_address": F.lit(False), "net_error": none,
             "status": F.when(busy, 503).otherwise(200), "final_url": F.col("url"), "content_type": F.lit("text/html"), "body_head": none, "retry_after_ms": F.lit(0)}
        )

    ids = lambda df: sorted(r.target_id for r in df.collect())
    one = pipeline.turn(state, fetch, 0)
    assert ids(one["pages"]) == [1] and ids(one["dead"]) == [3] and ids(one["scheduled"]) == [2, 4]
    early = pipeline.turn(one, fetch, 500)
    assert ids(early["pages"]) == [] and ids(early["scheduled"]) == [2, 4]
    two = pipeline.turn(early, fetch, 5000)
    assert ids(two["pages"]) == [2] and ids(two["delayed"]) == [4] and two["delayed"].first().not_before_ms == 10_000
    three = pipeline.turn(two, fetch, 10_000)
    assert ids(three["scheduled"]) == [] and three["delayed"].first().attempts == 2
    last = pipeline.turn(three, fetch, 60_000, stopping=True)
    assert ids(last["release"]) == [4] == ids(last["scheduled"]) and ids(last["pages"]) == []


def test_files_are_written_by_rename(spark, tmp_path):
    from millrace.operators import sinks

    files = spark.createDataFrame([("j/a.md", "ä"), ("j/b.md", "")], "path string, content string")
    for root in (str(tmp_path / "x"), f"file://{tmp_path}/y"):
        sinks.write_files(files, root)
        sinks.write_files(files, root)
    assert sorted(p.name for p in (tmp_path / "y" / "j").iterdir()) == ["a.md", "b.md"] and (tmp_path / "x/j/a.md").read_text(encoding="utf-8") == "ä"
    sinks.reset(str(tmp_path / "x"), str(tmp_path / "nothing"))
    assert not (tmp_path / "x").exists()


def test_windowed_counts_need_event_time(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 05:00:00", "b")], "ts string, k string")
    df.select(F.col("ts").cast("timestamp").alias("ts"), "k").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e"))
    q = pipeline.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("wc").collect()) == [("a", 2), ("b", 1)]


class _Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/go":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        self.send_response(429 if self.path == "/busy" else 200)
        self.send_header("Content-Type", "text/html")
        if self.path == "/busy":
            self.send_header("Retry-After", "120")
        self.end_headers()
        self.wfile.write(b"User-agent: *\nDisallow: /x\n" if self.path == "/robots.txt" else b"a" * 2048)

    def log_message(self, *a):
        pass


def test_fetch(spark):
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asks = spark.createDataFrame([("1", base + "/page"), ("2", base + "/go"), ("3", base + "/busy"), ("4", "http://127.0.0.1:1/")], "id string, url string")
    got = {r.id: r for r in fetch.fetch(asks, cap=1024, private=True, tasks=1).collect()}
    assert (got["1"].status, len(got["1"].html), got["1"].truncated) == (200, 1024, True)
    assert got["2"].final_url == base + "/page" and got["3"].retry_after == "120" and got["4"].net_error
    assert fetch.fetch(asks.filter("id = '1'"), tasks=1).first().blocked_address
    robots = fetch.fetch_robots(asks.filter("id < '3'"), private=True, tasks=1).collect()
    assert len(robots) == 1 and robots[0].body.startswith("User-agent")
    server.shutdown()
