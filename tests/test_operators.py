import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunks, deadletters, frontier, jobs, outcomes, sinks, submit
from millrace.settings import Settings
from millrace.sources import seeds

FETCH = (
    "k int, url string, scope_host string, stay_in_domain boolean, attempts int, robots_error string, allowed boolean, crawl_delay_ms long,"
    " blocked_address boolean, net_error string, status int, final_url string, content_type string, body_head string, retry_after_ms long"
)


def fetched(spark, **kw):
    row = dict(
        k=0, url="https://a.test/", scope_host="a.test", stay_in_domain=True, attempts=0, robots_error=None, allowed=True, crawl_delay_ms=0,
        blocked_address=False, net_error=None, status=200, final_url="https://a.test/", content_type="text/html", body_head="", retry_after_ms=0,
    )
    row.update(kw)
    return outcomes.fetch_outcomes(spark.createDataFrame([tuple(row.values())], FETCH)).first()


@pytest.mark.parametrize(
    "given,action,counter,gap,delay",
    [
        ({}, "push", "pages_fetched", 1000, None),
        ({"status": 503}, "delay", "fetch_retries", 1000, 5000),
        ({"status": 502, "attempts": 2}, "dead", "pages_failed", 1000, None),
        ({"status": 404}, "finish", "pages_failed", 1000, None),
        ({"content_type": "application/pdf"}, "finish", "pages_skipped", 1000, None),
        ({"allowed": False}, "finish", "pages_skipped", 0, None),
        ({"crawl_delay_ms": 10_000}, "push", "pages_fetched", 10_000, None),
        ({"crawl_delay_ms": 90_000}, "push", "pages_fetched", 30_000, None),
        ({"status": 429, "retry_after_ms": 30_000}, "delay", "fetch_retries", 30_000, 30_000),
        ({"url": "http:///x"}, "dead", "pages_failed", 0, None),
        ({"url": None}, "dead", "pages_failed", 0, None),
        ({"final_url": "https://b.test/"}, "finish", "pages_skipped", 1000, None),
        ({"final_url": "https://b.test/", "stay_in_domain": False}, "push", "pages_fetched", 1000, None),
        ({"final_url": "https://x.a.test/", "scope_host": ""}, "push", "pages_fetched", 1000, None),
        ({"blocked_address": True}, "dead", "pages_failed", 0, None),
        ({"net_error": "reset", "attempts": 1}, "delay", "fetch_retries", 1000, 10_000),
        ({"robots_error": "no robots", "status": 503, "retry_after_ms": 60_000}, "delay", "fetch_retries", 1000, 5000),
    ],
)
def test_outcomes(spark, given, action, counter, gap, delay):
    r = fetched(spark, **given)
    assert (r.action, r.counter, r.gap_ms, r.delay_ms) == (action, counter, gap, delay)


def test_dead_reason_counts_attempts(spark):
    assert fetched(spark, status=502, attempts=2).reason == "HTTP 502 (after 3 attempts)"


def test_backoff_is_capped(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (7, 0), (60, 0), (1, 9_000_000)], "n int, ra long")
    got = [r[0] for r in df.select(outcomes.backoff_ms(F.col("n"), F.col("ra"))).collect()]
    assert got == [5_000, 10_000, 300_000, 300_000, 3_600_000]


def test_jitter_stays_below_a_fifth(spark):
    r = spark.range(200).select(outcomes.jitter_ms(F.lit(5000), 1).alias("j")).agg(F.min("j"), F.max("j")).first()
    assert 0 <= r[0] < r[1] < 1000


def test_is_html(spark):
    cases = [
        ("text/html; charset=utf-8", "", True), ("application/xhtml+xml", "", True), ("application/pdf", "%PDF", False), ("image/png", "", False),
        ("application/json", "{}", False), ("", "<!DOCTYPE html><html>", True), ("", "%PDF-1.7", False), (None, "<html>", True), (None, None, False),
    ]
    df = spark.createDataFrame(cases, "c string, b string, want boolean")
    assert df.filter(outcomes.is_html(F.col("c"), F.col("b")) != F.col("want")).count() == 0


def test_truncation(spark):
    body, cut = outcomes.capped_body(F.col("b"), 1024)
    r = spark.createDataFrame([("a" * 2048,), ("é" * 512,)], "b string").select(F.octet_length(body), cut).collect()
    assert [tuple(x) for x in r] == [(1024, True), (1024, False)]


def test_robots(spark):
    body = "User-agent: millrace\nDisallow: /private\nAllow: /private/ok$\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /\n"
    policies = spark.createDataFrame([("a", 200, body), ("b", 404, ""), ("c", 503, ""), ("d", 200, "User-agent: *\nDisallow: /*.pdf$\n"), ("f", 200, None)], "host string, status int, body string")
    asks = [("a", "/public"), ("a", "/private/x?y=1"), ("a", "/private/ok"), ("b", "/x"), ("c", "/x"), ("d", "/a.pdf"), ("d", "/a.pdfx"), ("e", "/x"), ("f", "/x")]
    got = outcomes.robots_decisions(spark.createDataFrame(asks, "host string, path string"), policies)
    by = {(r.host, r.path): (r.allowed, r.crawl_delay_ms) for r in got.collect()}
    assert by == {
        ("a", "/public"): (True, 3000), ("a", "/private/x?y=1"): (False, 3000), ("a", "/private/ok"): (True, 3000), ("b", "/x"): (True, 0),
        ("c", "/x"): (False, 0), ("d", "/a.pdf"): (False, 0), ("d", "/a.pdfx"): (True, 0), ("e", "/x"): (True, 0), ("f", "/x"): (True, 0),
    }


def test_public_addresses(spark):
    # Addresses and whether they are public.
    _ADDRESSES = {
        "93.184.216.34": True, "2606:4700::1111": True, "127.0.0.1": False, "10.1.2.3": False, "172.16.0.1": False, "192.168.1.1": False,
        "169.254.169.254": False, "100.64.0.1": False, "0.0.0.0": False, "::1": False, "fe80::1": False, "fd00::1": False,
        "::ffff:127.0.0.1": False, "224.0.0.1": False,
    }

    df = spark.createDataFrame([*_ADDRESSES.items(), ("nonsense", False)], "a string, want boolean")
    assert df.filter(outcomes.public_address(F.col("a")) != F.col("want")).count() == 0


T = "url string, priority int, ms long, id int"


def test_claims_one_for_each_host(spark):
    rows = [("https://a.test/1", 2, 5, 1), ("https://a.test/2", 9, 9, 2), ("https://b.test/1", 5, 1, 3), ("ftp://c", 5, 1, 4), (None, 5, 1, 5)]
    t = spark.createDataFrame(rows, T).withColumn("score", frontier.queue_score(F.col("priority"), F.col("ms")))
    routed, dead = frontier.route(t)
    assert dead.count() == 2
    hosts = spark.createDataFrame([("b.test", 100)], "host string, ready_at_ms long")
    assert sorted(r.id for r in frontier.next_claims(routed, hosts, 50, "id").collect()) == [2]
    assert sorted(r.id for r in frontier.next_claims(routed, hosts, 100, "id").collect()) == [2, 3]
    plan = frontier.politeness_plan(routed, F.lit(1000), "id", 0).collect()
    assert {r.id: r.contact_ms for r in plan} == {2: 0, 1: 1000, 3: 0}


def test_running_sums_in_blocks(spark):
    from millrace.operators.ordered import running

    rows = [("hot", k, k % 7) for k in range(500)] + [(f"h{k % 9}", k, 2) for k in range(90)]
    got = running(spark.createDataFrame(rows, "key string, at int, w int"), "key", [F.desc("at")], F.col("w"), blocks=6).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])
        want = {r[1]: (n + 1, sum(x[2] for x in mine[:n])) for n, r in enumerate(mine)}
        assert {r["at"]: (r["place"], r["before"]) for r in got if r["key"] == key} == want


def test_reaper(spark):
    s = Settings(max_redeliveries=1)
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item string")
    lease = lambda df: df.select(F.sha1("item").alias("lease_id"), "x")
    leases = lease(spark.createDataFrame([("a", 10), ("b", 10), ("d", 99), ("gone", 10), ("later", 99)], "item string, x long")).withColumnRenamed("x", "deadline_ms")
    n = lease(spark.createDataFrame([("b", 1)], "item string, x long")).withColumnRenamed("x", "n")
    got = frontier.reap(items, leases, n, 10, s).collect()
    by = {r.item: (r.action, r.deadline_ms) for r in got if r.item}
    assert by == {"a": ("requeue", 10), "b": ("dead", 10), "c": ("adopt", 120_010), "d": ("keep", 99)}
    assert sorted(r.action for r in got if not r.item) == ["drop", "wait"]


def test_accounting(spark):
    log = [("j1", 1, 1, False), ("j1", 1, 1, False), ("j1", -1, 5, False), ("j1", -1, 7, False), ("j2", 1, 1, False), ("j3", 1, 1, True)]
    got = jobs.accounting(spark.createDataFrame(log, "job_id string, delta int, at_ms long, claimed boolean")).orderBy("job_id").collect()
    assert [tuple(r) for r in got] == [("j1", 0, "completed", 7), ("j2", 1, "enqueued", None), ("j3", 1, "running", None)]


def test_submit(spark):
    given = ["https://a.test", "https://a.test/", "not a url", "", None, "https://seen.test/", "HTTPS://A.test/#x"]
    s = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "pos int, url string")
    seen = spark.createDataFrame([("https://seen.test/",)], "url string")
    kinds = submit.classified(s, seen)
    assert [r.kind for r in kinds.orderBy("pos").collect()] == ["enqueued", "duplicate", "invalid", "blank", "blank", "seen", "duplicate"]
    r = submit.batch_report(kinds).first()
    assert (r.total_received, r.enqueued_count, r.deduplicated_count, r.invalid_count) == (7, 1, 3, 1)
    assert (r.enqueued_urls, r.deduplicated_urls, r.invalid_urls) == (["https://a.test/"], ["https://seen.test/"], ["not a url"])
    forced = submit.classified(s, seen, force=True)
    assert [r.kind for r in forced.orderBy("pos").collect()][5] == "enqueued"
    t = submit.targets(forced.filter("kind = 'enqueued'")).orderBy("url").first()
    assert (t.url, t.depth, t.scope_host, t.attempts, t.priority) == ("https://a.test/", 0, "a.test", 0, 5) and len(t.job_id) == 36


def test_replay(spark):
    rows = [
        (1, "frontier", json.dumps({"job_id": "j", "url": "https://a.test/", "depth": 1, "attempts": 3}), 5), (2, "frontier", '{"job_id": "j"', 4),
        (3, "frontier", json.dumps({"job_id": "j"}), 3), (4, "frontier", None, 2), (5, "raw_pages", "j/1", 1), (6, "raw_pages", "j/2", 1),
    ]
    letters = spark.createDataFrame(rows, "letter_id int, queue string, payload string, failed_at_ms long")
    got = {r.letter_id: r for r in deadletters.replay_targets(letters).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "replayed", 2: "dropped", 3: "dropped", 4: "dropped"}
    assert json.loads(got[1].target)["attempts"] == 0
    pages = spark.createDataFrame([("j/1",)], "page_key string")
    assert {r.letter_id: r.outcome for r in deadletters.replay_pages(letters, pages).collect()} == {5: "replayed", 6: "dropped"}
    assert [r.letter_id for r in deadletters.newest(letters, "frontier", 2).collect()] == [1, 2]


def test_malformed_pages(spark):
    good = json.dumps({"job_id": "j", "url": "u", "status_code": 200, "depth": 0, "max_depth": 1, "html": ""})
    bad = json.dumps({"job_id": "j", "url": "u", "status_code": 200, "depth": "x", "max_depth": 1})
    df = spark.createDataFrame([(0, good), (1, bad), (2, "{")], "k int, payload string")
    errors = [r.error for r in deadletters.malformed_pages(df).orderBy("k").collect()]
    assert errors[0] is None and "html" in errors[1] and errors[2].startswith("malformed RawPage")


MD = "# System\n\nIntro text.\n\n## Caching\n\nIn-memory stores.\n\n## Queues\n\nAsync messages.\n"


def test_sections_and_chunks(spark):
    df = spark.createDataFrame([(1, MD, "Doc"), (2, "before\n# \nx", None), (3, "", "t"), (4, None, "t"), (5, "  \n ", "t")], "id int, md string, t string")
    s = [(r.id, r.section_no, r.heading, r.text) for r in chunks.sections(df, "id", "md", F.col("t")).orderBy("id", "section_no").collect()]
    assert s == [(1, 0, "System", "Intro text."), (1, 1, "Caching", "In-memory stores."), (1, 2, "Queues", "Async messages."), (2, 0, "Overview", "before"), (2, 1, "", "x")]
    words = " ".join(f"w{k}" for k in range(900))
    long = spark.createDataFrame([(1, words, "T")], "id int, md string, t string")
    got = chunks.chunks(long, ["id"], "md", F.lit("u"), F.col("t")).orderBy("index").collect()
    assert [len(r.content.split()) - 2 for r in got] == [400, 400, 200] and [r["index"] for r in got] == [1, 2, 3]
    assert got[1].content.split()[2] == "w350"


def test_seed_lines(spark, tmp_path):
    f = tmp_path / "seeds.txt"
    f.write_text("https://a.test/\n\n  # note\n https://b.test/ \n")
    assert [r.value for r in seeds.seed_file(spark, str(f)).collect()] == ["https://a.test/", "https://b.test/"]


def test_files_and_language_filter(spark, tmp_path):
    docs = spark.createDataFrame([("j", "https://a.test/", 'T "x"', 3, "body", "fa"), ("j", "https://b.test/", None, 0, None, None)], "job_id string, url string, title string, estimated_tokens int, markdown string, language string")
    files = sinks.markdown_files(docs, F.lit("now"))
    sinks.write_files(files, str(tmp_path))
    sinks.write_files(files, str(tmp_path))
    written = sorted(tmp_path.glob("j/*.md"))
    assert len(written) == 2 and written[0].read_text().startswith("---\nurl: https://")
    assert sinks.in_languages(docs, ["fa"]).count() == 2
    assert sinks.in_languages(docs.filter("language is not null"), ["de"]).count() == 1
    sinks.reset(str(tmp_path / "j"))
    assert not (tmp_path / "j").exists()


def test_first_target_of_a_child(spark):
    docs = spark.createDataFrame([("j2", ["u1", "u2"], 0, 1, True, "s"), ("j1", ["u1"], 0, 1, True, "s"), ("j1", ["u3"], 1, 1, True, "s")], "job_id string, extracted_links array<string>, depth int, max_depth int, stay_in_domain boolean, scope_host string")
    seen = spark.createDataFrame([("u2",)], "url string")
    assert [(r.url, r.job_id, r.depth) for r in submit.children(docs, seen).collect()] == [("u1", "j1", 1)]
