"""Every query of the core against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from millrace.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = [tuple(_plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    assert _sorted(got) == _sorted(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_plans_prune_and_push_down(spark):
    """The scan of a projection reads its columns only, and filters reach it."""
    plan = catalogue.QUERIES["newest_letters"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(queue), EqualTo(queue,frontier)]" in plan
    plan = catalogue.QUERIES["totals"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<estimated_tokens:int,raw_html_bytes:bigint,markdown_bytes:bigint>" in plan
    plan = catalogue.QUERIES["chunks"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_hosts_outside_ascii(spark, tmp_path):
    """The queries named _idn over a Unicode host, its punycode, a broken host and a blank."""
    d, run = str(tmp_path), catalogue.QUERIES
    given = ["https://Bücher.example/a", "https://xn--bcher-kva.example/a", "http://münze.test/", "https://ü..b/", " "]
    t = spark.createDataFrame([(k, u, 0, "bücher.example" if k > 2 else "xn--bcher-kva.example") for k, u in enumerate(given)], "target_id long, url string, attempts int, scope_host string")
    t.write.parquet(f"{d}/crawl_targets.parquet")
    spark.createDataFrame([("http://xn--mnze-0ra.test", "running")], "url string, status string").write.parquet(f"{d}/jobs.parquet")
    for name in ("parsed_documents", "dead_letters", "raw_pages"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    kinds = {r.target_id: (r.canonical, r.kind) for r in run["submitted_kinds_idn"](spark, d).collect()}
    a, m = "https://xn--bcher-kva.example/a", "http://xn--mnze-0ra.test/"
    assert kinds == {0: (a, "enqueued"), 1: (a, "duplicate"), 2: (m, "seen"), 3: (None, "invalid"), 4: (None, "blank")}
    assert [(r.url, r.scope_host) for r in run["submitted_targets_idn"](spark, d).collect()] == [(a, "xn--bcher-kva.example")]
    assert tuple(run["submit_report_idn"](spark, d).first()) == (5, 1, 2, 1)
    assert run["batch_reports_idn"](spark, d).first().enqueued_urls == [a]
    assert {r.host: r.n for r in run["host_counts_idn"](spark, d).collect()} == {"xn--bcher-kva.example": 2, "xn--mnze-0ra.test": 1}
    assert {r.target_id for r in run["scope_tests_idn"](spark, d).filter("in_scope").collect()} == {0, 1}
    assert run["cluster_metrics_idn"](spark, d).first().unique_urls_seen == 2
    assert run["prometheus_lines_idn"](spark, d).filter("line = 'crawler_urls_seen 2'").count() == 1
