"""Nulls in any column, very long texts, clashing names, repeated rows and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("millrace.llm")

from millrace.functions.urls import canonicalize  # noqa: E402
from millrace.llm import boilerplate, language, leaks, neardup, packing, residue, seen, site_lines, spam, splitting  # noqa: E402

LONG = ("The old bridge was repaired before winter. Nobody asked the farmers. " * 8000) + "\n\n# End\n\nlast words of all"
#: Columns with the names that the operators use inside.
CLASH = ["id", "key", "n", "v", "epoch", "site", "keys", "same", "head", "s1", "class_id", "tab", "rec_id", "score", "seen", "lang", "size", "task", "t", "d", "text_", "drop_", "hit", "k", "a", "b"]


def clash(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def parsed(spark, rows):
    schema = "parsed_id long, job_id string, url string, title string, text_sample string, markdown string, extracted_links array<string>, language string"
    return clash(spark.createDataFrame(rows, schema))


ROWS = [
    (1, "j", "https://a.test/1", "t", "Some text here.", "# T\n\nSome text here. And some more of it.", ["u"], "en"),
    (1, "j", "https://a.test/1", "t", "Some text here.", "# T\n\nSome text here. And some more of it.", ["u"], "en"),
    (2, None, None, None, None, None, None, None),
    (3, "j", "", "", "", "", [], ""),
    (4, "j", "not a url", None, LONG[:500], LONG, None, "und"),
    (5, "j", "https://a.test/1", "t", "\x00퟿ ", "\n\n \t\n```\nunclosed", [None], "x"),
]


@pytest.fixture()
def tables(spark):
    samples = spark.createDataFrame([(1, "en", "The old bridge was repaired. Nobody asked."), (2, "de", "Die alte Brücke wurde repariert. Niemand fragte."), (3, None, "x"), (4, "fr", None)], "sample_id long, language string, text string")
    raw = clash(spark.createDataFrame([(1, "j", "https://a.test/1", "<p>Some text<p>more"), (2, None, None, None), (3, "j", "x", ""), (4, "j", "u", f"<p>{LONG}")], "page_id long, job_id string, url string, html string"))
    return parsed(spark, ROWS), raw, clash(samples)


def test_edges_of_the_page_operators(spark, tables):
    p, raw, samples = tables
    model = residue.fit(p)
    assert residue.parsed_cases(p, model).count() >= 0 and residue.raw_cases(raw, model).count() >= 0
    assert boilerplate.boilerplate_units(p, raw, None, residue.html_judge(raw, model)).columns == ["tab", "rec_id", "unit_md5"]
    assert boilerplate.main_text(p).count() == 6
    segs = language.segments(p, samples)
    assert {r.lang for r in segs.filter("parsed_id in (1, 4)").collect()} == {"en"}
    assert {r.parsed_id for r in language.relabelled(p, segs).collect()} == {4}
    assert spam.spam_cases(p, samples).filter("parsed_id <> 4").count() == 0
    assert site_lines.recurring_lines(p, "parsed_id", "markdown", "url", None, 2).count() == 2
    assert site_lines.cleaned(p, "parsed_id", "markdown", "url").count() == 6


def test_edges_of_the_document_operators(spark):
    docs = clash(spark.createDataFrame([(1, LONG), (1, LONG), (2, None), (3, ""), (4, "short text " * 20), (None, "no id"), (5, LONG + " changed")], "doc_id long, text string"))
    m, links = neardup.near_duplicates(docs, "doc_id", "text")
    assert [tuple(r) for r in neardup.all_pairs(m, links).collect()] == [(1, 5)]
    assert {r.doc_id for r in splitting.cut_levels(docs, "doc_id", "text").collect()} == {1, 5}
    pieces = splitting.pieces(docs.filter("doc_id is not null"), "doc_id", "text")
    assert pieces.agg(F.max("size")).first()[0] <= 4096
    packed = packing.pack(docs.filter("doc_id is not null"), "doc_id", "text").groupBy("container_id").agg(F.sum("size").alias("s"))
    assert packed.agg(F.max("s")).first()[0] <= 8192
    items = clash(spark.createDataFrame([(1, "nobody asked the farmers the old bridge was repaired before winter nobody"), (2, None)], "item_id long, text string"))
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs, items).collect()} == {(1, 1), (1, 5)}
    assert leaks.leaks(docs, items.limit(0)).count() == 0


def test_edges_of_the_seen_keys(spark):
    t = clash(spark.createDataFrame([(1, "https://a.test"), (2, None), (3, "https://a.test/"), (3, "https://a.test/"), (None, "https://a.test/"), (4, "")], "target_id long, url string"))
    assert sorted(r.target_id for r in seen.seen_before(t, "target_id", canonicalize(F.col("url"))).collect()) == [3, 3]


def test_empty_tables(spark, tables):
    p, raw, samples = (x.limit(0) for x in tables)
    model = residue.fit(p)
    assert residue.parsed_cases(p, model).count() == residue.raw_cases(raw, model).count() == 0
    assert boilerplate.boilerplate_units(p, raw).count() == 0 and boilerplate.main_text(p).count() == 0
    assert spam.spam_cases(p, samples).count() == 0 and language.segments(p, samples).count() == 0
    assert site_lines.cleaned(p, "parsed_id", "markdown", "url").count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert splitting.cut_levels(docs, "doc_id", "text").count() == splitting.pieces(docs, "doc_id", "text").count() == 0
