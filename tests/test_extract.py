import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.dom import parse
from millrace.operators import extract as ex
from millrace.operators import submit

PAGE = "job_id string, page_id long, url string, html string, stay_in_domain boolean, scope_host string, depth int, max_depth int, fetched_at long"


def md(html):
    from pyspark.sql import functions as F

    from millrace.functions.text import clean_markdown
    from millrace.session import get_spark

    root = parse(html)
    ex.strip_boilerplate(root)
    spark = get_spark()
    return spark.createDataFrame([(ex.raw_markdown(root),)], "m string").select(clean_markdown(F.col("m"))).first()[0]


def rows(spark, *htmls, **kw):
    data = [
        (kw.get("job", "j"), k, kw.get("url", f"https://a.test/p{k}"), h, kw.get("stay", False), kw.get("scope", ""), kw.get("depth", 0), kw.get("most", 2), k)
        for k, h in enumerate(htmls)
    ]
    return spark.createDataFrame(data, PAGE)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<h3>Ferry <em>times</em></h3>first boat", "### Ferry times\n\nfirst boat"),
        ("<h6>a</h6><h2>b</h2>", "###### a\n\n## b"),
        ("before<blockquote>said <b>once</b></blockquote>after", "before\n\n> said once\n\nafter"),
        ("<pre>x = 1\n  y = 2</pre>", "```\nx = 1\n y = 2\n```"),
        ("<pre><code>a</code><code>b</code></pre>", "```\na\nb\n```"),
        ("call <code>tide()</code> twice", "call `tide()` twice"),
        ("<ol><li>mix<li>bake</ol>", "- mix bake"),
        ("<ul><li>rye</li><li></li><li>oat</li></ul>", "- rye\n- oat"),
        ("<p>one</p><p></p><p>two</p>", "one\n\ntwo"),
        ("Salt  ,   <i>yeast</i> ; water", "Salt, yeast; water"),
    ],
)
def test_elements(spark, html, want):
    assert md(f"<body>{html}</body>") == want


@pytest.mark.parametrize(
    "junk",
    [
        "<select><option>gone</select>", "<dialog>gone</dialog>", "<svg><text>gone</text></svg>", "<form>gone<input></form>", "<canvas>gone</canvas>",
        "<p hidden=''>gone</p>", "<b aria-hidden='true'>gone</b>", "<p style='VISIBILITY : hidden'>gone</p>",
        "<div class='page newsletter-box'>gone</div>", "<section id=cookie-bar>gone</section>", "<p class=noprint>gone</p>", "<i class='mw-ref'>gone</i>",
        "<sup>12</sup>", "<sup><a href='#n'>[3]</a></sup>", "<sup>Citation gone</sup>",
    ],
)
def test_what_is_never_content(spark, junk):
    assert md(f"<body><p>The oven is warm{junk} by six</p></body>") in ("The oven is warm by six", "The oven is warm")
    assert "gone" not in ex._page(f"<body>kept {junk}</body>")[5]


def test_aria_hidden_needs_its_value(spark):
    assert md("<p aria-hidden=false>stays</p><p class=shadow>too</p><sup>th</sup>") == "stays\n\ntoo\n\nth"


@pytest.mark.parametrize(
    "table,want",
    [
        ("<tr><td>grain</td><td>kg</td></tr>", "| grain | kg |\n| --- | --- |"),
        ("<thead><tr><th>day<th>tide</tr></thead><tbody><tr><td>Mon</td><td>low</td></tr></tbody>", "| day tide | tide |\n| --- | --- |\n| Mon | low |"),
        ("<tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>1</td><td>2</td><td>3</td></tr>", "| a | b |\n| --- | --- |\n| 1 | |\n| 1 | 2 |"),
        ("<tr><td></td></tr><tr><td>x</td><td>y</td></tr>", "| x | y |"),
        ("<tr><td>this | that</td></tr>", "| this \\| that |\n| --- |"),
        ("<tr><td> </td></tr>", ""),
    ],
)
def test_tables(spark, table, want):
    assert md(f"<body><table>{table}</table></body>") == want


@pytest.mark.parametrize(
    "link,want",
    [
        ("<a href='HTTP://b.test'>upper</a>", "upper"),
        ("<a href=' http://b.test/x?y=1 '>padded</a>", "[padded](http://b.test/x?y=1)"),
        ("<a href='//b.test/'>no scheme</a>", "no scheme"),
        ("<a href='#top'>anchor</a>", "anchor"),
        ("<a name=here>named</a>", "named"),
        ("x<a href='https://b.test/'><img></a>y", "xy"),
        ("<a href='https://b.test/'>two <b>parts</b></a>", "[two parts](https://b.test/)"),
    ],
)
def test_links_in_markdown(spark, link, want):
    assert md(f"<body>{link}</body>") == want


def test_root_class_survives(spark):
    assert "Body text" in md("<html class='vector-toc-available'><body><p>Body text</p></body></html>")


def test_link_clouds_go_but_containers_stay(spark):
    links = "".join(f"<a href='/{k}'>a long link text {k}</a> " for k in range(4))
    assert md(f"<body><div>{links}</div><p>Text</p></body>") == "Text"
    assert "a long link text" in md(f"<body><div id=content>{links}</div></body>")


def test_main_root_needs_text(spark):
    assert md("<body><article>short</article><p>around</p></body>") == "short\n\naround"


def test_unclosed_tags_nest(spark):
    assert md("<article><p><b>one<p>two<p>three</article>") == "one two three"


@pytest.mark.parametrize(
    "html,sample,want",
    [
        ('<html lang="en"><body>x', "x", "en"),
        ('<html lang="fa-IR"><body>x', "x", "fa"),
        ("<html><body>x", "هوش مصنوعی و یادگیری", "fa"),
        ('<meta http-equiv="Content-Language" content="pt, en">', "x", "pt"),
        ("<p>x", "1", "en"),
    ],
)
def test_language(html, sample, want):
    assert ex.language_of(parse(html), sample) == want


@pytest.mark.parametrize(
    "head,want",
    [
        ('<meta name=author content="Ines"><meta property="article:author" content="Otto">', {"author": "Ines"}),
        ('<meta property="OG:Site_Name" content=" Harbour post "><meta name=pubdate content="">', {"site_name": "Harbour post"}),
        ('<meta property="twitter:image" content="/i.png"><meta property="og:image" content="/j.png">', {"image": "/i.png"}),
        ('<meta name=keywords content="x"><meta content="y">', {}),
        ('<script type="application/ld+json">[]</script><script type="application/ld+json">7</script>', {}),
        ('<script type="application/ld+json">{"@type": ["A", "B"], "author": ["x"]}</script>', {"schema_type": "['A', 'B']"}),
        ('<script type="application/json">{"headline": "no"}</script>', {}),
    ],
)
def test_metadata(head, want):
    assert ex.metadata_of(parse(head)) == want


def test_json_ld_fills_what_tags_left_open():
    graph = json.dumps({"@type": "Recipe", "headline": "Rye", "author": "Vera", "datePublished": "1999-12-31T10:00"})
    broken, tag = '{"headline": "cut', '<meta name="date" content="2001-02-03">'
    root = parse(f'{tag}<script type="application/ld+json">{broken}</script><script type="application/ld+json">{graph}</script>')
    assert ex.metadata_of(root) == {"published_time": "2001-02-03", "schema_type": "Recipe", "headline": "Rye", "author": "Vera"}


def test_title_and_description():
    assert ex.title_of(parse("<title> A &amp; B </title>")) == "A & B"
    assert ex.description_of(parse('<meta name="twitter:description" content=" d ">')) == "d"
    assert ex.title_of(parse("<p>x")) == ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abp=\"' &;!-tdr\n", max_size=200))
def test_never_raises(junk):
    assert ex._page(junk)[-1] is None


def test_documents(spark):
    html = (
        "<title>T</title><body><p>Some body text here.</p><a href='/b'>b</a><a href='https://www.o.test/c'>c</a>"
        "<a href='/p0'>self</a><a href='/x.png'>img</a><footer><a href='/f'>f</a></footer></body>"
    )
    d = ex.documents(rows(spark, html)).first()
    assert d.extracted_links == ["https://a.test/b", "https://a.test/f", "https://www.o.test/c"]
    assert d.text_sample == "Some body text here. b c self img" and d.raw_html_bytes == len(html) and d.title == "T"
    stay = ex.documents(rows(spark, html, stay=True, scope="o.test")).first()
    assert stay.extracted_links == ["https://www.o.test/c"]


def test_mirrors_are_duplicates_and_empty_pages_are_not(spark):
    shell = "<body><div id=root></div><script>x</script></body>"
    docs = ex.first_of_content(ex.documents(rows(spark, "<title>1</title><body><p>same", "<title>2</title><body><p>Same ", shell, shell, None)))
    assert [r.is_duplicate for r in docs.orderBy("page_id").collect()] == [False, True, False, False, False]


def test_empty_table(spark):
    assert ex.first_of_content(ex.documents(rows(spark, "x").limit(0))).count() == 0


def test_a_page_that_fails_is_told_by_its_error(spark, monkeypatch):
    monkeypatch.setattr(ex, "title_of", lambda root: 1 / 0)
    assert ex._page("<p>x</p>")[-1] == "ZeroDivisionError: division by zero" and ex._page("<p>x</p>")[:4] == ("", "", [], [])


def test_large_and_deep_trees_take_time_in_proportion():
    import time

    def took(page):
        began = time.perf_counter()
        assert ex._page(page)[-1] is None
        return time.perf_counter() - began

    few, many = (min(took("<article>" + "<p>a line of text</p>" * n + "</article>") for _ in range(2)) for n in (4000, 32_000))
    assert many < 24 * few
    assert took("<div>" * 20_000 + "<a href=/x>x</a>" * 5 + "</q>" * 20_000 + "<td> </td>" * 5000) < 30


def test_deep_markup_does_not_fail(spark):
    assert ex.documents(rows(spark, "<div>" * 3000 + "deep")).first().text_sample == "deep"


def test_links_to_hosts_outside_ascii(spark):
    html = "<a href='https://Bücher.example/a'>a</a><a href=' //münze.test:8080/b?q=ü#x'>b</a><a href='/c'>c</a><a href='https://u@a.test/d'>d</a><a href='https://ü..b/'>e</a><a href='/p'>self</a>"
    page = rows(spark, html)
    outside = ["http://xn--mnze-0ra.test:8080/b?q=ü", "https://a.test/d", "https://xn--bcher-kva.example/a"]
    own = page.withColumn("url", F.lit("http://münze.test/p"))
    got = ex.documents(own).first()
    assert got.extracted_links == sorted([*outside, "http://xn--mnze-0ra.test/c"]) and got.url == "http://münze.test/p"
    for scope in (None, "", "münze.test", "xn--mnze-0ra.test"):
        stay = own.withColumns({"stay_in_domain": F.lit(True), "scope_host": F.lit(scope).cast("string")})
        assert ex.documents(stay).first().extracted_links == ["http://xn--mnze-0ra.test/c", outside[0]]
    children = submit.children(ex.documents(own.withColumns({"depth": F.lit(0), "max_depth": F.lit(1)})))
    assert {r.url for r in children.collect()} == {*outside, "http://xn--mnze-0ra.test/c"}
