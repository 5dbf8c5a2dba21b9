"""Problems 1, 3, 4, 5: held-out accuracy and defined results of the trained operators."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("millrace.llm")

from millrace.llm import boilerplate, crf, language, queries, residue, spam, units  # noqa: E402

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data here")

PROSE = {
    "en": "The old bridge was repaired before winter. Nobody had asked the farmers about the new road. They waited for the next meeting of the council, and it took a while.",
    "de": "Die alte Brücke wurde vor dem Winter repariert. Niemand hatte die Bauern nach der neuen Straße gefragt. Sie warteten auf die nächste Sitzung, und es dauerte lange.",
    "fr": "Le vieux pont a été réparé avant l'hiver. Personne n'avait demandé l'avis des fermiers sur la nouvelle route. Ils attendaient la prochaine réunion du conseil.",
    "ru": "Старый мост починили перед зимой. Никто не спросил крестьян о новой дороге. Они ждали следующего заседания совета, и это заняло много времени.",
}
SAMPLES = [(k, lang, text) for k, (lang, text) in enumerate(PROSE.items())]


def samples(spark):
    return spark.createDataFrame(SAMPLES, "sample_id long, language string, text string")


# --- the CRF


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    chain = crf.Chain(rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))
    lengths = np.array([3, 0, 6, 1, 4])
    score = rng.normal(size=int(lengths.sum())) * 2
    got = crf.viterbi(score, lengths, chain)
    at = 0
    for n in lengths:
        s = score[at : at + n]
        best, want = -1e9, ()
        for k in range(2**n if n else 0):
            y = [k >> j & 1 for j in range(n)]
            v = chain.start[y[0]] + chain.end[y[-1]] + sum(s[j] * y[j] for j in range(n)) + sum(chain.trans[a, b] for a, b in zip(y, y[1:]))
            if v > best:
                best, want = v, y
        assert got[at : at + n].tolist() == list(want)
        at += n


def test_training_learns_a_chain():
    rng = np.random.default_rng(2)
    pages, labels = [], []
    for _ in range(120):
        y = np.repeat(rng.integers(0, 2, 4), 3)
        # Feature 0 or 1 hints at the label and is wrong once in five times; neighbours settle it.
        pages.append([[int(v) if rng.random() > 0.2 else int(1 - v)] for v in y])
        labels.append(y.tolist())
    w, chain = crf.train(pages[:100], labels[:100], 2)
    right = total = alone = 0
    for p, y in zip(pages[100:], labels[100:]):
        got = crf.viterbi(np.array([w[u].sum() for u in p]), np.array([len(p)]), chain)
        right, total = right + int((got == np.array(y)).sum()), total + len(y)
        alone += sum(u[0] == v for u, v in zip(p, y))
    assert right > alone + 10 and right / total > 0.8


PAGE = (
    "<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>"
    "<article><h1>On bridges</h1><p>The old bridge was <b>repaired</b> before winter &amp; nobody noticed. It took a long time.</p><!-- no -->"
    "<p>They waited for the next meeting of the council.<br>Nobody came.</p></article><footer><p>&copy; 2020 Name. All rights reserved.</p></footer>"
    "<noscript>turn it on</noscript>"
)


def test_html_units():
    got = [u[0] for u in units.html_units(PAGE)]
    assert got == [
        "Home", "About us", "On bridges", "The old bridge was repaired before winter & nobody noticed. It took a long time.",
        "They waited for the next meeting of the council.", "Nobody came.", "© 2020 Name. All rights reserved.",
    ]
    assert units.html_units(PAGE, noscript=True)[-1][1][-1] == "noscript"


@pytest.mark.parametrize("broken", ["", "<", "<p", "<!-- x", "<script>x", "<p>a<p", "</div></div>x", "<div " + "a" * 1000, "x" * 100_000, "<b>" * 5000 + "y"])
def test_broken_markup_is_read_as_far_as_it_goes(broken):
    assert isinstance(units.html_units(broken), list)


def test_deep_nesting_closes_no_outer_element():
    for n in (40, 65, 3000):
        page = f"<div class=wrapper><nav>{'<div>' * n}<b>deep words</b>{'</div>' * n}<p>menu words</p></nav><p>body words</p></div><p>last words</p>"
        got = {t: a for t, a, _ in units.html_units(page)}
        assert got["menu words"] == ("div", ".wrapper", "nav", "p") and got["body words"] == ("div", ".wrapper", "p") and got["last words"] == ("p",)
        assert got["deep words"][-1] == "div" and "nav" in got["deep words"] and len(got["deep words"]) < 80
    text = "<i>x</i> " * 20 + "</q>" * 20_000
    assert len(units.html_units("<div>" * 20_000 + text)) == 1


def test_long_units_are_counted_over_the_site(spark):
    notice = "All rights in these pages, their pictures and their tables are reserved by the owner of the place. " * 3
    rows = [(k, f"https://a.test/{k}", f"# Title {chr(97 + k // 6)}{chr(97 + k % 6)}\n\n{notice}\n") for k in range(30)]
    df = spark.createDataFrame(rows, "parsed_id long, url string, markdown string")
    kept = boilerplate.with_counts(boilerplate.written(boilerplate.scored(df, "parsed_documents", "parsed_id", "markdown", "md")))
    assert {x["n"] for r in kept.collect() for x in r.seen} == {30}


def test_main_content_of_pages(spark):
    site = "https://news.example/"
    things = ["bridge", "harbour", "orchard", "library", "tower"]
    body = lambda x: "\n\n".join(f"Paragraph {k} tells of the {x} {y}. It was repaired before winter, and nobody noticed the {x}." for k, y in enumerate(things))
    md = [f"- Home\n- About us\n- Contact\n\n# The {x}\n\n{body(x)}\n\n© 2020 News. All rights reserved." for x in things]
    rows = [(k, "j", f"{site}{k}", t, "x") for k, t in enumerate(md)] + [(90, "j", None, None, "x"), (91, "j", "u", "", "x")]
    parsed = spark.createDataFrame(rows, "parsed_id long, job_id string, url string, markdown string, drop string")
    raw = spark.createDataFrame([(1, "j", site, PAGE), (2, "j", None, None)], "page_id long, job_id string, url string, html string")
    import hashlib

    got = {(r.tab, r.rec_id, r.unit_md5) for r in boilerplate.boilerplate_units(parsed, raw).collect()}
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    for line in ("- Home", "- About us", "© 2020 News. All rights reserved."):
        assert ("parsed_documents", 0, key(line)) in got
    assert ("raw_pages", 1, key("About us")) in got and ("raw_pages", 1, key("On bridges")) not in got
    text = {r.parsed_id: r.text for r in boilerplate.main_text(parsed).collect()}
    assert "All rights" not in text[0] and "Paragraph 3" in text[0] and text[90] is None and len(text) == 7


def test_main_text_of_both_tables(spark):
    html = PAGE.replace("</article>", "<pre>\nif a:\n    b()\n</pre><table><tr><td>Year</td><td>1987</td></tr></table></article>")
    parsed = spark.createDataFrame([(1, "https://news.example/1", "# On bridges\n\nThe old bridge was repaired."), (2, None, None)], "parsed_id long, url string, markdown string")
    pages = [(1, html), (2, None), (3, ""), (4, "<p>12"), (5, "<p>12</p>")]
    raw = spark.createDataFrame([(i, "https://news.example/", t) for i, t in pages], "page_id long, url string, html string")
    got = {(r.tab, r.rec_id): r.text for r in boilerplate.main_texts(parsed, raw).collect()}
    assert set(got) == {("parsed_documents", k) for k in (1, 2)} | {("raw_pages", k) for k in range(1, 6)}
    text = got["raw_pages", 1]
    assert "On bridges" in text and "About us" not in text and "if a:\n    b()" in text and "1987" in text
    assert got["raw_pages", 2] is None and got["raw_pages", 3] == "" and got["parsed_documents", 2] is None
    shown = []
    assert len(units.html_units("<p>1<p>One<p>2<p>Two", shown=shown)) == 2 and shown == ["1\nOne\n2", "Two"]


# --- language


def test_segments_of_mixed_documents(spark):
    mixed = PROSE["de"] + "\n\n" + PROSE["en"] + "\n\n" + PROSE["ru"]
    phrase = PROSE["fr"].replace("route. ", "route. «старый мост» ")
    rows = [(0, mixed, "de"), (1, PROSE["en"], "EN-us"), (2, PROSE["fr"], "de"), (3, PROSE["de"], None), (4, phrase, "fr_CA"), (5, None, "en"), (6, "", None), (7, "123 456", "en"), (8, PROSE["ru"], "und")]
    df = spark.createDataFrame([(*r, None, "x") for r in rows], "parsed_id long, markdown string, language string, url string, lang string")
    segs = language.segments(df, samples(spark))
    by = {}
    for r in segs.orderBy("parsed_id", "seg_no").collect():
        by.setdefault(r.parsed_id, []).append(r.lang)
        assert 0 <= r.confidence <= 1
    assert by == {0: ["de", "en", "ru"], 1: ["en"], 2: ["fr"], 3: ["de"], 4: ["fr"], 8: ["ru"]}
    found = sorted(tuple(r) for r in language.relabelled(df, segs).collect())
    assert found == [(0, 0, "de"), (0, 1, "en"), (0, 2, "ru"), (2, 0, "fr"), (3, 0, "de"), (8, 0, "ru")]


def test_labels(col):
    assert col(["EN-us", "pt_BR", "und", "", None, " De "], "string", language.label_language) == ["en", "pt", None, None, None, "de"]


def test_cosine_is_exact():
    c = language.Centroids.fit([(a, b) for _, a, b in SAMPLES], k=1)
    texts = [PROSE["en"][:60], "x", "", "bridge bridge bridge"]
    got = c.similar(texts)
    for t, row in zip(texts, got):
        v = np.zeros(1 << language.DIM_BITS)
        for w in language._WORD.findall(t.lower()):
            np.add.at(v, language._grams(w), 1)
        v *= c.idf
        n = np.linalg.norm(v)
        assert np.allclose(row, [(v @ r) / n if n else 0 for r in c.rows], atol=1e-5)


def test_centroids_are_fitted_on_every_sample(spark):
    """Beyond the 4,000 texts that were once read, and equal in any order and number of partitions."""
    rows = [(k, "en", f"The old bridge {chr(97 + k % 26)}{chr(97 + k // 26 % 26)} was repaired.") for k in range(4500)] + [(5000 + k, "de", t) for k, t in enumerate(PROSE["de"].split(". ") * 2)]
    rows += [(6000, None, "x"), (6001, "fr", None), (6002, "ru", "12 34"), (6003, "fa", "پل")]
    df = spark.createDataFrame(rows, "sample_id long, language string, text string")
    a, b = language.fit(df.coalesce(1)), language.fit(df.repartition(5, F.rand(2)))
    local = language.Centroids.fit([(lang, t) for _, lang, t in rows if lang and t])
    assert a.langs == b.langs == local.langs == ["de", "en", "fa"] and a.owner.tolist() == [0, 0, 0, 1, 1, 1, 2]
    for x in (b, local):
        assert (a.idf == x.idf).all() and (a.rows == x.rows).all()
    # What none of the 4,507 sentences has weighs most.
    assert np.isclose(a.idf.max(), np.log(1 + 4507) + 1)


@needs_data
def test_language_held_out(spark):
    s = spark.read.parquet(str(DATA / "language_samples.parquet"))
    fit, held = s.filter("sample_id % 3 <> 0"), s.filter("sample_id % 3 = 0")
    docs = held.select(F.col("sample_id").alias("parsed_id"), F.col("text").alias("markdown"), F.lit(None).cast("string").alias("url"), "language")
    first = language.segments(docs, fit).filter("seg_no = 0").join(docs, "parsed_id")
    n, right = first.agg(F.count("*"), F.count_if(F.col("lang") == F.col("language"))).first()
    assert n == held.count() and right / n >= 0.97


def test_no_samples_and_no_documents(spark):
    df = spark.createDataFrame([(1, "Some text here.", None, None)], "parsed_id long, markdown string, url string, language string")
    assert language.segments(df, samples(spark).limit(0)).count() == 0
    assert language.relabelled(df.limit(0), language.segments(df.limit(0), samples(spark))).count() == 0


# --- residue

FAILED = [
    "404 Not Found", "403 Forbidden. You do not have permission to open /x/ on this server.", "Hello {{ user.name }}, your {{ order.id }} is ready: %%date%%",
    "Please enable JavaScript to use this site.", "Lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet.", "[object Object] undefined Price: undefined",
]
FINE = [
    PROSE["en"], PROSE["de"], "Short note on bridges.", "You need to enable JavaScript to run this app. " + PROSE["en"],
    "Printers set filler text, the famous lorem ipsum, long before any copy was there. " + PROSE["en"],
    "The template language replaces a field such as {{ title }} by a value. " + PROSE["fr"],
]


def test_residue(spark):
    prose = [(100 + k, t) for k, t in enumerate([*PROSE.values()] * 20)]
    rows = [*enumerate(FAILED + FINE), *prose, (900, None), (901, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "parsed_id long, text_sample string, t string")
    assert {r.parsed_id for r in residue.parsed_cases(df).collect()} == set(range(len(FAILED)))
    assert residue.parsed_cases(df.limit(0)).count() == 0


def test_messages_are_learnt_from_unlabelled_records():
    new = ["Error: the gizmo vault refuses entry. The page gizmo vault refuses service.", "Access denied. The gizmo vault refuses entry to this page."]
    plain = [f"{a} {b} went to the {c} and spoke about {d} for a while." for a in ("Anna", "Boris") for b in ("Weber", "Novak") for c in ("market", "harbour", "school") for d in ("boats", "bread")]
    seeds = ["access denied", "error: the page refuses service", "page not found"]
    unknown = "gizmo vault gizmo vault gizmo"
    once, often = (residue.Residue.fit(seeds, plain * 10 + new * 4, rounds) for rounds in (1, 6))
    assert once.odds.get("gizmo", 0) <= 0 < often.odds["gizmo"] and often.share(unknown)[0] and not once.share(unknown)[0]
    assert not any(often.share(t)[0] for t in plain)


def test_residue_is_fitted_on_every_record(spark):
    """Beyond the 4,000 records that the model was once fitted on, and equal in any order and number of partitions."""
    plain = [(k, f"Anna went to the {w} and spoke about boats for a while.") for k, w in enumerate(["market", "harbour", "school"] * 3000)]
    new = [(9000 + k, "Error: the gizmo vault refuses entry. The page gizmo vault refuses service." if k % 2 else "Access denied. The gizmo vault refuses entry to this page.") for k in range(8)]
    df = spark.createDataFrame(plain + new, "parsed_id long, text_sample string")
    rows = residue.tokenised(df)
    model = residue.fit_tokenised(rows)
    trusted, rest = ([t for _, t in plain + new if residue.trusted(t) is x] for x in (True, False))
    seeds = [m.replace("\\w+", "title") for m in residue._LITERALS]
    local = residue.Residue.fit(seeds + trusted, rest)
    assert model.odds == local.odds and model.prior == local.prior and len(rest) > 9000
    assert residue.fit(df.repartition(7, F.rand(1))).odds == model.odds


def test_trusted_texts_are_those_of_the_patterns():
    for m in residue._LITERALS:
        for t in (m.replace("\\w+", "title"), m.replace("\\w+", "title").upper()):
            assert residue.trusted(t) == bool(residue._MESSAGE.search(t))
    assert residue.trusted("PAGE NOT FOUND") and residue.trusted("page ı vıa acceſs denıed") and not residue.trusted("A page about pages.")
    assert residue.trusted("%%a%% {{ b }} __c__") and not residue.trusted("%%a%% {{ b }}")


def test_residue_in_html(spark):
    prose = spark.createDataFrame([(k, t) for k, t in enumerate([*PROSE.values()] * 20)], "parsed_id long, text_sample string")
    model = residue.fit(prose)
    wrap = "<body><nav><a href=/>Home</a> | <a href=/a>About us</a></nav><article>%s</article><footer>© 2020 Name. All rights reserved.</footer>"
    pages = [
        (1, wrap % "<h1>Error</h1><p>404 Not Found</p>"), (2, wrap % f"<h1>Bridges</h1><p>{PROSE['en']}</p>"),
        (3, "<body><div id=root></div><noscript><p>Please enable JavaScript to run this app.</p></noscript>"),
        (4, wrap % f"<noscript>Please enable JavaScript to run this app.</noscript><p>{PROSE['en']}</p>"), (5, None), (6, ""),
    ]
    raw = spark.createDataFrame([(*p, None) for p in pages], "page_id long, html string, url string")
    assert {r.page_id for r in residue.raw_cases(raw, model).collect()} == {1, 3}


# --- spam


def _stuffed(k):
    words = ["cheap", "buy", "online", "best", "price", f"brand{k}", "deal", "shop"]
    return " ".join(words[(7 * j + k * j * j) % len(words)] for j in range(140))


def test_spam_pages(spark):
    rng = np.random.default_rng(3)
    prose = {lang: t.split(". ") for lang, t in PROSE.items()}
    rows = []
    for k in range(160):
        lang = ["en", "de", "fr", "ru"][k % 4]
        rows.append((k, ". ".join(prose[lang][int(j)] for j in rng.integers(0, len(prose[lang]), 6 + k % 9)) + ".", []))
    bad = {200 + k for k in range(8)} | {300}
    rows += [(200 + k, _stuffed(k), []) for k in range(8)] + [(300, "\n".join(f"https://s{k}.example/x" for k in range(80)), ["x"] * 80)]
    rows += [(400, None, None), (401, "", []), (402, "buy now", [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "parsed_id long, markdown string, extracted_links array<string>, slope string")
    assert {r.parsed_id for r in spam.spam_cases(df, samples(spark)).collect()} == bad
    assert spam.spam_cases(df.limit(0), samples(spark)).count() == 0


def test_prose_models_count_every_sample(spark):
    """Beyond the 4,000 texts that were once read."""
    rows = [(k, "en" if k % 2 else "de", f"word{k} common") for k in range(9000)] + [(9001, None, "x"), (9002, "en", None)]
    df = spark.createDataFrame(rows, "sample_id long, language string, text string").repartition(5)
    got = spam.prose_models(df)
    assert list(got) == ["de", "en"] and all(len(c) == 4501 for c in got.values())
    assert np.isclose(np.exp(got["en"]["common"]), 4500 / (9000 * 1.25)) and np.isclose(np.exp(got["de"]["word8998"]), 1 / (9000 * 1.25))


def test_short_link_lists(spark):
    lists = [
        "\n".join(f"https://s{k}.example/x" for k in range(26)), "# Two Words\n\n" + "\n".join(f"Name https://s{k}.test/x\nhttps://t{k}.test/" for k in range(12)),
        "# Two Words\n\n" + "\n".join(f"* [Name {k}](https://s{k}.test/)" for k in range(9)), "Alpha\nBeta\nGamma",
    ]
    notes = ["# Bridges\n\nThe old bridge was repaired, see https://a.test/x and https://b.test/y for more.", "# Bridges\n\nThe old bridge was repaired.", "buy now"]
    rows = [(k, t, ["x"] * 20) for k, t in enumerate(lists)] + [(10 + k, t, ["x"] * (20 if "." in t else 1)) for k, t in enumerate(notes)]
    rows += [(100 + k, f"{t} {t}", []) for k, t in enumerate([*PROSE.values()] * 10)]
    df = spark.createDataFrame(rows, "parsed_id long, markdown string, extracted_links array<string>")
    assert {r.parsed_id for r in spam.spam_cases(df, samples(spark)).collect()} == set(range(len(lists)))
    assert spam.curves(df, samples(spark)).count() == len(rows)


def test_no_jump_with_the_pages_of_a_language(spark):
    def off(n):
        rows = [(k, "en", 100 + k, -0.5, 0.1, 1.0) for k in range(600)] + [(1000 + k, "fa", 100 + 3 * k, -0.5, 0.1, 3.0) for k in range(n)]
        df = spark.createDataFrame(rows, "id long, lang string, n_tokens long, slope double, residual double, divergence double")
        return spam.deviations(df).filter("id = 1000").first().divergence_off

    few, below, above, many = off(5), off(199), off(201), off(3000)
    assert abs(below - above) < 0.05 and few > below > abs(many) and abs(many) < 0.05


def test_curve_is_that_of_the_page(spark):
    text = " ".join("a" for _ in range(40)) + " " + " ".join("b" for _ in range(20)) + " " + " ".join(f"c{k}" for k in range(10))
    df = spark.createDataFrame([(1, text, [])], "parsed_id long, markdown string, extracted_links array<string>")
    r = spam.curves(df, samples(spark)).first()
    x = np.log(np.array([1.0, 2.0, *[7.5] * 10]))
    y = np.log(np.array([40.0, 20.0, *[1.0] * 10]))
    slope, level = np.polyfit(x, y, 1)
    assert r.n_tokens == 70 and np.isclose(r.slope, slope) and np.isclose(r.residual, np.sqrt(np.mean((y - slope * x - level) ** 2)))


# --- whole queries


def test_site_lines_of_a_language_whose_samples_come_late(spark, tmp_path):
    """English samples lie behind the 4,000 texts that were once read; without them the few English pages were taken for spam."""
    late = [(k, "de", PROSE["de"]) for k in range(4500)] + [(5000, "en", PROSE["en"]), (5001, "en", None)]
    spark.createDataFrame(late, "sample_id long, language string, text string").coalesce(1).write.parquet(f"{tmp_path}/language_samples.parquet")
    line = "All pages of this place"

    def page(lang, k):
        prose = PROSE[lang].split(". ")
        return ". ".join(prose[(k + j) % len(prose)].rstrip(".") for j in range(5 + k % 4)) + "."

    rows = [(k, "https://a.test/x", page("en", k), f"{line}\n\n{page('en', k)}", []) for k in range(12)]
    rows += [(200 + k, f"https://s{k}.test/x", page("de", k), page("de", k), []) for k in range(150)]
    rows += [(100 + k, "https://a.test/x", "Short note on bridges.", f"{line}\n\n{_stuffed(k)}", []) for k in range(2)]
    schema = "parsed_id long, url string, text_sample string, markdown string, extracted_links array<string>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/parsed_documents.parquet")
    got = {(r.parsed_id, r.line_no) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert {x for x in got if x[1] == 0} == {(k, 0) for k in range(12)} and not any(i >= 100 for i, _ in got)


@needs_data
def test_queries_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    want = {
        "p1_found": ["tab", "rec_id", "unit_md5"], "p2_found": ["parsed_a", "parsed_b"], "p3_found": ["parsed_id", "seg_no", "lang"], "p4_found": ["tab", "rec_id"],
        "p5_found": ["parsed_id"], "p6_found": ["parsed_id", "line_no"], "p7_found": ["target_id"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "cut_at"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, d)
        assert df.columns == columns and df.count() == df.distinct().count()
