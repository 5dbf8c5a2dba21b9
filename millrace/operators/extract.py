"""Raw pages to documents: title, description, metadata, links, language, body text and Markdown.

One Arrow stage parses each page once and gives every field; everything after it (addresses, fingerprints,
sizes, dedup) is native. Rows whose page cannot be processed come out with `error` set.

Defined results: null html counts as an empty page; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text, urls
from millrace.functions.dom import Element, parse
from millrace.session import spread

# What is never content.
REMOVED_TAGS = (
    "aside audio button canvas dialog footer form header iframe nav noscript option script select style svg template"
    " textarea video"
).split()
REMOVED_NAMES = re.compile(
    "ad-|ads-|advert|banner|catlinks|citation|consent|cookie|footnote|modal|mw-editsection|mw-jump-link|navbox|newsletter"
    "|popup|printfooter|promo|references|reflist|sidebar|social-share|vertical-navbox"
    r"|\b(?:ambox|hatnote|hidden-print|infobox|mw-empty-elt|noprint|screen-reader-text|sr-only|table-of-contents|toc"
    r"|vector-menu|vector-toc|visually-hidden)\b",
    re.I,
)
MAIN_IDS = re.compile("(?:article-body|bodyContent|content|main-content|mw-content-text|post-content)$", re.I)
MAIN_CLASSES = re.compile("(?:article-content|content-body|entry-content|markdown-body|post-content)$", re.I)
KEPT_IDS = {"bodyContent", "content", "main-content", "mw-content-text"}
KEPT_CLASSES = {"article-content", "entry-content", "markdown-body", "post-content"}
CITATION_CLASSES = re.compile("(?:citation|mw-ref|reference)$", re.I)
META_KEYS = {
    "og:title": "og_title", "twitter:title": "og_title",
    "og:description": "og_description", "twitter:description": "og_description",
    "og:image": "image", "twitter:image": "image",
    "article:author": "author", "author": "author",
    "article:published_time": "published_time", "date": "published_time", "pubdate": "published_time",
    "og:site_name": "site_name", "application-name": "site_name",
}
LINK_DENSITY, LEAST_LINKS, LEAST_TEXT, MAIN_TEXT, SAMPLE = 0.55, 3, 40, 80, 500
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NOTE = re.compile(r"\[?\d+\]?$")
_SPACES = re.compile(r"\s+")


def _class_hit(e: Element, pattern: re.Pattern, search: bool) -> bool:
    # A pattern is tried on each class, then on all of them joined.
    test = pattern.search if search else pattern.match
    return any(test(c) for c in e.classes) or bool(e.classes and test(" ".join(e.classes)))


def title_of(root: Element) -> str:
    """Text of the first title element; '' if it holds markup."""
    e = root.first(lambda e: e.tag == "title")
    while e is not None and len(e.kids) == 1:
        if isinstance(e.kids[0], str):
            return e.kids[0].strip()
        e = e.kids[0]
    return ""


def description_of(root: Element) -> str:
    e = root.first(lambda e: e.tag == "meta" and "description" in e.attrs.get("name", "").lower())
    return e.attrs.get("content", "").strip() if e else ""


def metadata_of(root: Element) -> dict[str, str]:
    """OpenGraph, Twitter and author tags, then JSON-LD; the first value of a key stays."""
    out: dict[str, str] = {}
    for e in root.tags("meta"):
        key = META_KEYS.get((e.attrs.get("property") or e.attrs.get("name") or "").strip().lower())
        value = e.attrs.get("content", "").strip()
        if key and value:
            out.setdefault(key, value)
    for e in root.tags("script"):
        if e.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(k for k in e.kids if isinstance(k, str)))
        except ValueError:
            continue
        data = data[0] if isinstance(data, list) and data else data
        if not isinstance(data, dict):
            continue
        author = data.get("author")
        author = author.get("name") if isinstance(author, dict) else author if isinstance(author, str) else None
        found = {"schema_type": data.get("@type"), "headline": data.get("headline"), "author": author, "published_time": data.get("datePublished")}
        for key, value in found.items():
            if value is not None:
                out.setdefault(key, str(value))
    return out


def language_of(root: Element, sample: str) -> str:
    """html[lang], then the content-language header, then the script of the sample, else en."""
    e = root.first(lambda e: e.tag == "html")
    if e and e.attrs.get("lang"):
        return re.split("[-_]", e.attrs["lang"].strip().lower())[0]
    e = root.first(lambda e: e.tag == "meta" and "content-language" in e.attrs.get("http-equiv", "").lower())
    if e and e.attrs.get("content"):
        return re.split("[-,]", e.attrs["content"].strip().lower())[0].strip()
    return text.script_language(sample)


def hrefs_of(root: Element) -> list[str]:
    return [e.attrs["href"] for e in root.tags("a") if "href" in e.attrs]


def strip_boilerplate(root: Element) -> None:
    """Take out, in this order: tags, hidden elements, names, citations, blocks of links."""

    def cut(test) -> None:
        for e in root.select(test):
            if not e.gone and e.tag not in ("html", "body"):
                e.drop()

    cut(lambda e: e.tag in REMOVED_TAGS)
    cut(lambda e: "hidden" in e.attrs)
    cut(lambda e: e.attrs.get("aria-hidden") == "true")
    cut(lambda e: bool(_HIDDEN.search(e.attrs.get("style", ""))))
    cut(lambda e: _class_hit(e, REMOVED_NAMES, True))
    cut(lambda e: "id" in e.attrs and bool(REMOVED_NAMES.search(e.attrs["id"])))

    def note(e: Element) -> bool:
        if e.tag != "sup":
            return False
        inside = e.flat("")
        return bool(_NOTE.match(inside)) or "citation" in inside.lower()

    cut(note)
    cut(lambda e: _class_hit(e, CITATION_CLASSES, False))
    # An element is judged by what it held before those inside it were: sums of the whole tree serve all of them.
    sums = root.sums(lambda e: e.tag == "a")
    for e in root.tags("div", "section", "ul", "ol", "table"):
        size, links, linked = sums[e]
        kept = e.attrs.get("id") in KEPT_IDS or KEPT_CLASSES.intersection(e.classes)
        if not kept and links >= LEAST_LINKS and size >= LEAST_TEXT and linked / size >= LINK_DENSITY:
            e.drop()


def body_of(root: Element) -> Element:
    return root.first(lambda e: e.tag == "body") or root


def main_root(root: Element) -> Element:
    """The first of article, main, role, id and class that holds enough text, else the body."""
    for test in (
        lambda e: e.tag == "article",
        lambda e: e.tag == "main",
        lambda e: e.attrs.get("role") == "main",
        lambda e: bool(MAIN_IDS.match(e.attrs.get("id", ""))),
        lambda e: _class_hit(e, MAIN_CLASSES, False),
    ):
        e = root.first(test)
        if e is not None and len(e.flat("")) > MAIN_TEXT:
            return e
    return body_of(root)


def _row(cells: list[str]) -> str:
    return f"| {' | '.join(cells)} |"


def _table(e: Element) -> str:
    """GitHub-style rows. Rows without text are left out; if the first row has any, it is the head, and its width
    is that of all others."""
    grid = [[_SPACES.sub(" ", c.flat(" ")).replace("|", "\\|") for c in row.tags("th", "td")] for row in e.tags("tr")]
    lines, head = [], grid[0] if grid and any(grid[0]) else []
    if head:
        lines = [_row(head), _row(["---"] * len(head))]
    for cells in grid[1:]:
        if any(cells):
            lines.append(_row([*cells, *[""] * len(head)][: len(head) or len(cells)]))
    return "\n\n" + "\n".join(lines) + "\n\n" if lines else ""


def _link(e: Element) -> str:
    shown, href = e.flat(" "), e.attrs["href"].strip()
    return f"[{shown}]({href})" if shown and href.startswith(("http://", "https://")) else shown


def raw_markdown(root: Element) -> str:
    """Markdown of the main part before clean-up. Outer elements are rendered before inner ones of the
    same kind, kinds in a fixed order, and each rendering flattens what is inside."""
    top = main_root(root)

    def each(elements: list[Element], render) -> None:
        for e in elements:
            if not e.gone and e is not top:
                shown = render(e)
                if shown is not None:
                    e.replace(shown)

    def block(before: str, after: str, joint: str = " ", empty: bool = False):
        def render(e: Element) -> str | None:
            inside = e.flat(joint)
            return before + inside + after if inside or empty else None

        return render

    each(top.tags("table"), _table)
    for level in range(1, 7):
        each(top.tags(f"h{level}"), block("\n\n" + "#" * level + " ", "\n\n"))
    each(top.tags("pre"), block("\n\n```\n", "\n```\n\n", "\n", True))
    each([e for e in top.tags("code") if e.up is not None and e.up.tag != "pre"], block("`", "`"))
    each([e for e in top.tags("a") if "href" in e.attrs], _link)
    each(top.tags("li"), block("\n- ", ""))
    each(top.tags("blockquote"), block("\n\n> ", "\n\n"))
    each(top.tags("p"), block("\n\n", "\n\n"))
    return "".join(top.strings())


_FIELDS = [
    ("title", pa.string()),
    ("meta_description", pa.string()),
    ("metadata", pa.map_(pa.string(), pa.string())),
    ("hrefs", pa.list_(pa.string())),
    ("language", pa.string()),
    ("body_text", pa.string()),
    ("raw_markdown", pa.string()),
    ("error", pa.string()),
]
_DDL = (
    "title string, meta_description string, metadata map<string,string>, hrefs array<string>, language string,"
    " body_text string, raw_markdown string, error string"
)


def _page(html: str | None) -> tuple:
    try:
        root = parse(html or "")
        title, about, meta, hrefs = title_of(root), description_of(root), metadata_of(root), [urls.ascii_address(h) for h in hrefs_of(root)]
        strip_boilerplate(root)
        body = body_of(root).flat(" ")
        return title, about, list(meta.items()), hrefs, language_of(root, body[:SAMPLE]), body, raw_markdown(root), None
    except Exception as e:  # whatever a page does, it becomes a dead letter and the job goes on
        return "", "", [], [], "", "", "", f"{type(e).__name__}: {e}"[:200]


def extract(pages: DataFrame, html_col: str = "html", punycode: dict[str, Callable] | None = None) -> DataFrame:
    """All columns of pages but the html, and the fields of each page; links have their hosts in punycode.
    punycode: string columns to go through ascii_address or ascii_host in the same stage."""
    punycode = punycode or {}
    kept = [f for f in pages.schema.fields if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = list(zip(*map(_page, part.column(html_col).to_pylist())))
                given = [(f.name, part.column(f.name)) for f in kept]
                given = [pa.array([x and punycode[n](x) for x in c.to_pylist()], pa.string()) if n in punycode else c for n, c in given]
                arrays = given + [pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [n for n, _ in _FIELDS])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [_DDL])
    return spread(pages.select(*[f.name for f in kept], html_col)).mapInArrow(run, ddl)


def links(base: Column, hrefs: Column, stay: Column, scope: Column) -> Column:
    """The distinct crawlable links of a page, without itself, in code point order; hosts in punycode."""
    own = urls.canonicalize(base, idn=False)
    found = F.array_distinct(urls.link_targets(base, hrefs, stay, scope))
    return F.array_sort(F.array_except(found, F.array(own)))


def documents(pages: DataFrame) -> DataFrame:
    """ParsedDocument rows (before content dedup) of raw pages, with fingerprint, language and metadata.

    Hosts outside ASCII, of links, of the page's address and of its scope, become punycode in the stage that
    parses the page."""
    sized = pages.withColumn("raw_html_bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"))
    sized = sized.withColumns({"_base": F.col("url"), "_scope": F.col("scope_host")})
    e = extract(sized, punycode={"_base": urls.ascii_address, "_scope": urls.ascii_host})
    md = text.clean_markdown(F.col("raw_markdown"))
    fp_text = text.normal(F.col("body_text"))
    return (
        e.withColumn("markdown", md)
        .withColumn("text_sample", F.substring("body_text", 1, SAMPLE))
        .withColumn("fingerprint", F.when(fp_text != "", text.fingerprint(fp_text)).otherwise(F.lit("")))
        .withColumn("estimated_tokens", text.estimated_tokens(F.col("markdown")))
        .withColumn("markdown_bytes", F.octet_length("markdown").cast("long"))
        .withColumn("token_savings_pct", text.savings_pct(F.col("markdown_bytes"), F.col("raw_html_bytes")))
        .withColumn(
            "extracted_links",
            links(F.col("_base"), F.col("hrefs"), F.col("stay_in_domain"), F.col("_scope")),
        )
        .drop("raw_markdown", "body_text", "hrefs", "_base", "_scope")
    )


def first_of_content(docs: DataFrame, fp: str = "fingerprint", order: tuple[str, ...] = ("fetched_at", "page_id")) -> DataFrame:
    """docs with is_duplicate: another page with the same body came before it. Pages without text ('' as
    fingerprint) are never duplicates; rows equal in `order` share their fate.

    Only fingerprints and order columns are compared: the first of a body is a minimum with map-side
    combine, and the duplicates' own keys, which are spread evenly, carry the answer back to the wide rows.
    docs is read more than once, so give it written (session.written), not as a plan over raw pages."""
    keys = docs.select(fp, *order).filter(F.col(fp) != "")
    firsts = keys.groupBy(fp).agg(F.min(F.struct(*order)).alias("first_of_body"))
    later = keys.join(firsts, fp).filter(F.struct(*order) != F.col("first_of_body"))
    later = later.select(*[F.col(c).alias(f"_{c}") for c in order]).distinct().withColumn("is_duplicate", F.lit(True))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order))
    marked = docs.join(later, same, "left").drop(*[f"_{c}" for c in order])
    return marked.withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
