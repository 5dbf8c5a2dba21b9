"""Leaf units of a page (text between tags, or lines of Markdown) and their features for the CRF."""

from __future__ import annotations

import html
import re
from collections import Counter

LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
# Tags that do not end a unit.
INLINE = frozenset("a abbr b code em font i small span strong sub sup".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("head script style noscript template".split())
_PLACES = frozenset("nav header footer aside article main section form table ul ol li p blockquote pre h1 h2 h3 h4 h5 h6 td div".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)|<[!?][^>]*>", re.S
)
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]{3,}")
#: Depth from which ancestors are kept as distinct names, so that no unit carries a path of any length.
DEEP, OUTER = 60, 10
_HEAD_END = re.compile(r"</head\s*>|(?=<body)", re.I)
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIP}


def html_units(page: str, noscript: bool = False, shown: list[str] | None = None) -> list[tuple[str, tuple[str, ...], float]]:
    """(tidy text, ancestors from the outside in as tags and class words, share of letters in links) of
    every unit with a letter, in order. With noscript=True, the text of noscript elements comes as units
    whose last ancestor is 'noscript'. Below DEEP elements a unit has the OUTER outermost ancestors, the distinct
    names of the others, and its own tag. shown gets the text of each unit to be shown: lines of pre are kept,
    and text without a letter is put to the unit before it (at the start, to the first). Broken markup is
    read as far as it goes; nothing raises."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    deep: Counter[str] = Counter()
    in_link = False
    at, n = 0, len(page)

    def names(element: tuple[str, str]) -> tuple[str, ...]:
        tag, words = element
        return (tag, *words.split()) if words else (tag,)

    def push(element: tuple[str, str]) -> None:
        opened[element[0]] += 1
        stack.append(element)
        if len(stack) > DEEP:
            deep.update(names(element))

    def pop(to: int) -> None:
        while len(stack) > to:
            element = stack.pop()
            opened[element[0]] -= 1
            if len(stack) >= DEEP:
                for x in names(element):
                    deep[x] -= 1
                    if not deep[x]:
                        del deep[x]

    def ancestors() -> tuple[str, ...]:
        if len(stack) <= DEEP:
            return tuple(x for e in stack for x in names(e))
        outer = [x for e in stack[:OUTER] for x in names(e)]
        middle = dict.fromkeys(x for e in stack[OUTER:DEEP] for x in names(e))
        return (*outer, *dict.fromkeys([*middle, *deep]), stack[-1][0])

    def flush() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            if "&" in whole:
                whole = html.unescape(whole)
            lines = whole.strip("\r\n").rstrip() if shown is not None and opened["pre"] else ""
            whole = " ".join(whole.split())
            if shown is not None and whole:
                # One text more than units: what stood before the first unit.
                if not shown or (len(shown) == len(out) and LETTER.search(whole)):
                    shown.append(lines or whole)
                else:
                    shown[-1] += "\n" + (lines or whole)
            if LETTER.search(whole):
                out.append((whole, ancestors(), min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        close = bool(m.group(1))
        if tag in INLINE:
            if tag == "a":
                in_link = not close
            continue
        flush()
        if close:
            if opened[tag]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            in_link = False if tag not in ("br",) else in_link
            continue
        if tag in _SKIP:
            if tag == "noscript" and noscript:
                end = _ENDS[tag].search(page, at)
                inner = page[at : end.start()] if end else page[at:]
                out += [(t, (*a, "noscript"), d) for t, a, d in html_units(inner)]
                at = end.end() if end else n
                continue
            if tag == "head":
                # An unclosed head ends where the body begins.
                end = _HEAD_END.search(page, at)
                at = end.end() if end else at
                continue
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("li", "p", "td", "tr") and stack and stack[-1][0] == tag:
            pop(len(stack) - 1)
        if tag not in _VOID:
            attrs = m.group(3)
            words = ""
            if "=" in attrs:
                words = " ".join("." + w for g in _CLASS.findall(attrs) for w in _PART.findall(max(g, key=len).lower()))
            push((tag, words))
    flush()
    return out


_DECOR = re.compile(r"^(?:(#{1,6})\s+|([-*+])\s+|(>)\s*|(\d+[.)])\s+)+")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}")
_STOP = re.compile(r"[.!?؟…۔][\"'»)\]]*$")
_BREAKS = (". ", "! ", "? ", "؟ ", "… ", "۔ ")
_DIGIT = re.compile(r"\d")
_INNER = re.compile(r"[.!?؟…۔][\"'»)]*\s+\S")


def site_word(host: str) -> str:
    """The word of a site's host that its pages use as a name: the label before the last, without
    letters outside ASCII (of a punycode label, its plain part)."""
    labels = [x for x in (host or "").split(".") if x]
    label = labels[-2] if len(labels) > 1 else (labels[0] if labels else "")
    if label.startswith("xn--"):
        label = label[4:].rpartition("-")[0]
    return re.sub(r"[^a-z0-9]", "", label)


def text_shape(text: str, name: str) -> tuple[list[str], list[str] | None]:
    """Features of the text alone, and its words if there are at most 25 of them: longer units are told by their
    length, sentences, place, tags and recurrence, not by single words. name: site_word of the page's site."""
    out = []
    body = text
    m = _DECOR.match(text)
    if m:
        body = text[m.end() :]
        out += [k for k, g in zip(("md#", "md-", "md>", "md1"), m.groups()) if g]
        if m.group(1):
            out.append("h%d" % len(m.group(1)))
    if "](" in body:
        bare = _LINK.sub(r"\1", body)
        shown = sum(len(x) for x in _LINK.findall(body))
        out.append("links" if shown >= 0.8 * len(bare) else "somelink")
        body = bare
    if body[:1] in "*_" and body[-1:] in "*_" and len(body) > 2:
        out.append("emph")
        body = body.strip("*_")
    low = body.lower()
    n = body.count(" ") + 1
    if n > 40:
        # Prose: how much of it, and whether it reads like sentences.
        inner = sum(body.count(mark) for mark in _BREAKS)
        out += ["n%d0" % min(n // 10, 6), "stop%d_in%d" % (bool(_STOP.search(body[-8:])), min(inner, 3))]
        if "|" in body:
            out.append("bar")
        if name and name in low:
            out.append("name")
        return out, None
    words = WORD.findall(low)
    n = len(words)
    long = n > 25
    out.append("n%d" % min(n, 9) if n < 10 else "n%d0" % min(n // 10, 6))
    stop = bool(_STOP.search(body))
    inner = len(_INNER.findall(body)) if n > 3 else 0
    out.append("stop%d_in%d" % (stop, min(inner, 3)))
    if n >= 2 and body.isupper():
        out.append("caps")
    if "|" in body:
        out.append("bar")
    if "›" in body or "»" in body or " / " in body or " > " in body:
        out.append("crumb")
    if "©" in body:
        out.append("(c)")
    if _DATE.search(body):
        out.append("date")
    if name and name in words:
        out.append("name")
    if long:
        return out, None
    if _DIGIT.search(body):
        out.append("digit")
    return out, words


def text_features(text: str, name: str) -> list[str]:
    """All features of the text, words and pairs of words as well."""
    out, words = text_shape(text, name)
    if words:
        out = [*out, "first:" + words[0], *("w:" + w for w in words), *("b:%s %s" % p for p in zip(words, words[1:]))]
    return out


def place_features(k: int, n: int, seen_title: bool, in_code: bool) -> list[str]:
    """Features of the unit's place among the n units of its page."""
    out = ["at%d" % k if k < 4 else "mid", "after_title" if seen_title else "before_title"]
    if n - k <= 4:
        out.append("last%d" % (n - k))
    if in_code:
        out.append("code")
    return out


def tag_features(anc: tuple[str, ...], density: float) -> list[str]:
    """Features of an html unit's ancestors."""
    out = ["in:" + x for x in dict.fromkeys(anc) if x in _PLACES or x[0] == "."]
    tags = [x for x in anc if x[0] != "."]
    if tags:
        out.append("own:" + tags[-1])
    out.append("depth%d" % min(len(tags), 9))
    out.append("linked%d" % round(density * 4))
    return out


def page_title(units: list, kind: str) -> str | None:
    """Text of the first heading, by which copies of a page are known as one."""
    if kind == "html":
        return next((t.lower() for t, anc, _ in units if "h1" in anc or "h2" in anc), None)
    return next((line.lstrip("# ").lower() for _, line, code in units if line[:1] == "#" and not code), None)


def repeat_feature(n: int) -> str:
    """Feature of the number of titles on the site under which the unit occurs."""
    return "rep%d" % (n if n < 3 else 3 if n < 5 else 5 if n < 20 else 20)


def markdown_units(text: str) -> list[tuple[int, str, bool]]:
    """(line number, tidy line, inside a code fence) of every line with a letter."""
    out, code = [], False
    for k, line in enumerate(text.split("\n")):
        if line.lstrip().startswith("```"):
            code = not code
            continue
        if LETTER.search(line):
            out.append((k, " ".join(line.split()), code))
    return out
