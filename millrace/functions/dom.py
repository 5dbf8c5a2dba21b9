"""A forgiving tree over html, on the standard library's tokenizer.

It keeps what was written: no tag is implied, an end tag closes up to its nearest open namesake and is
ignored without one, void elements hold nothing, and runs of text between tags are one string. It never
raises, whatever the markup.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without content.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid"
    " param source spacer track wbr".split()
)
#: Elements whose strings are no text of the page.
SILENT = frozenset(("script", "style", "template"))
_BLANK = re.compile(r"[ \t\n\r\f\v]*\Z")


class Element:
    """A node: kids are elements and strings. An element that is taken out or replaced stays among its parent's kids
    with `gone` set (as all below it), and `shown` is the string in its place, so that each costs no search."""

    __slots__ = ("tag", "attrs", "kids", "up", "gone", "shown")

    def __init__(self, tag: str, attrs: dict[str, str], up: Element | None):
        self.tag, self.attrs, self.up, self.kids, self.gone, self.shown = tag, attrs, up, [], False, None

    def walk(self) -> Iterator[Element]:
        """Elements below this one, in document order; cut-off parts are not entered."""
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, Element) and not kid.gone:
                yield kid
                if not kid.gone:
                    stack.append(iter(kid.kids))

    def select(self, test: Callable[[Element], bool]) -> list[Element]:
        return [e for e in self.walk() if test(e)]

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def tags(self, *names: str) -> list[Element]:
        return self.select(lambda e: e.tag in names)

    def strings(self) -> Iterator[str]:
        """Text below this element, without that of silent elements inside it."""
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, str):
                yield kid
            elif kid.gone:
                if kid.shown is not None:
                    yield kid.shown
            elif kid.tag not in SILENT:
                stack.append(iter(kid.kids))

    def flat(self, joint: str) -> str:
        """Every string stripped, empty ones dropped, joined."""
        return joint.join(s for s in (x.strip() for x in self.strings()) if s)

    def replace(self, text: str | None) -> None:
        """Put a string in the place of this element; None takes it out."""
        self.shown = text
        below = list(self.walk())
        self.gone = True
        for e in below:
            e.gone = True

    def drop(self) -> None:
        self.replace(None)

    def sums(self, of: Callable[[Element], bool]) -> dict[Element, tuple[int, int, int]]:
        """For each live element below (and this one): the length of its text, how many elements below it pass `of`,
        and the length of their texts. One pass from the leaves up, whatever the depth."""
        order = [self, *self.walk()]
        size, n, held = ({e: 0 for e in order} for _ in range(3))
        for e in reversed(order):
            size[e] += sum(len(k.strip()) for k in e.kids if isinstance(k, str))
            if e is not self:
                hit = of(e)
                size[e.up] += size[e] if e.tag not in SILENT else 0
                n[e.up] += n[e] + hit
                held[e.up] += held[e] + (size[e] if hit else 0)
        return {e: (size[e], n[e], held[e]) for e in order}

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open: list[Element] = [self.root]
        self.count: Counter[str] = Counter()
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            s = "".join(self.text)
            self.text.clear()
            if _BLANK.match(s) and not (self.count["pre"] or self.count["textarea"]):
                s = "\n" if "\n" in s else " "
            self.open[-1].kids.append(s)

    def handle_starttag(self, tag, attrs):
        self.flush()
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].kids.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        while self.count[tag]:
            last = self.open.pop().tag
            self.count[last] -= 1
            if last == tag:
                break

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_pi(self, data):
        self.flush()

    def unknown_decl(self, data):
        self.flush()


def parse(html: str) -> Element:
    """The root element of a page; what the tokenizer cannot read ends the tree, nothing raises."""
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except (AssertionError, ValueError):
        pass
    b.flush()
    return b.root
