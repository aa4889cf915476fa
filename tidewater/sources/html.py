"""Rows from HTML: elements that match a selector, and texts or attributes of what lies in them.

Pages are read in Arrow batches by a tokenizer with a stack of open elements; no page leaves its task.

Selectors are the small part of CSS that cards need: a tag, `[attr]`, `[attr=value]`, `[attr*=part]`, joined
without blanks, with commas between alternatives. The first element in document order counts.

Cases: null and empty pages give no rows; elements that are never closed end with the page; an end tag
without its start is ignored; nested matches give a row each; scripts and styles have no text; a field
that is not found is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without content, and those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_STEP = re.compile(r"""([a-z][a-z0-9]*)|\[([a-z-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""")


def selector(text: str) -> list[list[tuple]]:
    """Alternatives, each a list of tests (kind, name, value)."""
    out = []
    for one in text.split(","):
        tests, at = [], 0
        for m in _STEP.finditer(one := one.strip()):
            if m.start() != at:
                break
            at = m.end()
            tests.append(("tag", m[1], None) if m[1] else ({None: "has", "=": "is", "*=": "part"}[m[3]], m[2], m[4]))
        if at != len(one) or not tests:
            raise ValueError(f"selector not understood: {one}")
        out.append(tests)
    return out


class Element:
    __slots__ = ("tag", "attrs", "first", "end", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], first: int, texts: int):
        self.tag, self.attrs, self.first, self.end, self.texts = tag, attrs, first, None, (texts, None)

    def matches(self, alternatives: list[list[tuple]]) -> bool:
        return any(all(self._passes(*t) for t in tests) for tests in alternatives)

    def _passes(self, kind: str, name: str, value: str | None) -> bool:
        if kind == "tag":
            return self.tag == name
        held = self.attrs.get(name)
        return held is not None and (kind == "has" or (held == value if kind == "is" else value in held))


class Page(HTMLParser):
    """Elements in document order; each knows which elements and which pieces of text lie in it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        self.open: list[Element] = []
        self.feed(html)
        self.close()
        while self.open:
            self._shut()

    def _shut(self) -> None:
        element = self.open.pop()
        element.end, element.texts = len(self.elements), (element.texts[0], len(self.pieces))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and any(e.tag == "p" for e in self.open):
            while self._ends("p"):
                pass
        if self.open and tag == "li" and self.open[-1].tag == "li":
            self._shut()
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, len(self.elements) + 1, len(self.pieces))
        self.elements.append(element)
        if tag in VOID:
            element.end, element.texts = len(self.elements), (len(self.pieces),) * 2
        else:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _ends(self, tag: str) -> bool:
        """Shut elements up to the innermost one of that tag; a card is never shut by the end of a paragraph."""
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                while len(self.open) > depth:
                    self._shut()
                return True
            if tag == "p" and self.open[depth].tag in BLOCKS:
                return False
        return False

    def handle_endtag(self, tag):
        self._ends(tag)

    def handle_data(self, data):
        if not (self.open and self.open[-1].tag in ("script", "style")):
            self.pieces.append(data)

    def inside(self, element: Element) -> list[Element]:
        return self.elements[element.first : element.end]

    def text(self, element: Element) -> str:
        """Pieces of text without white space at their ends, with one space where there was some between two."""
        out, gap = [], False
        for piece in self.pieces[slice(*element.texts)]:
            if clean := piece.strip():
                if out and (gap or piece[0].isspace()):
                    out.append(" ")
                out.append(clean)
                gap = piece[-1].isspace()
            else:
                gap = gap or piece != ""
        return "".join(out)


def cards(pages: DataFrame, card: str, fields: dict[str, tuple], keep: list[str], html: str = "html") -> DataFrame:
    """One row for each element that matches `card`: the columns `keep` of its page and the fields.

    A field is a list of selectors, tried in turn, and the attribute to take, or None for the text.
    """
    wanted = selector(card)
    found = {name: ([selector(s) for s in selectors], attr) for name, (selectors, attr) in fields.items()}

    def read(page: Page, element: Element) -> list[str | None]:
        inside, out = page.inside(element), []
        for selectors, attr in found.values():
            hit = next((e for s in selectors for e in inside if e.matches(s)), None)
            out.append(None if hit is None else page.text(hit) if attr is None else hit.attrs.get(attr))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(html).to_pylist()):
                if not text:
                    continue
                page = Page(text)
                rows = [read(page, e) for e in page.elements if e.matches(wanted)]
                if rows:
                    held = batch.select(keep).take(pa.array([at] * len(rows)))
                    yield pa.RecordBatch.from_arrays([*held.columns, *[pa.array(c, pa.string()) for c in zip(*rows, strict=True)]], [*keep, *fields])

    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{f}` string" for f in fields)])
    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)
