"""Per-page markup helper: what tags cannot be matched by a regular expression.

One page is one row. Spark spreads the pages over tasks; the helper only turns
the markup of a single page into its text or into its list of links.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionhour.constants import (
    CONTENT_SELECTORS,
    FOOTNOTE_HEADING_TAGS,
    FOOTNOTE_HEADINGS,
    FOOTNOTE_MARK,
    FOOTNOTE_PARENTS,
    NOISE_WORDS,
    REMOVED_TAGS,
)

VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
# Opening one of the values' keys closes an open element of the named kinds.
_BLOCKS = (
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul"
).split()
IMPLIED_END = {
    **{tag: ("p",) for tag in _BLOCKS},
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
# An implied end never reaches past these.
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "td", "th", "blockquote"}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: int
    first_text: int
    last_text: int = -1

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


@dataclass
class Page(HTMLParser):
    """Elements in document order, each spanning a run of the page's text pieces."""

    elements: list[Element] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._open: list[int] = []
        self._pending: list[str] = []

    @classmethod
    def read(cls, markup: str) -> "Page":
        page = cls()
        page.feed(markup)
        page.close()
        page._flush()
        while page._open:
            page._end_last()
        return page

    def _flush(self) -> None:
        if self._pending:
            self.texts.append("".join(self._pending))
            self.owners.append(self._open[-1] if self._open else -1)
            self._pending.clear()

    def _end_last(self) -> None:
        element = self.elements[self._open.pop()]
        element.last_text = len(self.texts)

    def _end_through(self, wanted: tuple[str, ...], scope: set[str]) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self.elements[self._open[depth]].tag
            if tag in wanted:
                while len(self._open) > depth:
                    self._end_last()
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag in IMPLIED_END:
            self._end_through(IMPLIED_END[tag], SCOPE - set(IMPLIED_END[tag]))
        parent = self._open[-1] if self._open else -1
        named = {name: value or "" for name, value in reversed(attrs)}
        self._open.append(len(self.elements))
        self.elements.append(Element(tag, named, parent, len(self.texts)))
        if tag in VOID_TAGS:
            self._end_last()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag not in VOID_TAGS:
            self._end_through((tag,), set())

    def handle_data(self, data: str) -> None:
        self._pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def joined(self, element: Element) -> str:
        """Stripped text pieces of an element, run together."""
        return "".join(t.strip() for t in self.texts[element.first_text:element.last_text])

    def has_ancestor(self, index: int, tags: tuple[str, ...]) -> bool:
        return self.ancestor(index, tags) is not None

    def ancestor(self, index: int, tags: tuple[str, ...]) -> int | None:
        at = self.elements[index].parent
        while at >= 0 and self.elements[at].tag not in tags:
            at = self.elements[at].parent
        return at if at >= 0 else None


def page_text(markup: str) -> str | None:
    """Text of the main content, one stripped piece per line; what a body would hold where a page names none."""
    page = Page.read(markup)

    dropped: list[bool] = []
    for element in page.elements:
        label = f"{' '.join(element.classes())} {element.attrs.get('id', '')}".lower()
        noisy = element.tag in REMOVED_TAGS or any(word in label for word in NOISE_WORDS)
        dropped.append(noisy or (element.parent >= 0 and dropped[element.parent]))

    def pieces(element: Element) -> list[str]:
        span = range(element.first_text, element.last_text)
        return [page.texts[i] for i in span if page.owners[i] < 0 or not dropped[page.owners[i]]]

    kept = [element for element, gone in zip(page.elements, dropped) if not gone]
    for tag, css_class in CONTENT_SELECTORS:
        hits = [e for e in kept if e.tag == tag and (css_class is None or css_class in e.classes())]
        if hits:
            content = max(hits, key=lambda e: sum(map(len, pieces(e))))
            break
    else:
        content = next((e for e in kept if e.tag == "body"), None)
    if content is not None:
        found = pieces(content)
    elif any(e.tag == "body" for e in page.elements):
        return None
    else:
        in_head: list[bool] = []
        for element in page.elements:
            in_head.append(element.tag in ("head", "title") or (element.parent >= 0 and in_head[element.parent]))
        found = [text for text, owner in zip(page.texts, page.owners) if owner < 0 or not (dropped[owner] or in_head[owner])]
    return "\n".join(filter(None, (piece.strip() for piece in found))) or None


def _footnote_section(page: Page) -> Element | None:
    titled = [
        (page.joined(e).lower(), i) for i, e in enumerate(page.elements) if e.tag in FOOTNOTE_HEADING_TAGS
    ]
    for heading in FOOTNOTE_HEADINGS:
        for text, index in titled:
            if text.startswith(heading):
                around = page.ancestor(index, tuple(FOOTNOTE_PARENTS))
                if around is not None:
                    return page.elements[around]
    for tag, css_class in (("div", "field-item"), ("article", None), ("main", None)):
        for element in page.elements:
            if element.tag == tag and (css_class is None or css_class in element.classes()):
                return element
    return None


def page_links(markup: str) -> list[dict]:
    """Links of the footnote section, else of the best container, else of the page."""
    page = Page.read(markup)
    section = _footnote_section(page)
    marked_parents: dict[int, bool] = {}

    links = []
    for index, element in enumerate(page.elements):
        if element.tag != "a" or "href" not in element.attrs:
            continue
        if section is not None and not _is_below(page, index, section):
            continue
        parent = element.parent
        if parent not in marked_parents:
            around = page.joined(page.elements[parent]) if parent >= 0 else "".join(t.strip() for t in page.texts)
            marked_parents[parent] = re.search(FOOTNOTE_MARK, around) is not None
        links.append({
            "pos": len(links),
            "href": element.attrs["href"],
            "link_text": page.joined(element),
            "parent_marked": marked_parents[parent],
            "in_list": page.has_ancestor(index, ("ol", "li")),
        })
    return links


def _is_below(page: Page, index: int, section: Element) -> bool:
    at = page.elements[index].parent
    while at >= 0:
        if page.elements[at] is section:
            return True
        at = page.elements[at].parent
    return False


@F.pandas_udf(T.StringType())
def content_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text, na_action="ignore")


LINK = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("href", T.StringType()),
    T.StructField("link_text", T.StringType()),
    T.StructField("parent_marked", T.BooleanType()),
    T.StructField("in_list", T.BooleanType()),
])


@F.pandas_udf(T.ArrayType(LINK))
def content_links(pages: pd.Series) -> pd.Series:
    return pages.map(page_links, na_action="ignore")
