"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements cut the page into lines, each with its text
and the number of tags seen in it. The ratio of text to tags is smoothed along the page with a Gaussian, and
two-means clustering of the smoothed ratios gives the threshold above which a line is content. Content lines
select a region: the article or main element, or else the smallest container, that holds most of their text.
Where several such elements hold content, it is the smallest container around them all, unless one holds most of
the text and the others' lines lie below the threshold on the whole, weighed by their text.
The text of the region is all of its lines, short ones too, but for those inside menus, headers, footers,
sidebars, notices, adverts, forms and comments.

Defined cases: null and empty html, and pages without text outside such parts, give an empty text; tags that
are never closed end with their container; `br` and other inline elements are white space or nothing inside a
line; very long pages are parsed in pieces; repeated rows give the same text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.rows import with_text_columns

SIGMA = 1.0
PIECE = 1 << 16
#: Share of the content lines' text that a region must hold.
COVER = 0.8
# Element names of HTML.
SKIPPED = frozenset("script style noscript template head title iframe object svg math canvas select option textarea button".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
CONTAINERS = frozenset("body div section article main aside nav header footer form table tbody tr td th ul ol dl figure blockquote details dialog menu center".split())
BLOCKS = CONTAINERS | frozenset("html head p h1 h2 h3 h4 h5 h6 li dt dd pre hr address caption figcaption summary thead tfoot fieldset legend title option textarea select noscript".split())
HEAD = frozenset("head meta link base title style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words in class and id names that mark parts around the article.
PARTS = frozenset(
    "ad ads advert adverts advertisement adbox banner banners sponsor sponsored promo promotion nav navbar navigation "
    "menu menus header masthead footer sidebar aside widget comment comments disqus reply replies respond cookie "
    "cookies consent notice notices alert popup modal newsletter subscribe subscription share sharing social related "
    "breadcrumb breadcrumbs pagination pager login signup search form skip hidden".split()
)
#: Of these, names that inside an article mark its own title.
TITLES = frozenset("header banner masthead".split())
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Lines of a page: text, number of tags, path of containers, and whether the line is outside the article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.stack: list[tuple[str, int, bool]] = []  # containers: name, number, boilerplate
        self.kinds: list[str] = [""]
        self.skipping: list[str] = []
        self.parts: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, tuple(n for _, n, _ in self.stack), any(b for _, _, b in self.stack)))
            self.tags = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping == ["head"] and tag not in HEAD:
            self.skipping.clear()  # the head was never closed
        if self.skipping:
            if tag in SKIPPED:
                self.skipping.append(tag)
            return
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in SKIPPED:
            self.skipping.append(tag)
        elif tag in CONTAINERS:
            self.kinds.append(tag)
            self.stack.append((tag, len(self.kinds) - 1, self.outside(tag, dict(attrs))))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def outside(self, tag: str, attrs: dict) -> bool:
        inside = any(name in ("article", "main") for name, _, _ in self.stack)
        if tag in BOILER or tag == "header" and not inside:
            return True
        if tag in ("body", "article", "main"):
            return False
        if (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs:
            return True
        names = set(_NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        return not PARTS.isdisjoint(names - TITLES if inside else names)

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
            elif tag in ("head", "body", "html"):
                self.skipping.clear()
            return
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if any(name == tag for name, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)


def parsed(html: str) -> Lines:
    page = Lines()
    for at in range(0, len(html), PIECE):
        page.feed(html[at : at + PIECE])
    page.close()
    page.cut()
    return page


def ratios(lines: list, sigma: float = SIGMA) -> np.ndarray:
    """Smoothed ratio of text to tags of each line."""
    raw = np.array([len(text) / max(1, tags) for text, tags, _, _ in lines], float)
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel)[reach : reach + len(raw)]
    return np.convolve(raw, kernel)[reach : reach + len(raw)] / weight


def threshold(values: np.ndarray) -> float:
    """The border between the two clusters of values."""
    low, high = values.min(), values.max()
    while True:
        border = (low + high) / 2
        upper = values >= border
        if upper.all() or not upper.any():
            return float(border)
        means = values[~upper].mean(), values[upper].mean()
        if means == (low, high):
            return float(border)
        low, high = means


def region(page: Lines, content: np.ndarray, gain: np.ndarray) -> int:
    """Number of the container that holds the article; 0 is the whole page.

    gain is each line's distance from the threshold times the length of its text.
    """
    held: dict[int, int] = {0: 0}
    depth: dict[int, int] = {0: 0}
    for (text, _, path, _), chosen in zip(page.lines, content, strict=True):
        if chosen:
            held[0] += len(text)
            for level, number in enumerate(path, 1):
                held[number] = held.get(number, 0) + len(text)
                depth[number] = level
    for kind in ("article", "main"):
        outer: dict[int, tuple[int, ...]] = {}  # the outermost elements of the kind that hold content, and what they lie in
        for (_, _, path, _), chosen in zip(page.lines, content, strict=True):
            at = next((k for k, n in enumerate(path) if page.kinds[n] == kind), None) if chosen else None
            if at is not None:
                outer[path[at]] = path[:at]
        if sum(held[n] for n in outer) < COVER * held[0]:
            continue
        one = max((n for n in held if page.kinds[n] == kind), key=lambda n: (held[n], depth[n]))
        around = (0, *commonprefix(list(outer.values())))[-1]
        if len(outer) > 1 and (held[one] < COVER * held[0] or _gained(page, gain, around) >= _gained(page, gain, one)):
            return around
        return one
    return max((n for n in held if held[n] >= COVER * held[0]), key=lambda n: depth[n])


def _gained(page: Lines, gain: np.ndarray, at: int) -> float:
    return sum(g for (_, _, path, outside), g in zip(page.lines, gain.tolist(), strict=True) if not outside and (not at or at in path))


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The text of the article, blocks joined by line breaks."""
    page = parsed(html or "")
    own = np.array([not outside for _, _, _, outside in page.lines], bool)
    if not own.any():
        return ""
    smooth = ratios(page.lines, sigma)
    above = smooth - threshold(smooth[own])
    content = own & (above >= 0)
    gain = above * np.array([len(text) for text, _, _, _ in page.lines])
    at = region(page, content if content.any() else own, gain)
    return "\n".join(text for text, _, path, outside in page.lines if not outside and (not at or at in path))


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None, sigma: float = SIGMA) -> DataFrame:
    """Columns of pages with text and n_chars; a column of pages named so gives way."""

    def run(texts: pa.Array) -> list:
        out = [main_text(x.as_py(), sigma) for x in texts]
        return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

    return with_text_columns(pages, html, "text string, n_chars long", run, carry)
