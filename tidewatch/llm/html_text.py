"""Main text of web pages by text-to-tag ratio.

The standard library's parser turns a page into events; block elements cut them into
lines. A line's ratio is its characters outside links per tag in it. Ratios are
smoothed with a Gaussian, lines above a threshold form clusters, and the lowest container
of all clustered lines is the content region; if some are in an article or main, it is the
lowest one of those. A section is a part of the container around it. Lines in elements
that are never content (menus, forms and the like) count as ratio 0 and are left out, and
so are blocks that class or id name as comments, adverts, newsletters or consent. What
class, id or role otherwise mark is judged when the clusters are known, since wrappers of
the whole text have such names too.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never main text. Fixed values.
_NEVER = frozenset((
    "head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form",
    "button", "select", "option", "textarea", "label", "iframe", "object", "embed", "canvas",
    "svg", "math", "audio", "video", "map", "dialog", "menu", "fieldset"))

#: Elements that begin a new line. Fixed values.
_BLOCKS = frozenset((
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6",
    "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "caption",
    "blockquote", "pre", "figure", "figcaption", "header", "address", "hr", "details", "summary",
    "center", "hgroup", "search")) | _NEVER

#: Elements that have no end tag. Fixed values.
_VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr"))

_CONTENT = frozenset(("article", "main"))
_REGIONS = _CONTENT | {"body", "section", "div", "td"}

#: Elements that a new block element ends. Fixed values.
_ENDED = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "option": "option"}

#: Words in class, id and role that mark what is not main text. Fixed values.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"comments?|disqus|replies|related|recommended|recommendations|widget|toolbar|pagination|"
    r"pager|skip|complementary|contentinfo|search)(?:$|[\s_\d-])", re.I)

#: Names of blocks that others have written or sell, whatever their length: one of the first
#: words, with what kind of block it is. Fixed values.
_FOREIGN = re.compile(
    r"(?:^|\s)(?:comments?|replies|reply|respond|disqus|ads?|adverts?|advertisements?|adsense|"
    r"sponsored|newsletters?|subscribe|subscription|cookies?|consent|gdpr)"
    r"(?:[\s_-]*(?:comments?|replies|respond|list|area|section|threads?|box|blocks?|wrap|wrapper|container|body|"
    r"content|form|item|items|banner|bar|notice|slot|unit|signup|inner|text|entry|post|holder|popup|modal|"
    r"overlay|\d+))*(?=\s|$)", re.I)

_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Events(HTMLParser):
    """Lines of a page: text, characters in links, tags, whether left out, region, mark."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int, int]] = []
        #: Open elements: name, left out, number of the region, number of the mark.
        self._open: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]
        self.parents = {0: 0}
        self.content: set[int] = set()
        self.sections: set[int] = set()
        #: Mark around each region, and marked elements: mark around them, whether they
        #: are an article, whether they are inside an article or main, whether foreign.
        self.region_marks = [0]
        self.marks: list[tuple[int, bool, bool, bool]] = [(0, False, False, False)]
        self._text: list[str] = []
        self._linked = self._tags = self._anchors = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        _, out, region, mark = self._open[-1]
        if text or self._tags:
            self.lines.append((text, min(self._linked, len(text)), self._tags, out, region, mark))
        self._text = []
        self._linked = self._tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._text.append(" ")
            self._tags += 1
            return
        if tag in _BLOCKS:
            self._flush()
            self._end("p", flush=False, within=_REGIONS)
            if tag in _ENDED:
                self._end(tag, flush=False, within={"ul", "ol", "dl", "table", *_REGIONS})
                self._end(_ENDED[tag], flush=False, within={"ul", "ol", "dl", "table", *_REGIONS})
        elif tag in ("td", "th"):
            self._text.append(" ")
        self._tags += 1
        if tag in _VOID:
            return
        _, out, region, mark = self._open[-1]
        whole = tag in ("html", "body", "main")
        if not out:
            out = tag in _NEVER or (tag == "header" and not self._inside_content(region)) \
                or (not whole and self._hidden(attrs))
        if not out and not whole:
            foreign = tag in _BLOCKS and self._named(attrs, _FOREIGN, ("class", "id"))
            if foreign or self._named(attrs, _MARKS, ("class", "id", "role")):
                self.marks.append((mark, tag == "article", self._inside_content(region), foreign))
                mark = len(self.marks) - 1
        if tag in _REGIONS:
            new = len(self.parents)
            self.parents[new] = region
            self.region_marks.append(mark)
            region = new
            if tag in _CONTENT and not out:
                self.content.add(new)
            elif tag == "section":
                self.sections.add(new)
        if tag == "a":
            self._anchors += 1
        self._open.append((tag, out, region, mark))

    def _inside_content(self, region: int) -> bool:
        while region:
            if region in self.content:
                return True
            region = self.parents[region]
        return False

    @staticmethod
    def _named(attrs: list, pattern: re.Pattern, places: tuple[str, ...]) -> bool:
        return any(value and pattern.search(value) for name, value in attrs if name in places)

    @staticmethod
    def _hidden(attrs: list) -> bool:
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and _HIDDEN.search(value):
                return True
        return False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` is a comment up to the next ``>``, whatever it holds."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _end(self, tag: str, *, flush: bool, within=frozenset()) -> None:
        """Close the innermost open ``tag``, not beyond an element of ``within``."""
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i][0]
            if name == tag:
                if flush:
                    self._flush()
                self._anchors -= sum(e[0] == "a" for e in self._open[i:])
                del self._open[i:]
                return
            if name in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        # An inline end tag does not close a block around it.
        self._end(tag, flush=tag in _BLOCKS, within=() if tag in _BLOCKS else _BLOCKS)
        self._tags += 1

    def handle_data(self, data: str) -> None:
        self._text.append(data)
        if self._anchors > 0:
            self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def _smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius), kernel / kernel.sum(), "valid")


def _dense(lines: list, left_out: list[bool], sigma: float, strength: float) -> np.ndarray:
    """Which lines are above the threshold of the smoothed ratios."""
    ratios = np.array([0.0 if out else (len(line[0]) - line[1]) / max(1, line[2])
                       for line, out in zip(lines, left_out)])
    smooth = _smooth(ratios, sigma)
    return (smooth >= strength * smooth.std()) & (ratios > 0)


def _dropped(page: _Events, dense: np.ndarray) -> list[bool]:
    """For each mark, whether what is inside it is left out.

    What is foreign always is. Otherwise an article is not left out for its own mark, and a
    marked container stays if it holds an
    article and no less clustered text than the articles outside marked containers, or if
    it holds half of all clustered text and no article stands against it.
    """
    parents = [m[0] for m in page.marks]
    chars, holds = [0] * len(parents), [False] * len(parents)
    within = [False] * len(parents)
    for m in range(1, len(parents)):
        within[m] = within[parents[m]] or not page.marks[m][1]
    for r in page.content:
        holds[page.region_marks[r]] = True
    foreign = [False] * len(parents)
    for m in range(1, len(parents)):
        foreign[m] = page.marks[m][3] or foreign[parents[m]]
    total = articles = 0
    top = _top_content(page, page.content)
    for i in np.flatnonzero(dense):
        text, linked, _, _, region, mark = page.lines[i]
        if foreign[mark]:
            continue
        chars[mark] += len(text) - linked
        total += len(text) - linked
        if top[region] and not within[mark]:
            articles += len(text) - linked
    for m in range(len(parents) - 1, 0, -1):
        chars[parents[m]] += chars[m]
        holds[parents[m]] |= holds[m]
    dropped = [False] * len(parents)
    for m in range(1, len(parents)):
        around, article, inside, _ = page.marks[m]
        stays = not foreign[m] and (article or chars[m] > 0 and (
            holds[m] and chars[m] >= articles
            or 2 * chars[m] >= total and (not articles or holds[m] or inside)))
        dropped[m] = dropped[around] or not stays
    return dropped


def _top_content(page: _Events, content: set[int]) -> list[int]:
    """For each region the outermost article or main around it, else 0."""
    top = [0] * len(page.parents)
    for r in range(1, len(top)):
        top[r] = top[page.parents[r]] or (r if r in content else 0)
    return top


def main_text(html: str | None, sigma: float = 1.0, strength: float = 0.5) -> str:
    """Main text of one page: its blocks joined by line feeds, '' if there is none."""
    if not html:
        return ""
    page = _Events()
    page.feed(html)
    page.close()
    lines = page.lines
    left_out = [line[3] for line in lines]
    if not any(line[0] and not out for line, out in zip(lines, left_out)):
        return ""
    dense = _dense(lines, left_out, sigma, strength)
    content = page.content
    if len(page.marks) > 1:
        dropped = _dropped(page, dense)
        left_out = [line[3] or dropped[line[5]] for line in lines]
        if not any(line[0] and not out for line, out in zip(lines, left_out)):
            return ""
        dense = _dense(lines, left_out, sigma, strength)
        content = {r for r in content if not dropped[page.region_marks[r]]}

    # Containers of clustered lines: the outermost articles around them, if there are any.
    top = _top_content(page, content)
    around = {lines[i][4] for i in np.flatnonzero(dense)}
    around = {top[r] for r in around if top[r]} or around
    if around:
        region = around.pop()
        for r in around:
            while r != region:  # a region has a larger number than those around it
                if r > region:
                    r = page.parents[r]
                else:
                    region = page.parents[region]
        while region in page.sections and not top[region]:  # a part of what is around it
            region = page.parents[region]
        inside = [False] * len(top)
        for r in range(len(top)):
            inside[r] = r == region or inside[page.parents[r]]
    else:
        inside = [t > 0 for t in top]
    return "\n".join(line[0] for line, out in zip(lines, left_out)
                     if line[0] and not out and inside[line[4]])


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """``text`` and ``n_chars`` in place of the page source, all other columns as they are.

    A null or empty page, and one without main text, gives ''. Pages are read one at
    a time inside the tasks, so a long page costs its own length in memory. Markup that
    is not closed ends with the page; no markup, however broken, is an error. Columns named like the new ones are replaced.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return (pages.select(*rest, text(F.coalesce(F.col(html), F.lit(""))).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
