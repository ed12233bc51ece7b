"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one per block of text. A line has its
text length and the number of tags met since the line before; lines in boilerplate elements (menus, headers outside
the article, footers, sidebars, adverts, notices, forms, comments) are left out from the start. Forms and elements
marked by a class or id are left out by what they turn out to hold, see _void(). The text-to-tag ratios, smoothed with a Gaussian over neighbouring lines, are split by two-means clustering into a
high and a low group; its border, held below MAX_BORDER, is the threshold. Lines above it vote, by the length of their text, for the
elements around them. The outermost article and main elements that lines above the threshold lie in are content, with all
their lines, short ones as well. Otherwise the content region is the deepest element with NEARLY all votes, so that
sections side by side stay together. In it the lines above the threshold are content, and what stands between the first and
the last of them: short lines, list items and headings, but for lines that are mostly links. Headings right before
the first belong to it as well.

Results by case: a null or empty page has an empty text; broken markup, missing end tags and cut-off
references are read as browsers do, a tag cut off at the end is no text; text of any length is kept whole; other columns are not looked at; repeated rows
give repeated results; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.buffers import named

SIGMA = 1.0
RADIUS = 2
MAX_BORDER = 20.0
NEARLY = 0.95

# Element names of HTML by their part in a page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "head", "title", "select", "textarea", "button", "canvas", "audio", "video"}
BOILERPLATE = {"nav", "footer", "aside", "menu", "dialog"}
CONTAINERS = {"article", "main"}
REGIONS = {"article", "main", "section", "div", "body", "td", "center"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Classes and ids, as a whole, that mark boilerplate, and roles that do.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies",
    "consent", "disclaimer", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination",
    "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "ad-banner", "ad-container", "ad-slot", "ad-wrapper", "comment-list", "comments-area", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice",
    "footer-nav", "main-menu", "main-nav", "main-navigation", "nav-bar", "nav-links", "nav-menu", "newsletter-signup", "page-footer", "post-comments",
    "related-articles", "related-posts", "share-bar", "share-buttons", "share-links", "side-bar", "side-nav", "site-footer", "site-nav", "site-navigation",
    "social-links", "social-share", "sub-nav", "top-nav", "widget-area",
}
# First and last words of hyphenated classes and ids that mark boilerplate, such as comments-section or post-sidebar.
LEADING = {
    "ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "footer", "nav", "navbar",
    "newsletter", "pagination", "popup", "sidebar", "sponsor", "sponsored",
}
TRAILING = {"ad", "ads", "breadcrumb", "breadcrumbs", "comments", "footer", "nav", "navbar", "newsletter", "pagination", "sidebar"}
# Words that tell of an element's state or make-up instead, such as has-sidebar or comments-open.
STATES = {"active", "closed", "disabled", "enabled", "has", "is", "no", "not", "off", "on", "open", "with", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that no class or id marks.
NEVER_MARKED = {"html", "body", "main", "article"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
# Elements whose end tag may be left out: a new one of the set ends them.
CLOSED_BY = {
    "p": BLOCKS - {"br"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}


def _marks(value: str) -> bool:
    """True for a class or id with a name that marks boilerplate."""
    for name in value.lower().replace("_", "-").split():
        parts = name.split("-")
        if name in MARKS or ((parts[0] in LEADING or parts[-1] in TRAILING) and STATES.isdisjoint(parts)):
            return True
    return False


class _Lines(HTMLParser):
    """Collects (text, tags before, boilerplate, regions around it, marks around it, mostly links, heading) of each block of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, list[int], tuple[int, ...]]] = []
        self.regions: list[str] = []  # names of the region elements, by number
        self.inside: list[int] = []  # numbers of the open ones
        # name; silent, boilerplate, container: here or above; numbers of the marked elements here and above
        self.open: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = []
        self.marked = 0
        self.text: list[str] = []
        self.tags = 0
        self.links = self.linked = 0  # open links; signs of the block inside links

    def _break(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            heading = any(x[0] in HEADINGS for x in self.open)
            self.lines.append((text, self.tags, bool(self.open) and self.open[-1][2], self.inside.copy(), self.open[-1][4] if self.open else (), 2 * self.linked > len(text), heading))
            self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._break()
            while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
                self._drop(len(self.open) - 1)
        self.tags += 1
        if tag in VOID:
            return
        _, silent, plate, container, marks = self.open[-1] if self.open else ("", False, False, False, ())
        marked = tag == "form"
        if tag in ("body", "html"):
            silent = False
            if tag == "body":
                self._drop(next((i for i, x in enumerate(self.open) if x[0] != "html"), len(self.open)))
        elif tag in SILENT:
            silent = True
        elif tag in BOILERPLATE or (tag == "header" and not container):
            self._leave()
            plate = True
        elif tag in CONTAINERS:
            container = True
        for name, value in attrs:
            if not value:
                continue
            if name in ("class", "id"):
                marked = marked or (tag not in NEVER_MARKED and _marks(value))
            elif not plate and (
                (name == "role" and value.lower() in ROLES and not (tag == "form" and value.lower() == "form"))
                or name == "hidden"
                or (name == "aria-hidden" and value.lower() == "true")
            ):
                self._leave()
                plate = True
        if marked and not plate:
            self._leave()
            marks = (*marks, self.marked)
            self.marked += 1
        self.open.append((tag, silent, plate, container, marks))
        self.links += tag == "a"
        if tag in REGIONS:
            self.inside.append(len(self.regions))
            self.regions.append(tag)

    def _drop(self, start: int) -> None:
        """Close the elements from this depth on."""
        gone = sum(x[0] in REGIONS for x in self.open[start:])
        self.links -= sum(x[0] == "a" for x in self.open[start:])
        del self.open[start:]
        if gone:
            del self.inside[-gone:]

    def _leave(self) -> None:
        """Text before boilerplate is a line of its own."""
        self._break()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self._break()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if self.open[i][2:5:2] != (self.open[i - 1][2:5:2] if i else (False, ())):
                    self._break()
                self._drop(i)
                return
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def finish(self) -> list[tuple[str, int, bool, list[int]]]:
        """The lines; boilerplate are also those below a form or mark that is not void."""
        # What html.parser makes of a tag cut off at the end depends on its release.
        if self.rawdata.startswith("<") and (self.rawdata[1:2].isalpha() or self.rawdata[1:2] in ("/", "!", "?")):
            self.rawdata = ""
        self.close()
        self._break()
        void = _void(self.lines, self.regions)
        return [(text, tags, plate or not void.issuperset(marks), around, *more) for text, tags, plate, around, marks, *more in self.lines]


def _void(lines: list[tuple[str, int, bool, list[int], tuple[int, ...]]], names: list[str]) -> set[int]:
    """The forms and marked elements that are no boilerplate, as they hold what the page is about.

    These are elements around a main or an article, as long as no other text of a main or of an article is free of
    them (comments below an article can be articles too); on a page with neither, elements around NEARLY all text. The outer ones are released first.
    """
    soft = [(len(text), around, marks) for text, _, plate, around, marks, *_ in lines if not plate]
    void: set[int] = set()
    if not any(marks for _, _, marks in soft):
        return void
    found = False
    for kind in ("main", "article"):
        held = [(n, marks) for n, around, marks in soft if any(names[r] == kind for r in around)]
        while held and not any(void.issuperset(marks) for _, marks in held):
            void |= {next(m for m in marks if m not in void) for _, marks in held}
        found = found or bool(held)
    if found:
        return void
    total = sum(n for n, _, _ in soft)
    while True:
        votes: dict[int, int] = {}
        for n, _, marks in soft:
            first = next((m for m in marks if m not in void), None)
            if first is not None:
                votes[first] = votes.get(first, 0) + n
        wide = {m for m, n in votes.items() if n >= NEARLY * total}
        if not wide:
            return void
        void |= wide


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """The ratios under a Gaussian over neighbouring lines, renormalised at the ends."""
    at = np.arange(-RADIUS, RADIUS + 1)
    bell = np.exp(-(at**2) / (2 * SIGMA**2))
    middle = slice(RADIUS, RADIUS + len(ratio))
    return np.convolve(ratio, bell)[middle] / np.convolve(np.ones(len(ratio)), bell)[middle]


def border(ratio: np.ndarray) -> float:
    """The middle between the two clusters of the values."""
    low, high = float(ratio.min()), float(ratio.max())
    for _ in range(20):
        middle = (low + high) / 2
        upper = ratio > middle
        if not upper.any() or upper.all():
            break
        low, high = float(ratio[~upper].mean()), float(ratio[upper].mean())
    return min((low + high) / 2, MAX_BORDER)


def main_text(html: str) -> str:
    """The content blocks of a page in order, joined by one space."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = [x for x in parser.finish() if not x[2]]
    if not lines:
        return ""
    ratio = smoothed(np.array([len(x[0]) / max(1, x[1]) for x in lines]))
    edge = border(ratio)
    high = (ratio >= edge).tolist()
    regions, whole = _regions(lines, high, parser.regions)
    inside = [(x, up) for x, up in zip(lines, high, strict=True) if regions is None or not regions.isdisjoint(x[3])]
    if whole:
        return " ".join(x[0] for x, _ in inside)
    ups = [i for i, (_, up) in enumerate(inside) if up]
    if not ups:
        return ""
    first, last = ups[0], ups[-1]
    while first and inside[first - 1][0][5]:
        first -= 1
    return " ".join(x[0] for x, _ in inside[first : last + 1] if not x[4] or len(x[0]) >= edge * max(1, x[1]))


def _regions(lines: list[tuple], high: list[bool], names: list[str]) -> tuple[set[int] | None, bool]:
    """The numbers of the content regions, None for the page, and whether all their lines are content."""
    votes: dict[int, int] = {}
    total = 0
    depth: dict[int, int] = {}
    outermost = set()
    for text, _, _, around, *_ in (x for x, up in zip(lines, high, strict=True) if up):
        total += len(text)
        for i, region in enumerate(around):
            votes[region] = votes.get(region, 0) + len(text)
            depth[region] = i
        container = next((r for r in around if names[r] in CONTAINERS), None)
        if container is not None:
            outermost.add(container)
    if outermost:
        return outermost, True
    ample = [r for r, n in votes.items() if n >= NEARLY * total]
    return ({max(ample, key=lambda r: (depth[r], r))} if ample else None), False


def extract(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points of the text)."""
    schema = f"`{id}` {df.schema[id].dataType.simpleString()}, `{url}` {df.schema[url].dataType.simpleString()}, text string, n_chars long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x.as_py()) for x in named(part, html)]
                yield pa.RecordBatch.from_arrays(
                    [named(part, id), named(part, url), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id, url, "text", "n_chars"]
                )

    return df.select(id, url, html).mapInArrow(rows, schema)
