"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; nothing builds a tree. Block elements and <br> end a line. Each line has its
text, the tags within it, the characters inside links, and its region: the innermost open container element. For every page
the ratio of text to tags, line by line, is smoothed by a Gaussian, and a two-cluster threshold separates content lines.

The content lines select the region: from the whole page, the search goes down into a region as long as it holds CHIEF of
all content characters (HALF for <article> or <main>, where it stops). All lines of the selected region are kept, short
lists, quotations and tables in it too, and the page's h1 before it. Marks are secondary: regions named as furniture by
their element or by a word of class, id or role are left out, unless a word alone names them and they hold most of the
content and the page's h1 or <main>. Regions inside the selected one whose characters are mostly links, and of whose
lines none reaches the threshold by its own ratio, are menus and left out as well. A page without a content line outside furniture is judged by the length of its lines.

Character references are decoded, white space inside a line becomes one space, lines are trimmed, empty ones dropped and
the others joined by a line feed. Null html: empty, so the text is empty. Repeated rows: each extracted. Broken mark-up
(tags not closed, an end without a begin) never fails. An empty table gives no rows. Extra columns are not carried."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, STEP = 2.0, 65_536
CHIEF, HALF, LINKS = 0.75, 0.5, 0.5

# Element names and attribute words of page furniture; a heuristic of this module.
SKIPPED = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "select", "button", "textarea"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog"}
CONTAINERS = {"article", "main", "section", "div", "header", "body", "table", "ul", "ol", "dl", "blockquote", "figure", "details"} | FURNITURE
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "dt", "dd", "pre", "hr", "br", "title", "caption", "figcaption", "summary", "address", "option", "label", "legend", "fieldset"} | CONTAINERS
WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "sidebar", "widget", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "header", "comment", "comments", "respond", "reply", "replies", "disqus", "share", "sharing", "social", "recommended", "newsletter", "subscribe", "signup",
    "login", "search", "pagination", "pager", "copyright", "toolbar", "skip", "complementary", "contentinfo",
}
_ABOUT = re.compile(r"^(has|with|without|no)[-_]")  # such a class tells of something else, as has-sidebar does


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters inside links
    region: int
    title: bool  # in an h1


@dataclass
class Region:
    parent: int
    name: str
    furniture: bool
    by_word: bool  # only a class, id or role says so
    anchor: bool = False  # holds an h1 or <main>


class _Events(HTMLParser):
    """Lines and regions of a page; region 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.regions = [Region(0, "", False, False)]
        self.open: list[tuple[str, int]] = []  # containers and skipped elements: name, region (-1: its text counts nowhere)
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.titles = 0

    def _here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _end_line(self) -> None:
        region = self._here()
        text = " ".join("".join(self.text).split())
        if text and region >= 0:
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), region, self.titles > 0))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def _marked(self, tag: str, attrs: list[tuple[str, str | None]], region: int) -> tuple[bool, bool]:
        if tag in FURNITURE or any(k == "hidden" for k, _ in attrs) or (tag == "header" and not self._inside(region)):
            return True, False
        if tag in ("article", "main", "body"):
            names = {"comment", "comments"}
        else:
            names = WORDS
        tokens = (t for k, v in attrs if k in ("class", "id", "role") and v for t in re.sub(r"([a-z])([A-Z])", r"\1-\2", v).lower().split())
        named = any(names.intersection(re.split(r"[^a-z]+", t)) for t in tokens if not _ABOUT.match(t))
        return named, named

    def _inside(self, region: int) -> bool:
        """Is the region in an <article> or <main>?"""
        while region > 0:
            if self.regions[region].name in ("article", "main"):
                return True
            region = self.regions[region].parent
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self._end_line()
        self.tags += 1
        if tag == "body":  # ends a head that was left open
            self.open = [x for x in self.open if x[0] != "head"]
        region = self._here()
        if tag in SKIPPED or (tag in CONTAINERS and region < 0):
            self.open.append((tag, -1))
        elif tag in CONTAINERS:
            self.regions.append(Region(region, tag, *self._marked(tag, attrs, region)))
            self.open.append((tag, len(self.regions) - 1))
        elif tag == "a":
            self.links = 1  # links do not nest
        elif tag == "h1":
            self.titles = 1
        if region >= 0 and tag in ("h1", "main"):
            at = self._here()
            while at > 0 and not self.regions[at].anchor:
                self.regions[at].anchor = True
                at = self.regions[at].parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self._end_line()
        self.tags += 1
        if tag == "a":
            self.links = 0
        elif tag == "h1":
            self.titles = 0
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())


def _smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel counts what is there."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(ratio) < len(kernel):
        weights = np.exp(-0.5 * ((np.arange(len(ratio))[:, None] - np.arange(len(ratio))) / sigma) ** 2)
        return weights @ ratio / weights.sum(axis=1)
    return np.convolve(ratio, kernel, "same") / np.convolve(np.ones(len(ratio)), kernel, "same")


def _threshold(values: np.ndarray) -> float:
    """The middle between two clusters' means (two-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above) or (below.mean(), above.mean()) == (low, high):
            break
        low, high = float(below.mean()), float(above.mean())
    return (low + high) / 2


def _sums(regions: list[Region], values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The sum of the lines' values in each region and all regions inside it; a parent's number is below its children's."""
    out = np.bincount(place, values, len(regions))
    for k in range(len(regions) - 1, 0, -1):
        out[regions[k].parent] += out[k]
    return out


def selected(lines: list[Line], regions: list[Region], content: np.ndarray, rich: np.ndarray) -> np.ndarray:
    """Which lines are main text, given which of them are content lines, and which reach the threshold by themselves."""
    place = np.array([x.region for x in lines])
    size = np.array([len(x.text) for x in lines], "f8")
    weight = _sums(regions, size * content, place)
    left_out = np.zeros(len(regions), bool)
    for k, r in enumerate(regions[1:], 1):
        chief = r.by_word and r.anchor and weight[k] > HALF * weight[0]
        left_out[k] = left_out[r.parent] or (r.furniture and not chief)
    free = ~left_out[place]
    if not free.any():
        return free
    if not (content & free).any():
        content = np.ones(len(lines), bool)
    weight = _sums(regions, size * (content & free), place)
    children: dict[int, list[int]] = {}
    for k, r in enumerate(regions[1:], 1):
        children.setdefault(r.parent, []).append(k)
    chief = 0
    while regions[chief].name not in ("article", "main"):
        down = [k for k in children.get(chief, ()) if weight[k] >= (HALF if regions[k].name in ("article", "main") else CHIEF) * weight[0]]
        if not down:
            break
        chief = max(down, key=lambda k: weight[k])
    inside = np.zeros(len(regions), bool)
    inside[chief] = True
    all_size, all_rich = _sums(regions, size * free, place), _sums(regions, size * rich, place)
    all_links = _sums(regions, np.array([x.linked for x in lines], "f8") * free, place)
    for k in range(chief + 1, len(regions)):
        menu = all_rich[k] == 0 and all_links[k] > LINKS * all_size[k]
        inside[k] = inside[regions[k].parent] and not menu
    keep = free & inside[place]
    first = int(np.flatnonzero(keep)[0]) if keep.any() else 0
    for k in range(first):
        keep[k] |= lines[k].title and free[k]
    return keep


def main_text(html: str) -> str:
    """The main text of a whole page."""
    events = _Events()
    for at in range(0, len(html), STEP):
        events.feed(html[at : at + STEP])
    events.close()
    events._end_line()
    lines = events.lines
    if not lines:
        return ""
    ratio = np.array([len(x.text) / max(x.tags, 1) for x in lines])
    cut = _threshold(smooth := _smooth(ratio))
    keep = selected(lines, events.regions, smooth >= cut, ratio >= cut)
    return "\n".join(x.text for x, k in zip(lines, keep.tolist(), strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(rows, f"page_id {kind}, url string, text string, n_chars long")


op4 = extracted
