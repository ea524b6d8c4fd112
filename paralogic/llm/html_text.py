"""Main text of web pages by line-block distribution.

Markup is stripped first: each block element gives one line. A line's weight is
its text length outside links, 0 if most of it is links. Elements that are page
furniture by their tag, role, class or id (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments), scripts, styles and comments give a gap,
a line of length zero. Weights are summed over windows of ``WINDOW`` lines that
slide over the page. A surge point is a line at which the sums rise to the
threshold, a dive point the last line of the last window before they fall below it
again; the text between the two is kept, short lines and links within it too.

Windows reach over a surge or dive by some lines, so the ends are trimmed: gaps,
lines of links, and short lines that share no container with a long line of the
stretch go (a heading before the text stays). Short lines next to the ends that do
share such a container, other than the page itself, stay. <article> and <main> are a bonus:
where a page has them, lines inside weigh ``BONUS`` times as much and lines outside
a ``BONUS``-th. The threshold is ``SURGE`` characters, or the largest sum of the
page if that is less, so a short article is found as well.

Scale: a narrow pass in Arrow batches, a page at a time; no shuffle; memory is a
page. The scanner reads each page once from left to right, in linear time whatever
quotes or tags it leaves open.

Defined results: null and empty pages have an empty text; unclosed elements reach
to the end of the page, as in browsers; a tag without an end is text; repeated rows
stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 3
SURGE = 80
BONUS = 8

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not text of the page, whatever stands in it.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "select"}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored sponsors promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar aside widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " signup login signin search searchbox share sharing social related recommended recommendations trending popular pagination pager comment comments respond reply replies disqus"
    " copyright disclaimer outbrain taboola paywall".split()
)
#: Tokens of a class or id that make an <article> or <section> furniture too.
_CARRIERS = {"html", "body", "main", "article"}
_ON_CARRIERS = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "comments", "reply", "replies", "related", "recommended"}
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol"
    " p pre section summary table tbody thead tfoot tr caption ul".split()
)
_SPACES = {"br", "td", "th", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that part the page: lines in one of them belong together.
_CONTAINERS = {"body", "div", "section", "article", "main", "header", "td", "th"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTENT = {"article", "main"}


def is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is page furniture; ``inside`` an <article> a <header> is the article's own."""
    if tag in _FURNITURE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" and tag not in _CARRIERS:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            words = {w.lower() for w in _TOKEN.findall(value)}
            if words & (_ON_CARRIERS if tag in _CARRIERS else _WORDS) or "header" in words and not inside and words & {"site", "page", "top", "main", "global", "header"} and tag in ("div", "section") and "article" not in words:
                return True
    return False


class Line(NamedTuple):
    """A block of text; a gap has no text."""

    text: str
    outside: int  # characters outside links
    content: int  # number of the <article> or <main> around it, 0 if none
    container: int  # number of the innermost element that parts the page
    heading: bool


GAP = Line("", 0, 0, -1, False)


class Tags:
    """Finds the ends of tags in linear time: quoted > do not end a tag, unless its quotes never close."""

    def __init__(self, html: str) -> None:
        self.at = [m.start() for m in _SPECIAL.finditer(html)]
        n = len(self.at)
        #: by special character: where a tag ends whose first special character this is; the next >.
        self.end, self.plain = [-1] * (n + 1), [-1] * (n + 1)
        later = {'"': -1, "'": -1}
        for k in range(n - 1, -1, -1):
            c = html[self.at[k]]
            self.plain[k] = self.at[k] if c == ">" else self.plain[k + 1]
            if c == ">":
                self.end[k] = self.at[k]
            else:
                self.end[k] = self.end[later[c] + 1] if later[c] >= 0 else -1
                later[c] = k

    def after(self, start: int, quotes: bool = True) -> int:
        """Place behind the tag that begins at ``start``; -1 if it has no end."""
        k = bisect_left(self.at, start)
        end = self.end[k] if quotes else -1
        end = self.plain[k] if end < 0 else end
        return end + 1 if end >= 0 else -1


def lines_of(html: str) -> list[Line]:
    """Blocks of text and gaps in page order."""
    out: list[Line] = []
    held: list[str] = []
    linked = links = numbered = 0  # characters of the block inside links; open links; elements so far
    content: list[int] = []  # open <article> and <main> elements
    containers: list[int] = []
    opened: dict[str, list[int]] = {tag: [] for tag in _CONTAINERS}  # places of the open ones of a tag
    heading = ""
    skip, depth = "", 0
    at, size, tags = 0, len(html), Tags(html)

    def end() -> None:
        nonlocal held, linked
        if held:
            raw = "".join(held)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Line(text, max(0, len(text) - linked), content[0] if content else 0, containers[-1] if containers else 0, bool(heading)))
        held, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if not skip and piece:
            held.append(piece)
            if links:
                linked += len(piece.strip())

    while at < size:
        m = _OPEN.search(html, at)
        add(html[at : m.start() if m else size])
        if not m:
            break
        start = m.end()
        if html.startswith("!--", start):
            close = html.find("-->", start + 3)
            at = close + 3 if close >= 0 else size
            continue
        name = _NAME.match(html, start)
        at = tags.after(start, name is not None)
        if at < 0:  # no tag ends here or later: the rest is text
            add(html[m.start() :])
            break
        if not name:
            continue
        tag, closing, attributes = name[2].lower(), name[1] == "/", html[name.end() : at - 1]
        if not closing and tag in _RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}(?![a-zA-Z0-9:-])[^>]*>", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if skip:
            if tag == skip and tag not in _VOID:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
            continue
        if tag in _BLOCKS:
            end()
        elif tag in _SPACES:
            held.append(" ")
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if closing:
            if tag in _CONTENT and content:
                content.pop()
            if tag == heading:
                heading = ""
            if tag in _CONTAINERS:
                while opened[tag] and opened[tag][-1] >= len(containers):  # closed by an outer one
                    opened[tag].pop()
                if opened[tag]:
                    del containers[opened[tag].pop() :]
            continue
        if tag not in _VOID and is_furniture(tag, attributes, bool(content)):
            end()
            out.append(GAP)
            skip, depth = tag, 1
            continue
        numbered += 1
        if tag in _CONTENT:
            content.append(numbered)
        if tag in _CONTAINERS:
            opened[tag].append(len(containers))
            containers.append(0 if tag == "body" else numbered)
        if tag in _HEADINGS:
            heading = tag
        elif tag in _BLOCKS:
            heading = ""
    if not skip:
        end()
    return out


def weights(lines: list[Line], bonus: int = BONUS) -> list[int]:
    """What each line adds to the sums: characters outside links, times ``bonus`` inside marked content and over it outside."""
    marked = any(x.content for x in lines)
    out = []
    for x in lines:
        own = x.outside if 2 * x.outside > len(x.text) or x.content else 0
        out.append(own if not marked else own * bonus if x.content else own // bonus)
    return out


def stretches(sums: list[int], threshold: int, window: int) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch: lines from the first window that reaches the threshold to behind the last one."""
    out: list[tuple[int, int]] = []
    for i, s in enumerate(sums):
        if s >= threshold:
            if out and i <= out[-1][1] and sums[i - 1] >= threshold:
                out[-1] = (out[-1][0], i + window)
            else:
                out.append((i, i + window))
    return [(a, min(b, len(sums))) for a, b in out]


def home(x: Line) -> tuple[int, int]:
    """What a line belongs to: its marked content, or the innermost element that parts the page."""
    return (x.content, 0) if x.content else (0, x.container)


def trimmed(lines: list[Line], own: list[int], start: int, stop: int, homes: set[tuple[int, int]], least: float) -> tuple[int, int]:
    """The stretch without what its windows reached over at both ends."""

    def loose(k: int, first: bool) -> bool:
        x = lines[k]
        if not x.text or not own[k] and not x.content:
            return True
        return own[k] < least and bool(homes) and home(x) not in homes and not (first and x.heading)

    while start < stop and loose(start, True):
        start += 1
    while stop > start and loose(stop - 1, False):
        stop -= 1
    return start, stop


def reach(lines: list[Line], own: list[int], at: int, step: int, homes: set[tuple[int, int]], limit: int) -> int:
    """The end ``at`` of a stretch, moved over short lines (and gaps before them) of the containers its long lines stand in."""
    found, k = at, at if step > 0 else at - 1
    while (k < limit if step > 0 else k >= limit) and (not lines[k].text or own[k] and home(lines[k]) in homes):
        if lines[k].text:
            found = k + 1 if step > 0 else k
        k += step
    return found


def between(lines: list[Line], window: int = WINDOW, surge: int = SURGE, bonus: int = BONUS) -> list[str]:
    """Texts of the lines between surge and dive points.

    Lines between a dive and the next surge stay too if they are no links and all
    stand in a container that both stretches have long lines in (a list of short items)."""
    own = weights(lines, bonus)
    running, sums = 0, [0] * len(own)
    for i in range(len(own) - 1, -1, -1):
        running += own[i] - (own[i + window] if i + window < len(own) else 0)
        sums[i] = running
    threshold = min(surge, max(sums, default=0))
    if not threshold:  # links alone: only marked content can tell text from a menu
        return [x.text for x in lines if x.content]
    kept: list[int] = []
    before: set[tuple[int, int]] = set()
    for a, b in stretches(sums, threshold, window):
        homes = {home(lines[k]) for k in range(a, b) if own[k] * window >= threshold}
        start, stop = trimmed(lines, own, a, b, homes, threshold / window)
        inner = homes - {(0, 0)}  # the page itself says nothing of a line
        last = kept[-1] + 1 if kept else 0
        if stop <= last:
            before = before | homes
            continue
        start, stop = reach(lines, own, start, -1, inner, last), reach(lines, own, stop, 1, inner, len(lines))
        gap = range(last, start)
        if kept and all(not lines[k].text or own[k] and home(lines[k]) in homes & before for k in gap):
            start = last
        kept += range(max(start, last), stop)
        before = homes
    return [lines[k].text for k in kept if lines[k].text]


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by a line feed."""
    return "\n".join(between(lines_of(html))) if html else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
