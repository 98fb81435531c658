"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events; block elements cut the page
into lines. Each line has a text-to-tag ratio. A line inside an element that is beside the
article by its name, role or class (menus, forms, adverts, comments and the like) has its
ratio times DAMPING. The ratios are smoothed along the page with a Gaussian, and a
threshold that splits the smoothed ratios into two clusters marks content lines. The
content region is the smallest container that holds most of the marked text which is not
beside the article.

An ``article`` or ``main`` is evidence, too: a region inside one is widened to the
outermost one around it, and of a region with some inside it only these are taken; there
every line counts, short ones in lists and tables too. In a region without any, inner
containers in which no line is marked are left out. Lines beside the article are never
part of the text; an outermost article is never beside itself by its class or id, and
inside one only whole class names count.

Defined cases: a null or empty page gives the empty text; a page of one line is that
line; very long pages are read whole; broken markup is read as far as the parser goes,
unclosed elements ending with what encloses them or where HTML ends them (within their
scope: an item in its list, a cell in its table), and a tag that the page's end cuts off
is no text; the time for a page follows its length however deep it is nested; ties between
containers go to the inner one; repeated rows give the same text; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIGMA = 1.0
MASS = 0.8
DAMPING = 0.1
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body blockquote ul ol table".split())
#: Elements whose text is not shown as text, and such as are beside an article.
SILENT = frozenset("head script style noscript template button select option textarea input iframe svg canvas object audio video map".split())
AROUND = frozenset("nav footer aside form dialog menu".split())
NEVER = SILENT | AROUND
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that name a part beside the article in a class or id; inside an article, only in names made of nothing but them and PARTS.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside header masthead footer comment comments reply replies disqus respond cookie cookies consent notice notices alert popup modal overlay "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar copyright legal disclaimer gdpr".split()
)
#: By scope, what a new element looks back to: the last open one of these is ended if it is of a kind that the new one ends, and else shields what is around it.
SCOPES = {
    "p": frozenset("p body caption td th table button object template".split()),
    "item": (BLOCK | NEVER) - {"address", "div", "p"},
    "cell": frozenset("td th table template".split()),
    "row": frozenset("tr table template".split()),
    "option": frozenset("option select datalist".split()),
}
WATCHED = {tag: tuple(s for s, tags in SCOPES.items() if tag in tags) for tag in frozenset().union(*SCOPES.values())}
#: By new element, the scopes and the kinds that it ends in them.
_PARAGRAPH = ("p", frozenset(["p"]))
ENDS = {tag: (_PARAGRAPH,) for tag in BLOCK - frozenset("body html caption legend tbody td tfoot th thead tr".split())} | {
    "li": (("item", frozenset(["li"])), _PARAGRAPH),
    "dt": (("item", frozenset(["dt", "dd"])), _PARAGRAPH),
    "dd": (("item", frozenset(["dt", "dd"])), _PARAGRAPH),
    "td": (("cell", frozenset(["td", "th"])),),
    "th": (("cell", frozenset(["td", "th"])),),
    "tr": (("row", frozenset(["tr"])),),
    "option": (("option", frozenset(["option"])),),
}
PARTS = frozenset("area areas bar block blocks box boxes btn button buttons card cards container content entry form group icon icons inner item items link links list page post posts row section site slot thread title unit widget widgets wrap wrapper".split())
#: Elements whose id is not made from the article's own words, as those of headings and sections are.
GENERIC = frozenset("div ul ol".split())
_MARKUP = re.compile("<[A-Za-z/!?]")


def _words(name: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in name.lower()).split()


def _names_part(name: str) -> bool:
    words = _words(name)
    return all(w in BESIDE or w in PARTS for w in words) and any(w in BESIDE and w not in ("header", "copyright", "legal") for w in words)


def _beside(tag: str, attributes: list[tuple[str, str | None]], inside: bool) -> bool:
    for name, value in attributes:
        if name in ("class", "id") and value:
            if inside:
                if (name == "class" or tag in GENERIC) and any(map(_names_part, value.split())):
                    return True
            elif tag not in ("article", "main") and any(w in BESIDE for w in _words(value)):
                return True
        elif name == "role" and value and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return True
    return False


class Lines(HTMLParser):
    """The page as lines: text, tags, the container around it, and whether it lies in an element beside the article."""

    def __init__(self, trusting: bool = False):
        super().__init__(convert_charrefs=True)
        self.trusting = trusting
        self.stack: list[str] = []
        self.within: Counter[str] = Counter()
        self.seen: dict[str, list[str]] = {scope: [] for scope in SCOPES}
        #: Depths of the outermost open elements without text, and beside the article.
        self.silent: int | None = None
        self.beside: int | None = None
        self.by_name = self.missed = False
        self.boxes: list[tuple[int, int]] = []
        self.parents: list[int] = []
        self.article: list[bool] = []
        self.lines: list[tuple[str, int, int, bool]] = []
        self.words: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.lines.append((text, self.tags, self.boxes[-1][1] if self.boxes else -1, self.beside is not None))
            self.tags = 0
        self.words.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        for scope, kinds in ENDS.get(tag, ()):
            if (seen := self.seen[scope]) and seen[-1] in kinds:
                self.handle_endtag(seen[-1], counted=False)
        if tag in BLOCK and self.silent is None:
            self.flush()
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        self.stack.append(tag)
        self.within[tag] += 1
        for scope in WATCHED.get(tag, ()):
            self.seen[scope].append(tag)
        if self.silent is not None:
            return
        if self.beside is not None:
            self.missed |= tag in ("article", "main") and not self.by_name and not _beside(tag, attrs, True)
            if tag in SILENT:
                self.silent = len(self.stack)
            return
        box = self.boxes[-1][1] if self.boxes else -1
        inside = box >= 0 and self.article[box]
        by_name = tag in AROUND or (tag == "header" and not inside)
        if tag in SILENT:
            self.silent = len(self.stack)
        elif by_name or (attrs and tag not in ("html", "body") and (inside or not self.trusting) and _beside(tag, attrs, inside)):
            self.by_name = by_name
            if tag in BLOCK or by_name:
                self.flush()
                self.beside = len(self.stack)
            else:
                self.silent = len(self.stack)  # in the middle of a line
        elif tag in CONTAINER:
            self.parents.append(box)
            self.article.append(inside or tag in ("article", "main"))
            self.boxes.append((len(self.stack), len(self.parents) - 1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag, counted=False)

    def handle_endtag(self, tag: str, counted: bool = True) -> None:
        self.tags += counted
        if tag in BLOCK and self.silent is None:
            self.flush()
        if not self.within[tag]:
            return
        while self.stack:
            last = self.stack.pop()
            self.within[last] -= 1
            for scope in WATCHED.get(last, ()):
                self.seen[scope].pop()
            if self.silent is not None and len(self.stack) < self.silent:
                self.silent = None
            if self.beside is not None and len(self.stack) < self.beside:
                self.flush()
                self.beside = None
            while self.boxes and self.boxes[-1][0] > len(self.stack):
                self.flush()
                self.boxes.pop()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.silent is None:
            self.words.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "same") if len(ratio) > 2 * reach else None
    if weight is None:
        near = kernel[reach + np.clip(np.arange(len(ratio))[:, None] - np.arange(len(ratio))[None, :], -reach, reach)]
        near[np.abs(np.arange(len(ratio))[:, None] - np.arange(len(ratio))[None, :]) > reach] = 0
        return near @ ratio / near.sum(axis=1)
    return np.convolve(ratio, kernel, "same") / weight


def threshold(values: np.ndarray) -> float:
    """Between two clusters: means of either side, until they stay (one-dimensional 2-means)."""
    cut = float(values.mean())
    for _ in range(20):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return min(cut, float(values.max()))


def _read(html: str, trusting: bool) -> Lines:
    """trusting: outside an article, classes and roles do not leave anything out."""
    page = Lines(trusting)
    # After the last > no tag can end: the parser would look for one from every <.
    cut = _MARKUP.search(html, html.rfind(">") + 1)
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    page.flush()
    return page


def content(page: Lines) -> np.ndarray:
    """Which lines the ratios mark."""
    ratio = np.array([len(text) / max(1, tags) * (DAMPING if beside else 1) for text, tags, _, beside in page.lines])
    score = smoothed(ratio)
    return score >= threshold(score)


def region(page: Lines, marked: list[bool]) -> tuple[int, list[bool]]:
    """The smallest container with most of the marked text (-1: none but the page), and which containers hold marked text."""
    # A box comes after the one around it: sums go up in reverse order.
    mass, holds, total = [0] * len(page.parents), [False] * len(page.parents), 0
    for (text, _, box, _), good in zip(page.lines, marked, strict=True):
        if good:
            total += len(text)
            if box >= 0:
                mass[box] += len(text)
                holds[box] = True
    for box in range(len(mass) - 1, -1, -1):
        if holds[box] and (above := page.parents[box]) >= 0:
            mass[above] += mass[box]
            holds[above] = True
    return max((b for b, m in enumerate(mass) if holds[b] and m >= MASS * total), default=-1), holds


def chosen(page: Lines) -> list[str]:
    """The lines of the article."""
    own = [not beside for *_, beside in page.lines]
    marked = [m and o for m, o in zip(content(page).tolist(), own, strict=True)]
    at, holds = region(page, marked)
    within = [False] * len(page.parents)
    for box, above in enumerate(page.parents):
        within[box] = at < 0 or box == at or (above >= 0 and within[above])
    articles = {box for (_, _, box, _), o in zip(page.lines, own, strict=True) if o and box >= 0 and page.article[box]}
    if at >= 0 and page.article[at]:
        while (above := page.parents[at]) >= 0 and page.article[above]:
            at = above
        kept = [False] * len(page.parents)
        for box, above in enumerate(page.parents):
            kept[box] = box == at or (above >= 0 and kept[above])
    elif inner := [box for box in articles if within[box]]:
        kept = [box in inner for box in range(len(page.parents))]
    elif any(m and box in articles for (_, _, box, _), m in zip(page.lines, marked, strict=True)):
        kept = [box in articles for box in range(len(page.parents))]  # little text, but marked: the article, beside more of something else
    else:
        kept = [False] * len(page.parents)
        for box, above in enumerate(page.parents):
            kept[box] = box == at or (holds[box] and (kept[above] if above >= 0 else at < 0))
        return [text for (text, _, box, _), o in zip(page.lines, own, strict=True) if o and (kept[box] if box >= 0 else at < 0)]
    return [text for (text, _, box, _), o in zip(page.lines, own, strict=True) if o and box >= 0 and kept[box]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _read(html, False)
    if page.missed and not any(box >= 0 and page.article[box] and not beside for _, _, box, beside in page.lines):
        page = _read(html, True)  # a wrapper named after the sidebar beside it holds the article
    if len(page.lines) < 2:
        return "".join(text for text, _, _, beside in page.lines if not beside)
    return "\n".join(chosen(page))


@common.on_arrow("string")
def main_texts(html: pa.Array) -> pa.Array:
    return pa.array([main_text(raw.decode()) for part in common.chunks(html) for raw in part], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), main_texts("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
