"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks under a tree of elements. Text length and punctuation are summed up per
root-to-leaf tag path, smoothed along the page, and fused into one ratio; the paths above the page's threshold give the
content nodes. The smallest element that holds most of their weight is the article. Its blocks are kept in page order,
less lists of links whose paths stay under the threshold, and less menus, notices, adverts, forms, comments and the like.

Tags and class names only say what such a part might be: an element keeps its name's verdict where other text is left
over, and loses it where it holds most of the page, as a wrapper named after a part of it does.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the content weight that the article must hold.
HOLD = 0.9
#: Weight of the neighbours in smoothing.
SMOOTH = (0.25, 0.5, 0.25)
#: Share of the page's text that must be left over for a part of most of the text to be shut by its name.
LEFT_OVER = 0.25
#: The same where an article or main element holds what is left over.
LEFT_IN_ARTICLE = 0.05
#: Largest share of the page's text in a part with a loose name, unless it is made of links.
SMALL = 0.15
#: Share of link text from which a part is made of links.
LINKS = 0.5
#: Open elements; deeper ones count as part of the element at this depth.
DEPTH = 512

# fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul title head".split())
HOLDERS = frozenset("html body main article section div td center form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no content by their tag.
APART = frozenset("head title nav footer aside form button select option label fieldset dialog menu header search".split())
#: Names of parts, in a class or id, and names that stand for less.
NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar ad ads advert adverts advertisement advertisements sponsored cookie cookies consent popup modal newsletter subscribe signup login comment comments reply replies disqus pagination pager".split())
LOOSE = frozenset("header aside sponsor promo promotion banner notice notices share sharing social related recommended widget toolbar copyright legal".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: A name that begins so is about something else: `has-sidebar`.
ABOUT = frozenset("with without has no not is".split())
#: An opening tag of the key closes open elements of the value, up to the nearest element that bounds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table body html article section div main aside nav footer header form blockquote".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、！？]")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_PART, _LOOSE = 1, 2


def _named(tag: str, attrs: str) -> int:
    """_PART, _LOOSE or 0: what an element's tag and attributes say."""
    said = _PART if tag in APART else 0
    if said or tag in ("html", "body", "article", "main") or not _TELLING.search(attrs):
        return said
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES or name == "style" and re.search(r"display\s*:\s*none", value):
            return _PART
        if name in ("class", "id"):
            for one in value.split():
                words = [w for w in re.split(r"[_-]+", one) if w]
                if words and words[0] not in ABOUT:
                    if NAMES.intersection(words):
                        return _PART
                    if LOOSE.intersection(words):
                        said = _LOOSE
    return said


class Page:
    """A page's elements (tag, parent, what its name says, path) and text blocks (element, text, letters in links), in order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.said, self.path = [""], [-1], [0], [0]
        self.of: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack, self._open = [0], {}
        self._parts: list[str] = []
        self._at, self._links = 0, 0
        self._read(page)

    def _end(self) -> None:
        """Ends the open block."""
        text = _SPACE.sub(" ", "".join(self._parts)).strip(" ")
        if text:
            self.of.append(self._at)
            self.text.append(text)
            self.linked.append(min(self._links, len(text)))
        self._parts.clear()
        self._at = self._links = 0

    def _add(self, text: str) -> None:
        if not text:
            return
        text = entities.unescape(text) if "&" in text else text
        if not self._at and text.strip(" \t\n\r\f\v"):
            self._at = next((e for e in reversed(self._stack) if self.tag[e] in BLOCK), self._stack[0])
        self._parts.append(text)
        if self._open.get("a"):
            self._links += len(text)

    def _pop_to(self, at: int) -> None:
        gone = self._stack[at:]
        if any(self.tag[e] in BLOCK or self.said[e] for e in gone):
            self._end()
        for e in gone:
            self._open[self.tag[e]] -= 1
        del self._stack[at:]

    def _close(self, tags, bounds) -> bool:
        """Closes the innermost open element of these tags that no bound hides."""
        if any(self._open.get(t) for t in tags):
            for i in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[i]]
                if tag in tags:
                    self._pop_to(i)
                    return True
                if tag in bounds:
                    break
        return False

    def _push(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            if tag != "title":
                self._close(("head",), ())
            self._close(("p",), BOUNDS)  # a block ends an open paragraph
            if tag in CLOSES:
                self._close(CLOSES[tag], BOUNDS)
            self._end()
        said = _named(tag, attrs)
        if said:
            self._end()
        if len(self._stack) < DEPTH and not (attrs.endswith("/") and tag not in BLOCK):
            up = self._stack[-1]
            self.tag.append(tag)
            self.parent.append(up)
            self.said.append(said)
            self.path.append(self._paths.setdefault((self.path[up], tag), len(self._paths) + 1) if tag in BLOCK else self.path[up])
            self._stack.append(len(self.tag) - 1)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _read(self, page: str) -> None:
        last = {q: page.rfind(q) for q in "\"'"}
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self._add(page[at:])
                break
            after = page[lt + 1 : lt + 2]
            name = _NAME.match(page, lt + 1 + (after == "/"))
            if not name and after not in ("!", "?", "/"):  # a bare sign
                self._add(page[at : lt + 1])
                at = lt + 1
                continue
            self._add(page[at:lt])
            if not name:
                end = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
                at = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
                continue
            end = name.end()
            while True:  # a quote opens a value after `=` only
                stop = _STOP.search(page, end)
                if stop is None or stop[0] == ">":
                    break
                end = stop.end()
                if stop.start() < last[stop[0]] and page[max(name.end(), stop.start() - 16) : stop.start()].rstrip().endswith("="):
                    end = page.index(stop[0], end) + 1
            if stop is None:  # a tag that never ends
                break
            tag, attrs, at = name[0].lower(), page[name.end() : stop.start()], stop.end()
            if after == "/":
                if not self._close((tag,), () if tag in BLOCK else BLOCK) and tag in BLOCK:
                    self._end()
            elif tag == "br":
                self._parts.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    self._end()
            elif tag in RAW:
                if not attrs.endswith("/"):
                    at = _after_close(page, tag, at)
            else:
                self._push(tag, attrs)
        self._end()


def _after_close(page: str, tag: str, at: int) -> int:
    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    end = page.find(">", close.end()) if close else -1
    return len(page) if end < 0 else end + 1


def path_ratios(path: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Each block's fused ratio: its path's mean text length times its mean punctuation, fused with the smoothed sequence."""
    _, of = np.unique(path, return_inverse=True)
    count = np.bincount(of)
    ratio = (np.bincount(of, length) / count * (1 + np.bincount(of, marks)) / count)[of]
    padded = np.pad(ratio, 1, mode="edge")
    smooth = sum(w * padded[i : i + len(ratio)] for i, w in enumerate(SMOOTH))
    return np.sqrt(np.maximum(ratio, 1e-9) * smooth)


def _shut(page: Page, size: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each element whether it, or one above it, is no content by its name."""
    n = len(page.tag)
    total = max(1.0, size.sum())
    whole, links, heads = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    np.add.at(whole, page.of, size)
    np.add.at(links, page.of, linked)
    for e in range(n - 1, 0, -1):  # children stand after their parents
        up = page.parent[e]
        whole[up] += whole[e]
        links[up] += links[e]
        heads[up] |= heads[e] or page.tag[e] in HEADINGS
    inside = np.zeros(n, bool)  # of an article
    said = np.zeros(n, bool)
    for e in range(1, n):
        up = page.parent[e]
        inside[e] = inside[up] or page.tag[e] in ("article", "main")
        loose = page.said[e] == _LOOSE and whole[e] > SMALL * total and links[e] < LINKS * whole[e]
        title = page.tag[e] == "header" and inside[up] and heads[e]  # an article's own heading
        said[e] = bool(page.said[e]) and not loose and not title

    while True:
        top = np.zeros(n, np.int64)  # the uppermost named element at or above each
        for e in range(1, n):
            top[e] = top[page.parent[e]] or (e if said[e] else 0)
        share = np.zeros(n)
        np.add.at(share, top[page.of], size)
        left = share[0]
        in_article = size[(top[page.of] == 0) & inside[page.of]].sum()
        share[0] = 0
        most = int(share.argmax())
        wrapper = page.tag[most] == "form" or page.tag[most] not in APART
        if left >= LEFT_OVER * total or in_article >= LEFT_IN_ARTICLE * total or not wrapper or share[most] < total / 2:
            return top > 0
        said[most] = False  # a wrapper: what is inside speaks for itself


def main_text(page: str | None) -> str:
    """The page's main text; empty for null, empty or contentless pages."""
    read = Page(page or "")
    if not read.text:
        return ""
    size, linked = np.array([len(t) for t in read.text], float), np.array(read.linked, float)
    open_ = np.flatnonzero(~_shut(read, size, linked)[read.of])
    if not len(open_):
        return ""
    of, size, linked = np.array(read.of)[open_], size[open_], linked[open_]
    path = np.array(read.path)[of]
    fused = path_ratios(path, size, np.array([len(_MARKS.findall(read.text[i])) for i in open_], float))
    chosen = fused >= min(fused.std(), fused.max())
    n = len(read.tag)
    weight = np.zeros(n)
    np.add.at(weight, of[chosen], size[chosen])
    for e in range(n - 1, 0, -1):
        weight[read.parent[e]] += weight[e]
    full = [e for e in range(1, n) if weight[e] >= HOLD * weight[0] and read.tag[e] in HOLDERS]
    holder = up = max(full, default=0)  # the deepest: it was opened last
    while up:  # a part of an article stands for the whole of it
        holder = up if read.tag[up] in ("article", "main") else holder
        up = read.parent[up]
    within = np.zeros(n, bool)
    for e in range(n):
        within[e] = e == holder or (e > holder and within[read.parent[e]])
    # paths under the threshold that are made of links: menus without a name
    _, group = np.unique(path, return_inverse=True)
    menu = (np.bincount(group, linked) >= LINKS * np.bincount(group, size)) & (np.bincount(group, chosen) == 0) & (np.bincount(group) > 1)
    keep = within[of] & ~menu[group]
    return " ".join(read.text[i] for i in open_[keep])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row from its whole html.

    Null or empty html, and pages without content, give an empty text; text outside all elements counts as a block. A
    tag or comment that never ends takes the rest of the page with it, as in a browser. Very long and deeply nested
    pages take time in proportion to their length. Repeated rows give a row each; further columns are ignored; an empty
    table gives none.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
