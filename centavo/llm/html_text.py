"""HTML extraction by tree scoring.

A page is read as a stream of tags and texts. Block elements make a tree; inline elements only
mark links. Text between block tags is a block, a paragraph of the element it stands in. Paragraphs
pass points for their length and commas to the elements above them: all to the nearest container,
half to the next, less further up. An element's score is discounted by the share of its text that is
in links; the best one and siblings of like worth are the main text. Elements that are not article
text by their name (menus, footers, scripts ...) or because a class, id or role is such a word
(adverts, notices, comments ...) are left out with all they hold; a header is left out unless it stands
in the article. Where such a word is only part of a class (`has-sidebar`), stands beside a word for content, or the
element is a form, the element is left out unless it holds an article or, on a page without one, most of the text.

A tag whose quotes never close ends at the next `>`, and from there on quotes are not minded; every page is read
in time linear in its length. White space inside a block becomes one space; a line break counts as white space. Null, empty and
tagless pages have a defined result: no text, no text, and the page's own text. A page is
judged alone, so repeated rows give repeated results. Columns other than page_id, url and html
are not looked at.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.llm.arrow import map_batches

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>", re.S)
#: From where on quotes no longer count.
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp "
                   "small source span strike strong sub sup time tt u var wbr".split())  # fmt: skip
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head nav footer aside noscript template svg canvas button select object dialog menu header".split())
LEFT_OUT_LABELS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus share sharing "
    "social related subscribe newsletter popup modal login signup search toolbar pagination pager widget contentinfo complementary".split()
)
CONTENT_LABELS = frozenset("content article main post entry story body page text wrapper container layout".split())
SHOWN, DOUBTFUL, HIDDEN = range(3)
ARTICLE = frozenset(("article", "main"))
PARAGRAPH = frozenset("p pre blockquote li td th dd dt figcaption h1 h2 h3 h4 h5 h6 summary caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends open elements of the values, up to an element of the stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table".split())
DEPTH = 5  # levels of elements that a paragraph's points reach


class _Page:
    def __init__(self) -> None:
        self.tags: list[str] = ["html"]
        self.up: list[int] = [-1]
        self.span: list[list[int]] = [[0, 0]]  # blocks begun and ended within
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = self.links = 0
        self.state = [SHOWN]  # of each element, by its own name and labels
        self.hidden = 0  # open elements that are left out
        self.articles = 0

    def add(self, raw: str) -> None:
        if not self.hidden:
            self.text.append(raw)
            if self.links:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((self.open[-1][1], text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def push(self, tag: str, labels: str) -> None:
        if tag in LEFT_OUT and not (tag == "header" and self.articles):
            state = HIDDEN
        elif tag in ARTICLE or tag in ("html", "body"):
            state = SHOWN
        else:
            state = max(DOUBTFUL if tag == "form" else SHOWN, judged(labels))
        if self.hidden or state == HIDDEN:
            self.hidden += 1
            node = -1
        else:
            node = len(self.tags)
            self.tags.append(tag)
            self.up.append(self.open[-1][1])
            self.span.append([len(self.blocks), 0])
            self.state.append(state)
            self.articles += tag in ARTICLE
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> str:
        tag, node = self.open.pop()
        self.count[tag] -= 1
        if node < 0:
            self.hidden -= 1
        else:
            self.span[node][1] = len(self.blocks)
            self.articles -= tag in ARTICLE
        return tag

    def start(self, tag: str, attributes: str) -> None:
        labels = ""
        if "=" in attributes:
            labels = " ".join("".join(m) for m in LABEL.findall(attributes))
        if tag in INLINE:
            if tag == "br":
                self.add(" ")
            elif tag == "a":
                self.links = 1
            if tag in VOID or not judged(labels):
                return
        self.flush()
        if tag in VOID:
            return
        if self.count.get("head") and tag not in ("noscript", "template"):
            self.end("head")
        if tag not in INLINE and self.open[-1][0] == "p":
            self.pop()
        if ends := ENDS.get(tag):
            while self.open[-1][0] in ends or (self.open[-1][0] not in STOPS and len(self.open) > 1 and any(self.count.get(e) for e in ends) and self._above(ends)):
                self.pop()
        self.push(tag, labels)

    def _above(self, ends: set[str]) -> bool:
        """An element to end is open above the nearest list or table."""
        for tag, _ in reversed(self.open):
            if tag in ends:
                return True
            if tag in STOPS:
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if not self.count.get(tag):
            if tag not in INLINE:
                self.flush()
            return
        self.flush()
        while self.pop() != tag:
            pass

    def settle(self) -> None:
        """Drop the text of doubtful elements, but for those that hold an article or, where there is none, most of the text."""
        n = len(self.tags)
        self.span[0][1] = len(self.blocks)
        if DOUBTFUL not in self.state:
            return
        size, article = [0] * n, [False] * n
        for node, text, _ in self.blocks:
            size[node] += len(text)
        for node in range(n - 1, 0, -1):
            article[node] |= self.tags[node] in ARTICLE and size[node] > 0
            size[self.up[node]] += size[node]
            article[self.up[node]] |= article[node]
        gone = [False] * n
        for node in range(1, n):  # an element comes after the one it stands in
            mine = self.state[node] == DOUBTFUL and not article[node] and (article[0] or 2 * size[node] <= size[0])
            gone[node] = mine or gone[self.up[node]]
        self.kept = [not gone[node] for node, _, _ in self.blocks]

    def best(self) -> str:
        n = len(self.tags)
        self.kept = [True] * len(self.blocks)
        self.settle()
        points, size, linked = [0.0] * n, [0] * n, [0] * n
        for (node, text, links), kept in zip(self.blocks, self.kept, strict=True):
            if not kept:
                continue
            size[node] += len(text)
            linked[node] += links
            if self.tags[node] in HEADING:
                continue
            worth = 1 + text.count(",") + min(len(text) / 100, 3)
            at = self.up[node] if self.tags[node] in PARAGRAPH else node
            for level in range(DEPTH):
                if at < 0:
                    break
                points[at] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
                at = self.up[at]
        for node in range(n - 1, 0, -1):
            size[self.up[node]] += size[node]
            linked[self.up[node]] += linked[node]
        score = [(p + 10 * (t in ARTICLE and p > 0)) * (1 - k / s if s else 0) for p, t, s, k in zip(points, self.tags, size, linked, strict=True)]
        top = max(range(n), key=lambda i: score[i])
        if score[top] <= 0:
            return "\n".join(text for (_, text, _), kept in zip(self.blocks, self.kept, strict=True) if kept)
        spans = [self.span[top]]
        least = max(10.0, 0.2 * score[top])
        if self.up[top] >= 0:
            for node in range(1, n):
                if self.up[node] == self.up[top] and node != top:
                    plain = self.tags[node] == "p" and size[node] > 80 and linked[node] < 0.25 * size[node]
                    if plain or score[node] >= least:
                        spans.append(self.span[node])
        return "\n".join(self.blocks[k][1] for b, e in sorted(spans) for k in range(b, e) if self.kept[k])


def judged(labels: str) -> int:
    """Whether an element of these class, id and role words is article text."""
    tokens = labels.lower().split()
    if not tokens:
        return SHOWN
    parts = [set(re.split(r"[_-]+", t)) for t in tokens]
    if all(LEFT_OUT_LABELS.isdisjoint(p) for p in parts):
        return SHOWN
    content = any(not CONTENT_LABELS.isdisjoint(p) for p in parts)
    whole = any(t in LEFT_OUT_LABELS or p <= LEFT_OUT_LABELS for t, p in zip(tokens, parts, strict=True))
    return HIDDEN if whole and not content else DOUBTFUL


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree, at, size = _Page(), 0, len(page)
    last, tag_of, begin = page.rfind(">"), TAG, 0  # text begins at `begin`, a tag is looked for from `at`
    while True:
        start = page.find("<", at)
        comment = start >= 0 and page.startswith("<!--", start)
        if start < 0 or (start > last and not comment):
            tree.add(page[begin:])
            break
        m = tag_of.match(page, start)
        if m is None and page[start + 1 : start + 2].isascii() and (page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/"):
            tag_of = PLAIN_TAG
            m = tag_of.match(page, start)
        if m is None:
            at = start + 1
            continue
        if start > begin:
            tree.add(page[begin:start])
        begin = at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
        elif tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, last + 1)
            begin = at = close.end() if close else size
            if tag != "textarea":
                tree.flush()
        else:
            tree.start(tag, m[3])
    tree.flush()
    while len(tree.open) > 1:
        tree.pop()
    return tree.best()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def fn(batch):
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_batches(rows, fn, "page_id bigint, url string, text string, n_chars bigint")
