"""Main-text extraction by composite text density.

Every node of the page's tree gets its characters per tag, adjusted by its links. A node's density sum adds up its
children's densities; the node with the largest sum holds the article. The smallest density on the path from there to the body is the
threshold: every node that reaches it brings in the largest-sum node below it. Density alone would drop titles and short paragraphs beside
these nodes, so it decides on boxes (div, section and the like): text elements and like parts beside content stay, and so does all of the best
node's article element.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"html", "body", "caption", "option", "tbody", "tfoot", "thead", "tr", "legend", "select"}
#: A start tag ends the nearest open one of these, unless one of the limits lies between.
ENDS_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"caption"}, {"table"}),
}
#: Blocks that stay or go by their own density; other elements go with the content they stand beside.
BOXES = frozenset("address article body center details div fieldset header hgroup main section summary".split())
CELLS = frozenset("table tbody td tfoot th thead tr".split())
#: A table cell with one of these lays out the page and is a box; others hold data.
LAYOUT = frozenset("article div h1 h2 main p section table".split())
#: Elements that never hold article text.
NOT_TEXT = frozenset(
    "head script style noscript template title textarea iframe object embed canvas audio video svg map nav footer aside dialog menu form fieldset button select option "
    "input label xmp noembed noframes".split()
)
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id names that mark what surrounds an article.
NOT_TEXT_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer breadcrumb breadcrumbs ad ads adbox advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations comment comments commentlist disqus reply replies respond pagination pager widget toolbar masthead".split()
)
_MARKUP = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME_PART = re.compile(r"[a-z]+")
#: Names that say what a wrapper has.
_PROPERTY = re.compile(r"\b(?:has|with|no|without)[-_]\S*")
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Page:
    """A page as a list of nodes in order of their start tags, and the order of tags and texts."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#root"], [0], [""]
        self.events: list[tuple[int, int, str]] = []  # (kind, node, text): 0 opens, 1 text, 2 closes
        stack = [0]
        at = 0
        while at < len(source):
            m = _MARKUP.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                if m.group().startswith("<![CDATA["):
                    self._text(stack[-1], m.group()[9:-3])
                continue
            name = name.lower()
            if m.group(1) or m.group(4):
                self._end(stack, name)
                continue
            rest = m.group(3) or m.group(6) or ""
            self._implied(stack, name)
            node = len(self.tags)
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.attributes.append(rest)
            self.events.append((0, node, ""))
            if name in VOID or rest.endswith("/") and name in ("svg", "path"):
                self.events.append((2, node, ""))
            elif name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                self.events.append((2, node, ""))
                at = end.end() if end else len(source)
            else:
                stack.append(node)
        while len(stack) > 1:
            self.events.append((2, stack.pop(), ""))

    def _text(self, node: int, raw: str) -> None:
        self.events.append((1, node, html.unescape(raw) if "&" in raw else raw))

    def _close(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            self.events.append((2, stack.pop(), ""))

    def _find(self, stack: list[int], names, limits) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag in names:
                return depth
            if tag in limits:
                return 0
        return 0

    def _implied(self, stack: list[int], name: str) -> None:
        if name in ENDS_P and (depth := self._find(stack, {"p"}, BLOCKS - {"p"} | {"td", "th", "button"})):
            self._close(stack, depth)
        if name in ENDS_SAME and (depth := self._find(stack, *ENDS_SAME[name])):
            self._close(stack, depth)

    def _end(self, stack: list[int], name: str) -> None:
        limits = {"td", "th", "table"} if name in BLOCKS else BLOCKS | {"td", "th"}
        if depth := self._find(stack, {name}, limits - {name} if name != "table" else set()):
            self._close(stack, depth)


def _unwanted(page: Page, own: np.ndarray, article: np.ndarray) -> np.ndarray:
    """Nodes outside the article by their element, role or names; what stands below them goes as well."""
    n = len(page.tags)
    chars = _sums(page, own)
    never, marked, title = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    inside = np.zeros(n, bool)  # of an article or main element
    for i in range(1, n):
        tag, parent = page.tags[i], page.parents[i]
        inside[i] = inside[parent] or tag in ("article", "main")
        title[i] = tag == "h1"
        if tag in NOT_TEXT or tag == "header" and not inside[i]:
            never[i] = True
        elif page.attributes[i] and tag not in ("html", "body", "main") and not article[i]:
            values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(page.attributes[i])}
            names = set(_NAME_PART.findall(_PROPERTY.sub(" ", values.get("class", "") + " " + values.get("id", ""))))
            marked[i] = bool(values.get("role") in NOT_TEXT_ROLES or _HIDDEN.search(page.attributes[i]) or names & NOT_TEXT_NAMES)
    # Text and titles outside marked blocks: below a node, and below it or beside the large marked blocks around it.
    free, titles = own.copy(), title.copy()
    for i in range(n - 1, 0, -1):
        titles[page.parents[i]] |= titles[i] and not never[i]
        free[page.parents[i]] += 0 if never[i] or marked[i] else free[i]
    out = np.zeros(n, bool)
    beside = np.full(n, free[0])
    for i in range(1, n):
        parent = page.parents[i]
        out[i], beside[i] = out[parent] or never[i], beside[parent]
        if marked[i] and not out[i]:
            # A wrapper may be named after one of its parts: of large blocks, what holds the page's title or all text there is stays.
            comments = "comment" in page.attributes[i].lower()
            out[i] = 2 * chars[i] <= chars[0] or beside[i] > 0 and (comments or not titles[i])
            beside[i] += free[i]
    return out


def _sums(page: Page, values: np.ndarray) -> np.ndarray:
    """Sums over subtrees; a node always comes after its parent."""
    out = values.copy()
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] += out[i]
    return out


def densities(page: Page, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Composite density and density sum of every node, and the body's number; nodes not in ``use`` count for nothing."""
    n = len(page.tags)
    own = np.zeros(n)
    link = np.zeros(n, bool)
    for i in range(1, n):
        link[i] = link[page.parents[i]] or page.tags[i] == "a"
    for kind, node, text in page.events:
        if kind == 1 and use[node]:
            own[node] += len(text.strip())
    chars, link_chars = _sums(page, own), _sums(page, own * link)
    tags = _sums(page, use.astype(float)) - use
    link_tags = _sums(page, (link & use).astype(float)) - (link & use)
    body = next((i for i, t in enumerate(page.tags) if t == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density = np.zeros(n)
    for i in np.flatnonzero(use & (chars > 0)).tolist():
        c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
        base = math.log(c / max(c - link_chars[i], 1) * lc + share * c + math.e)  # lc is at least 1, so that base is above 1 without links too
        density[i] = max(c / t * math.log(max(c / lc * t / lt, 1)) / math.log(base), 1e-9)
    total = np.zeros(n)
    np.add.at(total, np.array(page.parents[1:], np.int64), density[1:])
    return density, np.maximum(total, density * (total == 0)), body


def _chosen(page: Page, density: np.ndarray, total: np.ndarray, body: int) -> np.ndarray:
    """Nodes that are article text, by the largest density sum and the threshold on its path to the body."""
    n = len(page.tags)
    below_best = np.arange(n)
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if total[below_best[i]] > total[below_best[p]]:
            below_best[p] = below_best[i]
    best = int(below_best[body])
    threshold, at = density[best], best
    while at != body and at:
        at = page.parents[at]
        threshold = min(threshold, density[at])
    content = np.zeros(n, bool)
    content[best] = True
    for i in range(n):
        if density[i] >= threshold > 0:
            content[below_best[i]] = True
    at = best
    while at:
        content[at] |= page.tags[at] == "article"
        at = page.parents[at]
    holds, layout = content.copy(), np.array([t in LAYOUT for t in page.tags])
    for i in range(n - 1, 0, -1):
        holds[page.parents[i]] |= holds[i]
        layout[page.parents[i]] |= layout[i]
    kinds = [(p, t, m[0].lower() if (m := _CLASS.search(a)) else "") for p, t, a in zip(page.parents, page.tags, page.attributes)]
    parts = {k for i, k in enumerate(kinds) if holds[i] and (k[2] or k[1] == "section")}  # an article's parts look alike
    whole = content.copy()  # with all below
    for i in range(1, n):
        p, tag = page.parents[i], page.tags[i]
        box = (tag in BOXES or "-" in tag or tag in CELLS and layout[i]) and kinds[i] not in parts
        whole[i] |= whole[p] or holds[p] and not holds[i] and not box
    return whole | holds


def main_text(source: str | None) -> str:
    """The article of a page: blocks with single spaces inside, joined by two line ends; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    n = len(page.tags)
    own, article = np.zeros(n), np.array([t in ("article", "main") for t in page.tags])
    for kind, node, text in page.events:
        if kind == 1:
            own[node] += len(text.strip())
    for i in range(n - 1, 0, -1):
        article[page.parents[i]] |= article[i]
    comments = np.array(["comment" in a.lower() for a in page.attributes])
    unwanted = _unwanted(page, own, article & ~comments)
    density, total, body = densities(page, ~unwanted)
    keep = _chosen(page, density, total, body) & ~unwanted
    blocks: list[str] = []
    pending: list[str] = []

    def flush():
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            blocks.append(text)

    for kind, node, text in page.events:
        if kind == 1:
            if keep[node]:
                pending.append(text)
        elif page.tags[node] in BLOCKS:
            flush()
        elif page.tags[node] in ("br", "td", "th", "img", "wbr"):
            pending.append("" if page.tags[node] == "wbr" else " ")
    flush()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row: the main text of the whole html.

    A null or empty page, or one without text, gives an empty text. Repeated rows come back as often as they came; extra
    columns are left out.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


