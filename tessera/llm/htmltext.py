"""Main text of web pages by composite text density.

A page is parsed into the tree of its elements.  Elements that hold no text of an
article whatever stands in them (menus, footers, scripts) are left out.  Every node
then has its characters C, link characters LC, tags T and link tags LT, and the
composite density of Sun et al. (2011)

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LCb / Cb * C + e),

where b marks the body and a zero divisor reads as 1.  The node whose children's
densities have the greatest sum is the core.  The least density on the path from
the core to the body is the threshold: nodes beside that path are taken with the
core if they reach it.  The body is the page, or its ``article`` or ``main`` element
if that has half of the text; there the threshold only drops what consists of links
for the most part, as an article's short paragraphs are part of it.  The same goes
for nodes below the core.

Names (class, id) and forms mark what is a comment, an advert or a notice.  A mark
drops a node, but not one that holds the article: see ``_unmark``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html import unescape
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")

#: HTML's element classes. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
#: A start tag closes open elements of these kinds, up to one of the next set. Fixed values.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "caption"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "caption"}, {"table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPES = frozenset("table td th caption button object body html".split())

#: Elements, roles and words of class or id that hold no article text.
NO_TEXT = frozenset(
    "nav footer aside script style noscript iframe template button select textarea input svg canvas dialog menu "
    "object embed audio video map head title noembed noframes xmp optgroup option datalist search".split()
)
NO_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar status".split())
#: Names of what is no article even where most of the page stands in it, and names that a wrapper may have, too.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
NO_NAME = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs captcha consent cookie cookies "
    "footer gdpr login masthead menu nav navbar navigation pagination pager sidebar toolbar".split()
)
WEAK_NAME = frozenset(
    "banner byline copyright disclaimer donate header modal newsletter notice notices notification overlay popup promo "
    "promotion recommended related rss share sharing signup skip social sponsor sponsored subscribe subscription "
    "tags toc widget widgets".split()
)
#: A name that begins so tells what stands elsewhere, or doesn't.
ABOUT = frozenset("no not non has have with without is hide show".split())
#: How many times the rest of the page a node of a weak name must have to be the article.
MOST = 3


class Node:
    """An element: its texts and child nodes in page order, and counts over its whole subtree."""

    __slots__ = ("tag", "parent", "block", "mark", "items", "chars", "link_chars", "tags", "links", "density", "sum")

    def __init__(self, tag: str, parent: "Node | None", block: bool = True, mark: str = ""):
        self.tag, self.parent, self.block, self.mark = tag, parent, block, mark
        self.items: list = []
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.sum = 0.0

    def nodes(self) -> list["Node"]:
        return [x for x in self.items if isinstance(x, Node)]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element is left out for good, and its mark: strong, weak or none."""
    if tag in NO_TEXT or tag == "header" and not in_article:
        return True, ""
    mark = "strong" if tag == "form" else ""
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False, mark
    a = _attributes(attributes)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in NO_ROLE:
        return True, ""
    if "none" in a.get("style", "") and re.search(r"display\s*:\s*none", a["style"]):
        return True, ""
    names: set[str] = set()
    for token in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        words = _WORDS.findall(token)
        if words and words[0] not in ABOUT:
            names.update(words)
    if names & (COMMENTS if tag == "article" else NO_NAME) or a.get("role", "").lower() == "form":
        return False, "strong"
    return False, mark or ("weak" if tag != "article" and names & WEAK_NAME else "")


class _Parser:
    """The open elements while a page is read, with the latest place of each kind among them."""

    def __init__(self):
        self.root = self.at = Node("html", None)
        self.stack: list[tuple[Node, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.out = self.links = self.articles = 0

    def latest(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def text(self, piece: str) -> None:
        if piece and not self.out:
            if "&" in piece:
                piece = unescape(piece)
            self.at.items.append(piece)
            size = len("".join(piece.split()))
            self.at.chars += size
            if self.links:
                self.at.link_chars += size

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            node, left = self.stack.pop()
            self.places[node.tag].pop()
            if node.block:
                self.blocks.pop()
            self.out -= left
            self.links -= node.tag == "a"
            self.articles -= node.tag in ("article", "main")
            self.at = node.parent

    def end(self, tag: str) -> None:
        """An end tag closes the latest element of its kind; an inline one doesn't reach out of its block."""
        place = self.latest((tag,))
        if place >= 0 and (tag in BLOCKS or place > (self.blocks[-1] if self.blocks else -1)):
            self.close(place)
        if tag in BLOCKS and not self.out and self.at.items and isinstance(self.at.items[-1], str):
            self.at.items.append(None)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS and tag not in ("option", "optgroup", "head", "html", "body"):
            # A paragraph ends where a block begins.
            if self.blocks and self.stack[self.blocks[-1]][0].tag == "p" and self.latest(SCOPES) < self.blocks[-1]:
                self.close(self.blocks[-1])
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            while (place := self.latest(shut)) > self.latest(stop):
                self.close(place)
                if tag in ("li", "dt", "dd", "option"):
                    break
        if not self.out:
            self.at.tags += 1
        if tag in VOID:
            if not self.out and tag in ("br", "hr", "img", "wbr"):
                self.at.items.append(None if tag == "hr" else "" if tag == "wbr" else " ")
            return
        left, mark = _judge(tag, attributes, self.articles > 0)
        if tag == "a" and not self.out:
            self.at.links += 1
        node = Node(tag, self.at, tag in BLOCKS, mark)
        if not left and not self.out:
            self.at.items.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        if node.block:
            self.blocks.append(len(self.stack))
        self.stack.append((node, left))
        self.at = node
        self.out += left
        self.links += tag == "a"
        self.articles += tag in ("article", "main")


def parse(html: str) -> Node:
    """The tree of a page's elements, without those that hold no article text; work grows with the page's length."""
    parser, pos, n = _Parser(), 0, len(html)
    while pos < n:
        m = _TAG.search(html, pos)
        if m is None:
            parser.text(html[pos:])
            break
        parser.text(html[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, attributes, ends = name.lower(), (m[3] if m[2] else m[6]) or "", bool(m[1] or m[4])
        if ends:
            parser.end(tag)
        elif tag in RAW:
            parser.at.tags += not parser.out
            end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(html, pos)
            pos = end.end() if end else n
        else:
            parser.start(tag, attributes)
    return parser.root


def _order(top: Node) -> list[Node]:
    """The nodes of a tree, from the leaves up."""
    order, todo = [], [top]
    while todo:
        b = todo.pop()
        order.append(b)
        todo += b.nodes()
    return order[::-1]


def _measure(root: Node) -> list[Node]:
    """Fill in subtree counts; the nodes from the leaves up."""
    order = _order(root)
    for b in order:
        for c in b.nodes():
            b.chars += c.chars
            b.link_chars += c.link_chars
            b.tags += c.tags
            b.links += c.links
    return order


def _unmark(root: Node) -> None:
    """Takes the marked nodes out of the tree, but for those that hold the article.

    A marked node holds it if an ``article`` or ``main`` is in it and none outside of
    marked nodes; if there is no text outside; or, with a weak name, if it has
    ``MOST`` times the text outside.  Nodes in one that stays are judged anew.  Counts
    are still those of each node alone.
    """
    whole: dict[int, int] = {}
    named: dict[int, bool] = {}
    for b in _order(root):
        whole[id(b)] = b.chars + sum(whole[id(c)] for c in b.nodes())
        named[id(b)] = b.mark != "strong" and (b.tag in ("article", "main") or any(named[id(c)] for c in b.nodes()))

    def tops(node: Node) -> list[Node]:
        found, todo = [], node.nodes()
        while todo:
            b = todo.pop()
            if b.mark:
                found.append(b)
            else:
                todo += b.nodes()
        return found

    def inner(b: Node) -> bool:
        return any(named[id(c)] for c in b.nodes())

    marked = tops(root)
    if not marked:
        return
    rest = whole[id(root)] - sum(whole[id(b)] for b in marked)
    outside, todo = False, root.nodes()
    while todo and not outside:
        b = todo.pop()
        if not b.mark:
            outside = b.tag in ("article", "main")
            todo += b.nodes()
    # Those that hold an article first, then the longest.
    entry = lambda i, b: (not inner(b), -whole[id(b)], i, b)
    heap = [entry(i, b) for i, b in enumerate(marked)]
    heapify(heap)
    seen, dropped = len(heap), set()
    while heap:
        b = heappop(heap)[-1]
        n = whole[id(b)]
        if outside or not (inner(b) or n and not rest or b.mark == "weak" and n > MOST * rest):
            dropped.add(id(b))
            continue
        within = tops(b)
        outside = inner(b) and not any(inner(c) for c in within)
        rest += n - sum(whole[id(c)] for c in within)
        for c in within:
            seen += 1
            heappush(heap, entry(seen, c))
    todo = [root]
    while todo:
        b = todo.pop()
        b.items = [x for x in b.items if id(x) not in dropped]
        todo += b.nodes()


def density(b: Node, body: Node) -> float:
    """The composite text density of ``b``."""
    c, lc, t, lt = b.chars, b.link_chars, max(1, b.tags), max(1, b.links)
    if not c:
        return 0.0
    base = log(c / max(1, c - lc) * lc + body.link_chars / max(1, body.chars) * c + e)
    inside = c / max(1, lc) * t / lt
    return c / t * log(max(inside, 1.0 + 1e-9)) / log(base) if base > 1.0 + 1e-9 else c / t * log(max(inside, 1.0))


def choose(root: Node) -> tuple[Node, Node, float]:
    """The body, the core and the threshold of a tree whose counts are filled in."""
    order = _order(root)
    best = max((b for b in order if b.tag in ("article", "main")), key=lambda b: b.chars, default=None)
    body = best if best is not None and 2 * best.chars >= root.chars else root
    order = _order(body)
    for b in order:
        b.density = density(b, root)
    core, most = body, -1.0
    for b in order:
        b.sum = sum(c.density for c in b.nodes())
        if b.sum > most and b.nodes():
            core, most = b, b.sum
    while core is not body and not core.block:
        core = core.parent
    least, b = core.density, core
    while b is not body:
        b = b.parent
        least = min(least, b.density)
    return body, core, least


def main_blocks(root: Node) -> list[str]:
    """Texts of the chosen blocks, in page order."""
    _unmark(root)
    _measure(root)
    if not root.chars:
        return []
    body, core, threshold = choose(root)
    path, b = {id(core), id(body)}, core
    while b is not body:
        b = b.parent
        path.add(id(b))
    # Within an article element all is taken that isn't links; elsewhere what is as dense as the path.
    article = body is not root
    texts: list[str] = []
    run: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(run).split())
        run.clear()
        if joined:
            texts.append(joined)

    todo: list = [(body, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x.block:
                flush()
            inside = inside or x is core
            if id(x) not in path:
                linked = x.links >= 2 and 2 * x.link_chars > x.chars
                if x.density < threshold and x.block and (linked or not inside and not article):
                    continue
                inside = True
            if x.block:
                todo.append((None, inside))
            for item in reversed(x.items):
                if isinstance(item, Node) or inside or article or item is None:
                    todo.append((item, inside))
    flush()
    return texts


def extract(html: str | None) -> str:
    """The page's main text: blocks parted by an empty line; empty if there is none."""
    return "\n\n".join(main_blocks(parse(html))) if html else ""


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    The whole page is read.  A null or empty page, and one without an article,
    has an empty text; broken markup is read as browsers do, as far as blocks
    go.  Character references are decoded, white space inside a block is one
    space.  ``n_chars`` counts code points.  Other columns are ignored; a repeated
    page gives a row each time.
    """
    import pyarrow as pa

    prepare(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x).encode("utf-8", "replace").decode() for x in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
