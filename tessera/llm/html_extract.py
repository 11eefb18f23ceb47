"""Main text of web pages by composite text density.

A page is parsed into a tree of elements in linear time. Elements that never hold the article are
taken out by their kind or role: scripts, styles, menus, headers, footers, side notes, forms. For
every element left, the composite text density is its characters per tag, adjusted for links:
C/T * ln(1 + C/LC * T/LT) / ln(1 + b) with b = ln(C/(C-LC) * LC + LC_body/C_body * C + e), where C
and T count characters and tags, LC and LT those of links, each 1 at least (the ones in both
logarithms keep pages without links defined). The element whose children's densities have the
greatest sum leads to the article: from it the choice climbs towards the body while the parent's
density stays above the threshold, which is the least density on the path to the body, and to an
enclosing ``article`` or ``main`` element. Without one, it goes on to the highest element on that
path, the body included, that has further blocks whose density reaches the threshold: articles laid
out in several sections stay whole. There, blocks below the threshold stay out, but for headings
before a block that stays and paragraphs, lists, tables and the like between two such blocks. Blocks
whose text is mostly links stay out wherever the choice climbed past them.

Names weigh beside density and drop nothing: the text of an element whose class or id says sidebar,
notice, advert, comments and the like counts as links do. Its density falls, it attracts no choice,
and it stays out where it stands below the threshold beside the chosen text. A name speaks only as a whole
(``related-posts``, not ``has-sidebar``), and does not weigh on an element that holds the longest
``article`` or ``main`` of the page, or most of its text where there is none outside of named elements.

Text of each block element is decoded, its white space turned into single blanks, and trimmed;
blocks stand in page order, one a line. ``br`` counts as white space.

Defined cases: null, empty or markup-only pages give an empty text. Unclosed and misplaced tags,
unclosed comments and truncated pages are read like browsers do, roughly. If only forms hold text,
forms count as plain containers. Repeated rows each get their text. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>|[^>]*(?:>|\Z))", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("annotation annotation-xml applet aside audio canvas datalist dialog embed footer head header iframe input map menu nav noembed noframes script search select style svg template textarea title video".split())
#: Left out unless they stand in an article or main element.
OUTSIDE = frozenset(("button", "noscript"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class or id names that mark an element as something else than the article, alone or with one another.
NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus dropdown footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices paywall popup popover promo promos promotion promoted related reply replies respond share sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Words that change nothing about the words beside them.
PLAIN_NAMES = frozenset("area bar block bottom box button buttons container form inner item items left link links list post posts right section slot top unit wrap wrapper".split())
KEPT_NAMES = frozenset(("article", "main", "body", "html"))

#: Blocks that hold other blocks.
HOLDERS = frozenset("address article aside body center div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_SCOPE = frozenset(("table", "ul", "ol", "dl", "div", "article", "section", "body", "select", "blockquote"))
_P_SCOPE = _SCOPE | {"p"}
_SHUT = _P_SCOPE | {t for tags in _CLOSES.values() for t in tags}
#: Closings of inline elements do not reach beyond these.
_BARRIERS = frozenset(("article", "main", "td", "body"))


class Node:
    """An element with its children and texts in page order, and what its subtree counts."""

    __slots__ = ("tag", "parent", "parts", "drop", "named", "inside", "shut", "inner", "article", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, named: bool = False):
        self.tag, self.parent, self.named, self.parts = tag, parent, named, []
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.drop = drop or tag in OUTSIDE and not self.inside
        #: The nearest element, itself included, that another opening may close or that bounds it.
        self.shut = self if parent is None or tag in _SHUT else parent.shut
        #: How many elements of each tag are open in here, as far as inline closings reach.
        self.inner: dict[str, int] = {} if parent is None or tag in _BARRIERS else parent.inner
        self.article = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _dropped(tag: str, rest: str) -> bool:
    if tag in DROPPED:
        return True
    if not rest or tag in ("html", "body"):
        return False
    for name, *values in _NAMED.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" and "=" not in rest.lower().partition("hidden")[2][:2]:
            return True
        if name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _named(tag: str, rest: str) -> bool:
    """Whether a class or the id of an element says that it is something else than the article."""
    if not rest or tag in KEPT_NAMES:
        return False
    for name, *values in _NAMED.findall(rest):
        if name.lower() in ("class", "id"):
            for whole in "".join(values).lower().split():
                words = {w for w in _SPLIT.split(whole) if w and not w.isdigit()}
                if not NAMES.isdisjoint(words) and words <= NAMES | PLAIN_NAMES:
                    return True
    return False


class _Open:
    """The open elements: the innermost one, and how many of each tag there are."""

    def __init__(self):
        self.root = self.here = Node("html", None)
        self.all: dict[str, int] = {}

    def enter(self, node: Node) -> None:
        self.all[node.tag] = self.all.get(node.tag, 0) + 1
        self.here.inner[node.tag] = self.here.inner.get(node.tag, 0) + 1
        self.here = node

    def leave(self, node: Node) -> None:
        """Close all up to and with ``node``; each element is passed once."""
        while True:
            last, self.here = self.here, self.here.parent
            self.all[last.tag] -= 1
            self.here.inner[last.tag] -= 1
            if last is node:
                return

    def nearest(self, tags: tuple[str, ...] | frozenset[str]) -> Node:
        """The nearest open element of some tags, or the root. Of the tags that openings close, few are open at once between two bounds."""
        at = self.here.shut
        while at.parent is not None and at.tag not in tags:
            at = at.parent.shut
        return at

    def close(self, tag: str) -> None:
        """A closing tag; nothing happens if no such element is open within its reach."""
        if (self.all if tag in BLOCK else self.here.inner).get(tag):
            at = self.here
            while at.tag != tag:
                at = at.parent
            self.leave(at)


def parse(page: str) -> Node:
    """The tree of a page; its root is the ``html`` element."""
    now = _Open()
    position, end = 0, len(page)
    while position < end:
        m = _MARKUP.search(page, position)
        if m is None:
            now.here.parts.append(page[position:])
            break
        if m.start() > position:
            now.here.parts.append(page[position : m.start()])
        position = m.end()
        closing, opening = m[1], m[2]
        if opening:
            tag, rest = opening.lower(), m[3]
            if tag == "html":
                continue
            if tag == "body":
                while now.here is not now.root:
                    now.leave(now.here)
            elif tag in BLOCK:
                at = now.nearest(_P_SCOPE)
                if at.tag == "p":
                    now.leave(at)
            for other in _CLOSES.get(tag, ()):
                at = now.nearest(_SCOPE | {other})
                if at.tag == other:
                    now.leave(at)
            node = Node(tag, now.here, _dropped(tag, rest), _named(tag, rest))
            now.here.parts.append(node)
            if tag in VOID or rest.rstrip(">").endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, position)
                position = over.end() if over else end
                continue
            now.enter(node)
        elif closing:
            now.close(closing.lower())
        elif m[0].startswith("<![CDATA["):
            now.here.parts.append(html.escape(m[0][9:].removesuffix("]]>")))
    return now.root


def _walk(root: Node, forms: bool) -> list[Node]:
    """Elements that stay, parents first; their counts filled in."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.drop and (forms or p.tag not in ("form", "fieldset"))]
        stack += [p for p in node.parts if not isinstance(p, str)]
    for node in reversed(order):
        inside = node.tag == "a"
        node.tags = node.link_tags = node.chars = node.link_chars = node.article = 0
        for p in node.parts:
            if isinstance(p, str):
                node.chars += sum(map(len, html.unescape(p).split()))
            else:
                node.chars += p.chars
                node.link_chars += p.link_chars
                node.tags += p.tags + 1
                node.link_tags += p.link_tags + (p.tag == "a")
                node.article = max(node.article, p.article)
        if node.tag in ("article", "main"):
            node.article = max(node.article, node.chars)
        if inside:
            node.link_chars = node.chars
    return order


def _unname(order: list[Node]) -> None:
    """Take the name's weight from elements that hold the article, or most of the text where no article stands apart."""
    within: set[int] = set()
    apart: dict[int, int] = {}  # characters in named elements of a subtree
    outside = 0
    for node in reversed(order):
        apart[id(node)] = sum(p.chars if p.named else apart[id(p)] for p in node.parts if not isinstance(p, str))
    for node in order:
        if node.named or node.parent is not None and id(node.parent) in within:
            within.add(id(node))
        elif node.tag in ("article", "main"):
            outside = max(outside, node.chars - apart[id(node)])
    for node in order:
        node.named = node.named and node.article <= outside and (outside > 0 or 2 * node.chars <= order[0].chars)


def _discount(order: list[Node]) -> None:
    """Count the text of named elements as that of links."""
    under: set[int] = set()
    for node in order:
        if node.named or node.parent is not None and id(node.parent) in under:
            under.add(id(node))
    for node in reversed(order):
        if id(node) in under:
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        elif node.tag != "a":
            kids = [p for p in node.parts if not isinstance(p, str)]
            node.link_chars = sum(p.link_chars for p in kids)
            node.link_tags = sum(p.link_tags + (p.tag == "a") for p in kids)


def _weigh(order: list[Node], body: Node) -> None:
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        c, t = node.chars, max(node.tags, 1)
        if c:
            lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
            base = log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + e)
            node.density = 0.0 if node.link_chars >= c else c / t * log(1 + max(c / lc * t / lt, 1.0)) / log(1 + base)
        node.total = sum(p.density for p in node.parts if not isinstance(p, str))


def _blocks(node: Node, out: list[list[str]], skip: set[int]) -> None:
    """The texts of the blocks of a subtree, in order (without recursion: trees can be deep)."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag in BLOCK:
            out.append([])
        while i < len(node.parts):
            p = node.parts[i]
            i += 1
            if isinstance(p, str):
                out[-1].append(p)
            elif id(p) in skip:
                out.append([])
            elif p.tag == "br":
                out[-1].append(" ")
            else:
                stack += [(node, i), (p, 0)]
                break
        else:
            if node.tag in BLOCK:
                out.append([])


def _path(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _chosen(root: Node, forms: bool) -> tuple[Node, set[int]] | None:
    order = _walk(root, forms)
    if not root.chars:
        return None
    if any(n.named for n in order):
        _unname(order)
        _discount(order)
    body = next((n for n in order if n.tag == "body"), root)
    if body.chars < root.chars:
        body = root
    _weigh(order, body)
    inside = {id(body)}
    best = body
    for node in order:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
            if node.total > best.total:
                best = node
    path = _path(best)
    path = path[: path.index(body) + 1]
    least = min(n.density for n in path)
    top = 0
    while top + 1 < len(path) - 1 and path[top + 1].density > least:
        top += 1
    top = max([top, *(i for i, n in enumerate(path) if n.tag in ("article", "main"))])
    skip = set()
    for child, node in zip(path[:top], path[1 : top + 1], strict=True):
        for p in node.parts:
            if not isinstance(p, str) and p is not child and p.chars and _linked(p) and p.tag in BLOCK:
                skip.add(id(p))
    if not any(n.tag in ("article", "main") for n in path):
        higher = top
        for i in range(top + 1, len(path)):
            if any(_dense(p, least) for p in path[i].parts if p is not path[i - 1]):
                higher = i
        for child, node in zip(path[top:higher], path[top + 1 : higher + 1], strict=True):
            skip.update(_aside(node, child, least))
        top = higher
    inside = {id(n) for n in path}
    skip.update(id(n) for n in order if n.named and n.density < least and id(n) not in inside)
    return path[top], skip


def _linked(p: Node) -> bool:
    return p.link_chars > 0.5 * p.chars


def _dense(p: Node | str, least: float) -> bool:
    return not isinstance(p, str) and p.tag in BLOCK and p.chars > 0 and p.density >= least and not _linked(p)


def _aside(node: Node, child: Node, least: float) -> set[int]:
    """The blocks of ``node`` that do not belong to the text that ``child`` is part of."""
    blocks = [p for p in node.parts if not isinstance(p, str) and p.tag in BLOCK and p.chars]
    stays = [p is child or _dense(p, least) for p in blocks]
    first, last = stays.index(True), len(stays) - 1 - stays[::-1].index(True)
    out, heads = set(), False
    for i in range(len(blocks) - 1, -1, -1):
        p = blocks[i]
        between = first < i < last and p.tag not in HOLDERS and not _linked(p)
        heads = stays[i] or between or heads and p.tag in HEADINGS
        if not heads:
            out.add(id(p))
    return out


def main_text(page: str | None) -> str:
    """The article's text of an HTML page."""
    if not page:
        return ""
    found = _chosen(parse(page), False) or _chosen(parse(page), True)
    if not found:
        return ""
    out: list[list[str]] = [[]]
    _blocks(*[found[0], out, found[1]])
    lines = (" ".join(html.unescape("".join(block)).split()) for block in out)
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            some = batch.slice(i, 512)
            texts = [main_text(page) for page in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
