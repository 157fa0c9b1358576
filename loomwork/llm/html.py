"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier reads each block's text and tags and the marks (tags, and words
in class, id and role) of the containers around it, and gives it a cost for being called content and one for being called
boilerplate: these are the capacities of its edges to the two terminals. All neighbouring blocks are joined by edges whose
capacity falls with the number of containers that lie between them in the DOM. The maximum flow finds the cheapest cut, and
the blocks on the source's side are the article: a mark on one paragraph doesn't take it out of the article that it stands
in, nor does a good sentence bring a menu into it.

Parsing and features take time in proportion to the page, however deep it is nested.

Defined results: null, empty and text-free HTML give an empty text. Cut-off pages are read as far as they go; an
unfinished tag or comment at the end is dropped. Repeated rows give equal texts. Columns named like an output are
replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, ddl, drop_clashing, table

#: Bound of the sample of pages that the classifier is fitted on.
TRAIN_PAGES = 400

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math head title iframe object canvas audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the second kind, unless one of the third kind stands between.
CLOSES = {
    **dict.fromkeys(BLOCK - {"button", "option", "select", "textarea", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}, ({"p"}, {"button", "table", "td", "th", "caption"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BAD_TAGS = frozenset("nav footer aside form menu dialog button select option textarea search".split())
GOOD_TAGS = frozenset("article main".split())
#: Words in class, id and role that mark boilerplate and content.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion promotions banner banners "
    "nav navbar navigation menu menus topbar toolbar breadcrumb breadcrumbs pagination pager header masthead footer foot sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup signin login paywall "
    "share sharing social comment comments commentlist disqus reply replies respond discussion related recommended recommendations trending search form copyright legal "
    "disclaimer skip contentinfo complementary hidden".split()
)
GOOD_WORDS = frozenset("article articlebody content contents post entry story main maincontent body text prose".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ENDS = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template")}


@dataclass
class Node:
    tag: str
    parent: "Node | None"
    depth: int
    bad: int = 0  # 2: marked by its tag or attribute, 1: by a header or an element that can also wrap a page
    good: bool = False
    unseen: bool = False
    chars: int = 0
    holds_good: bool = False
    owner: "Node | None" = None  # the block that text in this element belongs to
    # of this element and those around it
    marks: int = 0
    halves: int = 0
    header: bool = False
    favours: bool = False
    in_good: bool = False


@dataclass
class Block:
    node: Node
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _marked(node: Node, attrs: str) -> None:
    tag = node.tag
    node.good = tag in GOOD_TAGS
    node.bad = 1 if tag in ("header", "form") else 2 if tag in BAD_TAGS else 0
    node.unseen = tag in UNSEEN
    if not attrs or tag in ("html", "body"):
        return
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.unseen = True
        elif name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if words[:1] in (["has"], ["with"], ["no"], ["without"]):
                    continue
                if not BAD_WORDS.isdisjoint(words):
                    node.bad = 2
                elif not GOOD_WORDS.isdisjoint(words):
                    node.good = True


class _Stack:
    """The open elements, and where those of each tag stand."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.links = [root], {}, 0

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.links += node.tag == "a"

    def leave(self, k: int) -> None:
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            self.links -= tag == "a"

    def last(self, tags) -> int:
        """The innermost open element of some tags, 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


#: Elements that an inline end tag doesn't close.
WALLS = ("td", "th", "li", "div", "section", "article")


def blocks_of(page: str) -> list[Block]:
    """The visible blocks of text of a page in order; white space in each is one space, character references decoded."""
    root = Node("#root", None, 0)
    root.owner = root
    at, stack, blocks, current, nodes = 0, _Stack(root), [], None, [root]

    def say(raw: str) -> None:
        nonlocal current
        if not raw or stack.nodes[-1].unseen:
            return
        text = entities.unescape(raw)
        if current is None:
            if text.isspace():
                return
            current = Block(stack.nodes[-1].owner)
            blocks.append(current)
        current.parts.append(text)
        if stack.links:
            current.linked += len(text)

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        slash, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if m[5] and at == size and page[-1] != ">":
            break  # a tag that the page's end cuts off
        if slash:
            k = stack.last((name,))
            if name in BLOCK:
                current = None
            if k and (name in BLOCK or stack.last(WALLS) <= k):
                stack.leave(k)
            continue
        if name in BLOCK or name == "body":
            current = None
        if name in CLOSES:
            ends, stops = CLOSES[name]
            k = stack.last(ends)
            if k > stack.last(stops):
                stack.leave(k)
        if name == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if name in VOID:
            continue
        top = stack.nodes[-1]
        if name == "body" and top.tag == "head":
            stack.leave(len(stack.nodes) - 1)
            top = stack.nodes[-1]
        node = Node(name, top, top.depth + 1)
        node.owner = node if name in BLOCK else top.owner
        _marked(node, attrs)
        node.unseen = node.unseen or top.unseen
        if attrs.endswith("/") and name not in BLOCK:
            continue
        if name in _RAW and name != "noscript":
            end = _RAW[name].search(page, at)
            at = end.end() if end else size
            continue
        stack.push(node)
        nodes.append(node)

    kept = []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
            b.node.chars += len(b.text)
    for n in reversed(nodes):  # inner elements first
        up = n.parent
        if up is not None and n.chars:
            up.chars += n.chars
            up.holds_good = up.holds_good or n.holds_good or n.tag in GOOD_TAGS
    for n in nodes:  # outer elements first
        _inherit(n, root.chars or 1)
    return kept


def _inherit(n: Node, total: int) -> None:
    """Marks, content-like classes and articles of an element and those around it. What wraps most of a page isn't marked."""
    up = n.parent
    if up is not None:
        n.marks, n.halves, n.header, n.favours, n.in_good = up.marks, up.halves, up.header, up.favours, up.in_good
    wraps = n.holds_good or n.chars >= 0.7 * total and n.tag not in BAD_TAGS | {"footer"}
    if n.bad == 2 and not (wraps and n.tag not in ("nav", "footer", "aside")):
        n.marks += 1
    elif n.bad == 1 and not wraps:
        if n.tag == "header" and n.in_good:
            n.header = True  # of an article: its headings are content
        else:
            n.halves += 1
    n.favours = n.favours or n.good and n.tag not in GOOD_TAGS
    n.in_good = n.in_good or n.tag in GOOD_TAGS


#: What the classifier reads of a block, and the weights that it starts from (log odds of content). Those of marks aren't
#: fitted, as marks name the blocks that the others are fitted on.
FEATURES = ("one", "log of words", "linked share", "ends as a sentence", "heading", "paragraph", "list item", "in article or main", "content-like class", "marked container", "header or form")
PRIOR = np.array([-0.4, 0.45, -4.0, 0.7, 0.6, 0.7, -0.4, 2.6, 1.5, -7.0, -6.5])
#: Weights that are fitted: the first so many.
FITTED = 7
#: Smoothness of two blocks of the same container; it is divided by the containers between them and one.
SMOOTH = 1.6


def features(b: Block) -> list[float]:
    n, tag = b.node, b.node.tag
    words = b.text.count(" ") + 1
    halves = n.halves + (n.header and tag not in ("h1", "h2"))
    return [
        1.0, math.log1p(words), b.linked / len(b.text), float(bool(_ENDS.search(b.text))), float(len(tag) == 2 and tag[0] == "h" and tag != "hr"), float(tag in ("p", "blockquote", "pre")), float(tag in ("li", "dt", "dd")),
        float(n.in_good), float(n.favours and not n.marks and not halves), float(min(n.marks, 2)), float(min(halves, 2)),
    ]


def costs_of(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[int]:
    """Thousandths of the log odds of content of each block."""
    return np.round(1000 * np.array([features(b) for b in blocks]) @ weights).astype(np.int64).tolist()


def _between(a: Node, b: Node) -> int:
    """Containers that one leaves and enters on the way from one block's element to the other's, 0 for siblings."""
    steps = 0
    while a is not b:
        steps += 1
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return max(0, steps - 2)


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut (of those cuts, the one with the fewest such nodes).

    A positive cost is the capacity from the source, a negative one that to the sink; edges are (node, node, capacity)
    both ways. Dinic's algorithm: level graphs by breadth-first search, blocking flows by depth-first search.
    """
    n = len(costs)
    source, sink = n, n + 1
    to, cap, at = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: int, back: int) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(there)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            edge(source, i, c, 0)
        elif c < 0:
            edge(i, sink, -c, 0)
    for a, b, c in edges:
        if c > 0:
            edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            v = queue.popleft()
            for e in at[v]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        spot = [0] * (n + 2)
        path, v = [], source
        while True:
            if v == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not cap[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            edges_here = at[v]
            while spot[v] < len(edges_here):
                e = edges_here[spot[v]]
                if cap[e] and level[to[e]] == level[v] + 1:
                    break
                spot[v] += 1
            if spot[v] < len(edges_here):
                path.append(edges_here[spot[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]
    seen = [False] * (n + 2)
    seen[source] = True
    queue = deque([source])
    while queue:
        for e in at[queue.popleft()]:
            if cap[e] and not seen[to[e]]:
                seen[to[e]] = True
                queue.append(to[e])
    return seen[:n]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours, and between siblings one apart."""
    out = []
    for i in range(len(blocks) - 1):
        out.append((i, i + 1, round(1000 * SMOOTH / (1 + _between(blocks[i].node, blocks[i + 1].node)))))
        if i + 2 < len(blocks) and blocks[i].node.parent is blocks[i + 2].node.parent:
            out.append((i, i + 2, round(500 * SMOOTH)))
    return out


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    side = min_cut(costs_of(blocks, weights), edges_of(blocks))
    return "\n".join(b.text for b, content in zip(blocks, side, strict=True) if content)


def fit(pages: DataFrame, html: str = "html", key: str = "page_id") -> np.ndarray:
    """Weights from at most TRAIN_PAGES pages chosen by a hash of the key. Blocks in boilerplate containers are learned
    as boilerplate, others inside ``article`` or ``main`` as content; the rest are left out. Weights stay near PRIOR
    unless the sample says otherwise, and keep its values where there is nothing to learn from."""
    rows = bounded_sample(pages.where(F.col(html).isNotNull()).select(html), TRAIN_PAGES)
    x, y = [], []
    for r in rows:
        for f in map(features, blocks_of(r[html])):
            bad, article = f[9] or f[10], f[7]
            if bad or article:
                x.append(f[:FITTED])
                y.append(0.0 if bad else 1.0)
    weights = PRIOR.copy()
    if not x or min(y) == max(y):
        return weights
    a, t, start = np.array(x), np.array(y), PRIOR[:FITTED]
    w = start.copy()
    stay = 0.2 * len(a)  # the prior counts like this many rows
    for _ in range(20):  # Newton's steps
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + stay * np.eye(len(w)), a.T @ (p - t) + stay * (w - start))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights[:FITTED] = np.round(w, 6)
    return weights


def extract(pages: DataFrame, weights: np.ndarray = PRIOR, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` of each whole page. Rows are handled one by one in Arrow batches."""
    names = ["text", "n_chars"]
    pages = drop_clashing(pages, [n for n in names if n != html])

    def run(batches):
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(html))
            texts = [main_text(source[i].as_py(), weights) for i in range(batch.num_rows)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return pages.mapInArrow(run, f"{ddl(pages)}, text string, n_chars bigint")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
