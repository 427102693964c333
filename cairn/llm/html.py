"""Main-text extraction: gradient-boosted trees over DOM-node features with hierarchical decoding.

A page is read into a tree of elements and text runs. Each element has features of its subtree (text and link density, tags inside),
its attribute tokens, depth and siblings; boosted trees give the log-odds that it is main content. Decoding is a dynamic programme from
the leaves up: a kept element keeps or drops each child, a dropped one drops its whole subtree, so no element is kept inside a dropped one.
The trees learn from pages whose markup names its parts (article, nav, footer, ...), also with these names turned into attribute tokens,
removed, or removed with all attributes, so that they don't rest on names alone. Where no page of the sample names its main part, blocks
of running text (many words, few of them links) stand for it.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the trees are fitted on, at most about: a bounded sample drawn by hash of the id.
FIT_PAGES = 400
ROUNDS, DEPTH, RATE = 40, 3, 0.3
#: Words of its own that make a block running text.
RUNNING_WORDS = 12
#: Share of the parent's log-odds that counts for a child.
AGREE = 0.5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that a start tag of the same group ends when they are open inside the same block.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block starts also end an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
MAIN = frozenset(("article", "main"))
FURNITURE = frozenset(("nav", "footer", "header", "aside", "form", "menu"))
GOOD = ("article", "content", "post", "entry", "story", "main", "body", "text")
BAD = ("nav", "menu", "footer", "header", "aside", "sidebar", "ad", "ads", "advert", "banner", "cookie", "notice", "promo", "share", "social", "comment", "comments", "related", "form", "subscribe", "breadcrumb", "widget")
_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", regex.S)
_ATTR = regex.compile(r"(?i)\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = regex.compile(r"[a-z]+")
_SPACE = regex.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "depth", "n", "links", "tags", "stops", "blocks", "place", "siblings", "same", "sibling_text", "in_main", "in_furniture")

    def __init__(self, tag: str, attrs: str, parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """The element tree of a page; unclosed, stray and misnested tags are taken as browsers mostly do, and raw elements hold no text."""
    root = at = Node("#root", "", None)
    pos, end = 0, len(page)
    opened: Counter = Counter()  # names of the elements that are open
    while pos < end:
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text:
            at.items.append(text)
        if not m:
            break
        pos = m.end()
        close, tag, attrs = m.group(1, 2, 3)
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if opened[tag]:
                while at.tag != tag:
                    opened[at.tag] -= 1
                    at = at.parent
                opened[tag] -= 1
                at = at.parent
            continue
        if tag in BLOCKS or tag in CLOSES:
            ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in BLOCKS else set())
            node = at
            while node.parent and (node.tag in INLINE or node.tag in ends):
                if node.tag in ends:
                    while at is not node.parent:
                        opened[at.tag] -= 1
                        at = at.parent
                node = node.parent
        node = Node(tag, attrs, at)
        at.items.append(node)
        if tag in RAW:
            stop = regex.compile(rf"</{regex.escape(tag)}\s*[^>]*(?:>|\Z)", regex.I).search(page, pos)
            pos = stop.end() if stop else end
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            at = node
            opened[tag] += 1
    return root


def elements(root: Node) -> list[Node]:
    """Elements that can hold blocks, parents first, with the counts of their subtrees set."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    for node in reversed(order):
        node.n = node.links = node.stops = 0
        node.tags = node.blocks = 0
        for x in node.items:
            if isinstance(x, str):
                n = len(x) if not x.isspace() else 0
                node.n += n
                node.stops += x.count(".") + x.count(",") if n else 0
            else:
                node.n, node.stops, node.tags, node.blocks = node.n + x.n, node.stops + x.stops, node.tags + x.tags + 1, node.blocks + x.blocks + (x.tag == "p")
                node.links += x.n if x.tag == "a" else x.links
    root.place, root.siblings, root.same, root.sibling_text, root.in_main, root.in_furniture = 0.0, 1, 1, 0.0, False, False
    for node in order:
        kids = [x for x in node.items if isinstance(x, Node)]
        if kids:
            of_tag, mean = Counter(k.tag for k in kids), sum(k.n for k in kids) / len(kids)
            main, furniture = node.in_main or node.tag in MAIN, node.in_furniture or node.tag in FURNITURE
            for i, k in enumerate(kids):
                k.place, k.siblings, k.same, k.sibling_text, k.in_main, k.in_furniture = i / len(kids), len(kids), of_tag[k.tag], mean / (k.n + 1), main, furniture
    return [n for n in order if n.tag not in INLINE]


def describe(nodes: list[Node]) -> np.ndarray:
    """The feature matrix of a page's elements."""
    whole, rows = max(1, nodes[0].n), []
    for x in nodes:
        words = set(_WORD.findall(" ".join("".join(m[1:]) for m in _ATTR.findall(x.attrs)).lower())) if x.attrs else ()
        tag = x.tag
        rows.append((
            x.n, x.n / whole, x.links / max(1, x.n), x.n / (1 + x.tags), x.stops / (1 + x.n / 50), x.blocks, x.depth, x.siblings, x.same, x.place, x.sibling_text,
            tag in MAIN, tag in FURNITURE, tag in RAW or tag in ("head", "button", "select", "input"), tag == "p", tag in ("ul", "ol", "li"), tag[0] == "h" and tag[1:].isdigit(),
            bool(words) and any(w in words for w in GOOD), bool(words) and any(w in words for w in BAD), x.in_main, x.in_furniture,
        ))
    out = np.array(rows, dtype=float)
    out[:, 0], out[:, 5] = np.log1p(out[:, 0]), np.log1p(out[:, 5])
    return out


NAMES = ["log_chars", "share", "link_density", "text_density", "stop_density", "log_paragraphs", "depth", "siblings", "same_tag", "place", "sibling_text", "is_main", "is_furniture", "is_raw", "is_p", "is_list", "is_heading", "good_token", "bad_token", "in_main", "in_furniture"]


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 for elements in or above named main content, 0 for the rest and for named furniture inside it."""
    good, bad = ("article", "main"), ("nav", "footer", "header", "aside", "form", "menu", "button", "select", "head")
    out = np.zeros(len(nodes))
    state: dict[int, int] = {}
    for i, x in enumerate(nodes):
        words = set(_WORD.findall(x.attrs.lower()))
        up = x.parent
        while up and id(up) not in state:
            up = up.parent
        s = state.get(id(up), 0) if up else 0
        if x.tag in bad or x.tag in RAW or (words & set(BAD) and x.tag not in good):
            s = -1
        elif s == 0 and (x.tag in good or words & {"article", "content", "post", "entry"}):
            s = 1
        state[id(x)] = s
        out[i] = s == 1
    index = {id(x): i for i, x in enumerate(nodes)}
    for i in np.flatnonzero(out):
        up = nodes[i].parent
        while up:
            if id(up) in index:
                out[index[id(up)]] = 1
            up = up.parent
    return out


def content_labels(nodes: list[Node]) -> np.ndarray:
    """1 for blocks of running text outside named furniture, and for the elements above them: labels for pages that name no main part."""
    out = np.zeros(len(nodes))
    index = {id(x): i for i, x in enumerate(nodes)}
    for i, x in enumerate(nodes):
        own = [y for y in x.items if isinstance(y, str)] + [y for k in x.items if isinstance(k, Node) and k.tag in INLINE and k.tag != "a" for y in k.items if isinstance(y, str)]
        if x.tag in RAW or x.in_furniture or x.tag in FURNITURE or set(_WORD.findall(x.attrs.lower())) & set(BAD) or len(" ".join(own).split()) < RUNNING_WORDS:
            continue
        up: Node | None = x
        while up:
            if id(up) in index:
                out[index[id(up)]] = 1
            up = up.parent
    return out


class Boosted:
    """Binary gradient boosting of shallow trees on log-loss, with histogram splits."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> None:
        self.rounds, self.depth, self.rate, self.trees, self.base = rounds, depth, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree: list = []
            f += self._grow(tree, bins, y - q, q * (1 - q), np.arange(len(y)), self.depth, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, bins, g, h, rows, depth, add) -> np.ndarray:
        at = len(tree)
        tree.append(None)
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum() + 1.0
        if depth:
            for j, e in enumerate(self.edges):
                if not len(e):
                    continue
                b = bins[rows, j]
                gs, hs = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1] + 1.0
                gain = gs**2 / hs + (total_g - gs) ** 2 / (total_h - hs + 1.0) - total_g**2 / total_h
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            value = self.rate * total_g / total_h
            tree[at] = value
            add[rows] += value
            return add
        _, j, k = best
        left = bins[rows, j] <= k
        here = at
        self._grow(tree, bins, g, h, rows[left], depth - 1, add)
        right = len(tree)
        self._grow(tree, bins, g, h, rows[~left], depth - 1, add)
        tree[here] = (j, float(self.edges[j][k]), right)
        return add

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                if not len(rows):
                    continue
                if isinstance(tree[at], float):
                    f[rows] += tree[at]
                else:
                    j, edge, right = tree[at]
                    left = x[rows, j] <= edge
                    stack += [(at + 1, rows[left]), (right, rows[~left])]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """ids of the kept elements: the labelling of highest total log-odds, weighted by own text, in which kept elements have kept parents."""
    index = {id(x): i for i, x in enumerate(nodes)}
    parents = np.full(len(nodes), -1)
    for i in range(1, len(nodes)):
        up = nodes[i].parent
        while id(up) not in index:
            up = up.parent
        parents[i] = index[id(up)]
    # a child leans towards the label of its parent
    leaning = odds + AGREE * np.where(parents >= 0, odds[parents], 0)
    # an element around nothing but one other has no say: chains of wrappers may be long
    weight = [own_text(x) + 0.05 * (sum(isinstance(y, Node) for y in x.items) != 1) for x in nodes]
    best = leaning * np.array(weight)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0 and parents[i] >= 0:
            best[parents[i]] += best[i]
    kept = {id(nodes[0])} if best[0] > 0 else set()
    for i in range(1, len(nodes)):
        if best[i] > 0 and parents[i] >= 0 and id(nodes[parents[i]]) in kept:
            kept.add(id(nodes[i]))
    return kept


def own_text(x: Node) -> float:
    """Characters of an element outside its inner blocks, on a log scale."""
    n, stack = 0, list(x.items)
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            n += len(y) if not y.isspace() else 0
        elif y.tag in INLINE:
            stack += y.items
    return float(np.log1p(n))


def render(node: Node, kept: set[int]) -> str:
    """Blocks of the kept elements in page order, one line each; references are decoded and white space becomes one space."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    stack: list = [(node, None)]
    while stack:
        x, _ = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in INLINE:
            if x.tag == "br":
                run.append(" ")
            stack += [(y, None) for y in reversed(x.items)]
        elif id(x) in kept:
            close()
            stack.append((None, None))
            stack += [(y, None) for y in reversed(x.items)]
        else:
            close()
    close()
    return "\n".join(blocks)


def variants(page: str) -> list[str]:
    """The page, and the same with part names moved into classes or taken away."""
    names = {"article": "post-content", "main": "main-content", "nav": "menu", "footer": "page-footer", "aside": "sidebar", "header": "page-header"}
    classed = regex.sub(r"<(/?)(article|main|nav|footer|aside|header)\b([^>]*)>", lambda m: f"</div>" if m[1] else f'<div class="{names[m[2]]}">', page)
    bare = regex.sub(r"<(/?)(article|main)\b[^>]*>", lambda m: f"<{m[1]}div>", page)
    hidden = regex.sub(r"<(/?)(article|main|nav|footer|aside|header)\b[^>]*>", lambda m: f"<{m[1]}div>", page)
    return [page, classed, bare, _ATTR.sub("", hidden)]


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Boosted | None:
    """Boosted trees from a bounded sample of the pages; None without one."""
    pages = pages.where(F.length("html") > 0)
    n = pages.count()
    drawn = pages.where(F.pmod(F.xxhash64(F.lit("fit"), "page_id", "html"), F.lit(1_000_000)) < min(1.0, fit_pages / max(1, n)) * 1_000_000).select("html").limit(4 * fit_pages)
    sample = [r.html for r in drawn.collect()]
    xs, ys = [], []
    # pages that name no main part say nothing about names; only where no page does, their text has to
    for label in (weak_labels, content_labels):
        for html in sample:
            own = None
            for page in variants(html):
                nodes = elements(parse(page))
                x, y = describe(nodes), label(nodes)
                if own is None:
                    own = y
                    if not own.any():
                        break
                elif len(y) == len(own):
                    y = own
                xs.append(x), ys.append(y)
        if xs:
            break
    if not xs:
        return None
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract(page: str | None, model: Boosted | None) -> str:
    """The main text of one page; empty for null, blank and text-free pages."""
    if not page or model is None:
        return ""
    root = parse(page)
    nodes = elements(root)
    return render(root, decode(nodes, model.log_odds(describe(nodes))))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; repeated rows are kept, an empty table gives no rows."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                roots = [parse(p) if p else None for p in part.column(2).to_pylist()]
                nodes = [elements(r) if r else [] for r in roots]
                odds = np.split(model.log_odds(np.concatenate([describe(n) for n in nodes if n])), np.cumsum([len(n) for n in nodes if n])[:-1]) if model and any(nodes) else []
                found = iter(odds)
                texts = [render(r, decode(n, next(found))) if n and model else "" for r, n in zip(roots, nodes, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
