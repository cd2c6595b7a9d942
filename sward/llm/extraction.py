"""HTML extraction: boosted trees over element features, decoded down the page tree.

The trees learn from a bounded sample of pages, marked by their own markup where it names the article and what
stands around it and by tokens and text density elsewhere, and from the same pages rewritten with other markup, so that they weigh
density, links, tokens, depth and siblings besides tag names. Decoding keeps a subtree, drops
it or looks into it, whichever the elements' scores favour together: an element is never kept under
one that was dropped, nor dropped under one that was kept whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import prepare
from sward.llm.dom import BODY_TAGS, HEADING, MAIN_TAGS, MAIN_TOKENS, SIDE_TOKENS, Node, Page

# Most pages that the trees are grown on.
SAMPLE_PAGES = 300
ROUNDS, DEPTH, BINS, RATE, LEAF_PENALTY = 40, 4, 32, 0.25, 1.0
# Score of looking into an element instead of keeping or dropping it whole.
MIXED = -0.3
# Elements that are blocks of the text around them, and what an element counts of the text that one inside it holds.
BLOCKS, NEAR = BODY_TAGS | HEADING | frozenset("li ul ol dl dt dd table thead tbody tfoot tr td th".split()), 0.7
# Other markup for the same parts, and parts that few pages have: (opening, closing).
MAIN_FORMS = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="story">', "</div>"), ("<div>", "</div>"))
SIDE_FORMS = (
    ("<nav>", "</nav>"), ("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="menu">', "</div>"),
    ('<div class="cookie-notice">', "</div>"), ('<section class="comments">', "</section>"), ("<footer>", "</footer>"),
    ("<header>", "</header>"), ('<div class="related-posts">', "</div>"), ("<form>", "</form>"), ("<div>", "</div>"),
)


def marked(page: Page, main, side) -> np.ndarray:
    """Per node: 1 inside a ``main`` element but not in a ``side`` one, 0 outside, -1 above the main text."""
    mark = np.full(len(page.nodes), -1)
    for i, node in enumerate(page.nodes):
        above = mark[node.parent.order] if node.parent else -1
        mark[i] = 0 if above == 0 or side(node) else 1 if above == 1 or main(node) else -1
    inside = np.array([node.chars * (m == 1) for node, m in zip(page.nodes, mark)])
    own = {node.order: 0 for node in page.nodes}
    for node in reversed(page.nodes):
        got = inside[node.order] if mark[node.order] == 1 else own[node.order]
        own[node.order] = got
        if node.parent and mark[node.parent.order] != 1:
            own[node.parent.order] += got
    for i, node in enumerate(page.nodes):
        if mark[i] == -1 and own[node.order] == 0:
            mark[i] = 0
    return mark


def beside(page: Page, node: Node) -> bool:
    """Whether the element's tag or its class and id tokens name a side part."""
    return page.side(node) or "hidden" in node.marks or sum(m in SIDE_TOKENS for m in node.marks) > sum(m in MAIN_TOKENS for m in node.marks)


def densest(page: Page) -> Node | None:
    """The element that holds most unlinked text near it outside side parts; None if there is no such text."""
    out: list[bool] = []
    for node in page.nodes:
        out.append(beside(page, node) or (node.parent is not None and out[node.parent.order]))
    weight = np.zeros(len(page.nodes))
    for node, text, linked in page.pieces:
        if not linked and not out[node.order]:
            weight[node.order] += len("".join(text.split()))
    held = np.zeros(len(page.nodes))
    for node in reversed(page.nodes):
        i, up = node.order, node.parent
        if up is None:
            held[i] += weight[i]
        elif node.tag in BLOCKS:
            held[up.order] += weight[i] + held[i]
            held[i] = 0
        else:
            held[i] += weight[i]
            held[up.order] += NEAR * held[i]
    favour = np.array([1.25 if any(m in MAIN_TOKENS for m in node.marks) else 1.0 for node in page.nodes])
    best = int((held * favour).argmax())
    return page.nodes[best] if held[best] else None


def contents(html: str) -> tuple[Page, np.ndarray]:
    """The page and, per node, 1 inside the article, 0 outside it, -1 above it.

    A page whose markup names no article with text is marked by tokens and text density; one without
    text outside side parts is marked -1 throughout, and teaches nothing.
    """
    page = Page(html)
    page.measure()
    mark = marked(page, lambda node: node.tag in MAIN_TAGS, page.side)
    if not any(m == 1 and node.chars for m, node in zip(mark, page.nodes)):
        top = densest(page)
        if top is None:
            return page, np.full(len(page.nodes), -1)
        mark = marked(page, lambda node: node is top, lambda node: beside(page, node))
        if len(mark) > 1:
            mark[0] = -1
    return page, mark


def variants(html: str, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """Rewritten pages: the page's blocks between chosen forms, with the label of each form."""
    page, mark = contents(html)
    blocks: dict[int, list[tuple[str, str]]] = {0: [], 1: []}
    texts: dict[int, list[str]] = {}
    for node, text, _ in page.pieces:
        texts.setdefault(node.order, []).append(text)
    for node in page.nodes:
        words = " ".join("".join(texts.get(node.order, [])).split())
        if words and mark[node.order] in (0, 1):
            words = words.replace("&", "&amp;").replace("<", "&lt;")
            blocks[int(mark[node.order])].append((node.tag if node.tag in ("p", "h1", "h2", "h3", "li") else "p", words))
    if not blocks[1]:
        return []
    made = []
    rng = np.random.default_rng(seed)
    for _ in range(3):
        main = MAIN_FORMS[rng.integers(len(MAIN_FORMS))]
        body = main[0] + "".join(f"<{t}>{w}</{t}>" for t, w in blocks[1]) + main[1]
        before, after = [], []
        for _ in range(rng.integers(1, 5)):
            form = SIDE_FORMS[rng.integers(len(SIDE_FORMS))]
            source = blocks[0] or [("li", "Home")]
            picked = [source[rng.integers(len(source))][1] for _ in range(rng.integers(1, 6))]
            if form[0] == "<div>" or rng.random() < 0.6:
                inner = "<ul>" + "".join(f'<li><a href="/">{" ".join(w.split()[:3])}</a></li>' for w in picked) + "</ul>"
            else:
                inner = "".join(f"<p>{w}</p>" for w in picked)
            (before if rng.random() < 0.5 else after).append(f"{form[0]}{inner}{form[1]}")
        made.append(("<html><body>" + "".join(before), body, "".join(after) + "</body></html>"))
    return made


def training_rows(html: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of the page and its rewritten forms."""
    page, mark = contents(html)
    rows, labels = [Page(html).measure()], [mark]
    for before, main, after in variants(html, seed):
        whole = Page(before + main + after)
        x = whole.measure()
        front, back = len(Page(before).nodes), len(Page(before + main).nodes)
        y = np.zeros(len(x), int)
        y[front:back] = 1
        y[0] = -1
        rows.append(x)
        labels.append(y)
    x, y = np.concatenate(rows), np.concatenate(labels)
    return x[y >= 0], y[y >= 0]


class Forest:
    """Gradient-boosted trees of fixed depth for a log-odds score, stored as arrays."""

    def __init__(self, edges, feature, cut, leaf, base):
        self.edges, self.feature, self.cut, self.leaf, self.base = edges, feature, cut, leaf, base

    @staticmethod
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray) -> "Forest":
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b = cls.binned(x, edges)
        # without labels all text is taken for content
        rate = min(max(y.mean() if len(y) else 1.0, 1e-3), 1 - 1e-3)
        base = float(np.log(rate / (1 - rate)))
        score = np.full(len(x), base)
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        features, cuts, values = np.zeros((ROUNDS, inner), int), np.full((ROUNDS, inner), 255), np.zeros((ROUNDS, leaves))
        for r in range(ROUNDS if len(set(y.tolist())) == 2 else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(x), int)
            for level in range(DEPTH):
                width = 2**level
                best = np.full(width, 1e-9)
                for j in range(x.shape[1]):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    key = node * size + b[:, j]
                    gs = np.cumsum(np.bincount(key, g, width * size).reshape(width, size), axis=1)
                    hs = np.cumsum(np.bincount(key, h, width * size).reshape(width, size), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + LEAF_PENALTY) + (gt - gs) ** 2 / (ht - hs + LEAF_PENALTY) - gt**2 / (ht + LEAF_PENALTY)
                    at = gain[:, :-1].argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for k in np.flatnonzero(top > best):
                        best[k] = top[k]
                        features[r, width - 1 + k], cuts[r, width - 1 + k] = j, at[k]
                where = width - 1 + node
                node = node * 2 + (b[np.arange(len(x)), features[r, where]] > cuts[r, where])
            gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            values[r] = -RATE * gl / (hl + LEAF_PENALTY)
            score += values[r][node]
        return cls(edges, features, cuts, values, base)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for r in range(ROUNDS):
            node = np.zeros(len(x), int)
            for level in range(DEPTH):
                where = 2**level - 1 + node
                node = node * 2 + (b[rows, self.feature[r, where]] > self.cut[r, where])
            out += self.leaf[r][node]
        return out


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """True for the nodes whose own text is kept: the best consistent choice over the tree."""
    n = len(page.nodes)
    gain = np.where([node.chars > 0 for node in page.nodes], np.clip(score, -6, 6), 0.0)
    whole, apart = gain.copy(), np.zeros(n)  # keeping the subtree (dropping it is the negative); looking into it
    best = np.zeros(n)
    for node in reversed(page.nodes):
        i = node.order
        best[i] = max(whole[i], -whole[i], apart[i] + MIXED if node.children else -np.inf)
        if node.parent:
            whole[node.parent.order] += whole[i]
            apart[node.parent.order] += best[i]
    kept = np.zeros(n, bool)
    state = np.zeros(n, int)  # 1 kept whole, -1 dropped whole, 0 looked into
    for node in page.nodes:
        i, up = node.order, node.parent
        if up and state[up.order]:
            state[i] = state[up.order]
        elif node.children and apart[i] + MIXED > abs(whole[i]):
            state[i] = 0
        else:
            state[i] = 1 if whole[i] > 0 else -1
        # text that stands in an element which is looked into follows the element's own score
        kept[i] = state[i] == 1 or (state[i] == 0 and gain[i] > 0)
    return kept


def extract(html: str, forest: Forest) -> str:
    page = Page(html)
    return joined(page, decode(page, forest.score(page.measure())))


def joined(page: Page, kept: np.ndarray) -> str:
    return " ".join("".join(text if kept[node.order] else " " for node, text, _ in page.pieces).split())


def grow_forest(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Forest:
    """Train on the pages whose url hashes lowest; features are made by the tasks, at most ``sample_pages`` rows return."""
    chosen = pages.filter("html is not null").select("html").orderBy(F.xxhash64("html"), "html").limit(sample_pages)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column("html").to_pylist():
                x, y = training_rows(html, zlib.crc32(html.encode()))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.astype(np.int64).tobytes()], pa.binary())], names=["x", "y"])

    got = chosen.mapInArrow(rows, "x binary, y binary").collect()
    width = len(Page("").measure()[0])
    x = np.concatenate([np.zeros((0, width)), *(np.frombuffer(r["x"]).reshape(-1, width) for r in got)])
    y = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["y"], np.int64) for r in got)])
    return Forest.grow(x, y)


def main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages give an empty text. Equal pages give equal texts. An empty table gives an
    empty result. Of ``pages`` only page_id, url and html are read.
    """
    prepare(pages.sparkSession)
    forest = grow_forest(pages, sample_pages)
    parts = (forest.edges, forest.feature, forest.cut, forest.leaf, forest.base)
    source = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*parts)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                pages = [Page(html or "") for html in part.column("html").to_pylist()]
                rows = [page.measure() for page in pages]
                score = np.split(own.score(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [joined(page, decode(page, s)) for page, s in zip(pages, score)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
