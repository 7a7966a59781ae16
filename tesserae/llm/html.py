"""Main text of web pages by minimum cut.

A page becomes its text blocks, with what stands around each in the document tree. Two things give a block a cost for
being content and one for being boilerplate, the terminal capacities: a classifier (logistic, on the block's own text,
tag, place and the share of the page's text in its zone), and a hint from the tree (names and classes of the elements
around it). Both are capped alike, so where they contradict each other the edges decide. Neighbours on the page are joined by edges, stronger under the same parent within one zone (what a
hinted element holds), and so are blocks with the same grandparent: cutting them costs smoothness. The cut of least
capacity labels all blocks. Blocks whose terminal outweighs all their edges keep their side in some least cut, so they
are fixed first; max-flow settles the rest.

The classifier starts from fixed weights and learns from the blocks of about `SAMPLE` pages, drawn by a hash (all of
fewer), labelled by their own markup: blocks in article or main against those in navigation, footers and the like. At
most `SAMPLE_BLOCKS` rows of features, the first by a hash, come to the driver. Pages without any markup of that kind
are told apart by the classifier and the cut alone.

Nulls and edges: null and empty html give an empty text; unclosed, crossed and truncated tags are taken as browsers
do (a block element ends an open paragraph, an end tag closes what is open inside it); an unclosed script or style
runs to the end of the page; pages of any length are read whole; a null url stays null; repeated rows give a row each; an
empty table gives no row. Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table
from tesserae.llm.near_dedup import chunks

SAMPLE, SAMPLE_BLOCKS = 400, 20_000
HINT, OWN, NEAR, SAME, KIN = 2.8, 2.8, 0.25, 1.0, 0.4

#: An attribute as the HTML standard has it: a value in quotes, or one without that ends at white space or >.
_ATTRIBUTE = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_RAW = {"script", "style", "title", "template", "iframe", "svg"}
_BLOCK = set("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article section nav header footer aside main form fieldset blockquote pre figure figcaption address details summary hr body html head menu dialog".split())
_GOOD_TAGS, _BAD_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
_BAD = re.compile(r"(?:^|[_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|alert|popup|modal|nav|navigation|menu|breadcrumbs?|sidebar|footer|masthead|comments?|respond|replies|share|social|related|widget|newsletter|subscribe|signup|login|search|contentinfo|complementary|toolbar|pagination)(?:$|[_-]|\d)", re.I)
_GOOD = re.compile(r"(?:^|[_-])(?:article|content|post|story|entry|main|body)(?:$|[_-])", re.I)
#: Names that tell a state or a layout of the page, not what an element is.
_STATE = re.compile(r"^(?:has|with|without|is|no|js)[_-]|[_-](?:open|opened|closed|active|enabled|disabled|visible|collapsed|expanded|layout|page|site|theme|grid)$", re.I)
_SPACE = re.compile(r"\s+")
#: Where the classifier starts: constant, length, words, share of links, stops, p, heading, li, place, share of its zone.
_START = np.array([-3.0, 0.6, 0.6, -4.0, 2.0, 1.0, 1.0, -0.5, 0.0, 0.5])


@dataclass
class Block:
    text: str
    tag: str
    hint: float
    parent: int
    kin: int
    zone: int
    linked: int


def _names(attributes: str) -> list[str]:
    """The names in class, id and role of a tag, but for those that tell a state."""
    found: dict[str, str] = {}
    for name, *values in _NAMES.findall(attributes):
        found.setdefault(name.lower(), values[0] or values[1] or values[2])
    return [x for k in ("class", "id", "role") for x in found.get(k, "").split() if not _STATE.search(x)]


def _hint(name: str, attributes: str, around: float, inside: bool) -> float:
    """What an element tells of its text: 1 content, -1 boilerplate, between them in doubt."""
    names = _names(attributes) if attributes and name not in ("body", "html") else []
    if name in _BAD_TAGS or name == "header" and not inside or any(map(_BAD.search, names)):
        return -1.0
    if name == "main":
        return 1.0
    good = name in _GOOD_TAGS
    if around < 0:
        return max(around, -1 / 3) if good else around
    return 1.0 if good or any(map(_GOOD.search, names)) else around


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in page order."""
    if not page:
        return []
    out: list[Block] = []
    stack = [("", 0.0, 0, 0)]  # name, hint, number, zone
    parts: list[str] = []
    link, linked, made, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                name, hint, _, zone = stack[-1]
                out.append(Block(text, name, hint, stack[-2][2] if len(stack) > 1 else 0, stack[-3][2] if len(stack) > 2 else -1, zone, min(linked, len(text))))
            parts.clear()
        linked = 0

    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            parts.append(page[at:end])
            if link:
                linked += end - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW and not closing:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                if stack[-1][0] == "head" or name == "body":  # either ends the head
                    stack[:] = [x for x in stack if x[0] != "head"]
                if stack[-1][0] == "p" or stack[-1][0] == name == "li":
                    stack.pop()
                if name == "hr":
                    continue
                made += 1
                hint = _hint(name, m[3], stack[-1][1], any(s[0] in _GOOD_TAGS for s in stack))
                stack.append((name, hint, made, made if hint != stack[-1][1] else stack[-1][3]))
    flush()
    return out


def features(bs: list[Block]) -> np.ndarray:
    """What each block shows without the names of the elements around it."""
    held, whole = {}, sum(len(b.text) for b in bs)
    for b in bs:
        held[b.zone] = held.get(b.zone, 0) + len(b.text)
    out = []
    for k, b in enumerate(bs):
        words = b.text.count(" ") + 1
        out.append([np.log1p(len(b.text)), min(words, 60) / 20, b.linked / len(b.text), min(sum(map(b.text.count, ".,;:!?")) / words, 1), b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag == "li", k / len(bs), held[b.zone] / whole])
    return np.array(out, float).reshape(-1, len(_START) - 1)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the classifier, the first the constant; those it starts from where a label is missing."""
    w = _START.copy()
    if not len(y) or all(y) or not any(y):
        return w
    a, y = np.c_[np.ones(len(x)), x], np.array(y, float)
    share = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (share * p * (1 - p))[:, None]) + np.eye(len(w)), a.T @ (share * (p - y)) + w - _START)
    return w


def labelled(pages: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks that the markup places for certain."""
    x, y = [np.empty((0, len(_START) - 1))], []
    for page in pages:
        bs = blocks(page)
        sure = [abs(b.hint) == 1 for b in bs]
        x.append(features(bs)[sure])
        y += [b.hint > 0 for b, s in zip(bs, sure, strict=True) if s]
    return np.concatenate(x), np.array(y, bool)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    n, share = pages.count(), 1 << 20
    if not n:
        return _START.copy()
    some = pages.where(F.pmod(F.xxhash64(id_col, html_col), F.lit(share)) < min(share, max(1, share * SAMPLE // n))).select(F.col(html_col).cast("string").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, 0):
            x, y = labelled(texts)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.bool_()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = some.mapInArrow(run, "y boolean, x array<double>")
    got = rows.orderBy(F.xxhash64("x", "y")).limit(SAMPLE_BLOCKS).toPandas()
    return fit(np.stack(got["x"].to_list()) if len(got) else np.empty((0, len(_START) - 1)), got["y"].to_numpy(bool))


class _Flow:
    """Largest flow by level graphs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, u: int, v: int, c: float, back: float) -> None:
        self.out[u].append(len(self.to))
        self.out[v].append(len(self.to) + 1)
        self.to += [v, u]
        self.room += [c, back]

    def levels(self, s: int) -> list[int]:
        level, todo = [-1] * len(self.out), deque([s])
        level[s] = 0
        while todo:
            u = todo.popleft()
            for e in self.out[u]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    todo.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[int]:
        """Levels after the last push: what the source still reaches is its side."""
        while (level := self.levels(s))[t] >= 0:
            at, path, u = [0] * len(self.out), [], s
            while True:
                if u == t:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    k = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    u = self.to[path[k] ^ 1]
                    del path[k:]
                elif at[u] < len(self.out[u]):
                    e = self.out[u][at[u]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[u] + 1:
                        path.append(e)
                        u = self.to[e]
                    else:
                        at[u] += 1
                elif path:
                    u = self.to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break
        return level


def least_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Sides of the least cut: a node of gain g costs g on the second side (or -g on the first), an edge its weight when cut."""
    near: list[dict[int, float]] = [{} for _ in gain]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    gain, side = list(gain), [None] * len(gain)
    todo = deque(range(len(gain)))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(gain[i]) >= sum(near[i].values()):
            side[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        number = {i: k + 2 for k, i in enumerate(rest)}
        flow = _Flow(len(rest) + 2)
        for i in rest:
            if gain[i] > 0:
                flow.join(0, number[i], gain[i], 0)
            elif gain[i] < 0:
                flow.join(number[i], 1, -gain[i], 0)
            for j, c in near[i].items():
                if i < j:
                    flow.join(number[i], number[j], c, c)
        level = flow.run(0, 1)
        for i in rest:
            side[i] = level[number[i]] >= 0
    return side


def main_text(page: str | None, w: np.ndarray) -> str:
    bs = blocks(page)
    if not bs:
        return ""
    own = np.clip(features(bs) @ w[1:] + w[0], -OWN, OWN)
    gain = [float(g) + HINT * b.hint for g, b in zip(own, bs, strict=True)]
    edges, last = {}, {}
    for k, b in enumerate(bs):
        if k:
            edges[k - 1, k] = SAME if (bs[k - 1].parent, bs[k - 1].zone) == (b.parent, b.zone) else NEAR
        if (j := last.get((b.kin, b.zone))) is not None and j != k - 1:
            edges[j, k] = KIN
        last[b.kin, b.zone] = k
    return "\n\n".join(b.text for b, s in zip(bs, least_cut(gain, edges), strict=True) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """id, url and text of every page."""
    w = train(pages, id_col, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(t, w) for t in texts], pa.string())], [id_col, url_col, "text"])

    d = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return d.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string")


def op7_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_mincut_html": op7_mincut_html}
ORACLES: dict[str, str] = {}
