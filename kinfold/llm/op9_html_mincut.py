"""Operator 9: main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier of each block (its words, links and element, the names in class, id and
role attributes around it, whether the page's article or a menu, form, footer and so on holds it) gives the log odds of content:
the capacities to the two terminals. Blocks next to each other, and a block and the last one of the same parent, are joined by
edges, stronger the nearer they are in the tree and weaker where a marked element begins or ends. The minimum cut (by maximum
flow) is the labelling of least total cost: a short or linked paragraph in a run of prose goes with the prose, a sentence in a list
of links with the links. No block is labelled before the cut; only what browsers never show (scripts, hidden elements) is no text.

The classifier's weights start from PRIOR and are fitted to at most FIT_PAGES pages of the table, FIT_BLOCKS blocks each, whose own
elements say what they are (inside the article or main element: content; inside navigation, footers, forms: not). Elements that
give the label are left out of the fit, which the other weights pay for with a Gaussian prior around PRIOR.

Plan. The fit reads the keys of all pages and the html of the sample. The extraction is one pass without a shuffle or any state.
Reading a page is linear in its length, however deep its elements. Before the flow, blocks whose cost outweighs all their edges
are settled, which is exact and leaves few.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import pieces

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg canvas object audio video select option datalist".split())
NEVER = frozenset("nav footer aside form button dialog menu head header fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())

#: Parts of names that pages give to what is no article, and to what is.
BAD_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related "
    "recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
GOOD_NAMES = frozenset("article articlebody body content entry main mainbody post story text".split())
BAD_ENDINGS = ("sidebar", "comments", "footer", "navbar", "menu", "banner", "advert", "adverts")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Log odds of content that each feature of a block starts with, chosen by hand; the fit moves those of the text and the names.
FEATURES = ("bias", "length", "links", "sentence", "paragraph", "item", "heading", "symbols", "good_name", "bad_name", "never", "article")
PRIOR = (-0.6, 1.0, -2.5, 0.5, 0.5, -0.2, 0.6, -1.5, 1.5, -5.0, -7.0, 3.0)
LABELLING = frozenset(["never", "article"])  # they give the fit's labels
FIT_PAGES, FIT_BLOCKS, FIT_WEIGHT = 512, 64, 200.0  # the whole sample weighs as much as so many blocks against a prior of variance 1

#: Edges: of neighbours, more the nearer in the tree, of a parent's next blocks; the part that is left where marks differ.
NEXT, PROXIMITY, SIBLING, BORDER = 0.3, 4.0, 0.5, 0.3

#: A tag ends at the first > outside a quoted value; one that doesn't end takes the rest of the page with it.
_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)"
    r"|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?=[\s=/]|\Z)(?:\s*=\s*(\"[^\"]*|'[^']*|[^\s\"'>]+))?", re.I)
_END = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for tag in RAW}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"'\u201d\u2019\u00bb)]?(?:\s|\Z)")


@dataclass(slots=True)
class Element:
    tag: str
    up: Element | None
    depth: int  # its place in the stack of open elements
    hidden: bool = False
    never: bool = False
    good: bool = False
    bad: bool = False
    article: int = 0  # 2 in an article element, 1 in main, else 0; a bad name inside ends it
    holder: Element | None = None  # the nearest that is not inline, itself included

    def marks(self) -> tuple:
        return self.never, self.bad, self.article


@dataclass(slots=True)
class Block:
    """The text between two borders of block elements."""

    at: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(hidden, good, bad) by an element's attributes."""
    hidden = good = bad = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name == "role":
            bad |= value.lower() in BAD_ROLES
            good |= value.lower() in ("main", "article")
        elif name in ("class", "id", "itemprop"):
            names = {x.lower() for x in _NAME.findall(value)}
            fine = bool(names & GOOD_NAMES) and not names & COMMENT_NAMES
            bad |= (bool(names & BAD_NAMES) or any(x.endswith(BAD_ENDINGS) for x in names)) and not fine
            good |= fine
    return hidden, good, bad


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, with references decoded and white space made one space; blocks without text are left out."""
    root = Element("", None, 0)
    root.holder = root
    stack, out, now = [root], [], None
    opened: Counter[str] = Counter()
    links = headings = 0
    at = 0

    def text(data: str) -> None:
        nonlocal now
        if not data or stack[-1].hidden:
            return
        if now is None:
            if not data.strip():
                return
            now = Block(stack[-1].holder)
            now.heading = headings > 0
            out.append(now)
        now.parts.append(entities.unescape(data) if "&" in data else data)
        if links:
            now.linked += len(data)

    def pop() -> None:
        nonlocal links, headings
        e = stack.pop()
        opened[e.tag] -= 1
        links -= e.tag == "a"
        headings -= len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456"

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):  # no text and no elements up to its end
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            now = None
        if closing:
            if opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            if tag == "img":
                text(" ")
            continue
        ends = CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in ENDS_P else frozenset())
        if ends:
            k = stack[-1].holder.depth
            if stack[k].tag in ends and k > 0:
                while len(stack) > k:
                    pop()
                while tag in ("tr", "li", "dt", "dd", "td", "th") and len(stack) > 1 and stack[-1].tag in ends:
                    pop()
        up = stack[-1]
        hidden, good, bad = _marks(m[3]) if m[3] else (False, False, False)
        article = {"article": 2, "main": 1}.get(tag, 0)
        never = tag in NEVER and not (tag == "header" and up.article == 2)
        e = Element(tag, up, up.depth + 1, up.hidden or hidden, up.never or never, up.good or good, up.bad or bad, article if bad else max(up.article, article))
        e.holder = up.holder if tag in INLINE else e
        stack.append(e)
        opened[tag] += 1
        links += tag == "a"
        headings += len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
    text(page[at:])
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    return kept


def features(b: Block, article: int) -> tuple[float, ...]:
    """A block's FEATURES. article: what the page has, as Element.article."""
    n = max(1, sum(map(len, b.parts)))
    return (
        1.0,
        min(3.0, math.log1p(len(b.text) / 20)),
        min(1.0, b.linked / n),
        float(_SENTENCE.search(b.text) is not None),
        float(b.at.tag in ("p", "blockquote", "pre")),
        float(b.at.tag == "li"),
        float(b.heading),
        float(b.text[0] in "©®|»•" or b.text.endswith("|")),
        float(b.at.good),
        float(b.at.bad),
        float(b.at.never),
        (1.0 if b.at.article >= article else -1.0) if article else 0.0,
    )


def _article(found: list[Block]) -> int:
    return max((b.at.article for b in found if not b.at.never), default=0)


def marked(page: str) -> tuple[list[tuple[float, ...]], list[bool]]:
    """Features of the blocks (at most FIT_BLOCKS, evenly spaced) whose own elements label them, without these elements, and the labels."""
    found = blocks_of(page)
    article = _article(found)
    some = [b for b in found if b.at.never or (article and b.at.article == article)]
    some = [some[k * len(some) // FIT_BLOCKS] for k in range(FIT_BLOCKS)] if len(some) > FIT_BLOCKS else some
    blind = [float(f not in LABELLING) for f in FEATURES]
    return [tuple(x * keep for x, keep in zip(features(b, article), blind, strict=True)) for b in some], [not b.at.never for b in some]


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights of least logistic loss, both classes weighing the same, with a Gaussian prior around PRIOR; PRIOR if a class is missing."""
    prior = np.array(PRIOR)
    if not len(y) or y.all() or not y.any():
        return prior
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * FIT_WEIGHT
    w = prior.copy()
    for _ in range(50):  # Newton steps; the loss is strictly convex
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + (w - prior)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return w


def _apart(a: Element, b: Element) -> int:
    """Steps from a and b up to their nearest common ancestor, together."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def settled(costs: list[float], edges: list[tuple[int, int, float]]) -> dict[int, bool]:
    """Labels that some least labelling has: a node whose cost, with its settled neighbours' pull, outweighs its other edges, again and again."""
    near: list[list[tuple[int, float]]] = [[] for _ in costs]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull, free = list(costs), [sum(w for _, w in own) for own in near]
    known: dict[int, bool] = {}
    queue = deque(range(len(costs)))
    while queue:
        i = queue.popleft()
        if i in known or abs(pull[i]) < free[i] or not pull[i]:
            continue
        known[i] = pull[i] > 0
        for j, w in near[i]:
            if j not in known:
                pull[j] += w if known[i] else -w
                free[j] = max(0.0, free[j] - w)
                queue.append(j)
    return known


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost: costs above 0 are paid by boilerplate, below by content, edges by different labels."""
    known = settled(costs, edges)
    if not known:
        return _max_flow(costs, edges)
    rest = [i for i in range(len(costs)) if i not in known]
    at = {i: k for k, i in enumerate(rest)}
    left, inner = [costs[i] for i in rest], []
    for a, b, w in edges:
        if a in at and b in at:
            inner.append((at[a], at[b], w))
        elif a in at or b in at:
            i, j = (a, b) if a in at else (b, a)
            left[at[i]] += w if known[j] else -w
    labels = _max_flow(left, inner)
    return [known[i] if i in known else labels[at[i]] for i in range(len(costs))]


def _max_flow(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """min_cut by maximum flow: content is what the source still reaches."""
    n = len(costs)
    if not any((costs[a] > 0) != (costs[b] > 0) for a, b, _ in edges):
        return [c > 0 for c in costs]
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forward: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forward)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        add(source, i, c, 0.0) if c > 0 else add(i, sink, -c, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:  # all shortest paths of this level graph, without recursion
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def graph(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of a page's blocks (above 0 for content) and edges between them."""
    article = _article(found)
    costs = (np.array([features(b, article) for b in found]) @ weights).tolist()
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}  # by parent: the last block it holds
    for i, b in enumerate(found):
        if i:  # the steps between neighbours are elements that end and begin between them: few on the whole
            w = NEXT + PROXIMITY / (1 + _apart(found[i - 1].at, b.at))
            edges.append((i - 1, i, w if found[i - 1].at.marks() == b.at.marks() else w * BORDER))
        up = b.at.up or b.at
        if (j := last.get(id(up))) is not None and j != i - 1:
            edges.append((j, i, SIBLING if found[j].at.marks() == b.at.marks() else SIBLING * BORDER))
        last[id(up)] = i
    return costs, edges


def labelled(page: str, weights: np.ndarray | None = None) -> list[tuple[str, bool]]:
    """The page's blocks and whether each is content."""
    found = blocks_of(page)
    if not found:
        return []
    return [(b.text, keep) for b, keep in zip(found, min_cut(*graph(found, np.array(PRIOR) if weights is None else weights)), strict=True)]


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    return " ".join(text for text, content in labelled(page or "", weights) if content)


def fit(pages: DataFrame) -> np.ndarray:
    """Weights fitted to the FIT_PAGES pages of the least keys (a hash of id, url and length; equal rows count once)."""
    keyed = pages.select(F.xxhash64("page_id", "url", F.length("html")).alias("key"), "html").where("html IS NOT NULL")
    keys = [r.key for r in keyed.select("key").distinct().orderBy("key").limit(FIT_PAGES).collect()]
    if not keys:
        return np.array(PRIOR)
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            rows = [marked(h) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), pa.array([np.array(x, "<f8").tobytes() for x, _ in rows], pa.binary()), pa.array([np.array(y, bool).tobytes() for _, y in rows], pa.binary())], names=["key", "x", "y"]
            )

    sample = keyed.where(F.col("key") <= keys[-1]).mapInArrow(run, "key long, x binary, y binary").groupBy("key").agg(F.min(F.struct("x", "y")).alias("r"))
    rows = sorted((r.key, r.r.x, r.r.y) for r in sample.collect())
    x = np.concatenate([np.frombuffer(v, "<f8").reshape(-1, width) for _, v, _ in rows])
    return fitted(x, np.concatenate([np.frombuffer(v, bool) for _, _, v in rows]))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (columns page_id, url, html; others are ignored).

    text has the content blocks in page order, joined by one space: references decoded, white space made one space. Null and empty pages,
    and pages without content, have an empty text. The whole page is read, broken and unclosed elements as browsers do roughly: an element may
    be nested as deep as the page is long, a quoted value or comment that never ends takes the rest of the page, quotes inside an unquoted value
    belong to it. Null ids and urls stay; repeated rows give repeated rows and weigh once in the fit. A cost of 0 is boilerplate.
    """
    weights = fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            texts = [main_text(x, weights) for x in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
