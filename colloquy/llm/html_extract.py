"""Main text of web pages: blocks labelled by a minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import in_small_batches

# Elements of HTML, by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math head title textarea select button canvas audio video xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split(),
)
CLOSES_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
SELF_CLOSING = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}.items()}
SCOPE = frozenset("ul ol dl table article section div main nav aside body html".split())

# Evidence of an element's role, in log odds of main text.
TAG_ODDS = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "header": -6.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "article": 4.0, "main": 3.0}
ROLE_ODDS = {"navigation": -9.0, "banner": -7.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "dialog": -9.0, "alert": -7.0, "main": 3.0, "article": 4.0}
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adv|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer\w*|foot|header|masthead|comment\w*|disqus\w*|replies|reply|respond|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|toolbar|pagination|pager|tags|copyright|legal|disclaimer|skip|hidden|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|content|story\w*|main|body|text|prose)(?:$|[\s_-])", re.I)
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?)?"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?)?", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
#: Elements of other languages than HTML, which alone can close themselves.
FOREIGN = frozenset(("svg", "math"))


@dataclass
class Block:
    text: str
    away: int  #: elements to leave and enter on the way from the block before
    parent: int  #: the element around the innermost one
    odds: float  #: evidence from the elements around
    tag: str
    linked: int  #: characters inside links


@dataclass
class _Open:
    tag: str
    number: int
    odds: float
    block: str  #: the innermost block element
    link: bool
    article: bool


def _evidence(tag: str, attributes: str, in_article: bool) -> float:
    """Log odds of main text that an element adds to those of the elements around it.

    Names of good and bad at once ("article-header") are good; names say nothing of an article or main element.
    """
    odds = 0.0 if tag == "header" and in_article else TAG_ODDS.get(tag, 0.0)
    if tag in ("body", "html") or not attributes:
        return odds
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role":
            odds += ROLE_ODDS.get(value.lower(), 0.0)
        elif name in ("class", "id") and tag not in ("article", "main"):
            odds += 1.5 if GOOD_NAMES.search(value) else -8.0 if BAD_NAMES.search(value) else 0.0
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            odds -= 12.0
    return odds


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, character references decoded, white space turned to single spaces."""
    stack: list[_Open] = [_Open("", 0, 0.0, "body", False, False)]
    count: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked, number, at, low, depth = 0, 0, 0, 0, 0  # low: the least depth since the last block, whose depth is depth

    def flush() -> None:
        nonlocal parts, linked, low, depth
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            out.append(Block(text, depth + len(stack) - 2 * low, stack[-2].number if len(stack) > 1 else 0, top.odds, top.block, linked))
            low = depth = len(stack)
        parts, linked = [], 0

    def close(tags: frozenset[str], through: frozenset[str] = frozenset()) -> None:
        """Closes the innermost open element of tags and all in it, unless one of SCOPE lies between."""
        nonlocal low
        if not any(count[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for x in stack[i:]:
                    count[x.tag] -= 1
                del stack[i:]
                low = min(low, len(stack))
                return
            if stack[i].tag in SCOPE - through:
                return

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            if tag != "head" and not (tag in FOREIGN and m[3].endswith("/")):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID or tag in RAW:
            continue
        if closing:
            close(frozenset((tag,)), SCOPE if tag in SCOPE else frozenset())
            continue
        if tag in CLOSES_P:
            close(frozenset(("p",)))
        if tag in SELF_CLOSING:
            close(SELF_CLOSING[tag])
        top = stack[-1]
        number += 1
        count[tag] += 1
        article = top.article or tag == "article"
        stack.append(_Open(tag, number, top.odds + _evidence(tag, m[3], top.article), tag if tag in BLOCK else top.block, top.link or tag == "a", article))
    flush()
    return out


#: Weights of features() before any page is seen; fit() moves them by what the pages show.
START = np.array([-1.0, 0.45, -4.0, 0.6, 0.0, 0.0, 1.0, -1.0, 0.5, -0.5])
#: Evidence over which the elements around a block alone say what it is.
SURE = (3.0, -6.0)


def features(b: Block) -> list[float]:
    """What a block's own text tells: length, links, punctuation, numbers, and its element."""
    n, n_words = len(b.text), b.text.count(" ") + 1
    marks = sum(b.text.count(c) for c in ",;:")
    digits = sum(map(str.isdigit, b.text))
    return [
        1.0,
        min(4.0, math.log1p(n_words)),
        min(1.0, b.linked / n),
        float(b.text[-1] in ".!?:;\"')»”"),
        min(1.0, 4 * marks / n_words),
        digits / n,
        b.tag == "p",
        b.tag == "li",
        b.tag[0] == "h" and b.tag[1:].isdigit(),
        b.tag == "td",
    ]


def fit(x: np.ndarray, good: np.ndarray, prior: float = 50.0, steps: int = 25) -> np.ndarray:
    """Weights by logistic loss, both classes counting alike, that stay near START as far as rows are few."""
    w = START.copy()
    if not len(x) or good.all() or not good.any():
        return w
    share = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(x)
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (good - p)) - prior * (w - START)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def classifier(b: Block, weights: np.ndarray = START) -> float:
    """Log odds that a block is main text: the evidence around it and, within limits, its own."""
    return b.odds + max(-3.0, min(3.0, float(np.dot(weights, features(b)))))


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut.

    A node with positive odds has that capacity from the source, with negative odds to the sink; edges have their
    capacity both ways. Dinic's method: each phase levels the nodes by their distance from supply and blocks every
    shortest way to demand. Edges are short and small beside the odds, so the phases are few.
    """
    n, tiny = len(odds), 1e-9
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            out[a].append(len(to))
            out[b].append(len(to) + 1)
            to += [b, a]
            room += [c, c]
    supply = [max(x, 0.0) for x in odds]
    demand = [max(-x, 0.0) for x in odds]
    while True:
        level = [-1] * n
        reached = [i for i in range(n) if supply[i] > tiny]
        for i in reached:
            level[i] = 0
        end = -1
        for i in reached:  # grows while it is read
            if end >= 0 and level[i] > end:
                break
            if demand[i] > tiny and level[i] > 0 and end < 0:
                end = level[i]
            for e in out[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    reached.append(to[e])
        if end < 0:
            return [x >= 0 for x in level]
        at = [0] * n
        for root in range(n):
            while supply[root] > tiny and level[root] == 0:
                path, node = [], root
                while not (demand[node] > tiny and level[node] > 0):
                    if at[node] == len(out[node]) or level[node] >= end:
                        if not path:
                            node = -1
                            break
                        node = to[path.pop() ^ 1]  # dead end: take the next way from the node before
                        at[node] += 1
                        continue
                    e = out[node][at[node]]
                    if room[e] > tiny and level[to[e]] == level[node] + 1:
                        path.append(e)
                        node = to[e]
                    else:
                        at[node] += 1
                if node < 0:
                    break
                amount = min([supply[root], demand[node], *(room[e] for e in path)])
                supply[root] -= amount
                demand[node] -= amount
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount


def graph(found: list[Block], weights: np.ndarray = START, adjacency: float = 0.5, proximity: float = 0.7) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Odds of the blocks, and edges between neighbours, by their distance in the tree, and between siblings."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, adjacency / (1 + b.away)))
        if b.parent in last:
            edges.append((last[b.parent], i, proximity))
        last[b.parent] = i
    return [classifier(b, weights) for b in found], edges


def extract(page: str, weights: np.ndarray = START) -> str:
    """The main text of one page, blocks joined by line ends."""
    found = blocks(page)
    kept = min_cut(*graph(found, weights))
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def learn(pages: DataFrame, train_pages: int = 2_000, train_blocks: int = 20_000) -> np.ndarray:
    """Weights from blocks whose elements say by themselves what they are (SURE), the page's own labels.

    Blocks come from about train_pages pages, those with the smallest hashes of url and html; of their blocks at most
    train_blocks, by hash, are used.
    """
    n = pages.count()
    draw = F.xxhash64("url", "html")
    some = pages.where(draw < F.lit(int(-(2.0**63) + 2.0**64 * min(1 - 1e-9, train_pages / n)))) if n > train_pages else pages

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                found = [b for b in blocks(batch.column(0)[row].as_py() or "") if b.odds >= SURE[0] or b.odds <= SURE[1]]
                x = np.asarray([features(b) for b in found], float).reshape(-1, len(START))
                columns = [pa.array([b.odds > 0 for b in found], pa.bool_()), *(pa.array(c) for c in x.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["good", *(f"f{i}" for i in range(len(START)))])

    numbers = [f"f{i}" for i in range(len(START))]
    rows = in_small_batches(some.select("html")).mapInArrow(told, "good boolean, " + ", ".join(f"{c} double" for c in numbers))
    rows = rows.orderBy(F.xxhash64("good", *numbers), "good", *numbers).limit(train_blocks).toPandas()
    return fit(rows[numbers].to_numpy(), rows["good"].to_numpy(bool))


def extract_pages(pages: DataFrame, **params) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    The classifier's weights are learned from a bounded sample of the same pages (see learn), all else is by page.

    Null, empty and textless html give an empty text. Cut-off html is read as far as it goes. Repeated rows are
    extracted each. An empty table gives no rows. Other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = learn(own, **params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = batch.slice(at, 64)
                texts = [extract(x.as_py() or "", weights) for x in rows.column(2)]
                found = [pa.array([x.encode("utf-8", "replace").decode() for x in texts], pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *found], names=["page_id", "url", "text", "n_chars"])

    return in_small_batches(own).mapInArrow(run, "page_id long, url string, text string, n_chars long")
