"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text. A classifier gives each block a cost of being called
content and one of being called boilerplate: the log-odds of its own features (length,
stops, links, element) and of how the page marks the place (tags, class words). These are
the capacities to the source (content) or the sink (boilerplate). Neighbouring blocks,
and blocks next to each other under the same parent, are joined by smoothness edges.
Maximum flow separates the two. Blocks whose own capacity outweighs all their edges are
settled first, which changes no minimum cut.

The classifier is fitted (:func:`fit`) on a bounded number of pages, on the blocks that
pages themselves mark as an article or as navigation and the like, by features that do
not see the marks. Without such blocks its weights are those set by hand, from which the
fit starts.

Null, empty and textless pages give the empty text; a page of any size or depth is read
whole. Elements that hide their text hide it only if they end. Pages are read one by one,
so ties and repeated rows have the same text each; other columns pass through
:func:`extract`, and one named like its result is replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object head title select option textarea button math canvas audio video datalist map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPE = frozenset("article aside body dd div dialog details fieldset figure footer form header html li main nav section table td th blockquote ul ol dl".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HEAD_ONLY = frozenset("head title meta link style script base noscript template".split())
# Words in class, id and role that mark parts of a page.
AWAY_TAGS = frozenset("nav footer aside dialog menu search".split())
#: A class that begins with one of these says what is beside an element, not what it is.
BESIDE = frozenset("with has no without hide".split())
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side widget widgets related recommended recommendations "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup signin login register search share sharing social comment comments commentlist disqus reply replies discussion respond "
    "copyright legal disclaimer skip pagination pager paging contentinfo complementary".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies discussion respond".split())
HERE_TAGS = frozenset(("article", "main"))
HERE = frozenset("article content main story post entry body articlebody maincontent".split())
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
#: Features of a block, and the weights that a fit starts from.
FEATURES = ("one", "length", "stops", "links", "paragraph", "heading", "short")
BY_HAND = (-1.25, 1.0, 1.0, -3.0, 1.5, 0.5, -0.25)
#: What a mark of the page adds to a block's log-odds.
MARKED_HERE, MARKED_AWAY, MOST_ODDS = 2.0, -4.0, 2.0


class Block:
    """parent: the number of the element around it; steps: how many elements lie on the way from the block before."""

    __slots__ = ("parent", "steps", "tag", "here", "away", "pieces", "linked", "text")

    def __init__(self, parent: int, steps: int, tag: str, here: bool, away: bool):
        self.parent, self.steps, self.tag, self.here, self.away = parent, steps, tag, here, away
        self.pieces: list[str] = []
        self.linked = 0
        self.text = ""


class Reader(HTMLParser):
    """Reads a page into blocks. Open elements: (tag, number, in the main part, in boilerplate, in a form). ``shown``: tags that hide nothing."""

    def __init__(self, shown: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.hidden = SILENT - shown
        self.open: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self.count, self.silent, self.links = 0, 0, 0
        self.last, self.low = 0, 0  # how deep the last block lay, and the least depth since
        self.blocks: list[Block] = []
        self.block: Block | None = None

    def _pop(self, to: int) -> None:
        for tag, *_ in self.open[to:]:
            self.silent -= tag in self.hidden
            self.links -= tag == "a"
            if tag in BLOCK:
                self.block = None
        del self.open[to:]
        self.low = min(self.low, to - 1)

    def _close(self, tags, until) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self._pop(i)
                return
            if self.open[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.block = None
            if tag in CLOSES_P:
                self._close(("p", *HEADING) if tag in HEADING else ("p",), SCOPE)
            if tag in SIBLING:
                self._close(SIBLING[tag], LISTS[tag])
        elif tag == "br" and self.block:
            self.block.pieces.append(" ")
        if tag in VOID:
            return
        if tag not in HEAD_ONLY:
            self._close(("head",), ())
        _, _, here, away, form = self.open[-1]
        if tag not in ("html", "body"):
            names, main, other = set(), False, False
            for k, v in attrs:
                if v and k in ("class", "id", "role"):
                    for one in v.split():
                        words = [w.lower() for w in _WORDS.findall(one)]
                        if words and words[0] not in BESIDE:
                            names.update(words)
                            main, other = main or not HERE.isdisjoint(words), other or not AWAY.isdisjoint(words)
            if tag in HERE_TAGS:
                here, away, form = True, away or not COMMENTS.isdisjoint(names), False
            else:
                here = here or main
                form = (form or tag == "form") and not main
                away = away or tag in AWAY_TAGS or other
                if tag == "header" or "header" in names:
                    away = away or not here
        self.count += 1
        self.silent += tag in self.hidden
        self.links += tag == "a"
        self.open.append((tag, self.count, here, away, form))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.block = None
        self._close((tag,), () if tag in BLOCK or tag in SILENT else BLOCK)

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] == "head" and not data.isspace():
            self._close(("head",), ())
        if self.silent or not data:
            return
        if self.block is None:
            if data.isspace():
                return
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in BLOCK or not i)
            tag, _, here, *_ = self.open[at]
            away = self.open[-1][3] or self.open[-1][4]
            around = max(at - 1, 0)
            self.low = min(self.low, around)
            self.block = Block(self.open[around][1], self.last - self.low + at - self.low, tag, here, away)
            self.last = self.low = at
            self.blocks.append(self.block)
        self.block.pieces.append(data)
        if self.links:
            self.block.linked += len(data.strip())


def features(b: Block) -> tuple[float, ...]:
    """What a block is like by itself."""
    n = len(b.text)
    return 1.0, min(n, 400) / 200, min(sum(map(b.text.count, ".!?,;:")), 6) / 6, min(1.0, b.linked / max(n, 1)), float(b.tag in ("p", "blockquote", "pre")), float(b.tag in HEADING), float(n < 25)


def score(b: Block, weights: Sequence[float] = BY_HAND) -> float:
    """The log-odds that a block is content: the cost of calling it boilerplate, or below 0 that of calling it content."""
    own = sum(w * x for w, x in zip(weights, features(b)))
    return max(-MOST_ODDS, min(MOST_ODDS, own)) + (MARKED_AWAY if b.away else MARKED_HERE if b.here else 0.0)


def read(html: str) -> list[Block]:
    """The blocks of a page that have text. An element that hides its text but has no end hides nothing."""
    shown: frozenset[str] = frozenset()
    while True:
        reader = Reader(shown)
        reader.feed(html)
        reader.close()
        left = {tag for tag, *_ in reader.open} & reader.hidden
        if not left:
            break
        shown |= left
    for b in reader.blocks:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in reader.blocks if b.text]


def fit_weights(pages: list[str | None], pull: float = 20.0, rounds: int = 25) -> tuple[float, ...]:
    """Logistic regression on the blocks that pages mark, either way, both ways with the same weight. ``pull``: how much the weights set by hand hold."""
    blocks = [b for html in pages if html for b in read(html) if b.here != b.away]
    start = np.array(BY_HAND)
    if not blocks:
        return BY_HAND
    x = np.array([features(b) for b in blocks])
    y = np.array([float(b.here) for b in blocks])
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = start.copy()
    for _ in range(rounds):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + pull * (w - start)
        w = w - np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
    return tuple(float(v) for v in w)


def fit(pages: DataFrame, html: str = "html", most: int = 400, longest: int = 100_000) -> tuple[float, ...]:
    """Weights fitted on at most ``most`` pages, those of no more than ``longest`` characters with the smallest hashes: what reaches the driver is bounded."""
    few = pages.where(F.length(html) <= longest).select(html).orderBy(F.xxhash64(html), html).limit(most)
    return fit_weights([r[0] for r in few.collect()])


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut."""
    n = len(scores)
    scores, near = list(scores), [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a node whose own capacity outweighs its edges is settled; its edges become capacities of its neighbours
        i = queue.popleft()
        if side[i] is None and abs(scores[i]) >= sum(near[i].values()):
            side[i] = scores[i] > 0
            for j, w in near[i].items():
                scores[j] += w if side[i] else -w
                near[j].pop(i)
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, x in _flow(rest, scores, near).items():
            side[i] = x
    return [bool(x) for x in side]


def _flow(rest: list[int], scores: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Dinic's maximum flow; the source's side of the cut."""
    source, sink = -1, -2
    residual: dict[int, dict[int, float]] = {source: {}, sink: {}} | {i: dict(near[i]) for i in rest}
    for i in rest:
        a, b = (source, i) if scores[i] > 0 else (i, sink)
        residual[a][b] = abs(scores[i])
        residual[b].setdefault(a, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in residual[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i: i in level for i in rest}
        todo = {u: iter(list(residual[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(residual[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    residual[a][b] -= flow
                    residual[b][a] = residual[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if residual[a][b] <= 1e-12)
                del path[cut + 1 :]
                continue
            for v in todo[u]:
                if residual[u].get(v, 0.0) > 1e-12 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def edges_of(blocks: list[Block], adjacent: float, siblings: float) -> list[tuple[int, int, float]]:
    """Smoothness: between neighbours (less the more elements lie between them, and where the page marks them differently), and between blocks next to each other under one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            alike = blocks[i - 1].here == b.here and blocks[i - 1].away == b.away
            edges.append((i - 1, i, adjacent * 2 / max(2, b.steps) * (1 if alike else 0.25)))
        if b.parent in last:
            edges.append((last[b.parent], i, siblings))
        last[b.parent] = i
    return edges


def labels(blocks: list[Block], weights: Sequence[float] = BY_HAND, adjacent: float = 1.6, siblings: float = 1.6) -> list[bool]:
    """Which blocks are content."""
    return minimum_cut([score(b, weights) for b in blocks], edges_of(blocks, adjacent, siblings))


def main_text(html: str | None, weights: Sequence[float] = BY_HAND) -> str:
    if not html:
        return ""
    blocks = read(html)
    return "\n\n".join(b.text for b, k in zip(blocks, labels(blocks, weights)) if k)


def extract(pages: DataFrame, html: str = "html", result: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """Adds the main text. Without weights, fits them on the pages themselves."""
    weights = fit(pages, html) if weights is None else tuple(weights)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x, weights) for x in pages], dtype=object)

    return pages.withColumn(result, run(F.col(html)))
