"""HTML extraction (operator 1): the main text of a page by a minimum cut over its blocks.

A page becomes a row of blocks, each with what stands about it in the tree. A linear classifier's log-odds that a block is content
become its capacity to the source (content) or the sink (boilerplate). Its features: whether an element above says what it holds by its tag or
role (navigation, forms, an article), by the words of its class and id, and of the block itself its length against the page's mean, share of links, kind of element and
whether it ends as a sentence does. Class names are weak evidence: a name that also has words of other kinds counts the less, the more of the
page's text the element holds, and no name counts that the whole page's text stands under. Edges that a cut must pay for join blocks that follow one another, the stronger the fewer tree steps part
them, and the neighbours among the children of one element. Max-flow (Dinic) finds the cheapest labelling, so a block whose own
evidence is weak takes the side of those about it. Blocks whose own capacity outweighs all their edges keep their side in any
cheapest cut: they are fixed and folded into their neighbours first, and max-flow runs on what is left.

The weights are set by hand: pages carry no labels to fit them on.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements without text of the page: up to the end tag or else to the page's end.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
#: The same where there is an end tag; without one they are as if they weren't there.
_DROPPED = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("template", "noscript", "svg", "canvas", "object", "audio", "video", "annotation", "annotation-xml")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd "
    "template noscript svg canvas object audio video picture".split()
)
#: What an opening tag closes, if it is the nearest of its kind below a list, table or part of the page.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_STOPS = set("ul ol dl table body article section main div nav aside header footer form select".split())
#: What an open paragraph ends at, seen from within.
_P_STOPS = _STOPS | {"li", "td", "th", "dd", "blockquote"}
_APART = set("nav footer aside form button select menu dialog fieldset legend dir datalist optgroup option".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_BAD = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription "
    "signup sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended recommendations comment comments reply replies "
    "respond disqus discussion widget login search copyright legal disclaimer pagination pager toolbar skip hidden tags byline outbrain taboola".split()
)
_GOOD = set("article content post entry story body text main maincontent articlebody".split())
#: Words that say where something stands or how it is laid out.
_PLACE = set("area bar block bottom box center col column container fixed group head heading inner item items layout left link links list main module outer page panel right row section site small sticky title top wrap wrapper".split())
_WORDS = re.compile(r"[a-z]+")
#: Log-odds: of an element, whose blocks inherit them; of a block.
APART, ARTICLE, NAMED, NAMED_GOOD = -6.0, 0.8, -4.0, 0.4
PLAIN, HEADING, LENGTH, SENTENCE, LINKS = 0.5, 0.5, 0.6, 0.3, -5.0
#: Weights of the edges: to the next block, to the next one with the same parent; the steps that an edge of a part of the page counts for.
NEXT, SIBLING, PART = 4.0, 0.8, 5
_PARTS = set("article main section nav aside header footer form dialog".split())


class Block:
    __slots__ = ("element", "odds", "text", "words")


class Page:
    """Blocks with text, in order; of each element that isn't inline its parent (a smaller number), depth and log-odds."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.depth, self.step = [0], [0], [1]
        self.known, self.named = [0.0], [0]  # evidence that stands, and whether a name is against it: 1 may be discounted, 2 only if all text is within
        self.odds: list[float] = []

    def element(self, parent: int, step: int, known: float, named: int) -> int:
        self.parent.append(parent)
        self.step.append(step)
        self.depth.append(self.depth[parent] + 1)
        self.known.append(known)
        self.named.append(named)
        return len(self.parent) - 1

    def weigh(self) -> None:
        """Sums the evidence down the tree, and adds the elements' to the blocks'."""
        held = [0] * len(self.parent)
        for b in self.blocks:
            held[b.element] += len(b.text)
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        total = max(1, held[0])
        self.odds = [0.0] * len(held)
        for k in range(1, len(held)):
            against = (0.0, 1 - held[k] / total, float(held[k] < total))[self.named[k]]
            own = self.known[k] + NAMED * against
            self.odds[k] = max(-8.0, min(4.0, self.odds[self.parent[k]] + own))
        mean = sum(b.words for b in self.blocks) / max(1, len(self.blocks))
        for b in self.blocks:
            b.odds += self.odds[b.element] + LENGTH * max(-3.0, min(2.0, math.log2(b.words / mean)))


def _evidence(tag: str, attributes: str, inside: bool) -> tuple[float, int]:
    """Of an element's tag and attributes: the log-odds, and whether its name speaks against it (0: no, 1: not clearly, 2: clearly)."""
    odds, doubt, named = 0.0, False, 0
    if tag in _APART or (tag == "header" and not inside):
        odds += APART
    elif tag in ("article", "main"):
        odds += ARTICLE
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                for one in value.split():
                    found = set(_WORDS.findall(one))
                    if found & _BAD:
                        if found <= _BAD | _PLACE:
                            named = min(named, -1)
                        else:
                            doubt = True
                    elif found & _GOOD:
                        named = named or 1
            elif (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                odds += APART
            elif name == "role" and value in ("main", "article"):
                odds += ARTICLE
    if named > 0:
        odds += NAMED_GOOD
    return odds, 2 if named < 0 else int(doubt)


def page_of(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]  # tag, the nearest element that isn't inline
    places: dict[str, list[int]] = {}  # of each open tag, so that no step walks down the stack
    stops, p_stops = [0], [0]
    pieces: list[str] = []
    linked: list[str] = []
    links = heading = inside = 0
    at = 0

    def end_block():
        nonlocal pieces, linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                b = Block()
                b.text, b.element = text, stack[-1][1]
                share = min(1.0, len(" ".join(unescape("".join(linked)).split())) / len(text))
                b.odds = PLAIN + LINKS * max(0.0, share - 0.3) + HEADING * (heading > 0) + SENTENCE * (text[-1] in _ENDS)
                b.words = text.count(" ") + 1
                page.blocks.append(b)
            pieces, linked = [], []

    def close(k: int):
        nonlocal links, heading, inside
        while len(stack) > k:
            tag = stack.pop()[0]
            places[tag].pop()
            for found in (stops, p_stops):
                if found[-1] == len(stack):
                    found.pop()
            links -= tag == "a"
            heading -= tag in _HEADINGS
            inside -= tag in ("article", "main")

    def nearest(tags, barriers: list[int]) -> int:
        """The place of the innermost open one of ``tags`` within the last barrier, or 0."""
        k = max((places[t][-1] for t in tags if places.get(t)), default=0)
        return k if k > barriers[-1] else 0

    for m in _tokens(html):
        if isinstance(m, int):  # the end of what is left out
            at = m
            continue
        begin = m.start()
        if begin > at:
            pieces.append(html[at:begin])
            if links:
                linked.append(pieces[-1])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in _INLINE:
            end_block()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            k = nearest((tag,), stops if tag in _INLINE else [0])
            if k:
                if any(t not in _INLINE for t, _ in stack[k:]):
                    end_block()
                close(k)
            continue
        if tag in _VOID or tag in _RAW or tag in _DROPPED:
            continue
        if tag not in _INLINE:
            k = nearest(("p",), p_stops)
            if k:
                close(k)
        if tag in _CLOSES:
            k = nearest(_CLOSES[tag], stops)
            if k:
                close(k)
        above = stack[-1][1]
        if tag not in _INLINE:
            above = page.element(above, PART if tag in _PARTS else 1, *((0.0, 0) if tag in ("html", "body") else _evidence(tag, attributes, inside > 0)))
        places.setdefault(tag, []).append(len(stack))
        if tag in _STOPS:
            stops.append(len(stack))
        if tag in _P_STOPS:
            p_stops.append(len(stack))
        stack.append((tag, above))
        links += tag == "a"
        heading += tag in _HEADINGS
        inside += tag in ("article", "main")
    if at < len(html):
        pieces.append(html[at:])
        if links:
            linked.append(pieces[-1])
    end_block()
    page.weigh()
    return page


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_ENDS = ".!?…:;\"'”’»)"


def _tokens(html: str):
    """The matches of tags and comments; after a tag whose content is left out, the place at which that ends."""
    skip_to, endless = 0, set()  # tags that have no end tag any more
    for m in _TOKEN.finditer(html):
        if m.start() < skip_to:
            continue
        yield m
        tag = (m[2] or m[5] or "").lower()
        if (tag in _RAW or tag in _DROPPED) and tag not in endless and not (m[1] or m[4]) and not (m[3] or m[6] or "").rstrip().endswith("/"):
            end = (_RAW.get(tag) or _DROPPED[tag]).search(html, m.end())
            if end:
                skip_to = end.end()
                yield skip_to
            else:
                endless.add(tag)


def edges_of(page: Page) -> dict[tuple[int, int], float]:
    """Weights by pairs of places of blocks; the steps between blocks that follow one another are, in sum, at most twice the elements."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    parent, depth = page.parent, page.depth
    for i, b in enumerate(page.blocks):
        if i:
            x, y, steps = page.blocks[i - 1].element, b.element, 0
            while x != y:
                deeper = depth[x] - depth[y]
                if deeper >= 0:
                    steps, x = steps + page.step[x], parent[x]
                if deeper <= 0:
                    steps, y = steps + page.step[y], parent[y]
            edges[i - 1, i] = NEXT / (1 + steps)
        above = parent[b.element]
        if above in last:
            key = (last[above], i)
            edges[key] = edges.get(key, 0.0) + SIBLING
        last[above] = i
    return edges


_LEAST = 1e-12


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labels (True: source) that cost least: |odds| for each block against its sign, an edge's weight where its ends differ."""
    n = len(odds)
    odds, near = list(odds), [dict() for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    core = [i for i in range(n) if label[i] is None]
    if core:
        reached = _source_side(core, odds, near)
        for i in core:
            label[i] = i in reached
    return label


def _source_side(core: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """Max-flow by Dinic's phases; what the source reaches in the residual graph."""
    left = {i: dict(near[i]) for i in core}
    source, sink = {i: max(0.0, odds[i]) for i in core}, {i: max(0.0, -odds[i]) for i in core}
    while True:
        level = {i: 0 for i in core if source[i] > _LEAST}
        queue, met = deque(level), False
        while queue:
            i = queue.popleft()
            met = met or sink[i] > _LEAST
            for j, w in left[i].items():
                if w > _LEAST and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not met:
            return set(level)
        untried = {i: list(left[i]) for i in level}
        for first in [i for i in level if level[i] == 0]:
            while source[first] > _LEAST:
                path = [first]
                while path and sink[path[-1]] <= _LEAST:  # forward as long as there is a way, else back
                    i, onward = path[-1], None
                    while untried[i]:
                        j = untried[i][-1]
                        if left[i].get(j, 0.0) > _LEAST and level.get(j, -1) == level[i] + 1:
                            onward = j
                            break
                        untried[i].pop()
                    if onward is None:
                        path.pop()
                        if path:
                            untried[path[-1]].pop()
                    else:
                        path.append(onward)
                if not path:
                    break
                flow = min([source[first], sink[path[-1]], *(left[a][b] for a, b in zip(path, path[1:]))])
                source[first] -= flow
                sink[path[-1]] -= flow
                for a, b in zip(path, path[1:]):
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow


def labelled_blocks(html: str) -> tuple[list[Block], list[bool]]:
    """The page's blocks, with their own log-odds, and whether each is content."""
    page = page_of(html)
    return page.blocks, min_cut([b.odds for b in page.blocks], edges_of(page))


def main_text(html: str) -> str:
    blocks, keep = labelled_blocks(html)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


OUT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """``OUT`` of every row of ``pages`` (page_id, url, html; others are ignored): its main text, empty if it has none.

    A null html is empty; null ids and urls stay null; equal rows stay.
    """

    def texts(batches):
        for batch in batches:
            out = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(texts, OUT)
