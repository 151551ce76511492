"""Main text of web pages by a minimum cut.

A page is cut into blocks at block-level tags. Every block pays a cost for each of two labels,
content and boilerplate, from a small classifier over its ancestors, class names, links and words.
Neighbouring blocks, and blocks that follow each other under one parent, pay for differing labels, the
more the closer they stand in the document tree. The labelling of least total cost is the minimum cut
between a source (content) and a sink (boilerplate), found by maximum flow page by page.

Defined results: a null or empty page gives an empty text; unclosed and stray tags are repaired as
browsers do, block-level tags end an open select, svg or math; white space of any kind, ``<br>`` included, becomes one space inside a block; repeated
rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.shingles import sliced

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title noscript iframe".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s
samp small span strike strong sub sup time tt u var wbr svg math object canvas""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table td th tr ul dt dd tbody thead""".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table article section main div body nav aside footer header form blockquote".split())
AWAY_TAGS = frozenset("nav footer aside form button menu dialog head select".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Parts of class names and ids.
AWAY_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar
sidebars sidenav rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar header cookie cookies consent gdpr notice
notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
recommendations comment comments commentlist disqus discussion respond reply replies widget widgets toolbar pagination
pager skip copyright legal disclaimer search""".split())
MAIN_NAMES = frozenset("article content main post entry story body text prose".split())
NEGATED = frozenset("has no with without".split())


@dataclass(frozen=True)
class Costs:
    """Log-odds of content by feature, and the price of differing neighbours."""
    away: float = -9.0
    main: float = 6.0
    named: float = 1.5
    start: float = -1.6
    per_word: float = 0.06
    most_words: int = 60
    links: float = -4.0
    sentence: float = 0.8
    same_parent: float = 1.2
    near: float = 0.5
    far: float = 0.15
    siblings: float = 0.5


class _Node:
    __slots__ = ("tag", "away", "main", "named", "link", "parent", "depth", "foreign")

    def __init__(self, tag, parent, away=False, main=False, named=False, link=False):
        self.tag, self.parent, self.away, self.main, self.named, self.link = tag, parent, away, main, named, link
        self.depth = parent.depth + 1 if parent else 0
        # Tags inside svg and math stand in the line, but for pages embedded in a foreignObject.
        self.foreign = tag in FOREIGN or bool(parent and parent.foreign and tag != "foreignobject")

    @property
    def inline(self) -> bool:
        return self.tag in INLINE or self.foreign


def _node(tag: str, rest: str, parent: _Node) -> _Node:
    away, main, named, link = parent.away, parent.main, parent.named, parent.link or tag == "a"
    own_away = tag in AWAY_TAGS
    if len(rest) > 2 and ("=" in rest or "hidden" in rest) and tag not in ("html", "body", "a"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
        parts = {p.lower() for k in ("class", "id") if k in found for name in found[k].split() for p in _parts(name)}
        own_away |= bool(parts & AWAY_NAMES) or found.get("role", "").lower() in AWAY_ROLES
        own_away |= found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        own_away |= bool(re.search(r"\shidden(?:[\s=/>]|$)", rest))
        named = named or bool(parts & MAIN_NAMES)
        if found.get("role", "").lower() == "main":
            tag = "main"
    if tag == "header" and not main:
        own_away = True
    if tag in ("article", "main") and not own_away and not any(n.tag in AWAY_TAGS for n in _up(parent)) and not main:
        away, main = False, True  # a wrapper named after its sidebar still holds the article
    return _Node(tag, parent, away or own_away, main, named, link)


def _parts(name: str) -> list[str]:
    parts = NAME_PART.findall(name)
    return [] if any(p.lower() in NEGATED for p in parts) else parts


def _up(node: _Node | None) -> Iterator[_Node]:
    while node:
        yield node
        node = node.parent


def blocks(html: str) -> list[tuple[str, _Node, float]]:
    """(text, parent element, share of linked characters) of every block with text, in page order."""
    out: list[tuple[str, _Node, float]] = []
    top = at = _Node("", None)
    parts: list[str] = []
    linked = 0
    home = top

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, home, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    def block_of(node):
        while node.inline and node.parent:
            node = node.parent
        return node

    pos, n = 0, len(html)
    while pos < n:
        m = TAG.search(html, pos)
        end = m.start() if m else n
        if end > pos:
            piece = html[pos:end]
            if not parts:
                home = block_of(at)
            parts.append(piece)
            if at.link:
                linked += len(piece)
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE and (tag in CLOSES_P or not at.foreign):
                flush()
            node = at
            while node.parent and node.tag != tag:
                if tag in INLINE and not node.inline and node.tag != "foreignobject":
                    node = top  # a stray inline end doesn't close blocks
                    break
                node = node.parent
            if node.parent:
                at = node.parent
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P:
            while at.foreign or tag != "hr" and at.tag in ("select", "option", "optgroup"):
                at = at.parent
        if tag not in INLINE and not at.foreign:
            flush()
        if tag in RAW and not (at.foreign and m[3].endswith("/>")):
            close = re.compile(f"</{re.escape(tag)}\\s*>", re.IGNORECASE).search(html, pos)
            pos = close.end() if close else n
            continue
        if tag in CLOSES_P:
            node = block_of(at)
            if node.tag == "p":
                at = node.parent
        if tag in SAME:
            node = at
            while node.parent and node.tag not in SAME[tag] and node.tag not in SCOPE:
                node = node.parent
            if node.tag in SAME[tag]:
                at = node.parent
        if tag not in VOID and not m[3].endswith("/>"):
            at = _node(tag, m[3], at)
    flush()
    return out


def _log_odds(text: str, node: _Node, linked: float, c: Costs) -> float:
    if node.away:
        return c.away
    words = text.count(" ") + 1
    score = c.start + c.per_word * min(words, c.most_words) + c.links * linked
    score += c.sentence * (text[-1] in ".!?\"')") + c.named * node.named
    if node.main:
        score += c.main
    return score


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: gain > 0 favours True by so much; an edge costs its weight where labels differ.

    Dinic's algorithm on the graph with the two terminals; the labels True are the source's side.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, there, back):
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            link(source, i, g, 0.0)
        elif g < 0:
            link(i, sink, -g, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def main_text(html: str, costs: Costs = Costs()) -> str:
    found = blocks(html)
    if not found:
        return ""
    gain = [_log_odds(t, node, linked, costs) for t, node, linked in found]
    # Cost of a label is -log of its probability; their difference is the log-odds.
    # A block that is boilerplate by its own marks says little of its neighbours: it is linked weakly
    # and stepped over by the others.
    edges, last, before = [], {}, None
    for i, (_, node, _) in enumerate(found):
        parent = node.parent or node
        if node.away:
            if i:
                edges.append((i - 1, i, costs.far))
            continue
        if before is not None:
            there = found[before][1].parent or found[before][1]
            near = there.parent is parent.parent or there is parent.parent or there.parent is parent
            edges.append((before, i, costs.same_parent if there is parent else costs.near if near else costs.far))
            if parent in last and last[parent] != before:
                edges.append((last[parent], i, costs.siblings))
        before = last[parent] = i
    label = min_cut(gain, edges)
    return "\n".join(t for (t, _, _), on in zip(found, label) if on)


def probability(log_odds: float) -> float:
    """Content probability behind a log-odds value."""
    return 1 / (1 + exp(-log_odds)) if log_odds > -30 else exp(log_odds - log1p(exp(log_odds)))


def extracted(pages: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(h or "", costs) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
