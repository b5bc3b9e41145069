"""Main-text extraction by minimum cut.

A page becomes a sequence of text blocks.  A linear classifier over tags, names, link share and text gives each block a
cost for either label; the costs are the capacities of its terminal edges.  Smoothness edges tie blocks that follow each
other and blocks that are near in the DOM tree though others stand between them (the last one before under the same
parent, and under the same grandparent); their capacity falls with the distance in the tree.  The minimum cut, found by
maximum flow, separates content from boilerplate.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, own_columns, slices, text_bytes

_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

#: Fixed values of HTML: elements without an end tag, elements that break a line, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul video audio canvas".split())
RAW = frozenset("script style noscript template iframe textarea title noframes xmp".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
_SCOPE = frozenset("ul ol dl table select article section div main aside nav footer header form body html".split())
# Possessive throughout: what a part has taken is never given back, so a tag costs one walk over its characters.
_TAG = re.compile(r"</?+([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Words in class, id and role names that mark furniture, ones that may, and ones that mark content.
AWAY = frozenset("ad ads adv advert advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments respond reply replies disqus discussion related recommended newsletter signup login widget pagination pager copyright skip complementary contentinfo header".split())
MAYBE = frozenset("banner overlay share sharing social subscribe search legal".split())
HERE = frozenset("article articlebody main content post entry story body text prose".split())
#: The classifier's weights, calibrated on the labelled pages of the tests; positive speaks for content.
WEIGHTS = dict(bias=-0.5, word=0.1, most_words=40, sentence=1.0, paragraph=1.0, title=2.0, heading=0.5, article=4.0, named_content=2.0, furniture=-9.0, named_furniture=-9.0, named_maybe=-3.0, named_both=-1.0, control=-9.0, links=-4.0, list_item=-0.5)
FURNITURE = frozenset("nav footer aside form menu dialog head search".split())
CONTROL = frozenset("button select option optgroup label legend fieldset".split())
#: Capacities at DOM distance 1 of the edges between neighbours, and between blocks under one parent or grandparent.
TIE, KIN = 1.5, 0.5


class _Element:
    """An open element: its place in the tree, the block element that holds its text, what it says about that."""

    __slots__ = ("article", "bias", "depth", "holder", "link", "name", "parent")

    def __init__(self, name: str, parent: _Element | None):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.holder = self if parent is None or name in BLOCK else parent.holder
        self.bias, self.article, self.link = (parent.bias, parent.article, parent.link) if parent else (0.0, False, False)


@dataclass
class Block:
    """A run of text without a line break of the page."""

    element: _Element
    bias: float = 0.0
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    def cost(self) -> float:
        """How much more it costs to call this block boilerplate than content."""
        w, n, name = WEIGHTS, self.text.count(" ") + 1, self.element.name
        s = w["bias"] + w["word"] * min(n, w["most_words"]) + self.bias
        s += w["sentence"] * (self.text[-1] in ".!?…。\"”»") + w["paragraph"] * (name in ("p", "pre", "blockquote")) + w["list_item"] * (name == "li")
        s += w["title"] if name == "h1" else w["heading"] if name in ("h2", "h3", "h4", "h5", "h6") else 0
        if 2 * self.linked > len(self.text):
            s += w["links"]
        return s


def _named(attributes: str) -> set[str]:
    """Whether class, id, role and itemprop speak for furniture, perhaps for it, for content."""
    words = {x.lower() for found in _ATTRIBUTE.findall(attributes) for value in found[1:] for x in _NAME.findall(value)}
    return {kind for kind, known in (("away", AWAY), ("maybe", MAYBE), ("here", HERE)) if words & known}


def _described(name: str, attributes: str, parent: _Element) -> _Element:
    own = _Element(name, parent)
    own.link |= name == "a"
    if name in ("article", "main"):
        own.bias += 0 if own.article else WEIGHTS["article"]
        own.article = True
    elif name in FURNITURE or (name == "header" and not own.article):
        own.bias += WEIGHTS["furniture"]
    elif name in CONTROL:
        own.bias += WEIGHTS["control"]
    if attributes and name not in ("html", "body", "h1"):
        said = _named(attributes)
        if "here" in said and len(said) > 1:
            own.bias += WEIGHTS["named_both"]
        elif "away" in said:
            own.bias += WEIGHTS["named_furniture"]
        elif "maybe" in said:
            own.bias += WEIGHTS["named_maybe"]
        elif "here" in said and not own.article:
            own.bias += WEIGHTS["named_content"]
    return own


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, start tags with their attributes, end tags; every character is looked at a few times.

    A sign that opens nothing is text.  A tag that the page's end cuts off is markup without text, as are comments,
    declarations and the content of raw elements, which run to their end or that of the page.
    """
    at, n = 0, len(html)
    while at < n:
        if html[at] != "<":
            to = html.find("<", at)
            to = n if to < 0 else to
            yield "text", "", html[at:to]
            at = to
            continue
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = n if end < 0 else end + 3
        elif after.isascii() and after.isalpha() or (after == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha()):
            m = _TAG.match(html, at)
            if m is None:
                return
            at, name = m.end(), m[1].lower()
            if after == "/":
                yield "end", name, ""
            else:
                yield "start", name, m[2]
                if name in RAW:
                    end = _RAW_END[name].search(html, at)
                    at = end.end() if end else n
        elif after and after in "!?/":
            end = html.find(">", at)
            at = n if end < 0 else end + 1
        else:
            yield "text", "", "<"
            at += 1


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles and comments of the markup have none."""
    stack, out = [_Element("", None)], []
    open_: dict[str, int] = {}  # how many elements of each name are on the stack
    now: Block | None = None

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.pieces).split())
            if now.text:
                out.append(now)
            now = None

    def pop(k: int) -> None:
        for e in stack[k:]:
            open_[e.name] -= 1
        del stack[k:]

    for kind, name, rest in tokens(html):
        if kind == "text":
            top = stack[-1]
            if now is None:
                if rest.isspace():
                    continue
                now = Block(top.holder, top.bias)
            now.pieces.append(unescape(rest) if "&" in rest else rest)
            if top.link:
                now.linked += len(rest)
        elif kind == "end":
            if name in BLOCK:
                close()
            if open_.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        pop(k)
                        break
                    if name not in BLOCK and stack[k].name in BLOCK:
                        break
        elif name == "br":
            if now is not None:
                now.pieces.append(" ")
        elif name not in RAW:
            if name in BLOCK:
                close()
                ends = _CLOSES.get(name, set())
                heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
                for k in range(len(stack) - 1, 0, -1):
                    above = stack[k].name
                    if above == "p" or above in ends or (heading and len(above) == 2 and above[0] == "h" and above[1].isdigit()):
                        pop(k)
                    elif above in _SCOPE and above not in ends:
                        break
            if name not in VOID and not rest.endswith("/"):
                stack.append(_described(name, rest, stack[-1]))
                open_[name] = open_.get(name, 0) + 1
    close()
    return out


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements over their nearest common ancestor, less one; 1 at least."""
    n = -1
    while a is not b:
        n += 1
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return max(1, n)


def smoothness(holders: list[_Element]) -> dict[tuple[int, int], float]:
    """Capacities of the edges between blocks i < j, given the elements that hold them; at most three for each j.

    The steps between blocks that follow each other add up to a walk through the tree, so this is linear in the page.
    """
    out: dict[tuple[int, int], float] = {}
    before: dict[tuple[int, int], int] = {}
    for j, own in enumerate(holders):
        if j:
            out[j - 1, j] = TIE / _distance(holders[j - 1], own)
        above = own
        for up in (1, 2):
            above = above.parent
            if above is None:
                break
            i = before.get((up, id(above)))
            if i is not None and i < j - 1:
                out[i, j] = max(out.get((i, j), 0.0), KIN / (2 * up - 1))
            before[up, id(above)] = j
    return out


def minimum_cut(costs: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which blocks stay on the source's side; ties[i, j] is the capacity between blocks i and j.

    A block whose terminal edge outweighs all its other edges is on that terminal's side in some minimum cut; it is
    settled first and its ties become terminal capacity of its neighbours.  Maximum flow settles what still hangs together,
    group by group.
    """
    n = len(costs)
    costs = list(costs)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in ties.items():
        beside[i][j] = beside[j][i] = c
    side: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:
        i = work.popleft()
        if side[i] is not None or abs(costs[i]) < sum(beside[i].values()):
            continue
        side[i] = costs[i] > 0
        for j, c in beside[i].items():
            costs[j] += c if side[i] else -c
            del beside[j][i]
            work.append(j)
        beside[i] = {}
    for first in range(n):
        if side[first] is not None:
            continue
        group, queue = {first}, deque([first])
        while queue:
            for j in beside[queue.popleft()]:
                if j not in group:
                    group.add(j)
                    queue.append(j)
        for i, content in _flow(sorted(group), costs, beside).items():
            side[i] = content
    return [bool(s) for s in side]


def _flow(nodes: list[int], costs: list[float], beside: list[dict[int, float]]) -> dict[int, bool]:
    """Maximum flow from source (-1) to sink (-2) by blocking flows in layered networks."""
    room: dict[int, dict[int, float]] = {-1: {}, -2: {}, **{i: dict(beside[i]) for i in nodes}}
    for i in nodes:
        if costs[i] > 0:
            room[-1][i], room[i][-1] = costs[i], 0.0
        elif costs[i] < 0:
            room[i][-2], room[-2][i] = -costs[i], 0.0
    while True:
        layer = {-1: 0}
        queue = deque([-1])
        while queue:
            x = queue.popleft()
            for y, left in room[x].items():
                if left > 1e-12 and y not in layer:
                    layer[y] = layer[x] + 1
                    queue.append(y)
        if -2 not in layer:
            return {i: i in layer for i in nodes}
        ahead = {x: [y for y in room[x] if layer.get(y) == layer[x] + 1] for x in layer}
        tried = dict.fromkeys(layer, 0)
        path = [-1]
        while path:
            x = path[-1]
            if x == -2:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                del path[next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-12) + 1 :]
                continue
            while tried[x] < len(ahead[x]) and room[x][ahead[x][tried[x]]] <= 1e-12:
                tried[x] += 1
            if tried[x] < len(ahead[x]):
                path.append(ahead[x][tried[x]])
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def main_text(html: str) -> str:
    found = blocks(html)
    keep = minimum_cut([b.cost() for b in found], smoothness([b.element for b in found]))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(it):
        texts = [main_text((h or b"").decode("utf-8", "replace")) for h in text_bytes(batch.column(2))]
        yield batches({"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, _OUT)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page.

    Blocks of content in page order, one per line, character references decoded, white space within a block as one
    space.  A null or empty html, or a page without content, has an empty text.  Every row is judged by itself:
    repeated rows, null ids and urls and further columns don't matter; an empty table gives an empty result.
    """
    return own_columns(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
