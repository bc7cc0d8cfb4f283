"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A linear classifier over a block's
ancestors, attributes, length, punctuation and share of links gives each block a cost for
being called content or boilerplate. What the name of an element says counts the less, the less
prose there is beside it, and not at all where it holds the main part: wrappers of whole articles
have all kinds of names. Controls that come again and again mark comments and notices without
names. Squashed to log-odds of CERTAIN at most, the costs are a block's
capacities from source and to sink, so that they and the smoothness edges are of one scale.
Neighbouring blocks, and blocks of the same parent, are joined by edges that make unequal
labels cost the more the closer they are in the document tree. The minimum cut, found by
maximum flow, separates content from boilerplate.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of HTML by how text in and around them behaves.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset(
    "head script style noscript template svg math iframe object embed canvas audio video select option button input textarea "
    "title datalist".split()
)
CLOSED_BY_ITSELF = {
    "p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
SCOPES = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$))", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@.-][^\s=/>]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAMES = re.compile(r"[a-z0-9]+")
UNLIKELY = re.compile(
    r"^(?:ad|ads|adv|advert\w*|adslot|adsbox|banner|breadcrumbs?|byline|comments?|consent|cookies?|copyright|disclaimer|disqus|discussion|"
    r"donate|footer|foot|footnote|gdpr|header|masthead|login|menu|menus|modal|nav|navbar|navigation|navi|newsletter|notice|notices|notification|"
    r"overlay|pager|pagination|paywall|popup|privacy|promo|promos|promotion|recommend\w*|related|replies|reply|respond|responses|search|share|sharing|shoutbox|"
    r"sidebar|sidenav|side|signup|skip|social|sponsor\w*|subscribe|subscription|tags?|toc|toolbar|topbar|trackback|trending|warning|widget|alert|announcement|"
    r"sign|feedback|rating|reviews?|teaser|outbrain|taboola)$"
)
LIKELY = re.compile(r"^(?:article|body|content|entry|main|maincontent|post|story|text|hentry)$")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


NAMED = -12.0  # what a listed name, a form or a header says of an element that holds little of the page
OWN_NAME = -3.0  # the same of an article or main part
HALF = 0.5  # prose beside an element, in parts of its own, from which on its name has its full weight
PROSE = 400  # characters of prose from which on an element can do without it
NOTICE = re.compile(r"\b(?:cookies?|consent|privacy policy|all rights reserved|newsletter)\b", re.IGNORECASE)
CONTROL = 24  # characters of a link or button that stands alone, at most
CERTAIN = 4.0  # log-odds that a block's own signs reach at most
STRENGTH = 1.5  # log-odds that two blocks next to each other in one element share


@dataclass
class Block:
    text: str
    parent: int  # number of the element it stands in
    depth: int
    shared: int  # how many open elements it has in common with the block before it
    score: float = 0.0  # positive: content
    mark: int = 0  # the innermost element around it that says something of it by its name
    prose: float = 0.0  # characters that are no links, of a block that reads like text
    control: bool = False  # nothing but a short link
    group: int = 0  # the element around its own parent

    @property
    def cost(self) -> float:
        return CERTAIN * math.tanh(self.score / CERTAIN)


@dataclass
class Open:
    """An open element: its number, the score of what stands in it, and what holds for text there."""

    tag: str
    number: int
    score: float
    dropped: bool
    link: bool
    block: str  # the nearest block element
    near: int  # the nearest place of the stack, its own included, that may end by itself or bounds a search
    mark: int = 0  # the innermost marked element


@dataclass
class Mark:
    """An element whose name counts: the marked one around it, and what its name says before its share of the page is known."""

    above: int
    score: float
    main: bool = False  # holds an article or main element
    prose: float = 0.0


def _attribute_score(tag: str, raw: str) -> tuple[float, bool]:
    """What an element's attributes say of all text in it, and whether it is hidden."""
    if not raw or raw == "/":
        return 0.0, False
    score, hidden = 0.0, False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "data-component", "aria-label", "data-role"):
            if tag in ("html", "body"):
                continue
            bad = good = False
            for parts in map(NAMES.findall, value.split()):
                if parts and parts[0] not in ("with", "has", "no", "is", "without"):
                    bad |= any(map(UNLIKELY.match, parts))
                    good |= all(map(LIKELY.match, parts))
            if name == "aria-label" and len(value.split()) > 2:
                continue  # a sentence, not a name
            score += 2 if good else NAMED if bad else 0
        elif name == "role":
            score += NAMED if value in ROLES else 3 if value in ("main", "article") else 0
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return score, hidden


def _tag_score(tag: str, inside: float) -> float:
    """inside: the score of the ancestors; a header within an article counts less than a page's header."""
    if tag in ("nav", "footer", "aside", "menu", "dialog", "search"):
        return -12
    if tag in ("article", "main"):
        return 5
    return 0


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, with what the classifier makes of each; in time linear in the page."""
    found: list[Block] = []
    stack = [Open("#root", 0, 0.0, False, False, "body", 0)]
    marks = [Mark(-1, 0.0)]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked, count, at, has_main, low = 0, 0, 0, False, 1

    def flush() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                block = Block(text, top.number, len(stack), low)
                low = len(stack)
                share = min(1.0, linked / len(text))
                stops = sum(text.count(c) for c in ".,;:!?")
                block.mark, block.group = top.mark, stack[-2].number if len(stack) > 1 else 0
                block.prose = len(text) * (1 - share) if stops and len(text) >= 40 and top.score > -6 and not NOTICE.search(text) else 0.0
                block.control = share > 0.9 and len(text) <= CONTROL
                block.score = (
                    top.score
                    + min(2.0, len(text) / 80)
                    + min(1.0, stops / 3)
                    - 5 * share
                    + (1 if top.block in ("p", "blockquote", "pre") else 0.5 if top.block in ("h1", "h2", "h3") else -1 if top.block == "li" else 0)
                    - 1.5
                    - (2 if NOTICE.search(text) and len(text) < 300 else 0)
                )
                found.append(block)
        linked = 0

    def close(k: int) -> None:
        nonlocal low
        open_tags.subtract(x.tag for x in stack[k:])
        del stack[k:]
        low = min(low, len(stack))

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not stack[-1].dropped:
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK or tag in DROPPED:
            flush()
        if m[1]:
            if open_tags[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in SCOPES and tag not in SCOPES and tag not in BLOCK:
                        break
            continue
        k = stack[-1].near
        while k > 0:
            open_tag = stack[k].tag
            if tag in CLOSED_BY_ITSELF.get(open_tag, ()):
                if tag != "br":
                    close(k)
                break
            if open_tag in SCOPES:
                break
            k = stack[k - 1].near
        if tag in VOID:
            continue
        count += 1
        top = stack[-1]
        score, hidden = _attribute_score(tag, m[3])
        own = _tag_score(tag, top.score)
        has_main |= own > 0
        if tag in ("form", "fieldset") or tag == "header":
            score += -2 if tag == "header" and top.score >= 3 else NAMED
        if own > 0:
            score = max(score, OWN_NAME)
            k = top.mark
            while k and not marks[k].main:
                marks[k].main = True
                k = marks[k].above
        mark = top.mark
        if score:
            mark = len(marks)
            marks.append(Mark(top.mark, score, own > 0))
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        gone = top.dropped or hidden or tag in DROPPED
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        near = len(stack) if tag in CLOSED_BY_ITSELF or tag in SCOPES else top.near
        stack.append(Open(tag, count, top.score + own, gone, top.link or tag == "a", tag if tag in BLOCK else top.block, near, mark))
        open_tags[tag] += 1
    flush()
    _weigh(found, marks)
    if has_main:  # where the page names its main part, what stands outside it is less likely
        for b in found:
            b.score -= 1.5
    return found


def _weigh(found: list[Block], marks: list[Mark]) -> None:
    """Add to the blocks' scores what the names around them say, and what controls beside them do."""
    times = Counter(b.text.lower() for b in found if b.control)
    beside = {n for b in found if b.control and times[b.text.lower()] > 1 for n in (b.parent, b.group)}
    spread = Counter(b.parent for b in found) + Counter(b.group for b in found)
    few = {n for n in beside if spread[n] <= 12}  # a comment or a card, not what holds all of them
    for b in found:
        if b.parent in few or b.group in few:
            b.score, b.prose = b.score - 4, 0.0
        marks[b.mark].prose += b.prose
    own = [m.prose for m in marks]
    for m in reversed(marks[1:]):
        marks[m.above].prose += m.prose
    told, out = [0.0] * len(marks), [0.0] * len(marks)
    for k, m in enumerate(marks[1:], 1):
        out[k] = out[m.above] + own[m.above]  # beside it, and in no other element of such a name
        keeps = max(min(1.0, out[k] / (HALF * m.prose + 1)) ** 2, 1 - m.prose / PROSE)
        told[k] = told[m.above] + (m.score if m.score >= OWN_NAME else 0.0 if m.main else m.score * keeps)
    for b in found:
        b.score += told[b.mark]


def edges(found: list[Block], strength: float = STRENGTH) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next, the weaker the more elements lie between, and with the next of its own parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            between = max(1, found[i - 1].depth - b.shared, b.depth - b.shared)  # 1: siblings
            out.append((i - 1, i, strength * (0.1 + 0.9 / between)))
        before = last.get(b.parent)
        if before is not None and before < i - 1:
            out.append((before, i, strength / 2))
        last[b.parent] = i
    return out


def min_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for the source side of the minimum cut of terminal costs (positive: source) and undirected links.

    A block whose own cost outweighs all its links keeps its side in every minimum cut; such
    blocks are settled first and hand their links on as costs. Maximum flow settles the rest.
    """
    near: list[dict[int, float]] = [{} for _ in costs]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    cost, side = list(costs), [None] * len(costs)
    todo = deque(range(len(costs)))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(cost[i]) > sum(near[i].values()):
            side[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        place = {i: k + 2 for k, i in enumerate(rest)}
        room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]  # 0 source, 1 sink
        for i in rest:
            k = place[i]
            if cost[i] > 0:
                room[0][k], room[k][0] = cost[i], 0.0
            else:
                room[k][1], room[1][k] = -cost[i], 0.0
            for j, w in near[i].items():
                room[k][place[j]] = w
        while True:  # shortest augmenting paths
            via, queue = {0: 0}, deque([0])
            while queue and 1 not in via:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 1e-12 and v not in via:
                        via[v] = u
                        queue.append(v)
            if 1 not in via:
                break
            path, v = [], 1
            while v:
                path.append((via[v], v))
                v = via[v]
            flow = min(room[u][v] for u, v in path)
            for u, v in path:
                room[u][v] -= flow
                room[v][u] = room[v].get(u, 0.0) + flow
        for i in rest:
            side[i] = place[i] in via
    return side


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by one space; empty for null or where there is none."""
    if not page:
        return ""
    found = blocks(page)
    labels = min_cut([b.cost for b in found], edges(found))
    return " ".join(b.text for b, content in zip(found, labels, strict=True) if content)


def extract(pages: DataFrame, columns: list[Column] | None = None, html_col: str = "html") -> DataFrame:
    """columns of pages (default: all but html_col), text and n_chars (its code points) for every row.

    Null html counts as empty and gives an empty text; equal rows give equal texts; an empty
    table gives no rows. Columns named text or n_chars are replaced. Long pages are read whole,
    in time linear in their length, but for the flow among blocks that are in doubt.
    """
    columns = columns or [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text", "n_chars")]
    picked = pages.select(*columns, F.col(html_col).alias("__html"))
    at = len(picked.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *added], [*batch.schema.names[:at], "text", "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:at]]
    return picked.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
