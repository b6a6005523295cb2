"""Main text of web pages: a minimum cut over their text blocks separates content from boilerplate.

A page is cut into blocks at block-level tags; a block knows its element, the signs of the elements around it (semantic
tags, roles, words of class and id), its words, links and punctuation. A linear classifier gives log-odds of being content;
its weights are stated below, for no labelled blocks exist. Probabilities become terminal capacities -log(p), in whole
thousandths. Smoothness edges join a block with the next one (the weaker, the more tags lie between them, weaker still
across regions of different signs) and with the last block before it under the same parent. Blocks on the source's side
of the minimum cut are content.

Before the flow, a block whose own capacities outweigh all its edges gets its label (every minimum cut gives it that one)
and hands its edges over as capacities to its neighbours; the rest is solved by augmenting along shortest paths, level by
level. Blocks that could stand on either side are content.

Null and empty pages, and pages without content, have an empty text. Character references are decoded once, white space in
a block becomes one space, blocks are joined by a line feed in page order. Unclosed tags, stray ends and broken comments are
read as browsers do, roughly. Repeated rows give the same text; nested or long pages take linear time to cut into blocks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import gathered, small_batches

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video title textarea select button option datalist head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
#: What a start tag closes if it is open within the nearest of the elements named last.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
PARAGRAPH_STAYS = frozenset("hr body html td th tr li dd dt tbody thead tfoot caption".split())

# Signs of regions: tags, roles, words of class and id.
GOOD_TAGS, BAD_TAGS, SOFT_TAGS = {"article", "main"}, {"nav", "aside", "footer", "dialog", "menu", "search"}, {"header", "form", "address", "fieldset"}
GOOD_ROLES, BAD_ROLES = {"main", "article"}, {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
GOOD_WORDS = frozenset("article content main post entry story text body prose".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts advertisement advertising adsense sponsor sponsored "
    "sponsors promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies respond discussion disqus social share sharing related recommended recommendations widget toolbar "
    "pagination pager copyright disclaimer skip banner".split()
)
SOFT_WORDS = frozenset("header head side aside notice notification alert search form links tags meta byline legal rss toc top bottom".split())
#: Words that tell of the page instead of its subject, in short blocks.
PHRASES = re.compile(
    r"©|\(c\) ?\d{4}|copyright|all rights reserved|alle rechte|tous droits|todos los derechos|cookies?\b|privacy|subscribe|newsletter|sign (?:up|in)|log ?in\b|read more|share (?:this|on)|"
    r"advertisement|sponsored|related (?:posts|articles)|leave a (?:reply|comment)|terms of", re.I,
)

# Weights of the classifier.
GOOD, BAD, SOFT, OUTSIDE = 3.0, -6.0, -3.0, -1.5
LINKS, SENTENCE, PHRASE, SHORT, PER_LOG_WORD, MOST_FOR_WORDS = -4.0, 0.7, -2.0, -1.2, 0.9, 2.5
OF_TAG = {"p": 0.8, "pre": 0.8, "blockquote": 0.6, "h1": 0.8, "h2": 0.5, "h3": 0.5, "h4": 0.5, "h5": 0.3, "h6": 0.3, "li": -0.3, "td": -0.2, "label": -3.0, "legend": -3.0, "summary": -0.3}
#: Smoothness: of neighbours, of the last block under the same parent; factor across regions. Capacities are thousandths.
NEXT, SIBLING, ACROSS, UNIT = 2.4, 0.6, 0.25, 1000

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NO_SIGN, _GOOD, _SOFT, _BAD = 0, 1, 2, 3


@dataclass(slots=True)
class _Open:
    """An open element: its sign, that of its region, and the last block under it."""

    tag: str
    number: int
    sign: int
    hidden: bool
    within_good: bool


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    sign: int
    within_good: bool
    parent: int
    depth: int
    apart: int  # tags between the last block and this one
    linked: int  # characters in links
    words: int = field(default=0)


def _sign(tag: str, attributes: str) -> tuple[int, bool]:
    """The sign of an element by itself, and whether it is hidden."""
    sign = _GOOD if tag in GOOD_TAGS else _BAD if tag in BAD_TAGS else _SOFT if tag in SOFT_TAGS else _NO_SIGN
    if not attributes or tag in ("html", "body"):
        return sign, False
    words: set[str] = set()
    role = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role":
            role = value.strip().lower()
        elif name in ("class", "id"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return _BAD, True
    if role in BAD_ROLES or words & BAD_WORDS:
        return _BAD, False
    good = role in GOOD_ROLES or bool(words & GOOD_WORDS)
    if sign == _NO_SIGN:
        soft = bool(words & SOFT_WORDS)
        return (_GOOD if good and not soft else _SOFT if soft and not good else _NO_SIGN), False
    return (_NO_SIGN if sign == _SOFT and good else sign), False


def blocks(page: str) -> list[Block]:
    """The page's text blocks, in order. What stands in scripts, styles, form controls and the head is no text."""
    found: list[Block] = []
    stack = [_Open("", 0, _NO_SIGN, False, False)]
    names: dict[str, int] = {}
    endless: set[str] = set()  # raw elements of which no end follows
    pieces: list[str] = []
    link_depth = linked = number = 0
    lowest = 0  # least depth since the last block
    last_depth = 0
    end_of_tags = page.rfind(">")
    pos, size = 0, len(page)

    def flush() -> None:
        nonlocal linked, lowest, last_depth
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text and not stack[-1].hidden:
            top, depth = stack[-1], len(stack)
            at = depth - 1
            while at and stack[at].tag not in BLOCKS:
                at -= 1
            around = stack[at]
            apart = last_depth + depth - 2 * min(lowest, depth) if found else 0
            above = stack[at - 1].number if at else 0
            found.append(Block(text, around.tag, top.sign, top.within_good, above, depth, apart, min(linked, len(text)), text.count(" ") + 1))
            lowest = last_depth = depth
        linked = 0

    def close(depth: int) -> None:
        nonlocal lowest, link_depth
        while len(stack) > depth:
            gone = stack.pop()
            names[gone.tag] -= 1
            if gone.tag == "a":
                link_depth -= 1
        lowest = min(lowest, len(stack))

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if link_depth:
                linked += len(text.strip())

    while pos < size:
        at = page.find("<", pos)
        if at < 0 or at > end_of_tags:
            add(page[pos:])
            break
        add(page[pos:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pos = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            add("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not names.get("p"):
                flush()
            elif names.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                if any(e.tag in BLOCKS for e in stack[depth:]):
                    flush()
                close(depth)
            continue
        if tag in RAW and not (tag == "head" and names.get("body")):
            if tag == "head":  # ends where the body begins; a second one is no element
                if "head" in endless:
                    continue
                endless.add("head")
                end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(_without_raw(page, pos), pos)
                pos = end.end() if end else pos
                continue
            if tag not in endless and not (m[3].rstrip().endswith("/") and tag in ("svg", "math")):
                end = _end_of(tag).search(page, pos)
                pos = end.end() if end else (size if tag in ("script", "style", "title", "textarea") else pos)
                if not end:
                    endless.add(tag)
            continue
        if tag in BLOCKS:
            flush()
            if names.get("p") and tag not in PARAGRAPH_STAYS:
                depth = len(stack) - 1
                while stack[depth].tag not in BLOCKS:  # only a paragraph that is the nearest block is closed
                    depth -= 1
                if stack[depth].tag == "p":
                    close(depth)
        elif tag == "br":
            add(" ")
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            depth = len(stack) - 1
            while depth and stack[depth].tag not in ends and stack[depth].tag not in within:
                depth -= 1
            if stack[depth].tag in ends:
                close(depth)
        if tag in VOID:
            continue
        sign, hidden = _sign(tag, m[3])
        above = stack[-1]
        # Bad regions stay bad; only an article or main part lifts a soft one.
        if above.sign == _BAD or sign == _NO_SIGN or (above.sign == _SOFT and sign == _GOOD and tag not in GOOD_TAGS):
            sign = above.sign
        elif above.sign == _GOOD and sign == _SOFT and tag == "header":
            sign = _NO_SIGN
        number += 1
        good = above.within_good or (sign == _GOOD and tag in GOOD_TAGS)
        stack.append(_Open(tag, number, sign, above.hidden or hidden, good))
        names[tag] = names.get(tag, 0) + 1
        if tag == "a":
            link_depth += 1
    flush()
    return found


def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def _without_raw(page: str, pos: int) -> str:
    """The page, scripts, styles, titles and comments of the head blanked out, so that no tag in them counts."""
    return page[:pos] + _HEAD_RAW.sub(lambda m: " " * len(m[0]), page[pos:])


_HEAD_RAW = re.compile(r"<(script|style|title|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.I | re.S)


def log_odds(block: Block, page_has_good: bool) -> float:
    """How likely the block is content, as log-odds."""
    z = {_NO_SIGN: 0.0, _GOOD: GOOD, _SOFT: SOFT, _BAD: BAD}[block.sign]
    if page_has_good and not block.within_good:
        z += OUTSIDE
    elif block.within_good and block.sign == _NO_SIGN:
        z += GOOD / 2
    z += min(MOST_FOR_WORDS, PER_LOG_WORD * math.log(1 + block.words) + SHORT)
    share = block.linked / len(block.text)
    if share > 0.3:
        z += LINKS * share
    if block.text[-1] in ".!?:;…。！？\"”»)" or block.text.count(",") > 1:
        z += SENTENCE
    if block.words < 25 and PHRASES.search(block.text):
        z += PHRASE
    return z + OF_TAG.get(block.tag, 0.0)


def _capacity(z: float) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content): -log(1 - p) and -log(p)."""
    z = max(-30.0, min(30.0, z))
    return round(UNIT * math.log1p(math.exp(z))), round(UNIT * math.log1p(math.exp(-z)))


def graph(found: list[Block]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Terminal capacities (source, sink) of the blocks, and smoothness edges (a, b, capacity)."""
    good = any(b.within_good and b.sign != _BAD for b in found)
    terminals = [_capacity(log_odds(b, good)) for b in found]
    edges, under = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            same = a.sign == b.sign and a.within_good == b.within_good
            edges.append((i - 1, i, round(UNIT * NEXT / (1 + b.apart) * (1 if same else ACROSS))))
        before = under.get(b.parent)
        if before is not None and before != i - 1:
            same = found[before].sign == b.sign
            edges.append((before, i, round(UNIT * SIBLING * (1 if same else ACROSS))))
        under[b.parent] = i
    return terminals, edges


def minimum_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut with the largest source's side."""
    n = len(terminals)
    net = [s - t for s, t in terminals]  # the smaller capacity flows through at once
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if c and a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    weight = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # nodes that outweigh all their edges
        i = todo.popleft()
        if side[i] is not None or abs(net[i]) <= weight[i] and weight[i]:
            continue
        side[i] = net[i] >= 0
        for j, c in near[i].items():
            del near[j][i]
            net[j] += c if side[i] else -c
            weight[j] -= c
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        _flow(rest, net, near, side)
    return [bool(x) for x in side]


def _flow(rest: list[int], net: list[int], near: list[dict[int, int]], side: list[bool | None]) -> None:
    """Maximum flow from the nodes with a surplus to those with a lack, along shortest paths; then the sides."""
    while True:
        # Distances to a lack through residual edges, then paths from each surplus down the levels.
        level = {i: 0 for i in rest if net[i] < 0}
        queue = deque(level)
        while queue:
            j = queue.popleft()
            for i in near[j]:
                if i not in level and near[i][j] > 0:
                    level[i] = level[j] + 1
                    queue.append(i)
        sources = [i for i in rest if net[i] > 0 and i in level]
        if not sources:
            break
        edge = {i: list(near[i]) for i in level}
        for start in sources:
            while net[start] > 0:
                path = [start]
                while path and net[path[-1]] >= 0:
                    i = path[-1]
                    while edge[i] and not (near[i][edge[i][-1]] > 0 and level.get(edge[i][-1], -2) == level[i] - 1):
                        edge[i].pop()
                    if edge[i]:
                        path.append(edge[i][-1])
                    else:
                        path.pop()
                        if path:
                            edge[path[-1]].pop()
                if not path:
                    break
                moved = min(net[start], -net[path[-1]], *(near[a][b] for a, b in zip(path, path[1:])))
                for a, b in zip(path, path[1:]):
                    near[a][b] -= moved
                    near[b][a] += moved
                net[start] -= moved
                net[path[-1]] += moved
    for i in rest:
        side[i] = i not in level


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = minimum_cut(*graph(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 4 << 20):
            texts = [main_text(page.as_py()) for page in part.column(2)]
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
