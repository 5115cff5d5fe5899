"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read tag by tag into blocks: runs of text between the bounds of block elements. A logistic classifier
gives each block the log-odds of being content, from its length, its share of links, its punctuation, its element
and the class and id names around it; being inside the page's article or main element is further evidence. These
costs become the block's capacity from the source or to the sink. Neighbouring blocks and successive siblings are
joined by edges whose capacity falls with their distance in the tree. The minimum cut, found by maximum flow, is the
labelling of least cost in total; a block on the source's side is content. Only blocks that are boilerplate by their
very element (menus, forms, scripts and the like) or are hidden have a capacity that nothing can outweigh.

Names are evidence, no more: a name counts fully as a whole class token, less as a part of one, and not at all on a
wrapper that holds the page's main article or over half of its words. The classifier's weights start from PRIOR and
are fitted to the pages (``fit``), with the blocks inside and outside the article of those that have one as labels.

Defined results: null or empty html gives an empty text; elements that are not closed or not opened are read as
browsers do it, roughly; quotes part attributes only after an equals sign, and one that is never closed ends at the next ``>``;
repeated rows give the same text; long pages and any depth are read whole; an empty table gives no rows. Only
page_id, url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li main menu nav noscript ol option optgroup p pre section select summary table tbody td textarea tfoot th thead title tr ul caption label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed template svg math".split())
#: Of these, the ones that may close themselves, and that text after them survives if they never close.
DRAWN = frozenset("template svg math".split())
UNWANTED = frozenset("nav footer aside menu noscript button select textarea label script style head iframe dialog template svg math fieldset option object".split())
WANTED = frozenset("article main".split())
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus respond replies reply related recommended share sharing social subscribe newsletter "
    "signup login search pagination pager toolbar widget skip copyright legal tags toc topbar".split()
)
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
GOOD_NAMES = frozenset("article content post entry story main body text prose".split())
#: Parts of a name that say how a thing is laid out, and first parts that say what a thing has or lacks.
LAYOUT = frozenset("area bar block body bottom box container content footer header inner item items left link links list main outer right row section slot text top unit wrap wrapper".split())
HAVING = frozenset("has have no not non with without is js".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An element in the first set is closed by a start tag in the second, if nothing of the third stands between.
ENDS = [
    (frozenset(["p"]), BLOCK - {"button", "label"}, frozenset(["button", "td", "th", "table", "object", "body"])),
    (frozenset(["li"]), frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd"]), frozenset(["dl"])),
    (frozenset(["td", "th"]), frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    (frozenset(["tr"]), frozenset(["tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    (frozenset(["option"]), frozenset(["option", "optgroup"]), frozenset(["select"])),
    (frozenset(["head"]), frozenset(["body"]), frozenset()),
]
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: An attribute's name and, after an equals sign, its value; one with an open quote has the quote in the last group.
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(["'])|([^\s>]+))?)?)""")
READ = frozenset("class id role hidden style aria-hidden".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
STRONG, WEAK, COMMENT, FORM = 1, 2, 3, 4

FEATURES = ("bias", "words", "linked", "sentence", "heading", "paragraph", "label", "good name", "named", "partly named")
PRIOR = (-1.6, 0.9, -5.0, 0.7, 1.5, 0.6, -0.6, 1.0, -12.0, -2.5)
SURE, INSIDE, OUTSIDE, MOST = 1e6, 4.0, -6.0, 12.0


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: float
    tag: str
    #: The number of the element around it and of that one's parent; steps in the tree from the block before.
    parent: int
    steps: int
    hard: bool
    good: bool
    article: int
    mark: int


@dataclass(slots=True)
class _Element:
    tag: str
    number: int
    #: The nearest block element, itself or above; how many there are.
    block: _Element | None
    parent: int
    depth: int
    hard: bool = False
    good: bool = False
    article: int = 0
    mark: int = -1


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Names that speak against a part of the page: (the mark around it or -1, its kind).
    marks: list[tuple[int, int]] = field(default_factory=list)
    #: An article's number to the mark around it.
    articles: dict[int, int] = field(default_factory=dict)


@cache
def _closing(tag: str) -> re.Pattern[str]:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I | re.A)


def name_kind(token: str) -> tuple[int, bool]:
    """What a class or id token says: a kind of mark or 0, and whether it speaks for content."""
    parts = [p.lower() for p in NAME.findall(token)]
    if not parts or (len(parts) > 1 and parts[0] in HAVING):
        return 0, False
    bad = [p in BAD_NAMES for p in parts]
    if not any(bad):
        return 0, not GOOD_NAMES.isdisjoint(parts)
    if bad[-1] or (bad[0] and all(b or p in LAYOUT for p, b in zip(parts, bad, strict=True))):
        return COMMENT if not COMMENTS.isdisjoint(parts) else STRONG, False
    return WEAK, False


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that are read here, from the end of a tag's name, and where the tag ends."""
    found: dict[str, str] = {}
    while m := ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return found, at
        if m[5]:
            # The quote is never closed.
            end = page.find(">", at)
            return found, end + 1 if end >= 0 else len(page)
        name = m[2].lower()
        if name in READ and name not in found:
            found[name] = html.unescape(next((v for v in (m[3], m[4], m[6]) if v is not None), ""))
    return found, len(page)


def parsed(page: str) -> Page:
    out = Page()
    root = _Element("", 0, None, 0, 0)
    stack = [root]
    where: dict[str, list[int]] = defaultdict(list)
    parts: list[str] = []
    links: list[str] = []
    count, at, lowest, last_depth = 1, 0, 0, 0

    def end_block() -> None:
        nonlocal lowest, last_depth
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                e = stack[-1]
                own = e.block or root
                linked = min(1.0, len(" ".join("".join(links).split())) / len(text))
                out.blocks.append(Block(text, text.count(" ") + 1, linked, own.tag, own.parent, last_depth + own.depth - 2 * lowest, e.hard, e.good, e.article, e.mark))
                lowest = last_depth = own.depth
            parts.clear()
            links.clear()

    def add(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if where["a"]:
                links.append(text)

    def close(i: int) -> None:
        nonlocal lowest
        if stack[-1].depth > stack[i - 1].depth:
            end_block()
        for e in reversed(stack[i:]):
            where[e.tag].pop()
        del stack[i:]
        lowest = min(lowest, stack[-1].depth)

    def opened(tag: str, attributes: dict[str, str]) -> _Element:
        above = stack[-1]
        e = _Element(tag, count, above.block, (above.block or root).number, above.depth, above.hard, above.good, above.article, above.mark)
        if tag in BLOCK:
            e.block, e.depth = e, above.depth + 1
        kind, good, role = 0, False, attributes.get("role", "").strip().lower()
        for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if attributes else ():
            own, speaks_for = name_kind(token)
            kind, good = max(kind, own, key=(0, 2, 1, 3).index), good or speaks_for
        # The names of a whole page's body say what the page is, not what is in it.
        if tag in ("body", "html"):
            kind, good = 0, False
        if (tag in WANTED or role in WANTED) and not kind and not e.article and not e.hard:
            e.article, out.articles[count] = count, e.mark
            e.mark = -1
        e.hard = e.hard or tag in UNWANTED or (tag == "header" and not (above.article or above.good)) or role in BAD_ROLES or "hidden" in attributes
        e.hard = e.hard or attributes.get("aria-hidden", "").strip().lower() == "true" or "display:none" in "".join(attributes.get("style", "").lower().split())
        e.good = e.good or (good and not kind)
        kind = FORM if tag == "form" else kind
        if kind:
            out.marks.append((e.mark, kind))
            e.mark = len(out.marks) - 1
        return e

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        attributes, at = _attributes(page, at)
        if m[1]:
            if where[tag]:
                close(where[tag][-1])
            elif tag in BLOCK:
                end_block()
            continue
        if tag == "br":
            add(" ")
            continue
        for open_tags, by, stop in ENDS:
            if tag in by:
                i = max((where[t][-1] for t in open_tags if where[t]), default=0)
                if i and not any(where[t] and where[t][-1] > i for t in stop):
                    close(i)
        if tag in BLOCK:
            end_block()
        if tag in VOID or (page[at - 2 : at] == "/>" and tag not in BLOCK and (tag not in RAW or tag in DRAWN)):
            continue
        if tag in RAW and (tag not in DRAWN or page[at - 2 : at] != "/>"):
            if closing := _closing(tag).search(page, at):
                at = end + 1 if (end := page.find(">", closing.end())) >= 0 else len(page)
            elif tag not in DRAWN:
                at = len(page)
            continue
        stack.append(opened(tag, attributes))
        where[tag].append(len(stack) - 1)
        count += 1
    add(page[at:])
    end_block()
    return out


def _against(page: Page) -> tuple[list[int], int]:
    """For each mark what holds of it and the marks around it, 0 if nothing does; and the main article's number."""
    words, inside = [0] * len(page.marks), dict.fromkeys(page.articles, 0)
    for b in page.blocks:
        if not b.hard:
            if b.mark >= 0:
                words[b.mark] += b.words
            if b.article:
                inside[b.article] += b.words
    for article, mark in page.articles.items():
        if mark >= 0:
            words[mark] += inside[article]
        # Marks inside an article end at it, so what they hold is counted once, by the article.
    for i in range(len(page.marks) - 1, -1, -1):
        if page.marks[i][0] >= 0:
            words[page.marks[i][0]] += words[i]
    most = sum(b.words for b in page.blocks if not b.hard) / 2
    main = max(inside, key=lambda a: inside[a], default=0) if any(inside.values()) else 0
    held: list[int] = []
    for i, (up, kind) in enumerate(page.marks):
        kind = kind if kind == COMMENT or words[i] <= most else 0
        held.append(max(kind, held[up] if up >= 0 else 0, key=(0, WEAK, STRONG, COMMENT, FORM).index))
    return held, main


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Per block its FEATURES, whether it is boilerplate by its element, whether it is inside an article; if any is."""
    held, main = _against(page)
    rows, hard, inside = np.zeros((len(page.blocks), len(FEATURES))), np.zeros(len(page.blocks), bool), np.zeros(len(page.blocks), bool)
    for i, b in enumerate(page.blocks):
        kind = held[b.mark] if b.mark >= 0 else 0
        around = page.articles.get(b.article, -1)
        around = held[around] if around >= 0 and b.article != main else 0
        kind = kind or around
        hard[i] = b.hard or kind == FORM
        inside[i] = b.article > 0 and not around
        ends = b.text[-1] in ".!?…:;\"”»。！？"
        rows[i] = (1, math.log1p(min(b.words, 60)), b.linked, ends, b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("p", "blockquote", "pre"), b.words < 4 and not ends, b.good, kind in (STRONG, COMMENT), kind == WEAK)
    return rows, hard, inside, bool((inside & ~hard).any())


def evidence(page: Page, weights: tuple[float, ...] = PRIOR) -> list[float]:
    """Above zero for content, below for boilerplate: what calling the block the other would cost."""
    rows, hard, inside, marked = features(page)
    odds = np.clip(rows @ np.array(weights), -MOST, MOST)
    if marked:
        odds += np.where(inside, INSIDE, OUTSIDE)
    return np.where(hard, -SURE, odds).tolist()


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page and between successive blocks under one parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, 1.5 / (1 + b.steps)))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, 0.5))
        last[b.parent] = i
    return edges


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a least cut: node i hangs on the source by gain[i] if that is
    above zero, else on the sink by -gain[i]; edges hold both ways. By Dinic's maximum flow."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            join(s, i, g, 0.0)
        elif g < 0:
            join(i, t, -g, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            step = next((k for k in range(tried[a], len(out[a])) if room[out[a][k]] > 1e-9 and level[to[out[a][k]]] == level[a] + 1), None)
            if step is not None:
                tried[a] = step
                path.append(out[a][step])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
            else:
                break


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    read = parsed(page or "")
    keep = min_cut(evidence(read, weights), smoothness(read.blocks))
    return "\n".join(b.text for b, k in zip(read.blocks, keep, strict=True) if k)


def fitted(rows: np.ndarray, labels: np.ndarray, prior: tuple[float, ...] = PRIOR, trust: float = 50.0) -> tuple[float, ...]:
    """Logistic weights by Newton's method. ``trust`` draws each towards its prior, as so many blocks would; the
    larger class counts no more than the smaller one."""
    w, start, ones = np.array(prior), np.array(prior), max(float(labels.sum()), 1.0)
    zeros = max(len(labels) - ones, 1.0)
    share = np.where(labels > 0, min(1.0, zeros / ones), min(1.0, ones / zeros))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (share * (p - labels)) + trust * (w - start)
        step = np.linalg.solve((rows * (share * p * (1 - p))[:, None]).T @ rows + trust * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def fit(pages: DataFrame, max_pages: int = 400, max_blocks: int = 200) -> tuple[float, ...]:
    """Weights from at most ``max_pages`` pages with an article or main element, those of the smallest hash, and
    ``max_blocks`` blocks of each, spread over it; PRIOR where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows, hard, inside, marked = features(parsed(text))
                if marked:
                    some = np.unique(np.linspace(0, len(rows) - 1, max_blocks).astype(int))
                    # What an element settles by itself teaches nothing.
                    flat = np.column_stack([rows, inside])[some][~hard[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(list(flat), pa.list_(pa.float64()))], ["x"])

    sample = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "url", "html").alias("h"))
    sample = sample.where(F.col("html").rlike("(?i)<(article|main)")).orderBy("h", "html").limit(max_pages).select("html")
    found = np.array([r.x for r in sample.mapInArrow(run, "x array<double>").collect()])
    return fitted(found[:, :-1], found[:, -1]) if len(found) else PRIOR


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text. Without ``weights`` they are fitted to the pages."""
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x, weights) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
