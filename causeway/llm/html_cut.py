"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks that know their place in the element tree. A classifier prices each block as content
or boilerplate; the prices are the capacities to the two terminals of a graph. Neighbouring blocks, and blocks that
follow each other under one parent, are tied by smoothness edges. The minimum cut labels all blocks of a page at once;
those on the content side, in page order, are the main text.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, slices, table

# Element names of HTML by what they do to text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: those whose contents are no markup, and those that hold elements.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIPPED = frozenset("noscript template svg select button canvas audio video datalist".split())
CONTROLS = frozenset("input select textarea button".split())
#: Skipped elements that a start tag of a part of the page ends, if their own end tag is missing; and those parts.
ENDED = frozenset("select button canvas audio video datalist".split())
PARTS = frozenset("article aside blockquote body center details dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
#: What a start tag closes, if it is open above it, up to the nearest of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Times that a page is read at most: once more for its forms, and for each name that turns out to be the page's.
MOST_TURNS = 6
#: A block inside one of these leaves a paragraph around it open.
SCOPES = frozenset("table caption td th object marquee html".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
#: A form is the page itself, not boilerplate, from this share of the page's text and so many characters a control.
FORM_SHARE, FORM_CHARS = 0.5, 60
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
BAD_WORDS = frozenset("""
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner nav navbar navigation menu menus breadcrumb
    breadcrumbs sidebar sidebars aside footer foot masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    login share sharing social related recommended recommendations comment comments disqus reply replies respond responses discussion widget widgets toolbar pagination pager paging
    copyright legal disclaimer search form paywall teaser skip sitemap tags
    """.split())
#: The same where names are written together.
BAD_COMPOUNDS = re.compile(r"(cookie|advert|sponsor|newsletter|sidebar|breadcrumb|subscri|popup|footer)\w*|\w*(banner|navbar|sidebar|popup)|(top|side|sub|main|left|right|foot)(nav|menu)|ad(box|slot|unit|block|space|wrap|wrapper|container|zone)s?|comment(s?list|s?form|s?section|s?area)")
GOOD_WORDS = frozenset("article content entry post story maintext articlebody".split())
#: Bad words that settle what a name means wherever they stand in it; and words that say nothing beside a bad one.
SURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr disqus popup modal overlay newsletter breadcrumb breadcrumbs navbar masthead paywall sitemap".split())
#: Bad words that never name the page itself.
NEVER_PAGE = SURE_WORDS | frozenset("comment comments reply replies respond responses sidebar sidebars nav navigation menu menus banner footer foot subscribe subscription signup pagination pager paging login".split())
EMPTY_WORDS = frozenset("""
    area bar block body bottom box button buttons card col column container content count feed first footer group heading holder icon icons inner item items js label last layout left level line link links list
    mobile module outer page panel parent post posts primary region right row secondary section single site slot small text thread title top unit wrap wrapper zone
    """.split())
IGNORED_BEFORE = frozenset("has with no without is".split())

# Weights of the classifier, as log odds of content.
BIAS, IN_ARTICLE, OUTSIDE, BAD, BAD_NAME, DOUBTFUL_NAME, GOOD_NAME, PARAGRAPH, HEADING, LINKS, LENGTH, SENTENCE, PAGE_HEADER = -0.6, 4.0, -3.0, -9.0, -9.0, -2.0, 1.5, 0.6, 0.3, -4.0, 1.2, 0.5, -4.0
#: A part with a bad name is the page itself if it has so many characters and all that is left without it is less than this share of them.
LEFT_SHARE, LEAST_PAGE = 0.2, 140
#: Capacities of the smoothness edges: of neighbours under one parent or another, and of blocks that follow under one parent.
NEXT_SAME, NEXT_OTHER, SIBLING = 1.0, 0.2, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    bad: bool = False
    article: bool = False
    good: float = 0.0
    header: bool = False
    skip: bool = False
    form: int = -1
    named: int = -1  # the outermost element around it whose name is bad
    name: float = 0.0
    skipper: Node | None = None
    # what its place in the tree tells, so that nothing looks up through the open elements
    links: int = 0
    heading: bool = False
    head: bool = False
    block: Node | None = None
    paragraph: Node | None = None


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    link_chars: int
    heading: bool


@dataclass(slots=True)
class _Open:
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0


def name_weight(value: str, tag: str) -> tuple[float, bool]:
    """What a class or id says: 0, or how much it speaks against its element, and whether that is final. A bad word speaks fully if it comes last, is sure, or stands with empty words only; else ("share-enabled", "legal-history") it leaves doubt."""
    worst, good, never = 0.0, False, False
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        bad = [w for i, w in enumerate(words) if (w in BAD_WORDS or BAD_COMPOUNDS.fullmatch(w)) and not (i and words[i - 1] in IGNORED_BEFORE)]
        good |= bool(GOOD_WORDS & set(words)) and not bad
        if bad:
            full = words[-1] in bad or any(w in SURE_WORDS or w not in BAD_WORDS for w in bad) or all(w in bad or w in EMPTY_WORDS for w in words)
            worst = min(worst, BAD_NAME if full else DOUBTFUL_NAME)
            never |= full and any(w in NEVER_PAGE or w not in BAD_WORDS for w in bad)
    return (0.0, False) if good and tag in ("article", "main") else (worst, never)


def _child(parent: Node, tag: str, attrs: str, plain: bool = False) -> Node:
    """plain: a form that is the page itself; neither its tag nor its name counts."""
    n = Node(tag, parent, parent.bad, parent.article, parent.good, parent.header, parent.skip or tag in SKIPPED or tag in RAW, parent.form, parent.named, parent.name)
    n.skipper = parent.skipper or (n if n.skip else None)
    n.links, n.heading, n.head = parent.links + (tag == "a"), parent.heading or tag in HEADINGS, (parent.head or tag == "head") and tag != "body"
    n.block = n if tag in BLOCKS else parent.block
    n.paragraph = n if tag == "p" else None if tag in SCOPES else parent.paragraph
    n.bad |= tag in BAD_TAGS and not plain
    n.article |= tag in ("article", "main") and not n.bad
    n.header |= tag == "header" and not n.article
    if attrs and "=" in attrs:
        for key, *value in _ATTR.findall(attrs):
            key, value = key.lower(), next(filter(None, value), "")
            if key == "role":
                n.bad |= value.lower() in BAD_ROLES
                n.article |= value.lower() in ("main", "article") and not n.bad
            elif key in ("class", "id") and tag not in ("html", "body", "main") and not plain:
                weight, never = name_weight(value, tag)
                n.name, n.bad = min(n.name, weight), n.bad or never
                words = {w.lower() for w in _NAME.findall(value)}
                n.header |= "header" in words and not n.article
                if GOOD_WORDS & words and weight == 0.0:
                    n.good = GOOD_NAME
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value.lower() == "true":
                n.bad = True
    if attrs and re.search(r"(?:^|\s)hidden(?:\s|/|=|$)", attrs, re.I):
        n.bad = True
    return n


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order. Scripts, styles, form controls, comments and the head are no text.

    A form, or a part with a bad name, that holds the page itself is read again as any other part of it.
    """
    plain: frozenset[int] = frozenset()
    named: frozenset[int] = frozenset()
    for turn in range(MOST_TURNS):
        out, controls, names = _blocks(html, plain, named)
        chars = [0] * len(controls)
        held = [0] * names
        left = 0
        for b in out:
            n = b.node
            while n is not None and n.form >= 0:  # nested forms count for the outer ones too
                chars[n.form] += len(b.text)
                inner = n.form
                while n is not None and n.form == inner:
                    n = n.parent
            if not b.node.bad:
                if b.node.named >= 0:
                    held[b.node.named] += len(b.text) - b.link_chars
                else:
                    left += len(b.text) - b.link_chars
        total = sum(len(b.text) for b in out)
        forms = frozenset(i for i, n in enumerate(controls) if i not in plain and chars[i] and chars[i] >= FORM_SHARE * total and chars[i] >= FORM_CHARS * n)
        most = max(held, default=0)
        wrong = frozenset([held.index(most)]) - named if most >= LEAST_PAGE and left < LEFT_SHARE * most else frozenset()
        if turn == 0 and forms:  # forms first: what they hold is no part of `left` yet
            plain, wrong = forms, frozenset()
        elif not wrong:
            break
        named |= wrong
    return out


def _blocks(html: str, plain: frozenset[int], unnamed: frozenset[int]) -> tuple[list[Block], list[int], int]:
    """Blocks, the controls of each form, and the number of elements with bad names; plain: the forms, and unnamed: the bad names, that don't count."""
    names = 0
    controls: list[int] = []
    endless: set[str] = set()  # raw elements that are not closed any more
    root = Node("", None)
    stack, out, now = [root], [], _Open()
    opened: Counter[str] = Counter()  # elements on the stack by tag
    at = 0

    def flush() -> None:
        nonlocal now
        if now.pieces:
            text = " ".join(unescape("".join(now.pieces)).split())
            if text:
                out.append(Block(stack[-1].block or root, text, now.link_chars, stack[-1].heading))
            now = _Open()

    def say(text: str) -> None:
        if text and not stack[-1].skip and not stack[-1].head:
            now.pieces.append(text)
            if stack[-1].links:
                now.link_chars += len(text.strip())

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def close(tag: str) -> None:
        if opened[tag]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    cut(k)
                    return
                if tag not in BLOCKS and stack[k].tag in BLOCKS and not stack[k].skip:
                    return  # an inline end tag closes nothing beyond its block

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1]:
            closed = m[3].endswith("/")
            if tag in CONTROLS and stack[-1].form >= 0 and not (tag == "input" and re.search(r"type\s*=\s*[\"']?hidden", m[3], re.I)):
                controls[stack[-1].form] += 1
            if tag in RAW and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                    continue
                endless.add(tag)
            if tag in PARTS and stack[-1].skip and stack[-1].skipper.tag in ENDED:
                over = stack[-1].skipper
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k] is over))
            if stack[-1].skip or tag in SKIPPED or tag in RAW:
                # ends with its end tag, or else where its parent does
                if tag not in VOID and not closed:
                    push(_child(stack[-1], tag, ""))
                continue
            if tag == "br":
                say(" ")
                continue
            if tag in BLOCKS:
                flush()
                if stack[-1].paragraph is not None:
                    over = stack[-1].paragraph
                    cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k] is over))
            if tag in CLOSES and any(opened[t] for t in CLOSES[tag][0]):
                gone, stop = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stop:
                        break
                    if stack[k].tag in gone:
                        cut(k)
                        break
            if tag == "body" and opened["head"]:
                stack, opened["head"] = [n for n in stack if n.tag != "head"], 0
            if tag not in VOID and not closed or tag in BLOCKS - VOID:
                had = stack[-1].name
                push(_child(stack[-1], tag, m[3], tag == "form" and len(controls) in plain))
                if stack[-1].name < had:
                    if names in unnamed:
                        stack[-1].name = had
                    elif stack[-1].named < 0:
                        stack[-1].named = names
                    names += 1
                if tag == "form":
                    stack[-1].form = len(controls)
                    controls.append(0)
        else:
            if tag in BLOCKS:
                flush()
            close(tag)
    say(html[at:])
    flush()
    return out, controls, names


def odds(blocks: list[Block]) -> list[float]:
    """Log odds of content for each block, by its place and its text."""
    marked = any(b.node.article and not b.node.bad and b.node.name > BAD_NAME for b in blocks)
    out = []
    for b in blocks:
        n = b.node
        words = b.text.count(" ") + 1
        z = BIAS + n.good + LENGTH * min(np.log1p(words) / 3, 1.5) + LINKS * min(b.link_chars / max(len(b.text), 1), 1.0)
        z += PARAGRAPH * (n.tag in ("p", "blockquote", "pre")) + HEADING * b.heading + SENTENCE * b.text.endswith((".", "!", "?", "…", "”", '"'))
        z += BAD * n.bad + n.name + PAGE_HEADER * n.header + (IN_ARTICLE if n.article else OUTSIDE if marked else 0.0)
        out.append(float(z))
    return out


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: between neighbours, and between blocks that follow each other under one parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = id(b.node.parent) if b.node.parent is not None else id(b.node)
        if i:
            before = blocks[i - 1].node
            same = before is b.node or before.parent is b.node.parent
            out[i - 1, i] = NEXT_SAME if same else NEXT_OTHER
        if parent in last and last[parent] < i - 1:
            out[last[parent], i] = SIBLING
        last[parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True where a node lies on the source side of the minimum cut (the one with the fewest nodes there).

    source, sink: capacities from and to the terminals; edges: capacities both ways. A node that one terminal holds more
    strongly than all its edges together is settled at once and passes its edges on as terminal capacities; the rest is
    solved by blocking flows.
    """
    n = len(source)
    pull = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and (pull[i] > (held := sum(near[i].values())) or pull[i] <= -held):
            label[i] = pull[i] > held
            for j, c in near[i].items():
                pull[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    place = {i: k for k, i in enumerate(left)}
    ends: list[int] = []  # edge e leads to ends[e] and back by e ^ 1; room[e] is its residual capacity
    room: list[float] = []
    out: list[list[int]] = [[] for _ in left]
    for i in left:
        for j, c in near[i].items():
            if i < j:
                out[place[i]].append(len(ends))
                out[place[j]].append(len(ends) + 1)
                ends += [place[j], place[i]]
                room += [c, c]
    for k, inside in enumerate(_source_side([pull[i] for i in left], ends, room, out)):
        label[left[k]] = inside
    return [bool(x) for x in label]


def _source_side(excess: list[float], ends: list[int], room: list[float], out: list[list[int]], eps: float = 1e-12) -> list[bool]:
    """Where excess that finds no deficit can get to. Flow is pushed along shortest paths, all of one length at a time (blocking flows)."""
    while True:
        level = [0 if x > eps else -1 for x in excess]
        queue, met = deque(i for i, x in enumerate(excess) if x > eps), False
        sources = list(queue)
        while queue:
            i = queue.popleft()
            met |= excess[i] < -eps
            for e in out[i]:
                if room[e] > eps and level[ends[e]] < 0:
                    level[ends[e]] = level[i] + 1
                    queue.append(ends[e])
        if not met:
            return [x >= 0 for x in level]
        tried = [0] * len(excess)
        for s in sources:
            path: list[int] = []
            at = s
            while excess[s] > eps:
                if excess[at] < -eps:
                    push = min(excess[s], -excess[at], *(room[e] for e in path))
                    excess[s] -= push
                    excess[at] += push
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    full = next((k for k, e in enumerate(path) if room[e] <= eps), None)
                    if full is not None:  # go on from where the path is full
                        at = ends[path[full] ^ 1]
                        del path[full:]
                    continue
                while tried[at] < len(out[at]):
                    e = out[at][tried[at]]
                    if room[e] > eps and level[ends[e]] == level[at] + 1:
                        break
                    tried[at] += 1
                if tried[at] < len(out[at]):
                    path.append(out[at][tried[at]])
                    at = ends[path[-1]]
                elif path:
                    at = ends[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def main_text(html: str) -> str:
    """The content blocks of a page, each with white space as one space, joined by one space; empty if there is none."""
    blocks = blocks_of(html)
    z = odds(blocks)
    cut = minimum_cut([float(np.log1p(np.exp(x))) for x in z], [float(np.log1p(np.exp(-x))) for x in z], edges_of(blocks))
    return " ".join(b.text for b, content in zip(blocks, cut, strict=True) if content)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points); columns of those names are replaced. A null page counts as empty and has an empty text."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{html}`"), F.lit("")).alias(source := fresh_name("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            text = [main_text(h) for h in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, rows.drop(source).schema.add("text", "string").add("n_chars", "long"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
