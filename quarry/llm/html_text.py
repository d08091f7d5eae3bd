"""Main text of web pages by tag-path ratios.

A page is read as tag soup into text blocks, each with its root-to-leaf path of block tags (first class included).
For each path the blocks' text length and punctuation are aggregated to ratios per block; the ratios are smoothed in
page order (a Gaussian window), fused (their product, damped by the share of linked text) and compared with a
threshold; the paths above it are content. Hints of the markup only weigh a path's score: an ``article`` or ``main``
around it raises it, a semantic tag, role, class or id of menus, headers, footers, sidebars, notices, adverts, forms
or comments lowers it. A hint isn't counted against an element that holds an ``article`` or ``main``, or, for classes,
ids, roles, forms and headers, most of the page's text: such an element is a wrapper. A class or id is a hint only if
all its parts are such words, so ``share-price`` and ``has-sidebar`` aren't.

The main text is what the nearest element around all content blocks holds (a block's own element counts as its
parent, and headings right before it belong to it), with blocks however short, but for those whose path is lowered.
Where only body itself is around all of them, it is the blocks from the first content block to the last whose path
is content or whose text is mostly unlinked. Undisplayed elements (scripts, styles, templates, hidden ones) have no
text.

Each page is handled alone in Arrow batches: no shuffle, time linear in the page. Defined results: a null or empty
page, or one without content, has an empty text; unclosed tags and comments end with the page; repeated rows are
handled one by one; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import as_text, carried, read_table, restored

#: A comment; a tag with balanced quotes, or else up to the next ">"; a tag, declaration or text cut off by the end.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>"
    r"|<[A-Za-z/][^>]*+\Z|<[!?/][^>]*+>?|[^<]++|<",
    re.S,
)
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img br picture source object".split()
)
#: Elements that aren't displayed as text.
_UNSEEN = frozenset("head script style noscript template svg math canvas audio video iframe object title textarea select".split())
#: Elements that lower their text's scores.
_LOWER_TAGS = frozenset("nav footer aside form button dialog menu header".split())
_LOWER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of classes and ids that lower scores, and words that may stand beside them.
_LOWER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies"
    " consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall nav navbar navigation menu"
    " breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related recommended share sharing social"
    " footer header masthead comment comments commentlist disqus reply replies respond login signup search skip toc"
    " tags".split()
)
_BESIDE_WORDS = frozenset(
    "bar block box button buttons container content form inner item items left link links list main menu page post"
    " posts article articles stories reader readers right section site stuff top bottom user users us wrap wrapper"
    " area group panel policy thread".split()
)
#: Elements of these names with a lowering hint can't be wrappers of a page.
_NEVER_WRAP = frozenset(("nav", "footer", "aside", "button", "dialog", "menu"))
#: What a hint multiplies a path's score by, and the share of the page's text from which an element is a wrapper.
LOWERED, RAISED, WRAPPER = 0.01, 3.0, 0.8
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag ends open elements of these names, not looking past the scope.
_SIBLING = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPLIT = re.compile(r"[^a-z]+")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold one block of text: the container of such a block is its parent.
_LEAF = _HEADING | frozenset("p li td th dt dd pre blockquote figcaption caption summary address tr".split())


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    path: int
    depth: int
    block: bool
    unseen: bool = False
    hint: bool = False  # a lowering hint on this element itself
    wraps: bool = True  # the hint may be one on a wrapper
    named: bool = False  # article or main
    holds_named: bool = False
    text: int = 0  # unlinked characters below
    texts: int = 0  # text blocks below
    lowered: bool = False
    raised: bool = False
    chosen: int = 0  # content blocks below


@dataclass(slots=True)
class Block:
    node: Node
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    score: float = 0.0


@functools.lru_cache(maxsize=1 << 12)
def _hinting(value: str) -> bool:
    """Whether one of the class or id names consists of lowering words, and words that stand beside them."""
    for name in value.lower().split():
        parts = [p for p in _SPLIT.split(name) if p]
        if parts and not _LOWER_WORDS.isdisjoint(parts) and all(p in _LOWER_WORDS or p in _BESIDE_WORDS for p in parts):
            return True
    return False


def _open(tag: str, attrs: str, parent: Node, paths: dict[tuple[int, str], int]) -> Node:
    node = Node(tag, parent, parent.path, parent.depth + 1, tag not in _INLINE, unseen=parent.unseen or tag in _UNSEEN)
    label = tag
    node.named = tag in ("article", "main")
    if tag in _LOWER_TAGS and not (tag == "header" and _in_article(parent)):
        node.hint, node.wraps = True, tag not in _NEVER_WRAP
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class" and label == tag and value.split():
                label = f"{tag}.{value.split()[0]}"
            if name in ("class", "id"):
                node.hint = node.hint or (tag not in ("html", "body", "article", "main") and _hinting(value))
            elif name == "role":
                node.hint = node.hint or value.lower() in _LOWER_ROLES
                node.named = node.named or value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                node.unseen = True
    if node.block or node.hint:
        # A path with a hint is another one, so that a hint by id doesn't weigh on its namesakes.
        node.path = paths.setdefault((parent.path, label + "!" * node.hint), len(paths) + 1)
    return node


def _in_article(node: Node) -> bool:
    return node.raised or node.named


class _Reader:
    """Open elements with, for each tag and for block elements, the places of the open ones: each step is O(1) but for
    the elements that it closes."""

    def __init__(self) -> None:
        self.root = Node("#root", None, 0, 0, True)
        self.stack, self.nodes, self.found = [self.root], [self.root], []
        self.open: dict[str, list[int]] = {}
        self.holders = [0]  # places of elements that own text: blocks and such with a hint
        self.blocks = [0]
        self.now = Block(self.root)
        self.aside: dict[int, Block] = {}  # text around an open inline element that owns its text

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def flush(self) -> None:
        text = " ".join("".join(self.now.parts).split())
        if text and not self.now.node.unseen:
            self.now.text = text
            self.found.append(self.now)
        self.now = Block(self.stack[self.holders[-1]])

    def pop_to(self, i: int) -> None:
        """Close the elements from place i on."""
        changed, resumed = False, None
        for k in range(len(self.stack) - 1, i - 1, -1):
            node = self.stack[k]
            self.open[node.tag].pop()
            if self.holders[-1] == k:
                self.holders.pop()
                changed = changed or node.block
                if k in self.aside:
                    self.flush()
                    resumed = self.aside.pop(k)
                    self.now = resumed
            if self.blocks[-1] == k:
                self.blocks.pop()
        del self.stack[i:]
        if changed:
            self.flush()

    def push(self, node: Node) -> None:
        place = len(self.stack)
        self.stack.append(node)
        self.nodes.append(node)
        self.open.setdefault(node.tag, []).append(place)
        if node.block:
            self.holders.append(place)
            self.blocks.append(place)
            self.flush()
        elif node.hint or (node.unseen and not node.parent.unseen):
            self.holders.append(place)
            self.aside[place] = self.now
            self.now = Block(node)

    def close(self, tag: str) -> None:
        places = self.open.get(tag)
        # An inline end tag doesn't close blocks.
        if places and not (tag in _INLINE and self.blocks[-1] > places[-1]):
            self.pop_to(places[-1])

    def close_siblings(self, tag: str) -> None:
        ends, scope = _SIBLING[tag]
        floor = self.last(scope)
        if tag in ("tr", "tbody"):  # rows end with their cells
            above = [p[k] for t in ends if (p := self.open.get(t)) and (k := bisect.bisect_right(p, floor)) < len(p)]
            if above:
                self.pop_to(min(above))
        elif (at := self.last(ends)) > floor:
            self.pop_to(at)


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    """Displayed text blocks in page order; elements, parents first. A path is a number that stands for (number of the
    parent's path, label), so deep nesting costs no long strings."""
    r, paths, pos = _Reader(), {}, 0
    while pos < len(page):
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            s = m.group()
            if s[0] != "<" or s == "<":
                r.now.parts.append(html.unescape(s) if "&" in s else s)
                if r.open.get("a"):
                    r.now.linked += len(s.strip())
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            r.close(tag)
            continue
        if tag in _CLOSES_P and r.open.get("p") and r.open["p"][-1] == r.blocks[-1]:
            r.pop_to(r.blocks[-1])
        if tag in _SIBLING:
            r.close_siblings(tag)
        if tag == "br":
            r.now.parts.append("\n")
        if tag in _VOID:
            if tag == "hr":
                r.flush()
            continue
        if tag in _RAW:
            end = _raw_end(tag).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if attrs.endswith("/") and tag in ("svg", "math", "path"):
            continue
        node = _open(tag, attrs, r.stack[-1], paths)
        node.raised = _in_article(r.stack[-1])
        r.push(node)
    r.pop_to(1)
    r.flush()
    return r.found, r.nodes


@functools.lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _hints(found: list[Block], nodes: list[Node]) -> None:
    """Sets which elements are lowered and raised: hints of wrappers don't count, the others hold for all below."""
    for b in found:
        b.node.text += max(0, len(b.text) - b.linked)
        b.node.texts += 1
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.texts += n.texts
            n.parent.holds_named = n.parent.holds_named or n.holds_named or (n.named and n.texts > 0)
    total, named = nodes[0].text, nodes[0].holds_named
    for n in nodes:
        wrapper = n.holds_named or (n.wraps and not named and n.texts > 1 and n.text >= WRAPPER * total)
        above = n.parent
        n.lowered = (n.hint and not wrapper) or (above is not None and above.lowered)
        n.raised = n.named or (above is not None and above.raised)


def _smooth(values: list[float], radius: int = 2) -> list[float]:
    kernel = [math.exp(-(d * d) / 2.0) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        k = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(a * b for a, b in zip(k, values[lo:hi], strict=True)) / sum(k))
    return out


def path_scores(found: list[Block]) -> dict[int, float]:
    """Each path's fused ratio: the mean over its blocks of the smoothed ratios' geometric mean, damped by the share
    of linked text and weighed by the markup's hints."""
    stats: dict[int, list[float]] = {}
    for b in found:
        s = stats.setdefault(b.node.path, [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(_PUNCT.findall(b.text))
        s[2] += 1
        s[3] += min(b.linked, len(b.text))
    text = _smooth([stats[b.node.path][0] / stats[b.node.path][2] for b in found])
    punct = _smooth([(stats[b.node.path][1] + 0.5) / stats[b.node.path][2] for b in found])
    scores: dict[int, list[float]] = {}
    for b, t, p in zip(found, text, punct, strict=True):
        s = stats[b.node.path]
        hint = LOWERED if b.node.lowered else RAISED if b.node.raised else 1.0
        b.score = hint * math.sqrt(t * p) * (1 - s[3] / s[0]) * math.log1p(s[0])
        scores.setdefault(b.node.path, []).append(b.score)
    return {k: sum(v) / len(v) for k, v in scores.items()}


def content_paths(found: list[Block]) -> set[int]:
    """Paths whose score passes the threshold: a standard deviation of the blocks' scores, or a share of the highest."""
    means = path_scores(found)
    if not means:
        return set()
    every = [means[b.node.path] for b in found]
    mean, top = sum(every) / len(every), max(means.values())
    deviation = math.sqrt(sum((x - mean) ** 2 for x in every) / len(every))
    threshold = min(max(deviation, 0.3 * top), top)
    return {k for k, v in means.items() if v >= threshold and v > 0}


def extract(page: str | None) -> str:
    """The main text; blocks joined by blank lines."""
    found, nodes = blocks(page or "")
    _hints(found, nodes)
    paths = content_paths(found)
    content = [k for k, b in enumerate(found) if b.node.path in paths and not b.node.lowered]
    if not content:
        return ""
    for k in content:
        found[k].node.chosen += 1
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chosen += n.chosen
    top = max((n for n in nodes if n.chosen == len(content)), key=lambda n: n.depth)
    while top.parent is not None and (top.tag in _LEAF or not top.block):
        top = top.parent
    first, last = content[0], content[-1]
    if top.tag not in ("#root", "html", "body"):
        inside = {id(top)}
        for n in nodes:
            if n.parent is not None and id(n.parent) in inside:
                inside.add(id(n))
        within = [k for k, b in enumerate(found) if id(b.node) in inside]
        first, last = within[0], within[-1]
        kept = [found[k] for k in within if not found[k].node.lowered]
    else:
        kept = [b for b in found[first : last + 1] if not b.node.lowered and (b.node.path in paths or 2 * b.linked < len(b.text))]
    heads = []
    while first and found[first - 1].node.tag in _HEADING and not found[first - 1].node.lowered:
        first -= 1
        heads.append(found[first])
    return "\n\n".join(b.text for b in [*reversed(heads), *kept])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract(as_text(t)) for t in b["t"]]
            yield pd.DataFrame({"i": b["i"], "u": b["u"], "text": texts, "n_chars": pd.Series([len(t) for t in texts], dtype="int64")})

    flat = pages.select(carried(pages, id_col), pages[url_col].cast("string").alias("u"), pages[html_col].alias("t"))
    return restored(flat.mapInPandas(run, "i string, u string, text string, n_chars long"), pages, id_col).withColumnRenamed("u", url_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
