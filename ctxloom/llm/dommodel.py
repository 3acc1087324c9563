"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page's DOM are the nodes of a tree; each is content or
not.  A node has a potential from its features (its names: tag, class and id
words; its text: length, share of link text, punctuation) and one with its
parent.  Sum-product messages run up and down the tree and give exact content
marginals; the text directly in nodes above one half is the result.

Potentials are learned from pages that label themselves: on a bounded sample
(``SAMPLE`` pages, smallest hash of the key) every node below a name that says
what it holds (article, main, ...; nav, footer, ad, ...; the nearest one counts)
is a labelled node.  Its features are counted, names and text alike, so pages
without such names are judged by text and neighbours.  The names themselves have
``PRIOR`` counts to start with.  A feature's say is bounded (a telling name's
most, a text feature's least), and a child may differ from its parent with at
least 2.5 %, whatever the sample.  The sample's tables are all that the driver sees.

An inline element with class, id or role names is a node too, judged by these
names and its parent; its text counts for the block around it, and it tells that
block nothing unless blocks stand in it.  Controls (button, select, option, ...)
are nodes named as a form.

Comments, declarations, scripts, styles and other raw text elements (``RAW``)
are markup and never text.  Null and empty pages give the empty text.  Broken
markup is read to its end: unclosed and misnested elements, stray ends and
quotes, a tag or comment that the page's end cuts off.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.textops import slices
from ctxloom.session import ship_package

SAMPLE = 2_000
PRIOR = 50.0

#: Names of main text and of the rest.
CONTENT = frozenset("article main content post entry story".split())
OTHER = frozenset(("nav menu navbar header footer sidebar aside notice cookie banner ad ads advert advertisement sponsored promo form "
                   "comment comments reply replies related share social breadcrumb breadcrumbs dialog").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes".split())
CONTROL = frozenset("button select option optgroup datalist template".split())
#: Elements of formulas and drawings, which a /> ends.
FOREIGN = frozenset(("math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mtable mtr mtd "
                     "mpadded mphantom menclose svg g path circle ellipse rect line polyline polygon text tspan textpath defs use symbol desc "
                     "lineargradient radialgradient stop clippath mask pattern filter marker").split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var").split()) | FOREIGN
#: Elements that an open one of the second kind ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "optgroup": ("option", "optgroup"), "button": ("button",), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
#: An end does not reach beyond these.
FENCE = frozenset("table ul ol dl body html article section div".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?<=[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Node:
    parent: int
    names: tuple[str, ...]
    chars: int = 0
    links: int = 0
    points: int = 0
    inline: bool = False  # with no block in it
    block: int = 0        # an inline node's block


def _tag_end(page: str, at: int) -> int:
    """Place behind the > of the tag whose name ends at ``at``; quotes behind = hold."""
    begin = at
    while m := _EDGE.search(page, at):
        c = m.start()
        if page[c] == ">":
            return c + 1
        at = c + 1
        value = c  # white space before a quote reaches back to the last quote at most: walked once
        while value > begin and page[value - 1].isspace():
            value -= 1
        if value > begin and page[value - 1] == "=":
            close = page.find(page[c], c + 1)
            if close < 0:  # the quote never ends: the tag does at its first >
                end = page.find(">", begin)
                return len(page) if end < 0 else end + 1
            at = close + 1
    return len(page)


def read_page(page: str | None) -> tuple[list[Node], list[list[tuple[int, str]]]]:
    """(nodes, parents first; text blocks in page order, each as runs of a node and its text)."""
    nodes, blocks = [Node(-1, ("html",))], []
    stack: list[tuple[str, int]] = []  # open elements and the node each stands in
    opened: Counter = Counter()
    here, links, parts = 0, 0, []
    page = page or ""

    def block() -> Node:
        return nodes[nodes[here].block if nodes[here].inline else here]

    def close_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for _, t in parts).split())
            if text:
                blocks.append(parts)
                node = block()
                node.chars += len(text)
                node.points += sum(text.count(c) for c in ",.;:!?")
            parts = []

    def pop() -> str:
        nonlocal here, links
        name, outer = stack.pop()
        opened[name] -= 1
        links -= name == "a"
        if here != outer:
            if not nodes[here].inline:
                close_block()
            here = outer
        return name

    def end(names: tuple[str, ...]) -> None:
        """End the innermost open element of ``names``, unless a fence is in between."""
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in FENCE:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = html.unescape(page[at:lt])
            parts.append((here, text))
            if links:
                block().links += len(text.strip())
        if lt >= n:
            break
        c = page[lt + 1:lt + 2]
        if c == "!" or c == "?":
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
            else:
                stop = page.find(">", lt)
                at = n if stop < 0 else stop + 1
            continue
        closing = c == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:  # a bare <
            parts.append((here, "<"))
            at = lt + 1
            continue
        tag = m[0].lower()
        at = _tag_end(page, m.end())
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
            elif tag == "p":
                close_block()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                close_block()
            continue
        if tag in RAW:
            if page[at - 2:at] != "/>":
                stop = _find_end(page, tag, at)
                at = n if stop < 0 else _tag_end(page, stop + 2 + len(tag))
            continue
        words = [w for a in _ATTR.finditer(page, m.end(), at) for w in _WORD.findall((a[1] or a[2] or a[3] or "").lower())]
        if tag in INLINE:
            if tag in FOREIGN and page[at - 2:at] == "/>":
                continue
            stack.append((tag, here))
            opened[tag] += 1
            links += tag == "a"
            if words and (tag not in FOREIGN or tag in ("svg", "math")):
                nodes.append(Node(here, tuple(dict.fromkeys(words)), inline=True, block=nodes[here].block if nodes[here].inline else here))
                here = len(nodes) - 1
            continue
        close_block()
        if tag in CLOSES:
            end(CLOSES[tag])
        if opened["p"]:
            end(("p",))
        outer = here
        while nodes[outer].inline:  # a block in it: they are blocks as well
            nodes[outer].inline, outer = False, nodes[outer].parent
        stack.append((tag, here))
        opened[tag] += 1
        nodes.append(Node(here, tuple(dict.fromkeys([tag, *(("form",) if tag in CONTROL else ()), *words]))))
        here = len(nodes) - 1
    while stack:
        pop()
    close_block()
    return nodes, blocks


def _find_end(page: str, tag: str, at: int) -> int:
    m = re.compile("</" + re.escape(tag), re.I | re.A).search(page, at)
    return m.start() if m else -1


def traits(node: Node) -> list[str]:
    """Features of a node: its names, and of its text the length, link share and punctuation."""
    out = ["name:" + w for w in node.names]
    if node.chars:
        out += [f"chars:{node.chars.bit_length()}", f"links:{min(4, 4 * node.links // node.chars)}",
                f"points:{min(6, 100 * node.points // node.chars)}"]
    return out


def seeds(nodes: list[Node]) -> list[int | None]:
    """Label of each node by the nearest name that tells: 1, 0, or None."""
    out: list[int | None] = []
    for node in nodes:
        own = [w for w in node.names if w in OTHER or w in CONTENT]
        out.append((0 if any(w in OTHER for w in own) else 1) if own else out[node.parent] if node.parent >= 0 else None)
    return out


@dataclass
class Potentials:
    """Log odds of features, and log potentials of (parent, child) states."""
    trait: dict = field(default_factory=dict)
    pair: list = field(default_factory=lambda: [[math.log(0.9), math.log(0.1)], [math.log(0.1), math.log(0.9)]])


def estimate(counts: dict[tuple[str, int], float]) -> Potentials:
    """Potentials from counts of (feature, label) and ("pair:parent", child label)."""
    total = [sum(v for (k, y), v in counts.items() if y == label and not k.startswith("pair:")) + PRIOR for label in (0, 1)]
    out = Potentials()
    names = {k for k, _ in counts if not k.startswith("pair:")} | {"name:" + w for w in CONTENT | OTHER}
    for k in names:
        word = k.removeprefix("name:")
        n = [counts.get((k, y), 0) + (PRIOR if word in (OTHER, CONTENT)[y] else 0) for y in (0, 1)]
        odds = math.log((n[1] + 0.5) / total[1]) - math.log((n[0] + 0.5) / total[0])
        limit = 8.0 if word in CONTENT or word in OTHER else 3.0 if k.startswith("name:") else 1.5
        out.trait[k] = max(-limit, min(limit, odds))
    for p in (0, 1):
        row = [counts.get((f"pair:{p}", c), 0) + (9.0 if p == c else 1.0) for c in (0, 1)]
        out.pair[p] = [math.log(0.95 * x / sum(row) + 0.025) for x in row]
    return out


def marginals(nodes: list[Node], pot: Potentials) -> list[float]:
    """Probability of content of every node: messages up, then down the tree."""
    odds = [sum(pot.trait.get(t, 0.0) for t in traits(x)) for x in nodes]
    (a, b), (c, d) = [[math.exp(x) for x in row] for row in pot.pair]
    # beliefs are log odds; a message is the log odds that the other side sees
    up, sent = odds[:], [0.0] * len(nodes)

    def through(z: float, p: float, q: float, r: float, s: float) -> float:
        e = math.exp(max(-50.0, min(50.0, z)))
        return math.log(r + s * e) - math.log(p + q * e)

    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].inline:
            continue
        sent[k] = through(up[k], a, b, c, d)
        up[nodes[k].parent] += sent[k]
    both = up[:]
    for k in range(1, len(nodes)):
        p = nodes[k].parent
        both[k] = up[k] + through(both[p] - sent[k], a, c, b, d)
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) for z in both]


def main_text(page: str | None, pot: Potentials) -> str:
    nodes, blocks = read_page(page)
    if not blocks:
        return ""
    p = marginals(nodes, pot)
    kept = (" ".join("".join(t for k, t in runs if p[k] > 0.5).split()) for runs in blocks)
    return " ".join(text for text in kept if text)


def train(pages: DataFrame, key: str = "page_id", text: str = "html", sample: int = SAMPLE) -> Potentials:
    """Counts over the nodes that label themselves, of at most ``sample`` pages."""
    ship_package(pages.sparkSession)
    ids = pages.select(F.col(key).alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    ids = pages.sparkSession.createDataFrame(ids.collect(), ids.schema)  # sample keys at most
    drawn = pages.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")
    drawn = drawn.groupBy("_id").agg(F.min("_text").alias("_text")).select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in slices(batches, "_text"):
            for page in b.column(0).to_pylist():
                nodes, _ = read_page(page)
                labels = seeds(nodes)
                for node, y in zip(nodes, labels, strict=True):
                    if y is not None:
                        found.update((t, y) for t in traits(node))
                        if node.parent >= 0 and labels[node.parent] is not None:
                            found[f"pair:{labels[node.parent]}", y] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([y for _, y in found], pa.int32()),
                                              pa.array([float(n) for n in found.values()])], ["trait", "label", "n"])

    got = drawn.mapInArrow(run, "trait string, label int, n double").groupBy("trait", "label").agg(F.sum("n").alias("n")).collect()
    return estimate({(r["trait"], r["label"]): r["n"] for r in got})


def extract(pages: DataFrame, pot: Potentials, key: str = "page_id", uri: str = "url", text: str = "html") -> DataFrame:
    """key, uri, text and n_chars of every page."""
    ship_package(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(pot)
    src = pages.select(F.col(key), F.col(uri), F.col(text).alias("_text"))
    schema = src.select(key, uri, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            found = [main_text(p, sent.value) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found), pa.array([len(t) for t in found], pa.int64())], schema.names)

    return src.mapInArrow(run, schema)
