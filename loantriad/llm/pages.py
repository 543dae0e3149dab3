"""Main text of web pages by composite text density.

A page becomes a tree of nodes. For every node, with C characters of text below it, T tags, LC characters inside links
and LT link tags, and the body's ratio LCb / Cb, the composite density is

    C / T * log_b( C * T / (LC * LT) ),   b = ln( C / nonlink * LC + LCb / Cb * C + e ),   nonlink = C - LC,

all counts at least 1: long text with few tags and few links is dense. A node's density sum adds the densities of
the blocks below it. The node with the greatest density sum gives the threshold: the least density on its path from the body. In
every block that reaches the threshold, the subtree with the greatest density sum is marked; an article or main element
around a mark is the content's frame, without one the least subtree around all marks is. Inside the frame, what holds no marked block and
is mostly links (three or more of them, with over half of its characters) goes: lists of links without a telling name. Parts that by tag, role or name are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments
are left out; they are left out of the counts as well, so that a long menu doesn't outweigh a short article.

Text blocks end where block tags begin or end. White space inside a block becomes one space; blocks are joined by an
empty line. Character references are decoded once.

Defined results: null or empty html, and pages without text outside left-out parts, give an empty string; broken markup
closes where HTML would close it, a cut-off tag is dropped; each row is read alone, so repeated rows repeat; an empty
table gives an empty table. Only page_id, url and html are read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loantriad.llm.common import beside, row_by_row, table
from loantriad.llm.registry import corpus_query

# What HTML itself says about its tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li option tbody td tfoot th thead title tr".split())
#: An opening tag on the left closes an open tag on the right, up to the given container.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Tags and roles that never hold article text.
LEFT_TAGS = frozenset(
    "head title script style noscript template nav header footer aside form button input select textarea datalist dialog "
    "iframe object embed applet canvas svg math audio video map menu noframes".split())
LEFT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words in class and id names that mark such parts.
LEFT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie "
    "cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice popup modal promo promotion related "
    "replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets gdpr paywall "
    "pagination pager login signup".split())
#: Tags that are the page or the article itself, whatever their names say.
NEVER_LEFT = frozenset("html body main article".split())
#: A block without a marked one needs this many links to count as a list of links: a heading or line that is one link stays.
LIST_LINKS = 3
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parts", "left", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent")

    def __init__(self, tag: str, parent: "Node | None", left: bool):
        self.tag, self.parent, self.left = tag, parent, left
        self.parts: list = []  # text and child nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def left_out(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in LEFT_TAGS:
        return True
    if tag in NEVER_LEFT:
        return False
    for name, value in attrs:
        value = value or ""
        if name == "role" and value.strip().lower() in LEFT_ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and any(w.lower() in LEFT_NAMES for w in _NAME_PARTS.findall(value)):
            return True
    return False


class TreeBuilder(HTMLParser):
    """Builds the tree and closes what HTML closes by itself."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None, False)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body") and len(self.open) == 1:
            return
        if tag in CLOSES_P:
            self._close_p()
        if tag in SIBLINGS:
            names, walls = SIBLINGS[tag]
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in walls:
                    break
                if self.open[at].tag in names:
                    del self.open[at:]
        top = self.open[-1]
        node = Node(tag, top, top.left or left_out(tag, attrs))
        top.parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _close_p(self) -> None:
        """An open paragraph ends, unless a block lies between it and here."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == "p":
                del self.open[at:]
                return
            if self.open[at].tag in BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if tag not in BLOCK and self.open[at].tag in BLOCK:
                return  # an inline end tag doesn't close blocks

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def in_order(root: Node) -> list[Node]:
    """Parents before children, without left-out parts."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.left:
            continue
        found.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return found


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes that aren't left out."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.left:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    ratio = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * lc + ratio * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1e-9)) / math.log(base) if base > 1.0000001 else c / t
        # densities of the nearest blocks below; inline tags stand between, but are no parts of a page by themselves
        node.total = sum(
            p.density if p.tag in BLOCK else p.total for p in reversed(node.parts) if isinstance(p, Node) and not p.left)
    return nodes


def main_nodes(root: Node) -> tuple[set[int], set[int]]:
    """Identities of the nodes that frame the content, and of those below that are lists of links."""
    nodes = measure(root)
    threshold, node = math.inf, max(nodes, key=lambda n: n.total)  # the first, so the highest, of equals
    while node is not None:
        if node.chars:
            threshold = min(threshold, node.density)
        node = node.parent
    best: dict[int, Node] = {}
    for node in reversed(nodes):  # children first
        top = node
        for part in node.parts:
            if isinstance(part, Node) and not part.left and best[id(part)].total > top.total:
                top = best[id(part)]
        best[id(node)] = top
    marked = [best[id(n)] for n in nodes if n.chars and n.density >= threshold and (n.tag in BLOCK or n is root)]
    holds: set[int] = set()
    for node in marked:
        while node is not None and id(node) not in holds:
            holds.add(id(node))
            node = node.parent
    lists = {id(n) for n in nodes if n.tag in BLOCK and id(n) not in holds and n.link_tags >= LIST_LINKS and 2 * n.link_chars > n.chars}
    return {id(n) for n in _whole(marked)}, lists


def _whole(marked: list[Node]) -> list[Node]:
    """The article elements around marked nodes; where there are none, the least subtree with all marked nodes."""
    around, bare = {}, []
    for node in marked:
        up = node
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        if up is None:
            bare.append(node)
        else:
            around[id(up)] = up
    if around:
        return list(around.values())
    paths = []
    for node in bare:
        path = []
        while node is not None:
            path.append(node)
            node = node.parent
        paths.append(path[::-1])
    common = None
    for level in zip(*paths):
        if any(n is not level[0] for n in level):
            break
        common = level[0]
    return [common] if common is not None else []


def blocks(root: Node, content: set[int], lists: set[int]) -> list[str]:
    """Text blocks of the content nodes in page order, without ``lists``."""
    out: list[str] = []
    current: list[str] = []

    def close() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            out.append(text)

    todo: list = [(root, False)]
    while todo:
        part, inside = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            if inside:
                current.append(part)
        elif part.tag == "br":
            current.append(" ")
        elif part.left or id(part) in lists:
            if part.tag in BLOCK:
                close()
        else:
            inside = inside or id(part) in content
            if part.tag in BLOCK:
                close()
                todo.append((None, inside))
            todo += [(p, inside) for p in reversed(part.parts)]
    close()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return "\n\n".join(blocks(builder.root, *main_nodes(builder.root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [main_text(html) for html in frame["html"]]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return beside(pages, ["page_id", "url"], ["html"], row_by_row(run), "text string, n_chars long")


@corpus_query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
