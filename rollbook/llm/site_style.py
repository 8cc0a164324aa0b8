"""Main text of web pages by a site style tree.

The trees of all pages of one host are merged: a node of the style tree is a path of
elements with their classes. Its importance joins two entropies, both with the number of
its pages as base: that of its presentations (the sequences of child elements), and that of
its contents - a text that stands on all pages of a node has entropy one and no importance,
one that stands on a single page has full importance. Pages of one text are one page there,
under whatever addresses, so copies do not make a text look like a notice. Branches of low importance are
removed from each page; what is left is its text.

What an element says of itself is its presentation as well, and is known without a second
page: menus, headers, footers, sidebars, notices, adverts, forms, comments and the like (by
element, role, class or id) have no importance, and an article or a main element has, so it
is never removed, nor is what stands around it, and on a page that has one nothing outside it counts.
Class words of an article itself, those of layout states and a header block inside an
article do not make noise. Branches below a main element are in the style tree as well and
go like others, unless that would take more than half of the page's text: then it is the
article itself that stands on several pages.

The tree is a set of aggregates by (host, path): one row for each path of a page, partial
sums before the shuffle, so a hot host is a few rows per task. Low branches of a page are
written first, and Spark joins them to the pages as their measured size allows.

Cases: null and empty html have an empty text. Broken and cut off pages are read as far as
they go. Pages without a host form one site of their own each and keep all
branches. Hosts of few pages keep all branches that do not call themselves otherwise.
Repeated rows each get their row, an empty table gives an empty result. Only id, url and html are read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, content_key, text_of, written

#: Pages of a node from which its entropies count, share of the content in its importance,
#: and the importance below which a branch goes.
PAGES, CONTENT, LOW = 5, 0.9, 0.25

# Element names and words of HTML and of common templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select textarea object svg canvas head title menu dialog label input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice popup promo related respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
MAIN = frozenset(("article", "main"))
_SPACE = re.compile(r"\s+")
#: Class names that tell a state of the layout, as no-sidebar, content-with-sidebar and comments-open do.
_STATE = re.compile(r"(^|[-_])(no|has|with|without)[-_]|[-_](open|closed|enabled|disabled)$")
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class Node:
    __slots__ = ("tag", "label", "parent", "children", "noise", "main", "kept")

    def __init__(self, tag: str, label: str, parent: Node | None, noise: bool, main: bool):
        self.tag, self.label, self.parent, self.noise, self.main = tag, label, parent, noise, main
        self.kept = False  # is a main element or holds one
        self.children: list[Node | str] = []


class Tree(HTMLParser):
    """A tolerant tree: a block closes an open paragraph, end tags close what they can."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None, False, False)
        self.has_main = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._close_paragraph()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_same(tag)
        values = {k: v or "" for k, v in attrs}
        names = f"{values.get('class', '')} {values.get('id', '')}".lower().split()
        words = {w for name in names if not _STATE.search(name) for w in re.split(r"[^a-z0-9]+", name)}
        main = tag in MAIN or values.get("role") == "main"
        inside = self.at.main
        noise = tag in NOISE_TAGS or (tag == "header" and not inside) or values.get("role") in NOISE_ROLES or "hidden" in values
        # a main element wins over its words, and a header inside of one holds its title
        named = words & NOISE_WORDS - ({"header"} if inside else set())
        noise = noise or bool(named and not main and tag not in ("html", "body"))
        noise = self.at.noise or noise
        self.has_main |= main and not noise
        node = Node(tag, f"{tag}.{values.get('class', '')}", self.at, noise, (inside or main) and not noise)
        self.at.children.append(node)
        above = node if main and not noise else None
        while above is not None and not above.kept:
            above.kept, above = True, above.parent
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag does not close a block
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _close_paragraph(self) -> None:
        node = self.at
        while node.parent is not None and (node.tag == "p" or node.tag not in BLOCKS):
            if node.tag == "p":
                self.at = node.parent
                return
            node = node.parent

    def _close_same(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag not in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select"):
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent


def parsed(html: str) -> Tree:
    tree = Tree()
    tree.feed(_CUT_TAG.sub("", html))
    tree.close()
    return tree


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - 2**63


def walk(tree: Tree):
    """(node, path) of all branches that do not call themselves noise; parents first."""
    start = "with main" if tree.has_main else "without"
    todo = [(tree.root, _hash(start))]
    while todo:
        node, path = todo.pop()
        yield node, path
        todo += [(c, _hash(str(path), c.label)) for c in reversed(node.children) if isinstance(c, Node) and not c.noise]


def text_under(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            parts.append(n)
        elif not n.noise:
            todo += reversed(n.children)
    return _SPACE.sub(" ", " ".join(parts)).strip()


def branches(tree: Tree) -> dict[int, tuple[int, int]]:
    """By path: its presentation and its content on this page. Main elements and what holds them are not
    listed, nor what lies outside them."""
    shown: dict[int, list[str]] = {}
    held: dict[int, list[str]] = {}
    for node, path in walk(tree):
        if node.parent is not None and not node.kept and node.main == tree.has_main and node.tag not in ("html", "body"):
            tags = [c.label for c in node.children if isinstance(c, Node)]
            shown.setdefault(path, []).append(",".join(t for i, t in enumerate(tags) if not i or t != tags[i - 1]))
            held.setdefault(path, []).append(text_under(node))
    return {p: (_hash(*shown[p]), _hash(*held[p])) for p in shown}


def page_of(tree: Tree) -> int:
    """What pages of one text have in common: a hash of the text of its main elements, or of all of it."""
    tops = [n for n, _ in walk(tree) if n.main and not n.parent.main] if tree.has_main else [tree.root]
    return _hash(*map(text_under, tops))


def main_text(tree: Tree, low: set[int]) -> str:
    """The blocks of what is left, in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        block = _SPACE.sub(" ", "".join(line)).strip()
        if block:
            blocks.append(block)
        line.clear()

    start = "with main" if tree.has_main else "without"
    todo: list = [(tree.root, _hash(start))]
    while todo:
        item = todo.pop()
        if item is None:
            end()
            continue
        node, path = item
        if isinstance(node, str):
            line.append(node)
            continue
        if node.noise or path in low and not node.kept:
            continue
        if node.tag == "br":
            line.append(" ")
        children = [(c, path if isinstance(c, str) else _hash(str(path), c.label)) for c in node.children]
        if tree.has_main and not node.main:
            children = [c for c in children if isinstance(c[0], Node)]
        if node.tag in BLOCKS:
            end()
            todo.append(None)
        todo += reversed(children)
    end()
    text = "\n".join(blocks)
    if tree.has_main and low:
        whole = main_text(tree, set())
        return whole if 2 * len(text) < len(whole) else text
    return text


def nodes(pages: DataFrame) -> DataFrame:
    """site, path, shown, held of the branches of every page with a host, with what stands for its text and its key."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for k1, k2, url, html in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "url", "html")), strict=True):
                host = host_of(url)
                if not host:
                    continue
                tree = parsed(html)
                site, page = _hash(host), page_of(tree)
                rows += [(site, path, shown, held, page, k1, k2) for path, (shown, held) in branches(tree).items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["site", "path", "shown", "held", "page", "k1", "k2"])

        return each

    return arrow_rows(pages, make, "site long, path long, shown long, held long, page long, k1 long, k2 long")


def importance(found: DataFrame) -> DataFrame:
    """(site, path, importance) of the merged tree's nodes that have enough pages; copies of a page count once."""
    once = found.groupBy("site", "path", "page").agg(F.min(F.struct("shown", "held")).alias("x")).select("site", "path", "x.*")

    def entropy(of: str) -> DataFrame:
        counts = once.groupBy("site", "path", of).agg(F.count("*").alias("c"))
        n, log_sum = F.sum("c"), F.sum(F.col("c") * F.log("c"))
        # sum of c log c over n log n: one if all pages agree, nought if all differ
        return counts.groupBy("site", "path").agg(n.alias("pages"), (log_sum / (n * F.log(n))).alias(of))

    shown, held = entropy("shown").where(F.col("pages") >= PAGES), entropy("held").where(F.col("pages") >= PAGES).drop("pages")
    value = 1 - ((1 - CONTENT) * F.col("shown") + CONTENT * F.col("held"))
    return shown.join(held, ["site", "path"]).select("site", "path", value.alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    url, html = F.col(url_col).cast("string"), text_of(html_col)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    source = source.select("*", *content_key(F.concat_ws("\x1f", F.coalesce("url", F.lit("")), "html")))
    found = written(nodes(source), "branches")
    low = importance(found).where(F.col("importance") < LOW).select("site", "path")
    removed = written(found.join(low, ["site", "path"]).groupBy("k1", "k2").agg(F.collect_set("path").alias("low")), "removed")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(parsed(html), set(low or ())) for html, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

        return each

    joined = source.join(removed, ["k1", "k2"], "left").select("page_id", "url", "html", "low")
    return arrow_rows(joined, make, "page_id long, url string, text string, n_chars long")
