"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into a tree of styles: a node is a path of tags with their classes. A node's content importance is one minus the mean
entropy of its features, the sentences of its text, over the pages that have the node (log pages with the sentence / log pages with the node): what
every page repeats has none, what each page has for itself has all. Its presentation importance is the entropy of the sequences of children that pages give it. A node with l
such sequences has the importance (1 - gamma^l) presentation + gamma^l content, so a leaf has its content's. A second tree merges all hosts; it
speaks for hosts of few pages.

Low is a node, of `LEAST_PAGES` pages at least, whose importance is `GAP` below that of the best node with a tenth of its tree's sentences. Every branch enters the trees, whatever its tags and classes are
called. From each page go the blocks whose node is low in either tree.

The page's own elements are a prior. What HTML itself defines as navigation, headers, footers, asides, forms, dialogs, or as an article within an article (comments)
is left out. A page with an article (or main) element has its text there; inside, low blocks go only if the others hold at least half of the text, so that near copies
of a page do not erase it. Pages of a host with equal html count as one, so that copies are no evidence of boilerplate.

Blocks are what block-level tags enclose; <br> is white space. Character references are decoded, white space becomes one space, and blocks are joined by one
newline in page order. Reading a page takes time linear in its length.

Defined results: null or empty html gives the empty text; a null URL or one without a host belongs to the empty host; unclosed and stray tags are repaired as browsers
do for paragraphs; repeated rows are each extracted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

LEAST_PAGES, GAP, MASS, GAMMA = 8, 0.1, 0.1, 0.9
#: Low nodes that are broadcast at most (16 bytes each); more are joined to the pages that have them.
MOST_BROADCAST = 200_000

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?;|·•«»。]+")

RAW = frozenset({"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"})
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"})
CONTENT = frozenset({"article", "main"})
#: What HTML defines as beside the content, by element and by ARIA role.
OUTSIDE = frozenset({"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "header"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"})
#: Which open element a tag ends, and the elements beyond which it doesn't look.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}
_PARAGRAPH = ("p", ("table", "td", "th", "li", "div", "article", "section"))


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _styled(attributes: str) -> tuple[str, bool]:
    """The style of a tag's attributes (words of classes and id), and whether its role is beside the content."""
    style, out = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            out |= value.strip().lower() in ROLES
        else:
            style += sorted({p.lower() for p in _PART.findall(value)})
    return ".".join(style), out


@dataclass
class Block:
    node: int
    text: str
    outside: bool
    inside: bool


class Page:
    """Blocks of a page's text with their nodes of the style tree, and each node's sequence of children."""

    def __init__(self, html: str | None) -> None:
        self.blocks: list[Block] = []
        self.children: dict[int, list[str]] = {}
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, node, outside, inside
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        if html:
            self._read(html)

    def _flush(self) -> None:
        if not self.text:
            return
        text = _SPACE.sub(" ", entities.unescape("".join(self.text))).strip()
        self.text = []
        if text:
            _, node, outside, inside = self.stack[-1] if self.stack else ("", 0, False, False)
            self.blocks.append(Block(node, text, outside, inside))

    def _close(self, depth: int) -> None:
        gone = [t[0] for t in self.stack[depth:]]
        if any(t not in INLINE for t in gone):
            self._flush()
        self.open.subtract(gone)
        del self.stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        _, node, outside, inside = self.stack[-1] if self.stack else ("", 0, False, False)
        style, role = _styled(attributes) if "=" in attributes else ("", False)
        # The heading of an article may stand in a header of its own; an article in an article is a comment on it.
        outside = outside or role or (tag in OUTSIDE and not (tag == "header" and inside)) or (tag == "article" and self.open["article"] > 0)
        inside = inside or tag in CONTENT
        if tag not in INLINE:
            name = f"{tag}.{style}" if style else tag
            own = self.children.setdefault(node, [])
            if not own or own[-1] != name:
                own.append(name)
            node = _hash(f"{node}/{name}")
        self.open[tag] += 1
        self.stack.append((tag, node, outside, inside))

    def _end_of(self, html: str, start: int) -> int:
        """The place after a tag's '>', which quotes may hide; 0 if it has none. Quotes that don't end, or of more than a hundred values, hide nothing."""
        at = start
        for _ in range(100):
            m = _STOP.search(html, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            if self.last[m[0]] <= m.start():
                break
            at = html.find(m[0], m.end()) + 1
        return html.find(">", start) + 1

    def _tag(self, html: str, at: int, tag: str, attributes: str, closing: bool) -> int:
        """Takes a tag and returns where to go on."""
        if closing:
            if tag == "br":
                self.text.append(" ")
            elif self.open[tag] > 0:
                self._close(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))
            elif tag not in INLINE:
                self._flush()
        elif tag in RAW:
            if not (tag in ("svg", "math") and attributes.rstrip().endswith("/")):
                end = _RAW_END[tag].search(html, at)
                return (html.find(">", end.end()) + 1 if end else 0) or len(html)
        elif tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self.text.append(" ")
        else:
            if tag not in INLINE:
                # Text so far belongs to the block that is open; a block also ends an open paragraph, an item the item before.
                self._flush()
                ends, beyond = _ENDS.get(tag, _PARAGRAPH)
                if self.open[ends] > 0:
                    for i in range(len(self.stack) - 1, -1, -1):
                        if self.stack[i][0] == ends:
                            self._close(i)
                            break
                        if self.stack[i][0] in beyond:
                            break
            self._open(tag, attributes)
        return at

    def _read(self, html: str) -> None:
        self.last = {q: html.rfind(q) for q in "\"'"}
        at, n = 0, len(html)
        while at < n:
            sign = html.find("<", at)
            if sign < 0:
                self.text.append(html[at:])
                break
            if sign > at:
                self.text.append(html[at:sign])
            if html.startswith("<!--", sign):
                end = html.find("-->", sign + 4)
                at = end + 3 if end >= 0 else n
            elif html.startswith("<![CDATA[", sign):
                end = html.find("]]>", sign)
                self.text.append(html[sign + 9 : end if end >= 0 else n].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else n
            elif m := _NAME.match(html, sign + 1):
                end = self._end_of(html, m.end())
                if not end:  # what follows has no tags
                    self.text.append(html[sign:])
                    break
                at = self._tag(html, end, m[2].lower(), html[m.end() : end - 1], bool(m[1]))
            elif html[sign + 1 : sign + 2] in ("!", "?") and (end := html.find(">", sign)) >= 0:
                at = end + 1
            else:
                self.text.append("<")
                at = sign + 1
        self._flush()
        self.stack.clear()


def sentences(text: str) -> set[str]:
    """The features of a block."""
    return {s for part in _SENTENCE.split(text) if (s := part.strip())}


#: The tree of all hosts. No host is called so: hosts are hashed with a colon before.
ALL = 0


def host_key(host: str) -> int:
    return _hash(f":{host}")


def main_text(page: Page, low: dict[int, set[int]] | None = None, host: str = "") -> str:
    """The page's blocks without what is beside the content and those whose nodes are low. low: the low nodes of each tree, by host_key() or ALL."""
    blocks = [b for b in page.blocks if not b.outside]
    main = any(b.inside for b in blocks)
    blocks = [b for b in blocks if b.inside or not main]
    if low:
        gone = low.get(host_key(host), set()) | low.get(ALL, set())
        kept = [b for b in blocks if b.node not in gone]
        if not main or 2 * sum(len(b.text) for b in kept) >= sum(len(b.text) for b in blocks):
            blocks = kept
    return "\n".join(b.text for b in blocks)


_SEEN = {"host": pa.int64(), "page": pa.int64(), "node": pa.int64(), "kind": pa.int32(), "feature": pa.int64()}


def page_key(host: str, html: str) -> int:
    return _hash(f"{host}\n{html}")


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, page, node, kind, feature) of each page: kind 0 a node with text is there, 1 a sentence of it, 2 its sequence of children."""
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                page, host = Page(html), host_of(url)
                h, p = host_key(host), page_key(host, html or "")
                seen = set()
                for b in page.blocks:
                    seen.add((h, p, b.node, 0, 0))
                    seen.update((h, p, b.node, 1, _hash(s)) for s in sentences(b.text))
                    if b.node in page.children:
                        seen.add((h, p, b.node, 2, _hash(" ".join(page.children[b.node]))))
                rows += seen
            cols = list(zip(*rows)) or [()] * len(_SEEN)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SEEN.values())], names=list(_SEEN))


def observed(pages: DataFrame) -> DataFrame:
    return pages.select("url", "html").mapInArrow(_observed, "host bigint, page bigint, node bigint, kind int, feature bigint")


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, pages, mass, importance) of the merged trees' nodes with text; host is ALL for the tree of all hosts. mass: sentences on all pages."""
    own = cut(observed(pages).groupBy("host", "node", "kind", "feature").agg(F.countDistinct("page").alias("c")))
    both = own.unionByName(own.groupBy("node", "kind", "feature").agg(F.sum("c").alias("c")).withColumn("host", F.lit(ALL).cast("bigint")))
    c = F.col("c").cast("double")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    nodes = both.groupBy("host", "node").agg(
        F.max(of(0, F.col("c"))).alias("pages"), F.sum(of(1, F.col("c"))).alias("mass"), F.avg(of(1, F.log(c))).alias("content"),
        F.sum(of(2, c * F.log(c))).alias("clogc"), F.sum(of(2, c)).alias("styled"), F.count(of(2, F.lit(1))).alias("l"),
    )
    m = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    presentation = F.coalesce((F.log("styled") - F.col("clogc") / F.col("styled")) / m, F.lit(0.0))
    content = 1 - F.coalesce("content", F.lit(0.0)) / m
    share = F.pow(F.lit(GAMMA), F.col("l"))
    return nodes.select("host", "node", "pages", F.coalesce("mass", F.lit(0)).alias("mass"), F.when(F.col("pages") < 2, 1.0).otherwise((1 - share) * presentation + share * content).alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, node) of the nodes whose importance removes them."""
    nodes = cut(importance(pages))
    total = nodes.groupBy("host").agg(F.sum("mass").alias("total"))
    best = nodes.join(total, "host").where(F.col("mass") >= MASS * F.col("total")).groupBy("host").agg(F.max("importance").alias("best"))
    low = nodes.where(F.col("pages") >= LEAST_PAGES).join(best, "host").where(F.col("importance") < F.col("best") - GAP)
    return low.select("host", "node")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = cut(low_branches(rows))
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def written(batch: pa.RecordBatch, lows) -> pa.RecordBatch:
        urls = batch.column("url").to_pylist()
        texts = [main_text(Page(h), lo, host_of(u)) for u, h, lo in zip(urls, batch.column("html").to_pylist(), lows)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if low.count() <= MOST_BROADCAST:
        trees: dict[int, set[int]] = {}
        for r in low.collect():
            trees.setdefault(r["host"], set()).add(r["node"])
        shared = spark.sparkContext.broadcast(trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "html"):
                    yield written(part, [shared.value] * part.num_rows)

        return rows.mapInArrow(run, schema)

    # Each page gets the low nodes that it has itself, whichever tree says so: no more than its own blocks.
    there = observed(rows).where("kind = 0").select("host", "page", "node").distinct()
    own = there.join(low, ["host", "node"]).select("page", "node").unionByName(there.join(low.where(F.col("host") == ALL).select("node"), "node").select("page", "node"))
    lists = own.groupBy("page").agg(F.collect_set("node").alias("low"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [page_key(host_of(u), h or "") for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["page_id", "url", "html", "page"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield written(part, [{ALL: set(x or ())} for x in part.column("low").to_pylist()])

    pages_ = rows.mapInArrow(keyed, "page_id bigint, url string, html string, page bigint")
    return pages_.join(lists, "page", "left").select("page_id", "url", "html", "low").mapInArrow(joined, schema)
