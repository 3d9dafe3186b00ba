"""Main text of web pages by a site style tree: what pages of one host repeat is noise, what they vary is content.

The pages of a host are merged: elements with the same labels from the root down are one node.
A node's presentation is the order of its children's labels; its content are the texts and link
targets right under it. Both have an importance by entropy, and a branch that is unimportant all
over its host goes from each page. Where a host has too few pages to tell, and within it, names
tell: elements such as nav and footer, and classes such as menu or advert.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import BROADCAST_ROWS, bounded, stored
from skein.llm.url_filter import host_of
from skein.llm.words import lean

#: Pages that a node needs to be judged; importance below which its branch goes; importance that its whole host must have, so that hosts of copies aren't judged.
MIN_PAGES, NOISE, VARIED = 10, 0.2, 0.5
#: Weight of the content against the presentation, to the power of the presentations.
GAMMA = 0.9
#: Elements below this depth count as part of the one above them.
DEPTH = 32

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
NOT_TEXT = frozenset("head title script style noscript template iframe object svg canvas math audio video select textarea button datalist".split())
APART = frozenset("nav aside footer form dialog menu".split())
#: Elements that end an open one of the same kind, and where the search for it stops.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of class, id and role that mark what isn't the article.
MARKED = frozenset(
    "nav navbar navigation menu topbar masthead footer contentinfo sidebar complementary ad ads advert advertisement adsense adslot sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal dialog overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments disqus respond reply replies widget skip search hidden".split()
)


#: Comments; tags, with quoted attributes or as they come; declarations. Tags that the page's end cuts off, and text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<(?:[A-Za-z][^>]*)?\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content isn't marked up.
RAW = {t: re.compile(f"</{t}[\\s/>]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(1 << 16)
def _hash(*parts: object) -> int:
    return _digest("\x00".join(map(str, parts)))


@lru_cache(1 << 14)
def _named(tag: str, attributes: str) -> tuple[str, frozenset[str], str]:
    """(label, words of class, id and role, link target) of a start tag."""
    a: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        a.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = " ".join(a.get(k, "") for k in ("class", "id", "role")).lower()
    words = frozenset(w for w in re.split(r"[^a-z]+", names) if w)
    label = tag + "." + re.sub(r"\d{3,}", "0", ".".join(sorted(names.split())))
    return label, words | ({"hidden"} if "hidden" in a else frozenset()), a.get("href", "") if tag == "a" else ""


class Element:
    __slots__ = ("tag", "label", "parent", "children", "words", "texts", "links", "node", "depth", "chars", "holds", "part", "gone")

    def __init__(self, tag: str, label: str, words: frozenset, parent: Element | None):
        self.tag, self.label, self.words, self.parent = tag, label, words, parent
        self.children: list[Element] = []
        self.texts: list[str] = []
        self.links: list[str] = []
        self.node = self.depth = self.chars = 0
        self.holds = self.gone = False
        self.part = ""


class Page:
    """A page as a tree of elements and a list of text pieces with their element, None where a block begins or ends."""

    def __init__(self, html: str):
        self.root = self.at = Element("", "", frozenset(), None)
        self.pieces: list[tuple[Element, str] | None] = []
        at = begun = 0  # where to look for a tag, and where the text before it began
        while (at := html.find("<", at)) >= 0:
            m = TOKEN.match(html, at)
            if m is None:
                at += 1
                continue
            if at > begun:
                self._text(html[begun:at])
            at = begun = m.end()
            close, tag, attributes = m.groups()
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if tag not in INLINE:
                    self.pieces.append(None)
                self._end((tag,), blocks=tag not in INLINE)
                continue
            self._start(tag, attributes or "")
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.start() if end else len(html)
        if begun < len(html):
            self._text(html[begun:])

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._end(("p",), blocks=False)
            self.pieces.append(None)
        if tag in SIBLINGS:
            self._end(SIBLINGS[tag], STOPS[tag])
        label, words, link = _named(tag, attributes)
        e = Element(tag, label, words, self.at)
        self.at.children.append(e)
        if link:
            self.at.links.append(link)
        if tag not in VOID:
            self.at = e

    def _text(self, data: str) -> None:
        data = unescape(data) if "&" in data else data
        self.pieces.append((self.at, data))
        if not data.isspace():
            self.at.texts.append(data)

    def _end(self, tags: tuple, stops: tuple = (), blocks: bool = True) -> None:
        """Close the innermost open element of ``tags``, unless one of ``stops`` or, without ``blocks``, a block lies before it."""
        e = self.at
        while e.parent is not None:
            if e.tag in tags:
                self.at = e.parent
                return
            if e.tag in stops or (not blocks and e.tag not in INLINE):
                return
            e = e.parent

    def place(self, host: str) -> list[Element]:
        """Nodes of the elements: a hash of the host and the labels from the root down; inline ones are part of their block. Parents come before their children."""
        self.root.node, order = _hash(host), [self.root]
        for e in order:
            for c in e.children:
                c.depth = e.depth + 1
                c.node = _hash(e.node, c.label) if c.depth < DEPTH and c.tag not in INLINE else e.node
            order.extend(e.children)
        return order


def _facts(page: Page, host: str) -> Iterator[tuple]:
    """(node, path, host, token) of each presentation and (node, None, None, token) of each text and link of a page, once each."""
    paths: dict[int, tuple[int, ...]] = {}
    styles: dict[int, set] = {}
    content: set[tuple[int, int]] = set()
    for e in page.place(host):
        node = e.node
        if node not in paths:
            paths[node] = (*(paths[e.parent.node] if e.parent is not None else ()), node)
        if e.tag not in INLINE:
            last, labels = "", []
            for c in e.children:
                if c.label != last and c.tag not in INLINE:
                    last = c.label
                    labels.append(last)
            styles.setdefault(node, set()).add(" ".join(labels))
        for t in e.texts:
            content.add((node, "text\x00" + " ".join(t.split())))
        for x in e.links:
            content.add((node, "link\x00" + x))
    for node, s in styles.items():
        yield node, paths[node], host, _hash("style", *sorted(s))
    for node, what in content:
        yield node, None, None, _digest(what)


_FACTS = pa.schema([("node", pa.int64()), ("path", pa.list_(pa.int64())), ("host", pa.string()), ("token", pa.int64()), ("n", pa.int64())])


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of pages (host, html), counted by batch."""
    for b in batches:
        counts: Counter = Counter()
        for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            counts.update(_facts(Page(html.as_py()), host))
        rows = list(counts.items())
        yield pa.record_batch([pa.array([f[i] for f, _ in rows], _FACTS.types[i]) for i in range(4)] + [pa.array([n for _, n in rows], pa.int64())], schema=_FACTS)


def style_tree(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, node, path, pages, presentations, presentation, content, importance) of the merged pages (url, html) of each host.

    ``presentation`` is the entropy of a node's presentations over its pages, to the base of the pages. A text or link on
    k of m pages has the entropy log k to the base m; ``content`` is 1 less the mean of those, over all
    nodes of the branch, null if it has none. ``importance`` weighs both: the more presentations there are, the less the content counts.
    Everything is counted before it is shuffled; rows grow with the sites' distinct texts. Pages without a host aren't merged.
    """
    bounded(spark)
    given = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> '' and html is not null")
    facts = stored(spark, given.mapInArrow(_counted, "node long, path array<long>, host string, token long, n long"), "style-facts")
    c, m = F.col("c"), F.col("m")
    styles = facts.where("host is not null").groupBy("node", "path", "host", "token").agg(F.sum("n").alias("c"))
    styles = styles.groupBy("node", "path", "host").agg(F.sum("c").alias("m"), F.count("*").alias("presentations"), F.sum(c * F.ln(c)).alias("clogc"))
    texts = facts.where("host is null").groupBy("node", "token").agg(F.sum("n").alias("c")).groupBy("node").agg(F.count("*").alias("l"), F.sum(F.ln("c")).alias("logs"))
    base = F.greatest(F.ln(m), F.lit(1e-9))
    nodes = styles.join(texts, "node", "left").withColumns({"l": F.coalesce("l", F.lit(0)), "own": F.coalesce(F.col("l") - F.col("logs") / base, F.lit(0.0))})
    nodes = stored(spark, nodes, "style-nodes")
    branch = nodes.select(F.explode("path").alias("node"), "l", "own").groupBy("node").agg(F.sum("l").alias("l"), F.sum("own").alias("own"))
    branch = branch.select("node", F.when(F.col("l") > 0, F.col("own") / F.col("l")).alias("content"))
    presentation = F.when(m > 1, F.greatest(F.ln(m) - F.col("clogc") / m, F.lit(0.0)) / base).otherwise(1.0)
    weight = F.pow(F.lit(GAMMA), F.col("presentations"))
    out = nodes.withColumn("presentation", presentation).join(branch, "node")
    return out.select("host", "node", "path", m.alias("pages"), "presentations", "presentation", "content", ((1 - weight) * F.col("presentation") + weight * F.col("content")).alias("importance"))


def noise(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """(host, nodes): the nodes of each host whose branches go; hosts without any have no row."""
    varied = tree.where(f"size(path) = 1 and content >= {VARIED}").select("host")
    low = tree.where(f"pages >= {MIN_PAGES} and importance < {NOISE} and size(path) > 1").join(varied, "host", "left_semi")
    return stored(spark, low.groupBy("host").agg(F.collect_set("node").alias("nodes")), "style-noise")


def main_text(page: Page, host: str, noisy: frozenset[int]) -> str:
    """The text of a page's article, or of its main part, or of its body, without noise."""
    order = page.place(host)
    for e in reversed(order):
        for t in e.texts:
            e.chars += len(t)
        main = e.tag == "main" or "main" in e.words
        e.part = "article" if e.tag == "article" else "main" if main else ""
        e.holds = e.holds or main or e.tag in ("h1", "article")
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.holds = e.parent.holds or e.holds
    for e in order[1:]:
        up = e.parent
        if up.gone:
            e.gone = True
            continue
        if e.tag in INLINE and not e.words:
            e.part = up.part
            continue
        nested = e.part == up.part == "article"  # an article in an article is a comment on it
        named = not e.words.isdisjoint(MARKED) and not (e.holds and e.words.isdisjoint(("comment", "comments")))
        repeated = e.node in noisy and e.tag not in INLINE and 2 * e.chars <= page.root.chars
        e.gone = e.tag in NOT_TEXT or e.tag in APART or nested or named or repeated or (e.tag == "header" and not up.part)
        e.part = up.part if up.part == "article" else e.part or up.part
    for wanted in (("article",), ("article", "main"), ("article", "main", "")):
        blocks, block = [], []
        for p in (*page.pieces, None):
            if p is None:
                if block and (t := " ".join("".join(block).split())):
                    blocks.append(t)
                block = []
            elif not p[0].gone and p[0].part in wanted:
                block.append(p[1])
        if blocks:
            return " ".join(blocks)
    return ""


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages`` (page_id, url, html); pages are parsed twice and shuffled only if the noise is large.

    A null or empty html, and a page without an article, give an empty text; null urls have no host
    and are judged by names alone. Repeated rows each keep theirs; a very long page is one row and must fit a task;
    an empty table gives no rows; other columns are not looked at. A block that is noise by its host
    stays if it holds over half of its page. A host's noise is one array: it grows with
    its templates, not with its pages.
    """
    noisy = noise(spark, style_tree(spark, pages))
    few = noisy.agg(F.sum(F.size("nodes")).alias("n")).first().n or 0
    host = pages.select("page_id", "url", "html").withColumn("_host", host_of(F.col("url")))
    joined = host.join(F.broadcast(noisy) if few <= BROADCAST_ROWS else noisy, F.col("_host") == noisy["host"], "left").select("page_id", "url", "_host", "nodes", "html")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for h, nodes, html in zip(b.column("_host").to_pylist(), b.column("nodes"), b.column("html"), strict=True):
                html = html.as_py()
                texts.append(main_text(Page(html), h, frozenset(nodes.as_py() or ())) if html else "")
            yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


# The given pages have one article each, with blocks of p, h1 and br and inline b, so SQL finds their text by patterns.
ORACLE = r"""
with a as (select page_id, url, regexp_replace(coalesce(html, ''), '<[A-Za-z/!?]?[^<>]*$', '') as html from pages),
b as (select page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) as body from a),
c as (select page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^<>]*>', ' ', 'g') as t from b),
d as (select page_id, url, trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g')) as text from c)
select page_id, url, text, length(text)::bigint as n_chars from d
"""
