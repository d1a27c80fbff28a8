"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: its nodes are element paths (names with classes), and a node counts, over
the pages that have it, in how many ways its children follow each other (presentation) and which texts its branch holds
(content). A text, or a way, that c of n pages have has the entropy ln c / ln n as a feature of the node. It is taken
twice: over the host's pages, and over the pages of all hosts that have the node's pool, which is its name and class, or
its path if it has no class; the larger one counts, so both what a host repeats and what many hosts rotate
stand out, while another host's repeats don't touch a node with texts of its own. A node's presentation and content
are 1 minus the mean entropy of what its pages have, and its importance is 1 - (1 - presentation) * (1 - content).

Few pages say little: a host's entropies weigh n / (n + ``PRIOR``), and an importance is shrunk, by the pages of the pool,
towards 1, or 0 if a class names an advert, a notice, a menu or a sidebar, with the weight of ``PRIOR`` pages. So the
names decide on a handful of pages and the entropies on all others; there is no least number of pages. Whether a page
has an article plays no part in a node's importance. Branches of low importance go.

Beside that, elements that HTML itself marks as no main text go (menus, headers, footers, sidebars, forms, scripts,
styles, hidden parts), so do roles that say the same and reader comments.

Copies say nothing about what a host repeats around its texts, so the tree counts the looks of a node (way and text)
once for each different main block. An article or main element and what is above it are never removed for their
importance; branches inside have a lower limit, as bylines and captions repeat too, and stay if they are more than half of
the article's text: pages so alike are near copies. For their sake an article's headings stay as well.

The tree's counts are sums by (host, node, way, text), over rows that are made distinct by these and the hash of the main
block in tasks of any part of a host, so no task gathers a host's pages.

Defined results: a null html is an empty text; pages without a host share one tree; rows that repeat a page_id are rows
of their own; markup that isn't closed ends with the page; columns named like an output are replaced.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraline.llm.bpe import _with
from terraline.session import fits, written

#: Below this importance a branch goes: outside of articles, and inside.
LOW_IMPORTANCE, LOW_INSIDE = 0.85, 0.6
#: Pages that what is assumed of a node before any is read weighs.
PRIOR = 30
#: More judged nodes than this meet the pages of their host in a shuffle instead of a broadcast.
MAX_BROADCAST_NODES = 100_000
#: Pages of a host that meet its judged nodes in one group of rows.
PAGES_AT_ONCE = 5_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_LOOKED_AT = re.compile("class|id|role|hidden|style", re.I)

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head script style textarea title noscript template iframe xmp noembed noframes nav footer aside form button select option menu dialog svg canvas video audio".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of these ends an open one of the same set.
SIBLINGS = ({"p"}, {"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"})
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Roles that mark no main text, and classes or ids of reader comments.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENTS = frozenset("comment comments comment-list comments-area disqus_thread respond".split())
#: Classes whose nodes are assumed to be of no importance until pages say otherwise.
DOUBTFUL = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies menu nav navbar newsletter notice notices pagination promo sidebar sponsored".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _mixed(h: int, x: int) -> int:
    return (h * 0x9E3779B97F4A7C15 + x + 1) & 0xFFFFFFFFFFFFFFFF


@lru_cache(100_000)
def _path(above: int, name: str, classes: str) -> int:
    return xxhash.xxh64_intdigest(f"{above}/{name}.{classes}")


class _Node:
    __slots__ = ("name", "path", "label", "off", "main", "low", "block", "doubtful", "holds", "ways", "text")

    def __init__(self, name: str, path: int, label: int, off: bool, main: bool, low: bool, block: str, doubtful: bool = False):
        self.name, self.path, self.label, self.off, self.main, self.low, self.block, self.doubtful = name, path, label, off, main, low, block, doubtful
        self.ways = self.text = 0
        self.holds = main


class Page:
    """Blocks of a page, and what the branches of its nodes look like. A node knows of those above it only whether one is
    low, off or an article, so a page's memory is in proportion to its size however deep it is."""

    def __init__(self, source: str, tree: bool = True, low: frozenset[int] = frozenset()):
        """``tree``: whether the nodes are wanted; ``low``: paths of nodes of low importance."""
        self.tree, self.low_paths = tree, low
        self.blocks: list[tuple[str, bool, bool, bool]] = []  # text, switched off by its markup, in an article, below a low node
        self.nodes: dict[int, tuple[int, int, int, bool, bool]] = {}  # by path: label, way, text, in or above an article, doubtful
        self.words: list[str] = []
        self.stack = [_Node("", 0, 0, False, False, False, "")]
        self.opened: dict[str, int] = {}
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            if not found:
                self.chars(source[at:])
                break
            self.chars(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self.close(name)
                continue
            self.open(name, found[3] if found[2] else found[6])
            if name in RAW:
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                at = stop.start() if stop else end
        self.flush()
        while len(self.stack) > 1:
            self.leave()

    def chars(self, text: str) -> None:
        if text:
            node = self.stack[-1]
            if self.tree and (own := text.strip()):
                node.text = _mixed(node.text, xxhash.xxh64_intdigest(own))
            if not self.words:
                self.at = node
            self.words.append(html.unescape(text) if "&" in text else text)

    def flush(self) -> None:
        if self.words:
            if text := " ".join("".join(self.words).split()):
                self.blocks.append((text, self.at.off, self.at.main, self.at.low))
            self.words = []

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            if self.words:
                self.words.append(" ")
            return
        if name not in INLINE:
            self.flush()
            if name in ENDS_P and self.stack[-1].block == "p":
                self.close("p")
            for same in SIBLINGS[1:]:
                if name in same and (top := self.stack[-1].block) in same:
                    self.close(top)
        if name in VOID:
            return
        up = self.stack[-1]
        said = _attributes(attributes) if _LOOKED_AT.search(attributes) else {}
        classes = said.get("class", "").lower()
        path = _path(up.path, name, classes)
        kind = _path(0, name, classes)
        hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").replace(" ", "").lower()
        comment = bool(said) and not COMMENTS.isdisjoint((*classes.split(), said.get("id", "").lower()))
        marked = comment or said.get("role", "").lower() in ROLES
        article = name in ("article", "main") and not marked
        off = (up.off and not (article and not up.main)) or name in NO_TEXT or hidden or marked or (name == "header" and not up.main)
        low = (up.low or (path in self.low_paths and not (up.main and name in HEADINGS))) and (up.main or not article)
        doubtful = up.doubtful or (bool(classes) and not DOUBTFUL.isdisjoint(classes.split()))
        # what differs in a look changes where words are cut from their neighbours' node
        if self.words and (off != up.off or low != up.low):
            self.flush()
        if self.tree:
            up.ways = _mixed(up.ways, kind)  # not its path: a pool holds nodes of any place
        self.opened[name] = self.opened.get(name, 0) + 1
        self.stack.append(_Node(name, path, kind if classes else 0, off, up.main or article, low, up.block if name in INLINE else name, doubtful))

    def leave(self) -> None:
        node = self.stack.pop()
        self.opened[node.name] -= 1
        up = self.stack[-1]
        if self.words and (node.off != up.off or node.low != up.low):
            self.flush()
        if self.tree:
            before = self.nodes.get(node.path, (0, 0, 0, False))
            self.nodes[node.path] = node.label, _mixed(before[1], node.ways), _mixed(before[2], node.text), before[3] or node.holds, node.doubtful
            up.holds = up.holds or node.holds
            if node.text:
                up.text = _mixed(up.text, node.text)

    def close(self, name: str) -> None:
        if not self.opened.get(name):
            if name == "p" or name == "br":
                self.flush() if name == "p" else self.words.append(" ")
            return
        if name not in INLINE:
            self.flush()
        while self.stack[-1].name != name:
            self.leave()
        self.leave()

    @property
    def has_article(self) -> bool:
        return any(main and not off for _, off, main, _ in self.blocks)

    def main_block(self) -> str:
        """What tells copies of a page: the article's text, without one all that isn't marked."""
        inside = self.has_article
        return "\n\n".join(text for text, off, main, _ in self.blocks if not off and main >= inside)

    def main_text(self) -> str:
        inside = [(len(text), low) for text, off, main, low in self.blocks if main and not off]
        whole = 2 * sum(n for n, low in inside if not low) < sum(n for n, _ in inside)
        return "\n\n".join(text for text, off, main, low in self.blocks if not off and (not low or (main and whole)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_NODES = "host string, node long, pool long, inside boolean, doubtful boolean, way long, content long, main long"


def _nodes(batches):
    for batch in batches:
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source or "")
            main = _signed(xxhash.xxh64_intdigest(page.main_block().encode("utf-8", "replace")))
            rows += [(host, _signed(path), _signed(label or path), inside, doubtful, _signed(way), _signed(text), main) for path, (label, way, text, inside, doubtful) in page.nodes.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        columns = [*zip(*rows)] or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "node", "pool", "inside", "doubtful", "way", "content", "main"])


def _entropy(counts: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(host, node, of_<kind>): the mean entropy of the ways or texts of a node's pages. What one page alone has says
    nothing, so only what is repeated somewhere meets the nodes' totals."""
    own = counts.groupBy("host", "node", "pool", kind).agg(F.sum("n").alias("c"))
    everywhere = own.groupBy("pool", kind).agg(F.sum("c").alias("c_all")).where("c_all > 1")
    repeated = own.join(everywhere, ["pool", kind]).join(nodes, ["host", "node", "pool"])
    of_host = F.when(F.col("n_pages") > 1, F.log("c") / F.log("n_pages") * F.col("n_pages") / (F.col("n_pages") + PRIOR)).otherwise(0.0)
    each = F.greatest(of_host, F.log("c_all") / F.log("n_all"))
    return repeated.groupBy("host", "node").agg((F.sum(F.col("c") * each) / F.max("n_pages")).alias(f"of_{kind}"))


def style_tree(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, node, inside, n_pages, n_all, presentation, content, importance, shrunk) of every node of every host's
    tree: ``importance`` from the pages alone, ``shrunk`` as it decides; ``n_pages`` counts the different looks of the node
    by main blocks, ``n_all`` those of its pool; ``inside`` nodes are in or above an article."""
    seen = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html")).mapInArrow(_nodes, _NODES)
    keys = ["host", "node", "pool"]
    marks = (F.max("doubtful").alias("doubtful"), F.max("inside").alias("inside"))
    counts = written(seen.groupBy(*keys, "way", "content", "main").agg(*marks).groupBy(*keys, "way", "content").agg(F.count("*").alias("n"), *marks), "style-tree")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_pages"), *marks)
    nodes = written(totals.join(totals.groupBy("pool").agg(F.sum("n_pages").alias("n_all")), "pool"), "style-nodes")
    sizes = nodes.select(*keys, "n_pages", "n_all")
    both = nodes.join(_entropy(counts, sizes, "way"), ["host", "node"], "left").join(_entropy(counts, sizes, "content"), ["host", "node"], "left")
    way, content = F.coalesce("of_way", F.lit(0.0)), F.coalesce("of_content", F.lit(0.0))
    importance = 1 - way * content
    assumed = F.when(F.col("doubtful"), 0.0).otherwise(1.0)
    return both.select("host", "node", "inside", "n_pages", "n_all", (1 - way).alias("presentation"), (1 - content).alias("content"), importance.alias("importance"), ((F.col("n_all") * importance + PRIOR * assumed) / (F.col("n_all") + PRIOR)).alias("shrunk"))


def low_nodes(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, node) of the branches that go."""
    return style_tree(pages, url, source).where(F.col("shrunk") < F.when(F.col("inside"), LOW_INSIDE).otherwise(LOW_IMPORTANCE)).select("host", "node")


def main_text(pages: DataFrame, url: str = "url", source: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``, the main text of each page, and leaves ``source`` out. The judged nodes of all hosts are broadcast
    if they are few; else they go, with a host's pages in groups of rows, to the same tasks ahead of the pages."""
    low = written(low_nodes(pages, url, source), "low-nodes")
    kept = pages.drop(*([out] if out in pages.columns and out != source else []))
    rest = [f for f in kept.schema if f.name != source]
    schema = _with(T.StructType(rest), T.StructField(out, T.StringType()))
    names = [*[f.name for f in rest], out]
    place = kept.withColumn("_terraline_host", host_of(F.col(url)))

    def texts(batch, lows) -> pa.RecordBatch:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        found = [Page(text or "", tree=False, low=lows.get(host, frozenset())).main_text() for text, host in zip(column(source).to_pylist(), column("_terraline_host").to_pylist())]
        return pa.RecordBatch.from_arrays([*[column(f.name) for f in rest], pa.array(found, pa.string())], names)

    if fits(low, MAX_BROADCAST_NODES):
        by_host: dict[str, set[int]] = {}
        for r in low.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.node & 0xFFFFFFFFFFFFFFFF)
        known = pages.sparkSession.sparkContext.broadcast({h: frozenset(n) for h, n in by_host.items()})

        def run(batches):
            for batch in batches:
                yield texts(batch, known.value)

        return place.mapInArrow(run, schema)

    groups = F.expr(f"cast(ceil(count(*) / {PAGES_AT_ONCE}) as int)").alias("_terraline_groups")
    sizes = place.groupBy("_terraline_host").agg(groups)
    dealt = place.join(sizes, "_terraline_host").withColumn("_terraline_group", F.pmod(F.xxhash64(url, source), F.col("_terraline_groups")).cast("int")).drop("_terraline_groups").withColumn("_terraline_node", F.lit(None).cast("long"))
    ahead = low.join(sizes, F.col("host") == F.col("_terraline_host")).select("_terraline_host", F.explode(F.sequence(F.lit(0), F.col("_terraline_groups") - 1)).alias("_terraline_group"), F.col("node").alias("_terraline_node"))

    def stream(batches):
        at, nodes = None, set()
        for batch in batches:
            hosts, groups, found = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_terraline_host", "_terraline_group", "_terraline_node"))
            start = 0
            for i, (host, group, node) in enumerate(zip(hosts, groups, found)):
                if (host, group) != at:
                    if i > start:
                        yield texts(batch.slice(start, i - start), {at[0]: frozenset(nodes)})
                    at, nodes, start = (host, group), set(), i
                if node is not None:
                    nodes.add(node & 0xFFFFFFFFFFFFFFFF)
                    start = i + 1
            if len(hosts) > start:
                yield texts(batch.slice(start), {at[0]: frozenset(nodes)})

    both = dealt.unionByName(ahead, allowMissingColumns=True).repartition("_terraline_host", "_terraline_group").sortWithinPartitions("_terraline_host", "_terraline_group", F.col("_terraline_node").isNull())
    return both.mapInArrow(stream, schema)
