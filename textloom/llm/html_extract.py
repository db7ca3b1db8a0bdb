"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: a node of the tree stands for a path of
tags and class names, and counts, over the host's distinct pages, how the
element looks (the sequence of its children) and what text it holds. Entropy
makes these counts an importance between 0 and 1: elements that look and read
the same on every page have none, elements that differ from page to page have
much. A branch is noise if neither it nor anything in it has an importance above
a limit. Blocks of text are content nodes of their own, a path with a text: one
that stands on more than ``COMMON`` of a host's pages is noise, wherever it
stands. Noise is cut from each page. Pages with equal texts count once, and
nothing is judged on fewer than ``MIN_PAGES`` pages, which say nothing about a site.

The tree can't know what differs from page to page and still isn't the text:
readers' comments, adverts by turns, other articles. Such parts are taken out by what
a page says about them (``nav``, ``footer``, ``aside``, roles, class names), which
also serves hosts of few pages; ``marks=False`` leaves it all to the tree. Paths of
text blocks directly in ``article`` or ``main`` are judged by their texts alone, since
all paragraphs of an article share one path; headings stay.

The trees of all hosts are aggregated by Spark, with one row for each path or
block. Only what is noise goes back to the pages: broadcast where it is little
(``broadcast_paths``), otherwise joined path by path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, fresh, slices, table

#: Importance of noise at most, share of a host's pages with a block that make it noise, and distinct pages from which a host is judged.
LIMIT, COMMON, MIN_PAGES = 0.2, 0.5, 3
#: Levels of the tree that are told apart; deeper elements count as part of the last one.
DEPTH = 64

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*'|[\"'])[^>\"']*)*)>?|<[!?/][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text that markup doesn't end, other than by their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no text of the page.
SILENT = frozenset("script style textarea title xmp iframe noembed noframes head template noscript svg math object canvas audio video select button datalist option map picture".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADING | frozenset("p blockquote pre li ul ol dl dd dt table tbody thead tr td th figure figcaption".split())
#: Elements whose whole text is a block that is judged by itself.
BLOCKS = frozenset("p blockquote pre li dd dt td th figcaption".split())
#: An open element of the second kind ends where an element of the first kind begins, up to an element of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = frozenset("table td th caption button object html body div section article main aside nav header footer form blockquote li dd dt figure details".split())
#: Parts of a page that are never its text, by element, role and name.
ASIDE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disqus disclaimer "
    "footer gdpr header login masthead menu menus modal nav navbar navi navigation newsletter notice notices notification pager pagination paywall popup promo promotion promoted recommendations related replies reply "
    "respond search share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription taboola teaser teasers toolbar topbar tracking widget widgets".split()
)
NOT_AFTER = frozenset("has with no without show hide".split())
MAIN_ROLES = frozenset(("main", "article"))


@lru_cache(1 << 15)
def _attributes(tag: str, attributes: str) -> tuple[str, bool, tuple[str, ...], str]:
    """(role, hidden, id and classes, name in paths)"""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    names = tuple((found.get("id", "") + " " + found.get("class", "")).split())
    return found.get("role", "").strip().lower(), hidden, names, ".".join([tag, *sorted({re.sub(r"\d+", "0", x.lower()) for x in names})])


class Node:
    __slots__ = ("tag", "name", "parent", "children", "role", "hidden", "names")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        if attributes:
            self.role, self.hidden, self.names, self.name = _attributes(tag, attributes)
        else:
            self.role, self.hidden, self.names, self.name = "", False, (), tag


def parse(page: str) -> Node:
    """The page's tree; children are nodes and texts."""
    root = Node("", None)
    at, end, n = root, 0, len(page)
    while True:
        m = TOKEN.search(page, end)
        start = m.start() if m else n
        if start > end:
            at.children.append(page[end:start])
        if not m:
            return root
        end = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not _open(at, {"p"}, SCOPE):
                continue
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        if tag in BLOCK and (p := _open(at, {"p"}, SCOPE)) is not None:
            at = p.parent
        if tag in HEADING and at.tag in HEADING:
            at = at.parent
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            while (open_one := _open(at, ends, scope)) is not None:
                at = open_one.parent
        node = Node(tag, at, m[3])
        at.children.append(node)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(page, end)
            end = close.start() if close else n
            at = node
        elif tag not in VOID and not m[0].endswith("/>"):
            at = node


def _open(at: Node, tags: set[str], scope) -> Node | None:
    while at.parent is not None:
        if at.tag in tags:
            return at
        if at.tag in scope:
            return None
        at = at.parent
    return None


@lru_cache(1 << 15)
def _tokens(name: str) -> tuple[str, ...]:
    return tuple(x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name))


def unwanted(node: Node, in_main: bool) -> bool:
    """Whether the page itself marks the element as something else than its text."""
    if node.tag in SILENT or node.tag in ASIDE or node.role in ROLES or node.hidden:
        return True
    if node.tag == "header" and not in_main:
        return True
    if node.tag in ("html", "body", "main"):
        return False
    for name in node.names:
        words = _tokens(name)
        if any(w in NAMES and not (k and words[k - 1] in NOT_AFTER) for k, w in enumerate(words)):
            return not (node.tag == "header" and words == ("header",) and in_main) and not (node.tag in HEADING and in_main)
    return False


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in MAIN_ROLES


def _has_text(node: Node, in_main: bool = False) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                if not c.isspace() and html.unescape(c).strip():
                    return True
            elif not unwanted(c, True):
                stack.append(c)
    return False


def main_nodes(root: Node, marks: bool = True) -> list[Node]:
    """The outermost main elements and articles outside unwanted parts, in page order; the whole page where neither has text."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag and marks and unwanted(node, False):
            continue
        if _is_main(node) and _has_text(node):
            found.append(node)
            continue
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found or [root]


def blocks(page: str | None, noise: frozenset[bytes] | set[bytes] = frozenset(), marks: bool = True) -> list[str]:
    """The page's text, block by block, without the branches and blocks whose keys are in ``noise``."""
    root = parse(page or "")
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = plain("".join(run))
            run.clear()
            if text:
                out.append(text)

    for top in main_nodes(root, marks):
        in_main = _is_main(top)
        stack: list = [(top, _path_to(top), in_main, True)]
        while stack:
            node, path, direct, entering = stack.pop()
            if isinstance(node, str):
                run.append(node)
                continue
            block = node.tag in BLOCK or not node.tag
            if not entering:
                if block:
                    flush()
                continue
            if node is not top:
                if node.tag in SILENT or marks and unwanted(node, in_main):
                    run.append(" ")
                    continue
                kept = node.tag in HEADING or direct and node.tag in TEXTUAL or not block
                if noise and not kept and path_key(path) in noise:
                    continue
                if noise and node.tag in BLOCKS and block_key(path, own_text(node)) in noise:
                    continue
            if block:
                flush()
                stack.append((node, path, direct, False))
            elif node.tag in ("br", "img", "wbr"):
                run.append(" " if node.tag != "wbr" else "")
            own = direct and in_main and (node is top or node.tag in TEXTUAL or node.tag == "")
            for c in reversed(node.children):
                stack.append((c, path, own, True) if isinstance(c, str) else (c, _below(path, c), own, True))
        flush()
    return out


def plain(text: str) -> str:
    return " ".join(html.unescape(text).split())


def own_text(node: Node) -> str:
    """The text of a block, without the blocks in it."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or x.tag not in BLOCK and x.tag not in SILENT:
            stack += reversed(x.children)
        else:
            parts.append(" ")
    return plain("".join(parts))


def _below(path: tuple[str, ...], node: Node) -> tuple[str, ...]:
    return (*path, node.name) if len(path) < DEPTH else path


def _path_to(node: Node) -> tuple[str, ...]:
    names = []
    while node is not None and node.tag:
        names.append(node.name)
        node = node.parent
    return tuple(reversed(names))[:DEPTH]


@lru_cache(1 << 15)
def path_key(path: tuple[str, ...]) -> bytes:
    return blake2b("/".join(path).encode("utf-8", "surrogatepass"), digest_size=12).digest()


@lru_cache(1 << 15)
def _block_key(path: bytes, text: str) -> bytes:
    return blake2b(path + text.encode("utf-8", "surrogatepass"), digest_size=12, person=b"block").digest()


def block_key(path: tuple[str, ...], text: str) -> bytes | None:
    return _block_key(path_key(path), text) if text else None


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def features(page: str) -> tuple[bytes, list[tuple[list[bytes], bytes, bytes]], list[bytes]]:
    """What a page adds to its host's tree.

    The page's digest; for each path on it (keys of the path and its ancestors, digest of the look, digest of the own
    text); and the keys of its blocks of text.
    """
    looks: dict[tuple[str, ...], list[str]] = {}
    texts: dict[tuple[str, ...], list[str]] = {}
    own: set[bytes] = set()
    stack = [(parse(page), ())]
    while stack:
        node, path = stack.pop()
        if node.tag in SILENT:
            continue
        if path:
            looks.setdefault(path, []).append(",".join(c.name for c in node.children if isinstance(c, Node)))
            texts.setdefault(path, []).append("".join(c for c in node.children if isinstance(c, str)).strip())
        if node.tag in BLOCKS and (key := block_key(path, own_text(node))):
            own.add(key)
        stack += [(c, _below(path, c)) for c in reversed(node.children) if isinstance(c, Node)]
    rows = []
    for path, look in looks.items():
        text = "\n".join(x for x in texts[path] if x)
        rows.append(([path_key(path[:k]) for k in range(len(path), 0, -1)], _digest("|".join(look)), _digest(text) if text else b""))
    return _digest("\n".join(x for t in texts.values() for x in t if x)), rows, sorted(own)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


ROW = T.ArrayType(T.StructType([T.StructField("up", T.ArrayType(T.BinaryType())), T.StructField("look", T.BinaryType()), T.StructField("text", T.BinaryType())]))


def noise_paths(pages: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``(host, path)``: the keys of what is noise on each host, branches of its style tree and blocks; ``pages`` has ``host`` and ``html``."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("page", T.BinaryType()), T.StructField("nodes", ROW), T.StructField("blocks", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("up", pa.list_(pa.binary())), ("look", pa.binary()), ("text", pa.binary())]))
        for batch in slices(batches, 1):
            got = [features(x or "") for x in batch.column(1).to_pylist()]
            nodes = pa.array([[{"up": u, "look": a, "text": b} for u, a, b in rows] for _, rows, _ in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _, _ in got], pa.binary()), nodes, pa.array([x for _, _, x in got], pa.list_(pa.binary()))], names=["host", "page", "nodes", "blocks"])

    # Read three times below, so it is kept: pages are parsed once for the tree.
    distinct = cut(pages.select("host", "html").mapInArrow(run, schema).dropDuplicates(["host", "page"]))
    nodes = distinct.select("host", F.explode("nodes").alias("n")).select("host", F.col("n.up").alias("up"), F.col("n.look").alias("look"), F.col("n.text").alias("text"))
    nodes = nodes.withColumn("path", F.element_at("up", 1))

    def entropy(feature: str) -> DataFrame:
        """(host, path, pages, e): entropy of the feature over the pages, in units of its largest value."""
        counts = nodes.groupBy("host", "path", feature).agg(F.count("*").alias("c"), F.first("up").alias("up"))
        return counts.groupBy("host", "path").agg(
            F.sum("c").alias("pages"),
            F.sum(F.col("c") * F.ln("c")).alias("s"),
            F.max((F.length(feature) > 0).cast("int")).alias("has"),
            F.first("up").alias("up"),
        )

    spread = lambda: F.when(F.col("pages") > 1, (F.ln("pages") - F.col("s") / F.col("pages")) / F.ln("pages")).otherwise(1.0)
    looks = entropy("look").select("host", "path", "pages", "up", spread().alias("look_e"))
    texts = entropy("text").select(F.col("host").alias("h__"), F.col("path").alias("p__"), F.when(F.col("has") > 0, spread()).alias("text_e"))
    joined = looks.join(texts, (F.col("host") == F.col("h__")) & (F.col("path") == F.col("p__")))
    # A node's importance is that of its content, or of its presentation where it holds no text itself; a branch has that of its best node.
    own = joined.select("host", "pages", "up", F.coalesce("text_e", "look_e").alias("imp"))
    up = own.select("host", "pages", "imp", F.explode("up").alias("path"))
    judged = up.groupBy("host", "path").agg(F.max("imp").alias("best"), F.max("pages").alias("pages"))
    branches = judged.where((F.col("pages") >= MIN_PAGES) & (F.col("best") <= limit)).select("host", "path")

    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    often = distinct.select("host", F.explode("blocks").alias("path")).groupBy("host", "path").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_PAGES - 1)
    common = often.join(sizes, "host").where(F.col("c") > F.col("pages") * F.lit(COMMON if limit >= 0 else 2.0)).select("host", "path")
    return branches.union(common)


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", limit: float = LIMIT, broadcast_paths: int = 200_000, marks: bool = True) -> DataFrame:
    """``df`` with ``html_col`` replaced by the page's main text in ``text_col``; a column of that name is replaced.

    Blocks are in page order, joined by an empty line, and white space in a
    block is one blank. Null and empty pages, pages without text and pages of
    nothing but noise give an empty text. Pages without a host are one site.
    Repeated rows give equal texts and count as one page; an empty table gives
    an empty result; a page of any length is read whole. All other columns are
    kept, whatever their names. A ``limit`` below 0 switches the tree off.
    """
    base = [c for c in df.columns if c not in (html_col, text_col)]
    host, content, one, two, lost = fresh([*base, text_col], "host__", "html__", "k1__", "k2__", "noise__")
    pages = df.select(*base, host_of(F.col(url_col)).alias(host), F.col(html_col).alias(content))
    noise = cut(noise_paths(pages.select(F.col(host).alias("host"), F.col(content).alias("html")), limit))
    n = len(base)
    out = T.StructType([*pages.schema.fields[:n], T.StructField(text_col, T.StringType())])

    def run_with(noise_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = noise_of()
            for batch in slices(batches, n + 1):
                marks = batch.column(n).to_pylist()
                texts = ["\n\n".join(blocks(x, of(m), marks)) if x else "" for m, x in zip(marks, batch.column(n + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=out.names)

        return run

    if noise.count() <= broadcast_paths:
        by_host: dict[str, set[bytes]] = {}
        for row in noise.toLocalIterator():
            by_host.setdefault(row.host, set()).add(bytes(row.path))
        shipped = df.sparkSession.sparkContext.broadcast(by_host)

        def from_broadcast():
            known = shipped.value
            return lambda host: known.get(host, frozenset())

        return pages.mapInArrow(run_with(from_broadcast), out)

    key = [F.xxhash64(host, content).alias(one), F.xxhash64(content, host, F.lit(1)).alias(two)]
    keyed = pages.select(*base, host, content, *key)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, found = [], []
            for row, x in enumerate(batch.column(1).to_pylist()):
                _, nodes, own = features(x or "")
                keys = {key for up, _, _ in nodes for key in up}.union(own)
                rows += [row] * len(keys)
                found += keys
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 2, 3)), pa.array(found, pa.binary())], names=["host", "k1", "k2", "path"])

    met = keyed.select(F.col(host).alias("host"), F.col(content).alias("html"), F.col(one).alias("k1"), F.col(two).alias("k2")).mapInArrow(paths, "host string, k1 long, k2 long, path binary").join(noise, ["host", "path"])
    own = met.groupBy(F.col("k1").alias(one), F.col("k2").alias(two)).agg(F.collect_set("path").alias(lost))
    joined = keyed.join(own, [one, two], "left").select(*base, lost, content)
    return joined.mapInArrow(run_with(lambda: lambda mine: set(mine or ())), out)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
