"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements
(tag with normalised class and id), its presentation is the sequence of its
children's styles, its content the hashes of its text blocks. A node's importance is
the entropy of its presentations over the m pages of the host that have it or, where it
holds text, one minus the mean of log_m(c) for texts that c of them share: what every such
page repeats is worth nothing, what one page alone has is worth one. Equal pages count once. A branch's composite
importance mixes its own with its children's, as depth lets them count.

From each page go the branches that are furniture by element, role or name
(navigation, advert, form, comments, ...) and those that are of low composite importance
with all that is in them; a branch of low importance that holds a better one loses only its
own text. A page's article or main element is where text is looked for; inside it, paragraphs and
headings are never taken for furniture by entropy (copies of a page on one host would
lose their text), other branches are.

Only counts are gathered by host and path, so a host with a third of all pages is aggregated
like any other, and no task holds a host's tree: composite importance is computed level by
level from the deepest one up. All paths that two pages have are kept, however large the host.
A page gets the values of the paths that its text may depend on, by its row's number.

Null or empty html has empty text. A null url is a host of its own. Unclosed and
unmatched tags are tolerated. Rows are kept as they are, repeated ones too; a null
page_id or url stays null. NUL is a character of the text, but a block of NULs alone is none. Nothing is ranked, so there are no ties: pages of one host
are counted in no order.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LOW = 0.2
DEPTH_WEIGHT = 0.9
#: From this depth on DEPTH_WEIGHT ** depth is less than the rounding of a double.
DEEPEST = 350

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select button noframes xmp audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_SCOPE = frozenset("table ul ol dl article section div main body html".split())

#: What names furniture, as element, role, or word of a class or id.
_FURNITURE_TAGS = frozenset("nav aside footer form menu dialog head".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs masthead footer sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply "
    "replies pagination pager skip toolbar copyright form search".split()
)
_PAGE_HEAD_WORDS = frozenset("header topbar top".split())
_MAIN_WORDS = frozenset("article post entry story content main".split())


class Node:
    """An element (or the root): its style, block children and, in order, text parts and children."""

    __slots__ = ("tag", "style", "words", "role", "hidden", "parts", "path", "depth")

    def __init__(self, tag: str, attributes: str = "", path: int = 0, depth: int = 0):
        self.tag, self.parts, self.depth = tag, [], depth
        self.words, self.role, self.hidden = (), "", False
        name = ""
        if attributes and attributes.strip(" /"):
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), values[0] or values[1] or values[2]
                if key in ("class", "id"):
                    self.words += tuple(w.lower() for w in _NAME.findall(value))
                elif key == "role":
                    self.role = value.strip().lower()
                elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
                    self.hidden = True
            name = ".".join(sorted(set(self.words)))
        self.style = f"{tag}.{name}" if name else tag
        self.path = _hash(f"{path}/{self.style}")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: A mark between text parts where a block ends; no text is it.
BREAK = object()


def parse(source: str) -> Node:
    """The tree of a page; inline elements leave only their text."""
    root = Node("")
    stack: list[Node] = [root]
    at, raw = 0, ""
    for m in _TAG.finditer(source):
        begin = m.start()
        if begin < at:
            continue
        if begin > at:
            stack[-1].parts.append(source[at:begin])
        at = m.end()
        if m[1]:
            stack[-1].parts.append(m[1])
        close, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in _INLINE:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            else:
                stack[-1].parts.append(BREAK)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag in _INLINE:
            continue
        if tag in _VOID:
            stack[-1].parts.append(BREAK)
            continue
        for i in range(len(stack) - 1, 0, -1):
            closed = _CLOSED_BY.get(stack[i].tag)
            if closed and tag in closed:
                del stack[i:]
                break
            if stack[i].tag in _SCOPE:
                break
        node = Node(tag, attributes, stack[-1].path, len(stack))
        stack[-1].parts.append(node)
        stack.append(node)
    if at < len(source):
        stack[-1].parts.append(source[at:])
    return root


def _block(parts: list[str]) -> str:
    """The text of a block; empty if it holds nothing but white space and NULs."""
    text = " ".join(html.unescape("".join(parts)).split())
    return text if text.strip("\0 ") else ""


def blocks(node: Node) -> list[str]:
    """The node's own text blocks, without those of its children."""
    out, now = [], []
    for part in [*node.parts, BREAK]:
        if part is BREAK or isinstance(part, Node):
            text = _block(now)
            if text:
                out.append(text)
            now = []
        else:
            now.append(part)
    return out


def _children(node: Node) -> list[Node]:
    return [p for p in node.parts if isinstance(p, Node)]


def walk(node: Node) -> Iterator[tuple[Node, Node | None]]:
    """All nodes with their parents."""
    todo: list[tuple[Node, Node | None]] = [(node, None)]
    while todo:
        x, up = todo.pop()
        yield x, up
        todo += [(c, x) for c in _children(x)]


def features(root: Node) -> set[tuple[int, int, int, str, int]]:
    """(path, parent path, depth, kind, feature) of a page: kind S for the children's styles, T for a text block."""
    out = set()
    for node, up in walk(root):
        parent = up.path if up else 0
        styles, last = [], None
        for c in _children(node):
            if c.style != last:  # runs of equal siblings are one
                styles.append(c.style)
                last = c.style
        out.add((node.path, parent, node.depth, "S", _hash("|".join(styles))))
        out.update((node.path, parent, node.depth, "T", _hash(b)) for b in blocks(node))
    return out


def host(url: str | None) -> str:
    """The host name of a URL."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _furniture(node: Node, inside: bool) -> bool:
    """Whether a branch is furniture by its own marks; inside: below an article."""
    if node.tag in _FURNITURE_TAGS or node.role in _FURNITURE_ROLES or node.hidden:
        return True
    if node.tag in ("html", "body", "main", "article", ""):
        return node.tag == "article" and bool(_FURNITURE_WORDS.intersection(node.words))
    if not inside and (node.tag == "header" or _PAGE_HEAD_WORDS.intersection(node.words)):
        return True
    return bool(_FURNITURE_WORDS.intersection(node.words))


def _mains(root: Node) -> list[Node]:
    """A page's articles or, if it has none, its main elements and containers named like one: all that are outermost and outside of furniture, in page order."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    outermost: list[Node] = []
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, held = todo.pop()
        kind = "main" if node.role == "main" else node.tag
        named = node.tag in ("div", "section") and bool(_MAIN_WORDS.intersection(node.words))
        if node.tag not in ("", "html", "body") and _furniture(node, inside or named) and kind != "main":
            continue
        if kind in found:
            found[kind].append(node)
            if kind == "article":
                continue
        if (kind == "main" or named) and not held:
            outermost.append(node)
            held = True
        todo += [(c, inside or kind in found, held) for c in reversed(_children(node))]
    return found["article"] or outermost


def main_text(root: Node, importance: dict[int, float], pages: int = 2) -> str:
    """A page's text without furniture and branches of low importance.

    pages: how many different pages the importance is known from; of one alone nothing
    inside an article is taken for furniture by entropy.
    """
    mains = _mains(root)
    # of several named containers those count that not every page repeats, or else all
    mains = [n for n in mains if n.tag in ("article", "main") or importance.get(n.path, 1.0) >= LOW] or mains
    chosen = {id(n) for n in mains}
    holds = set()  # nodes above the chosen ones
    if mains:
        up = {id(n): p for n, p in walk(root)}
        for n in mains:
            p = up[id(n)]
            while p is not None and id(p) not in holds:
                holds.add(id(p))
                p = up[id(p)]

    def floor(node: Node, inside: bool) -> float:
        """The importance that a branch needs; 0 if entropy doesn't judge it."""
        if inside:
            return LOW / 2 if pages > 1 and node.tag in ("div", "section", "ul", "ol", "table", "dl") else 0
        return 0 if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body", "") else LOW

    best: dict[int, float] = {}  # the greatest importance in a branch without its furniture

    def most(branch: Node, inside: bool) -> float:
        order, todo = [], [] if id(branch) in best else [branch]
        while todo:
            node = todo.pop()
            inner = [c for c in _children(node) if not _furniture(c, inside)]
            order.append((node, inner))
            todo += inner
        for node, inner in reversed(order):
            best[id(node)] = max([importance.get(node.path, 1.0), *(best[id(c)] for c in inner)])
        return best[id(branch)]

    def keep(node: Node, inside: bool) -> bool:
        if id(node) in holds or id(node) in chosen:
            return True
        if mains and not inside or _furniture(node, inside):
            return False
        least = floor(node, inside)
        return not least or most(node, inside) >= least

    def speaks(node: Node, inside: bool) -> bool:
        """Whether a kept node's own text is kept."""
        if id(node) in chosen:
            return True
        least = floor(node, inside)
        return (inside or not mains) and (not least or importance.get(node.path, 1.0) >= least)

    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = _block(now)
        if text:
            out.append(text)
        now.clear()

    todo = [(iter(root.parts), False, speaks(root, False))]
    while todo:
        parts, inside, loud = todo[-1]
        part = next(parts, None)
        if part is None or part is BREAK or isinstance(part, Node):
            end()
            if part is None:
                todo.pop()
            elif part is not BREAK and keep(part, inside):
                todo.append((iter(part.parts), inside or id(part) in chosen, speaks(part, inside)))
        elif loud:
            now.append(part)
    return " ".join(out)


class _Asked(dict):
    """An importance that is one everywhere and remembers which paths it was asked for."""

    def get(self, path: int, default: float) -> float:
        self[path] = default
        return default


def asked(root: Node) -> list[int]:
    """The paths on whose importance the page's text may depend.

    A low importance only takes branches away, so no other path is asked for when some are low.
    """
    seen = _Asked()
    main_text(root, seen)
    return list(seen)


def page_features(rows: DataFrame) -> DataFrame:
    """n, host, page (a hash of the html), asked() and features() of each row of (n, url, html)."""
    feature = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("kind", pa.string()), ("feature", pa.int64())])

    def lists(values: list, kind: pa.DataType) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        flat = list(chain.from_iterable(values))
        if pa.types.is_struct(kind):
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), kind)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat if isinstance(flat, pa.Array) else pa.array(flat, kind))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, hashes, wanted, found = [], [], [], []
        for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            root = parse(source or "")
            hosts.append(host(url))
            hashes.append(_hash(source or ""))
            wanted.append(asked(root))
            found.append(features(root))
        columns = [batch.column(0), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), lists(wanted, pa.int64()), lists(found, feature)]
        return pa.RecordBatch.from_arrays(columns, ["n", "host", "page", "asked", "found"])

    schema = "n long, host string, page long, asked array<long>, found array<struct<path: long, parent: long, depth: int, kind: string, feature: long>>"
    return common.over_text(rows.select("n", "url", "html"), run, schema, column="html")


def style_tree(found: DataFrame) -> DataFrame:
    """The paths that two different pages of a host have, from page_features(): host, path, parent, depth, own importance, and once, the number of children that one page alone has."""
    counts = found.select("host", "page", F.inline("found")).distinct().groupBy("host", "path", "parent", "depth", "kind", "feature").agg(F.count("*").cast("double").alias("c"))
    own = counts.groupBy("host", "path", "parent", "depth").agg(
        F.sum(F.when(F.col("kind") == "S", F.col("c"))).alias("n"),
        F.sum(F.when(F.col("kind") == "S", F.col("c") * F.log("c"))).alias("s"),
        F.sum(F.when(F.col("kind") == "T", F.col("c"))).alias("t"),
        F.sum(F.when(F.col("kind") == "T", F.col("c") * F.log("c"))).alias("u"),
    )
    base = F.log(F.greatest("n", F.lit(2.0)))
    presentation = (F.log("n") - F.col("s") / F.col("n")) / base
    content = F.greatest(F.lit(0.0), 1 - F.col("u") / F.col("t") / base)
    importance = F.when(F.col("t").isNotNull(), content).otherwise(presentation)
    # what one page alone has counts for its parent, as worth one
    own = common.stage(own.withColumn("alone", F.col("n") < 2), "paths")
    alone = own.where("alone").groupBy("host", F.col("parent").alias("path")).agg(F.count("*").alias("once"))
    kept = own.where(~F.col("alone")).join(alone, ["host", "path"], "left")
    tree = kept.select("host", "path", "parent", "depth", importance.alias("importance"), F.coalesce("once", F.lit(0)).alias("once"))
    return common.stage(tree.sortWithinPartitions("depth"), "style-tree")  # a level is read by itself


def composite(tree: list[dict]) -> dict[int, float]:
    """Composite importance of each path of one host's tree, its top at depth 1: its own and, the less the deeper it stands, its children's mean.

    What composites() computes of all hosts, for a tree that fits in memory.
    """
    own = {x["path"]: x["importance"] for x in tree}
    once = {x["path"]: x.get("once", 0) for x in tree}
    below: dict[int, list[int]] = {}
    for x in tree:
        if x["parent"] in own:
            below.setdefault(x["parent"], []).append(x["path"])
    out: dict[int, float] = {}
    order, todo = [], [(x["path"], 1) for x in tree if x["parent"] not in own]
    while todo:
        path, depth = todo.pop()
        order.append((path, depth))
        todo += [(c, depth + 1) for c in below.get(path, ())]
    for path, depth in reversed(order):
        inner = [out[c] for c in below.get(path, ())]
        total, many = sum(inner) + once.get(path, 0), len(inner) + once.get(path, 0)
        weight = DEPTH_WEIGHT**depth if many else 0
        out[path] = (1 - weight) * own[path] + (weight * total / many if many else 0)
    return out


def composites(tree: DataFrame, least: int = 0) -> DataFrame:
    """host, path and value, the composite importance, of all paths of style_tree() from depth least on.

    One level after another, the deepest first: a path's children are aggregated by their
    parent. From DEEPEST on children weigh nothing that a double could hold.
    """
    deepest = tree.agg(F.max("depth")).first()[0]
    start = -1 if deepest is None else min(deepest, DEEPEST)
    spark = tree.sparkSession
    schema = "host string, path long, parent long, value double"
    levels = [tree.where(F.col("depth") > start).select("host", "path", "parent", F.col("importance").alias("value"))]
    below = spark.createDataFrame([], schema)
    for depth in range(start, least - 1, -1):
        sums = below.groupBy("host", F.col("parent").alias("path")).agg(F.sum("value").alias("total"), F.count("*").alias("many"))
        level = tree.where(F.col("depth") == depth).join(sums, ["host", "path"], "left")
        many = F.coalesce("many", F.lit(0)) + F.col("once")
        total = F.coalesce("total", F.lit(0.0)) + F.col("once")
        weight = DEPTH_WEIGHT ** (depth + 1)
        value = F.when(many > 0, (1 - weight) * F.col("importance") + weight * total / many).otherwise(F.col("importance"))
        below = common.stage(level.select("host", "path", "parent", value.alias("value")), "level")
        levels.append(below)
    return reduce(DataFrame.unionByName, levels).select("host", "path", "value")


def importance_of_rows(found: DataFrame) -> DataFrame:
    """n and values, the composite importance of each path that the row n asks for and two pages have."""
    tree = style_tree(found)
    wanted = found.select("n", "host", F.explode("asked").alias("path"))
    times = wanted.groupBy("host", "path").agg(F.count("*").alias("times"))
    known = common.stage(tree.select("host", "path", "depth").join(times, ["host", "path"]), "asked")
    least = known.agg(F.min("depth")).first()[0]
    if least is None:  # no page's text depends on the tree
        return found.sparkSession.createDataFrame([], "n long, values array<struct<path: long, value: double>>")
    known = common.stage(known.join(composites(tree, least), ["host", "path"]).select("host", "path", "value", "times"), "importance")
    return common.join_counted(wanted, known, ["host", "path"]).groupBy("n").agg(F.collect_list(F.struct("path", "value")).alias("values"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""
    rows = common.numbered(pages, page_id="long", url="string", html="string")
    found = common.stage(page_features(rows), "page-features")
    joined = rows.join(importance_of_rows(found), "n", "left").select("page_id", "url", "html", "values")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for source, values in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            texts.append(main_text(parse(source or ""), {x["path"]: x["value"] for x in values or ()}))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.over_text(joined, run, "page_id long, url string, text string, n_chars long", column="html")
