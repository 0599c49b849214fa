"""Pages as numbered trees, and the units of text that a reader meets in them.

A task parses a page and numbers its nodes in the order in which they are read; every node also
knows the largest number below it, so that `node..last` holds its subtree. What depends on
ancestors is then a question about nested intervals, and windows over the numbers answer it: a
node lies in some interval of a kind if the running maximum of their ends reaches it, and the
nearest one around it is the last that was opened while as many were open.

The shadow root of a host and the document of a frame are roots of their own: they are read where
they stand, but what holds outside (blocks, hiding, reading aids) ends at them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import geometry as G
from .html import BLOCKS, VOID, ended_references

# Elements whose content is never read, and those that are seen but hold no text of the page.
UNREAD = set("head script style noscript template title meta link audio object embed".split())
MEDIA = set("canvas svg video iframe".split())
#: What the start of an element ends: open elements of these names, up to the nearest of the names behind the bar.
_LISTS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "rt": ("rt rp", "ruby"), "rp": ("rt rp", "ruby")}
ENDS = {tag: (set(ended.split()), set(scope.split())) for tag, (ended, scope) in _LISTS.items()}
#: A paragraph ends where one of these starts.
ENDS_PARAGRAPH = BLOCKS - {"li", "td", "th", "tr", "dt", "dd", "figcaption"} | {"hr"}

ROOT = "#root"


class Node:
    __slots__ = ("tag", "text", "attrs", "children")

    def __init__(self, tag: str | None, text: str | None = None, attrs: dict[str, str] | None = None):
        self.tag, self.text, self.attrs, self.children = tag, text, attrs, []


class TreeParser(HTMLParser):
    """Builds the tree of a page; `top` is its root."""

    def __init__(self, bare: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.bare = bare
        self.top = Node(ROOT)
        self.open = [self.top]
        self.whole = False  # whether the last child is text that goes on

    def _end(self, names: set[str], scope: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in scope or self.open[i].tag == ROOT:
                return
            if self.open[i].tag in names:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        self.whole = False
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, {"button", "table", "td", "th", "caption", "object", "template"})
        own = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        node = Node(tag, attrs=own)
        host = self.open[-1]
        if tag == "template" and own.get("shadowrootmode", "").lower() == "open" and not any(c.tag == ROOT for c in host.children):
            node.tag = ROOT
            host.children.insert(0, node)  # read before what else the host holds
        else:
            host.children.append(node)
        if tag == "iframe" and "srcdoc" in own and ("sandbox" not in own or "allow-same-origin" in own["sandbox"].lower().split()):
            node.children.append(parse(own["srcdoc"], self.bare))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing, but within pictures
        if tag not in VOID and any(n.tag == "svg" for n in self.open):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        self.whole = False
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if name == tag or name == ROOT and tag == "template":
                del self.open[i:]
                return
            if name == ROOT:
                return

    def handle_comment(self, data: str) -> None:
        self.whole = False

    def handle_data(self, data: str) -> None:
        inside = self.open[-1].children
        if self.open[-1].tag == "iframe":
            return  # no browser shows what stands between the tags of a frame
        if self.whole and inside:
            inside[-1].text += data
        else:
            inside.append(Node(None, data))
            self.whole = True


def parse(html: str | None, bare: bool = True) -> Node:
    parser = TreeParser(bare)
    if html:
        parser.feed(html if bare else ended_references(html))
        parser.close()
    return parser.top


def numbered(top: Node) -> list[tuple[int, int, int, Node]]:
    """(number, last number of the subtree, depth, node) in reading order, without recursion."""
    order: list[list] = []
    work: list[tuple[Node, int, int]] = [(top, 0, -1)]
    parents: list[int] = []
    while work:
        node, depth, parent = work.pop()
        number = len(order)
        order.append([number, number, depth, node])
        parents.append(parent)
        work += [(c, depth + 1, number) for c in reversed(node.children)]
    for number in range(len(order) - 1, 0, -1):
        order[parents[number]][1] = max(order[parents[number]][1], order[number][1])
    return [tuple(o) for o in order]


#: Attributes that the rules ask for.
ATTRS = ("role", "aria-label", "alt", "aria-hidden", "hidden", "style")
NODES = "node int, last int, depth int, tag string, text string, attrs map<string,string>"


def _run(batches: Iterator[pa.RecordBatch], bare: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    for batch in batches:
        for i, html in enumerate(batch.column(batch.schema.get_field_index("html")).to_pylist()):
            nodes = numbered(parse(html, bare))
            own = [None if n.attrs is None else [(k, n.attrs[k]) for k in ATTRS if k in n.attrs] for *_, n in nodes]
            made = [[x[0] for x in nodes], [x[1] for x in nodes], [x[2] for x in nodes], [n.tag for *_, n in nodes], [n.text for *_, n in nodes], own]
            page = [pa.repeat(batch.column(c)[i], len(nodes)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*page, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=["page_row", "page_id", "node", "last", "depth", "tag", "text", "attrs"])


def page_nodes(pages: DataFrame, bare: bool = True) -> DataFrame:
    """page_row, page_id, node, last, depth, tag, text, attrs: a row for each node of each page.

    page_row tells rows of one page_id apart. Tags are in lower case, `#root` for the page, for a
    declarative open shadow root and for a frame whose document stands in its srcdoc. A text has no
    tag. A null or empty page is its root alone; what the page leaves open ends with what is around.
    bare: whether references without a semicolon count, as they do in a browser.
    """
    source = pages.select(F.monotonically_increasing_id().alias("page_row"), "page_id", F.col("html").cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(partial(_run, bare=bare), f"page_row bigint, page_id {kind}, {NODES}")


def within(kind: Column, keys: list[str], itself: bool = False) -> Column:
    """Whether a node lies in the subtree of a node of a kind (or is one)."""
    before = Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return F.coalesce(F.max(F.when(kind, F.col("last"))).over(before) >= F.col("node"), F.lit(False))


def with_nearest(nodes: DataFrame, keys: list[str], kind: Column, value: Column, name: str) -> DataFrame:
    """nodes with `name`: `value` of the nearest node of a kind around each node, itself included; null if there is none.

    Ends of subtrees are events of their own, so that a running sum counts the open ones. Of those
    that were opened at a count, the last one is still open when a node at that count is met.
    """
    marked = nodes.withColumn("__kind", F.coalesce(kind, F.lit(False)))
    opened = F.struct(F.col("node").alias("at"), F.lit(0).alias("end"), F.col("__kind").cast("int").alias("step"))
    closed = F.struct(F.col("last").alias("at"), F.lit(1).alias("end"), F.lit(-1).alias("step"))
    events = marked.withColumn("__e", F.explode(F.when(F.col("__kind"), F.array(opened, closed)).otherwise(F.array(opened))))
    order = [F.col("__e.at"), F.col("__e.end")]
    upto = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    level = events.withColumn("__level", F.sum("__e.step").over(upto(Window.partitionBy(*keys))))
    here = F.struct(value.alias("v"))
    found = F.last(F.when(F.col("__kind") & (F.col("__e.end") == 0), here), ignorenulls=True).over(upto(Window.partitionBy(*keys, "__level")))
    return level.withColumn(name, F.when(F.col("__level") > 0, found["v"])).where("__e.end = 0").drop("__kind", "__e", "__level")


def page_tree_units(nodes: DataFrame, remove_ruby: Column | bool = False) -> DataFrame:
    """page_row, page_id, node, kind, text, block: what is read of each page, in the order of node.

    The root of each page comes along without a kind, so that pages without units aren't lost.

    Texts are read unless they are blank, lie in elements that are never read, are hidden (by
    aria-hidden, the hidden attribute, or display: none in their own style) or are the part of a
    reading aid that isn't wanted. Pictures give their label or alternative text unless hidden, other
    media their label. block is the nearest block around a text within its root, or null.
    """
    remove = remove_ruby if isinstance(remove_ruby, Column) else F.lit(remove_ruby)
    page, tag = ["page_row"], F.coalesce(F.col("tag"), F.lit(""))
    attr = lambda name: F.col("attrs")[name]
    framed = (tag == "iframe") & (F.col("last") > F.col("node"))  # a frame with a document
    closed = tag.isin(*sorted(UNREAD | MEDIA)) & ~framed
    seen = nodes.withColumn("unread", within(closed, page)).where(~F.col("unread"))
    rooted = with_nearest(seen, page, tag == ROOT, F.col("node"), "root")
    own = [*page, "root"]
    away = (attr("aria-hidden") == "true") | attr("hidden").isNotNull() | F.lower(attr("style")).rlike(r"(?:^|;)\s*display\s*:\s*none\b")
    rows = rooted.withColumn("away", within(F.coalesce(away, F.lit(False)), own, itself=True))
    rows = with_nearest(rows, own, tag.isin(*sorted(BLOCKS)), F.col("node"), "block")
    rows = with_nearest(rows, own, tag.isin("rt", "rp", "ruby"), F.upper(tag), "aid")
    role = G.ruby_role(F.array("aid"))
    spoken = T.alt_text(tag, attr("role"), attr("aria-label"), attr("alt"))
    kind = (
        F.when(F.col("tag").isNull() & (T.trim(F.col("text")) != "") & ~F.col("away") & G.keep_by_ruby(role, remove), "text")
        .when((tag == "img") & ~F.col("away") & (spoken != ""), "alt").when(tag.isin("canvas", "svg", "video") & (spoken != ""), "label")
    )
    text = F.when(F.col("tag").isNull(), F.col("text")).otherwise(spoken)
    units = rows.withColumn("kind", kind).select(*page, "page_id", "node", "kind", text.alias("text"), F.when(F.col("kind") == "text", F.col("block")).alias("block"))
    return units.where("kind IS NOT NULL OR node = 0")


def with_page_text(units: DataFrame) -> DataFrame:
    """page_id, units, page_text of every page: units with their places, if they have any, joined as one text."""
    places = ["left", "top", "right", "bottom"]
    placed = units.withColumns({c: F.lit(None).cast("double") for c in places if c not in units.columns})
    fields = ["text", "block", "kind", *places]
    listed = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("node", *fields))))
    pages = placed.groupBy("page_row").agg(F.first("page_id").alias("page_id"), F.transform(listed, lambda u: F.struct(*[u[c].alias(c) for c in fields])).alias("units"))
    return pages.select("page_id", "units", T.join_units(F.col("units")).alias("page_text"))
