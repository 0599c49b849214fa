"""Pages as ordered text units: one unit for each readable text node."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that are never read, elements without end tags, and block elements.
SKIPPED = set("script style noscript template title svg canvas audio video iframe object".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "p div section article aside header footer main nav h1 h2 h3 h4 h5 h6 li td th tr dt dd blockquote pre "
    "figcaption figure form ul ol dl table address".split()
)
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
UNIT = "array<struct<text:string,block:int,kind:string,left:double,top:double,right:double,bottom:double>>"
UNIT_ARROW = pa.list_(pa.struct([("text", pa.string()), ("block", pa.int32()), ("kind", pa.string()), *((n, pa.float64()) for n in ("left", "top", "right", "bottom"))]))


def ended_references(html: str) -> str:
    """html whose character references without a semicolon, as `&amp` where a text was cut, are text like any other."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


class UnitParser(HTMLParser):
    """Collects text nodes with the number of the block they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.units: list[tuple[str, int]] = []
        self.stack: list[str] = []
        self.skipped = 0
        self.block = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            self.break_node()
            return
        self.stack.append(tag)
        self.skipped += tag in SKIPPED
        if tag in BLOCKS:
            self.block += 1
        self.break_node()

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.break_node()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:  # what was left open inside ends too
            while self.stack:
                top = self.stack.pop()
                self.skipped -= top in SKIPPED
                if top == tag:
                    break
        if tag in BLOCKS:
            self.block += 1
        self.break_node()

    def handle_comment(self, data: str) -> None:
        pass

    def break_node(self) -> None:
        self.fresh = True

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.units and not getattr(self, "fresh", True):
            text, block = self.units[-1]
            self.units[-1] = (text + data, block)
        else:
            self.units.append((data, self.block))
        self.fresh = False


def units_of(html: str | None, bare: bool = True) -> list[tuple[str, int]]:
    """Non-blank text nodes of a page in order, with block numbers; none of a null page.

    bare: whether references without a semicolon count, as they do in a browser.
    """
    if not html:
        return []
    parser = UnitParser()
    parser.feed(html if bare else ended_references(html))
    parser.close()
    return [(t, b) for t, b in parser.units if t.strip("\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")]


def _run(batches: Iterator[pa.RecordBatch], bare: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[{"text": t, "block": b, "kind": "text"} for t, b in units_of(h, bare)] for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(rows, UNIT_ARROW)], names=["page_id", "units"])


def page_units(pages: DataFrame, bare: bool = True) -> DataFrame:
    """page_id and units, the text nodes that aren't inside skipped elements; bare as in units_of.

    Tokenizing needs a parser's state, so it runs in Arrow batches; all that follows is columns.
    Places on a screen don't exist in raw pages and stay null.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(partial(_run, bare=bare), f"page_id {kind}, units {UNIT}")
