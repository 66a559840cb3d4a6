"""HTML pages as lines of text, tables as rows of cells.

The standard parser turns each page into events: strings and breaks with the tables, rows and cells that are open around them. All else is grouping: strings to cells, cells to rows,
rows to tables, and these with the other strings to pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import CLOSE, OPEN

#: Elements that end a line, those that hold no shown text, and those without an end tag.
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 tr".split())
HIDDEN = frozenset(("script", "style", "head"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DASHES = "‐‑‒–—―−"
_EVENT = "at int, kind string, data string, outer_table int, cells array<struct<row_at:int,cell_at:int>>"
#: What of a page's events is held before it is sent on.
_ROWS = 10_000


class _Events(HTMLParser):
    """(at, kind, data, outermost open table, open cells of its rows) of strings, breaks and ends. An end tag closes the nearest open element of its name and those inside it, without events of theirs but of the lines they end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at, self.open, self.out, self.hidden = 0, [], [], 0

    def _add(self, kind: str, data: str = "") -> None:
        if self.hidden:
            return
        outer = next((at for tag, at in self.open if tag == "table"), None)
        within = self.open if outer is None else [x for x in self.open if x[1] >= outer]
        inside = [{"row_at": row, "cell_at": cell} for (up, row), (tag, cell) in zip(within, within[1:], strict=False) if up == "tr" and tag in ("td", "th")]
        self.out.append((self.at, kind, data, outer, inside))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.at += 1
        if tag == "br":
            self._add("break")
        elif tag not in VOID:
            self.open.append((tag, self.at))
            self.hidden += tag in HIDDEN
            if tag in ("td", "th", "table"):
                self._add("start", tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at += 1
        if tag == "br":
            self._add("break")

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            last = None
            while last != tag:
                last = self._leave()

    def _leave(self) -> str:
        tag, _ = self.open[-1]
        self.at += 1
        if tag in BLOCKS or tag in ("table", "td", "th"):
            self._add("end", tag)
        self.open.pop()
        self.hidden -= tag in HIDDEN
        return tag

    def handle_data(self, data: str) -> None:
        self.at += 1
        self._add("text", re.sub(r"[\r\n]+", " ", data))

    def close(self) -> None:
        super().close()
        while self.open:
            self._leave()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("row_at", pa.int32()), ("cell_at", pa.int32())]))]
    names = ["at", "kind", "data", "outer_table", "cells"]
    for b in batches:
        for i, html in enumerate(b.column(1).to_pylist()):
            parser = _Events()
            parser.out.append((0, "page", None if html is None else "", None, []))
            parser.feed(html or "")
            parser.close()
            for j in range(0, len(parser.out), _ROWS):
                part = list(zip(*parser.out[j : j + _ROWS], strict=True))
                key = b.column(0).take(pa.array([i] * len(part[0]), pa.int32()))
                yield pa.RecordBatch.from_arrays([key, *(pa.array(x, k) for x, k in zip(part, kinds, strict=True))], ["page", *names])


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "\xa0" + _DASHES, " " + "-" * len(_DASHES)), "\u200b", "")


def tidy_lines(text: Column) -> Column:
    """Inner spaces as one, runs of blank lines as one, none at the ends."""
    trimmed = F.regexp_replace(F.regexp_replace(_plain(text), r"[ \t]+", " "), r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def merge_cells(texts: Column) -> Column:
    """An opening sign joins the cell after it, a closing one the cell before, so a value has one cell; empty cells go."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("sign"))
    n = lambda s: F.size(s["out"])
    closing = lambda s, c: F.concat(F.slice(s["out"], F.lit(1), n(s) - 1), F.array(F.concat(F.element_at(s["out"], -1), c)))

    def step(s: Column, c: Column) -> Column:
        opens, closes = c.isin("$", "(", "$(", "($"), (n(s) > 0) & c.rlike(r"^[)%]+$")
        out = F.when(opens, s["out"]).when(closes, closing(s, c)).otherwise(F.array_append(s["out"], F.concat(s["sign"], c)))
        return F.struct(out.alias("out"), F.when(opens, F.concat(s["sign"], c)).when(closes, s["sign"]).otherwise("").alias("sign"))

    return F.aggregate(F.filter(texts, lambda c: c != ""), state, step)["out"]


def _in_order(order: str, text: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), by)


def page_lines(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, flat) a page. text: a line a block, outermost tables as rows of ` | ` between marks, rows of inner tables after the row that holds them. flat: no marks, cells parted by ` | `,
    typographic quotes plain too. Null for null, empty for empty. Rows that are equal in key and page are one; a key may be null or have several pages. Other columns are not read."""
    page = df.select(F.struct(F.col(key).alias("key"), F.xxhash64(html).alias("version"), F.length(html).alias("n")).alias("page"), F.col(html).alias("html")).dropDuplicates(["page"])
    kind = page.schema["page"].dataType.simpleString()
    events = page.mapInArrow(_parse, f"page {kind}, {_EVENT}")
    # Strings to cells, cells to rows, rows to tables. A cell's strings are all inside it, inner tables' too.
    inside = events.where("outer_table is not null").select("page", "outer_table", "at", F.col("kind"), "data", F.explode("cells").alias("c")).select("page", "outer_table", "at", "kind", "data", "c.*")
    piece = inside.withColumn("s", F.when(F.col("kind") == "text", F.col("data")))
    cells = piece.groupBy("page", "outer_table", "row_at", "cell_at").agg(_in_order("at", "s", " ").alias("cell"))
    clean = F.translate(F.regexp_replace(F.regexp_replace(_plain(F.col("cell")), r"(?U)\s+", " "), "^ | $", ""), "|", "/")
    rows = cells.withColumn("cell", clean).groupBy("page", "outer_table", "row_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_at", "cell"))), lambda x: x["cell"]).alias("row"))
    rows = rows.withColumn("row", merge_cells(F.col("row"))).where(F.size("row") > 0).withColumn("line", F.array_join("row", " | "))
    tables = rows.groupBy("page", "outer_table").agg(_in_order("row_at", "line", "\n").alias("rows"))
    # A table stands where it begins; one without rows has its marks only.
    begins = events.where("kind = 'start' and data = 'table' and at = outer_table").select("page", "outer_table").join(tables, ["page", "outer_table"], "left")
    marked = begins.select("page", F.col("outer_table").alias("at"), F.concat(F.lit(f"\n{OPEN}\n"), F.coalesce(F.concat("rows", F.lit("\n")), F.lit("")), F.lit(f"{CLOSE}\n")).alias("s"), F.lit(None).cast("string").alias("f"))
    breaks = (F.col("kind") == "break") | ((F.col("kind") == "end") & F.col("data").isin(*BLOCKS))
    flat = F.when(F.col("kind").isin("text", "page"), F.col("data")).when(breaks | ((F.col("kind") == "end") & (F.col("data") == "table")), "\n").when(F.col("kind") == "end", " | ")
    own = F.when(F.col("outer_table").isNull(), F.when(F.col("kind").isin("text", "page"), F.col("data")).when(breaks, "\n"))
    strings = events.select("page", "at", own.alias("s"), flat.alias("f"))
    known = F.max(F.when(F.col("at") == 0, F.col("s")))  # empty for a page, null for none
    both = strings.unionByName(marked).groupBy("page").agg(_in_order("at", "s", "").alias("s"), _in_order("at", "f", "").alias("f"), known.alias("known"))
    quotes = F.translate("f", "’‘“”", "''\"\"")
    bare = F.regexp_replace(F.regexp_replace(quotes, r"(?md)^[ \t|]+", ""), r"(?md)[ \t|]+$", "")
    shown = lambda c: F.when(F.col("known").isNotNull(), tidy_lines(c))
    return both.select(F.col("page.key").alias(key), shown(F.col("s")).alias("text"), shown(bare).alias("flat"))
