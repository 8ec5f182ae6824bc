"""Tables in HTML as grids: cells with their places and spans, what is wrong with a table, and checks of the grid.

A cell stands in the first columns of its row that are free over its whole width; it takes up its rowspan and colspan, also beyond the last row. Rows
of tables inside cells are not the table's own. cells() is one pass in Arrow batches; occupancy, checks and categories are joins and aggregates over its rows.

Defined results: null and blank html is no_html, one without rows no_rows; spans that are no numbers from 1 to MOST_SPAN count as 1 and are invalid_span; a table inside a table is nested_table
and gives no cells; repeated tables are tables of their own rows each; an empty table of tables gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SPAN = 1000
#: Tables that a task reads together.
TOGETHER = 2000
#: The placeholder that stands for a picture which was not kept.
PLACEHOLDER = r"(?i)(?:&lt;|<)image\s*\d+(?:&gt;|>)"
_SCHEMA = "table_id string, rows array<struct<r: int, c: int, rowspan: int, colspan: int, header: boolean, text: string, images: array<string>>>, nested int, invalid_spans int, has_rows boolean"
_CELL = pa.struct([("r", pa.int32()), ("c", pa.int32()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("header", pa.bool_()), ("text", pa.string()), ("images", pa.list_(pa.string()))])


class _Rows(HTMLParser):
    """Rows of the outermost table: [rowspan, colspan, header, texts, images] each cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.cell: list | None = None
        self.depth = self.nested = self.invalid = 0

    def _span(self, given: str | None) -> int:
        if given is None:
            return 1
        given = given.strip()
        if given.isdecimal() and 1 <= int(given) <= MOST_SPAN:
            return int(given)
        self.invalid += 1
        return 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.depth += 1
            self.nested += self.depth > 1
        elif self.depth > 1:
            return
        elif tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th"):
            own = dict(attrs)
            self.cell = [self._span(own.get("rowspan")), self._span(own.get("colspan")), tag == "th", [], []]
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell)
        elif tag == "img" and self.cell is not None:
            if source := dict(attrs).get("src"):
                self.cell[4].append(source.replace("\\", "/"))
        elif tag == "br" and self.cell is not None:
            self.cell[3].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif tag in ("td", "th") and self.depth <= 1:
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None and self.depth <= 1:
            self.cell[3].append(data)


#: A tag without anything odd about it, or the text between two; whatever else a table holds, it is read by HTMLParser.
_PIECE = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z-]*(?:=(?:"[^"<>]*"|[a-zA-Z0-9]+))?)*)[ \t\n]*>|([^<]+)""")
_PART = re.compile(r"""([a-zA-Z][a-zA-Z-]*)(?:=(?:"([^"<>]*)"|([a-zA-Z0-9]+)))?""")
_OWN_RULES = frozenset("script style textarea title xmp iframe noembed noframes plaintext noscript".split())


@lru_cache(4096)
def _attributes(text: str) -> list[tuple[str, str | None]]:
    return [(m[1].lower(), unescape(v) if (v := m[2] if m[2] is not None else m[3]) is not None else None) for m in _PART.finditer(text)]


def _read(html: str) -> _Rows:
    """The rows of a table; as _Rows reads them by itself, but plain tags are cut by one pattern."""
    parser, at = _Rows(), 0
    for m in _PIECE.finditer(html):
        if m.start() != at:
            break
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None:
            parser.handle_data(unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if tag in _OWN_RULES or closing and attributes:
            break
        if closing:
            parser.handle_endtag(tag)
        else:
            parser.handle_starttag(tag, _attributes(attributes) if attributes else [])
    else:
        if at == len(html):
            return parser
    parser = _Rows()
    parser.feed(html)
    parser.close()
    return parser


def _placed(rows: list[list[list]], out: list[list]) -> int:
    """Adds the cells with their places to the columns of out, and counts them; `until` says for each column up to which row it is taken."""
    until: dict[int, int] = {}
    n = 0
    for r, row in enumerate(rows):
        c = 0
        for down, across, header, texts, images in row:
            if across == 1:
                while until.get(c, 0) > r:
                    c += 1
            else:
                while (taken := next((k for k in range(c + across - 1, c - 1, -1) if until.get(k, 0) > r), None)) is not None:
                    c = taken + 1
            for column, x in zip(out, (r, c, down, across, header, " ".join("".join(texts).split()), images), strict=True):
                column.append(x)
            for k in range(c, c + across):
                until[k] = r + down
            c += across
            n += 1
    return n


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(at, TOGETHER)
            cells, ends, nested, invalid, filled = [[] for _ in _CELL], [0], [], [], []
            for html in batch.column("html").to_pylist():
                parser = _read(html)
                ends.append(ends[-1] + _placed(parser.rows, cells))
                nested.append(parser.nested)
                invalid.append(parser.invalid)
                filled.append(bool(parser.rows))
            rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _CELL, strict=True)], fields=list(_CELL))
            yield pa.RecordBatch.from_arrays([batch.column("table_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(nested, pa.int32()), pa.array(invalid, pa.int32()), pa.array(filled)], ["table_id", "rows", "nested", "invalid_spans", "has_rows"])


def views(tables: DataFrame) -> DataFrame:
    """tables(table_id, html) -> (table_id, rows array of cells, nested, invalid_spans, has_rows, category, row_count, column_count)."""
    own = tables.select(F.col("table_id").cast("string").alias("table_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    parsed = own.withColumn("category", F.when(F.trim("html") == "", "no_html").when(F.col("html").rlike(PLACEHOLDER), "unresolved_image_placeholder"))
    # the category travels in the id's column, so that the html is read once
    packed = parsed.select(F.to_json(F.struct("table_id", "category")).alias("table_id"), "html").mapInArrow(_parsed, _SCHEMA)
    known = packed.withColumn("k", F.from_json("table_id", "table_id string, category string"))
    pictured = F.exists("rows", lambda x: F.size(x["images"]) > 0)
    category = F.coalesce("k.category", F.when(pictured, F.lit("internal_images")).otherwise(F.lit("structured_text_only")))
    size = lambda a, b: F.coalesce(F.array_max(F.transform("rows", lambda x: x[a] + x[b])), F.lit(0))
    return known.select("k.table_id", "rows", "nested", "invalid_spans", "has_rows", category.alias("category"), size("r", "rowspan").alias("row_count"), size("c", "colspan").alias("column_count"))


def cells(found: DataFrame) -> DataFrame:
    """views() -> a row a cell: table_id, cell (its number), r, c, rowspan, colspan, header, text."""
    return found.select("table_id", F.posexplode("rows").alias("cell", "x")).select("table_id", "cell", "x.r", "x.c", "x.rowspan", "x.colspan", "x.header", "x.text")


def occupancy(found: DataFrame) -> DataFrame:
    """cells() -> a row for each place of the grid that a cell takes up: table_id, row, col, cell."""
    rows = found.select("table_id", "cell", "c", "colspan", F.explode(F.sequence("r", F.col("r") + F.col("rowspan") - 1)).alias("row"))
    return rows.select("table_id", "row", F.explode(F.sequence("c", F.col("c") + F.col("colspan") - 1)).alias("col"), "cell")


def issues(found: DataFrame) -> DataFrame:
    """views() -> (table_id, issue, n)."""
    kinds = F.array(
        F.struct(F.lit("no_html").alias("issue"), (F.col("category") == "no_html").cast("int").alias("n")), F.struct(F.lit("nested_table").alias("issue"), F.col("nested").alias("n")),
        F.struct(F.lit("invalid_span").alias("issue"), F.col("invalid_spans").alias("n")), F.struct(F.lit("no_rows").alias("issue"), (~F.col("has_rows") & (F.col("category") != "no_html")).cast("int").alias("n")),
    )
    return found.select("table_id", F.inline(kinds)).where("n > 0")


def checks(found: DataFrame) -> DataFrame:
    """views() -> (table_id, cells, places, twice: places that two cells take up, empty: places of the grid that none does, passed)."""
    # a table's cells are one row, so its grid is checked inside it
    taken = F.flatten(F.transform("rows", lambda x: F.flatten(F.transform(F.sequence(x["r"], x["r"] + x["rowspan"] - 1), lambda r: F.transform(F.sequence(x["c"], x["c"] + x["colspan"] - 1), lambda c: r * F.lit(1 << 20) + c)))))
    rows = found.select("table_id", F.size("rows").alias("cells"), "row_count", "column_count", F.when(F.size("rows") > 0, taken).otherwise(F.array().cast("array<int>")).alias("taken"))
    once = F.size(F.array_distinct("taken"))
    return rows.select("table_id", "cells", F.size("taken").alias("places"), (F.size("taken") - once).alias("twice"), (F.col("row_count") * F.col("column_count") - once).alias("empty"), (F.size("taken") == once).alias("passed"))
