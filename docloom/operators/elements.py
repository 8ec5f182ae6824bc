"""Document tables derived from plain texts and pages: elements, pages, sections and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES_PER_PAGE = 8


def elements(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> one row a non-blank line: doc_id, pos, page_index, line."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.floor(F.col("pos") / LINES_PER_PAGE).alias("page_index"), "line")


def next_in_order(rows: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """Edges from each item to the next of its group."""
    ahead = F.lead(item).over(Window.partitionBy(group).orderBy(order))
    return rows.select(group, F.col(item).alias("source"), ahead.alias("target")).where("target is not null")


def containment(rows: DataFrame) -> DataFrame:
    """document -> page and page -> element edges, as (kind, source, target)."""
    page = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("page_index").cast("string"))
    pages = rows.select("doc_id", "page_index").distinct().select(F.lit("document_page").alias("kind"), F.col("doc_id").cast("string").alias("source"), page.alias("target"))
    items = rows.select(F.lit("page_element").alias("kind"), page.alias("source"), F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("target"))
    return pages.unionByName(items)


def html_blocks(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> headings, paragraphs and items in order: page_id, pos, tag, text."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h[1-6]|p|li)>[^<]*"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "block"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("block", "<([a-z0-9]+)>", 1).alias("tag"), F.trim(F.regexp_replace("block", "<[^>]*>", "")).alias("text"))


def current_heading(blocks: DataFrame) -> DataFrame:
    """Each block with the position of the nearest heading at or before it."""
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading_pos", F.last(F.when(F.col("tag").like("h_"), F.col("pos")), ignorenulls=True).over(before))


def parent_headings(headings: DataFrame) -> DataFrame:
    """headings(doc, pos, level) -> with parent_pos: the nearest earlier heading of a lower level.

    The nearest earlier heading of each single level is a running maximum, so there is no pair join.
    """
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    of_level = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(1, 7)]
    with_all = headings.withColumns({f"_l{k}": c for k, c in enumerate(of_level, 1)})
    lower = [F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, 7)]
    return with_all.withColumn("parent_pos", F.greatest(*lower)).drop(*(f"_l{k}" for k in range(1, 7)))
