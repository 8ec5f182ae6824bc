"""Continuations of lists and code, shared and markerless notes, table fragments, spreads: relations by layout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators.relations import DOC, same_page_pairs, sides
from docloom.operators.sections import _document


def _points(*rules: tuple[Column, float]) -> Column:
    """The sum of the points of the rules that hold, from .10 on, at most .90."""
    total = F.lit(0.10)
    for rule, points in rules:
        total = total + F.when(F.coalesce(rule, F.lit(False)), points).otherwise(0.0)
    return F.round(F.least(F.lit(0.9), total), 3)


def _next_page(last: DataFrame, first: DataFrame) -> DataFrame:
    a, b = sides(last)[0], sides(first)[1]
    return a.join(b, (F.col("a_document_id") == F.col("b_document_id")) & (F.col("a_page_index") + 1 == F.col("b_page_index")))


def _edges(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The last and the first block of a kind on each page."""
    own = rows.where(F.col("element_type") == kind)
    nth = lambda order: own.withColumn("rn", F.row_number().over(Window.partitionBy(DOC, "page_index").orderBy(order))).where("rn = 1").drop("rn")
    return nth(F.desc("reading_order")), nth(F.col("reading_order"))


def list_continuations(elements: DataFrame, least: float = 0.65) -> DataFrame:
    met = _next_page(*_edges(elements, "list"))
    reference = lambda c: F.rlike(c, F.lit(r"(?i)^\s*(?:\[[0-9]+\]|[0-9]+\.\s).*\b(?:19|20)[0-9]{2}\b"))
    score = _points(
        ((F.col("a_y2") >= 0.72) & (F.col("b_y1") <= 0.30), 0.25), (F.col("a_section_id") == F.col("b_section_id"), 0.15), (F.rlike("a_text", F.lit(r"[,;:]\s*$")), 0.20), (F.rlike("b_text", F.lit(r"^\s*\p{Ll}")), 0.15),
        (reference(F.col("a_text")) & reference(F.col("b_text")), 0.15),
    )
    return met.withColumn("score", score).where(F.col("score") >= least).select(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("source_id"), F.col("b_element_id").alias("target_id"), "score")


def code_continuations(elements: DataFrame, least: float = 0.60) -> DataFrame:
    met = _next_page(*_edges(elements, "code"))
    open_block = ~F.rlike("a_text", F.lit(r"(?:[};]|\bend\b|\breturn\b[^\n]*)\s*$"))
    fresh = F.rlike("b_text", F.lit(r"^\s*(?:def|class|function|public|private|import|from|#include|package)\b"))
    alike = (F.abs((F.col("a_x2") - F.col("a_x1")) - (F.col("b_x2") - F.col("b_x1"))) <= 0.1) & (F.abs(F.col("a_x1") - F.col("b_x1")) <= 0.1)
    score = _points(
        (F.lit(True), 0.15), (F.col("a_y2") >= 0.80, 0.15), (F.col("b_y1") <= 0.25, 0.15), (F.col("a_section_id") == F.col("b_section_id"), 0.05), (alike, 0.15), (open_block, 0.10), (F.lower("b_text").contains("continued"), 0.15), (fresh, -0.10),
    )
    return met.withColumn("score", score).where(F.col("score") >= least).select(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("source_id"), F.col("b_element_id").alias("target_id"), "score")


def markerless_notes(elements: DataFrame, anchored: DataFrame) -> DataFrame:
    """Footnotes without a target right below one that has a target: it becomes theirs. anchored(document_id, footnote_id, target_id)."""
    notes = elements.where("element_type = 'footnote'")
    pairs = same_page_pairs(notes).where((F.col("b_y2") <= F.col("a_y1") + 1e-9) & (G.v_gap("a_", "b_") <= 0.035) & (G.h_overlap("a_", "b_") >= 0.60)).withColumnRenamed("a_document_id", DOC)
    free = pairs.join(anchored.select(DOC, F.col("footnote_id").alias("a_element_id")), [DOC, "a_element_id"], "left_anti")
    met = free.join(anchored.withColumnRenamed("footnote_id", "b_element_id"), [DOC, "b_element_id"])
    return met.groupBy(DOC, F.col("a_element_id").alias("footnote_id")).agg(F.max_by("target_id", F.struct("b_y2", "b_element_id")).alias("target_id"))


def caption_groups(elements: DataFrame) -> DataFrame:
    """Captions with at least two visuals on their page within .10 that share a fifth of their width."""
    pairs = same_page_pairs(elements).where("a_element_type = 'caption' and b_element_type in ('figure', 'chart', 'table')").where((G.v_gap("a_", "b_") <= 0.10) & (G.h_overlap("a_", "b_") >= 0.20))
    return pairs.groupBy(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("caption_id")).agg(F.sort_array(F.collect_list("b_element_id")).alias("members")).where(F.size("members") >= 2)


def shared_note_members(elements: DataFrame, anchored: DataFrame) -> DataFrame:
    """Visuals that a note below several of them belongs to as well as its target: a row with the target (shared height .70, widths within 1.8), which together the note spans (.80).

    anchored(document_id, footnote_id, target_id) -> (document_id, footnote_id, member_id), two members at least.
    """
    visual = elements.where("element_type in ('figure', 'chart', 'table')")
    rows = same_page_pairs(visual).where((G.v_overlap("a_", "b_") >= 0.70) & (G.width_ratio("a_", "b_") <= 1.8))
    rows = rows.select(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("target_id"), F.col("b_element_id").alias("member_id"), "b_x1", "b_x2")
    own = visual.select(DOC, F.col("element_id").alias("target_id"), F.col("element_id").alias("member_id"), F.col("x1").alias("b_x1"), F.col("x2").alias("b_x2"))
    met = anchored.join(rows.unionByName(own), [DOC, "target_id"]).join(elements.select(DOC, F.col("element_id").alias("footnote_id"), F.col("x1").alias("n_x1"), F.col("x2").alias("n_x2")), [DOC, "footnote_id"])
    span = met.groupBy(DOC, "footnote_id").agg(F.collect_set("member_id").alias("members"), F.min("b_x1").alias("lo"), F.max("b_x2").alias("hi"), F.first("n_x1").alias("n_x1"), F.first("n_x2").alias("n_x2"))
    covered = (F.least("hi", "n_x2") - F.greatest("lo", "n_x1")) / (F.col("hi") - F.col("lo"))
    return span.where((F.size("members") >= 2) & (covered >= 0.80)).select(DOC, "footnote_id", F.explode("members").alias("member_id"))


def panel_members(elements: DataFrame, primary: DataFrame) -> DataFrame:
    """Visuals of a row with the primary target of a caption: gap <= .08 to the caption, width shared >= .25, row shared >= .65. primary(document_id, caption_id, target_id)."""
    visual = elements.where("element_type in ('figure', 'chart')")
    rows = same_page_pairs(visual).where(G.v_overlap("a_", "b_") >= 0.65).select(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("target_id"), F.col("b_element_id").alias("member_id"))
    near = same_page_pairs(elements).where("a_element_type = 'caption'").where((G.v_gap("a_", "b_") <= 0.08) & (G.h_overlap("a_", "b_") >= 0.25)).select(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("caption_id"), F.col("b_element_id").alias("member_id"))
    return primary.join(rows, [DOC, "target_id"]).join(near, [DOC, "caption_id", "member_id"]).select(DOC, "caption_id", "member_id")


def composite_fallback(mentions: DataFrame, elements: DataFrame, resolved: DataFrame) -> DataFrame:
    """For mentions without a target: the one tall visual that stands later on the page, if there is exactly one."""
    open_ = mentions.join(resolved.where("target_id is not null").select(DOC, "source_id", "kind", "number"), [DOC, "source_id", "kind", "number"], "left_anti")
    source = elements.select(DOC, F.col("element_id").alias("source_id"), F.col("reading_order").alias("s_order"))
    tall = elements.where("element_type in ('figure', 'chart') and y2 - y1 >= 0.25").select(DOC, "page_index", F.col("element_id").alias("target_id"), "reading_order")
    met = open_.join(source, [DOC, "source_id"]).join(tall, [DOC, "page_index"]).where("reading_order > s_order")
    return met.groupBy(DOC, "source_id", "kind", "number").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id")).where("n = 1").drop("n")


def duplicate_code(elements: DataFrame, ratio: float = 0.72) -> DataFrame:
    """Later code blocks of a page whose box shares .45 with an earlier one and whose words are alike."""
    pairs = same_page_pairs(elements.where("element_type = 'code'")).where("a_reading_order < b_reading_order").where(G.iou("a_", "b_") >= 0.45)
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\W+"))
    alike = 2 * F.size(F.array_intersect(words("a_text"), words("b_text"))) / (F.size(words("a_text")) + F.size(words("b_text")))
    return pairs.where(alike >= ratio).select(F.col("b_document_id").alias(DOC), F.col("b_element_id").alias("element_id"), F.col("a_element_id").alias("same_as")).distinct()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for table, (fragments, whole) in enumerate(zip(batch.column("fragments").to_pylist(), batch.column("whole").to_pylist(), strict=True)):
            at, whole = 0, whole or []
            for fragment in fragments:
                i, rows, found = fragment["fragment_index"], fragment["rows"] or [], None
                for skip in range(4 if i else 1):
                    part = rows[skip:]
                    if skip and rows[:skip] != whole[:skip] or not part:
                        break
                    places = [k for k in range(at, len(whole) - len(part) + 1) if whole[k : k + len(part)] == part]
                    if len(places) == 1:
                        found = (places[0], places[0] + len(part), skip)
                        break
                out.append((table, i, *(found or (None, None, None))))
                at = found[1] if found else at
        rows = list(zip(*out, strict=True)) or [()] * 5
        own = [batch.column(c).take(pa.array(rows[0], pa.int64())) for c in batch.schema.names if c not in ("fragments", "whole")]
        yield pa.RecordBatch.from_arrays(own + [pa.array(c, pa.int32()) for c in rows[1:]], [*(c for c in batch.schema.names if c not in ("fragments", "whole")), "fragment_index", "row_start", "row_end", "header_rows"])


def fragment_positions(fragments: DataFrame) -> DataFrame:
    """fragments(document_id, group_id, fragment_index, rows array, whole array): where each fragment's rows stand in the whole table.

    A fragment must stand at exactly one place at or after the end of the one before; up to three repeated header rows are left out.
    A table's fragments are placed in order, for each begins where the last one ended; many tables go through Python together.
    """
    key = [*_document(fragments), "group_id"]
    tables = fragments.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("fragment_index", "rows"))).alias("fragments"), F.first("whole").alias("whole"))
    kept = ", ".join(f"{c} string" for c in key)
    return tables.select(*(F.col(c).cast("string").alias(c) for c in key), "fragments", "whole").mapInArrow(_placed, f"{kept}, fragment_index int, row_start int, row_end int, header_rows int")


def inherited_headers(fragments: DataFrame) -> DataFrame:
    """fragments(document_id, group_id, fragment_index, headers): a fragment without headers takes those of the first that has some."""
    w = Window.partitionBy(*_document(fragments), "group_id").orderBy("fragment_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return fragments.withColumn("headers", F.coalesce("headers", F.first("headers", ignorenulls=True).over(w)))


def sequence_support(labels: DataFrame) -> DataFrame:
    """labels(doc, page_index, number, x): labels that a neighbour within two pages supports: in step, and at the same height of the line."""
    a = labels.select("doc", "page_index", "number", "x", F.explode(F.array(*(F.lit(k) for k in (-2, -1, 1, 2)))).alias("step"))
    b = labels.select("doc", F.col("page_index").alias("q"), F.col("number").alias("n2"), F.col("x").alias("x2"))
    met = a.join(b, (a["doc"] == b["doc"]) & (F.col("page_index") + F.col("step") == F.col("q"))).select(a["doc"], "page_index", "number", "step", "n2", "x", "x2")
    gap = (F.col("n2") - F.col("number")) / F.col("step")
    return met.where(gap.between(1, 2) & (F.abs(F.col("x2") - F.col("x")) <= 0.20)).select("doc", "page_index", "number").distinct()


def spread_labels(labels: DataFrame) -> DataFrame:
    """labels(doc, page_index, number): pages between two labelled ones whose numbers grow twice as fast hold two printed pages each."""
    w = Window.partitionBy("doc").orderBy("page_index")
    known = labels.withColumns({"np": F.lead("page_index").over(w), "nn": F.lead("number").over(w)})
    gap = F.col("np") - F.col("page_index")
    rows = known.where((F.col("nn") - F.col("number") == 2 * gap) & (gap >= 1)).select("doc", "page_index", "number", F.explode(F.sequence(F.lit(0), gap - 1)).alias("k"))
    first = F.col("number") + 2 * F.col("k")
    return rows.select("doc", (F.col("page_index") + F.col("k")).alias("page_index"), F.array(first, first + 1).alias("numbers"))
