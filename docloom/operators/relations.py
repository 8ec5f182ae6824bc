"""Relations between elements: spatial neighbours, captions, footnotes, references, continuations, closures.

elements have document_id, element_id, page_index, reading_order, element_type, text, x1, y1, x2, y2 and section_id; every pair join is an
equi-join on the document (and page), with the geometry as what remains of the condition.

Null boxes fail every geometric test, null texts every textual one; equal candidates are told apart by their ids; empty tables give empty
results.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import paragraphs as P
from docloom.functions.text import LABELS, open_ended
from docloom.lineage import cut_lineage

BOX = ("x1", "y1", "x2", "y2")
COMPATIBLE = {"figure": ("figure", "chart"), "table": ("table",)}


def sides(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements twice, with all columns prefixed a_ and b_."""
    return tuple(elements.select(*(F.col(c).alias(f"{p}{c}") for c in elements.columns)) for p in ("a_", "b_"))


DOC = "document_id"


def same_page_pairs(elements: DataFrame, keys: tuple[str, ...] = (DOC, "page_index")) -> DataFrame:
    a, b = sides(elements)
    on = F.col("a_element_id") != F.col("b_element_id")
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return a.join(b, on)


def neighbours(elements: DataFrame, most: float = 0.1) -> DataFrame:
    """For pairs on a page: distance, and whether b is near, above, below, in the same column or overlapping."""
    pairs = same_page_pairs(elements)
    return pairs.select(
        F.col("a_document_id").alias(DOC), "a_element_id", "b_element_id", G.distance("a_", "b_").alias("distance"), (G.distance("a_", "b_") <= most).alias("nearby"), (F.col("b_y2") <= F.col("a_y1")).alias("above"), (F.col("b_y1") >= F.col("a_y2")).alias("below"),
        (G.h_overlap("a_", "b_") >= 0.5).alias("same_column"), (G.iou("a_", "b_") > 0).alias("overlapping"),
    )


def nearest_target(captions: DataFrame, targets: DataFrame, radius: int = 1) -> DataFrame:
    """The nearest compatible target of each caption within some pages: same page first, then a target before it, then by reading distance.

    Pages are matched by equality: a target is offered to each page of its radius.
    """
    kind = F.when(F.lower("text").rlike("^(table|tab)"), "table").otherwise("figure")
    c = captions.withColumn("kind", kind).select(DOC, F.col("element_id").alias("caption_id"), F.col("page_index").alias("at"), F.col("reading_order").alias("c_order"), "kind")
    t = targets.withColumn("kind", F.when(F.col("element_type") == "table", "table").otherwise("figure")).select(DOC, F.col("element_id").alias("target_id"), "page_index", F.col("reading_order").alias("t_order"), "kind", F.explode(F.sequence(F.col("page_index") - radius, F.col("page_index") + radius)).alias("at"))
    key = F.struct((F.col("page_index") != F.col("at")).cast("int"), (F.col("t_order") > F.col("c_order")).cast("int"), F.abs(F.col("t_order") - F.col("c_order")), F.col("target_id"))
    return c.join(t, [DOC, "at", "kind"]).groupBy(DOC, "caption_id").agg(F.min_by(F.struct("target_id", (F.col("page_index") == F.col("at")).alias("same_page")), key).alias("x")).select(
        DOC, "caption_id", "x.target_id", F.when(F.col("x.same_page"), 0.95).otherwise(0.78).alias("confidence"))


def marker_targets(elements: DataFrame) -> DataFrame:
    """Footnotes with their marker and the nearest element before them on the page that holds it."""
    notes = elements.where("element_type = 'footnote'").select(DOC, F.col("element_id").alias("footnote_id"), "page_index", F.col("reading_order").alias("n_order"), F.regexp_extract("text", r"^\s*(\*+|[0-9]{1,2}|[a-z]\))", 1).alias("marker")).where("marker <> ''")
    others = elements.where("element_type <> 'footnote'").select(DOC, F.col("element_id").alias("target_id"), "page_index", "reading_order", "text")
    met = notes.join(others, [DOC, "page_index"]).where("reading_order < n_order and contains(text, marker)")
    return met.groupBy(DOC, "footnote_id", "marker").agg(F.max_by("target_id", "reading_order").alias("target_id"))


def footnote_score(parser: Column, marker: Column, same_page: Column, gap: Column, reading: Column, prefix: Column, y1: Column) -> Column:
    points = F.when(parser, 0.35).otherwise(0.0) + F.when(marker, 0.45).otherwise(0.0) + F.when(same_page, 0.15).otherwise(0.0)
    points = points + F.when(gap <= 0.08, 0.15).when(gap <= 0.18, 0.08).otherwise(0.0) + F.when(reading <= 2, 0.10).when(reading <= 5, 0.05).otherwise(0.0)
    return F.least(F.lit(0.98), points + F.when(prefix, 0.10).otherwise(0.0) + F.when(y1 >= 0.70, 0.05).otherwise(0.0))


def mentions(elements: DataFrame) -> DataFrame:
    """(document_id, source_id, kind, number, page_index, section_id) of the labels that texts name; captions name their own."""
    parts = []
    for kind, pattern in LABELS.items():
        parts.append(elements.where("element_type = 'paragraph'").select(DOC, F.col("element_id").alias("source_id"), F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("number"), "page_index", "section_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_references(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The best target of each mention: same section, priority, page distance, id; null where there is none."""
    t = labels.select(DOC, "kind", "number", "target_id", "priority", F.col("page_index").alias("t_page"), F.col("section_id").alias("t_section"))
    key = F.struct((F.col("section_id") != F.col("t_section")).cast("int"), -F.col("priority"), F.abs(F.col("page_index") - F.col("t_page")), F.col("target_id"))
    return found.join(t, [DOC, "kind", "number"], "left").groupBy(DOC, "source_id", "kind", "number").agg(F.min_by("target_id", key).alias("target_id"), F.count("target_id").alias("candidates"))


def scored_footnotes(elements: DataFrame, targets: DataFrame, parser: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """targets(document_id, footnote_id, marker, target_id) -> with score, and whether that confirms it; parser(document_id, footnote_id, target_id): what the parser bound."""
    side = lambda k, p: elements.select(DOC, F.col("element_id").alias(k), *(F.col(c).alias(f"{p}{c}") for c in ("page_index", "reading_order", "text", *BOX)))
    met = targets.join(side("footnote_id", "f_"), [DOC, "footnote_id"]).join(side("target_id", "t_"), [DOC, "target_id"])
    bound = F.lit(False)
    if parser is not None:
        met = met.join(parser.select(DOC, "footnote_id", "target_id", F.lit(True).alias("bound")), [DOC, "footnote_id", "target_id"], "left")
        bound = F.coalesce("bound", F.lit(False))
    prefix = F.startswith(F.ltrim("f_text"), F.col("marker"))
    score = footnote_score(bound, F.col("marker") != "", F.col("f_page_index") == F.col("t_page_index"), G.v_gap("f_", "t_"), F.abs(F.col("f_reading_order") - F.col("t_reading_order")), prefix, F.col("f_y1"))
    return met.select(DOC, "footnote_id", "target_id", F.round(score, 6).alias("score"), (score >= least).alias("confirmed"))


_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
_TABLE_LABEL = r"(?i)\b(?:table|tab\.)\s*([0-9]+(?:\.[0-9]+)*[a-z]?|[IVX]+)\b"
_FORM_LABEL = r"(?i)^\s*([0-9]+(?:\.[0-9]+)*)\s*[.)]?\s+.{0,180}?\bTable\b\s*[:.]?"


def table_columns(html: Column) -> Column:
    """Cells of the first row, or null."""
    n = F.size(F.regexp_extract_all(F.regexp_extract(html, _ROW, 1), F.lit(r"(?i)<t[hd]\b"), F.lit(0)))
    return F.when(n > 0, n)


def table_header_tokens(html: Column) -> Column:
    """Different words of the first two rows, of two letters or digits at least, folded."""
    rows = F.slice(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_ROW), F.lit(1)), 1, 2)
    words = F.regexp_extract_all(F.regexp_replace(F.array_join(rows, " "), r"<[^>]+>", " "), F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower))


def table_title_label(text: Column) -> Column:
    """The number of "Table 5", or of a form's "5. ... Table"; null without one."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "), r"\s+", " "))
    explicit, form = F.regexp_extract(plain, _TABLE_LABEL, 1), F.regexp_extract(plain, _FORM_LABEL, 1)
    return F.lower(F.when(explicit != "", explicit).when(form != "", form))


def with_table_profiles(elements: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """elements(..., html) with columns, header and label of each table; captions(document_id, target_id, text) name tables whose own text does not."""
    rows = elements.withColumns({"columns": table_columns(F.col("html")), "header": table_header_tokens(F.col("html")), "label": F.coalesce(table_title_label(F.col("text")), table_title_label(F.col("html")))})
    if captions is None:
        return rows
    named = captions.withColumn("_named", table_title_label(F.col("text"))).where("_named is not null").groupBy(DOC, F.col("target_id").alias("element_id")).agg(F.min("_named").alias("_named"))
    return rows.join(named, [DOC, "element_id"], "left").withColumn("label", F.coalesce("label", "_named")).drop("_named")


def table_continuations(elements: DataFrame, least: float = 0.5) -> DataFrame:
    """The last table of a page with the first of the next, scored by place, columns, header words and what the text says.

    columns, header and label are those of with_table_profiles(), where elements have them; else words of the text are counted and compared. Tables of two different labels are two tables:
    nothing joins them.
    """
    tables = elements.where("element_type = 'table'")
    order = lambda *c: Window.partitionBy(DOC, "page_index").orderBy(*c)
    last = tables.withColumn("rn", F.row_number().over(order(F.desc("reading_order")))).where("rn = 1").drop("rn")
    first = tables.withColumn("rn", F.row_number().over(order("reading_order"))).where("rn = 1").drop("rn")
    a, b = sides(last)[0], sides(first)[1]
    words = lambda p: F.col(f"{p}header") if "header" in elements.columns else F.array_distinct(F.split(F.lower(f"{p}text"), r"\s+"))
    columns = lambda p: F.col(f"{p}columns") if "columns" in elements.columns else F.size(F.split(F.trim(f"{p}text"), r"\s+"))
    jaccard = F.size(F.array_intersect(words("a_"), words("b_"))) / F.greatest(F.size(F.array_union(words("a_"), words("b_"))), F.lit(1))
    alike = (F.abs((F.col("a_x2") - F.col("a_x1")) - (F.col("b_x2") - F.col("b_x1"))) <= 0.1) & (F.abs((F.col("a_x1") + F.col("a_x2")) - (F.col("b_x1") + F.col("b_x2"))) <= 0.2)
    said = F.rlike("b_text", F.lit("(?i)continued|续"))
    rules = (((F.col("a_y2") >= 0.68) & (F.col("b_y1") <= 0.25), 0.1), (alike, 0.1), (jaccard >= 0.5, 0.2), (said, 0.3), (columns("a_") == columns("b_"), 0.1))
    score = sum((F.when(F.coalesce(rule, F.lit(False)), points).otherwise(0.0) for rule, points in rules), F.lit(0.2))
    met = a.join(b, (F.col("a_document_id") == F.col("b_document_id")) & (F.col("a_page_index") + 1 == F.col("b_page_index"))).withColumn("score", F.round(F.least(F.lit(0.9), score), 3))
    if "label" in elements.columns:
        met = met.where(F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(True)))
    return met.where(F.col("score") >= least).select(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("source_id"), F.col("b_element_id").alias("target_id"), "score")


def visual_bridges(elements: DataFrame) -> DataFrame:
    """Pages with visuals and without running text: (document_id, page_index)."""
    text = "element_type in ('heading', 'list', 'code') or (element_type = 'paragraph' and length(text) >= 25)"
    return elements.groupBy(DOC, "page_index").agg(F.count_if(F.expr("element_type in ('figure', 'chart', 'table')")).alias("visual"), F.count_if(F.expr(text)).alias("running")).where("visual > 0 and running = 0").select(DOC, "page_index")


def _rx(column: str, pattern: str) -> str:
    return f"{column} rlike r'{pattern}'"


def paragraph_continuations(elements: DataFrame, least: float = 0.55) -> DataFrame:
    """The best pair of paragraphs of each two pages in a row, or of two with nothing but visuals between; gates of one side filter it before the join."""
    text = elements.where("element_type = 'paragraph'")
    a, b = sides(text.where(open_ended(F.col("text"))))[0], sides(text)[1]
    offered = a.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("far")).withColumn("at", F.col("a_page_index") + F.col("far"))
    met = offered.join(b, (F.col("a_document_id") == F.col("b_document_id")) & (F.col("at") == F.col("b_page_index"))).withColumnRenamed("a_document_id", DOC)
    between = visual_bridges(elements).select(DOC, (F.col("page_index") - 1).alias("a_page_index"), F.lit(True).alias("between"))
    heads = elements.where("element_type = 'heading'").groupBy(DOC, F.col("page_index").alias("b_page_index")).agg(F.min("reading_order").alias("head"))
    met = met.join(between, [DOC, "a_page_index"], "left").join(heads, [DOC, "b_page_index"], "left")
    met = met.selectExpr("*", "coalesce(between, false) as bridged", "coalesce(head < b_reading_order, false) as headed", f"{P.layout()} as layout", f"{P.hyphen(_rx)} as hyphen", f"{P.seam(_rx)} as seam")
    met = met.withColumn("_overlap", G.h_overlap("a_", "b_")).where(P.gates(_rx))
    met = met.withColumn("score", F.round(F.least(F.lit(0.9), F.expr(P.score("_overlap", _rx)).cast("double")), 3)).where(F.col("score") >= least)
    key = F.struct(-F.col("score"), -F.col("a_reading_order"), F.col("b_reading_order"), F.col("a_element_id"), F.col("b_element_id"))
    best = met.groupBy(DOC, F.col("a_page_index").alias("page_index"), F.col("at").alias("target_page")).agg(F.min_by(F.struct(F.col("a_element_id").alias("source_id"), F.col("b_element_id").alias("target_id"), "score"), key).alias("x"))
    return best.select(DOC, "page_index", "target_page", "x.*")


def later_wins(relations: DataFrame) -> DataFrame:
    """Of a document's relations that share an id the one of the latest origin; what a human set stays whatever came later."""
    human = F.coalesce(F.col("human"), F.lit(False)) if "human" in relations.columns else F.lit(False)
    fields = [c for c in relations.columns if c not in (DOC, "relation_id")]
    return relations.groupBy(DOC, "relation_id").agg(F.max_by(F.struct(*fields), F.struct(human.cast("int"), F.col("origin"))).alias("x")).select(DOC, "relation_id", "x.*")


def referential_errors(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """(document_id, relation_id, error): ends that are no element of the document, relations with themselves, confidences beyond [0, 1], null kinds, ids that occur twice."""
    # both ends meet the elements in one join, and what a row shows by itself is found in one pass
    known = elements.select(DOC, F.col("element_id").alias("id"))
    ends = relations.select(DOC, "relation_id", F.explode(F.array(*(F.struct(F.col(f"{k}_id").alias("id"), F.lit(f"unknown_{k}").alias("error")) for k in ("source", "target")))).alias("x"))
    lost = ends.select(DOC, "relation_id", "x.id", "x.error").join(known, [DOC, "id"], "left_anti").select(DOC, "relation_id", "error")
    rules = (("source_id = target_id", "self_relation"), ("confidence is null or isnan(confidence) or confidence < 0 or confidence > 1", "confidence_range"), ("kind is null", "no_kind"))
    own = relations.select(DOC, "relation_id", F.explode(F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(error)) for rule, error in rules)))).alias("error"))
    twice = relations.groupBy(DOC, "relation_id").agg(F.count("*").alias("n")).where("n > 1").select(DOC, "relation_id", F.lit("repeated_id").alias("error"))
    return lost.union(own).union(twice)


def document_errors(pages: DataFrame, elements: DataFrame, sections: DataFrame, relations: DataFrame) -> DataFrame:
    """What the tables of documents name that is not there: (document_id, owner, id, error, missing).

    pages(document_id, page_id, element_ids), elements(document_id, element_id, page_id, section_id), sections(document_id, section_id, heading_id, parent_id, page_ids, element_ids), relations(document_id, relation_id, source_id, target_id).
    Ends of relations may be elements, pages or sections of their document. Null lists are empty; a null section or parent names nothing, a null page, heading or end is missing.
    """
    # what is there, a row an id, with the kinds it has
    ids = lambda rows, kind: rows.select(DOC, F.col(f"{kind}_id").alias("missing"), *(F.lit(k == kind).alias(f"_{k}") for k in ("element", "page", "section")))
    there = ids(elements, "element").union(ids(pages, "page")).union(ids(sections, "section")).groupBy(DOC, "missing").agg(*(F.max(f"_{k}").alias(f"_{k}") for k in ("element", "page", "section")))

    def named(rows: DataFrame, owner: str, missing: Column, error: str, optional: bool = False) -> DataFrame:
        out = rows.select(DOC, F.lit(owner).alias("owner"), F.col(f"{owner}_id").alias("id"), F.lit(error).alias("error"), missing.alias("missing"))
        return out.where("missing is not null") if optional else out

    held = pages.select(DOC, "page_id", F.explode("element_ids").alias("element_id"))
    of_section = lambda c: sections.select(DOC, "section_id", F.explode(c).alias("x"))
    parts = [
        (named(relations, "relation", F.col("source_id"), "missing_source"), "any"), (named(relations, "relation", F.col("target_id"), "missing_target"), "any"),
        (named(held, "page", F.col("element_id"), "missing_element"), "element"), (named(elements, "element", F.col("page_id"), "missing_page"), "page"), (named(elements, "element", F.col("section_id"), "missing_section", True), "section"),
        (named(sections, "section", F.col("heading_id"), "missing_heading"), "element"), (named(sections, "section", F.col("parent_id"), "missing_parent", True), "section"),
        (named(of_section("page_ids"), "section", F.col("x"), "missing_page"), "page"), (named(of_section("element_ids"), "section", F.col("x"), "missing_element"), "element"),
    ]
    other = held.join(elements.select(DOC, "element_id", F.col("page_id").alias("own")).distinct(), [DOC, "element_id"]).where(F.coalesce(F.col("own") != F.col("page_id"), F.lit(True)))
    out = other.select(DOC, F.lit("element").alias("owner"), F.col("element_id").alias("id"), F.lit("other_page").alias("error"), F.col("page_id").alias("missing"))
    # all names meet what is there in one join
    names = None
    for rows, kind in parts:
        own = rows.withColumn("_kind", F.lit(kind))
        names = own if names is None else names.unionByName(own)
    met = F.when(F.col("_kind") == "any", F.col("_element").isNotNull())
    for k in ("element", "page", "section"):
        met = met.when(F.col("_kind") == k, F.col(f"_{k}"))
    lost = names.join(there, [DOC, "missing"], "left").where(~F.coalesce(met, F.lit(False)))
    return out.unionByName(lost.select(*out.columns))


def continuation_closure(relations: DataFrame, least: float = 0.6) -> DataFrame:
    """relations(document_id, source_id, target_id, kind, confidence) -> (document_id, source_id, target_id, hops): all that a chain of continuations reaches, by its shortest path."""
    edges = cut_lineage(relations.where((F.col("kind") == "continues") & (F.col("confidence") >= least)).select(DOC, "source_id", "target_id").distinct())
    fresh = now = edges.withColumn("hops", F.lit(1))
    for hops in count(2):
        step = fresh.select(DOC, "source_id", F.col("target_id").alias("via")).join(edges.select(DOC, F.col("source_id").alias("via"), "target_id"), [DOC, "via"]).select(DOC, "source_id", "target_id").distinct()
        fresh = cut_lineage(step.join(now.select(DOC, "source_id", "target_id"), [DOC, "source_id", "target_id"], "left_anti").withColumn("hops", F.lit(hops)))
        if fresh.isEmpty():
            return now
        now = cut_lineage(now.unionByName(fresh))


def declared_captions(elements: DataFrame, declared: DataFrame, furniture: DataFrame) -> DataFrame:
    """declared(document_id, caption_id, target_id), furniture(document_id, element_id): the parser's captions, each with its confidence or the reason why it doesn't stand.

    A caption that says "table" fits tables, one that says "figure" or "chart" fits figures and charts, one without a label fits any visual.
    """
    kind = F.lower(F.regexp_extract("text", r"(?i)^\s*(table|tab|figure|fig|chart)\b", 1))
    side = elements.select(DOC, F.col("element_id").alias("caption_id"), kind.alias("_kind"))
    target = elements.select(DOC, F.col("element_id").alias("target_id"), F.col("element_type").alias("_type"))
    bars = furniture.select(DOC, F.col("element_id").alias("caption_id"), F.lit(True).alias("_bar")).distinct()
    met = declared.join(side, [DOC, "caption_id"], "left").join(target, [DOC, "target_id"], "left").join(bars, [DOC, "caption_id"], "left")
    fits = F.when(F.col("_kind").startswith("tab"), F.col("_type") == "table").when(F.col("_kind") != "", F.col("_type").isin("figure", "chart")).otherwise(F.col("_type").isin("figure", "chart", "table"))
    reason = F.when(F.col("_bar"), "running_header").when(F.col("_type").isNull(), "unknown_target").when(~fits, "other_kind")
    return met.select(DOC, "caption_id", "target_id", F.when(reason.isNull(), 1.0).alias("confidence"), reason.alias("reason"))


def repaired_captions(elements: DataFrame, wrong: DataFrame) -> DataFrame:
    """wrong(document_id, caption_id): captions of tables that were given something else: the nearest table of the page by vertical gap, then reading order and id, at .96."""
    pairs = same_page_pairs(elements).where("b_element_type = 'table'").withColumnRenamed("a_document_id", DOC)
    met = pairs.join(wrong.select(DOC, F.col("caption_id").alias("a_element_id")), [DOC, "a_element_id"]).where(F.rlike("a_text", F.lit(r"(?i)^\s*tab(?:le)?\b")))
    key = F.struct(G.v_gap("a_", "b_"), F.abs(F.col("a_reading_order") - F.col("b_reading_order")), F.col("b_element_id"))
    return met.groupBy(DOC, F.col("a_element_id").alias("caption_id")).agg(F.min_by("b_element_id", key).alias("target_id")).withColumn("confidence", F.lit(0.96))
