"""Labels of figures, tables and sections: the registry of a document's targets, exact lookups and places by order.

elements have document_id, element_id, page_index, reading_order, element_type, text, a box and section_id. Null texts have no label; equal
targets are told apart by their ids; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators.normalize import leading_label
from docloom.operators.relations import DOC, same_page_pairs

#: Priorities of the sources: a caption's target, a caption-like paragraph's visual, the caption itself, a numbered heading.
CAPTIONED, NEAREST, ITSELF, NUMBERED = 100, 90, 70, 100
NAMES = f"{DOC} string, kind string, number string, target_id string, priority int"


def caption_like(elements: DataFrame) -> DataFrame:
    """Paragraphs that begin with a label: (document_id, element_id, kind, number)."""
    return elements.where("element_type = 'paragraph'").withColumn("_l", leading_label(F.col("text"))).where("_l is not null").select(DOC, "element_id", "_l.kind", "_l.number")


def nearest_visuals(elements: DataFrame) -> DataFrame:
    """The visual of a caption-like paragraph's kind next to it: at most 3 places in reading order and .08 of the page apart, a quarter of the width shared; the nearest by gap, place and id."""
    said = caption_like(elements).select(F.col(DOC).alias("a_document_id"), F.col("element_id").alias("a_element_id"), "kind", "number")
    pairs = same_page_pairs(elements).where("b_element_type in ('figure', 'chart', 'table')").join(said, ["a_document_id", "a_element_id"])
    fit = (F.col("kind") == "table") == (F.col("b_element_type") == "table")
    far = F.abs(F.col("a_reading_order") - F.col("b_reading_order"))
    met = pairs.where(fit & (far <= 3) & (G.v_gap("a_", "b_") <= 0.08) & (G.h_overlap("a_", "b_") >= 0.25))
    return met.groupBy(F.col("a_document_id").alias(DOC), F.col("a_element_id").alias("element_id"), "kind", "number").agg(F.min_by("b_element_id", F.struct(G.v_gap("a_", "b_"), far, F.col("b_element_id"))).alias("target_id"))


def registry(elements: DataFrame, captions: DataFrame) -> DataFrame:
    """(document_id, kind, number, target_id, priority) of four sources; captions(document_id, caption_id, target_id) are confirmed bindings. Each target of a label once, by its best priority."""
    said = elements.where("element_type = 'caption'").withColumn("_l", leading_label(F.col("text"))).where("_l is not null").select(DOC, F.col("element_id").alias("caption_id"), "_l.kind", "_l.number")
    number = F.regexp_extract("text", r"^\s*([0-9]+(?:\.[0-9]+)*)\.?\s", 1)
    parts = [
        said.join(captions, [DOC, "caption_id"]).select(DOC, "kind", "number", "target_id", F.lit(CAPTIONED).alias("priority")),
        nearest_visuals(elements).select(DOC, "kind", "number", "target_id", F.lit(NEAREST).alias("priority")),
        said.select(DOC, "kind", "number", F.col("caption_id").alias("target_id"), F.lit(ITSELF).alias("priority")),
        elements.where("element_type = 'heading'").where(number != "").select(DOC, F.lit("section").alias("kind"), number.alias("number"), F.col("element_id").alias("target_id"), F.lit(NUMBERED).alias("priority")),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union.groupBy(DOC, "kind", "number", "target_id").agg(F.max("priority").alias("priority"))


def lookup(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """mentions(document_id, question_id, kind, number) -> how many targets of the best priority each has, the first of them and a status; a sub-label that is not known falls back to its number.

    resolved: one target; ambiguous: several; unresolved: none.
    """
    best = labels.withColumn("_top", F.max("priority").over(Window.partitionBy(DOC, "kind", "number"))).where("priority = _top").groupBy(DOC, "kind", "number").agg(F.count("*").alias("targets"), F.min("target_id").alias("target_id"))
    base = best.select(DOC, "kind", F.col("number").alias("_base"), F.col("targets").alias("_targets"), F.col("target_id").alias("_target"))
    met = mentions.withColumn("_base", F.regexp_replace("number", "[a-z]$", "")).join(best, [DOC, "kind", "number"], "left").join(base, [DOC, "kind", "_base"], "left")
    found, target = F.coalesce("targets", "_targets", F.lit(0)), F.coalesce("target_id", "_target")
    return met.select(DOC, "question_id", "kind", "number", found.alias("targets"), target.alias("target_id"), F.when(found == 0, "unresolved").when(found == 1, "resolved").otherwise("ambiguous").alias("status"))


def positional(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(document_id, question_id, kind, position) -> the element of a kind at a place in the document: 1 is the first, -1 the last, -2 the one before it."""
    kind = F.when(F.col("element_type").isin("figure", "chart"), "figure").when(F.col("element_type") == "table", "table").when(F.col("element_type") == "heading", "section")
    order = [F.col("page_index"), F.col("reading_order"), F.col("element_id")]
    rows = elements.withColumn("kind", kind).where("kind is not null")
    ahead, back = F.row_number().over(Window.partitionBy(DOC, "kind").orderBy(*order)), F.row_number().over(Window.partitionBy(DOC, "kind").orderBy(*(c.desc() for c in order)))
    placed = rows.select(DOC, "kind", F.col("element_id").alias("target_id"), ahead.alias("ahead"), back.alias("back")).select(DOC, "kind", "target_id", F.explode(F.array("ahead", -F.col("back"))).alias("position"))
    return asked.join(placed, [DOC, "kind", "position"], "left").select(DOC, "question_id", "kind", "position", "target_id")


def section_candidates(asked: DataFrame, sections: DataFrame, margin: float = 0.02, least: float = 0.5) -> DataFrame:
    """asked(document_id, question_id, title), sections(document_id, section_id, title): the best section by shared words, ambiguous where another comes within the margin.

    A title equals another by its words without case and plural; the score is twice the shared words over all of both.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(named_title(c), " "), lambda w: w != ""))
    a, b = asked.select(DOC, "question_id", words(F.col("title")).alias("_a")), sections.select(DOC, "section_id", words(F.col("title")).alias("_b"))
    score = 2 * F.size(F.array_intersect("_a", "_b")) / (F.size("_a") + F.size("_b"))
    # candidates share a word
    key = lambda d, k: d.select("*", F.explode(k).alias("_w"))
    met = key(a, "_a").join(key(b, "_b"), [DOC, "_w"]).drop("_w").dropDuplicates([DOC, "question_id", "section_id"]).withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    w = Window.partitionBy(DOC, "question_id").orderBy(F.desc("score"), "section_id")
    ranked = met.withColumns({"_rn": F.row_number().over(w), "_next": F.lead("score").over(w)}).where("_rn = 1")
    return ranked.select(DOC, "question_id", "section_id", "score", F.coalesce(F.col("score") - F.col("_next") <= margin, F.lit(False)).alias("ambiguous"))


def named_title(c):
    """Words of a section's name: lower case, letters and digits, the last one singular, programme as program."""
    c = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(c, r"\bprogramme", "program"), r"([a-z]{3,})s$", "$1")


def exact_matches(matches: DataFrame) -> DataFrame:
    """matches(query_id, place, target_id, ...): the first match of each target of a query."""
    return matches.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "target_id").orderBy("place"))).where("_rn = 1").drop("_rn")
