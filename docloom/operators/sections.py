"""Sections of floating elements: reference votes, inheritance, chains, title anchors, eligibility of headings."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.lineage import cut_lineage

BEFORE_PAGES, AFTER_PAGES = 2, 1


def reference_strength(confidence: Column, pages: Column, side: Column) -> Column:
    """A reference before its target loses .05 a page, up to two pages; one after it .10 and .05 a page, up to one."""
    before = F.when(pages <= BEFORE_PAGES, confidence - 0.05 * pages)
    return F.when(side == "before", before).otherwise(F.when(pages <= AFTER_PAGES, confidence - 0.10 - 0.05 * pages))


def _document(*tables: DataFrame) -> list[str]:
    """The document's key, where all tables have one: ids are told apart by document then."""
    return ["document_id"] if all("document_id" in t.columns for t in tables) else []


def resolve_by_references(references: DataFrame) -> DataFrame:
    """references(document_id, target_id, section_id, confidence, pages, side): the section of the strongest vote, or ambiguous on a tie."""
    target = [*_document(references), "target_id"]
    votes = references.withColumn("strength", F.round(reference_strength(F.col("confidence"), F.col("pages"), F.col("side")), 6)).where("strength is not null")
    best = votes.groupBy(*target, "section_id").agg(F.max("strength").alias("strength"))
    top = best.withColumn("top", F.max("strength").over(Window.partitionBy(*target))).where("strength = top")
    return top.groupBy(*target).agg(F.when(F.count("*") == 1, F.min("section_id")).alias("section_id"), F.min("strength").alias("strength"), F.when(F.count("*") == 1, "resolved").otherwise("ambiguous").alias("status"))


def inherit(relations: DataFrame, resolved: DataFrame, kinds: tuple[str, ...] = ("caption_of", "footnote_of")) -> DataFrame:
    """Captions and footnotes get the section of their target."""
    doc = _document(relations, resolved)
    return relations.where(F.col("kind").isin(*kinds)).join(resolved.select(*doc, "target_id", "section_id"), [*doc, "target_id"]).select(*doc, F.col("source_id").alias("element_id"), "section_id")


def inherit_along(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges(document_id, a, b) undirected, known(document_id, element_id, section_id): what a chain of confirmed continuations hands on.

    Each round reaches one edge further, until a round reaches nothing new; an element that two sections reach at once gets none.
    """
    doc = _document(edges, known)
    both = cut_lineage(edges.select(*doc, "a", "b").union(edges.select(*doc, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = known.select(*doc, "element_id", "section_id", F.lit(0).alias("round"))
    for i in count(1):
        reached = both.join(now.select(*doc, F.col("element_id").alias("a"), "section_id"), [*doc, "a"]).select(*doc, F.col("b").alias("element_id"), "section_id").join(now, [*doc, "element_id"], "left_anti")
        fresh = cut_lineage(reached.groupBy(*doc, "element_id").agg(F.min("section_id").alias("section_id"), F.max("section_id").alias("other")).where("section_id = other").select(*doc, "element_id", "section_id", F.lit(i).alias("round")))
        if fresh.isEmpty():
            return now
        now = cut_lineage(now.unionByName(fresh))


def title_anchors(captions: DataFrame, sections: DataFrame, least: int = 6) -> DataFrame:
    """captions(doc, element_id, text), sections(doc, section_id, title): captions that start with one title, the longest."""
    met = captions.join(sections.where(F.length("title") >= least), "doc").where(F.startswith(F.lower("text"), F.lower("title")))
    ranked = met.withColumn("longest", F.max(F.length("title")).over(Window.partitionBy("doc", "element_id"))).where(F.length("title") == F.col("longest"))
    return ranked.groupBy("doc", "element_id").agg(F.count("*").alias("n"), F.min("section_id").alias("section_id")).where("n = 1").drop("n")


def eligibility(headings: DataFrame) -> DataFrame:
    """headings(doc, page, pos, text, is_furniture, after_table) -> with the first reason against each, or null; repeats are counted in the document."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    words = F.size(F.filter(F.split(clean, " "), lambda w: w != ""))
    pages = F.size(F.collect_set("page").over(Window.partitionBy("doc", F.lower(clean))))
    known = F.lower(clean).isin("abstract", "introduction", "background", "conclusion", "conclusions", "references", "results", "discussion", "methods", "appendix")
    reason = (
        F.when(F.col("is_furniture"), "running_header_footer").when(clean == "", "empty").when(clean.rlike(r"(?i)https?://|www\.|@[a-z0-9-]+\.|^\+?[0-9()\s.-]{7,}$"), "contact_or_url")
        .when(clean.rlike(r"^[$€£]?[0-9][0-9.,]*\s*(?:%|million|billion|k)?$"), "local_statistic").when(clean.rlike(r"(?i)^step\s+[0-9]+\b"), "procedure_step").when(clean.rlike(r"(?i)^(?:signed|signature|sincerely|/s/)"), "signature")
        .when((words >= 4) & clean.rlike(r"[.!?]$"), "functional_sentence").when(F.col("after_table") & clean.rlike(r"(?i)^notes?:?$"), "table_notes").when((words <= 4) & (pages >= 3) & ~known & ~clean.rlike(r"^[0-9]"), "repeated_local_label")
    )
    return headings.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def group_sections(groups: DataFrame, anchored: DataFrame) -> DataFrame:
    """groups(document_id, caption_id, member_id), anchored(document_id, element_id, section_id): members of a caption with several targets get the one section that any of them has; two sections give none."""
    doc = "document_id"
    many = groups.groupBy(doc, "caption_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = groups.join(many, [doc, "caption_id"]).join(anchored.select(doc, F.col("element_id").alias("member_id"), "section_id"), [doc, "member_id"], "left")
    one = own.groupBy(doc, "caption_id").agg(F.min("section_id").alias("section_id"), F.max("section_id").alias("_other")).where("section_id = _other").drop("_other")
    return groups.join(one, [doc, "caption_id"]).select(doc, "caption_id", "member_id", "section_id")
