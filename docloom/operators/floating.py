"""Sections of floating elements (figures, tables, listings and what belongs to them), step by step; each with the step that decided.

The steps in order, each for what no earlier one has decided:

    reference      the section of the strongest explicit reference; equally strong ones of two sections are ambiguous
    listing_chain  code that candidate continuations tie to an anchored listing
    continuation   confirmed continuations hand on what has been decided
    title          captions that begin with one section's title
    caption_group  members of a caption with several targets, where any of them is decided
    function       captions and notes take their target's section
    base           what a parser said

A step sees what the steps before it have decided, not what it decides itself. Elements are told apart by document and id. If a step gives an element two sections, it
gives it none. Every step is a join or a fixed point over the step's own edges; decisions are a small table that grows.

Defined results: null sections decide nothing; elements that no table knows are left out; repeated rows count once; an empty table of elements gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.lineage import cut_lineage
from docloom.operators.inventory import listing_chains
from docloom.operators.relations import DOC
from docloom.operators.sections import group_sections, inherit, inherit_along, resolve_by_references, title_anchors

FLOATING = ("figure", "chart", "table", "code", "algorithm", "caption", "footnote", "equation")
_KEY = [DOC, "element_id"]


def resolve(elements: DataFrame, references: DataFrame, listings: DataFrame, relations: DataFrame, titles: DataFrame, groups: DataFrame, least: float = 0.8) -> DataFrame:
    """elements(document_id, element_id, element_type, text, section_id), references as resolve_by_references() takes them, listings(document_id, source_id, target_id, confidence), relations(document_id, source_id, target_id, kind, confidence),
    titles(document_id, section_id, title), groups(document_id, caption_id, member_id) -> (document_id, element_id, base_section_id, section_id, step, ambiguous).
    """
    own = elements.where(F.col("element_type").isin(*FLOATING)).select(*_KEY, F.col("section_id").alias("base_section_id")).dropDuplicates(_KEY)
    voted = cut_lineage(resolve_by_references(references))
    decided = None

    def take(found: DataFrame, step: str) -> None:
        nonlocal decided
        one = found.where("section_id is not null").select(*_KEY, "section_id").groupBy(*_KEY).agg(F.min("section_id").alias("section_id"), F.max("section_id").alias("_other")).where("section_id = _other")
        fresh = one.select(*_KEY, "section_id", F.lit(step).alias("step")).join(own.select(*_KEY), _KEY, "left_semi")
        if decided is not None:
            fresh = decided.unionByName(fresh.join(decided, _KEY, "left_anti"))
        decided = cut_lineage(fresh)

    take(voted.where("status = 'resolved'").withColumnRenamed("target_id", "element_id"), "reference")
    code = elements.where("element_type in ('code', 'algorithm')").select(*_KEY)
    take(listing_chains(listings, decided.join(code, _KEY, "left_semi").select(*_KEY, "section_id")).join(code, _KEY, "left_semi"), "listing_chain")
    edges = relations.where((F.col("kind") == "continues") & (F.col("confidence") >= least)).select(DOC, F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    take(inherit_along(edges, decided.select(*_KEY, "section_id")), "continuation")
    captions = elements.where("element_type = 'caption' and text is not null").select(F.col(DOC).alias("doc"), "element_id", "text")
    take(title_anchors(captions, titles.withColumnRenamed(DOC, "doc")).withColumnRenamed("doc", DOC), "title")
    take(group_sections(groups, decided.select(*_KEY, "section_id")).withColumnRenamed("member_id", "element_id"), "caption_group")
    take(inherit(relations, decided.select(DOC, F.col("element_id").alias("target_id"), "section_id")), "function")
    unsure = voted.where("status = 'ambiguous'").select(DOC, F.col("target_id").alias("element_id"), F.lit(True).alias("ambiguous"))
    out = own.join(decided, _KEY, "left").join(unsure, _KEY, "left")
    return out.select(*_KEY, "base_section_id", F.coalesce("section_id", "base_section_id").alias("section_id"), F.coalesce("step", F.lit("base")).alias("step"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
