"""Normalisation of elements by an ordered chain of named rules, the first that holds decides; with a trace of each decision, and the structure passes on top.

A rule is a name, a condition over the columns of one element in its context, the type that the element becomes (null: stays) and a confidence. decide() adds the
context (the element after it, its target, the visual above it, the document's profile) by windows and joins, and evaluates all rules as one
expression; so adding a rule adds a branch and no pass over the data.

Defined results: null texts are empty; an element without a target, profile or box fails the conditions that need them; elements are told apart by document
and id, and of repeated targets of one element the smallest id counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions.text import by_ascii
from docloom.lineage import cut_lineage
from docloom.operators.elements import parent_headings
from docloom.operators.normalize import code_score
from docloom.operators.relations import DOC
from docloom.operators.sections import eligibility
from docloom.operators.structure import repeated_lines

# Fixed patterns and corrections: what they match, and the names of rules, are part of the results.
EXPLICIT_ALGORITHM = r"(?i)^\s*algorithm\s+\d+\b"
STRUCTURAL_SECTION = r"(?i)\b(?:section|appendix)\s+[A-Z0-9]+(?:\.[0-9]+)*\s*:\s*[^|]{0,180}"
CAPTION_LABEL = r"(?i)(?:^|[\s)])(?:Figure|Fig\.?|Table|Listing|Algorithm|图|表)\s*\d+(?:\s*(?:\([a-z](?:\s*[-–—]\s*[a-z])?\)|[a-z](?:\s*[-–—]\s*[a-z])?))?\s*[:.\-–—]"
FOOTNOTE_PREFIX = r"(?i)^\s*(?:<sup>\s*)?(?:\d+|[*†‡])(?:\s*</sup>)?(?:\s|[).:\-])|^\s*(?:note|notes|source|sources)\s*[:：]"
PROCEDURE_OR_CONTACT = r"(?i)^\s*(?:step\s+\d+|it takes\b|to (?:use|install|connect|set)|\d+\s+(?:on|click|choose|press|select|open|insert|connect)\b|(?:tel|phone|email|contact)\b|www\.|https?://)"
VISUAL_ATTRIBUTION = r"(?i)\b(?:picture|photo|chart)\s+by\b|source\s*:|\bfrom\s+(?:https?://|www\.)|\bcopyright\b"
OFFICIAL_OR_ADDRESS = r"(?i)\b(?:governor|secretary|director|president|chief officer|street|avenue|road|telephone|fax)\b"
UI_TEXT = r"(?i)\b(?:control panel|system preferences|enable|checkbox|ask me before|sharing|click|button)\b"
VISUAL_NOTE = r"(?i)^\s*(?:source\s*:|notes?\s*:|\d*\s*(?:EB|PB|TB|GB|MB|KB)\s*=)"
PROMPT_TEMPLATE = r"(?i)(?:^|\n)\s*#\s*(?:answer|question|verify|predict)\b|<input_[a-z_]+>"
CREDIT = r"(?i)\b(?:picture|photo|chart)\s+by\b|\bsource\s*:|\bfrom\s+\S+|©"
DIAGRAM = r"(?i)\b(?:feature|axis|input|output|layer|node)\w*\b"
OCR = (
    ("currency_leading_one", r"(?<=\$)[Il](?=\d)", "1"),
    ("decimal_unit_one", r"(?<=\d\.)[Il](?=[KMBT]\b)", "1"),
    ("two_digit_year", r"(?<![A-Za-z])(['’‘])[Il]{2}\b", "$111"),
    ("mixed_digit_year", r"(?<![A-Za-z])(['’‘])[Il](\d)\b", "$11$2"),
    ("missing_year_apostrophe", r"\bin(?=\d{2}\b)", "in '"),
    ("numbered_hash_label", r"(?<=#)[Il]\b", "1"),
    ("data_unit_one", r"\b[Il](?=(?:EB|PB|TB|GB|MB|KB|B)\b)", "1"),
    ("billion_count_one", r"\b[Il](?=\s+Billion\b)", "1"),
)

OWN = (DOC, "element_id", "page_index", "reading_order", "element_type", "text", "x1", "y1", "x2", "y2")
VISUAL = ("figure", "chart", "table")
KEPT = "preserve_parser_type"


def uncorrected(text: Column) -> Column:
    return F.struct(text.alias("text"), F.array().cast("array<struct<rule:string,before:string,after:string>>").alias("corrections"))


def corrected(text: Column) -> Column:
    """Struct(text, corrections array<struct<rule, before, after>>): misread figures of slides put right, rule by rule, in order."""
    steps = [text]
    for _, pattern, replacement in OCR:
        steps.append(F.regexp_replace(steps[-1], pattern, replacement))
    made = F.array(*(F.when(before != after, F.struct(F.lit(rule).alias("rule"), before.alias("before"), after.alias("after"))) for (rule, _, _), before, after in zip(OCR, steps, steps[1:], strict=False)))
    # each step holds all steps before it: texts that no pattern meets, as no step changes them, are left alone
    met = F.rlike(text, F.lit("|".join(f"(?:{pattern})" for _, pattern, _ in OCR)))
    return F.when(met, F.struct(steps[-1].alias("text"), F.array_compact(made).alias("corrections"))).otherwise(uncorrected(text))


def has(pattern: str) -> Column:
    return F.rlike("plain", F.lit(by_ascii(pattern)))


@dataclass(frozen=True)
class Rule:
    """becomes: the new type, or None to keep it."""

    name: str
    when: Callable[[], Column]
    becomes: str | None
    confidence: float | Callable[[], Column]


def _of(kind: str) -> Column:
    return F.col("element_type") == kind


_SLIDES = lambda: F.col("profile") == "slides"
_CODE = lambda: F.col("element_type").isin("code", "algorithm")
_ON_VISUAL = lambda: F.col("t_element_type").isin(*VISUAL)
_UNLABELLED = lambda: _of("caption") & _ON_VISUAL() & ~has(CAPTION_LABEL)
_ABOVE = lambda: F.col("y2") <= F.col("t_y1") + 0.01

RULES = (
    Rule("embedded_section_label_promoted", lambda: (_of("caption") & has(STRUCTURAL_SECTION)) | (_of("paragraph") & (F.regexp_instr("plain", F.lit(by_ascii(STRUCTURAL_SECTION))).between(1, 21))), "heading", 0.99),
    Rule("slide_visual_note_to_footnote", lambda: _SLIDES() & _of("paragraph") & has(VISUAL_NOTE) & F.col("above_id").isNotNull(), "footnote", 0.97),
    Rule("explicit_numbered_algorithm", lambda: _CODE() & has(EXPLICIT_ALGORITHM), "algorithm", 0.99),
    Rule("ui_screenshot_not_algorithm", lambda: _of("algorithm") & has(UI_TEXT) & (F.col("signs") == 0), "figure", 0.95),
    Rule("prompt_template_normalized_to_code", lambda: _CODE() & F.rlike("text", F.lit(by_ascii(PROMPT_TEMPLATE))), "code", 0.96),
    Rule("runnable_or_prompt_code_normalized", lambda: _CODE() & (F.col("signs") >= 2), "code", lambda: F.least(F.lit(0.98), 0.78 + F.col("signs") * 0.04)),
    Rule("short_output_not_algorithm", lambda: _of("algorithm") & (F.col("words") <= 8) & (F.col("signs") == 0), "paragraph", 0.90),
    Rule("preserve_code_like_type", _CODE, None, 0.70),
    Rule("visual_attribution_preserved", lambda: _of("footnote") & has(VISUAL_ATTRIBUTION), None, 0.97),
    Rule("procedure_contact_or_official_text_not_footnote", lambda: _of("footnote") & (has(PROCEDURE_OR_CONTACT) | has(OFFICIAL_OR_ADDRESS)), "paragraph", 0.94),
    Rule("slide_local_text_not_footnote", lambda: _of("footnote") & _SLIDES() & ~has(FOOTNOTE_PREFIX) & (F.col("words") <= 12), "paragraph", 0.92),
    Rule("explicit_footnote_or_source_prefix", lambda: _of("footnote") & has(FOOTNOTE_PREFIX), None, 0.98),
    Rule("table_introduction_before_following_table", lambda: _of("footnote") & (F.col("next_type") == "table") & (F.col("next_order") - F.col("reading_order") <= 2), "paragraph", 0.95),
    Rule("unbound_page_footnote_preserved", lambda: _of("footnote") & F.col("t_element_type").isNull(), None, 0.70),
    Rule("visual_internal_text_not_footnote", lambda: _of("footnote") & _ON_VISUAL() & (F.col("inside") >= 0.30), "paragraph", 0.96),
    Rule("table_introduction_without_note_marker", lambda: _of("footnote") & (F.col("t_element_type") == "table") & _ABOVE(), "paragraph", 0.92),
    Rule("markerless_table_note_preserved_for_validation", lambda: _of("footnote") & (F.col("t_element_type") == "table"), None, 0.68),
    Rule("nearby_visual_description_to_caption", lambda: _of("footnote") & _ON_VISUAL() & (F.col("gap") <= 0.10) & F.col("words").between(2, 100), "caption", 0.86),
    Rule("ambiguous_footnote_preserved", lambda: _of("footnote"), None, 0.55),
    Rule("visual_attribution_to_footnote", lambda: _of("caption") & _ON_VISUAL() & has(VISUAL_ATTRIBUTION), "footnote", 0.97),
    Rule("external_visual_title_preserved", lambda: _of("caption") & _ON_VISUAL() & (F.col("words") > 0) & _ABOVE() & (F.col("gap") <= 0.08) & (F.col("across") >= 0.50) & (F.col("words") <= 24), None, 0.97),
    Rule("slide_local_text_not_caption", lambda: _SLIDES() & _UNLABELLED() & ~has(CREDIT) & ((F.col("inside") >= 0.05) | (F.col("words") <= 12) | has(PROCEDURE_OR_CONTACT)), "paragraph", 0.94),
    Rule("visual_internal_label_not_caption", lambda: _UNLABELLED() & (F.col("inside") >= 0.45), "paragraph", 0.95),
    Rule("slide_diagram_label_not_caption", lambda: _SLIDES() & _UNLABELLED() & (F.col("words") <= 8) & ((F.col("inside") >= 0.15) | has(DIAGRAM)), "paragraph", 0.93),
    Rule("empty_list_excluded_from_semantic_relations", lambda: _of("list") & (F.col("words") == 0), None, 1.0),
    Rule("high_confidence_slide_ocr_correction", lambda: F.size("corrections") > 0, None, 0.99),
)


def in_context(elements: DataFrame, targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """elements(document_id, element_id, page_index, reading_order, element_type, text, x1, y1, x2, y2), targets(document_id, element_id, target_id), profiles(document_id, profile) -> with what the rules look at."""
    key = [DOC, "element_id"]
    elements = elements.select(*OWN)
    rows = elements.join(profiles.groupBy(DOC).agg(F.min("profile").alias("profile")), DOC, "left").withColumn("text", F.coalesce("text", F.lit("")))
    fixed = F.when(F.coalesce(_SLIDES(), F.lit(False)), corrected(F.col("text"))).otherwise(uncorrected(F.col("text")))
    rows = rows.withColumn("fixed", fixed).withColumns({"text": F.col("fixed.text"), "corrections": F.col("fixed.corrections")}).drop("fixed")
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"<[^>]+>", " "), by_ascii(r"\s+"), " "))
    along = Window.partitionBy(DOC, "page_index").orderBy("reading_order", "element_id")
    rows = rows.withColumns({"plain": plain, "next_type": F.lead("element_type").over(along), "next_order": F.lead("reading_order").over(along)})
    rows = rows.withColumns({"words": F.when(F.col("plain") == "", 0).otherwise(F.size(F.split("plain", " "))), "signs": code_score(F.col("text"), F.lit(None).cast("string"))})
    # the nearest visual above a note, on its page
    notes = rows.where(_SLIDES() & _of("paragraph") & has(VISUAL_NOTE)).select(*key, "page_index", *(F.col(c).alias(f"n_{c}") for c in ("x1", "y1", "x2", "y2")))
    seen = elements.where(F.col("element_type").isin(*VISUAL)).select(DOC, "page_index", F.col("element_id").alias("above_id"), *(F.col(c).alias(f"v_{c}") for c in ("x1", "y1", "x2", "y2")))
    met = notes.join(seen, [DOC, "page_index"]).where((F.col("v_y2") <= F.col("n_y1") + 0.02) & (G.v_gap("v_", "n_") <= 0.12))
    nearest = met.groupBy(*key).agg(F.min_by("above_id", F.struct(G.v_gap("v_", "n_"), -G.h_overlap("v_", "n_"), F.col("above_id"))).alias("above_id"))
    # the one target of each element, and where it lies
    bound = targets.groupBy(*key).agg(F.min("target_id").alias("target_id"))
    box = elements.select(DOC, F.col("element_id").alias("target_id"), *(F.col(c).alias(f"t_{c}") for c in ("element_type", "x1", "y1", "x2", "y2")))
    rows = rows.join(bound.join(box, [DOC, "target_id"]), key, "left")
    shared = F.greatest(F.lit(0.0), F.least("x2", "t_x2") - F.greatest("x1", "t_x1")) * F.greatest(F.lit(0.0), F.least("y2", "t_y2") - F.greatest("y1", "t_y1"))
    rows = rows.withColumns({"inside": shared / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), "gap": G.v_gap("", "t_"), "across": G.h_overlap("", "t_")})
    return rows.join(nearest, key, "left")


def decide(elements: DataFrame, targets: DataFrame, profiles: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The elements with rule, normalized_type, confidence and corrections: the first rule that holds, or that the type is kept."""
    rows = in_context(elements, targets, profiles)
    choice = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("type"), F.lit(0.0).alias("confidence")))
    for r in rules:
        becomes = F.lit(r.becomes) if r.becomes else F.col("element_type")
        sure = r.confidence() if callable(r.confidence) else F.lit(r.confidence)
        choice = choice.when(F.coalesce(r.when(), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), becomes.alias("type"), sure.alias("confidence")))
    rows = rows.withColumn("x", choice.otherwise(F.struct(F.lit(KEPT).alias("rule"), F.col("element_type").alias("type"), F.lit(1.0).alias("confidence"))))
    heading = F.trim(F.regexp_extract("plain", by_ascii(STRUCTURAL_SECTION), 0))
    text = F.when(F.col("x.rule") == RULES[0].name, heading).otherwise(F.col("text"))
    names = [c for c in OWN if c != "text"]
    return rows.select(*names, text.alias("text"), F.col("x.rule").alias("rule"), F.col("x.type").alias("normalized_type"), F.col("x.confidence").alias("confidence"), "corrections", F.coalesce("target_id", "above_id").alias("target_id"))


def firings(decisions: DataFrame) -> DataFrame:
    """decide() -> (rule_id, document_id, element_id, status) of the rules that changed or judged something, as audit.rule_coverage takes them."""
    status = F.when(F.col("confidence") >= 0.9, "confirmed").otherwise("candidate")
    return decisions.where(F.col("rule") != KEPT).select(F.col("rule").alias("rule_id"), DOC, "element_id", status.alias("status"))


def structure(elements: DataFrame, targets: DataFrame, profiles: DataFrame, parsed: bool = True) -> dict[str, DataFrame]:
    """The passes in order: normalisation, repetition, eligibility of headings, hierarchy, sections. Without `parsed` (a parser that has settled types) normalisation is left out.

    decisions; furniture(doc, text); headings(doc, page, pos, text, reason, eligible); tree(doc, pos, level, parent_pos); sections(document_id, element_id, section_pos): the eligible heading at or before each element.
    """
    # four passes read the decisions: they are made once
    decisions = cut_lineage(decide(elements, targets, profiles)) if parsed else elements.select(*OWN).withColumns({"rule": F.lit(KEPT), "normalized_type": F.col("element_type"), "confidence": F.lit(1.0)})
    pos = F.col("page_index") * 100_000 + F.col("reading_order")
    rows = decisions.withColumn("pos", pos).withColumn("text", F.coalesce("text", F.lit("")))
    lines = rows.where("normalized_type in ('heading', 'paragraph') and text <> ''").select(F.col(DOC).alias("doc"), F.col("page_index").alias("page"), F.trim(F.regexp_replace(F.lower("text"), r"[0-9]+", "#")).alias("key"))
    furniture = repeated_lines(lines, ["key"]).select("doc", "key").distinct()
    after = F.lag("normalized_type").over(Window.partitionBy(DOC, "page_index").orderBy("reading_order", "element_id")) == "table"
    heads = rows.withColumn("after_table", F.coalesce(after, F.lit(False))).where("normalized_type = 'heading'").select(F.col(DOC).alias("doc"), F.col("page_index").alias("page"), "pos", "text", "after_table", F.trim(F.regexp_replace(F.lower("text"), r"[0-9]+", "#")).alias("key"))
    heads = heads.join(furniture.withColumn("is_furniture", F.lit(True)), ["doc", "key"], "left").withColumn("is_furniture", F.coalesce("is_furniture", F.lit(False))).drop("key")
    headings = eligibility(heads)
    depth = F.size(F.split(F.regexp_extract("text", r"^\s*([0-9]+(?:\.[0-9]+)*)", 1), r"\."))
    level = F.when(F.col("text").rlike(r"^\s*[0-9]"), F.least(depth, F.lit(6))).otherwise(1)
    tree = parent_headings(headings.where("eligible").select("doc", "pos", level.cast("long").alias("level"), "text"))
    own = tree.select(F.col("doc").alias(DOC), "pos", F.col("pos").alias("section_pos"))
    upto = Window.partitionBy(DOC).orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    sections = rows.select(DOC, "element_id", "pos").join(own, [DOC, "pos"], "left").select(DOC, "element_id", F.last("section_pos", ignorenulls=True).over(upto).alias("section_pos"))
    return {"decisions": decisions, "furniture": furniture, "headings": headings, "tree": tree, "sections": sections}
