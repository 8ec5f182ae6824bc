"""The normalisation rules one by one, corrections against plain substitution, and the structure passes."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import rules as N
from docloom.plans import derived

ELEMENTS = "document_id string, element_id string, page_index long, reading_order long, element_type string, text string, x1 double, y1 double, x2 double, y2 double, rule string, profile string"
TARGETS, PROFILES = "document_id string, element_id string, target_id string", "document_id string, profile string"
TOP, MIDDLE, LOW, OVER = (0.1, 0.05, 0.9, 0.10), (0.1, 0.2, 0.9, 0.5), (0.1, 0.52, 0.9, 0.58), (0.1, 0.3, 0.9, 0.4)

#: rule -> (profile, type, text, box, type of the target in the middle or None, what follows, new type)
CASES = {
    "embedded_section_label_promoted": ("report", "paragraph", "and so Section 4.2: The rest | more", LOW, None, None, "heading"),
    "slide_visual_note_to_footnote": ("slides", "paragraph", "Source: somebody", LOW, "beside", None, "footnote"),
    "explicit_numbered_algorithm": ("report", "code", "Algorithm 3 Sort", LOW, None, None, "algorithm"),
    "ui_screenshot_not_algorithm": ("report", "algorithm", "Open the control panel there", LOW, None, None, "figure"),
    "prompt_template_normalized_to_code": ("report", "algorithm", "# Question here\nso and so on it goes for long now", LOW, None, None, "code"),
    "runnable_or_prompt_code_normalized": ("report", "algorithm", "def f(x):\n    return x;", LOW, None, None, "code"),
    "short_output_not_algorithm": ("report", "algorithm", "forty two", LOW, None, None, "paragraph"),
    "preserve_code_like_type": ("report", "code", "forty two", LOW, None, None, "code"),
    "visual_attribution_preserved": ("report", "footnote", "Photo by A", LOW, None, None, "footnote"),
    "procedure_contact_or_official_text_not_footnote": ("report", "footnote", "Step 2 of it", LOW, None, None, "paragraph"),
    "slide_local_text_not_footnote": ("slides", "footnote", "a few words", LOW, None, None, "paragraph"),
    "explicit_footnote_or_source_prefix": ("report", "footnote", "* without tax", LOW, None, None, "footnote"),
    "table_introduction_before_following_table": ("report", "footnote", "as the table says", LOW, None, "table", "paragraph"),
    "unbound_page_footnote_preserved": ("report", "footnote", "some words", LOW, None, None, "footnote"),
    "visual_internal_text_not_footnote": ("report", "footnote", "some words", OVER, "figure", None, "paragraph"),
    "table_introduction_without_note_marker": ("report", "footnote", "some words", TOP, "table", None, "paragraph"),
    "markerless_table_note_preserved_for_validation": ("report", "footnote", "some words", LOW, "table", None, "footnote"),
    "nearby_visual_description_to_caption": ("report", "footnote", "some words", LOW, "figure", None, "caption"),
    "ambiguous_footnote_preserved": ("report", "footnote", "some words", LOW, "paragraph", None, "footnote"),
    "visual_attribution_to_footnote": ("report", "caption", "chart by A", LOW, "chart", None, "footnote"),
    "external_visual_title_preserved": ("slides", "caption", "Costs", (0.1, 0.14, 0.9, 0.18), "chart", None, "caption"),
    "slide_local_text_not_caption": ("slides", "caption", "a few words", LOW, "figure", None, "paragraph"),
    "visual_internal_label_not_caption": ("report", "caption", "a label", OVER, "figure", None, "paragraph"),
    # a credit keeps the rule before it from holding
    "slide_diagram_label_not_caption": ("slides", "caption", "© input layer", LOW, "figure", None, "paragraph"),
    "empty_list_excluded_from_semantic_relations": ("report", "list", " <br> ", LOW, None, None, "list"),
    "high_confidence_slide_ocr_correction": ("slides", "paragraph", "It cost $l2 in all", LOW, None, None, "paragraph"),
    N.KEPT: ("report", "paragraph", None, LOW, None, None, "paragraph"),
}


def test_every_rule_has_a_case():
    assert set(CASES) == {r.name for r in N.RULES} | {N.KEPT}


def test_rules_one_by_one(spark):
    """Every case is a document of its own; the ids clash between documents."""
    rows, targets, profiles = [], [], []
    for name, (profile, kind, text, box, target, after, _) in CASES.items():
        rows.append((name, "e", 0, 5, kind, text, *box, "x", "y"))
        profiles.append((name, profile))
        if target:
            rows.append((name, "t", 0, 1, "figure" if target == "beside" else target, "T", *MIDDLE, "x", "y"))
            targets += [(name, "e", "t"), (name, "e", "t")] if target != "beside" else []
        if after:
            rows.append((name, "n", 0, 6, after, "N", 0.1, 0.6, 0.9, 0.9, "x", "y"))
    out = N.decide(*(spark.createDataFrame(r, s) for r, s in ((rows, ELEMENTS), (targets, TARGETS), (profiles, PROFILES)))).where("element_id = 'e'").collect()
    assert {r.document_id: (r.rule, r.normalized_type) for r in out} == {name: (name, case[-1]) for name, case in CASES.items()}
    by = {r.document_id: r for r in out}
    assert by["embedded_section_label_promoted"].text == "Section 4.2: The rest" and by["high_confidence_slide_ocr_correction"].text == "It cost $12 in all"
    assert by["slide_visual_note_to_footnote"].target_id == "t" and by["runnable_or_prompt_code_normalized"].confidence == pytest.approx(0.78 + 0.04 * 2, abs=0.13)
    fired = N.firings(N.decide(*(spark.createDataFrame(r, s) for r, s in ((rows, ELEMENTS), (targets, TARGETS), (profiles, PROFILES)))))
    assert fired.where("element_id = 'e'").count() == len(CASES) - 1


def test_first_rule_wins_and_edges(spark):
    rows = [("d", "a", 0, 0, "caption", "Section 1: chart by A", *LOW), ("d", "b", 0, 1, "caption", "plain", *LOW), ("z", "b", 0, 0, "figure", None, *MIDDLE), (None, "q", 0, 0, "list", None, None, None, None, None)]
    elements = spark.createDataFrame([(*r, "x", "y") for r in rows], ELEMENTS)
    targets = spark.createDataFrame([("d", "b", "b"), ("d", "a", "zz")], TARGETS)  # b of the other document is no target here
    got = {(r.document_id, r.element_id): r.rule for r in N.decide(elements, targets, spark.createDataFrame([("d", "report")], PROFILES)).collect()}
    assert got == {("d", "a"): "embedded_section_label_promoted", ("d", "b"): N.KEPT, ("z", "b"): N.KEPT, (None, "q"): "empty_list_excluded_from_semantic_relations"}
    assert N.decide(elements.where("false"), targets, spark.createDataFrame([], PROFILES)).count() == 0


def test_corrections_match_substitution(spark):
    texts = ["$I5 and $l0, $Ix", "1.I5 1.IM 2.lK", "'II or ’ll, a'II", "'I9 and ‘l5", "in99 but in999 and win99", "#I #l2 #II", "I GB lTB IMB, IB", "I Billion, l  Billion", "", "none", "$I2 in98 #I"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(N.corrected(F.col("t")).alias("x")).collect()]
    for text, x in zip(texts, got, strict=True):
        want, trace = text, []
        for rule, pattern, replacement in N.OCR:
            plain = {"$111": r"\g<1>11", "$11$2": r"\g<1>1\g<2>"}.get(replacement, replacement)
            after = re.sub(pattern, plain, want)
            if after != want:
                trace.append((rule, want, after))
            want = after
        assert x.text == want and [tuple(c) for c in x.corrections] == trace


def test_structure_passes(spark):
    rows = [("d", f"f{p}", p, 0, "paragraph", f"Annual page {p}") for p in range(4)]
    rows += [("d", "h1", 0, 1, "heading", "1 Scope"), ("d", "p1", 0, 2, "paragraph", "Text of it."), ("d", "h2", 1, 1, "heading", "1.1 Terms"), ("d", "p2", 1, 2, "paragraph", "Other text."), ("d", "p3", 2, 1, "paragraph", "Section 2: Next"), ("d", "p4", 2, 2, "list", "a"), ("d", "w", 3, 1, "heading", "www.example.com"), ("z", "h1", 0, 0, "paragraph", "Alone here")]
    elements = spark.createDataFrame([(*r, 0.1, 0.1, 0.9, 0.2, "x", "y") for r in rows], ELEMENTS)
    out = N.structure(elements, spark.createDataFrame([], TARGETS), spark.createDataFrame([("d", "report")], PROFILES))
    assert {r.key for r in out["furniture"].collect()} == {"annual page #"}
    assert sorted((r.text, r.eligible) for r in out["headings"].collect()) == [("1 Scope", True), ("1.1 Terms", True), ("Section 2: Next", True), ("www.example.com", False)]
    assert sorted((r.text, r.parent_pos) for r in out["tree"].collect()) == [("1 Scope", None), ("1.1 Terms", 1), ("Section 2: Next", None)]
    where = {(r.document_id, r.element_id): r.section_pos for r in out["sections"].collect()}
    assert where["d", "f0"] is None and where["d", "p1"] == 1 and where["d", "p2"] == 100_001 and where["d", "p4"] == 200_001 and where["d", "w"] == 200_001 and where["z", "h1"] is None
    kept = N.structure(elements, spark.createDataFrame([], TARGETS), spark.createDataFrame([], PROFILES), parsed=False)
    assert kept["headings"].count() == 3 and {r.rule for r in kept["decisions"].collect()} == {N.KEPT}


def test_decisions_are_made_once_for_all_passes(spark, monkeypatch):
    written = []
    monkeypatch.setattr(N, "cut_lineage", lambda rows, cut=N.cut_lineage: written.append(rows) or cut(rows), raising=False)
    rows = spark.createDataFrame([("d", "e0", 0, 0, "heading", "1 Costs", *LOW), ("d", "e1", 0, 1, "paragraph", "so it goes", *LOW)], ELEMENTS.removesuffix(", rule string, profile string"))
    made = N.structure(rows, spark.createDataFrame([], TARGETS), spark.createDataFrame([("d", "slides")], PROFILES))
    assert len(written) == 1
    # sections read what was written, and decide nothing anew
    assert "lead(element_type" not in made["sections"]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made["sections"].collect())) == [("d", "e0", 0), ("d", "e1", 0)]


def test_lines_of_reports_are_cut_before_they_are_numbered(spark, sf):
    plan = derived.rows(spark, sf, derived.TABLES["fx_elements"])._jdf.queryExecution().optimizedPlan().toString()
    assert "length(line" in plan.split("Window", 1)[1]
    # nothing of it is in the SQL that DuckDB reads
    assert derived._SHORT_ROWS not in derived.cte("fx_elements") and derived.duck(derived._ROWS) in derived.cte("fx_elements")
