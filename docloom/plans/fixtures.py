"""Small literal tables for what the driver's tables cannot hold, as DataFrames and as VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (column names and types, rows)
TABLES: dict[str, tuple[list[tuple[str, str]], list[tuple]]] = {
    "fx_elements": (
        [("element_id", "string"), ("document_id", "string"), ("page_index", "bigint"), ("reading_order", "bigint"), ("element_type", "string"), ("text", "string"), ("x1", "double"), ("y1", "double"), ("x2", "double"), ("y2", "double"), ("section_id", "string")],
        [
            ("e01", "dA", 0, 0, "heading", "1 Introduction", 0.10, 0.05, 0.90, 0.09, "s1"), ("e02", "dA", 0, 1, "paragraph", "As Figure 1 shows, growth is fast and", 0.10, 0.10, 0.48, 0.30, "s1"), ("e03", "dA", 0, 2, "figure", None, 0.10, 0.32, 0.48, 0.55, "s1"),
            ("e04", "dA", 0, 3, "caption", "Figure 1: Growth by year", 0.10, 0.56, 0.48, 0.60, "s1"), ("e05", "dA", 0, 4, "figure", None, 0.52, 0.32, 0.90, 0.55, "s1"), ("e06", "dA", 0, 5, "caption", "Figure 2: Costs by year", 0.52, 0.56, 0.90, 0.60, "s1"),
            ("e07", "dA", 0, 6, "paragraph", "the totals*, given in Table 1 and", 0.10, 0.80, 0.90, 0.90, "s1"), ("e08", "dA", 0, 7, "footnote", "* without taxes", 0.10, 0.93, 0.90, 0.96, "s1"),
            ("e09", "dA", 1, 0, "paragraph", "table 2, rise each year.", 0.10, 0.05, 0.90, 0.12, "s1"), ("e10", "dA", 1, 1, "caption", "Table 1: Totals", 0.10, 0.15, 0.90, 0.18, "s2"), ("e11", "dA", 1, 2, "table", "Year Cost", 0.10, 0.19, 0.90, 0.50, "s2"),
            ("e12", "dA", 1, 3, "caption", "Table 2: Shares", 0.10, 0.55, 0.90, 0.58, "s2"), ("e13", "dA", 1, 4, "table", "Year Share Total", 0.10, 0.59, 0.90, 0.95, "s2"), ("e14", "dA", 2, 0, "table", "Year Share Total", 0.10, 0.06, 0.90, 0.40, "s2"),
            ("e15", "dA", 2, 1, "paragraph", "See Figure 2, Table 2 and Section 1.", 0.10, 0.45, 0.90, 0.60, "s2"), ("e16", "dA", 2, 2, "paragraph", "See Table 9.", 0.10, 0.65, 0.90, 0.70, "s2"),
            ("g01", "dB", 0, 0, "heading", "1 Setting", 0.10, 0.05, 0.90, 0.09, "t1"), ("g02", "dB", 0, 1, "caption", "Figure 1: Another growth", 0.10, 0.15, 0.48, 0.18, "t1"), ("g03", "dB", 0, 2, "figure", None, 0.10, 0.20, 0.48, 0.50, "t1"),
            ("g04", "dB", 0, 3, "paragraph", "Figure 2 is not here, but Table 1 and the totals* are of", 0.10, 0.80, 0.90, 0.90, "t1"), ("g05", "dB", 0, 4, "footnote", "* with taxes", 0.10, 0.92, 0.90, 0.94, "t1"), ("g16", "dB", 0, 5, "footnote", "and some more", 0.10, 0.95, 0.90, 0.97, "t1"),
            ("g06", "dB", 1, 0, "paragraph", "another kind, all told.", 0.10, 0.05, 0.90, 0.12, "t1"), ("g07", "dB", 1, 1, "table", "Name Size", 0.10, 0.60, 0.90, 0.95, "t1"), ("g08", "dB", 2, 0, "table", "Name Size", 0.10, 0.05, 0.90, 0.30, "t1"),
            ("g09", "dB", 2, 1, "figure", None, 0.10, 0.40, 0.45, 0.70, "t1"), ("g10", "dB", 2, 2, "figure", None, 0.50, 0.40, 0.90, 0.70, "t1"), ("g11", "dB", 2, 3, "caption", "Figure 3: Two panels", 0.10, 0.72, 0.90, 0.75, "t1"),
            ("g17", "dB", 2, 4, "footnote", "Source: both", 0.10, 0.76, 0.90, 0.78, "t1"), ("g12", "dB", 2, 5, "list", "[1] A. Author, Title, 2001;", 0.10, 0.80, 0.90, 0.95, "t1"), ("g13", "dB", 3, 0, "list", "[2] b. Other, Title, 2003", 0.10, 0.05, 0.90, 0.20, "t1"),
            ("g14", "dB", 3, 5, "code", "def f(x):\n    y = x", 0.10, 0.60, 0.90, 0.90, "t1"), ("g15", "dB", 4, 0, "code", "    return y", 0.10, 0.05, 0.90, 0.20, "t1"), ("g18", "dB", 4, 1, "code", "    return  y", 0.10, 0.06, 0.90, 0.22, "t1"),
            ("g19", "dB", 5, 0, "paragraph", "the text goes over the page of pictures and", 0.10, 0.80, 0.90, 0.95, "t1"), ("g20", "dB", 6, 0, "figure", None, 0.10, 0.10, 0.90, 0.90, "t1"), ("g21", "dB", 7, 0, "paragraph", "comes to its end here.", 0.10, 0.05, 0.90, 0.12, "t1"),
        ],
    ),
    "fx_pages": (
        [("page_id", "string"), ("document_id", "string"), ("page_index", "bigint"), ("label", "string"), ("x", "double")],
        [(f"p{i:02d}", "dA", i, label, 0.9 if i == 9 else 0.5) for i, label in enumerate([None, "ii", "1", None, None, "4", "5", "6", None, "8", None, None])]
        + [(f"q{i:02d}", "dB", i, label, 0.5) for i, label in enumerate(["1", "2", None, "9", None, None, "15", "17"])],
    ),
    "fx_labels": (
        [("document_id", "string"), ("kind", "string"), ("number", "string"), ("target_id", "string"), ("priority", "bigint"), ("page_index", "bigint"), ("section_id", "string")],
        [("dA", "figure", "1", "e03", 100, 0, "s1"), ("dA", "figure", "2", "e05", 100, 0, "s1"), ("dA", "figure", "2", "e06", 70, 0, "s1"), ("dA", "table", "1", "e11", 100, 1, "s2"), ("dA", "table", "2", "e13", 100, 1, "s2"), ("dA", "table", "2", "e14", 90, 2, "s2"), ("dA", "section", "1", "e01", 100, 0, "s1"), ("dB", "figure", "1", "g03", 100, 0, "t1"), ("dB", "table", "1", "g07", 100, 1, "t1")],
    ),
    "fx_questions": (
        [("set_id", "string"), ("question_id", "string"), ("position", "bigint"), ("status", "string"), ("depends_on", "string")],
        [
            ("u", "q0", 0, "done", ""), ("u", "q1", 1, "done", "q0"), ("u", "q2", 2, "open", "q1"), ("u", "q3", 3, "open", "q1,q2"), ("u", "q4", 4, "open", "q0"), ("u", "q5", 5, "open", "q6"), ("u", "q6", 6, "open", "q5"), ("u", "q7", 7, "open", "q9"), ("u", "q8", 8, "open", "q8"),
            ("v", "q0", 0, "open", ""), ("v", "q1", 1, "open", "q0"), ("v", "q2", 2, "done", ""), ("v", "q3", 3, "open", "q2"), ("v", "q4", 4, "open", "q3"), ("v", "q5", 5, "open", "q4"), ("v", "q6", 6, "open", "q5"), ("v", "q9", 7, "open", "q2,q6"),
        ],
    ),
    "fx_observations": (
        [("observation_id", "string"), ("stored", "bigint"), ("source_id", "string"), ("claim", "string")],
        [
            ("o1", 0, "e02", "Growth of 12% in 2019"), ("o2", 1, "e11", "Total costs were 400 in 2020"), ("o3", 2, "e11", "Total costs were 400 in 2020"), ("o4", 3, "e13", "Share of costs 12% of total"), ("o5", 4, "e15", "Nothing relevant"), ("o6", 5, "e99", "Costs by year"),
        ],
    ),
    "fx_evidence": (
        [("evidence_id", "string"), ("observation_id", "string"), ("question_id", "string")],
        [("v1", "o1", "q1"), ("v2", "o2", "q2"), ("v3", "o7", "q2"), ("v4", "o4", "q11"), ("v5", "o4", "q4")],
    ),
    "fx_relations": (
        [("relation_id", "string"), ("document_id", "string"), ("source_id", "string"), ("target_id", "string"), ("kind", "string"), ("confidence", "double"), ("origin", "bigint")],
        [
            ("r1", "dA", "e04", "e03", "caption_of", 0.95, 1), ("r1", "dA", "e04", "e05", "caption_of", 1.0, 2), ("r2", "dA", "e13", "e14", "continues", 0.7, 1), ("r3", "dA", "e07", "e09", "continues", 0.6, 1), ("r4", "dA", "e09", "e15", "continues", 0.9, 1),
            ("r5", "dA", "e01", "e77", "contains", 1.0, 1), ("r6", "dA", "e02", "e02", "contains", 1.0, 1), ("r2", "dA", "e13", "e14", "continues", 0.8, 3), ("r7", "dA", "e15", "e16", "continues", 0.5, 2),
            ("r1", "dB", "g02", "g03", "caption_of", 0.9, 1), ("r2", "dB", "g07", "g08", "continues", 0.9, 1), ("r8", "dB", "e13", "e14", "continues", 0.9, 1), ("r9", "dB", "g01", "g02", "contains", 1.5, 1),
        ],
    ),
    "fx_scores": (
        [("case_id", "string"), ("gold", "string"), ("prediction", "string"), ("status", "string")],
        [
            ("c1", "Blue", " blue. ", "ready"), ("c2", "12", "13", "ready"), ("c3", "Not answerable", "not answerable", "ready"), ("c4", "Not answerable", "7", "ready"), ("c5", "Paris", "Not Answerable", "stopped_incomplete"), ("c6", "Straße", "STRASSE", "ready"),
            ("c7", "a b", "a  b", "budget_exhausted"), ("c8", "x", None, None),
        ],
    ),
    "fx_questions_text": (
        [("question_id", "string"), ("text", "string")],
        [("t1", "How many charts are in the document?"), ("t2", "What is the largest value in the table on page 3?"), ("t3", "Is the total of row 2 higher than of row 3?"), ("t4", "List all colors in Figure 4."), ("t5", "Who wrote it?")],
    ),
    "fx_headings": (
        [("doc", "string"), ("pos", "bigint"), ("level", "bigint"), ("title", "string")],
        [("d1", 0, 1, "One"), ("d1", 3, 2, "One A"), ("d1", 5, 3, "One A i"), ("d1", 8, 2, "One B"), ("d1", 9, 1, "Two"), ("d1", 12, 3, "Two i"), ("d2", 1, 2, "Alone"), ("d2", 4, 2, "Next")],
    ),
    "fx_titles": (
        [("doc", "string"), ("page", "bigint"), ("pos", "bigint"), ("text", "string"), ("is_furniture", "boolean"), ("after_table", "boolean")],
        [
            ("d1", 0, 0, "Annual Report", True, False), ("d1", 0, 1, "  ", False, False), ("d1", 0, 2, "see www.example.com", False, False), ("d1", 0, 3, "+1 (555) 010-9999", False, False), ("d1", 1, 0, "$12.5 million", False, False), ("d1", 1, 1, "Step 3 of the way", False, False),
            ("d1", 1, 2, "Sincerely, the board", False, False), ("d1", 1, 3, "This is how it works.", False, False), ("d1", 2, 0, "Notes:", False, True), ("d1", 2, 1, "Notes:", False, False), ("d1", 0, 4, "Our View", False, False), ("d1", 1, 4, "our  view", False, False), ("d1", 2, 2, "Our View", False, False),
            ("d1", 3, 0, "Results", False, False), ("d1", 4, 0, "Results", False, False), ("d1", 5, 0, "Results", False, False), ("d2", 0, 0, "Our View", False, False), ("d2", 0, 1, "1 Scope", False, False), ("d2", 1, 0, "1 Scope", False, False), ("d2", 2, 0, "1 Scope", False, False), ("d2", 3, 0, "a@b.example", False, False),
        ],
    ),
    "fx_references": (
        [("target_id", "string"), ("section_id", "string"), ("confidence", "double"), ("pages", "bigint"), ("side", "string")],
        [("f1", "s1", 0.95, 0, "before"), ("f1", "s2", 0.95, 1, "before"), ("f2", "s1", 0.9, 1, "before"), ("f2", "s2", 0.9, 1, "before"), ("f3", "s3", 0.9, 3, "before"), ("f4", "s3", 0.9, 1, "after"), ("f4", "s4", 0.8, 2, "before"), ("f5", "s5", 0.7, 2, "after")],
    ),
    "fx_calls": (
        [("example_id", "string"), ("session", "string"), ("step", "bigint"), ("action", "string"), ("target", "string"), ("valid", "boolean"), ("accepted", "boolean")],
        [
            ("x1", "a", 1, "SEARCH", "growth", True, True), ("x2", "a", 2, "SEARCH", "growth", True, False), ("x3", "a", 3, "READ_SOURCE", "e02", True, True), ("x4", "b", 1, "SEARCH", "cost", False, None), ("x4", "b", 2, "READ_SOURCE", "e11", True, True),
            ("x5", "b", 3, "STOP", None, True, True), ("x6", "c", 1, "SEARCH", "growth", True, True),
        ],
    ),
    "fx_firings": (
        [("rule_id", "string"), ("document_id", "string"), ("element_id", "string"), ("status", "string")],
        [("heading.style", "d1", "e1", "confirmed"), ("heading.style", "d1", "e2", "candidate"), ("heading.style", "d2", "e9", "confirmed"), ("caption.nearest", "d2", "e3", "confirmed"), ("caption.nearest", "d2", "e3", "confirmed")],
    ),
    "fx_scopes": (
        [("question_id", "string"), ("scope", "string"), ("pages", "bigint")],
        [("g1", "first 3 pages", 9), ("g2", "last 2 pages", 9), ("g3", "pages 2-4", 9), ("g4", "pages 1, 3 and 5", 9), ("g5", "page 7", 9), ("g6", "whole document", 9), ("g7", "the appendix", 9), ("g8", "Last 4 pages", 3), ("g9", "pages 2 to 9", 3), ("h1", "page 7", 3)],
    ),
    "fx_deltas": (
        [("session", "string"), ("step", "bigint"), ("op", "string"), ("evidence_id", "string"), ("observation_id", "string")],
        [
            ("a", 1, "add", "v1", "o1"), ("a", 2, "add", "v2", "o2"), ("a", 3, "replace", "v1", "o3"), ("a", 4, "remove", "v2", None), ("a", 5, "add", "v3", "o9"), ("b", 1, "remove", "v1", None), ("b", 2, "add", "v1", "o1"), ("b", 3, "add", "v1", "o2"),
        ],
    ),
    "fx_cells": (
        [("table_id", "string"), ("r", "bigint"), ("c", "bigint"), ("rowspan", "bigint"), ("colspan", "bigint"), ("text", "string")],
        [("t1", 0, 0, 1, 2, "Head"), ("t1", 0, 2, 2, 1, "Tall"), ("t1", 1, 0, 1, 1, "a"), ("t1", 1, 1, 1, 1, "b"), ("t1", 2, 0, 1, 3, "wide"), ("t2", 0, 0, 1, 1, "x"), ("t2", 0, 0, 2, 1, "y")],
    ),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = TABLES[name]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in columns))


def cte(name: str) -> str:
    """name(columns) as (values ...), typed."""
    columns, rows = TABLES[name]
    show = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    values = ", ".join("(" + ", ".join(show(v) for v in row) + ")" for row in rows)
    types = {"string": "varchar"}
    return f"{name} as (select " + ", ".join(f"c{i}::{types.get(t, t)} as {c}" for i, (c, t) in enumerate(columns)) + f" from (values {values}) v({', '.join(f'c{i}' for i in range(len(columns)))}))"
