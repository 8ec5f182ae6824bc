"""Sections of floating elements: one document for each step, with the same ids in all."""

from docloom.operators import floating as V

ELEMENTS = "document_id string, element_id string, element_type string, text string, section_id string, step string, doc string"
REFERENCES = "document_id string, target_id string, section_id string, confidence double, pages int, side string"
LISTINGS = "document_id string, source_id string, target_id string, confidence double"
RELATIONS = "document_id string, source_id string, target_id string, kind string, confidence double"
TITLES, GROUPS = "document_id string, section_id string, title string", "document_id string, caption_id string, member_id string"


def solved(spark, elements=(), references=(), listings=(), relations=(), titles=(), groups=()):
    made = [spark.createDataFrame(list(r), s) for r, s in (([(*e, "x", "y") for e in elements], ELEMENTS), (references, REFERENCES), (listings, LISTINGS), (relations, RELATIONS), (titles, TITLES), (groups, GROUPS))]
    return {(r.document_id, r.element_id): (r.section_id, r.step, r.ambiguous) for r in V.resolve(*made).collect()}


def test_each_step_decides_what_is_left(spark):
    elements, want = [], {}

    def element(d, e, kind, text=None, result=("s0", "base", False)):
        elements.append((d, e, kind, text, "s0"))
        want[d, e] = result

    vote = lambda d, e, s, c=0.9: (d, e, s, c, 0, "before")
    references, listings, relations, titles, groups = [], [], [], [], []
    # d1: references, with a tie
    element("d1", "a", "figure", result=("s1", "reference", False))
    element("d1", "b", "figure", result=("s0", "base", True))
    references += [vote("d1", "a", "s1"), vote("d1", "a", "s2", 0.8), vote("d1", "b", "s1"), vote("d1", "b", "s2")]
    # d2: a listing chain from a referenced listing; a figure on the chain gets nothing by it
    element("d2", "a", "code", result=("s2", "reference", False))
    element("d2", "b", "code", result=("s2", "listing_chain", False))
    element("d2", "c", "figure")
    references.append(vote("d2", "a", "s2"))
    listings += [("d2", "a", "b", 0.9), ("d2", "b", "c", 0.9)]
    # d3: confirmed continuations, in both directions; an unsure one hands on nothing
    for e, result in (("a", ("s3", "reference", False)), ("b", ("s3", "continuation", False)), ("c", ("s3", "continuation", False)), ("d", ("s0", "base", False))):
        element("d3", e, "table", result=result)
    references.append(vote("d3", "a", "s3"))
    relations += [("d3", "a", "b", "continues", 0.9), ("d3", "c", "b", "continues", 0.9), ("d3", "c", "d", "continues", 0.5)]
    # d4: a caption that begins with a title, its figure by the caption's group, and a note of the figure by its function
    element("d4", "a", "caption", "Market share by year", ("s4", "title", False))
    element("d4", "b", "figure", result=("s4", "reference", False))
    element("d4", "c", "figure", result=("s4", "caption_group", False))
    element("d4", "n", "footnote", "* so", ("s4", "function", False))
    references.append(vote("d4", "b", "s4"))
    titles += [("d4", "s4", "Market share"), ("d4", "s5", "By year")]
    groups += [("d4", "a", "b"), ("d4", "a", "c")]
    relations.append(("d4", "n", "c", "footnote_of", 0.4))
    # a paragraph floats not; a document without anything keeps its base
    elements.append(("d4", "p", "paragraph", "Market share", "s0"))
    element("d5", "a", "figure")
    assert solved(spark, elements, references, listings, relations, titles, groups) == want


def test_edges_of_tables(spark):
    assert solved(spark) == {}
    one = [("d", "a", "figure", None, None), ("d", "a", "figure", None, None), (None, "a", "figure", None, "s")]
    assert solved(spark, one, references=[("d", "a", None, 0.9, 0, "before"), ("d", "zz", "s1", 0.9, 0, "before")]) == {("d", "a"): (None, "base", False), (None, "a"): ("s", "base", False)}
