"""Queries against DuckDB, and the operators that SQL cannot express against plain Python."""

import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.functions import chunking as C
from docloom.functions import text as T
from docloom.operators import relations as X
from docloom.operators import retrieval as R
from docloom.operators import structure as S
from docloom.plans import QUERIES, SQL
from docloom.plans.fixtures import frame
from docloom.plans.passes import DocSet, Pass, fingerprint, run_passes
from docloom.sources import parser
from docloom.streaming import events as EV

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    rows = QUERIES[name](spark, sf)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def plain_chunks(text):
    """Chunks by trying each end of a window from its last."""
    spans, out, i = C.token_spans(text), [], 0
    if len(spans) <= 256:
        return [(len(text) - len(text.lstrip()), len(text.rstrip()))] if text.strip() else []
    while i < len(spans):
        raw = end = min(len(spans), i + 256)
        if raw < len(spans):
            for e in range(raw, i + max(1, int(0.65 * (raw - i))) - 1, -1):
                if "\n" in text[spans[e - 1][1] : spans[e][0]]:
                    end = e
                    break
        a, b = (0 if i == 0 else spans[i][0]), (spans[end][0] if end < len(spans) else len(text))
        out.append((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())))
        if end == len(spans):
            break
        i = max(i + 1, end - 32)
    return out


def test_tokens_and_chunks(spark):
    text = "Naïve straße A-1.b 中文字 x_y 12%"
    assert [t for _, _, t in C.token_spans(text)] == ["na", "ïve", "stra", "sse", "a-1.b", "中", "文", "字", "x_y", "12"]
    assert [t for _, _, t in C.search_spans("中文")] == ["中", "中文", "文"]
    assert spark.createDataFrame([(text,)], "t string").select(T.base_tokens(F.col("t")).alias("x")).first().x == [t for _, _, t in C.token_spans(text)]
    words = " ".join(f"w{i}" for i in range(700))
    parts = C.chunk_ranges(words)
    assert [len(C.token_spans(words[a:b])) for a, b in parts] == [256, 256, 252]
    broken = " ".join(f"w{i}" for i in range(200)) + "\n" + " ".join(f"v{i}" for i in range(200))
    assert broken[slice(*C.chunk_ranges(broken)[0])].endswith("w199")
    assert C.chunk_ranges("  one two  ") == [(2, 9)] and C.chunk_ranges(" \n") == []
    assert C.windows(10, [3, 6], 5, 2, 0.6) == [(0, 3), (1, 6), (4, 9), (7, 10)]
    r = random.Random(5)
    for _ in range(60):
        t = "".join(r.choice(["word ", "a.b ", "\n", "中", " ", "x-\n"]) for _ in range(r.randint(0, 1200)))
        assert C.chunk_ranges(t) == plain_chunks(t)
    covered = set()
    for a, b in C.segment_ranges(words, lambda t: [(s, e) for s, e, _ in C.token_spans(t)], 100, 10):
        covered |= set(range(a, b))
    assert {i for s, e, _ in C.token_spans(words) for i in range(s, e)} <= covered
    rows = C.chunks(spark.createDataFrame([(1, words), (2, None)], "k long, t string"), ["k"], "t").collect()
    assert [(r.k, r.part, r.tokens) for r in rows] == [(1, 0, 256), (1, 1, 256), (1, 2, 252)]


def test_tables_and_rows():
    html = "<table><tr><th colspan=2>A &amp; B</th><th rowspan=2>C</th></tr><tr><td>1<td>2</tr><tr><td>3<table><tr><td>x</table></td></tr></table>"
    cells = C.table_cells(html)
    assert cells == [(0, 0, 1, 2, True, "A & B"), (0, 2, 2, 1, True, "C"), (1, 0, 1, 1, False, "1"), (1, 1, 1, 1, False, "2"), (2, 0, 1, 1, False, "3")]
    assert C.header_rows(cells) == 1 and C.row_lines(cells)[0] == "r0c0: A & B"
    assert C.row_relevance({"cost", "revenue"}, ["costs", "revenue"]) == 5 and C.row_relevance({"organise"}, ["organize"]) > 1.2


def test_anchors_and_headings(spark):
    found = C.anchor_mentions("See Figure 2(a), fig. IV and Table 3 on page 12; Section 1.2. Figure 2(a) again. Slide 4, 图3")
    assert [f[:2] for f in found] == [("figure", "2a"), ("figure", "iv"), ("table", "3"), ("page", "12"), ("section", "1.2"), ("slide", "4"), ("figure", "3")]
    named = lambda t: [f[:2] for f in C.anchor_mentions(t)]
    assert named("图 3(b)，表2a，第 12 页，第3.1节，第3章") == [("figure", "3b"), ("table", "2a"), ("page", "12"), ("section", "3.1")]
    assert named("page (7), p. 8, Fig 2 b, Table II(c), Figure 1.5, table3x, prefigure 3, Section 4., FIG. 9") == [("page", "7"), ("page", "8"), ("figure", "2"), ("table", "iic"), ("table", "3x"), ("section", "4"), ("figure", "9")]
    assert named("Name the table (e.g. Table 5 or Figure 6), see Table 7") == [("table", "7")]
    for text in ("Figure 2(a", "fig", "page (", "第", "Section .", "Table " * 500, "("):
        assert all(text[s:e] for _, _, s, e in C.anchor_mentions(text))
    assert C.expand_labels("1-4") == ["1", "2", "3", "4"] and C.expand_labels("1, 3 and 5") == ["1", "3", "5"] and C.expand_labels("1-99") == []
    assert [C.explicit_level(t) for t in ("1 Intro", "2.3.1 Deep", "Appendix B.2 More", "Chapter II", "References", "Plain", "U.S. economy", "A Proofs", "B.1 Lemmas", "C. Data", "A dog", "Item 7A Risks", "2019", "1.2.", "Part of it", "Appendix")] == [1, 3, 2, 1, 1, None, None, 1, 2, 1, None, 1, None, None, None, None]
    rows = [("d", 0, "1 Intro", "big"), ("d", 1, "Free", "big"), ("d", 2, "2.1 Sub", "mid"), ("d", 3, "Other", "odd")]
    out = C.heading_levels(spark.createDataFrame(rows, "doc string, pos long, text string, style string")).orderBy("pos").collect()
    assert [(r.level, r.method) for r in out] == [(1, "numbering"), (1, "style"), (2, "numbering"), (2, "previous")]
    assert C.uncovered("alpha beta gamma", ["xx beta yy"]) == ["alpha", "gamma"]


def test_text_columns(spark):
    rows = spark.createDataFrame([("a  b\r\n\r\n c \t d",)], "t string")
    assert rows.select(T.normalize_text(F.col("t")).alias("x")).first().x == "a b\nc\td"
    page = spark.createDataFrame([("<tr><td>a</td><td>b&amp;c</td></tr><p>d</p><script>x</script>",)], "t string")
    assert page.select(T.html_to_text(F.col("t")).alias("x")).first().x == "a\tb&c\nd"
    arr = spark.createDataFrame([(["A", "a ", "b", "A"],)], "t array<string>")
    assert arr.select(T.drop_adjacent_repeats(F.col("t")).alias("x")).first().x == ["A", "b", "A"]


def test_quota_backfill_and_late_interaction(spark):
    rows = [("q", "bm25", f"e{i}", 1, i + 1) for i in range(3)] + [("q", "dense", f"e{i}", 1, k + 1) for k, i in enumerate((0, 7, 8, 9, 10))]
    r = spark.createDataFrame(rows, "query_id string, route string, element_id string, page_number int, rank int")
    out = [(x.element_id, x.route) for x in R.fixed_quota(r, {"bm25": 3, "dense": 2}).orderBy("position").collect()]
    assert [e for e, _ in out] == ["e0", "e1", "e2", "e7", "e8", "e9", "e10"]
    p = spark.createDataFrame([("a", [[1.0, 0.0], [0.0, 2.0]]), ("b", [[1.0, 1.0]])], "id string, tokens array<array<double>>")
    got = {x.id: x.score for x in R.late_interaction(p, [[1.0, 0.0], [0.0, 1.0]]).collect()}
    assert got["a"] == pytest.approx(2) and got["b"] == pytest.approx(2**0.5)


def test_continuations(spark):
    assert sorted((r.source_id, r.target_id) for r in X.table_continuations(frame(spark, "fx_elements")).collect()) == [("e13", "e14"), ("g07", "g08")]
    # the second pair goes over a page of nothing but pictures
    assert sorted((r.source_id, r.target_id) for r in X.paragraph_continuations(frame(spark, "fx_elements")).collect()) == [("e07", "e09"), ("g19", "g21")]


def test_profiles(spark):
    base = dict(has_abstract=False, has_references=False, numbered_headings=0, chapter_headings=0, has_contents=False, has_index=False, section_labels=0, table_ratio=0.0, full_page_tables=0, brochure_identity=False, brochure_terms=0, repeated_short_headings=0, sparse_ratio=0.0, pages=1, landscape_ratio=0.0, median_chars=5000.0, median_items=50.0, pattern_ratio=0.0)
    cases = [({}, "report"), ({"has_abstract": True}, "academic"), ({"chapter_headings": 2}, "manual"), ({"section_labels": 3, "table_ratio": 0.1}, "form"), ({"pages": 5, "landscape_ratio": 1.0, "sparse_ratio": 0.9, "median_chars": 300.0, "median_items": 5.0, "pattern_ratio": 0.5}, "slides")]
    rows = spark.createDataFrame([{**base, **change} for change, _ in cases])
    assert sorted(r.profile for r in S.profile(rows).collect()) == sorted(p for _, p in cases)


def test_parser_source(spark, tmp_path):
    blocks = [
        [{"type": "title", "bbox": [80, 70, 920, 140], "content": {"title_content": [{"type": "text", "content": "1 Intro"}], "level": 1}}, {"type": "page_number", "bbox": [1, 1, 2, 2], "content": {}},
         {"type": "image", "bbox": [140, 500, 860, 900], "extra": 1, "content": {"content": "A scheme.", "image_caption": [{"type": "text", "content": "Figure 1."}, {"type": "text", "content": "Scheme"}], "image_caption_bbox": [180, 920, 820, 970]}}],
        [{"type": "table", "bbox": [100, 110, 90, 520], "content": {"html": "<table><tr><td>x</td></tr></table>"}}, {"type": "mystery", "bbox": [1, 2, 3, 4], "content": {}}],
    ]
    (tmp_path / "content.json").write_text(json.dumps(blocks))
    (tmp_path / "layout.json").write_text(json.dumps({"doc_id": "d", "pdf_info": [{"page_idx": 0, "page_number": 1, "page_size": [1000, 1400]}, {"page_idx": 1, "page_number": 2, "page_size": [1000, 1400]}]}))
    b = parser.read_blocks(spark, str(tmp_path / "content.json"), "d")
    e = parser.elements(b, parser.read_layout(spark, str(tmp_path / "layout.json")))
    rows = e.orderBy("page_index", "reading_order").collect()
    assert [(r.page_index, r.element_type, r.text) for r in rows] == [(0, "heading", "1 Intro"), (0, "caption", "Figure 1. Scheme"), (0, "figure", "A scheme."), (1, "table", None)]
    assert rows[0].box.x1 == pytest.approx(0.08) and rows[0].box.y2 == pytest.approx(0.1) and rows[3].box is None
    assert {r.warning for r in parser.warnings(b, e).collect()} == {"unknown_type:mystery", "unknown_field:extra", "no_box"}
    # two documents side by side keep their own pages
    (tmp_path / "other_content_list_v2.json").write_text(json.dumps(blocks[:1]))
    two = b.unionByName(parser.read_blocks(spark, str(tmp_path / "other_content_list_v2.json")))
    assert sorted({r.doc_id for r in two.collect()}) == ["d", "other"]
    both = parser.elements(two, parser.read_layout(spark, str(tmp_path / "layout.json")))
    assert both.count() == 7 and both.where("doc_id = 'other' and box is not null").count() == 0
    assert parser.align(b, b).where("block_index = layout_index").count() == 5
    parser.write_document({"elements": e.drop("box")}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/elements")).count() == 4


def test_embedding_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("k1", [1.0])], "key string, vector array<float>").write.parquet(path)
    wanted = spark.createDataFrame([("k1", "a"), ("k2", "bb"), ("k2", "bb"), ("k3", "ccc")], "key string, text string")
    parser.fill_cache(wanted, spark.read.parquet(path), lambda texts: [[len(t)] for t in texts], path)
    assert sorted((r.key, r.vector[0]) for r in spark.read.parquet(path).collect()) == [("k1", 1.0), ("k2", 2.0), ("k3", 3.0)]
    assert parser.missing_embeddings(wanted, spark.read.parquet(path)).count() == 0
    versions = spark.createDataFrame([("c", 1, "old"), ("c", 2, "new")], "key string, root int, answer string")
    assert [r.answer for r in parser.last_wins(versions, "key", "root").collect()] == ["new"]


def test_passes(spark):
    docs = DocSet({"elements": spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")})
    upper = Pass("upper", lambda d: d.with_tables(elements=d.tables["elements"].withColumn("text", F.upper("text"))), provides=frozenset({"upper"}))
    needs = Pass("needs", lambda d: d, requires=frozenset({"upper"}))
    out = run_passes(docs, [upper, needs, upper])
    assert out.reports == (("upper", "ran"), ("needs", "ran"), ("upper", "skipped"))
    assert fingerprint(out.tables["elements"]) == fingerprint(out.tables["elements"].select("text", "id").orderBy(F.desc("id"))) != fingerprint(docs.tables["elements"])
    with pytest.raises(ValueError):
        run_passes(docs, [needs])


def test_streams_agree_with_batches(spark, sf, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").repartitionByRange(3, "ts").write.parquet(source)
    batch = spark.read.parquet(source)
    EV.run_once(EV.tumbling(EV.read_events(spark, source, 10)), "tumbling", str(tmp_path / "c1"), "complete")
    got = {(r.start.isoformat(), r.event_type): r.n for r in spark.table("tumbling").collect()}
    assert got == {(r.start.isoformat(), r.event_type): r.n for r in QUERIES["tumbling_counts"](spark, sf).collect()}
    EV.run_once(EV.deduplicated(EV.read_events(spark, source, 10).unionByName(EV.read_events(spark, source, 10))), "deduplicated", str(tmp_path / "c2"))
    assert spark.table("deduplicated").count() == batch.count()
    documents = spark.readStream.schema(spark.read.parquet(f"{sf}/documents.parquet").schema).parquet(f"{sf}/documents.parque*")
    EV.grow_index(documents, str(tmp_path / "index"), str(tmp_path / "c3"))
    want = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(T.base_tokens(F.col("text")))).count()
    assert spark.read.parquet(str(tmp_path / "index/postings")).agg(F.sum(F.aggregate("tf", F.lit(0), lambda s, x: s + x))).first()[0] == want


def test_long_chains_and_cycles(spark):
    from docloom.operators import evidence as V
    from docloom.operators import relations as R
    from docloom.operators import sections as SE

    chain = [(f"e{i:02}", f"e{i + 1:02}") for i in range(20)]
    known = spark.createDataFrame([("e00", "s1")], "element_id string, section_id string")
    got = {r.element_id: (r.section_id, r.round) for r in SE.inherit_along(spark.createDataFrame(chain, "a string, b string"), known).collect()}
    assert got == {f"e{i:02}": ("s1", i) for i in range(21)}
    rows = [("d", a, b, "continues", 0.9) for a, b in chain] + [("d", "e20", "e00", "continues", 0.9), ("d", "e05", "x", "continues", 0.5), ("d", "e05", "y", "caption_of", 0.9)]
    reach = {(r.source_id, r.target_id): r.hops for r in R.continuation_closure(spark.createDataFrame(rows, "document_id string, source_id string, target_id string, kind string, confidence double")).collect()}
    assert reach == {(f"e{i:02}", f"e{j:02}"): (j - i) % 21 or 21 for i in range(21) for j in range(21)}
    asked = [(f"q{i}", f"q{(i + 1) % 20}") for i in range(20)] + [("p", "q0"), ("r", "r"), ("t", "gone"), ("u", "")]
    # ids are those of a set: what one set lacks is not found in another
    both = [("u", *a) for a in asked] + [("v", "gone", "")]
    errors = {(r.question_id, r.error) for r in V.graph_errors(spark.createDataFrame(both, "set_id string, question_id string, depends_on string")).collect()}
    assert errors == {(f"q{i}", "cycle") for i in range(20)} | {("r", "self_dependency"), ("t", "unknown_dependency")}


def test_sections_and_state(spark):
    from docloom.operators import audit as A
    from docloom.operators import sections as SE

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("e", "d"), ("x", "y")], "a string, b string")
    known = spark.createDataFrame([("a", "s1"), ("e", "s2")], "element_id string, section_id string")
    got = {r.element_id: r.section_id for r in SE.inherit_along(edges, known).collect()}
    assert got == {"a": "s1", "e": "s2", "b": "s1", "d": "s2"}  # c is reached from both sides at once
    # documents with the same ids stay apart
    two = lambda rows: [(d, *r) for d, own in rows.items() for r in own]
    linked = spark.createDataFrame(two({"d": [("a", "b")], "z": [("b", "c")]}), "document_id string, a string, b string")
    placed = spark.createDataFrame(two({"d": [("a", "s1")], "z": [("c", "s9"), ("a", "s8")]}), "document_id string, element_id string, section_id string")
    assert sorted((r.document_id, r.element_id, r.section_id) for r in SE.inherit_along(linked, placed).collect()) == [("d", "a", "s1"), ("d", "b", "s1"), ("z", "a", "s8"), ("z", "b", "s9"), ("z", "c", "s9")]
    votes = spark.createDataFrame(two({"d": [("f", "s1", 0.9, 0, "before"), ("f", "s2", 0.8, 0, "before")], "z": [("f", "s2", 0.95, 0, "before")]}), "document_id string, target_id string, section_id string, confidence double, pages int, side string")
    resolved = SE.resolve_by_references(votes)
    assert sorted((r.document_id, r.section_id) for r in resolved.collect()) == [("d", "s1"), ("z", "s2")]
    bound = spark.createDataFrame(two({"d": [("c", "f", "caption_of")], "z": [("c", "f", "caption_of"), ("k", "f", "contains")]}), "document_id string, source_id string, target_id string, kind string")
    assert sorted(tuple(r) for r in SE.inherit(bound, resolved).collect()) == [("d", "c", "s1"), ("z", "c", "s2")]
    heads = [("d", p, 0, t, f, False) for p, t, f in ((0, "Local label", False), (1, "Local label", False), (2, "Local label", False), (0, "", False), (0, "see www.x.com", False), (0, "Top", True), (0, "12%", False), (0, "This is a whole sentence.", False), (0, "Fine Title", False))]
    out = SE.eligibility(spark.createDataFrame(heads, "doc string, page int, pos int, text string, is_furniture boolean, after_table boolean")).collect()
    assert sorted(r.reason or "-" for r in out) == sorted(["repeated_local_label"] * 3 + ["empty", "contact_or_url", "running_header_footer", "local_statistic", "functional_sentence", "-"])
    caps = spark.createDataFrame([("d", "c1", "Market share by year"), ("d", "c2", "Other")], "doc string, element_id string, text string")
    titles = spark.createDataFrame([("d", "s1", "Market"), ("d", "s2", "Market share"), ("d", "s3", "By")], "doc string, section_id string, title string")
    assert [(r.element_id, r.section_id) for r in SE.title_anchors(caps, titles).collect()] == [("c1", "s2")]
    fold = {(r.session, r.evidence_id): (r.observation_id, r.rejected) for r in A.evidence_fold(frame(spark, "fx_deltas")).collect()}
    assert fold == {("a", "v1"): ("o3", 0), ("a", "v3"): ("o9", 0), ("b", "v1"): ("o1", 2)}
    assert A.balanced_pick({"a": {"x": 1}, "b": {"x": 2}, "c": {"x": 5}}, 2, {"x": 3}) == ["b", "a"]
    assert A.literal_pages("[3, 5]") == [3, 5] and A.literal_pages("3") == []
    ranges = spark.createDataFrame([([(5, 8)],), ([(0, 2)],), ([(0, 2), (6, 7)],), ([],)], "r array<struct<start:int,stop:int>>")
    assert [x[0] for x in ranges.select(A.match_scope(F.col("r"), F.lit(4), F.lit(9))).collect()] == ["content", "metadata", "mixed", "unknown"]


BLOCK = "document_id string, element_id string, page_index long, reading_order long, element_type string, text string, x1 double, y1 double, x2 double, y2 double, section_id string"


def test_layout_continuations(spark):
    from docloom.operators import continuation as CO

    rows = [
        ("l1", 0, 5, "list", "[1] A. Author, Title, 2001;", 0.1, 0.5, 0.9, 0.95, "s"), ("l2", 1, 0, "list", "[2] b. Other, Title, 2003", 0.1, 0.05, 0.9, 0.4, "s"), ("c1", 1, 5, "code", "def f(x):\n    y = x", 0.1, 0.6, 0.9, 0.9, "s"),
        ("c2", 2, 0, "code", "    return y", 0.1, 0.05, 0.9, 0.2, "s"), ("c3", 3, 0, "code", "import os", 0.1, 0.5, 0.9, 0.6, "s"), ("c4", 3, 1, "code", "import os", 0.1, 0.5, 0.9, 0.62, "s"), ("n1", 3, 7, "footnote", "* one", 0.1, 0.90, 0.9, 0.92, "s"), ("n2", 3, 8, "footnote", "goes on", 0.1, 0.93, 0.9, 0.95, "s"),
        ("v1", 4, 0, "figure", None, 0.1, 0.1, 0.45, 0.4, "s"), ("v2", 4, 1, "figure", None, 0.55, 0.1, 0.9, 0.4, "s"), ("k1", 4, 2, "caption", "Figure 1: both", 0.1, 0.42, 0.9, 0.45, "s"),
    ]
    # a second document with the same boxes and other ids must not be paired with the first
    e = spark.createDataFrame([("d", *r) for r in rows] + [("z", f"z{r[0]}", *r[1:]) for r in rows if r[0] in ("l2", "c2", "n1", "v2", "c4")], BLOCK)
    pairs = lambda d: [tuple(r)[1:3] for r in d.collect()]
    assert pairs(CO.list_continuations(e)) == [("l1", "l2")] and pairs(CO.code_continuations(e)) == [("c1", "c2")]
    assert pairs(CO.duplicate_code(e)) == [("c4", "c3")]
    assert pairs(CO.markerless_notes(e, spark.createDataFrame([("d", "n1", "t9")], "document_id string, footnote_id string, target_id string"))) == [("n2", "t9")]
    assert pairs(CO.panel_members(e, spark.createDataFrame([("d", "k1", "v1")], "document_id string, caption_id string, target_id string"))) == [("k1", "v2")]
    heads = spark.createDataFrame([("g", 0, ["A"]), ("g", 1, None)], "group_id string, fragment_index int, headers array<string>")
    assert [r.headers for r in CO.inherited_headers(heads).collect()] == [["A"], ["A"]]
    whole = ["h", "a", "b", "c", "d"]
    parts = [("g", 0, ["h", "a", "b"], whole), ("g", 1, ["h", "c", "d"], whole), ("k", 0, ["h", "a"], whole), ("k", 1, ["x"], whole)]
    # a second document's table of the same name holds other rows
    parts = [("d", *p) for p in parts] + [("e", "g", 0, ["y"], ["y", "z"]), ("e", "g", 1, ["z"], ["y", "z"])]
    placed = CO.fragment_positions(spark.createDataFrame(parts, "document_id string, group_id string, fragment_index int, rows array<string>, whole array<string>")).collect()
    assert [(r.row_start, r.row_end) for r in sorted(placed, key=lambda r: r.fragment_index) if r.document_id == "e"] == [(0, 1), (1, 2)]
    found = {(r.group_id, r.fragment_index): (r.row_start, r.row_end, r.header_rows) for r in placed if r.document_id == "d"}
    assert found == {("g", 0): (0, 3, 0), ("g", 1): (3, 5, 1), ("k", 0): (0, 2, 0), ("k", 1): (None, None, None)}


def test_normalisation(spark):
    from docloom.operators import normalize as N

    code = spark.createDataFrame([("Algorithm 3 Sort",), ("for (i = 0; i < n; i++) {\n  f(i);\n}",), ("Click the button in the menu",), ("user: tell me",), ("A plain sentence about things.",)], "t string")
    assert [r[0] for r in code.select(N.code_kind(F.col("t"), F.lit(None).cast("string"))).collect()] == ["algorithm", "code", "figure", "code", "paragraph"]
    rows = [("t", 0, 0, "table", "x"), ("a", 0, 1, "paragraph", "a) first"), ("b", 0, 2, "paragraph", "b) second"), ("q1", 1, 0, "paragraph", "1. Why?"), ("q2", 1, 1, "list", "2. How?"), ("z", 1, 2, "paragraph", "end")]
    e = spark.createDataFrame([("d", *r) for r in rows] + [("y", "yt", 0, 0, "table", "x"), ("y", "ya", 0, 1, "paragraph", "b) second"), ("y", "yq", 1, 0, "paragraph", "1. Why?")], "document_id string, element_id string, page_index long, reading_order long, element_type string, text string")
    assert [(r.table_id, r.element_id) for r in N.lettered_notes(e).orderBy("element_id").collect()] == [("t", "a"), ("t", "b")]
    assert [(r.page_index, r.blocks) for r in N.question_runs(e).collect()] == [(1, 2)]
    units = N.numbered_units(spark.createDataFrame([("i", "1. One\n2. Two\nstill two")], "element_id string, text string")).collect()
    assert [(r.unit, r.number) for r in units] == [(0, "1"), (1, "2")]
    notes = spark.createDataFrame([("Source: X", "report", False), ("1 Note", "report", True), ("Call us", "report", False), ("plain note", "report", False)], "t string, p string, h boolean")
    kinds = notes.select(N.footnote_kind(F.col("t"), F.col("p"), F.array(F.lit("paragraph")), F.lit(0.0), F.col("h")).alias("x")).select("x.*").collect()
    assert [(r.kind, r.confidence, r.resolved) for r in kinds] == [("footnote", 0.97, True), ("footnote", 0.98, True), ("paragraph", 0.94, True), ("footnote", 0.70, False)]


def test_tables_in_and_out(spark, tmp_path):
    from docloom.operators import audit as A
    from docloom.sources import tables as TB

    blocks = [[{"type": "page_number", "bbox": [480, 1350, 520, 1380], "content": {"page_number_content": [{"type": "text", "content": " 7 "}]}}, {"type": "page_number", "bbox": [10, 700, 20, 720], "content": {}}, {"type": "page_number", "bbox": [480, 700, 520, 720], "content": {"content": "x"}}]]
    (tmp_path / "content.json").write_text(json.dumps(blocks))
    layout = spark.createDataFrame([("d", 0, 1, 1000.0, 1400.0), ("e", 0, 1, 10.0, 10.0)], "doc_id string, page_index int, page_number int, width double, height double")
    rows = TB.page_label_signals(parser.read_blocks(spark, str(tmp_path / "content.json"), "d"), layout).collect()
    assert sorted((r.text, r.marginal) for r in rows) == [("7", True), ("x", False)]
    e = spark.createDataFrame([("d", "e1", 0, 0, "paragraph", "t", 0.1, 0.1, 0.2, 0.2, None)], TB.SCHEMAS["elements"])
    parser.write_document({"elements": e}, str(tmp_path / "doc"))
    back = TB.load_document(spark, str(tmp_path / "doc"))
    assert back["elements"].collect() == e.collect() and back["relations"].count() == 0 and set(back) == set(TB.SCHEMAS)
    runs = lambda v: spark.createDataFrame(v, "run_id string, component string, case_id string, n int")
    TB.write_run(runs([("r1", "reader", "c1", 1), ("r2", "reader", "c1", 2)]), str(tmp_path / "runs"))
    TB.write_run(runs([("r2", "reader", "c1", 3)]), str(tmp_path / "runs"))
    read = lambda r: [tuple(x) for x in TB.read_run(spark, str(tmp_path / "runs"), r, "case_id string, n int").collect()]
    assert read("r1") == [("c1", 1, "r1", "reader")] and read("r2") == [("c1", 3, "r2", "reader")] and read("r3") == []
    rules = A.rule_coverage(frame(spark, "fx_firings"))
    text = TB.coverage_markdown(rules)
    assert text.count("\n") == 4 and "| caption.nearest | 2 | 1 | confirmed | e3 |" in text
    TB.write_coverage(rules, str(tmp_path / "coverage"))
    assert spark.read.json(str(tmp_path / "coverage/rules")).count() == 2 and spark.read.text(str(tmp_path / "coverage/markdown"), wholetext=True).first().value == text
    for kind in ("parquet", "orc", "json", "csv"):
        runs([("r", "c", "x", 1)]).write.format(kind).save(str(tmp_path / kind))
        assert [tuple(r) for r in TB.read_table(spark, str(tmp_path / kind), kind, "run_id string, component string, case_id string, n int").collect()] == [("r", "c", "x", 1)]


def test_late_rows_and_other_windows(spark, tmp_path):
    """A row that comes after the watermark has passed it changes nothing; sliding and session windows and the fold agree with batches."""
    import datetime as dt
    import time

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    files = [[(1, at(10, 0), 1, "a", 1.0, "")], [(2, at(14, 0), 1, "b", 2.0, ""), (2, at(14, 0), 1, "b", 2.0, "")], [(4, at(14, 20), 2, "a", 1.0, "")], [(3, at(10, 30), 1, "late", 9.0, "")], [(5, at(20, 0), 1, "a", 1.0, "")]]
    source = str(tmp_path / "late")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    run = lambda name, f, mode: (EV.run_once(f(EV.read_events(spark, source, 1)), name, str(tmp_path / name), mode), spark.table(name).collect())[1]
    got = {(r.start.hour, r.event_type): r.n for r in run("late_tumbling", EV.tumbling, "append")}
    assert got == {(10, "a"): 1, (14, "b"): 2, (14, "a"): 1}
    assert sorted(r.event_id for r in run("late_unique", EV.deduplicated, "append")) == [1, 2, 4, 5]
    slides = {(r.start.hour, r.start.minute): r.n for r in run("late_sliding", EV.sliding, "append")}
    assert slides[10, 0] == 1 and slides[14, 0] == 3 and slides[13, 15] == 2 and slides[13, 30] == 3 and (10, 15) not in slides
    held = {(r.user_id, r.start.hour): r.n for r in run("late_sessions", EV.sessions, "append")}
    assert held == {(1, 10): 1, (1, 14): 2, (2, 14): 1}


def test_stateful_fold_over_batches(spark, sf, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        EV.run_once(EV.fold(EV.read_events(spark, source, 1)), "folded", str(tmp_path / "fold"), "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {r.user_id: (r.actions, r.n) for r in spark.table("folded").groupBy("user_id").agg(F.max("actions").alias("actions"), F.max("n").alias("n")).collect()}
    assert last == {r.user_id: (r.a, r.n) for r in spark.read.parquet(source).groupBy("user_id").agg(F.countDistinct("event_type").alias("a"), F.count("*").alias("n")).collect()}


def test_heading_matches():
    assert T.compact_heading("Ⅲ. Résumé & Ziele") == "iiiresumeziele"
    assert T.heading_match("Risk Factors", "risk-factors") == 1 and T.heading_match("Risk Factors", "Risk Factors and more") == 0.98 and T.heading_match("Risk", "Risks") > 0.8 and T.heading_match("", "x") == 0
