"""What reviews found: odd rows against DuckDB, and searches against plain Python."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from docloom.functions import chunking as C
from docloom.operators import encoding as N
from docloom.operators import index as X
from docloom.operators import inventory as I
from docloom.operators import reading as R
from docloom.operators import tables as T
from docloom.operators.relations import document_errors, referential_errors
from docloom.plans import QUERIES, SQL


def against_sql(spark, folder, name, **tables):
    """The query's rows and those of its SQL, over own tables (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, str(folder))
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    return Counter(map(tuple, found.select(*names).collect())), Counter(cursor.fetchall())


DOCUMENTS = "doc_id long, text string"


def cancelling(dims):
    """Two words whose signed counts cancel."""
    client, seen = N.HashClient(dims), {}
    for i in range(1000):
        v = client.encode([f"w{i}"])[0]
        at = int(np.flatnonzero(v)[0])
        if (at, -v[at]) in seen:
            return f"{seen[at, -v[at]]} w{i}"
        seen[at, v[at]] = f"w{i}"


def test_encoded_documents_have_a_length(spark, tmp_path):
    texts = [cancelling(32), " ", "  \u0085", "\x1c", "", None, " \t\n", "one two"]
    got, want = against_sql(spark, tmp_path, "encoded_documents", documents=(list(enumerate(texts)), DOCUMENTS))
    assert got == want


def test_label_numbers_of_odd_lines(spark, tmp_path):
    odd = ["12% of all", "3-4 rows", "7: seven", "8", "12 apples", "(a) first", "a - c parts", "Figs 3 and 4", "Table IV here", "table C 5", "Figure XII b", "figure 9 (b)", "Fig. 2"]
    documents = [(i, "\n".join(odd[(i + j) % len(odd)] + "." * (j % 3) for j in range(17))) for i in range(130)]
    got, want = against_sql(spark, tmp_path, "label_numbers_of_elements", documents=(documents, DOCUMENTS))
    assert got == want and len(want) > 1000


def test_short_blocks_come_back(spark, tmp_path):
    blocks = ["Whole first", "second one", "third one", "A.", "fifth block", "sixth block", "...", "eighth", "ninth", "x"]
    pages = [(1, "".join(f"<p>{b}</p>" for b in blocks)), (2, "<li>7</li>"), (3, "<p></p>")]
    got, want = against_sql(spark, tmp_path, "recovered_blocks_of_pages", pages=(pages, "page_id long, html string"))
    assert got == want == {("p1", 4, 12): 1, ("p2", 1, 1): 1}


def test_best_observations_are_told_apart(spark):
    rows = [("d", 0, "ii", 0.5, 0.75), ("d", 0, "ii", 0.5, 0.25), ("d", 1, "ii", 0.5, 0.25), ("d", 1, "ii", 0.5, 0.75)]
    got = I.best_observations(spark.createDataFrame(rows, "document_id string, page_index long, label string, confidence double, y double").coalesce(1))
    assert sorted(tuple(r) for r in got.collect()) == [("d", 0, "ii", 0.5, 0.25), ("d", 1, "ii", 0.5, 0.25)]


def test_search_shuffles_no_posting_by_query(spark, tmp_path, monkeypatch):
    """Many queries for the same frequent terms, few postings at a time: the best of all units, and no step with a row a posting and query."""
    monkeypatch.setattr(X, "TOGETHER", 7)
    monkeypatch.setattr(X, "SHARDS", 3)
    r, path = random.Random(3), str(tmp_path / "i")
    rows = [(d, p, [r.choice("abcdefgh") for _ in range(r.randint(0, 9))]) for d in [None, *range(60)] for p in range(3)]
    X.add_batch(spark.createDataFrame(rows, "doc_id long, pos long, terms array<string>"), path, ["doc_id", "pos"], 0, 8)
    asked = {q: r.sample("abcdefghz", 4) for q in range(40)}
    terms = spark.createDataFrame([(q, t) for q, own in asked.items() for t in own], "query_id long, term string")
    n, mean, df = len(rows), sum(len(t) for *_, t in rows) / len(rows), Counter(x for *_, t in rows for x in set(t))
    found = X.search(spark, path, terms, ["doc_id", "pos"], 5, 8)
    got = {}
    for x in sorted(found.collect(), key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append((x.doc_id, x.pos, [(m.term, m.positions) for m in x.matches]))
    for q, own in asked.items():
        score = {}
        for d, p, t in rows:
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in sorted(own) if w in t]
            if parts:
                score[d, p] = (-round(sum(parts), 6), d is not None, d or 0, p), [(w, [k for k, y in enumerate(t) if y == w]) for w in sorted(own) if w in t]
        assert got[q] == [(*k, score[k][1]) for k in sorted(score, key=lambda k: score[k][0])[:5]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "mapInArrow" not in plan and "MapInArrow" not in plan  # what was found is written; only it meets postings again


def test_cells_of_no_table_are_not_gathered(spark):
    """Only cells of tables that are there are collected into lines."""
    elements = spark.createDataFrame([("d", "t", "table", "own"), ("d", "p", "paragraph", "text"), ("d", "u", "table", "no cells")], "document_id string, element_id string, element_type string, text string")
    known = [("d", "t", 0, 0, "a"), ("d", "t", 0, 1, "b"), ("d", "p", 0, 0, "not read")]
    cells = spark.createDataFrame([*known, *(("z", "t", k, 0, "x") for k in range(5000)), (None, "t", 0, 0, "y")], "document_id string, element_id string, r long, c long, text string")
    found = R.read_elements(elements, cells)
    assert sorted(tuple(r) for r in found.collect()) == [("d", "p", "text", None), ("d", "t", "r0c0: a\nr0c1: b", None), ("d", "u", "no cells", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("collect_list") :]  # below the collection


def test_index_shuffles_blocks(spark, tmp_path, monkeypatch):
    """What is shuffled and sorted are blocks; terms are counted a bounded number at a time, and a long row is one part."""
    monkeypatch.setattr(X, "TOGETHER", 5)
    rows = [(d, ["a"] * (d % 3) + ["b", "c"] * (d % 7)) for d in range(50)]
    units = spark.createDataFrame(rows, "doc_id long, terms array<string>").coalesce(1)
    found = X.blocks(units, ["doc_id"], 4, 8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "most_tf" in next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    got = Counter((d, b.term, tf, length) for b in found.collect() for d, tf, length in zip(b.doc_id, b.tf, b.length, strict=True))
    assert got == Counter((d, w, t.count(w), len(t)) for d, t in rows for w in set(t))
    X.add_batch(units, str(tmp_path / "i"), ["doc_id"])
    assert spark.read.parquet(str(tmp_path / "i/stats")).select("n", "total").first() == (50, sum(len(t) for _, t in rows))


def test_plain_tables_are_cut_as_the_parser_reads_them(monkeypatch):
    """Tags, odd ones among them, by the pattern and by HTMLParser; plain tables never reach the latter."""
    r = random.Random(4)
    plain = ["<tr>", "</tr>", "<td>", "</td>", '<td rowspan="2" colspan=3>', "<TH colspan=x>", "<th Header>", "<table>", "</table>", "<br>", " a  b ", "&amp;", "&lt;image 3&gt;", "&nbsp", "x > y", '<img src="a&amp;b">', "<td\nrowspan=2 >", '<td rowspan="1" rowspan="3">']
    odd = ["<br/>", "<!-- <td> -->", "<td rowspan='2'>", "< td>", "<", "<script>a<td></script>", "</td x>", "<td rowspan = 2>", "<?x>", "<title>a<td></title>", "<a/b>", "&#60;td>", "<td", "<td a=b/c>", "<td\x0crowspan=2>"]
    seen = lambda p: (p.rows, p.nested, p.invalid)

    def parsed(html):
        parser = T._Rows()
        parser.feed(html)
        parser.close()
        return parser

    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for pieces in (plain, plain + odd) for _ in range(3000)]
    for html in texts:
        assert seen(T._read(html)) == seen(parsed(html)), html
    monkeypatch.setattr(T._Rows, "feed", None)
    for html in texts[:3000]:
        T._read(html)


def test_terms_are_counted_a_bounded_number_at_a_time(spark, monkeypatch):
    """Parts of a batch add up to the whole; no part holds more terms than it should, but a row's."""
    monkeypatch.setattr(X, "TOGETHER", 6)
    rows = [[w for w in "abcde" for _ in range((d * 7 + ord(w)) % 3)] for d in range(40)] + [[], None, ["z"] * 20]
    units = spark.createDataFrame([(t,) for t in rows], "terms array<string>").coalesce(1)
    want = {w: (sum((t or []).count(w) for t in rows), sum(w in (t or []) for t in rows)) for w in "abcdez"}
    assert {r.term: (r.times, r.units) for r in X.frequencies(units).collect()} == want
    whole = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["terms"])
    parts = list(X._slices(whole, np.array([len(t or []) for t in rows]), 6))
    assert sum(p.num_rows for p in parts) == len(rows) and all(p.num_rows == 1 or len(p.column("terms").flatten()) <= 6 for p in parts)


def test_parts_of_texts_come_in_small_frames(spark, monkeypatch):
    """What a task gives back is never the parts of a whole batch."""
    seen, frame = [], C.pd.DataFrame
    monkeypatch.setattr(C, "TOGETHER", 7)
    documents = spark.createDataFrame([(i, f"text {i}" if i % 5 else None) for i in range(40)], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in C.chunks(documents, ["doc_id"], "text").collect()) == [i for i in range(40) if i % 5]
    own = type("Rows", (), {"select": lambda s, *c: s, "schema": documents.schema, "mapInPandas": lambda s, run, schema: list(run(iter([frame({"doc_id": range(40), "text": ["a b"] * 40})])))})()
    seen = C.chunks(own, ["doc_id"], "text")
    assert [len(f) for f in seen] == [7, 7, 7, 7, 7, 5]


def test_tokens_take_one_call_a_text(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "tokens_with_places", documents=([(1, "one two\n \nthree-four"), (2, None), (3, " \n"), (4, "a.b\nc")], DOCUMENTS))
    assert got == want
    assert "posexplode" not in QUERIES["tokens_with_places"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_all_names_meet_what_is_there_in_one_join(spark):
    row = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    found = document_errors(
        row("document_id string, page_id string, element_ids array<string>", ("d", "p0", ["e0", "x", None])), row("document_id string, element_id string, page_id string, section_id string", ("d", "e0", "p0", None), ("d", "s0", "p9", "e0")),
        row("document_id string, section_id string, heading_id string, parent_id string, page_ids array<string>, element_ids array<string>", ("d", "s0", "p0", None, ["e0"], ["s0"])), row("document_id string, relation_id string, source_id string, target_id string", ("d", "r", "p0", "no"), (None, "r", "p0", "s0")),
    )
    assert sorted(map(str, ((x.owner, x.id, x.error, x.missing) for x in found.collect()))) == sorted(map(str, [
        ("page", "p0", "missing_element", "x"), ("page", "p0", "missing_element", None), ("element", "s0", "missing_page", "p9"), ("element", "s0", "missing_section", "e0"), ("section", "s0", "missing_heading", "p0"),
        ("section", "s0", "missing_page", "e0"), ("relation", "r", "missing_target", "no"), ("relation", "r", "missing_source", "p0"), ("relation", "r", "missing_target", "s0")]))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_both_ends_of_relations_meet_the_elements_in_one_join(spark):
    schema = "document_id string, relation_id string, source_id string, target_id string, kind string, confidence double"
    relations = spark.createDataFrame([
        ("d", "r1", "e1", "e2", "k", 0.5), ("d", "r1", "e2", "e1", "k", 1.0), ("d", "r2", "e1", "e1", None, 1.5), ("d", "r3", "x", None, "k", float("nan")), ("c", "r1", "e1", "y", "k", None), (None, "r4", "e1", "e1", "k", 0.0),
    ], schema)
    elements = spark.createDataFrame([("d", "e1"), ("d", "e1"), ("d", "e2"), ("c", "y"), (None, "e1")], "document_id string, element_id string")
    found = referential_errors(relations, elements)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("d", "r1", "repeated_id"), ("d", "r2", "self_relation"), ("d", "r2", "confidence_range"), ("d", "r2", "no_kind"), ("d", "r3", "unknown_source"), ("d", "r3", "unknown_target"), ("d", "r3", "confidence_range"),
        ("c", "r1", "unknown_source"), ("c", "r1", "confidence_range"), (None, "r4", "unknown_source"), (None, "r4", "unknown_target"), (None, "r4", "self_relation"),
    ], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("Aggregate") == 1


def test_words_of_rules_end_as_in_sql(spark, tmp_path):
    """Numbers and accents beside the words of the rules: an accent ends a word."""
    odd = ["4880133118426010 Onére de", "4340220564568488 on the", "Teléthon ou", "directoría éroad", "la source\u000b: de", "It takesé long", "12 selectión", "énode fromé by", "Photo byé", "copyrightê 12"]
    documents = [(i, "\n".join(odd[(i + j) % len(odd)] + "." * ((i + j) % 5) for j in range(23))) for i in range(300)]
    got, want = against_sql(spark, tmp_path, "normalization_decisions", documents=(documents, DOCUMENTS))
    assert got == want and len(want) > 5000
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(SQL["normalization_coverage"])
    rows = QUERIES["normalization_coverage"](spark, str(tmp_path)).select(*(d[0] for d in cursor.description)).collect()
    assert sorted(map(tuple, rows)) == sorted(cursor.fetchall()) and len(rows) > 8
