"""Table grids against a plain grid, and what is wrong with tables."""

import random

from docloom.operators import tables as T


def made(r):
    """HTML of a random table, and its cells by a plain grid."""
    html, taken, cells = "<table>", set(), []
    for row in range(r.randint(1, 6)):
        html += "<tr>"
        for _ in range(r.randint(0, 4)):
            down, across, head = r.choice([1, 1, 2, 3]), r.choice([1, 1, 2, 3]), r.random() < 0.3
            text = r.choice(["a", " b  c ", "x&amp;y", "", "é"])
            c = next(c for c in range(200) if c >= start(cells, row) and not any((row, c + k) in taken for k in range(across)))
            cells.append((row, c, down, across, head, " ".join(text.replace("&amp;", "&").split())))
            taken |= {(row + i, c + j) for i in range(down) for j in range(across)}
            tag = "th" if head else "td"
            html += f"<{tag} rowspan={down} colspan='{across}'>{text}" + (f"</{tag}>" if r.random() < 0.8 else "")
        html += "</tr>" if r.random() < 0.8 else ""
    return html + "</table>", cells, taken


def start(cells, row):
    """The column after the last cell of the row."""
    own = [c + across for r, c, _, across, _, _ in cells if r == row]
    return own[-1] if own else 0


def test_grids_match_a_plain_grid(spark):
    r = random.Random(1)
    tables = {f"t{k}": made(r) for k in range(300)}
    views = T.views(spark.createDataFrame([(k, html, "x", 1) for k, (html, _, _) in tables.items()], "table_id string, html string, rows string, c int")).cache()
    got = {}
    for x in T.cells(views).collect():
        got.setdefault(x.table_id, []).append((x.cell, (x.r, x.c, x.rowspan, x.colspan, x.header, x.text)))
    places = {}
    for x in T.occupancy(T.cells(views)).collect():
        places.setdefault(x.table_id, []).append((x.row, x.col))
    checks = {x.table_id: x for x in T.checks(views).collect()}
    for k, (_, cells, taken) in tables.items():
        assert [x for _, x in sorted(got.get(k, []))] == cells
        assert sorted(places.get(k, [])) == sorted(taken) and checks[k].passed and checks[k].places == len(taken)
        rows, columns = max((a for a, _ in taken), default=-1) + 1, max((b for _, b in taken), default=-1) + 1
        assert checks[k].empty == rows * columns - len(taken)


def test_issues_and_categories(spark):
    cases = {
        "lost": None, "blank": "  ", "no rows": "<table></table>", "plain": "<table><tr><td>a</table>", "cell without a row": "<table><td>a</td></table>", "nested": "<table><tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d</table>",
        "spans": "<table><tr><td rowspan=0 colspan='x'>a<td rowspan=1001>b<td colspan=''>c</table>", "picture": '<table><tr><td><img src="a\\b.png"><img></table>', "placeholder": "<table><tr><td>&lt;Image 12&gt;</table>", "no table": "just text",
    }
    views = T.views(spark.createDataFrame(list(cases.items()), "table_id string, html string")).cache()
    assert {(x.table_id, x.issue, x.n) for x in T.issues(views).collect()} == {("lost", "no_html", 1), ("blank", "no_html", 1), ("no rows", "no_rows", 1), ("no table", "no_rows", 1), ("nested", "nested_table", 1), ("spans", "invalid_span", 4)}
    got = {x.table_id: x for x in views.collect()}
    assert {k: x.category for k, x in got.items() if x.category != "structured_text_only"} == {"lost": "no_html", "blank": "no_html", "picture": "internal_images", "placeholder": "unresolved_image_placeholder"}
    assert [c.text for c in got["nested"].rows] == ["ac", "d"] and got["picture"].rows[0].images == ["a/b.png"] and (got["spans"].row_count, got["spans"].column_count) == (1, 3)
    assert (got["lost"].row_count, got["lost"].rows) == (0, []) and got["cell without a row"].rows[0].text == "a"
    assert T.views(spark.createDataFrame([], "table_id string, html string")).count() == 0
    twice = T.cells(T.views(spark.createDataFrame([("t", "<table><tr><td>a</table>")] * 2, "table_id string, html string")))
    assert twice.count() == 2


def test_profiles_and_identity(spark):
    from pyspark.sql import functions as F

    from docloom.operators import relations as X

    cases = [("Table 5: x", "5"), ("see tab. IV", "iv"), ("5.2) The long Table: y", "5.2"), ("5 things", None), ("<b>Table</b> 7", "7"), (None, None), ("tables 3", None)]
    assert [r[0] for r in spark.createDataFrame([(c,) for c, _ in cases], "t string").select(X.table_title_label(F.col("t"))).collect()] == [n for _, n in cases]
    html = "<TABLE><TR class=a><th>Year</th><TD>Net cost</TD></TR><tr><td>Year<td>a 12</tr><tr><td>never</tr></TABLE>"
    got = spark.createDataFrame([(html,), (None,), ("<table></table>",)], "h string").select(X.table_columns(F.col("h")), F.array_sort(X.table_header_tokens(F.col("h")))).collect()
    assert [tuple(r) for r in got] == [(2, ["12", "cost", "net", "year"]), (None, []), (None, [])]
    schema = "document_id string, element_id string, page_index long, reading_order long, element_type string, text string, html string, x1 double, y1 double, x2 double, y2 double"
    page = lambda d, e, p, text: (d, e, p, 0, "table", text, html, 0.1, 0.1, 0.9, 0.9)
    rows = spark.createDataFrame([page("d", "a", 0, "Table 1"), page("d", "b", 1, "Table 2"), page("d", "c", 2, None), page("d", "e", 3, "Table 2"), page("z", "a", 0, None), page("z", "b", 1, None)], schema)
    pairs = lambda *c: sorted((r.document_id, r.source_id, r.target_id) for r in X.table_continuations(X.with_table_profiles(rows, *c)).collect())
    assert pairs() == [("d", "b", "c"), ("d", "c", "e"), ("z", "a", "b")]
    named = spark.createDataFrame([("d", "c", "Table 9 of it"), ("z", "a", "Figure 1"), ("d", "a", "Table 3")], "document_id string, target_id string, text string")
    assert pairs(named) == [("z", "a", "b")]
