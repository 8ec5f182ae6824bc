"""Tables in HTML, made of orders and their lines: cells, places, issues and checks of every table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import relations as X
from docloom.operators import tables as T
from docloom.plans.registry import query, read

#: Lines of orders in order. v (the part) says how a line's row is written: its first cell spans 1 to 3 rows, some second cells two columns.
_LINES = "select l_orderkey as k, cast(l_partkey as bigint) as v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as i, l_returnflag as f from lineitem"


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, html): a table for each order; of some the html is lost, some hold a table in a cell, a wrong span, or the placeholder of a picture."""
    lines = spark.sql(_LINES.replace("from lineitem", "from {l}"), l=read(spark, sf_dir, "lineitem"))
    v = F.col("v")
    first = F.concat(F.lit('<td rowspan="'), F.when(v % 11 == 0, "x").otherwise((v % 3 + 1).cast("string")), F.lit('">'), "f", F.when(v % 13 == 0, "<table><tr><td>in</td></tr></table>").otherwise(""), F.when(v % 17 == 0, " &lt;image 3&gt;").otherwise(""), F.lit("</td>"))
    second = F.concat(F.when(v % 4 == 0, '<td colspan="2">').otherwise("<td>"), F.lit("part  "), v.cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), first, second, F.when(v % 5 == 0, "<td>&amp;</td>").otherwise(""), F.lit("</tr>"))
    body = lines.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "").alias("body"), F.sum("v").alias("v"))
    html = F.when(F.col("v") % 19 == 0, F.lit(" ")).otherwise(F.concat(F.lit("<table><tr><th colspan=2>Flag</th><th>Part</th></tr>"), "body", F.lit("</table>")))
    return body.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("table_id"), html.alias("html"))


_TABLES = f"""l as ({_LINES}), t as (select k, 't' || k as table_id, sum(v) as s, count(*) as n, count(*) filter (v % 13 = 0) as nested, count(*) filter (v % 11 = 0) as invalid, count(*) filter (v % 17 = 0) as pictures,
        sum(2 + (v % 5 = 0)::int) + 2 as cells, sum(case when v % 11 = 0 then 1 else v % 3 + 1 end + case when v % 4 = 0 then 2 else 1 end + (v % 5 = 0)::int) + 3 as places from l group by k)"""


@query(f"with {_TABLES} select table_id, case when s % 19 = 0 then 0 else cells end::bigint as cells, case when s % 19 = 0 then 0 else places end::bigint as places, 0 as twice, true as passed from t")
def table_grid_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and the places they take up in every table, none of them twice."""
    return T.checks(T.views(order_tables(spark, sf_dir))).drop("empty")


@query(f"""with {_TABLES} select table_id, 'no_html' as issue, 1 as n from t where s % 19 = 0 union all select table_id, 'nested_table', nested from t where s % 19 > 0 and nested > 0 union all select table_id, 'invalid_span', invalid from t where s % 19 > 0 and invalid > 0""")
def table_view_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.issues(T.views(order_tables(spark, sf_dir)))


@query(f"with {_TABLES}, c as (select case when s % 19 = 0 then 'no_html' when pictures > 0 then 'unresolved_image_placeholder' else 'structured_text_only' end as category, * from t) select category, count(*) as tables, sum(case when s % 19 = 0 then 0 else cells end)::bigint as cells from c group by category")
def table_view_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.views(order_tables(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("tables"), F.sum(F.size("rows")).alias("cells"))


@query(f"""with {_TABLES}, h as (select table_id, l.* from l join t using (k) where s % 19 > 0) select table_id, i as r, 'first' as kind, 0 as c_min, case when v % 11 = 0 then 1 else v % 3 + 1 end as rowspan, f || case when v % 17 = 0 then ' <image 3>' else '' end as text from h
    union all select table_id, i, 'second', 1, 1, 'part ' || v from h union all select table_id, i, 'third', 2, 1, '&' from h where v % 5 = 0""")
def table_view_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every table's body, by their turn in their row; c_min is the least column they can stand in."""
    found = T.cells(T.views(order_tables(spark, sf_dir))).where("not header")
    turn = F.col("cell") - F.min("cell").over(Window.partitionBy("table_id", "r"))
    return found.withColumn("turn", turn).select("table_id", F.col("r").cast("long").alias("r"), F.element_at(F.array(*map(F.lit, ("first", "second", "third"))), (F.col("turn") + 1).cast("int")).alias("kind"), F.least("turn", "c").cast("int").alias("c_min"), F.col("rowspan").cast("long").alias("rowspan"), "text")


#: The orders of a customer as tables on pages that follow one another; o tells how many columns one has and whether it says its number.
_ORDER_PAGES = """select 'c' || o_custkey as document_id, 't' || o as element_id, row_number() over (partition by o_custkey order by o) - 1 as page_index, 0 as reading_order, 'table' as element_type,
    case o % 5 when 0 then 'Table ' || (o % 3 + 1) || ': lines' when 1 then (o % 3 + 1) || '. The big Table: lines' when 2 then 'continued' else 'lines' end as text,
    '<table><tr><th>Flag</th><th>' || p || '</th>' || case when o % 2 = 0 then '<th>Part</th>' else '' end || '</tr><tr><td>' || s || '</td><td>x1</td></tr></table>' as html, 1e-1 as x1, case when o % 4 = 0 then 5e-1 else 1e-1 end as y1, case when o % 7 = 0 then 5e-1 else 9e-1 end as x2, 95e-2 as y2
    from (select o_custkey, o_orderkey as o, o_orderpriority as p, o_orderstatus as s from {0}) as orders_"""
_WORDS = "list_distinct(list_transform(list_filter(regexp_extract_all('Flag ' || p || case when o % 2 = 0 then ' Part' else '' end || ' ' || s || ' x1', '[A-Za-z0-9]+'), lambda w: length(w) > 1), lambda w: lower(w)))"


@query(f"""with e as (select o_custkey as c, o_orderkey as o, o_orderpriority as p, o_orderstatus as s, row_number() over (partition by o_custkey order by o_orderkey) - 1 as page, case when o_orderkey % 5 < 2 then (o_orderkey % 3 + 1)::varchar end as label from orders), w as (select *, {_WORDS} as words from e),
    m as (select a.c, a.o as oa, b.o as ob, 0.2 + case when b.o % 4 > 0 then 0.1 else 0 end + case when (a.o % 7 = 0) = (b.o % 7 = 0) then 0.1 else 0 end + case when 2 * len(list_intersect(a.words, b.words)) >= len(list_distinct(list_concat(a.words, b.words))) then 0.2 else 0 end
        + case when b.o % 5 = 2 then 0.3 else 0 end + case when a.o % 2 = b.o % 2 then 0.1 else 0 end as score from w a join w b on a.c = b.c and b.page = a.page + 1 where a.label is null or b.label is null or a.label = b.label)
    select 'c' || c as document_id, 't' || oa as source_id, 't' || ob as target_id, round(least(0.9, score), 3)::double as score from m where round(least(0.9, score), 3) >= 0.5""")
def table_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on from page to page by their columns, header words and labels; of two numbers nothing goes on."""
    rows = spark.sql(_ORDER_PAGES.format("{o}"), o=read(spark, sf_dir, "orders"))
    return X.table_continuations(X.with_table_profiles(rows))
