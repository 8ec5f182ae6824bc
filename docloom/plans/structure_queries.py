"""Structure and relation queries: over the tables where they can show it, over literal tables else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import paragraphs as P
from docloom.lineage import cut_lineage
from docloom.operators import continuation as C
from docloom.operators import elements as E
from docloom.operators import relations as X
from docloom.operators import structure as S
from docloom.plans.derived import TABLES, cte, frame, rows
from docloom.plans.registry import query, read
from docloom.plans.retrieval_queries import SQL_ELEMENTS


@query(f"with {SQL_ELEMENTS} select * from (select doc_id, pos as source, lead(pos) over (partition by doc_id order by pos) as target from e) where target is not null")
def next_in_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.next_in_order(E.elements(read(spark, sf_dir, "documents")), "doc_id", "pos", "pos")


@query(f"""with {SQL_ELEMENTS} select distinct 'document_page' as kind, doc_id::varchar as source, doc_id || ':' || page_index as target from e
    union all select 'page_element', doc_id || ':' || page_index, doc_id || '#' || pos from e""")
def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.containment(E.elements(read(spark, sf_dir, "documents")))


@query(f"""with {SQL_ELEMENTS}, l as (select doc_id as doc, page_index as page, trim(lower(line)) as text from e), n as (select doc, count(distinct page) as pages from l group by doc),
    f as (select doc, text, count(distinct page) as on_pages, count(*) as times, min(page) as first_page from l group by all)
    select doc, text, on_pages, times, first_page, pages from f join n using (doc) where on_pages >= least(3, greatest(2, pages))""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.elements(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), F.col("page_index").alias("page"), F.trim(F.lower("line")).alias("text"))
    return S.repeated_lines(rows, ["text"])


@query(f"""with {SQL_ELEMENTS}, l as (select trim(lower(line)) as text, doc_id from e)
    select text, count(*) as times, count(distinct doc_id) as documents from l group by text having count(*) >= 3""")
def repeated_lines_across_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.elements(read(spark, sf_dir, "documents")).select(F.trim(F.lower("line")).alias("text"), "doc_id")
    per = rows.groupBy("text", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("text").agg(F.sum("n").alias("times"), F.count("*").alias("documents")).where("times >= 3")


@query(f"""with {SQL_ELEMENTS}, p as (select doc_id as doc, page_index, sum(length(line)) as chars, count(*) as items from e group by all)
    select doc, count(*) as pages, round(quantile_cont(chars, 0.5), 6) as median_chars, round(quantile_cont(items, 0.5), 6) as median_items, round(avg((chars <= 1600 and items <= 24)::int), 6) as sparse_ratio from p group by doc""")
def page_density_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.elements(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), F.col("page_index").alias("page"), F.length("line").alias("n_chars"))
    return S.density_profile(rows).select("doc", "pages", *(F.round(c, 6).alias(c) for c in ("median_chars", "median_items", "sparse_ratio")))


_BLOCKS = """b as (select page_id, pos, regexp_extract(block, '<([a-z0-9]+)>', 1) as tag, trim(regexp_replace(block, '<[^>]*>', '', 'g')) as text
    from (select page_id, unnest(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)>[^<]*')) as block, generate_subscripts(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)>[^<]*'), 1) - 1 as pos from pages))"""


@query(f"with {_BLOCKS} select page_id, pos, tag, text from b where tag like 'h_'")
def html_heading_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.html_blocks(read(spark, sf_dir, "pages")).where("tag like 'h_'")


@query(f"with {_BLOCKS} select page_id, pos, tag, last_value(case when tag like 'h_' then pos end ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and current row) as heading_pos from b")
def sections_last_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.current_heading(E.html_blocks(read(spark, sf_dir, "pages"))).drop("text")


@query(f"""with {cte('fx_headings')} select doc, pos, level, title, (select max(pos) from fx_headings p where p.doc = h.doc and p.pos < h.pos and p.level < h.level
    and not exists (select 1 from fx_headings m where m.doc = h.doc and m.pos > p.pos and m.pos < h.pos and m.level < h.level)) as parent_pos from fx_headings h""")
def heading_parents_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.parent_headings(frame(spark, sf_dir, "fx_headings"))


@query(f"with {cte('fx_headings')} select doc, string_agg(repeat('  ', (level - 1)::int) || '- ' || title, chr(10) order by pos) as outline from fx_headings group by doc")
def outline_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outline_lines(frame(spark, sf_dir, "fx_headings"))


_NUMBERED = f"{cte('fx_pages')}, n as (select document_id as doc, page_index, try_cast(label as bigint) as number from fx_pages)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "fx_pages").select(F.col("document_id").alias("doc"), "page_index", F.expr("try_cast(label as bigint)").alias("number"))


@query(f"""with {_NUMBERED}, k as (select *, lead(page_index) over w as np, lead(number) over w as nn from n where number is not null window w as (partition by doc order by page_index))
    select doc, p as page_index, number + p - page_index as number from k, range(1, 100) x(p) where p > page_index and p < np and np - page_index <= 12 and nn - number = np - page_index""")
def page_label_interpolation_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interpolate_labels(_pages(spark, sf_dir))


_RUNS = f"{_NUMBERED}, i as (select *, page_index - row_number() over (partition by doc order by page_index) as island, number - page_index as o from n where number is not null), r as (select doc, island, o as \"offset\", min(page_index) as first_page, max(page_index) as last_page, min(number) as first_number, count(*) as length from i group by all having count(*) >= 3)"


@query(f"with {_RUNS} select * from r")
def page_label_runs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_runs(_pages(spark, sf_dir))


@query(f"""with {_RUNS}, s as (select doc, first_page, first_number, coalesce((select max(page_index) from n where n.doc = r.doc and number is not null and page_index < first_page), -1) as q from r)
    select doc, p as page_index, first_number - first_page + p as number from s, range(0, 100) x(p) where p >= greatest(q + 1, first_page - first_number + 1) and p < first_page""")
def page_label_backward_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extrapolate_backward(_pages(spark, sf_dir), S.label_runs(_pages(spark, sf_dir)))


# Pairs of elements of a page (p), or of a page and the next (n), with the geometry that the rules ask for.
_GEOMETRY = """greatest(0, b.x1 - a.x2, a.x1 - b.x2) as hg, greatest(0, b.y1 - a.y2, a.y1 - b.y2) as vg, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) as ho, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as vo,
    a.x2 - a.x1 as aw, b.x2 - b.x1 as bw, a.y2 - a.y1 as ah, b.y2 - b.y1 as bh"""
_PAIRS = f"{cte('fx_elements')}, p as (select a.document_id, a.page_index, {{columns}}, {_GEOMETRY} from fx_elements a join fx_elements b on a.document_id = b.document_id and a.page_index = b.page_index and a.element_id <> b.element_id)"
_ENDS = ", ".join(f"{t}.{c} as {t}_{c}" for t in "ab" for c in ("element_id", "reading_order", "element_type", "text", "x1", "y1", "x2", "y2", "section_id"))
_ON_PAGE = _PAIRS.format(columns=_ENDS)
_NEXT = f"{cte('fx_elements')}, n as (select a.document_id, a.page_index, b.page_index - a.page_index as far, {_ENDS}, {_GEOMETRY} from fx_elements a join fx_elements b on a.document_id = b.document_id and b.page_index between a.page_index + 1 and a.page_index + 2)"


@query(f"""with {_ON_PAGE} select document_id, a_element_id, b_element_id, round(sqrt(hg * hg + vg * vg), 6) as distance, sqrt(hg * hg + vg * vg) <= 0.1 as nearby, b_y2 <= a_y1 as above, b_y1 >= a_y2 as below, ho / least(aw, bw) >= 0.5 as same_column, ho * vo > 0 as overlapping from p""")
def spatial_neighbours_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.neighbours(frame(spark, sf_dir, "fx_elements")).withColumn("distance", F.round("distance", 6))


@query(f"""with {cte('fx_elements')}, c as (select *, case when regexp_matches(lower(text), '^(table|tab)') then 'table' else 'figure' end as kind from fx_elements where element_type = 'caption'),
    t as (select *, case when element_type = 'table' then 'table' else 'figure' end as kind from fx_elements where element_type in ('table', 'figure', 'chart')),
    m as (select c.document_id, c.element_id as caption_id, t.element_id as target_id, t.page_index = c.page_index as same, row_number() over (partition by c.document_id, c.element_id order by t.page_index <> c.page_index, t.reading_order > c.reading_order, abs(t.reading_order - c.reading_order), t.element_id) as r
        from c join t on c.document_id = t.document_id and c.kind = t.kind and abs(c.page_index - t.page_index) <= 1)
    select document_id, caption_id, target_id, case when same then 0.95 else 0.78 end::double as confidence from m where r = 1""")
def caption_targets_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "fx_elements")
    return X.nearest_target(rows.where("element_type = 'caption'"), rows.where("element_type in ('table', 'figure', 'chart')"))


_MARKERS = f"""{cte('fx_elements')}, m as (select document_id, element_id as footnote_id, page_index, reading_order as o, regexp_extract(text, '^\\s*(\\*+|[0-9]{{1,2}}|[a-z]\\))', 1) as marker from fx_elements where element_type = 'footnote'),
    t as (select m.document_id, footnote_id, marker, arg_max(e.element_id, e.reading_order) as target_id from m join fx_elements e on e.document_id = m.document_id and e.page_index = m.page_index and e.reading_order < o and contains(e.text, marker) where marker <> '' and e.element_type <> 'footnote' group by all)"""


@query(f"with {_MARKERS} select * from t")
def footnote_targets_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.marker_targets(frame(spark, sf_dir, "fx_elements"))


@query(f"""with {_MARKERS}, j as (select t.*, f.page_index = e.page_index as same_page, greatest(0, f.y1 - e.y2, e.y1 - f.y2) as gap, abs(f.reading_order - e.reading_order) as reading, f.y1
        from t join fx_elements f on f.document_id = t.document_id and f.element_id = footnote_id join fx_elements e on e.document_id = t.document_id and e.element_id = target_id),
    s as (select *, least(0.98, 0.45 + case when same_page then 0.15 else 0 end + case when gap <= 0.08 then 0.15 when gap <= 0.18 then 0.08 else 0 end + case when reading <= 2 then 0.10 when reading <= 5 then 0.05 else 0 end + 0.10 + case when y1 >= 0.70 then 0.05 else 0 end) as score from j)
    select document_id, footnote_id, target_id, round(score, 6)::double as score, score >= 0.75 as confirmed from s""")
def footnote_scores_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes with the target that their marker names, scored by all signals."""
    rows = frame(spark, sf_dir, "fx_elements")
    return X.scored_footnotes(rows, X.marker_targets(rows))


@query(f"""with {cte('fx_elements')}, {cte('fx_labels')}, k(kind, pattern) as (values ('figure', '(?i)\\b(?:figure|fig\\.?)\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?|[IVX]+)\\b'), ('table', '(?i)\\b(?:table|tab\\.)\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?|[IVX]+)\\b'), ('section', '(?i)\\b(?:section|sec\\.)\\s*([0-9]+(?:\\.[0-9]+)*)\\b')),
    m as (select distinct document_id, element_id as source_id, kind, page_index, section_id, unnest(regexp_extract_all(text, pattern, 1)) as number from fx_elements, k where element_type = 'paragraph')
    select document_id, source_id, kind, number, (list(target_id order by (m.section_id <> l.section_id)::int, priority desc, abs(m.page_index - l.page_index), target_id))[1] as target_id, count(target_id) as candidates from m left join fx_labels l using (document_id, kind, number) group by all""")
def reference_resolution_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.resolve_references(X.mentions(frame(spark, sf_dir, "fx_elements")), frame(spark, sf_dir, "fx_labels"))


_WORDS = "list_distinct(string_split_regex(lower({c}), '\\s+'))"
_SHARED = f"len(list_intersect({_WORDS.format(c='a_text')}, {_WORDS.format(c='b_text')})) / len(list_distinct(list_concat({_WORDS.format(c='a_text')}, {_WORDS.format(c='b_text')})))"
_ALIKE = "abs(aw - bw) <= 0.1 and abs(a_x1 + a_x2 - b_x1 - b_x2) <= 0.2"
_BOUNDARY = "edge as (select *, row_number() over (partition by document_id, page_index, element_type order by reading_order) as up, row_number() over (partition by document_id, page_index, element_type order by reading_order desc) as down from fx_elements)"
_AT_EDGE = "(document_id, a_element_id) in (select (document_id, element_id) from edge where down = 1) and (document_id, b_element_id) in (select (document_id, element_id) from edge where up = 1) and far = 1"


@query(f"""with {_NEXT}, {_BOUNDARY}, s as (select document_id, a_element_id as source_id, b_element_id as target_id, round(least(0.9, 0.2 + case when a_y2 >= 0.68 and b_y1 <= 0.25 then 0.1 else 0 end + case when {_ALIKE} then 0.1 else 0 end
        + case when {_SHARED} >= 0.5 then 0.2 else 0 end + case when regexp_matches(b_text, '(?i)continued|续') then 0.3 else 0 end + case when len(string_split_regex(trim(a_text), '\\s+')) = len(string_split_regex(trim(b_text), '\\s+')) then 0.1 else 0 end), 3)::double as score
        from n where a_element_type = 'table' and b_element_type = 'table' and {_AT_EDGE}) select * from s where score >= 0.5""")
def table_continuation_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table_continuations(frame(spark, sf_dir, "fx_elements"))


@query(f"""with {_NEXT}, {_BOUNDARY}, s as (select document_id, a_element_id as source_id, b_element_id as target_id, round(least(0.9, 0.10 + case when a_y2 >= 0.72 and b_y1 <= 0.30 then 0.25 else 0 end + case when a_section_id = b_section_id then 0.15 else 0 end
        + case when regexp_matches(a_text, '[,;:]\\s*$') then 0.20 else 0 end + case when regexp_matches(b_text, '^\\s*\\p{{Ll}}') then 0.15 else 0 end
        + case when regexp_matches(a_text, '(?i)^\\s*(?:\\[[0-9]+\\]|[0-9]+\\.\\s).*\\b(?:19|20)[0-9]{{2}}\\b') and regexp_matches(b_text, '(?i)^\\s*(?:\\[[0-9]+\\]|[0-9]+\\.\\s).*\\b(?:19|20)[0-9]{{2}}\\b') then 0.15 else 0 end), 3)::double as score
        from n where a_element_type = 'list' and b_element_type = 'list' and {_AT_EDGE}) select * from s where score >= 0.65""")
def list_continuation_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_continuations(frame(spark, sf_dir, "fx_elements"))


@query(f"""with {_NEXT}, {_BOUNDARY}, s as (select document_id, a_element_id as source_id, b_element_id as target_id, round(least(0.9, 0.25 + case when a_y2 >= 0.80 then 0.15 else 0 end + case when b_y1 <= 0.25 then 0.15 else 0 end + case when a_section_id = b_section_id then 0.05 else 0 end
        + case when abs(aw - bw) <= 0.1 and abs(a_x1 - b_x1) <= 0.1 then 0.15 else 0 end + case when not regexp_matches(a_text, '(?:[}};]|\\bend\\b|\\breturn\\b[^\\n]*)\\s*$') then 0.10 else 0 end + case when contains(lower(b_text), 'continued') then 0.15 else 0 end
        - case when regexp_matches(b_text, '^\\s*(?:def|class|function|public|private|import|from|#include|package)\\b') then 0.10 else 0 end), 3)::double as score
        from n where a_element_type = 'code' and b_element_type = 'code' and {_AT_EDGE}) select * from s where score >= 0.60""")
def code_continuation_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.code_continuations(frame(spark, sf_dir, "fx_elements"))


_RX_SQL = lambda c, p: f"regexp_matches({c}, '{p}')"
_PAIR_SQL = ["document_id", "page_index", "far", *(f"{t}_{c}" for t in "ab" for c in ("element_id", "reading_order", "element_type", "text", "x1", "y1", "x2", "y2", "section_id"))]


@query(f"""with {_NEXT}, bridge as (select document_id, page_index from fx_elements group by all having count(*) filter (element_type in ('figure', 'chart', 'table')) > 0 and count(*) filter (element_type in ('heading', 'list', 'code') or element_type = 'paragraph' and length(text) >= 25) = 0),
    w as (select n.*, exists (select 1 from bridge g where g.document_id = n.document_id and g.page_index = n.page_index + 1) as bridged,
        exists (select 1 from fx_elements h where h.document_id = n.document_id and h.page_index = n.page_index + n.far and h.element_type = 'heading' and h.reading_order < b_reading_order) as headed,
        {P.layout()} as layout, {P.hyphen(_RX_SQL)} as hyphen, {P.seam(_RX_SQL)} as seam from n where a_element_type = 'paragraph' and b_element_type = 'paragraph'),
    s as (select *, round(least(0.9, {P.score("ho / least(aw, bw)", _RX_SQL)}), 3)::double as score from w where {P.gates(_RX_SQL)}),
    r as (select *, row_number() over (partition by document_id, page_index, far order by score desc, a_reading_order desc, b_reading_order, a_element_id, b_element_id) as k from s where score >= 0.55)
    select document_id, page_index, page_index + far as target_page, a_element_id as source_id, b_element_id as target_id, score from r where k = 1""")
def paragraph_continuation_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.paragraph_continuations(frame(spark, sf_dir, "fx_elements"))


@query(f"with {cte('fx_relations')} select * exclude (r) from (select *, row_number() over (partition by document_id, relation_id order by origin desc) as r from fx_relations) where r = 1")
def relation_union_later_wins_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.later_wins(frame(spark, sf_dir, "fx_relations"))


@query(f"""with {cte('fx_relations')}, {cte('fx_elements')}, x as (select document_id, element_id from fx_elements) select document_id, relation_id, 'unknown_source' as error from fx_relations where (document_id, source_id) not in (select (document_id, element_id) from x)
    union all select document_id, relation_id, 'unknown_target' from fx_relations where (document_id, target_id) not in (select (document_id, element_id) from x) union all select document_id, relation_id, 'self_relation' from fx_relations where source_id = target_id
    union all select document_id, relation_id, 'repeated_id' from fx_relations group by all having count(*) > 1 union all select document_id, relation_id, 'confidence_range' from fx_relations where confidence not between 0 and 1""")
def referential_validation_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    # several parts read the relations: they are written once; of the elements only the ids count
    return X.referential_errors(cut_lineage(frame(spark, sf_dir, "fx_relations")), rows(spark, sf_dir, TABLES["fx_elements"]).select("document_id", "element_id"))


_REACH = "with recursive {cte}, f as (select * from fx_relations where kind = 'continues' and confidence >= 0.6), reach as (select document_id, source_id, target_id, 1 as hops from f union select r.document_id, r.source_id, f.target_id, r.hops + 1 from reach r join f on f.document_id = r.document_id and f.source_id = r.target_id where r.hops <= (select count(*) from f)) select document_id, source_id, target_id, min(hops) as hops from reach group by all"


@query(_REACH.format(cte=cte("fx_relations")))
def continuation_closure_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a continuation reaches, over any number of edges."""
    return X.continuation_closure(frame(spark, sf_dir, "fx_relations"))


@query(f"""with {cte('fx_cells')} select table_id, r + i as row, c + j as col, count(*) as anchors, min(text) as text from fx_cells, range(0, 10) a(i), range(0, 10) b(j) where i < rowspan and j < colspan group by all""")
def table_occupancy_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid that anchors with spans cover; a place with two anchors is an overlap."""
    cells = frame(spark, sf_dir, "fx_cells").select("table_id", "text", F.explode(F.sequence("r", F.col("r") + F.col("rowspan") - 1)).alias("row"), "c", "colspan")
    return cells.select("table_id", "text", "row", F.explode(F.sequence("c", F.col("c") + F.col("colspan") - 1)).alias("col")).groupBy("table_id", "row", "col").agg(F.count("*").alias("anchors"), F.min("text").alias("text"))


@query(f"with {SQL_ELEMENTS}, p as (select distinct doc_id, page_index from e) select a.doc_id, a.page_index, b.page_index as near from p a join p b on a.doc_id = b.doc_id and abs(a.page_index - b.page_index) <= 1")
def adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within one of each other: each offers itself to its neighbours, so the join is by equality."""
    pages = E.elements(read(spark, sf_dir, "documents")).select("doc_id", "page_index").distinct()
    offered = pages.select("doc_id", F.explode(F.sequence(F.col("page_index") - 1, F.col("page_index") + 1)).alias("near"), "page_index")
    return offered.join(pages.withColumnRenamed("page_index", "near"), ["doc_id", "near"]).select("doc_id", "page_index", "near")


@query(f"with {SQL_ELEMENTS}, w as (select doc_id, pos, lag(line) over o as before, line, lead(line) over o as after from e window o as (partition by doc_id, page_index order by pos)) select doc_id, pos, length(before) as n_before, length(line) as n_line, length(after) as n_after from w")
def siblings_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id", "page_index").orderBy("pos")
    rows = E.elements(read(spark, sf_dir, "documents")).withColumn("n", F.length("line").cast("long"))
    return rows.select("doc_id", "pos", F.lag("n").over(order).alias("n_before"), F.col("n").alias("n_line"), F.lead("n").over(order).alias("n_after"))
