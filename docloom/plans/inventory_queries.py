"""Inventories and summaries, over literal tables and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import inventory as I
from docloom.operators.elements import elements, html_blocks
from docloom.plans.derived import cte, frame, select, sub
from docloom.plans.registry import query, read
from docloom.plans.retrieval_queries import SQL_ELEMENTS
from docloom.plans.structure_queries import _BLOCKS


@query(f"with {_BLOCKS}, h as (select page_id::varchar as document_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from b where tag <> 'p'), o as (select document_id, t, count(*) as n from h where t <> '' and len(string_split(t, ' ')) <= 4 group by all having count(*) >= 3) select document_id, count(*) as headings, max(n) as most from o group by document_id")
def repeated_short_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and items of each web page that it says three times."""
    rows = html_blocks(read(spark, sf_dir, "pages")).where("tag <> 'p'").select(F.col("page_id").cast("string").alias("document_id"), F.lit(0).alias("page_index"), "text")
    return I.repeated_short_headings(rows)


@query(f"with {cte('fx_elements')}, p as (select document_id, page_index, string_agg(left(element_type, 2), '' order by reading_order) as signature from fx_elements group by all), e as (select document_id, signature, count(*) as n from p group by all), k as (select *, row_number() over (partition by document_id order by n desc, signature) as k, sum(n) over (partition by document_id) as s from e) select document_id, n / s as ratio, signature from k where k = 1")
def page_patterns_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.page_patterns(frame(spark, sf_dir, "fx_elements"))


_STYLED = sub("styled", "v")
_STYLE = "concat_ws('/', coalesce(lower(font), '?'), coalesce((round(size * 2) / 2)::double::varchar, '?'), case when bold then 'b' end, case when upper_ then 'u' end)"


@query(f"with v as (select *, {_STYLE} as style from {_STYLED}) select document_id, style, count(*) as n, count(distinct page_index) as pages, quantile_cont(prominence::double, 0.5) as prominence, case when min(level) = max(level) then min(level) end as anchor from v group by all")
def style_profiles_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select(spark, sf_dir, "select * from @styled@")
    return I.style_profiles(rows.withColumn("style", I.style_key(F.col("font"), F.col("size").cast("double"), F.col("bold"), F.col("upper_"))).withColumn("prominence", F.col("prominence").cast("double")))


@query(f"with {cte('fx_elements')}, k as (select *, row_number() over (partition by document_id order by page_index, reading_order) as k from fx_elements where regexp_matches(text, '(?i)^(?:figure|see)\\b')) select document_id, page_index, reading_order from k where k = 1")
def first_positions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_positions(frame(spark, sf_dir, "fx_elements"), r"(?i)^(?:figure|see)\b")


_HEADED = sub("headed", "v")


@query(f"""with k as (select *, y2 - y1 >= 0.1 as cover, row_number() over (partition by document_id order by y2 - y1 desc, prominence desc, reading_order) as k from {_HEADED} where page_index = 0),
    r as (select *, case when reading_order > 1 and not cover then 'late' when regexp_matches(text, '^\\s*[0-9]+(?:\\.[0-9]+)*\\.?\\s') then 'numbered' when lower(trim(text)) in ('abstract', 'introduction', 'contents', 'references', 'summary') then 'section_name' when y1 > 0.20 and not cover then 'low' end as rejected from k where k = 1)
    select document_id, element_id, case when rejected is null then text end as title, rejected from r""")
def document_titles_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.document_titles(select(spark, sf_dir, "select * from @headed@"))


@query("with e as (select source as document_id, trim(lang) as name, count(*) as n from documents group by all), k as (select *, row_number() over (partition by document_id order by n desc, name) as k from e where name <> '') select document_id, name, n from k where k = 1 and n >= 2")
def entity_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that each group says most: the language of each source."""
    return I.entity_titles(read(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("name")))


_SEEN = sub("seen", "v")


@query(f"with k as (select *, row_number() over (partition by document_id, page_index order by confidence desc, least(y, 1 - y), label) as k from {_SEEN}) select document_id, page_index, label, confidence::double as confidence, y::double as y from k where k = 1")
def best_observations_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.best_observations(select(spark, sf_dir, "select document_id, page_index, label, double(confidence) as confidence, double(y) as y from @seen@"))


_TOP = "select set_id, item, value from (select user_id as set_id, event_id::varchar as item, value, row_number() over (partition by user_id order by value {d}, event_id::varchar) as k from events where value is not null) where k <= {k}"


@query("select 'COUNT' as operator, user_id as set_id, null::varchar as item, count(*) filter (value > 0)::double as value from events group by all union all select 'ARGMAX', * from (" + _TOP.format(d="desc", k=1) + ") union all select 'ARGMIN', * from (" + _TOP.format(d="asc", k=1) + ") union all select 'TOP_K', * from (" + _TOP.format(d="desc", k=3) + ") union all select 'COLLECT_ALL', user_id, event_id::varchar, value from events where value > 0 union all select 'COMPLEMENT', user_id, event_id::varchar, value from events where not coalesce(value > 0, false)")
def coverage_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coverage operator over the events of each user."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("set_id"), F.col("event_id").cast("string").alias("item"), "value")
    parts = [I.coverage(rows, o).select(F.lit(o).alias("operator"), "set_id", "item", "value") for o in ("COUNT", "ARGMAX", "ARGMIN", "TOP_K", "COLLECT_ALL", "COMPLEMENT")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_GROUPS = sub("groups", "v")


@query(f"with {cte('fx_elements')} select e.document_id, coalesce(group_id, e.element_id) as item, min(page_index) as first_page, count(*) as fragments from fx_elements e left join {_GROUPS} on v.document_id = e.document_id and v.element_id = e.element_id where element_type in ('table', 'chart') group by all")
def coverage_items_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.coverage_items(frame(spark, sf_dir, "fx_elements"), ("table", "chart"), select(spark, sf_dir, "select * from @groups@"))


@query("select * from (select conv_id as document_id, role as group_id, turn::varchar as source_id, lead(turn::varchar) over (partition by conv_id, role order by turn) as target_id from conversations) where target_id is not null")
def fragment_edges_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speaker's turns as fragments of a group."""
    return I.fragment_edges(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("role").alias("group_id"), F.col("turn").alias("fragment_index"), F.col("turn").cast("string").alias("element_id")))


_ASSETS = sub("assets", "v")
_VISUALS = sub("visuals", "v")


@query(f"""with a as (select * from {_ASSETS}), b as (select * from {_VISUALS}), m as (select document_id, element_id, case when b.page_index is null then 'gone' when a.page_index is null then 'not_indexed' when a.sha256 is distinct from b.sha256 then 'other_content' when a.page_index <> b.page_index then 'other_page' end as drift from a full join b using (document_id, element_id)) select * from m where drift is not null""")
def asset_drift_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.asset_drift(select(spark, sf_dir, "select * from @assets@"), select(spark, sf_dir, "select * from @visuals@"))


_CAPTIONS = f"{cte('fx_relations')}, {cte('fx_elements')}, c as (select r.document_id, r.target_id, text, min((page_index, reading_order)) as o from fx_relations r join fx_elements e on e.document_id = r.document_id and e.element_id = r.source_id where kind = 'caption_of' and confidence >= 0.75 group by r.document_id, r.target_id, text), cap as (select document_id, target_id, string_agg(text, ' | ' order by o) as captions from c group by all)"


@query(f"with {_CAPTIONS} select * from cap")
def captions_of_targets_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.captions_of(frame(spark, sf_dir, "fx_relations"), frame(spark, sf_dir, "fx_elements"))


@query(f"with {_CAPTIONS}, x as (select e.document_id, e.element_id, element_type, captions, trim(coalesce(text, '')) as t from fx_elements e left join cap on cap.document_id = e.document_id and cap.target_id = e.element_id where element_type in ('figure', 'table')) select document_id, element_id, coalesce(nullif(array_to_string(list_filter([coalesce(captions, ''), t], lambda v: v <> ''), ' | '), ''), 'A ' || element_type || ' without text.') as preview from x")
def visual_previews_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = frame(spark, sf_dir, "fx_elements").where("element_type in ('figure', 'table')").withColumn("label", none).withColumn("descriptor", none)
    return I.preview_text(rows, I.captions_of(frame(spark, sf_dir, "fx_relations"), frame(spark, sf_dir, "fx_elements")))


_STARTS = sub("starts", "v")


@query(f"with {cte('fx_relations')} select distinct v.document_id, v.element_id, v.kind, case when source_id = v.element_id then 'out' else 'in' end as direction, case when source_id = v.element_id then target_id else source_id end as other_id from {_STARTS} join fx_relations r on r.document_id = v.document_id and r.kind = v.kind and v.element_id in (source_id, target_id)")
def followed_relations_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.follow(frame(spark, sf_dir, "fx_relations"), select(spark, sf_dir, "select * from @starts@"))


_CHAIN = sub("chain", "v")
_ANCHORS = sub("anchors", "v")


@query(f"""with recursive b as (select document_id, source_id as x, target_id as y from {_CHAIN} where confidence >= 0.7 union select document_id, target_id, source_id from {_CHAIN} where confidence >= 0.7), r as (select * from {_ANCHORS} union select b.document_id, b.y, r.section_id from r join b on b.document_id = r.document_id and b.x = r.element_id)
    select document_id, element_id, min(section_id) as section_id from r group by all having count(distinct section_id) = 1""")
def listing_chains_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.listing_chains(select(spark, sf_dir, "select * from @chain@"), select(spark, sf_dir, "select * from @anchors@"))


_PDF = sub("printed", "v")


@query(f"""with {cte('fx_elements')}, l as (select * from {_PDF}) select document_id, page_index, line_id, text from l where trim(text) <> '' and not exists (select 1 from fx_elements e where e.document_id = l.document_id and e.page_index = l.page_index and (contains(regexp_replace(lower(coalesce(e.text, '')), '\\s+', '', 'g'), regexp_replace(lower(l.text), '\\s+', '', 'g'))
    or e.element_type in ('figure', 'chart', 'table') and greatest(0, least(l.x2, e.x2) - greatest(l.x1, e.x1)) * greatest(0, least(l.y2, e.y2) - greatest(l.y1, e.y1)) >= 0.4 * (l.x2 - l.x1) * (l.y2 - l.y1)))""")
def uncovered_lines_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.uncovered_lines(select(spark, sf_dir, "select * from @printed@"), frame(spark, sf_dir, "fx_elements"))


_QUESTIONS = sub("asked_pages", "v")
_DOCUMENTS = sub("page_counts", "v")


@query(f"""with q as (select question_id, document_id, list_transform(list_filter(string_split(pages, ','), lambda x: x <> ''), lambda x: x::int) as pages from {_QUESTIONS}), d as (select * from {_DOCUMENTS}), m as (select q.*, n_pages from q left join d using (document_id))
    select question_id, 'unknown_document' as issue from m where n_pages is null union all select question_id, 'page_out_of_range' from m where len(list_filter(pages, lambda p: p < 1 or p > n_pages)) > 0 union all select question_id, 'repeated_id' from q group by question_id having count(*) > 1 union all select document_id, 'document_without_questions' from d where document_id not in (select document_id from q)""")
def dataset_issues_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dataset_issues(select(spark, sf_dir, "select question_id, document_id, transform(filter(split(pages, ','), x -> x <> ''), x -> int(x)) as pages from @asked_pages@"), select(spark, sf_dir, "select * from @page_counts@"))


_FILES = sub("files", "v")
_INDEX = f"x as (select distinct regexp_extract(path, '^(.*)/[^/]+$', 1) as directory from {_FILES} where regexp_matches(path, '/document\\.json$')), i as (select lower(regexp_extract(directory, '([^/]*)$', 1)) as key, min(directory) as directory from x group by 1 having count(*) = 1)"


@query(f"with {_INDEX} select * from i")
def directory_index_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.directory_index(select(spark, sf_dir, "select * from @files@"))


_GOLD = sub("gold", "v")


@query(f"with {_INDEX} select document_id || '-' || question_id as case_id, question_id, document_id, question, directory from {_GOLD} join i on i.key = document_id")
def gold_free_cases_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gold_free(select(spark, sf_dir, "select * from @gold@"), I.directory_index(select(spark, sf_dir, "select * from @files@")))


_STORE = sub("store", "v")


@query(f"""with s as (select *, case when coalesce(asset, '') = '' then 'no_asset' when sha256 is null then 'unreadable_asset' when duplicate then 'duplicate_of_another' when not regexp_matches(lower(asset), '\\.(?:png|jpe?g|webp)$') then 'unsupported_format' end as skipped from {_STORE} where element_type in ('figure', 'chart', 'table'))
    select document_id, element_id, sha256, skipped, case when skipped is null then count(*) filter (skipped is null) over (partition by sha256) end as mappings from s""")
def visual_inventory_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.visual_inventory(select(spark, sf_dir, "select * from @store@"))


@query(f"with {cte('fx_relations')}, {cte('fx_elements')} select r.document_id, relation_id, kind, a.page_index as source_page, b.page_index as target_page from fx_relations r join fx_elements a on a.document_id = r.document_id and a.element_id = source_id join fx_elements b on b.document_id = r.document_id and b.element_id = target_id where a.page_index <> b.page_index")
def cross_page_relations_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cross_page_relations(frame(spark, sf_dir, "fx_relations"), frame(spark, sf_dir, "fx_elements"))


@query("""with x as (select o_orderpriority, 'price' as metric, o_totalprice as v from orders union all select o_orderpriority, 'custkey', o_custkey from orders)
    select o_orderpriority, metric, count(*) as n, round(avg(v), 4) as mean, round(quantile_cont(v, 0.5), 4) as median, round(quantile_cont(v, 0.9), 4) as p90, round(sum(v), 2) as total from x where v is not null group by all""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("custkey"))
    out = I.metric_summary(rows, "o_orderpriority", ["price", "custkey"])
    return out.select("o_orderpriority", "metric", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "p90")), F.round("total", 2).alias("total"))


_CALLS = sub("decisions", "v")


@query(f"""with c as (select * from {_CALLS}), l as (select *, row_number() over (partition by model, session, step order by attempt desc) as k from c), m as (select *, action = gold_action as route, action = gold_action and target is not distinct from gold_target as exact, coalesce(action = lag(action) over w and target is not distinct from lag(target) over w, false) as again from l where k = 1 window w as (partition by model, session order by step)),
    f as (select model, round(avg(coalesce(valid, false)::int), 6) as first_valid from c where attempt = 1 group by model) select m.model, count(*) as steps, round(avg(exact::int), 6) as exact, round(avg(route::int), 6) as route, count(*) filter (again) as repeats, any_value(first_valid) as first_valid from m join f using (model) group by m.model""")
def policy_comparison_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.policy_comparison(select(spark, sf_dir, "select * from @decisions@"))


_BARE = sub("bare", "v")
_MADE = sub("made", "v")


@query(f"""with a as (select * from {_BARE}), b as (select * from {_MADE}), m as (select a.document_id, a.page_index, block_index, html, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as s from a join b on a.document_id = b.document_id and a.page_index = b.page_index)
    select document_id, page_index, block_index, min(html) as html from m where i / (s - i) >= 0.95 group by all having count(*) = 1""")
def recovered_table_html_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlapping_html(select(spark, sf_dir, "select * from @bare@"), select(spark, sf_dir, "select * from @made@"))


_CELLS_AT = sub("cells_asked", "v")


@query(f"with {cte('fx_cells')}, m as (select v.table_id, v.row, v.col, text, r, c, row_number() over (partition by v.table_id, v.row, v.col order by r, c, text) as k from {_CELLS_AT} left join fx_cells x on x.table_id = v.table_id and v.row between r and r + rowspan - 1 and v.col between c and c + colspan - 1) select table_id, row, col, text, r, c from m where k = 1")
def cells_at_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cells_at(frame(spark, sf_dir, "fx_cells"), select(spark, sf_dir, "select table_id, bigint(row) as row, bigint(col) as col from @cells_asked@"))


@query(f"with {SQL_ELEMENTS}, x as (select doc_id, pos, line from e) select doc_id, pos, length(line) < 60 and regexp_matches(line, '^\\s*[A-Z].*[.!?]\\s*$') as short_independent, regexp_matches(line, '^\\s*(?:[☐☑✓□]|\\[[ xX]\\])') as checklist, regexp_matches(line, '(?i)\\b(?:act|code|statute|regulation|u\\.s\\.c|cfr)\\b[^.]{{0,60}}\\bsection\\s+[0-9]') as external_reference, regexp_matches(trim(line), '(?i)^(?:yes|no|n/a|[-–—•.]+|[0-9]{{1,3}})$') as low_information, regexp_matches(line, '[A-Za-zÀ-ÿ]{{2,}}|[0-9]{{2,}}') as meaningful from x")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions import text as T

    line = F.col("line")
    return elements(read(spark, sf_dir, "documents")).select("doc_id", "pos", *(f(line).alias(k) for k, f in (("short_independent", T.short_independent), ("checklist", T.checklist_item), ("external_reference", T.external_reference), ("low_information", T.low_information), ("meaningful", T.meaningful))))
