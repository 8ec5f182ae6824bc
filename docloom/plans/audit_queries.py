"""Sections, audits and session-state queries over literal tables and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import chunking as C
from docloom.operators import audit as A
from docloom.operators import sections as S
from docloom.operators.elements import elements, html_blocks
from docloom.plans.derived import cte, frame, select, sub
from docloom.plans.registry import query, read


@query(f"""with {cte('fx_references')}, v as (select *, round(case when side = 'before' then case when pages <= 2 then confidence - 0.05 * pages end else case when pages <= 1 then confidence - 0.10 - 0.05 * pages end end, 6) as strength from fx_references),
    b as (select document_id, target_id, section_id, max(strength) as strength from v where strength is not null group by all), t as (select *, max(strength) over (partition by document_id, target_id) as top from b)
    select document_id, target_id, case when count(*) = 1 then min(section_id) end as section_id, min(strength) as strength, case when count(*) = 1 then 'resolved' else 'ambiguous' end as status from t where strength = top group by document_id, target_id""")
def floating_sections_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolve_by_references(frame(spark, sf_dir, "fx_references"))


_KNOWN = sub("known_sections", "k")


@query(f"""with recursive {cte('fx_relations')}, k as (select * from {_KNOWN}), b as (select document_id || '/' || source_id as a, document_id || '/' || target_id as b from fx_relations where kind = 'continues' union select document_id || '/' || target_id, document_id || '/' || source_id from fx_relations where kind = 'continues'),
    d as (select document_id || '/' || element_id as element_id, section_id, 0 as round from k union select b.b, d.section_id, d.round + 1 from d join b on b.a = d.element_id where d.round < (select count(*) from b)),
    m as (select element_id, section_id, min(round) as round from d group by all), f as (select element_id, min(round) as round from m group by all)
    select m.element_id, min(m.section_id) as section_id, m.round from m join f using (element_id, round) group by m.element_id, m.round having count(distinct m.section_id) = 1""")
def continuation_inheritance_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements are named by document and id, so that chains of documents stay apart."""
    name = lambda c: F.concat_ws("/", "document_id", c)
    edges = frame(spark, sf_dir, "fx_relations").where("kind = 'continues'").select(name("source_id").alias("a"), name("target_id").alias("b"))
    return S.inherit_along(edges, select(spark, sf_dir, "select concat_ws('/', document_id, element_id) as element_id, section_id from @known_sections@"))


_REASONS = """h as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from heads), w as (select *, len(list_filter(string_split(t, ' '), lambda x: x <> '')) as words from h), n as (select doc, lower(t) as low, count(distinct page) as pages from w group by all),
    r as (select w.*, case when is_furniture then 'running_header_footer' when t = '' then 'empty' when regexp_matches(t, '(?i)https?://|www\\.|@[a-z0-9-]+\\.|^\\+?[0-9()\\s.-]{7,}$') then 'contact_or_url'
        when regexp_matches(t, '^[$€£]?[0-9][0-9.,]*\\s*(?:%|million|billion|k)?$') then 'local_statistic' when regexp_matches(t, '(?i)^step\\s+[0-9]+\\b') then 'procedure_step' when regexp_matches(t, '(?i)^(?:signed|signature|sincerely|/s/)') then 'signature'
        when words >= 4 and regexp_matches(t, '[.!?]$') then 'functional_sentence' when after_table and regexp_matches(t, '(?i)^notes?:?$') then 'table_notes'
        when words <= 4 and pages >= 3 and lower(t) not in ('abstract', 'introduction', 'background', 'conclusion', 'conclusions', 'references', 'results', 'discussion', 'methods', 'appendix') and not regexp_matches(t, '^[0-9]') then 'repeated_local_label' end as reason
        from w join n on n.doc = w.doc and n.low = lower(w.t))"""


@query(f"""with b as (select page_id as page, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as doc, pos, regexp_extract(block, '<([a-z0-9]+)>', 1) as tag, trim(regexp_replace(block, '<[^>]*>', '', 'g')) as text
        from (select page_id, url, unnest(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)>[^<]*')) as block, generate_subscripts(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)>[^<]*'), 1) - 1 as pos from pages)),
    e as (select *, lag(tag) over (partition by page order by pos) as before, row_number() over (partition by page order by pos) = 1 or row_number() over (partition by page order by pos desc) = 1 as at_edge from b),
    f as (select doc, lower(text) as low, count(distinct page) as on_pages from e where at_edge group by all),
    heads as (select e.doc, e.page, e.pos, e.text, at_edge and coalesce(on_pages, 0) >= 3 as is_furniture, coalesce(before = 'table', false) as after_table from e left join f on f.doc = e.doc and f.low = lower(e.text) where tag like 'h_'), {_REASONS}
    select doc, page, pos, reason from r""")
def heading_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headings of all pages, with the first reason against each; a document is a site. What begins or ends three pages of a site is furniture."""
    site = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("doc")
    pages = read(spark, sf_dir, "pages")
    order = Window.partitionBy("page_id").orderBy("pos")
    rows = html_blocks(pages).withColumn("before", F.lag("tag").over(order)).withColumn("at_edge", F.lag("pos").over(order).isNull() | F.lead("pos").over(order).isNull()).join(pages.select("page_id", site), "page_id")
    often = rows.where("at_edge").groupBy("doc", F.lower("text").alias("low")).agg(F.countDistinct("page_id").alias("on_pages"))
    heads = rows.where("tag like 'h_'").withColumn("low", F.lower("text")).join(often, ["doc", "low"], "left")
    heads = heads.select("doc", F.col("page_id").alias("page"), "pos", "text", (F.col("at_edge") & (F.coalesce("on_pages", F.lit(0)) >= 3)).alias("is_furniture"), F.coalesce(F.col("before") == "table", F.lit(False)).alias("after_table"))
    return S.eligibility(heads).select("doc", "page", "pos", "reason")


@query(f"with {cte('fx_titles')}, heads as (select doc, page, pos, text, is_furniture, after_table from fx_titles), {_REASONS} select doc, page, pos, reason, reason is null as eligible from r")
def heading_eligibility_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason of the chain, in two documents."""
    return S.eligibility(frame(spark, sf_dir, "fx_titles")).select("doc", "page", "pos", "reason", "eligible")


@query(f"""with {cte('fx_firings')}, d as (select rule_id, element_id, row_number() over (partition by rule_id order by document_id, element_id) as n from (select distinct rule_id, document_id, element_id from fx_firings)),
    s as (select rule_id, list(element_id order by n) as samples from d where n <= 3 group by rule_id)
    select rule_id, count(*) as firings, count(distinct document_id) as documents, list_sort(list_distinct(list(status))) as statuses, any_value(samples) as samples from fx_firings join s using (rule_id) group by rule_id""")
def rule_coverage_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rule_coverage(frame(spark, sf_dir, "fx_firings"))


@query(f"""with {cte('fx_calls')}, m as (select *, coalesce(action = lag(action) over w and target is not distinct from lag(target) over w, false) as again, row_number() over (partition by example_id order by session, step) as nth from fx_calls window w as (partition by session order by step))
    select count(*) as examples, count(*) filter (valid) as valid, round(avg(valid::int), 6) as valid_rate, count(*) filter (accepted) as accepted, count(*) filter (again) as repeats, count(*) filter (nth > 1) as duplicate_ids, count(distinct session) as sessions from m""")
def example_audit_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.example_audit(frame(spark, sf_dir, "fx_calls"))


@query(f"""with {cte('fx_calls')}, m as (select *, row_number() over (partition by example_id order by session, step) as k from fx_calls where valid and accepted)
    select example_id, '{{"session":"' || session || '","step":' || step || ',"action":"' || action || '"' || coalesce(',"target":"' || target || '"', '') || '}}' as target_text from m where k = 1""")
def accepted_examples_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accepted_examples(frame(spark, sf_dir, "fx_calls"))


@query(f"with {cte('fx_scores')} select count(*) filter (status = 'ready') as succeeded, count(*) filter (status in ('stopped_incomplete', 'budget_exhausted')) as degraded, count(*) filter (status is null) as failed from fx_scores")
def batch_health_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.batch_health(frame(spark, sf_dir, "fx_scores"))


@query(f"""with {cte('fx_scopes')}, s as (select question_id, pages, lower(scope) as s from fx_scopes), x as (select *, regexp_matches(s, 'whole document') as all_, try_cast(regexp_extract(s, 'first ([0-9]+)', 1) as int) as f, try_cast(regexp_extract(s, 'last ([0-9]+)', 1) as int) as l,
        try_cast(regexp_extract(s, 'pages? ([0-9]+)\\s*(?:-|to)\\s*[0-9]+', 1) as int) as lo, try_cast(regexp_extract(s, 'pages? [0-9]+\\s*(?:-|to)\\s*([0-9]+)', 1) as int) as hi, list_transform(regexp_extract_all(regexp_extract(s, '(pages? [0-9]+(?:(?:\\s*,\\s*|\\s+and\\s+)[0-9]+)*)', 1), '[0-9]+'), lambda v: v::int) as named from s)
    select question_id, p::int as page_number from x, range(1, 1000) r(p) where p <= pages and case when all_ then true when f is not null then p <= f when l is not null then p > pages - l when lo <= hi then p between lo and hi else list_contains(named, p::int) end""")
def scope_pages_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scope_pages(frame(spark, sf_dir, "fx_scopes"))


_MENTIONED = sub("mentioned", "m")


@query(f"""with {cte('fx_pages')}, m as (select * from {_MENTIONED}), a as (select m.*, (select min(page_id) from fx_pages p where p.document_id = m.document_id and p.label = m.label) as printed_id, (select page_id from fx_pages p where p.document_id = m.document_id and p.page_index + 1 = try_cast(m.label as bigint)) as counted_id,
        (select count(distinct page_id) from fx_pages p where p.document_id = m.document_id and p.label = m.label) as printed from m)
    select document_id, label, coalesce(printed_id, counted_id) as page_id, case when printed_id is not null then 'printed' when counted_id is not null then 'physical' else 'unresolved' end as "by", printed from a""")
def page_resolution_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_of_label(select(spark, sf_dir, "select * from @mentioned@"), frame(spark, sf_dir, "fx_pages"))


@query(f"""with recursive {cte('fx_deltas')}, d as (select *, row_number() over (partition by session order by step) as n from fx_deltas),
    f as (select session, 0::bigint as n, map([]::varchar[], []::varchar[]) as held, 0 as rejected from (select distinct session from d)
        union all select d.session, d.n, case when op = 'add' and not list_contains(map_keys(held), evidence_id) then map(list_append(map_keys(held), evidence_id), list_append(map_values(held), observation_id))
                when op = 'replace' and list_contains(map_keys(held), evidence_id) then map_from_entries(list_append(list_filter(map_entries(held), lambda x: x.key <> evidence_id), {{'key': evidence_id, 'value': observation_id}}))
                when op = 'remove' and list_contains(map_keys(held), evidence_id) then map_from_entries(list_filter(map_entries(held), lambda x: x.key <> evidence_id)) else held end,
            rejected + case when (op = 'add') = list_contains(map_keys(held), evidence_id) then 1 else 0 end from f join d on d.session = f.session and d.n = f.n + 1),
    l as (select *, row_number() over (partition by session order by n desc) as k from f)
    select session, e.key as evidence_id, e.value as observation_id, rejected from (select session, unnest(map_entries(held)) as e, rejected from l where k = 1)
    union all select session, null, null, rejected from l where k = 1 and len(map_entries(held)) = 0""")
def evidence_fold_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evidence_fold(frame(spark, sf_dir, "fx_deltas"))


@query()
def search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every document's text: windows of 256 tokens that overlap by 32."""
    return C.chunks(read(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", "part", "start", "stop", "tokens")


@query()
def anchor_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the literal elements name."""
    return C.explode_texts(frame(spark, sf_dir, "fx_elements"), ["element_id"], "text", C.anchor_mentions, "kind string, label string, start int, stop int")


@query()
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the headings and items of each page, by their text and tag."""
    rows = html_blocks(read(spark, sf_dir, "pages")).where("tag <> 'p'").select(F.col("page_id").cast("string").alias("doc"), "pos", "text", F.col("tag").alias("style"))
    return C.heading_levels(rows)


@query("""with t as (select doc_id, pos, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where trim(line) <> ''),
    w as (select *, lag(line) over o as before, lead(line) over o as after, length(line) - length(replace(line, ' the ', '')) as relevance from t window o as (partition by doc_id order by pos)),
    r as (select *, row_number() over (partition by doc_id order by relevance desc, pos) as k from w) select doc_id as table_id, pos as r, before, line as text, after from r where k = 1""")
def best_line_with_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the line that says a word most, and the lines around it."""
    rows = elements(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("table_id"), F.col("pos").alias("r"), F.col("line").alias("text"), (F.length("line") - F.length(F.replace("line", F.lit(" the "), F.lit("")))).alias("relevance"))
    return A.best_row_with_neighbours(rows)
