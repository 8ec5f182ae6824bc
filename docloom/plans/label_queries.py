"""Labels, lookups and places by order, over literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import labels as L
from docloom.plans.derived import cte, frame, select, sub
from docloom.plans.registry import query
from docloom.plans.structure_queries import _ON_PAGE

_LABEL = "regexp_extract({c}, '(?i)^\\s*(figure|fig\\.?|table|tab\\.|chart|listing)\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?|[IVXLC]+)\\b', {g})"
_KIND = "case lower(left(" + _LABEL.format(c="text", g=1) + ", 3)) when 'fig' then 'figure' when 'tab' then 'table' when 'cha' then 'chart' when 'lis' then 'listing' end"
_SAID = f"l as (select *, {_KIND} as kind, lower({_LABEL.format(c='text', g=2)}) as number from fx_elements where element_type in ('paragraph', 'caption'))"
_NEAR = f"""near as (select p.document_id, l.element_id, l.kind, l.number, b_element_id as target_id, row_number() over (partition by p.document_id, l.element_id order by vg, abs(a_reading_order - b_reading_order), b_element_id) as k from p join l on l.document_id = p.document_id and l.element_id = a_element_id
    where l.element_type = 'paragraph' and l.kind is not null and b_element_type in ('figure', 'chart', 'table') and (l.kind = 'table') = (b_element_type = 'table') and abs(a_reading_order - b_reading_order) <= 3 and vg <= 0.08 and ho / least(aw, bw) >= 0.25)"""
_BOUND = sub("bound", "b")
_REGISTRY = f"""{_ON_PAGE}, {_SAID}, {_NEAR}, bound as (select * from {_BOUND}),
    reg as (select document_id, kind, number, target_id, max(priority) as priority from (select l.document_id, kind, number, bound.target_id, 100 as priority from l join bound on bound.document_id = l.document_id and bound.caption_id = l.element_id where element_type = 'caption' and kind is not null
        union all select document_id, kind, number, target_id, 90 from near where k = 1 union all select document_id, kind, number, element_id, 70 from l where element_type = 'caption' and kind is not null
        union all select document_id, 'section', regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\.?\\s', 1), element_id, 100 from fx_elements where element_type = 'heading' and regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\.?\\s', 1) <> '') group by all)"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.registry(frame(spark, sf_dir, "fx_elements"), select(spark, sf_dir, "select * from @bound@"))


@query(f"with {_REGISTRY} select * from reg")
def label_registry_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir)


@query(f"with {_ON_PAGE}, {_SAID}, {_NEAR} select document_id, element_id, kind, number, target_id from near where k = 1")
def nearest_visual_of_paragraph_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest_visuals(frame(spark, sf_dir, "fx_elements"))


_ASKED = sub("labels_asked", "a")


@query(f"""with {_REGISTRY}, best as (select document_id, kind, number, count(*) as targets, min(target_id) as target_id from reg r where priority = (select max(priority) from reg s where s.document_id = r.document_id and s.kind = r.kind and s.number = r.number) group by all),
    x as (select a.*, coalesce(b.targets, c.targets, 0) as targets, coalesce(b.target_id, c.target_id) as target_id from {_ASKED} left join best b using (document_id, kind, number) left join best c on c.document_id = a.document_id and c.kind = a.kind and c.number = regexp_replace(a.number, '[a-z]$', ''))
    select document_id, question_id, kind, number, targets, target_id, case targets when 0 then 'unresolved' when 1 then 'resolved' else 'ambiguous' end as status from x""")
def exact_lookup_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lookup(select(spark, sf_dir, "select * from @labels_asked@"), _registry(spark, sf_dir))


_PLACES = sub("places_asked", "a")


@query(f"""with {cte('fx_elements')}, k as (select *, case when element_type in ('figure', 'chart') then 'figure' when element_type = 'table' then 'table' when element_type = 'heading' then 'section' end as kind from fx_elements),
    o as (select document_id, kind, element_id, row_number() over w as ahead, count(*) over (partition by document_id, kind) as n from k where kind is not null window w as (partition by document_id, kind order by page_index, reading_order, element_id))
    select a.document_id, question_id, a.kind, position, o.element_id as target_id from {_PLACES} left join o on o.document_id = a.document_id and o.kind = a.kind and (position = ahead or position = ahead - n - 1)""")
def positional_targets_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.positional(frame(spark, sf_dir, "fx_elements"), select(spark, sf_dir, "select * from @places_asked@"))


_TITLES = sub("titles_asked", "a")
_SECTIONS = sub("section_titles", "s")
_NAMED = "regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '\\bprogramme', 'program', 'g'), '([a-z]{3,})s$', '\\1')"
_BAG = f"list_distinct(list_filter(string_split({_NAMED}, ' '), lambda w: w <> ''))"


@query(f"""with a as (select document_id, question_id, {_BAG} as wa from {_TITLES}), b as (select document_id, section_id, {_BAG} as wb from {_SECTIONS}),
    m as (select a.document_id, question_id, section_id, round(2 * len(list_intersect(wa, wb)) / (len(wa) + len(wb)), 6) as score from a join b on a.document_id = b.document_id and len(list_intersect(wa, wb)) > 0), f as (select * from m where score >= 0.5),
    r as (select *, row_number() over w as k, lead(score) over w as nxt from f window w as (partition by document_id, question_id order by score desc, section_id)) select document_id, question_id, section_id, score, coalesce(score - nxt <= 0.02, false) as ambiguous from r where k = 1""")
def section_candidates_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.section_candidates(select(spark, sf_dir, "select * from @titles_asked@"), select(spark, sf_dir, "select * from @section_titles@"))


_MATCHES = sub("matches", "m")


@query(f"select query_id, min(place) as place, target_id from {_MATCHES} group by query_id, target_id")
def exact_matches_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exact_matches(select(spark, sf_dir, "select * from @matches@")).select("query_id", F.col("place"), "target_id")
