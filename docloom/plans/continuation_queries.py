"""Continuation and normalisation queries over literal tables and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import continuation as C
from docloom.operators import normalize as N
from docloom.operators import relations as X
from docloom.operators import sections as SE
from docloom.operators.elements import elements
from docloom.plans.derived import cte, frame, select, sub
from docloom.plans.registry import query, read
from docloom.plans.retrieval_queries import SQL_ELEMENTS
from docloom.plans.structure_queries import _ON_PAGE


@query(f"with {_ON_PAGE}, m as (select document_id, a_element_id as caption_id, b_element_id as member from p where a_element_type = 'caption' and b_element_type in ('figure', 'chart', 'table') and vg <= 0.10 and ho / least(aw, bw) >= 0.20) select document_id, caption_id, list(member order by member) as members from m group by all having count(*) >= 2")
def caption_groups_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.caption_groups(frame(spark, sf_dir, "fx_elements"))


_PRIMARY = sub("primary", "v")


@query(f"""with {_ON_PAGE}, pr as (select * from {_PRIMARY}), r as (select document_id, a_element_id as target_id, b_element_id as member_id from p where a_element_type in ('figure', 'chart') and b_element_type in ('figure', 'chart') and vo / least(ah, bh) >= 0.65),
    c as (select document_id, a_element_id as caption_id, b_element_id as member_id from p where a_element_type = 'caption' and vg <= 0.08 and ho / least(aw, bw) >= 0.25) select document_id, caption_id, member_id from pr join r using (document_id, target_id) join c using (document_id, caption_id, member_id)""")
def panel_members_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of a caption's row beside its first target."""
    return C.panel_members(frame(spark, sf_dir, "fx_elements"), select(spark, sf_dir, "select * from @primary@"))


_ANCHORED = sub("anchored", "v")


@query(f"""with {_ON_PAGE}, an as (select * from {_ANCHORED}), m as (select p.document_id, a_element_id as footnote_id, target_id, row_number() over (partition by p.document_id, a_element_id order by b_y2 desc, b_element_id desc) as k from p join an on an.document_id = p.document_id and an.footnote_id = b_element_id
        where a_element_type = 'footnote' and b_element_type = 'footnote' and b_y2 <= a_y1 + 1e-9 and vg <= 0.035 and ho / least(aw, bw) >= 0.60 and (p.document_id, a_element_id) not in (select (document_id, footnote_id) from an))
    select document_id, footnote_id, target_id from m where k = 1""")
def markerless_notes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.markerless_notes(frame(spark, sf_dir, "fx_elements"), select(spark, sf_dir, "select * from @anchored@"))


@query(f"""with {_ON_PAGE}, an as (select * from {_ANCHORED}), v as (select * from fx_elements where element_type in ('figure', 'chart', 'table')),
    r as (select document_id, a_element_id as target_id, b_element_id as member_id, b_x1 as x1, b_x2 as x2 from p where a_element_type in ('figure', 'chart', 'table') and b_element_type in ('figure', 'chart', 'table') and vo / least(ah, bh) >= 0.70 and greatest(aw, bw) / least(aw, bw) <= 1.8 union all select document_id, element_id, element_id, x1, x2 from v),
    g as (select document_id, footnote_id, list(member_id) as members, min(r.x1) as lo, max(r.x2) as hi, any_value(f.x1) as n1, any_value(f.x2) as n2 from an join r using (document_id, target_id) join fx_elements f on f.document_id = an.document_id and f.element_id = footnote_id group by document_id, footnote_id)
    select document_id, footnote_id, unnest(members) as member_id from g where len(members) >= 2 and (least(hi, n2) - greatest(lo, n1)) / (hi - lo) >= 0.80""".replace("join r using (document_id, target_id) join fx_elements f on f.document_id = an.document_id", "join r using (document_id, target_id) join fx_elements f using (document_id)").replace("using (document_id) and f.element_id = footnote_id", "using (document_id) where f.element_id = footnote_id"))
def shared_notes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visuals in a row that share the note below them."""
    return C.shared_note_members(frame(spark, sf_dir, "fx_elements"), select(spark, sf_dir, "select * from @anchored@"))


_CODE_WORDS = "list_distinct(string_split_regex(lower({c}), '\\W+'))"


@query(f"""with {_ON_PAGE} select distinct document_id, b_element_id as element_id, a_element_id as same_as from p where a_element_type = 'code' and b_element_type = 'code' and a_reading_order < b_reading_order and ho * vo / (aw * ah + bw * bh - ho * vo) >= 0.45
    and 2 * len(list_intersect({_CODE_WORDS.format(c='a_text')}, {_CODE_WORDS.format(c='b_text')})) / (len({_CODE_WORDS.format(c='a_text')}) + len({_CODE_WORDS.format(c='b_text')})) >= 0.72""")
def duplicate_code_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_code(frame(spark, sf_dir, "fx_elements"))


_FOUND = """k(kind, pattern) as (values ('figure', '(?i)\\b(?:figure|fig\\.?)\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?|[IVX]+)\\b'), ('table', '(?i)\\b(?:table|tab\\.)\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?|[IVX]+)\\b'), ('section', '(?i)\\b(?:section|sec\\.)\\s*([0-9]+(?:\\.[0-9]+)*)\\b')),
    m as (select distinct document_id, element_id as source_id, kind, page_index, section_id, reading_order, unnest(regexp_extract_all(text, pattern, 1)) as number from fx_elements, k where element_type = 'paragraph')"""


@query(f"""with {cte('fx_elements')}, {cte('fx_labels')}, {_FOUND}, l as (select * from fx_labels where kind <> 'figure'),
    r as (select document_id, source_id, kind, number, (list(target_id order by (m.section_id <> l.section_id)::int, priority desc, abs(m.page_index - l.page_index), target_id))[1] as target_id from m left join l using (document_id, kind, number) group by all),
    t as (select m.document_id, source_id, kind, number, min(e.element_id) as target_id, count(*) as c from m join fx_elements e on e.document_id = m.document_id and e.page_index = m.page_index and e.element_type in ('figure', 'chart') and e.y2 - e.y1 >= 0.25 and e.reading_order > m.reading_order
        where (m.document_id, source_id, kind, number) not in (select (document_id, source_id, kind, number) from r where target_id is not null) group by all)
    select document_id, source_id, kind, number, target_id from t where c = 1 union all select * from r""")
def composite_fallback_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that no label answers, by the one tall visual that follows on the page."""
    rows = frame(spark, sf_dir, "fx_elements")
    found = X.mentions(rows)
    resolved = X.resolve_references(found, frame(spark, sf_dir, "fx_labels").where("kind <> 'figure'"))
    return C.composite_fallback(found, rows, resolved).unionByName(resolved.select("document_id", "source_id", "kind", "number", "target_id"))


@query(f"""with {cte('fx_pages')}, l as (select document_id as doc, page_index, try_cast(label as bigint) as number, x from fx_pages)
    select distinct a.doc, a.page_index, a.number from l a join l b on a.doc = b.doc and abs(b.page_index - a.page_index) between 1 and 2 where (b.number - a.number) / (b.page_index - a.page_index) between 1 and 2 and abs(a.x - b.x) <= 0.20""")
def page_label_support_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "fx_pages").select(F.col("document_id").alias("doc"), "page_index", F.expr("try_cast(label as bigint)").alias("number"), "x").where("number is not null")
    return C.sequence_support(rows)


@query(f"""with {cte('fx_pages')}, l as (select document_id as doc, page_index, try_cast(label as bigint) as number from fx_pages), k as (select *, lead(page_index) over w as np, lead(number) over w as nn from l where number is not null window w as (partition by doc order by page_index))
    select doc, page_index + i as page_index, [number + 2 * i, number + 2 * i + 1] as numbers from k, range(0, 100) x(i) where nn - number = 2 * (np - page_index) and i < np - page_index""")
def page_spreads_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spread_labels(frame(spark, sf_dir, "fx_pages").select(F.col("document_id").alias("doc"), "page_index", F.expr("try_cast(label as bigint)").alias("number")).where("number is not null"))


@query(f"with {SQL_ELEMENTS}, s as (select doc_id, pos, " + " + ".join(f"(regexp_matches(line, '{p}'))::int" for p in (r"^\s*(?:def|class|function|public|private|static|import|from|#include|package)\b", r"[{}];?\s*$", r";\s*$", r"\b(?:if|for|while|switch)\s*\(", r"(?:==|!=|&&|\|\||->|=>|:=|\+=)", r"\b[A-Za-z_]\w*\([^)]*\)\s*[;{:]", r"^\s{4,}\S", r"^\s*(?://|#|--)\s")) + " as score from e) select doc_id, sum(score)::bigint as signs, count(*) filter (score >= 2) as code_lines from s group by doc_id")
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of code in the lines of each document."""
    rows = elements(read(spark, sf_dir, "documents")).withColumn("score", N.code_score(F.col("line"), F.lit(None).cast("string")))
    return rows.groupBy("doc_id").agg(F.sum("score").alias("signs"), F.count_if(F.col("score") >= 2).alias("code_lines"))


@query(f"with {cte('fx_elements')} select element_id, case lower(left(regexp_extract(text, '(?i)^\\s*(figure|table)\\s*([0-9]+)', 1), 3)) when 'fig' then 'figure' when 'tab' then 'table' end as kind, regexp_extract(text, '(?i)^\\s*(?:figure|table)\\s*([0-9]+)', 1) as number from fx_elements where element_type = 'caption'")
def caption_labels_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "fx_elements").where("element_type = 'caption'").withColumn("x", N.leading_label(F.col("text")))
    return rows.select("element_id", "x.kind", "x.number")


@query("""with t as (select l_orderkey as g, count(*) as n, sum(l_partkey) % 7 = 0 as broken from lineitem group by l_orderkey)
    select 't' || g as group_id, 0 as fragment_index, 0 as row_start, (n + 1) // 2 + 1 as row_end, 0 as header_rows from t union all select 't' || g, 1, case when not broken then (n + 1) // 2 + 1 end, case when not broken then n + 1 end, case when not broken then 1 end from t where n > 1""")
def table_fragments_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as a table that goes over two pages and says its head twice; in some the second page holds another row."""
    row = F.concat_ws("|", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("x"), (F.sum("l_partkey") % 7 == 0).alias("broken"))
    head = F.array(F.lit("line|part"))
    whole = lines.select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("group_id"), "broken", F.concat(head, F.col("x.row")).alias("whole")).withColumn("cut", F.ceil((F.size("whole") - 1) / 2).cast("int") + 1)
    rest = F.slice("whole", F.col("cut") + 1, F.size("whole") - F.col("cut"))
    parts = F.array(F.struct(F.lit(0).alias("fragment_index"), F.slice("whole", F.lit(1), F.col("cut")).alias("rows")), F.struct(F.lit(1).alias("fragment_index"), F.concat(head, rest, F.when(F.col("broken"), F.array(F.lit("another"))).otherwise(F.array().cast("array<string>"))).alias("rows")))
    fragments = whole.select("group_id", "whole", F.inline(parts)).where("fragment_index = 0 or size(whole) > 2")
    return C.fragment_positions(fragments.select("group_id", "fragment_index", "rows", "whole"))


_DECLARED = sub("declared", "v")
_BARS = sub("bars", "v")
_STANDING = f"""x as (select d.*, lower(regexp_extract(c.text, '(?i)^\\s*(table|tab|figure|fig|chart)\\b', 1)) as kind, t.element_type as type, b.element_id is not null as bar from (select * from {_DECLARED}) d left join fx_elements c on c.document_id = d.document_id and c.element_id = d.caption_id left join fx_elements t on t.document_id = d.document_id and t.element_id = d.target_id left join (select * from {_BARS}) b on b.document_id = d.document_id and b.element_id = d.caption_id),
    st as (select document_id, caption_id, target_id, case when bar then 'running_header' when type is null then 'unknown_target' when not (case when kind like 'tab%' then type = 'table' when kind <> '' then type in ('figure', 'chart') else type in ('figure', 'chart', 'table') end) then 'other_kind' end as reason from x)"""


@query(f"with {cte('fx_elements')}, {_STANDING} select document_id, caption_id, target_id, case when reason is null then 1.0 end::double as confidence, reason from st")
def declared_captions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.declared_captions(frame(spark, sf_dir, "fx_elements"), select(spark, sf_dir, "select * from @declared@"), select(spark, sf_dir, "select * from @bars@"))


@query(f"""with {_ON_PAGE}, {_STANDING}, m as (select p.document_id, a_element_id as caption_id, b_element_id as target_id, row_number() over (partition by p.document_id, a_element_id order by vg, abs(a_reading_order - b_reading_order), b_element_id) as k from p join st on st.document_id = p.document_id and st.caption_id = a_element_id and reason = 'other_kind' where b_element_type = 'table' and regexp_matches(a_text, '(?i)^\\s*tab(?:le)?\\b'))
    select document_id, caption_id, target_id, 0.96::double as confidence from m where k = 1""")
def repaired_captions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "fx_elements")
    return X.repaired_captions(rows, X.declared_captions(rows, select(spark, sf_dir, "select * from @declared@"), select(spark, sf_dir, "select * from @bars@")).where("reason = 'other_kind'"))


_PANELS = sub("panels", "v")
_PLACED = sub("placed", "v")


@query(f"""with g as (select * from {_PANELS}), a as (select * from {_PLACED}), o as (select g.document_id, caption_id, min(section_id) as section_id from g left join a on a.document_id = g.document_id and a.element_id = g.member_id group by all having count(*) > 1 and count(distinct section_id) = 1)
    select g.document_id, g.caption_id, member_id, o.section_id from g join o on o.document_id = g.document_id and o.caption_id = g.caption_id""")
def caption_group_sections_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.group_sections(select(spark, sf_dir, "select * from @panels@"), select(spark, sf_dir, "select * from @placed@"))
