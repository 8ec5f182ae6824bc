"""Normalisation decisions, their coverage, and the structure that follows from them, over reports derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.lineage import cut_lineage
from docloom.operators import rules as N
from docloom.operators.audit import rule_coverage
from docloom.operators.coverage import recover
from docloom.operators.floating import resolve as resolve_floating
from docloom.operators.normalize import CODE_SIGNS
from docloom.operators.relations import document_errors
from docloom.plans.derived import TABLES, cte, duck, frame, rows, select, sub
from docloom.plans.registry import query

#: Elements as a parser may have them: some code is an algorithm, some footnotes stand inside figures.
PARSED = """select document_id, element_id, page_index, reading_order, case when element_type = 'code' and length(text) % 3 = 0 then 'algorithm' when element_type = 'paragraph' and length(text) % 5 = 0 then 'footnote' else element_type end as element_type,
    case when element_type = 'list' and length(text) % 4 = 0 then ' ' when element_type = 'caption' and length(text) % 7 = 0 then 'chart by ' || text when element_type = 'caption' and length(text) % 5 = 0 then substring(text, 11, 30) when element_type = 'paragraph' and length(text) % 6 = 0 then 'Source: ' || text
        when element_type = 'paragraph' and length(text) % 11 = 0 then 'Section 4.2: ' || text when element_type = 'footnote' and length(text) % 4 = 1 then 'Step 2 ' || text when element_type = 'code' and length(text) % 2 = 0 then 'Algorithm 3 ' || text else text end as text, x1, y1, x2, y2 from {0}"""
_PROFILES = "select distinct document_id, case when length(document_id) % 2 = 0 then 'slides' else 'report' end as profile from {0}"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    elements = cut_lineage(spark.sql(PARSED.format("{e}"), e=rows(spark, sf_dir, TABLES["fx_elements"])))
    bound = select(spark, sf_dir, "select document_id, caption_id as element_id, target_id from @declared@").union(select(spark, sf_dir, "select document_id, footnote_id, target_id from @anchored@"))
    return elements, bound, spark.sql(_PROFILES.format("{e}"), e=elements)


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')".replace("'’‘", "''’‘")


_SIGNS = " + ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')::int" for p in CODE_SIGNS).replace("(?m:$)", "(?m:$)")
_BOX = "greatest(0, least(x2, tx2) - greatest(x1, tx1)) * greatest(0, least(y2, ty2) - greatest(y1, ty1)) / ((x2 - x1) * (y2 - y1))"
_UNLABELLED = f"type = 'caption' and tt in ('figure', 'chart', 'table') and not {_re('plain', N.CAPTION_LABEL)}"
_BY_NAME = {
    "embedded_section_label_promoted": f"(type = 'caption' and {_re('plain', N.STRUCTURAL_SECTION)}) or (type = 'paragraph' and {_re('plain', N.STRUCTURAL_SECTION)} and strpos(plain, regexp_extract(plain, '{N.STRUCTURAL_SECTION}')) <= 21)",
    "slide_visual_note_to_footnote": f"slides and type = 'paragraph' and {_re('plain', N.VISUAL_NOTE)} and above is not null",
    "explicit_numbered_algorithm": f"type in ('code', 'algorithm') and {_re('plain', N.EXPLICIT_ALGORITHM)}",
    "ui_screenshot_not_algorithm": f"type = 'algorithm' and {_re('plain', N.UI_TEXT)} and signs = 0",
    "prompt_template_normalized_to_code": f"type in ('code', 'algorithm') and {_re('text', N.PROMPT_TEMPLATE)}",
    "runnable_or_prompt_code_normalized": "type in ('code', 'algorithm') and signs >= 2", "short_output_not_algorithm": "type = 'algorithm' and words <= 8 and signs = 0", "preserve_code_like_type": "type in ('code', 'algorithm')",
    "visual_attribution_preserved": f"type = 'footnote' and {_re('plain', N.VISUAL_ATTRIBUTION)}",
    "procedure_contact_or_official_text_not_footnote": f"type = 'footnote' and ({_re('plain', N.PROCEDURE_OR_CONTACT)} or {_re('plain', N.OFFICIAL_OR_ADDRESS)})",
    "slide_local_text_not_footnote": f"type = 'footnote' and slides and not {_re('plain', N.FOOTNOTE_PREFIX)} and words <= 12", "explicit_footnote_or_source_prefix": f"type = 'footnote' and {_re('plain', N.FOOTNOTE_PREFIX)}",
    "table_introduction_before_following_table": "type = 'footnote' and next_type = 'table' and next_order - reading_order <= 2", "unbound_page_footnote_preserved": "type = 'footnote' and tt is null",
    "visual_internal_text_not_footnote": "type = 'footnote' and tt in ('figure', 'chart', 'table') and inside >= 0.30", "table_introduction_without_note_marker": "type = 'footnote' and tt = 'table' and y2 <= ty1 + 0.01",
    "markerless_table_note_preserved_for_validation": "type = 'footnote' and tt = 'table'", "nearby_visual_description_to_caption": "type = 'footnote' and tt in ('figure', 'chart', 'table') and gap <= 0.10 and words between 2 and 100", "ambiguous_footnote_preserved": "type = 'footnote'",
    "visual_attribution_to_footnote": f"type = 'caption' and tt in ('figure', 'chart', 'table') and {_re('plain', N.VISUAL_ATTRIBUTION)}",
    "external_visual_title_preserved": "type = 'caption' and tt in ('figure', 'chart', 'table') and words > 0 and y2 <= ty1 + 0.01 and gap <= 0.08 and across >= 0.50 and words <= 24",
    "slide_local_text_not_caption": f"slides and {_UNLABELLED} and not {_re('plain', N.CREDIT)} and (inside >= 0.05 or words <= 12 or {_re('plain', N.PROCEDURE_OR_CONTACT)})", "visual_internal_label_not_caption": f"{_UNLABELLED} and inside >= 0.45",
    "slide_diagram_label_not_caption": f"slides and {_UNLABELLED} and words <= 8 and (inside >= 0.15 or {_re('plain', N.DIAGRAM)})", "empty_list_excluded_from_semantic_relations": "type = 'list' and words = 0",
}
#: Corrections of misread figures look around, which DuckDB's patterns cannot; the derived texts hold none.
_DECISIONS = f"""{cte('fx_elements')}, e as ({PARSED.format('fx_elements')}), pr as ({_PROFILES.format('fx_elements')}),
    b as (select document_id, element_id, min(target_id) as target_id from (select document_id, caption_id as element_id, target_id from {sub('declared')} union all select document_id, footnote_id, target_id from {sub('anchored')}) group by all),
    c as (select e.* exclude (text, element_type), element_type as type, coalesce(text, '') as text, profile = 'slides' as slides, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as plain, lead(element_type) over w as next_type, lead(reading_order) over w as next_order from e left join pr using (document_id) window w as (partition by e.document_id, page_index order by reading_order, element_id)),
    t as (select b.*, e.element_type as tt, x1 as tx1, y1 as ty1, x2 as tx2, y2 as ty2 from b join e on e.document_id = b.document_id and e.element_id = b.target_id),
    d as (select c.*, case when plain = '' then 0 else len(string_split(plain, ' ')) end as words, {_SIGNS} as signs, t.* exclude (document_id, element_id), {_BOX} as inside, greatest(0, ty1 - y2, y1 - ty2) as gap, greatest(0, least(x2, tx2) - greatest(x1, tx1)) / greatest(1e-9, least(x2 - x1, tx2 - tx1)) as across,
        (select min(v.element_id) from e v where v.document_id = c.document_id and v.page_index = c.page_index and v.element_type in ('figure', 'chart', 'table') and v.y2 <= c.y1 + 0.02 and greatest(0, c.y1 - v.y2, v.y1 - c.y2) <= 0.12) as above from c left join t on t.document_id = c.document_id and t.element_id = c.element_id),
    x as (select *, case {' '.join(f"when {where} then '{name}'" for name, where in _BY_NAME.items())} else '{N.KEPT}' end as rule from d),
    r as (select *, case rule {' '.join(f"when '{r.name}' then '{r.becomes}'" for r in N.RULES if r.becomes)} else type end as normalized_type, case rule when 'runnable_or_prompt_code_normalized' then least(0.98, 0.78 + signs * 0.04) {' '.join(f"when '{r.name}' then {r.confidence}" for r in N.RULES if isinstance(r.confidence, float))} else 1.0 end::double as confidence from x)"""


@query(f"with {_DECISIONS} select document_id, element_id, type as element_type, normalized_type, rule, round(confidence, 6) as confidence, case when rule = 'embedded_section_label_promoted' then trim(regexp_extract(plain, '{N.STRUCTURAL_SECTION}')) else text end as text from r")
def normalization_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element with the rule that decided, and its type and text before and after."""
    return N.decide(*_tables(spark, sf_dir)).select("document_id", "element_id", "element_type", "normalized_type", "rule", F.round("confidence", 6).alias("confidence"), "text")


@query(f"""with {_DECISIONS}, f as (select rule as rule_id, document_id, element_id, case when confidence >= 0.9 then 'confirmed' else 'candidate' end as status from r where rule <> '{N.KEPT}'),
    s as (select rule_id, list(element_id order by document_id, element_id)[1:3] as samples from (select distinct rule_id, document_id, element_id from f) group by rule_id)
    select rule_id, count(*) as firings, count(distinct document_id) as documents, list_sort(list_distinct(list(status))) as statuses, any_value(samples) as samples from f join s using (rule_id) group by rule_id""")
def normalization_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and where each rule decided."""
    return rule_coverage(N.firings(N.decide(*_tables(spark, sf_dir))))


@query()
def structure_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of every element, by all passes in order."""
    return N.structure(*_tables(spark, sf_dir))["sections"]


#: Blocks of pages as a parser found them: of three one whole, one by its first half, one not at all; and as they were printed.
_HALF = "cast(floor(length(text) / 2) as int)"
_FOUND_BLOCKS = f"""select 'p' || page_id as document_id, 'b' || pos as element_id, cast(floor(pos / 20) as bigint) as page_index, pos as reading_order, 'paragraph' as element_type, case when pos % 3 = 1 then substring(text, 1, {_HALF}) else text end as text,
    1e-1 as x1, (pos % 20) / 20e0 as y1, 9e-1 as x2, (pos % 20 + 0.9e0) / 20e0 as y2 from @blocks@ as b where pos % 3 > 0"""
_PRINTED_BLOCKS = "select 'p' || page_id as document_id, cast(floor(pos / 20) as bigint) as page_index, 'l' || pos as line_id, text, 1e-1 as x1, (pos % 20) / 20e0 as y1, 9e-1 as x2, (pos % 20 + 0.9e0) / 20e0 as y2 from @blocks@ as b where text <> ''"


@query()
def recovered_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the printed blocks of pages say beyond the blocks that were found."""
    return recover(select(spark, sf_dir, _PRINTED_BLOCKS), select(spark, sf_dir, _FOUND_BLOCKS))


@query(f"""with b as (select * from {duck('@blocks@')}), p as (select page_id, count(*) filter (pos % 3 = 0 and text <> '') as lost, sum(case when pos % 3 = 0 then len(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) else 0 end) as chars from b group by page_id)
    select 'p' || page_id as document_id, lost, chars::bigint as chars from p where lost > 0""")
def recovered_blocks_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that were not found at all, and their letters and digits: all of them come back, once."""
    rows = recover(select(spark, sf_dir, _PRINTED_BLOCKS), select(spark, sf_dir, _FOUND_BLOCKS), least=0).where("cast(substring(line_id, 2, 9) as int) % 3 = 0")
    return rows.groupBy("document_id").agg(F.countDistinct("line_id").alias("lost"), F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("chars"))


#: Tables of the reports with some faults: pages name lines of other pages, sections lines and pages that are not there, elements pages and sections likewise.
_P = "select document_id, 'p' || page_index as page_id, case when page_index % 5 = 4 then 'e' || (page_index * 8 + 9) else 'e' || (page_index * 8) end as one, case when page_index % 7 = 3 then 'x' || page_index else 'e' || (page_index * 8 + 1) end as two from @fx_pages@"
_E = "select document_id, element_id, 'p' || (page_index + case when length(text) % 13 = 0 then 900 else 0 end) as page_id, case when length(text) % 11 = 0 then 's99' when length(text) % 7 = 0 then null else section_id end as section_id from @fx_elements@"
_S = "select distinct document_id, 's' || cast(floor(page_index / 2) as bigint) as section_id, 'e' || (cast(floor(page_index / 2) as bigint) * case when length(document_id) % 2 = 0 then 16 else 400 end) as heading_id, case when page_index < 2 then null when page_index < 10 then 's0' else 's77' end as parent_id, 'p' || (cast(floor(page_index / 2) as bigint) * 3) as one, 'e' || (cast(floor(page_index / 2) as bigint) * 30) as two from @fx_pages@"


def _with(text: str) -> str:
    return text.replace("@fx_pages@", "fx_pages").replace("@fx_elements@", "fx_elements")


@query(f"""with {cte('fx_pages')}, {cte('fx_elements')}, {cte('fx_relations')}, p as ({_with(_P)}), e as ({_with(_E)}), s as ({_with(_S)}), ke as (select distinct document_id, element_id as id from e), kp as (select distinct document_id, page_id as id from p), ks as (select distinct document_id, section_id as id from s), k as (select * from ke union select * from kp union select * from ks),
    held as (select document_id, page_id, one as element_id from p union all select document_id, page_id, two from p),
    m as (select 'any' as place, document_id, 'relation' as owner, relation_id as id, 'missing_source' as error, source_id as missing from fx_relations union all select 'any', document_id, 'relation', relation_id, 'missing_target', target_id from fx_relations
        union all select 'e', document_id, 'page', page_id, 'missing_element', element_id from held union all select 'p', document_id, 'element', element_id, 'missing_page', page_id from e union all select 's', document_id, 'element', element_id, 'missing_section', section_id from e where section_id is not null
        union all select 'e', document_id, 'section', section_id, 'missing_heading', heading_id from s union all select 's', document_id, 'section', section_id, 'missing_parent', parent_id from s where parent_id is not null
        union all select 'p', document_id, 'section', section_id, 'missing_page', one from s union all select 'e', document_id, 'section', section_id, 'missing_element', two from s)
    select document_id, owner, id, error, missing from m where (document_id, missing) not in (select (document_id, id) from ke) and place = 'e' or (document_id, missing) not in (select (document_id, id) from kp) and place = 'p'
        or (document_id, missing) not in (select (document_id, id) from ks) and place = 's' or (document_id, missing) not in (select (document_id, id) from k) and place = 'any'
    union all select h.document_id, 'element', h.element_id, 'other_page', h.page_id from held h join e on e.document_id = h.document_id and e.element_id = h.element_id where e.page_id <> h.page_id""")
def document_reference_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that pages, elements, sections and relations of the reports name and that is not there."""
    # several parts read each of these tables: they are written once
    pages, elements, relations = cut_lineage(frame(spark, sf_dir, "fx_pages")), frame(spark, sf_dir, "fx_elements"), cut_lineage(frame(spark, sf_dir, "fx_relations"))
    made = lambda text: spark.sql(text.replace("@fx_pages@", "{p}").replace("@fx_elements@", "{e}"), p=pages, e=elements)
    sections = made(_S).select("document_id", "section_id", "heading_id", "parent_id", F.array("one").alias("page_ids"), F.array("two").alias("element_ids"))
    return document_errors(made(_P).select("document_id", "page_id", F.array("one", "two").alias("element_ids")), made(_E), sections, relations)


def _floating(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = select(spark, sf_dir, "select document_id, section_id, title from @section_titles@")
    return resolve_floating(frame(spark, sf_dir, "fx_elements"), frame(spark, sf_dir, "fx_references"), select(spark, sf_dir, "select * from @chain@"), frame(spark, sf_dir, "fx_relations"), titles, select(spark, sf_dir, "select * from @panels@"))


@query()
def floating_section_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of every floating element of the reports, and the step that decided."""
    return _floating(spark, sf_dir)


@query(f"""with {cte('fx_elements')}, {cte('fx_references')}, v as (select *, round(case when side = 'before' then case when pages <= 2 then confidence - 0.05 * pages end else case when pages <= 1 then confidence - 0.10 - 0.05 * pages end end, 6) as strength from fx_references),
    b as (select document_id, target_id, section_id, max(strength) as strength from v where strength is not null group by all), t as (select *, max(strength) over (partition by document_id, target_id) as top from b), w as (select document_id, target_id, min(section_id) as section_id from t where strength = top group by all having count(*) = 1)
    select w.document_id, target_id as element_id, e.section_id as base_section_id, w.section_id from w join fx_elements e on e.document_id = w.document_id and e.element_id = w.target_id where element_type in ('figure', 'chart', 'table', 'code', 'algorithm', 'caption', 'footnote', 'equation')""")
def floating_sections_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that the first step, the strongest reference, decided."""
    return _floating(spark, sf_dir).where("step = 'reference'").drop("step", "ambiguous")
