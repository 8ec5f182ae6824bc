"""Tables that the given ones do not hold as such, made of them: layouts, labels, relations, logs and question sets, as SQL that Spark and DuckDB both read.

Ten documents in a row are one report; its lines, eight a page, take turns as headings, paragraphs, figures, tables, captions, notes, lists and code, by place and by
length, so that reports differ. Events are the logs, questions and scores; order lines are the cells of tables. Each table grows with what it is made of.

@lines@ and @blocks@ stand for what the two have to say differently: the lines of documents, and the blocks of pages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docloom.lineage import cut_lineage

_GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_MACROS = {
    "lines": {
        "spark": r"(select doc_id, cast(pos as bigint) as pos, line from (select doc_id, posexplode(split(text, '\n')) as (pos, line) from documents) where trim(line) <> '')",
        "duck": "(select doc_id, pos, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where trim(line) <> '')",
    },
    "blocks": {
        "spark": r"(select page_id, cast(pos as bigint) as pos, regexp_extract(block, '<([a-z0-9]+)>', 1) as tag, trim(regexp_replace(block, '<[^>]*>', '')) as text from (select page_id, posexplode(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)>[^<]*', 0)) as (pos, block) from pages))",
        "duck": "(select page_id, pos, regexp_extract(block, '<([a-z0-9]+)>', 1) as tag, trim(regexp_replace(block, '<[^>]*>', '', 'g')) as text from (select page_id, unnest(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)>[^<]*')) as block, generate_subscripts(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)>[^<]*'), 1) - 1 as pos from pages))",
    },
}

#: The lines of reports: d (document), n (place), page, r (place on the page), h (a number of its own), part (its beginning).
_ROWS = """(select 'd' || d as d, d as k, n, cast(floor(n / 8) as bigint) as page, n % 8 as r, d * 13 + n * 5 + length(line) as h, trim(substring(line, 1, 24)) as part
    from (select cast(floor(doc_id / 10) as bigint) as d, line, cast(row_number() over (partition by cast(floor(doc_id / 10) as bigint) order by doc_id, pos) as bigint) - 1 as n from @lines@))"""
#: The same as Spark is told it: of a line only its length and beginning go on, before lines are numbered, so no whole line is shuffled or sorted.
_SHORT_ROWS = """(select 'd' || d as d, d as k, n, cast(floor(n / 8) as bigint) as page, n % 8 as r, d * 13 + n * 5 + chars as h, part
    from (select d, chars, part, cast(row_number() over (partition by d order by doc_id, pos) as bigint) - 1 as n from (select cast(floor(doc_id / 10) as bigint) as d, doc_id, pos, length(line) as chars, trim(substring(line, 1, 24)) as part from @lines@)))"""
#: What a page shows, and by which number.
_SHOWS, _NUMBER = "(k + page) % 3", "(page % 5 + 1)"
_EVENTS = "(select event_id, user_id, event_type, ts, cast(floor(event_id / 9) as bigint) as g, event_id % 9 as i, cast(floor(value) as bigint) as v, length(props) as p from events)"


def _report(y1: str, y2: str) -> str:
    return f"(case {y1} end) / 100e0 as y1, (case {y2} end) / 100e0 as y2"


TABLES: dict[str, str] = {
    "fx_elements": f"""select 'e' || n as element_id, d as document_id, page as page_index, r as reading_order, element_type,
        case element_type when 'heading' then '1 ' || part when 'list' then '[' || (page + 1) || '] ' || part || ', Title, 20' || (10 + h % 10) || case when h % 2 = 0 then ';' else '' end
            when 'code' then case when r = 7 then 'def f' || (h % 3) || '(x):' || chr(10) || '    y = x' when h % 2 = 0 then '    return y' else 'class A:' end when 'table' then 'Year Share ' || part when 'figure' then null
            when 'caption' then case when {_SHOWS} = 0 then 'Table ' else 'Figure ' end || {_NUMBER} || ': ' || part when 'footnote' then case h % 3 when 0 then '* ' || part when 1 then 'Source: ' || part else part end
            else case r when 1 then case when h % 6 = 0 then 'Figure ' || (h % 5 + 1) || ' ' || part else 'As Figure ' || (h % 5 + 1) || ' shows, ' || part || ' and' end when 7 then 'the totals*, given in Table ' || (h % 5 + 1) || ' and' when 0 then case when h % 2 = 0 then 'table ' || (h % 5 + 1) || ', rise each year.' else part || '.' end else 'See Section 1. ' || part end end as text,
        (case when r in (4, 5) then 52 else 10 end) / 100e0 as x1, (case r when 0 then 5 when 1 then 13 when 2 then 32 when 3 then 56 when 4 then 32 + h % 3 when 5 then case when h % 4 = 1 then 33 else 56 + h % 3 end when 6 then 62 + h % 4 else 80 end) / 100e0 as y1,
        (case when r = 3 and k % 4 = 1 then 90 when r in (1, 2, 3) then 48 else 90 end) / 100e0 as x2, (case r when 0 then 12 when 1 then 30 when 2 then 55 when 3 then 60 when 4 then 55 when 5 then case when h % 4 = 1 then 56 else 61 end when 6 then 67 else 95 end) / 100e0 as y2, 's' || cast(floor(page / 2) as bigint) as section_id
        from (select *, case when n = 0 then 'heading' when r in (0, 7) then case k % 6 when 0 then 'list' when 1 then 'code' when 2 then 'table' else 'paragraph' end when r = 1 then 'paragraph' when r = 2 then case when {_SHOWS} = 0 then 'table' else 'figure' end when r = 3 then 'caption'
            when r = 4 then case when h % 3 = 0 then 'figure' when h % 3 = 1 then 'code' else 'paragraph' end when r = 5 then case h % 4 when 0 then 'caption' when 1 then 'code' else 'footnote' end else 'footnote' end as element_type from {_ROWS}) as typed""",
    "fx_pages": f"""select 'p' || page as page_id, d as document_id, page as page_index, case when (k + page) % 7 = 3 then null when page = 1 and k % 4 = 0 then 'ii' when k % 5 = 0 and (page % 4 in (1, 2)) then null else cast(page * (case when k % 5 = 0 then 2 else 1 end) + k % 3 as varchar(20)) end as label,
        case when (k + page) % 11 = 5 then 9e-1 else 5e-1 end as x from (select distinct d, k, page from {_ROWS}) as p""",
    "fx_labels": f"""select d as document_id, case when {_SHOWS} = 0 then 'table' else 'figure' end as kind, cast({_NUMBER} as varchar(20)) as number, 'e' || (n - 1) as target_id, cast(100 as bigint) as priority, page as page_index, 's' || cast(floor(page / 2) as bigint) as section_id from {_ROWS} as a where r = 3
        union all select d, case when {_SHOWS} = 0 then 'table' else 'figure' end, cast({_NUMBER} as varchar(20)), 'e' || n, cast(70 as bigint), page, 's' || cast(floor(page / 2) as bigint) from {_ROWS} as b where r = 3 and h % 2 = 0
        union all select d, 'section', '1', 'e0', cast(100 as bigint), page, 's0' from {_ROWS} as c where n = 0""",
    "fx_questions": f"""select 'u' || g as set_id, 'q' || i as question_id, i as position, case when event_type in ('click', 'view') then 'done' else 'open' end as status,
        case when i = 0 then '' when v % 11 = 0 then 'q' || i when v % 11 = 1 then 'q99' when v % 11 = 2 then 'q' || ((i + 1) % 9) when v % 3 = 0 then 'q' || (i - 1) when v % 3 = 1 and i > 1 then 'q' || (i - 1) || ',q' || (i - 2) else '' end as depends_on from {_EVENTS} as e""",
    "fx_observations": f"""select d || ':o' || n as observation_id, n as stored, d || ':e' || n as source_id, case h % 4 when 0 then 'Total costs were ' || h || ' in 2020' when 1 then 'Share of costs ' || part when 2 then part else 'Total ' || part end as claim from {_ROWS} as a where r in (1, 2, 7)""",
    "fx_evidence": f"select 'v' || event_id as evidence_id, 'd' || g || ':o' || v as observation_id, 'q' || (v % 12) as question_id from {_EVENTS} as e",
    "fx_relations": f"""select 'r' || n as relation_id, d as document_id, 'e' || n as source_id, case when r = 7 then 'e' || (n + 1) when r = 1 and h % 5 = 0 then 'e' || n when r = 1 then 'e99999' else 'e' || (n - 1) end as target_id, case r when 3 then 'caption_of' when 7 then 'continues' else 'contains' end as kind,
        case when h % 17 = 0 then 15e-1 else (50 + h % 50) / 100e0 end as confidence, cast(1 as bigint) as origin from {_ROWS} as a where r in (1, 3, 7)
        union all select 'r' || n, d, 'e' || n, 'e' || (n - 1 + h % 2), 'caption_of', (60 + h % 40) / 100e0, cast(2 as bigint) from {_ROWS} as b where r = 3 and h % 3 = 0
        union all select 'r' || n, d, 'e' || n, 'e' || (n + 1), 'continues', (50 + h % 50) / 100e0, cast(3 as bigint) from {_ROWS} as c where r = 7 and h % 3 = 0""",
    "fx_scores": f"""select 'c' || event_id as case_id, case v % 4 when 0 then 'Not answerable' else event_type end as gold, case when v % 7 = 3 then null when v % 7 = 4 then 'not answerable' when v % 7 = 5 then ' ' || upper(event_type) || '. ' when v % 7 = 6 then 'Straße' else event_type end as prediction,
        case when v % 7 = 3 then null when v % 5 = 0 then 'budget_exhausted' when v % 5 = 1 then 'stopped_incomplete' else 'ready' end as status from {_EVENTS} as e""",
    "fx_questions_text": """select 't' || item_id as question_id, case item_id % 5 when 0 then 'How many charts are in ' when 1 then 'What is the largest value in the table on page 3 of ' when 2 then 'Is the total of row 2 higher than of ' when 3 then 'List all colors in Figure 4 and ' else 'Who wrote ' end || text || case when item_id % 2 = 0 then '?' else '' end as text from benchmark""",
    "fx_headings": f"select d as doc, n as pos, h % 3 + 1 as level, part as title from {_ROWS} as a where r in (0, 5)",
    "fx_titles": f"""select d as doc, page, n as pos, case h % 12 when 0 then 'see www.example.com' when 1 then '+1 (555) 010-99' || (10 + h % 80) when 2 then '$' || h || '.5 million' when 3 then 'Step ' || (h % 7) || ' of ' || part when 4 then 'Sincerely, ' || part when 5 then 'This is how ' || part || '.' when 6 then 'Notes:' when 7 then 'Our View'
        when 8 then 'our  view' when 9 then 'Results' when 10 then '1 Scope' else part end as text, h % 9 = 0 as is_furniture, h % 5 = 0 as after_table from {_ROWS} as a where r in (0, 3, 6)""",
    "fx_references": f"select d as document_id, 'e' || (n - n % 16 + 2) as target_id, 's' || (h % 4) as section_id, (70 + h % 30) / 100e0 as confidence, h % 4 as pages, case when h % 3 = 0 then 'after' else 'before' end as side from {_ROWS} as a where r in (1, 4, 7)",
    "fx_calls": f"""select 'x' || (event_id - event_id % 2) as example_id, 'u' || user_id as session, event_id as step, case event_type when 'view' then 'SEARCH' when 'click' then 'READ_SOURCE' when 'purchase' then 'READ_SOURCE' when 'signup' then 'STOP' else 'SEARCH' end as action, case when event_type = 'signup' then null else 'e' || (v % 6) end as target,
        v % 9 <> 0 as valid, case when v % 9 = 0 then null else v % 4 <> 1 end as accepted from {_EVENTS} as e""",
    "fx_firings": f"select case when h % 4 = 0 then 'heading.style' when h % 4 = 1 then 'caption.nearest' else 'note.' || (h % 3) end as rule_id, d as document_id, 'e' || n as element_id, case when h % 5 < 3 then 'confirmed' else 'candidate' end as status from {_ROWS} as a",
    "fx_scopes": f"""select 'g' || event_id as question_id, case v % 8 when 0 then 'first 3 pages' when 1 then 'last ' || (v % 5 + 1) || ' pages' when 2 then 'pages 2-' || (v % 6 + 2) when 3 then 'pages 1, 3 and ' || (v % 9 + 1) when 4 then 'page ' || (v % 12) when 5 then 'whole document' when 6 then 'the appendix' else 'pages 2 to ' || (v % 9 + 2) end as scope, i + 3 as pages from {_EVENTS} as e""",
    "fx_deltas": f"select 's' || g as session, i as step, case when v % 5 < 3 then 'add' when v % 5 = 3 then 'replace' else 'remove' end as op, 'v' || (v % 3) as evidence_id, case when v % 5 = 4 then null else 'o' || (v % 6) end as observation_id from {_EVENTS} as e",
    # a row a line, two cells a row; the head spans both and some flags span two rows
    "fx_cells": """select 't' || l_orderkey as table_id, l_linenumber * 1 as r, cast(0 as bigint) as c, cast(1 as bigint) as rowspan, cast(1 as bigint) as colspan, l_returnflag || l_linestatus as text from (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_returnflag, l_linestatus, l_partkey from lineitem) as a
        union all select 't' || l_orderkey, l_linenumber * 1, cast(1 as bigint), case when l_partkey % 4 = 0 then cast(2 as bigint) else cast(1 as bigint) end, cast(1 as bigint), 'part ' || l_partkey from (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey from lineitem) as b
        union all select 't' || o_orderkey, cast(0 as bigint), cast(0 as bigint), cast(1 as bigint), cast(2 as bigint), o_orderpriority from orders""",
}


_WRITTEN = ("fx_elements", "fx_titles")


def _said(text: str, dialect: str) -> str:
    for name, by in _MACROS.items():
        text = text.replace(f"@{name}@", by[dialect])
    return text


def rows(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """What `source` selects, over the files of the given tables."""
    text = re.sub(rf"\b(from|join) ({'|'.join(_GIVEN)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", _said(source.replace(_ROWS, _SHORT_ROWS), "spark"))
    return spark.sql(text.replace("varchar(20)", "string"))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one whose columns take long expressions is written, so that filters on them do not repeat these."""
    found = rows(spark, sf_dir, TABLES[name])
    return cut_lineage(found) if name in _WRITTEN else found


def duck(source: str) -> str:
    """`source` as DuckDB has it."""
    return _said(source, "duck")


def cte(name: str) -> str:
    """name as (its SQL), for DuckDB."""
    return f"{name} as ({duck(TABLES[name])})"


#: Smaller tables that single queries take beside these; INLINE[name] is read as @name@ by select(), and by sub() for DuckDB.
INLINE: dict[str, str] = {
    # sections and captions
    "known_sections": f"select d as document_id, 'e' || n as element_id, 's' || cast(floor(page / 2) as bigint) as section_id from {_ROWS} as a where r = 7 and h % 3 > 0",
    "mentioned": f"select distinct d as document_id, case h % 4 when 0 then 'ii' when 1 then cast(page as varchar(20)) when 2 then cast(page + 2 as varchar(20)) else '99' end as label from {_ROWS} as a where r = 0",
    "primary": f"select d as document_id, 'e' || n as caption_id, 'e' || (n - 1) as target_id from {_ROWS} as a where r = 3",
    "anchored": f"select d as document_id, 'e' || n as footnote_id, case when h % 2 = 0 then 'e' || (n - 4) else 'e' || (n - 2) end as target_id from {_ROWS} as a where (r = 6 and h % 2 = 0) or (r = 5 and h % 4 > 1)",
    "declared": f"select d as document_id, 'e' || n as caption_id, case h % 5 when 0 then 'e' || (n + 1) when 1 then 'e99999' else 'e' || (n - 1) end as target_id from {_ROWS} as a where r = 3",
    "bars": f"select d as document_id, 'e' || n as element_id from {_ROWS} as a where r = 3 and h % 7 = 0",
    "panels": f"select d as document_id, 'e' || (n - n % 8 + 3) as caption_id, 'e' || n as member_id from {_ROWS} as a where r in (2, 4)",
    "placed": f"select d as document_id, 'e' || n as element_id, 's' || (h % 2) as section_id from {_ROWS} as a where r in (2, 4) and h % 3 > 0",
    # styles, titles and observations of pages
    "styled": f"""select d as document_id, page as page_index, case when h % 9 = 0 then null when h % 2 = 0 then 'Helv' else 'helv' end as font, case when h % 9 = 0 then null else (90 + h % 60) / 10e0 end as size, h % 3 = 0 as bold, h % 4 = 0 as upper_,
        (h % 30) / 10e0 as prominence, case when h % 5 = 0 then null else cast(r as bigint) end as level from {_ROWS} as a""",
    "headed": f"""select d as document_id, cast(case when n < 5 then 0 else 1 end as bigint) as page_index, n as reading_order, 'e' || n as element_id, case h % 5 when 0 then '1 Scope' when 1 then 'Abstract' else part end as text, (h % 30) / 10e0 as prominence,
        (10 + 9 * n + h % 20) / 100e0 as y1, (12 + 9 * n + h % 20 + h % 12) / 100e0 as y2 from {_ROWS} as a where n < 8""",
    "seen": f"select d as document_id, page as page_index, case h % 3 when 0 then cast(page as varchar(20)) when 1 then 'ii' else cast(h as varchar(20)) end as label, (h % 10) / 10e0 as confidence, (h % 100) / 100e0 as y from {_ROWS} as a where r in (0, 7)",
    "groups": f"select d as document_id, 'e' || n as element_id, 'gr' || cast(floor(page / 2) as bigint) as group_id from {_ROWS} as a where r in (0, 7) and k % 6 = 2",
    "assets": f"select d as document_id, 'e' || n as element_id, 'x' || (h % 50) as sha256, page as page_index from {_ROWS} as a where r in (2, 4) and h % 7 > 0",
    "visuals": f"select d as document_id, 'e' || n as element_id, case when h % 11 = 0 then null when h % 5 = 0 then 'y' || h else 'x' || (h % 50) end as sha256, page + case when h % 13 = 0 then 1 else 0 end as page_index from {_ROWS} as a where r in (2, 4) and h % 8 > 0",
    "starts": f"select d as document_id, 'e' || n as element_id, case when h % 2 = 0 then 'continues' else 'caption_of' end as kind from {_ROWS} as a where r in (2, 3, 7, 0)",
    "chain": f"select d as document_id, 'e' || n as source_id, 'e' || (n + 8) as target_id, (50 + h % 50) / 100e0 as confidence from {_ROWS} as a where r = 7",
    "anchors": f"select d as document_id, 'e' || n as element_id, 's' || cast(floor(page / 4) as bigint) as section_id from {_ROWS} as a where r = 7 and h % 3 = 0",
    "printed": f"""select d as document_id, page + case when h % 9 = 0 then 50 else 0 end as page_index, 'l' || n as line_id, case h % 4 when 0 then '  ' || part || ' ' when 1 then 'not in any text ' || h when 2 then ' ' else part end as text, 1e-1 as x1, (h % 90) / 100e0 as y1, 45e-2 as x2, (h % 90 + 2) / 100e0 as y2 from {_ROWS} as a""",
    # question sets and their documents
    "asked_pages": f"select 'q' || event_id as question_id, 'd' || (g % 90) as document_id, case v % 5 when 0 then '' when 1 then cast(v as varchar(20)) else v % 12 || ',' || i end as pages from {_EVENTS} as e",
    "page_counts": f"select d as document_id, cast(max(page) + 1 as int) as n_pages from {_ROWS} as a where k % 9 > 0 group by d",
    "files": f"select '/r/' || (h % 3) || '/' || case when h % 6 = 0 then upper(d) else d end || '/' || case when h % 5 = 0 then 'pages.jsonl' else 'document.json' end as path from {_ROWS} as a where n = 0 or (n = 1 and k % 4 = 0)",
    "gold": f"select 'q' || event_id as question_id, 'd' || (g % 120) as document_id, 'Why ' || v || '?' as question, event_type as answer from {_EVENTS} as e",
    "store": f"""select d as document_id, 'e' || n as element_id, case r when 2 then 'figure' when 3 then 'chart' when 4 then 'table' else 'paragraph' end as element_type, case h % 6 when 0 then null when 1 then 'a.JPG' when 2 then 'b.tiff' else 'c.png' end as asset, case when h % 5 = 0 then null else 'x' || (h % 20) end as sha256, h % 7 = 0 as duplicate from {_ROWS} as a where r > 1 and r < 6""",
    "decisions": f"""select 'm' || (user_id % 4) as model, 'u' || user_id as session, event_id - event_id % 2 as step, event_id % 2 + 1 as attempt, case when v % 3 = 0 then 'READ' else 'SEARCH' end as action, 'a' || (v % 2) as target, case when v % 4 = 0 then 'READ' else 'SEARCH' end as gold_action, 'a' || (v % 3) as gold_target, case when v % 9 = 0 then null else v % 5 > 0 end as valid from {_EVENTS} as e""",
    "bare": f"select d as document_id, page as page_index, n as block_index, 1e-1 as x1, (r * 11) / 100e0 as y1, 9e-1 as x2, (r * 11 + 9) / 100e0 as y2 from {_ROWS} as a where r in (2, 4)",
    "made": f"select d as document_id, page as page_index, '<table>' || n || '</table>' as html, (10 + h % 3) / 100e0 as x1, (r * 11 + h % 2) / 100e0 as y1, 9e-1 as x2, (r * 11 + 9) / 100e0 as y2 from {_ROWS} as a where r in (2, 4) and h % 3 > 0",
    "cells_asked": "select distinct 't' || l_orderkey as table_id, cast(l_linenumber as bigint) as row, l_partkey % 3 as col from lineitem where l_partkey % 5 = 0 union select 't' || o_orderkey, cast(0 as bigint), o_custkey % 4 from orders where o_custkey % 3 = 0",
    # labels and lookups
    "bound": f"select d as document_id, 'e' || n as caption_id, 'e' || (n - 1) as target_id from {_ROWS} as a where r = 3 and h % 4 > 0",
    "labels_asked": f"select d as document_id, 'a' || n as question_id, case h % 3 when 0 then 'table' when 1 then 'figure' else 'section' end as kind, h % 6 || case when h % 5 = 0 then 'b' else '' end as number from {_ROWS} as a where r = 1",
    "places_asked": f"select d as document_id, 'p' || n as question_id, case when h % 2 = 0 then 'figure' else 'table' end as kind, cast(case h % 5 when 0 then -1 when 1 then -2 when 2 then 9 else h % 4 + 1 end as bigint) as position from {_ROWS} as a where r = 1",
    "titles_asked": f"select d as document_id, 'u' || n as question_id, case h % 3 when 0 then part when 1 then substring(part, 1, 14) else 'nothing like it' end as title from {_ROWS} as a where r = 0",
    "section_titles": f"select d as document_id, 's' || n as section_id, part as title from {_ROWS} as a where r = 0",
    "matches": f"select 'u' || g as query_id, cast(event_id as int) as place, 'e' || (v % 4) as target_id from {_EVENTS} as e",
    # reading logs
    "new_questions": f"select 'u' || g as set_id, case when v % 4 = 0 then 'q' || (v % 9) else 'n' || event_id end as question_id, case v % 5 when 0 then '' when 1 then 'q77' when 2 then 'q' || i || ',q' || (v % 9) else 'q' || (v % 9) end as depends_on from {_EVENTS} as e where i % 3 = 0",
    "observed": f"select 's' || g as session, 'o' || i as observation_id from {_EVENTS} as e where v % 5 > 0",
    "assessed": f"select 's' || g as session, 'o' || case when v % 7 = 0 then 99 when v % 7 = 1 then 0 else i end as observation_id from {_EVENTS} as e",
    "decided": f"select 's' || g as session, cast(i as int) as step, case when v % 2 = 0 then 'add' else 'remove' end as op, 'L' || (v % 3) as local_id from {_EVENTS} as e",
    "shown_ids": f"select distinct 's' || g as session, cast(i as int) as step, 'L' || ((v + 1) % 3) as local_id, 'e' || (v % 40) as stable_id from {_EVENTS} as e",
    "log": f"""select 'u' || user_id as session, cast(event_id as int) as step, case when v % 13 = 0 then null when event_type = 'view' then 'SEARCH' when event_type = 'error' and v % 4 = 0 then 'STOP' when event_type = 'signup' and i = 0 then 'initialize' else 'READ_SOURCE' end as action,
        case when event_type = 'view' then null else 'e' || (v % 8) end as target, case when v % 6 = 0 then null when v % 2 = 0 then 'cost' else 'growth' end as query from {_EVENTS} as e""",
    "answers": f"select 's' || event_id as session, case when v % 4 = 0 then 'not_answerable' else 'answered' end as status, case v % 5 when 0 then null when 1 then ' ' else event_type end as answer, case v % 3 when 0 then '' when 1 then 'v1' else 'v1,v' || i end as cited from {_EVENTS} as e",
    "held": f"select 's' || event_id as session, 'v1' as evidence_id from {_EVENTS} as e where v % 7 > 0 union all select 's' || event_id, 'v2' from {_EVENTS} as f where v % 2 > 0",
    "cases": f"select 'c' || event_id as case_id, 'x' || v as sha256 from {_EVENTS} as e where v % 3 > 0",
    "outputs": f"select 'c' || event_id as case_id, case when v % 5 = 0 then 'y' else 'x' || v end as sha256, v % 7 > 0 as complete from {_EVENTS} as e where v % 4 > 0",
    "prompts": "select lang || ' ' || source as name, doc_id as version, text, doc_id % 3 > 0 as active from documents",
    "required": "select distinct source as name from documents where doc_id % 2 = 0",
    "bindings": "select source as name, case when min(doc_id) % 3 = 0 then ' ' else 'v' || min(doc_id) end as value from documents where doc_id % 7 > 0 group by source union all select 'label ' || label, 'w' from embeddings group by label",
    # sessions and previews
    "units": f"""select d as document_id, 'e' || n as element_id, cast(page as int) as page_index, case r when 0 then 'heading' when 2 then 'figure' when 4 then 'table' else 'paragraph' end as element_type, case h % 4 when 0 then part || '  ' || chr(10) || chr(10) || ' so. ' when 1 then null else part end as text,
        case when r = 4 and h % 2 = 0 then '<table><tr><td>a</td><td>b</td></tr></table>' end as html, case when r in (2, 4) then 'Figure ' || (h % 5) end as label, h % 3 = 0 as generated, 's' || cast(floor(page / 2) as bigint) as section_id from {_ROWS} as a""",
    "paths": f"select d as document_id, 's' || cast(floor(page / 2) as bigint) as section_id, max('Intro>' || part) as path from {_ROWS} as a where r = 0 and page % 2 = 0 and k % 5 > 0 group by d, cast(floor(page / 2) as bigint)",
    "pages_known": f"select distinct d as document_id, cast(page as int) as page_index from {_ROWS} as a",
    "texts": f"select n + 10000 * k as id, case h % 4 when 0 then '中文字 ' || part when 1 then 'Straße A-1.b ' || part || '日本' when 2 then '' else part end as line from {_ROWS} as a",
    "results": f"select 'u' || g as session, case i when 0 then 'bm25' when 1 then 'dense' else 'exact' end as route, 'q' || cast(floor(v / 40) as bigint) as question_id, 'd' || cast(floor(g / 50) as bigint) as document_id, case when v % 9 = 0 then null else 'v1' end as index_version from {_EVENTS} as e where i < 3",
    "candidates": f"select 'e' || n as element_id, d as document_id, page + h % 2 as page_index, case when h % 3 = 0 then 'table' else 'figure' end as element_type from {_ROWS} as a where r in (2, 4)",
    "known_elements": f"select 'e' || n as element_id, d as document_id, page as page_index, case when h % 4 = 0 then 'chart' when h % 3 = 0 then 'table' else 'figure' end as element_type from {_ROWS} as a where r in (2, 4) and h % 7 > 0",
    "table_rows": """select 'q' || o_orderkey as query_id, 't' || o_custkey as table_id, cast(0 as int) as r, case when o_custkey % 3 = 0 then 'Year|Cost|' || o_orderstatus else 'Year|Cost' end as line, o_custkey % 4 > 0 as header, cast(0 as int) as relevance from orders
        union all select 'q' || l_orderkey, 't' || o_custkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int), l_returnflag || '|  ' || l_partkey || case when l_partkey % 5 = 0 then '|' || l_linestatus else '' end, false, cast(l_partkey % 4 as int) from lineitem join orders on l_orderkey = o_orderkey""",
    "scopes": f"select 'u' || user_id as query_id, case when v % 2 = 0 then 'bm25' else 'dense' end as route, cast(i + 1 as int) as rank, case v % 3 when 0 then 'content' when 1 then 'metadata' else 'mixed' end as scope from {_EVENTS} as e",
    "shares": f"select event_id as id, case v % 5 when 0 then null when 1 then 'unknown' when 2 then 'metadata' when 3 then 'mixed' else 'content' end as bm25, case i % 5 when 0 then null when 1 then 'metadata' when 2 then 'mixed' else 'content' end as dense, case when v % 5 = 0 then null else (v % 10) / 10e0 end as bs, case when i % 5 = 0 then null else (p * 7 + v % 9) / 10e0 end as ds from {_EVENTS} as e",
    "ranges": f"select g as id, case when v % 6 = 0 then null else cast(v % 8 as int) end as start, case when v % 6 = 0 then null else cast(v % 8 + i % 4 as int) end as stop from {_EVENTS} as e where i < 4",
    "actions": f"select 'a' || event_id as action_id, 'u' || g as session, cast(i as int) as step, case when v % 2 = 0 then 'e' || i || ',e' || (v % 7) else 'e' || (v % 7) end as ids from {_EVENTS} as e",
    "visible_ids": f"select 'u' || g as session, cast(i as int) as step, 'e' || i as id from {_EVENTS} as e union all select 'u' || g, cast(i as int), 'e' || ((v + 1) % 7) from {_EVENTS} as f",
}


def select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over INLINE's tables, named as @name@."""
    for name, body in INLINE.items():
        text = text.replace(f"@{name}@", f"({body}) as v")
    return rows(spark, sf_dir, text)


def sub(name: str, alias: str = "v") -> str:
    """An INLINE table as DuckDB has it."""
    return f"({duck(INLINE[name])}) {alias}"
