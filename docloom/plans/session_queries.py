"""Search units, sessions and previews, over literal tables and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import audit as A
from docloom.operators import retrieval as R
from docloom.operators import session as S
from docloom.plans.derived import select, sub
from docloom.plans.registry import query, read
from docloom.plans.retrieval_queries import _TWO, SQL_RANKINGS, _rankings, _sql_rrf

_UNITS = sub("units", "u")
_PATHS = sub("paths", "p")
_PAGES = sub("pages_known", "g")
_NORM = "array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '  +', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
_BOTH = "array_to_string(list_filter([{a}, {b}], lambda x: x <> ''), chr(10))"


@query(f"""with u as (select *, {_NORM.format(c='text')} as t, {_NORM.format(c='label')} as l, case when html <> '' then 'a' || chr(9) || 'b' else '' end as h from {_UNITS}),
    c as (select u.*, p.path, g.document_id is not null as paged, case when element_type in ('figure', 'chart') and generated then l when element_type in ('figure', 'chart') then {_BOTH.format(a='l', b='t')} when element_type = 'table' then case when coalesce(h, '') || t <> '' then {_BOTH.format(a="coalesce(h, '')", b='t')} else l end else t end as content
        from u left join {_PATHS} using (document_id, section_id) left join {_PAGES} on g.document_id = u.document_id and g.page_index = u.page_index),
    s as (select *, case when not paged then 'missing_page' when element_type in ('figure', 'chart') and generated and content = '' then 'unverified_generated_visual_text' when element_type in ('figure', 'chart') and content = '' then 'no_searchable_visual_text' when content = '' then 'empty_searchable_content' end as skipped,
        list_append(coalesce(string_split(path, '>'), []), content) as parts from c),
    o as (select *, list_filter(parts, lambda x, i: i = 1 or lower(x) <> lower(parts[i - 1])) as kept from s)
    select document_id, element_id, content, case when skipped is null then array_to_string(kept, chr(10)) end as search_text, skipped from o""")
def search_unit_texts_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched of each element, and why some are left out."""
    units = select(spark, sf_dir, "select * from @units@").withColumn("page_index", F.col("page_index").cast("long"))
    paths = select(spark, sf_dir, "select document_id, section_id, split(path, '>') as path from @paths@")
    return S.search_texts(units, paths, select(spark, sf_dir, "select * from @pages_known@"))


_LINES = sub("texts", "v")


@query(f"""with c as (select id, i, substring(line, i, 2) as two from {_LINES}, range(1, 40) r(i) where i < length(line)), p as (select id, list(two order by i) as pairs from c where regexp_matches(two, '^[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]{{2}}$') group by id)
    select v.id, array_to_string(list_concat(list_transform(regexp_extract_all(line, '{T.TOKEN}'), lambda x: replace(lower(x), 'ß', 'ss')), coalesce(pairs, [])), ' ') as terms from {_LINES} left join p on p.id = v.id""")
def search_terms_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and pairs of CJK characters."""
    return select(spark, sf_dir, "select * from @texts@").select("id", F.array_join(T.search_terms(F.col("line")), " ").alias("terms"))


_KEY = """substring(sha256('["' || query_id || '","' || element_id || '"]'), 1, 12)"""


@query(f"""with {SQL_RANKINGS}, t as (select query_id, element_id, 'text' as route, row_number() over (partition by query_id order by rank, element_id) as k from r where route = 'bm25'),
    v as (select query_id, element_id, 'visual' as route, row_number() over (partition by query_id order by rank, element_id) as k from r where route = 'visual' and (query_id, element_id) not in (select (query_id, element_id) from t)),
    u as (select query_id, element_id, route, (k - 1) // 3 as batch from t union all select query_id, element_id, route, (k - 1) // 2 from v)
    select query_id, element_id, route, batch, row_number() over (partition by query_id, batch order by {_KEY}, element_id) as place from u""")
def text_visual_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rankings(spark, sf_dir)
    return S.text_visual_quota(rows.where("route = 'bm25'"), rows.where("route = 'visual'"))


@query(f"""with {SQL_RANKINGS}, {_sql_rrf(_TWO)}, b as (select query_id, element_id, min(rank * 10 + case route when 'bm25' then 1 else 2 end) as turn from r where route in ('bm25', 'dense') group by all),
    a as (select 'rrf' as policy, query_id, element_id, position from g union all select 'round_robin', query_id, element_id, row_number() over (partition by query_id order by turn, element_id) from b union all select 'dense', query_id, element_id, rank from r where route = 'dense')
    select policy, query_id, element_id, position, 0 as batch from a where position <= 5""")
def session_first_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch of each query by each policy."""
    rows = _rankings(spark, sf_dir)
    parts = [S.start(rows, p, _TWO).select(F.lit(p).alias("policy"), "query_id", "element_id", F.col("position").cast("long").alias("position"), "batch") for p in ("rrf", "round_robin", "dense")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RESULTS = sub("results", "v")


@query(f"""with x as (select session, 'question_id' as field, question_id as v from {_RESULTS} union all select session, 'document_id', document_id from {_RESULTS} union all select session, 'index_version', index_version from {_RESULTS})
    select session, field, string_agg(distinct coalesce(v, 'null'), ',' order by coalesce(v, 'null')) as "values" from x group by all having count(distinct coalesce(v, 'null')) > 1""")
def session_identity_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.identity_errors(select(spark, sf_dir, "select * from @results@"))


_CANDIDATES = sub("candidates", "v")
_KNOWN = sub("known_elements", "v")


@query(f"""with k as (select *, true as known from {_KNOWN}), m as (select c.*, k.known, k.page_index as kp, k.element_type as kt from (select * from {_CANDIDATES}) c left join k using (document_id, element_id))
    select document_id, element_id, 'unknown_unit' as error from m where known is null union all select document_id, element_id, 'other_page_index' from m where kp <> page_index union all select document_id, element_id, 'other_element_type' from m where kt <> element_type""")
def candidate_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.candidate_errors(select(spark, sf_dir, "select * from @candidates@"), select(spark, sf_dir, "select * from @known_elements@"))


_ROWS = sub("table_rows", "v")


@query(f"""with v as (select * replace (array_to_string(list_transform(string_split(line, '|'), lambda x: trim(x)), ' | ') as line), string_split(line, '|')[1] as label, len(string_split(line, '|')) as n from {_ROWS}),
    h as (select query_id, table_id, arg_min(line, r) as header, arg_min(n, r) as hn from v where header group by all), b as (select *, lag(line) over w as before, lead(line) over w as after from v where not header window w as (partition by query_id, table_id order by r)),
    k as (select *, row_number() over (partition by query_id, table_id order by relevance desc, r) as k from b), o as (select * from k where k = 1)
    select o.query_id, o.table_id, h.header, o.r as row, o.before, o.line as best, o.after, coalesce((select array_to_string((list(label order by r))[1:6], ', ') from b where b.query_id = o.query_id and b.table_id = o.table_id and abs(b.r - o.r) > 1), '') as others,
        coalesce((select bool_and(b.n = h.hn) from b where b.query_id = o.query_id and b.table_id = o.table_id), true) as aligned from o left join h on h.query_id = o.query_id and h.table_id = o.table_id""")
def table_preview_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, best row and its neighbours of each table."""
    return S.table_preview(select(spark, sf_dir, "select query_id, table_id, r, split(line, '\\\\|') as cells, header, relevance from @table_rows@"))


@query(f"""with t as (select *, max(relevance) over (partition by query_id, table_id) as top from {_ROWS} where relevance > 0), k as (select *, row_number() over (partition by query_id, table_id order by r) as place from t where relevance = top) select query_id, table_id, r, line, relevance as overlap, place from k where place <= 3""")
def row_hints_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.row_hints(select(spark, sf_dir, "select query_id, table_id, r, line, relevance as overlap from @table_rows@")).select("query_id", "table_id", "r", "line", "overlap", F.col("place").cast("long").alias("place"))


_SCOPES = sub("scopes", "v")


@query(f"select route, count(*) as shown, count(*) filter (scope = 'metadata') as metadata, count(distinct query_id) filter (scope = 'metadata') as queries from {_SCOPES} where rank <= 5 group by route")
def scope_audit_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scope_audit(select(spark, sf_dir, "select * from @scopes@"))


_SHARES = sub("shares", "v")


@query(f"select id, case when coalesce(bm25 in ('content', 'mixed'), false) and not coalesce(dense in ('content', 'mixed'), false) then 'bm25' when coalesce(dense in ('content', 'mixed'), false) and not coalesce(bm25 in ('content', 'mixed'), false) then 'dense' when ds > bs then 'dense' else 'bm25' end as route from {_SHARES}")
def preview_routes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, "select * from @shares@").select("id", A.preview_route(F.col("bm25"), F.col("dense"), F.col("bs"), F.col("ds")).alias("route"))


_RANGES = sub("ranges", "v")


@query(f"with v as (select id, start >= 4 and stop <= 9 as inside from {_RANGES}) select id, case when count(inside) = 0 then 'unknown' when bool_and(inside) then 'content' when bool_or(inside) then 'mixed' else 'metadata' end as scope from v group by id")
def match_scopes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select(spark, sf_dir, "select id, collect_list(case when start is not null then struct(start, stop) end) as ranges from @ranges@ group by id")
    return rows.select("id", A.match_scope(F.col("ranges"), F.lit(4), F.lit(9)).alias("scope"))


_ACTIONS = sub("actions", "v")
_VISIBLE = sub("visible_ids", "v")


@query(f"with a as (select action_id, session, step, unnest(string_split(ids, ',')) as id from {_ACTIONS}) select action_id, id from a where (session, step, id) not in (select (session, step, id) from {_VISIBLE})")
def visible_id_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.visible_errors(select(spark, sf_dir, "select action_id, session, step, split(ids, ',') as ids from @actions@"), select(spark, sf_dir, "select * from @visible_ids@"))


@query("select label as sha256, vec_id as shard, len(embedding) as dimensions from (select *, row_number() over (partition by label order by vec_id desc) as k from embeddings where label % 3 = 0) where k = 1")
def required_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vectors of each asked label the one of the last shard."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("sha256"), F.col("vec_id").alias("shard"), "embedding")
    asked = rows.where("sha256 % 3 = 0").select("sha256")
    return R.required_vectors(rows, asked).select("sha256", "shard", F.size("embedding").cast("long").alias("dimensions"))


@query(f"with {SQL_RANKINGS}, {_sql_rrf(_TWO)} select query_id, element_id, page_number, position from g where position <= 5")
def visible_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy may see of each query's first batch."""
    return R.visible(R.rrf(_rankings(spark, sf_dir), _TWO)).where("position <= 5").withColumn("position", F.col("position").cast("long"))
