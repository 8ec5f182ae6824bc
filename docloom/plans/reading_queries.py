"""The reading log, over literal tables and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import reading as R
from docloom.plans.evidence_queries import _DEPTHS, _EDGES
from docloom.plans.derived import cte, frame, select, sub
from docloom.plans.registry import query, read


@query(f"with {_EDGES}, b as (select e.set_id, e.question_id from e left join fx_questions q on e.set_id = q.set_id and e.needs = q.question_id where q.status is null or q.status <> 'done') select set_id, arg_min(question_id, position) as target_id from fx_questions where status <> 'done' and (set_id, question_id) not in (select (set_id, question_id) from b) group by set_id")
def first_targets_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_targets(frame(spark, sf_dir, "fx_questions"))


_NEW = sub("new_questions", "v")


@query(f"""with recursive {_EDGES}, n as (select * from {_NEW}), {_DEPTHS},
    x as (select set_id, question_id, unnest(list_filter(string_split(depends_on, ','), lambda v: v <> '')) as needs from n), size as (select set_id, count(*) as c from ids group by set_id)
    select n.set_id, n.question_id, case when (n.set_id, n.question_id) in (select (set_id, question_id) from ids) then 'known_id' when exists (select 1 from x where x.set_id = n.set_id and x.question_id = n.question_id and (x.set_id, x.needs) not in (select (set_id, question_id) from ids)) then 'unknown_dependency'
        when coalesce(size.c, 0) >= 9 then 'too_many' when 1 + coalesce((select max(depth) from x join deep d on d.set_id = x.set_id and d.question_id = x.needs where x.set_id = n.set_id and x.question_id = n.question_id), 0) > 4 then 'too_deep' end as reason from n left join size on size.set_id = n.set_id""")
def deferred_questions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.register(frame(spark, sf_dir, "fx_questions"), select(spark, sf_dir, "select * from @new_questions@"), 9, 4)


_OBSERVED = sub("observed", "v")
_ASSESSED = sub("assessed", "v")


@query(f"with o as (select * from {_OBSERVED}), n as (select session, observation_id, count(*) as n from {_ASSESSED} group by all), m as (select session, observation_id, case when o.session is null then 'unknown_observation' when n is null then 'not_assessed' when n > 1 then 'assessed_twice' end as error from (select *, session as s from o) o full join n using (session, observation_id)) select * from m where error is not null".replace("case when o.session is null", "case when s is null"))
def assessment_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assessment_errors(select(spark, sf_dir, "select * from @observed@"), select(spark, sf_dir, "select * from @assessed@"))


_DECIDED = sub("decided", "v")
_SHOWN = sub("shown_ids", "v")


@query(f"select d.session, d.step, op, d.local_id, stable_id from (select * from {_DECIDED}) d left join (select * from {_SHOWN}) s on s.session = d.session and s.step = d.step and s.local_id = d.local_id")
def grounded_decisions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grounded(select(spark, sf_dir, "select * from @decided@"), select(spark, sf_dir, "select * from @shown_ids@"))


_LOG = sub("log", "v")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, "select * from @log@")


@query(f"""with l as (select * from {_LOG} where action is not null), b as (select *, row_number() over (partition by session order by step desc) as age from l), a as (select session, string_agg(action, ',' order by age) as actions from b where age <= 3 group by session),
    q as (select session, query, max(step) as step from l where query is not null group by all), r as (select *, row_number() over (partition by session order by step desc) as age from q), s as (select session, string_agg(query, ',' order by age) as queries from r where age <= 3 group by session), f as (select session, arg_max(target, step) as focus from l where action = 'READ_SOURCE' group by session)
    select session, actions, queries, focus from a left join s using (session) left join f using (session)""")
def exploration_view_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exploration(_log(spark, sf_dir))


@query(f"""with l as (select *, max((action = 'SEARCH')::int) over w as searched, max((action = 'STOP')::int) over w as stopped from {_LOG} where action is not null window w as (partition by session order by step rows between unbounded preceding and 1 preceding)),
    e as (select session, step, case when stopped = 1 then 'after_stop' when action = 'NEXT_BATCH' and coalesce(searched, 0) = 0 then 'no_search' when action in ('READ_SOURCE', 'FOLLOW_RELATION') and target is null then 'no_target' when action = 'SEARCH' and trim(coalesce(query, '')) = '' then 'no_query'
        when action not in ('SEARCH', 'NEXT_BATCH', 'READ_SOURCE', 'FOLLOW_RELATION', 'READ_ADJACENT_PAGE', 'READ_PAGE_CONTEXT', 'STOP', 'initialize', 'recheck', 'finalize') then 'unknown_action' end as error from l) select * from e where error is not null""")
def action_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.action_errors(_log(spark, sf_dir))


@query(f"with r as (select *, row_number() over (partition by session, target, coalesce(query, '') order by step) as k from {_LOG} where action = 'READ_SOURCE') select session, step, target from r where k = 1")
def first_reads_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_reads(_log(spark, sf_dir))


@query(f"""with {cte('fx_elements')}, {cte('fx_cells')}, l as (select case table_id when 't1' then 'dA' else 'dB' end as document_id, case table_id when 't1' then 'e11' else 'g07' end as element_id, string_agg('r' || r || 'c' || c || ': ' || text, chr(10) order by r, c, 'r' || r || 'c' || c || ': ' || text) as lines from fx_cells group by all),
    x as (select e.document_id, e.element_id, element_type, case when element_type = 'table' then coalesce(lines, text) when element_type not in ('figure', 'chart') then text end as content from fx_elements e left join l on l.document_id = e.document_id and l.element_id = e.element_id)
    select document_id, element_id, content, case when coalesce(content, '') = '' then case when element_type in ('figure', 'chart') then 'visual_needs_a_reader' else 'nothing_to_read' end end as limitation from x""")
def read_elements_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("table_id") == "t1"
    cells = frame(spark, sf_dir, "fx_cells").select(F.when(first, "dA").otherwise("dB").alias("document_id"), F.when(first, "e11").otherwise("g07").alias("element_id"), "r", "c", "text")
    return R.read_elements(frame(spark, sf_dir, "fx_elements"), cells)


@query("""with s as (select user_id as session, count(*) filter (event_type not in ('initialize', 'recheck', 'finalize')) as spent, max(event_id) as last_step, arg_max(event_type, event_id) as last from events group by user_id)
    select session, last_step, 25 - spent as "left", last not in ('STOP', 'finalize') and 25 - spent > 0 as resumes from s""")
def resumed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("action"))
    return R.resumed(log, 20, 5)


_ANSWERS = sub("answers", "v")
_HELD = sub("held", "v")


@query(f"""with a as (select *, list_filter(string_split(cited, ','), lambda x: x <> '') as ids from {_ANSWERS}), u as (select session, unnest(ids) as id from a)
    select distinct session, 'unknown_evidence' as error from u where (session, id) not in (select (session, evidence_id) from {_HELD}) union all select session, 'nothing_cited' from a where status = 'answered' and len(ids) = 0 union all select session, 'no_answer' from a where status = 'answered' and coalesce(trim(answer), '') = '' union all select session, 'answer_without_status' from a where status <> 'answered' and coalesce(trim(answer), '') <> ''""")
def answer_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.answer_errors(select(spark, sf_dir, "select session, status, answer, filter(split(cited, ','), x -> x <> '') as cited from @answers@"), select(spark, sf_dir, "select * from @held@"))


@query("with p as (select doc_id as document_id, unnest(range(0, 1 + n_chars // 2000)) as page_index from documents) select document_id, page_index, (row_number() over (partition by document_id order by page_index) - 1) // 5 as batch from p")
def scan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 2000))).alias("page_index"))
    return R.scan_batches(pages)


@query("""with x as (select doc_id, text, greatest(instr(lower(text), 'the') - 1, 0) as p from documents), y as (select *, greatest(0, least(p - 58, length(text) - 120))::int as b from x)
    select doc_id, case when length(text) <= 120 then text else (case when b > 0 then '...' else '' end) || substring(text, b + 1, 120) || (case when b + 120 < length(text) then '...' else '' end) end as preview from y""")
def centred_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the first "the" of each document."""
    return read(spark, sf_dir, "documents").select("doc_id", R.centred(F.col("text"), F.lit("the"), 120).alias("preview"))


_CASES = sub("cases", "v")
_OUTPUTS = sub("outputs", "v")


@query(f"with m as (select c.case_id, case when o.complete is null then 'missing' when o.sha256 is distinct from c.sha256 then 'other_input' when not o.complete then 'incomplete' end as reason from (select * from {_CASES}) c left join (select * from {_OUTPUTS}) o on o.case_id = c.case_id) select * from m where reason is not null")
def open_cases_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.open_cases(select(spark, sf_dir, "select * from @cases@"), select(spark, sf_dir, "select * from @outputs@"))


_PROMPTS = sub("prompts", "v")


@query(f"select name, version, sha256(text) as sha256 from {_PROMPTS} where active")
def prompt_manifest_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.manifest(select(spark, sf_dir, "select * from @prompts@"))


_REQUIRED, _BINDINGS = sub("required"), sub("bindings")


@query(f"with m as (select name, case when wanted is null then 'unknown_binding' when coalesce(trim(value), '') = '' then 'missing_binding' end as error from (select name, true as wanted from {_REQUIRED}) r full join (select * from {_BINDINGS}) b using (name)) select * from m where error is not null")
def snapshot_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.snapshot_errors(select(spark, sf_dir, "select * from @required@"), select(spark, sf_dir, "select * from @bindings@"))
