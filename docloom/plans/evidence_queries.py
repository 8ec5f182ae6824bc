"""Evidence, scoring, audit and text-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import evidence as V
from docloom.operators.elements import elements
from docloom.operators.search import holding
from docloom.plans.derived import cte, frame
from docloom.plans.registry import query, read
from docloom.plans.retrieval_queries import SQL_ELEMENTS

_EDGES = f"{cte('fx_questions')}, e as (select set_id, question_id, unnest(list_filter(string_split(depends_on, ','), lambda x: x <> '')) as needs from fx_questions), ids as (select set_id, question_id from fx_questions)"


#: What a question needs by way of others, and the depth of questions that need no cycle: 1 without known needs.
_DEPTHS = """k as (select * from e where (set_id, needs) in (select (set_id, question_id) from ids)),
    far as (select set_id, question_id, needs from k union select f.set_id, f.question_id, k.needs from far f join k on k.set_id = f.set_id and k.question_id = f.needs),
    bad as (select set_id, question_id from far where (set_id, needs) in (select (set_id, question_id) from far where question_id = needs)),
    deep as (select set_id, question_id, 1 as depth from ids where (set_id, question_id) not in (select (set_id, question_id) from k) union select k.set_id, k.question_id, d.depth + 1 from deep d join k on k.set_id = d.set_id and k.needs = d.question_id where (k.set_id, k.question_id) not in (select (set_id, question_id) from bad))"""


@query(f"""with recursive {_EDGES}, {_DEPTHS}, o as (select * from e where question_id <> needs), reach as (select set_id, question_id, needs from o union select r.set_id, r.question_id, o.needs from reach r join o on o.set_id = r.set_id and o.question_id = r.needs)
    select distinct set_id, question_id, 'unknown_dependency' as error from e where (set_id, needs) not in (select (set_id, question_id) from ids) union all select set_id, question_id, 'self_dependency' from e where question_id = needs union all select distinct set_id, question_id, 'cycle' from reach where question_id = needs
    union all select set_id, question_id, 'too_many' from (select set_id, question_id, row_number() over (partition by set_id order by position) as k from fx_questions) where k > 8
    union all select set_id, question_id, 'too_deep' from deep group by all having max(depth) > 4""")
def question_graph_errors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.graph_errors(frame(spark, sf_dir, "fx_questions"), 8, 4)


@query(f"with {_EDGES}, b as (select e.set_id, e.question_id from e left join fx_questions q on e.set_id = q.set_id and e.needs = q.question_id where q.status is null or q.status <> 'done') select set_id, question_id, row_number() over (partition by set_id order by position) as turn from fx_questions where status <> 'done' and (set_id, question_id) not in (select (set_id, question_id) from b)")
def runnable_questions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.runnable(frame(spark, sf_dir, "fx_questions")).select("set_id", "question_id", F.col("turn").cast("long").alias("turn"))


_STOPPED = "['the', 'a', 'an', 'of', 'in', 'and', 'or', 'to', 'is', 'are', 'was', 'were', 'what', 'which', 'how', 'many', 'for', 'on', 'by', 'with']"
_RECALLED = "list_filter(list_distinct(list_transform(regexp_extract_all({c}, '[0-9]+(?:[.,][0-9]+)*%?|[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))), lambda x: not list_contains(" + _STOPPED + ", x))"


@query(f"""with {cte('fx_observations')}, q as (select {_RECALLED.format(c="'What were total costs in 2020?'")} as t), o as (select source_id, claim, min(stored) as stored, arg_min(observation_id, stored) as observation_id from fx_observations group by all),
    s as (select o.*, list_intersect({_RECALLED.format(c='claim')}, t) as both_ from o, q), r as (select *, 4 * len(both_) + 3 * len(list_filter(both_, lambda x: regexp_matches(x, '^[0-9]'))) as score from s)
    select observation_id, score from r where score > 0 order by score desc, stored, observation_id limit 3""")
def recall_top3_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recall(frame(spark, sf_dir, "fx_observations"), "What were total costs in 2020?").select("observation_id", "score")


@query(f"""with {cte('fx_evidence')}, {cte('fx_observations')}, {cte('fx_questions')} select evidence_id, 'unknown_observation' as error from fx_evidence where observation_id not in (select observation_id from fx_observations)
    union all select evidence_id, 'unknown_question' from fx_evidence where question_id not in (select question_id from fx_questions)""")
def evidence_references_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.missing_references(frame(spark, sf_dir, "fx_evidence"), frame(spark, sf_dir, "fx_observations"), frame(spark, sf_dir, "fx_questions"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as the action log of a session."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("action"))


@query("select session, step, action, age from (select user_id as session, event_id as step, event_type as action, row_number() over (partition by user_id order by event_id desc) as age from events) where age <= 5")
def last_five_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.last_actions(_log(spark, sf_dir), 5).select("session", "step", "action", F.col("age").cast("long").alias("age"))


@query("""with s as (select user_id as session, count(*) filter (event_type not in ('initialize', 'recheck', 'finalize')) as spent, arg_max(event_type, event_id) as last from events group by user_id)
    select session, spent, last, case when last = 'finalize' then 'ready' when spent >= 20 then 'budget_exhausted' else 'open' end as status from s""")
def action_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.budget(_log(spark, sf_dir), 20)


@query("select session, step, action from (select user_id as session, event_id as step, event_type as action, lag(event_type) over (partition by user_id order by event_id) as before from events) where action = before")
def repeated_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.repeats(_log(spark, sf_dir))


_CLEAN = "regexp_replace(regexp_replace(replace(lower(trim({c})), 'ß', 'ss'), '\\s+', ' ', 'g'), '[. ]+$', '')"
_NA = "(" + _CLEAN + " in ('not answerable', 'unanswerable', 'none', 'n/a', ''))"


@query(f"""with {cte('fx_scores')}, s as (select *, coalesce(case when {_NA.format(c='gold')} then {_NA.format(c='prediction')} else {_CLEAN.format(c='gold')} = {_CLEAN.format(c='prediction')} end, false) as ok, coalesce(not {_NA.format(c='prediction')}, false) as ans, not {_NA.format(c='gold')} as able from fx_scores),
    a as (select count(*) as cases, count(*) filter (ok) as correct, count(*) filter (ok and able) as hits, count(*) filter (ans) as answered, count(*) filter (able) as answerable, count(*) filter (status = 'ready') as ready, count(*) filter (ok and status = 'ready') as ready_correct from s),
    r as (select *, correct / cases as accuracy, hits / answered as precision, hits / answerable as recall, ready_correct / ready as ready_accuracy from a) select *, 2 * precision * recall / (precision + recall) as f1 from r""")
def answer_scores_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answer_scores(frame(spark, sf_dir, "fx_scores"))


@query(f"with {cte('fx_scores')} select case_id, {_CLEAN.format(c='gold')} as gold, {_CLEAN.format(c='prediction')} as prediction from fx_scores")
def answer_cleaning_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "fx_scores").select("case_id", T.clean_answer(F.col("gold")).alias("gold"), T.clean_answer(F.col("prediction")).alias("prediction"))


@query("""with r as (select source, n_chars, row_number() over (partition by source order by n_chars) as rn, count(*) over (partition by source) as n from documents)
    select source, n_chars as percentile from r where rn = round_even((n - 1) * 0.95, 0) + 1""")
def length_p95_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.percentile_at(read(spark, sf_dir, "documents"), "source", "n_chars", 0.95)


@query("""select conv_id as "group", sum((role = 'user')::int)::bigint as matched, min((text is not null)::int) as complete, list_transform(list_sort(list_distinct(list({'b': f, 'v': role}))), lambda x: x.v) as "values"
    from (select *, min(turn) over (partition by conv_id, role) as f from conversations) group by conv_id""")
def coverage_fold_over_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("batch"), (F.col("role") == "user").cast("int").alias("matched"), F.col("text").isNotNull().cast("int").alias("complete"), F.col("role").alias("value"))
    return V.coverage_fold(rows)


_POINT = "(('0x' || substring(md5('split:' || {c}), 1, 8))::bigint % 10000)"


@query(f"select doc_id, case when p < 7000 then 'train' when p < 8500 then 'dev' else 'test' end as split from (select doc_id, {_POINT.format(c='doc_id')} as p from documents)")
def document_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to splits by the hash of their id."""
    return read(spark, sf_dir, "documents").select("doc_id", V.split_of(F.col("doc_id"), {"train": 0.7, "dev": 0.15, "test": 0.15}).alias("split"))


@query(f"""with s as (select doc_id, source, case when p < 7000 then 'train' when p < 8500 then 'dev' else 'test' end as split from (select doc_id, source, {_POINT.format(c='doc_id')} as p from documents)),
    l(split, least) as (values ('train', 1), ('dev', 1), ('test', 1), ('extra', 1)), n as (select split, count(*) as documents from s group by split)
    select 'too_small' as error, l.split as subject, coalesce(documents, 0) as n from l left join n using (split) where coalesce(documents, 0) < least
    union all select 'shared_key', source, count(distinct split) from s group by source having count(distinct split) > 1""")
def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents fall into several splits, and splits that are wanted but empty."""
    rows = read(spark, sf_dir, "documents").select("source", V.split_of(F.col("doc_id"), {"train": 0.7, "dev": 0.15, "test": 0.15}).alias("split"))
    return V.split_errors(rows, "source", {"train": 1, "dev": 1, "test": 1, "extra": 1})


@query("select lang, source, count(*) as documents, sum(n_chars)::bigint as chars, grouping(lang)::bigint as g_lang, grouping(source)::bigint as g_source from documents group by grouping sets ((lang, source), (lang), ())")
def split_summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    return rows.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")], []], F.col("lang"), F.col("source")).agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.grouping("lang").cast("long").alias("g_lang"), F.grouping("source").cast("long").alias("g_source"))


@query("select sha256(text) as sha256, count(*) as documents, min(doc_id) as first_id from documents group by 1")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


@query("select doc_id, sha256(text) as sha256, min(doc_id) over (partition by sha256(text)) as first_id from documents where text is not null")
def content_hash_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stands for its content: the texts of a group are not gathered, and no mapping is lost."""
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return rows.join(rows.groupBy("sha256").agg(F.min("doc_id").alias("first_id")), "sha256").select("doc_id", "sha256", "first_id")


@query("""select page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9._-]+', '-', 'g'), '-') as slug, substring(sha256('["' || page_id || '","page"]'), 1, 12) as digest from pages""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.digest(F.col("page_id"), F.lit("page")).alias("digest"))


@query(f"""with {SQL_ELEMENTS}, w as (select *, regexp_extract_all(line, '\\p{{L}}[\\p{{L}}''-]*') as ws from e)
    select doc_id, pos, length(regexp_replace(line, '\\P{{L}}', '', 'g')) >= 4 and length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 0.35 * length(regexp_replace(line, '\\s', '', 'g')) as prose,
        len(ws) between 1 and 12 and length(line) <= 100 and len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 0.8 * len(ws) as title, not regexp_matches(line, '[.!?;:]\\s*$') as open_end, regexp_matches(line, '^\\s*\\p{{Ll}}') as low from w""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return elements(read(spark, sf_dir, "documents")).select("doc_id", "pos", T.readable_prose(line).alias("prose"), T.title_fragment(line).alias("title"), T.open_ended(line).alias("open_end"), T.lower_start(line).alias("low"))


@query(f"with {cte('fx_questions_text')} select question_id, list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in T.QUESTION_FEATURES.items()) + "], lambda x: x is not null) as features from fx_questions_text")
def question_features_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "fx_questions_text").select("question_id", T.question_features(F.col("text")).alias("features"))


@query("select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def benchmark_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage word by word."""
    return holding(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
