"""Outputs of runs, made of events, held against a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import validation as V
from docloom.plans.derived import rows
from docloom.plans.registry import query

SCHEMA = {"action": {"allowed": ["view", "click", "purchase", "signup"]}, "target?": "text", "confidence": "number", "steps": [{"n": "integer", "note?": "string"}]}
#: v tells what is wrong with an output; u what is wrong with its steps.
_EVENTS = "select cast(event_id as varchar(20)) as case_id, event_id, event_type, cast(floor(value) as bigint) % 12 as v, cast(floor(value * 10) as bigint) % 7 as u, user_id from events"
_OUTPUTS = f"""select case_id, event_id, user_id, v, u, event_type, case when v = 0 then 'not json ' || case_id else '{{"' || case when v = 1 then 'act' else 'action' end || '": "' || event_type || '", "target": ' || case v when 2 then '" "' when 3 then 'null' when 4 then '7' else '"e1"' end
    || ', "confidence": ' || case v when 5 then '"high"' when 6 then 'true' else '0.5' end || ', "steps": ' || case u when 0 then '[]' when 1 then '[{{"n": 1.5}}]' when 2 then '[{{"n": 1}}, {{"note": "x"}}]' when 3 then '{{}}' else '[{{"n": 1, "note": null}}, {{"n": 2}}]' end || '}}' end as output from ({_EVENTS}) as e"""


@query(f"""with o as (select case_id, v, u, event_type from ({_EVENTS})), f as (
        select '$' as path, 'not_json' as fault from o where v = 0 union all select '$.action', 'missing' from o where v = 1 union all select '$.act', 'unknown_field' from o where v = 1 union all select '$.action', 'not_allowed' from o where v > 1 and event_type = 'error'
        union all select '$.target', 'blank' from o where v = 2 union all select '$.target', 'wrong_type' from o where v = 4 union all select '$.confidence', 'wrong_type' from o where v in (5, 6)
        union all select '$.steps[0].n', 'wrong_type' from o where v > 0 and u = 1 union all select '$.steps[1].n', 'missing' from o where v > 0 and u = 2 union all select '$.steps', 'wrong_type' from o where v > 0 and u = 3)
    select path, fault, count(*) as n from f group by all""")
def output_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each fault comes at each path of the outputs."""
    return V.check(rows(spark, sf_dir, _OUTPUTS), SCHEMA).groupBy("path", "fault").agg(F.count("*").alias("n"))


@query(f"""with o as (select user_id, case when v > 0 then concat_ws('|', case when v = 1 then 'x' else 'y' end, event_type, case v when 2 then 'a' when 3 then 'b' when 4 then 'c' end, case u when 0 then '0' when 1 then '1' when 2 then '2' when 3 then '3' else '4' end) end as s from ({_EVENTS}))
    select user_id::varchar as case_id, count(*) as runs, count(s) as readable, count(distinct s) as signatures, count(distinct s) = 1 and count(s) = count(*) as stable from o group by user_id""".replace("case v when 2 then 'a' when 3 then 'b' when 4 then 'c' end", "case v when 2 then 'a' when 3 then 'b' when 4 then 'c' else 'd' end"))
def output_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different outputs of every user's events, without their confidence."""
    return V.signatures(rows(spark, sf_dir, _OUTPUTS).withColumn("case_id", F.col("user_id").cast("string")), ignored=("confidence",))
