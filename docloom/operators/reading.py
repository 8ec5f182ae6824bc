"""The reading log: targets, deferred questions, preconditions, exploration views, actions, reads, answers, resuming.

A log has session, step, action, target and query. Null actions are ignored; steps of a session are unique; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.lineage import cut_lineage
from docloom.operators.evidence import FREE_ACTIONS, SET, question_walks, runnable
from docloom.operators.relations import DOC


def first_targets(questions: DataFrame) -> DataFrame:
    """The question that each set begins with."""
    return runnable(questions).where("turn = 1").select(SET, F.col("question_id").alias("target_id"))


def register(questions: DataFrame, asked: DataFrame, most: int = 6, depth: int = 4) -> DataFrame:
    """asked(set_id, question_id, position, status, depends_on): the first reason against adding each to its set, or null.

    Each is judged against the set as it stands: known_id, unknown_dependency, too_many and too_deep.
    """
    # the set's ids with their depths, of members of cycles null, are looked up for the asked id and for what it needs
    walks = cut_lineage(question_walks(questions).select(SET, F.col("question_id").alias("id"), "depth"))
    size = questions.groupBy(SET).agg(F.count("*").alias("_size"))
    needs = F.filter(F.split("depends_on", ","), lambda x: x != "")
    # an id that is asked twice is judged by what both ask for
    own = asked.groupBy(SET, "question_id").agg(F.count("*").alias("_times"), F.array_distinct(F.flatten(F.collect_list(needs))).alias("needs"))
    named = own.select(SET, "question_id", "_times", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("self"), F.col("question_id").alias("id"))), F.transform("needs", lambda x: F.struct(F.lit(False).alias("self"), x.alias("id"))))).alias("x"))
    met = named.select(SET, "question_id", "_times", "x.self", "x.id").join(walks.withColumn("_there", F.lit(True)), [SET, "id"], "left")
    other = ~F.col("self")
    judged = met.groupBy(SET, "question_id", "_times").agg(F.max(F.when(F.col("self"), F.col("_there"))).alias("_known"), F.count_if(other & F.col("_there").isNull()).alias("_unknown"), (F.coalesce(F.max(F.when(other, F.col("depth"))), F.lit(0)) + 1).alias("_depth"))
    rows = judged.join(size, SET, "left").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    reason = F.when(F.col("_known"), "known_id").when(F.col("_unknown") > 0, "unknown_dependency").when(F.coalesce("_size", F.lit(0)) >= most, "too_many").when(F.col("_depth") > depth, "too_deep")
    return rows.select(SET, "question_id", reason.alias("reason"))


def assessment_errors(observations: DataFrame, assessed: DataFrame) -> DataFrame:
    """observations(session, observation_id), assessed(session, observation_id): each must be assessed exactly once, and none that isn't there."""
    n = assessed.groupBy("session", "observation_id").agg(F.count("*").alias("n"))
    met = observations.select("session", "observation_id", F.lit(True).alias("there")).distinct().join(n, ["session", "observation_id"], "full")
    error = F.when(F.col("there").isNull(), "unknown_observation").when(F.col("n").isNull(), "not_assessed").when(F.col("n") > 1, "assessed_twice")
    return met.select("session", "observation_id", error.alias("error")).where("error is not null")


def grounded(decisions: DataFrame, shown: DataFrame) -> DataFrame:
    """decisions(session, step, op, local_id), shown(session, step, local_id, stable_id): decisions by stable ids; null where the local id was not shown at that step."""
    return decisions.join(shown, ["session", "step", "local_id"], "left").select("session", "step", "op", "local_id", "stable_id")


def exploration(log: DataFrame, actions: int = 3, queries: int = 3) -> DataFrame:
    """Of each session the last actions, newest first, the last distinct queries, and the focus: the last target that was read."""
    known = log.where("action is not null")
    back = known.withColumn("age", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("step"))))
    last = back.where(F.col("age") <= actions).groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("age", "action"))), lambda x: x["action"]).alias("a"))
    asked = known.where("query is not null").groupBy("session", "query").agg(F.max("step").alias("step"))
    asked = asked.withColumn("age", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("step")))).where(F.col("age") <= queries)
    said = asked.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("age", "query"))), lambda x: x["query"]).alias("q"))
    focus = known.where("action = 'READ_SOURCE'").groupBy("session").agg(F.max_by("target", "step").alias("focus"))
    return last.join(said, "session", "left").join(focus, "session", "left").select("session", F.array_join("a", ",").alias("actions"), F.array_join("q", ",").alias("queries"), "focus")


def action_errors(log: DataFrame) -> DataFrame:
    """(session, step, error): a NEXT_BATCH without a search before it, a read or relation without a target, and anything after a STOP."""
    before = Window.partitionBy("session").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.where("action is not null").withColumns({"_searched": F.max((F.col("action") == "SEARCH").cast("int")).over(before), "_stopped": F.max((F.col("action") == "STOP").cast("int")).over(before)})
    error = (
        F.when(F.col("_stopped") == 1, "after_stop").when((F.col("action") == "NEXT_BATCH") & (F.coalesce("_searched", F.lit(0)) == 0), "no_search").when(F.col("action").isin("READ_SOURCE", "FOLLOW_RELATION") & F.col("target").isNull(), "no_target")
        .when((F.col("action") == "SEARCH") & (F.trim(F.coalesce("query", F.lit(""))) == ""), "no_query").when(~F.col("action").isin("SEARCH", "NEXT_BATCH", "READ_SOURCE", "FOLLOW_RELATION", "READ_ADJACENT_PAGE", "READ_PAGE_CONTEXT", "STOP", *FREE_ACTIONS), "unknown_action")
    )
    return rows.select("session", "step", error.alias("error")).where("error is not null")


def first_reads(log: DataFrame) -> DataFrame:
    """Reads without those that a session has done before for the same query: (session, step, target)."""
    w = Window.partitionBy("session", "target", F.coalesce("query", F.lit(""))).orderBy("step")
    return log.where("action = 'READ_SOURCE'").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("session", "step", "target")


def read_elements(elements: DataFrame, cells: DataFrame) -> DataFrame:
    """What reading an element gives: its text, a table's cells as lines, or for other visuals a limitation. cells(document_id, element_id, r, c, text)."""
    line = F.concat(F.lit("r"), F.col("r"), F.lit("c"), F.col("c"), F.lit(": "), F.col("text"))
    # only cells of tables that are there are gathered; the tables are written so that, while they are few, no cell is shuffled to find its own
    tables = elements.where("element_type = 'table'").select(DOC, "element_id")
    held = cut_lineage(cells.select(DOC, "element_id").distinct().join(tables, [DOC, "element_id"], "left_semi"))
    lines = cells.join(held, [DOC, "element_id"], "left_semi").groupBy(DOC, "element_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "c", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    rows = elements.join(lines, [DOC, "element_id"], "left")
    content = F.when(F.col("element_type") == "table", F.coalesce("lines", "text")).when(~F.col("element_type").isin("figure", "chart"), F.col("text"))
    return rows.select(DOC, "element_id", content.alias("content"), F.when(F.coalesce(content, F.lit("")) == "", F.when(F.col("element_type").isin("figure", "chart"), "visual_needs_a_reader").otherwise("nothing_to_read")).alias("limitation"))


def resumed(log: DataFrame, limit: int, more: int) -> DataFrame:
    """Of each session what is left of its budget with `more` added, and whether it may go on: not after a STOP or finalize."""
    spent = log.groupBy("session").agg(F.count_if(~F.col("action").isin(*FREE_ACTIONS)).alias("spent"), F.max("step").alias("last_step"), F.max_by("action", "step").alias("last"))
    left = F.lit(limit + more) - F.col("spent")
    return spent.select("session", "last_step", left.alias("left"), (~F.col("last").isin("STOP", "finalize") & (left > 0)).alias("resumes"))


def answer_errors(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers(session, status, answer, cited array), evidence(session, evidence_id): (session, error)."""
    known = answers.select("session", F.explode_outer("cited").alias("evidence_id")).where("evidence_id is not null").join(evidence, ["session", "evidence_id"], "left_anti").select("session", F.lit("unknown_evidence").alias("error")).distinct()
    named = lambda rule, error: answers.where(rule).select("session", F.lit(error).alias("error"))
    answered = "status = 'answered'"
    return known.union(named(f"{answered} and coalesce(size(cited), 0) <= 0", "nothing_cited")).union(named(f"{answered} and coalesce(trim(answer), '') = ''", "no_answer")).union(named("status <> 'answered' and coalesce(trim(answer), '') <> ''", "answer_without_status"))


def scan_batches(pages: DataFrame, size: int = 5) -> DataFrame:
    """pages(document_id, page_index): pages in batches, in order."""
    rn = F.row_number().over(Window.partitionBy(DOC).orderBy("page_index")) - 1
    return pages.select(DOC, "page_index", F.floor(rn / size).alias("batch"))


def centred(text: Column, term: Column, most: int) -> Column:
    """At most so many characters of a text around the first place of a term, with points where something is left out; the beginning where it isn't there."""
    at = F.greatest(F.instr(F.lower(text), F.lower(term)) - 1, F.lit(0))
    begin = F.greatest(F.lit(0), F.least(at - F.floor((F.lit(most) - F.length(term)) / 2), F.length(text) - most)).cast("int")
    part = F.substring(text, begin + 1, F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(begin > 0, "...").otherwise(""), part, F.when(begin + most < F.length(text), "...").otherwise("")))


def open_cases(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """cases(case_id, sha256), outputs(case_id, sha256, complete): cases that are still to run, and why."""
    met = cases.join(outputs.select("case_id", F.col("sha256").alias("_sha"), "complete"), "case_id", "left")
    reason = F.when(F.col("complete").isNull(), "missing").when(~F.col("_sha").eqNullSafe(F.col("sha256")), "other_input").when(~F.col("complete"), "incomplete")
    return met.select("case_id", reason.alias("reason")).where("reason is not null")


def manifest(prompts: DataFrame, inactive: bool = False) -> DataFrame:
    """prompts(name, version, text, active): name, version and digest of each prompt in use."""
    rows = prompts if inactive else prompts.where("active")
    return rows.select("name", "version", F.sha2("text", 256).alias("sha256"))


def snapshot_errors(required: DataFrame, bindings: DataFrame) -> DataFrame:
    """required(name), bindings(name, value): what an experiment's snapshot lacks, and what it names without need."""
    met = required.select("name", F.lit(True).alias("wanted")).join(bindings, "name", "full")
    error = F.when(F.col("wanted").isNull(), "unknown_binding").when(F.coalesce(F.trim("value"), F.lit("")) == "", "missing_binding")
    return met.select("name", error.alias("error")).where("error is not null")
