"""Evidence log: question graphs, referential checks, recall, action logs, scores, audits and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import clean_answer, is_not_answerable, recall_terms
from docloom.functions.walks import walked
from docloom.lineage import cut_lineage

#: Actions that the environment takes by itself; they cost no budget.
FREE_ACTIONS = ("initialize", "recheck", "finalize")


#: The column that names the set a question belongs to: ids are those of a set.
SET = "set_id"


def dependencies(questions: DataFrame) -> DataFrame:
    """questions(set_id, question_id, depends_on 'a,b') -> (set_id, question_id, needs)."""
    needs = F.filter(F.split("depends_on", ","), lambda x: x != "")
    return questions.select(SET, "question_id", F.explode(needs).alias("needs"))


def graph_errors(questions: DataFrame, most: int | None = None, depth: int | None = None) -> DataFrame:
    """(set_id, question_id, error): unknown or own dependencies, members of cycles of any length, and, where limits are given, questions beyond the number or the depth of a set."""
    edges = dependencies(questions)
    unknown = edges.join(questions.select(SET, F.col("question_id").alias("needs")), [SET, "needs"], "left_anti").select(SET, "question_id", F.lit("unknown_dependency").alias("error"))
    own = edges.where("question_id = needs").select(SET, "question_id", F.lit("self_dependency").alias("error"))
    walks = cut_lineage(question_walks(questions))
    out = unknown.union(own).union(walks.where("cyclic").select(SET, "question_id", F.lit("cycle").alias("error")))
    if most is not None:
        order = Window.partitionBy(SET).orderBy("position", "question_id")
        out = out.union(questions.withColumn("k", F.row_number().over(order)).where(F.col("k") > most).select(SET, "question_id", F.lit("too_many").alias("error")))
    if depth is not None:
        out = out.union(walks.where(F.col("depth") > depth).select(SET, "question_id", F.lit("too_deep").alias("error")))
    return out.distinct()


def question_depths(questions: DataFrame) -> DataFrame:
    """(set_id, question_id, depth): 1 without dependencies, else one more than the deepest of them; members of cycles and what needs them have none."""
    return question_walks(questions).where("depth is not null").select(SET, "question_id", "depth")


def question_walks(questions: DataFrame) -> DataFrame:
    """(set_id, question_id, depth, cyclic) of each id of a set: its depth, and whether it is a member of a cycle of several questions."""
    kind = questions.schema[SET].dataType.simpleString()
    return walked(questions.select(SET, "question_id", "depends_on"), SET, _walk, f"{SET} {kind}, question_id string, depth int, cyclic boolean")


def _walk(rows: list[dict]) -> list[tuple]:
    """(question_id, depth, cyclic) of one set."""
    needs: dict = {}
    for r in rows:
        # null sets and ids meet nothing
        named = [x for x in (r["depends_on"] or "").split(",") if x] if r[SET] is not None and r["question_id"] is not None else []
        needs.setdefault(r["question_id"], set()).update(named)
    needs = {q: [x for x in own if x in needs] for q, own in needs.items()}
    needed: dict = {q: [] for q in needs}
    for q, own in needs.items():
        for x in own:
            needed[x].append(q)
    left, depth = {q: len(own) for q, own in needs.items()}, {}
    ready = [q for q, n in left.items() if not n]
    for q in ready:  # grows while it is read
        depth[q] = 1 + max((depth[x] for x in needs[q]), default=0)
        for x in needed[q]:
            left[x] -= 1
            if not left[x]:
                ready.append(x)
    cyclic = _cyclic({q: own for q, own in needs.items() if q not in depth}, needed)
    return [(q, depth.get(q), q in cyclic) for q in needs]


def _cyclic(needs: dict, needed: dict) -> set:
    """Members of cycles of several nodes: of strong components of more than one."""
    last: list = []
    seen: set = set()
    for start in needs:
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(needs[start]))]
        while path:
            at, rest = path[-1]
            x = next((x for x in rest if x in needs and x not in seen), None)
            if x is None:
                last.append(at)
                path.pop()
            else:
                seen.add(x)
                path.append((x, iter(needs[x])))
    out, taken = set(), set()
    for start in reversed(last):
        if start in taken:
            continue
        taken.add(start)
        own = [start]
        for at in own:  # grows while it is read
            for x in needed[at]:
                if x in needs and x not in taken:
                    taken.add(x)
                    own.append(x)
        if len(own) > 1:
            out.update(own)
    return out


def runnable(questions: DataFrame) -> DataFrame:
    """Open questions of each set whose dependencies are all done, with their order; the first of a set is its next to run."""
    key = [SET, "question_id"]
    status = questions.select(SET, F.col("question_id").alias("needs"), F.col("status").alias("needed"))
    blocked = dependencies(questions).join(status, [SET, "needs"], "left").where("needed is null or needed <> 'done'").select(*key)
    free = questions.where("status <> 'done'").join(blocked, key, "left_anti")
    return free.withColumn("turn", F.row_number().over(Window.partitionBy(SET).orderBy("position", "question_id")))


def recall(observations: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The k stored observations that share most with a query: four points a shared term, three more where it is a number."""
    terms = recall_terms(F.lit(query))
    first = observations.groupBy("source_id", "claim").agg(F.min(F.struct("stored", "observation_id")).alias("x")).select("source_id", "claim", "x.*")
    shared = F.array_intersect(recall_terms(F.col("claim")), terms)
    numbers = F.size(F.filter(shared, lambda t: F.rlike(t, F.lit("^[0-9]"))))
    scored = first.withColumn("score", 4 * F.size(shared) + 3 * numbers).where("score > 0")
    return scored.orderBy(F.desc("score"), "stored", "observation_id").limit(k)


def missing_references(evidence: DataFrame, observations: DataFrame, questions: DataFrame) -> DataFrame:
    """(evidence_id, error) of evidence that names an observation or question that is not there."""
    a = evidence.join(observations, "observation_id", "left_anti").select("evidence_id", F.lit("unknown_observation").alias("error"))
    return a.union(evidence.join(questions, "question_id", "left_anti").select("evidence_id", F.lit("unknown_question").alias("error")))


def last_actions(log: DataFrame, n: int) -> DataFrame:
    """log(session, step, action): the last n of each session, newest first."""
    return log.withColumn("age", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("step")))).where(F.col("age") <= n)


def budget(log: DataFrame, limit: int) -> DataFrame:
    """What each session has spent, without the environment's own actions, and how it stands."""
    spent = log.groupBy("session").agg(F.count_if(~F.col("action").isin(*FREE_ACTIONS)).alias("spent"), F.max_by("action", "step").alias("last"))
    return spent.withColumn("status", F.when(F.col("last") == "finalize", "ready").when(F.col("spent") >= limit, "budget_exhausted").otherwise("open"))


def repeats(log: DataFrame) -> DataFrame:
    """Steps that do again what the step before did."""
    before = F.lag("action").over(Window.partitionBy("session").orderBy("step"))
    return log.withColumn("before", before).where("action = before").select("session", "step", "action")


def correct(gold: Column, prediction: Column) -> Column:
    return F.when(is_not_answerable(gold), is_not_answerable(prediction)).otherwise(clean_answer(gold) == clean_answer(prediction))


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows(gold, prediction, status): one row of accuracy, precision, recall and generalised F1.

    Precision is over predictions that answer, recall over questions that can be answered.
    """
    right = F.coalesce(correct(F.col("gold"), F.col("prediction")), F.lit(False))
    answered = F.coalesce(~is_not_answerable(F.col("prediction")), F.lit(False))
    answerable = ~is_not_answerable(F.col("gold"))
    out = rows.agg(
        F.count("*").alias("cases"), F.count_if(right).alias("correct"), F.count_if(right & answerable).alias("hits"), F.count_if(answered).alias("answered"), F.count_if(answerable).alias("answerable"),
        F.count_if(F.coalesce(F.col("status"), F.lit("program_failure")) == "ready").alias("ready"), F.count_if(right & (F.col("status") == "ready")).alias("ready_correct"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumns({"accuracy": ratio("correct", "cases"), "precision": ratio("hits", "answered"), "recall": ratio("hits", "answerable"), "ready_accuracy": ratio("ready_correct", "ready")})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def percentile_at(rows: DataFrame, group: str, value: str, fraction: float) -> DataFrame:
    """The value at index round((n - 1) * fraction), halves to even, of each group's sorted values.

    Rows are counted by value first, with map-side combine, so that a window sees each value of a group once.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    totals = counts.withColumns({"upto": upto, "n": F.sum("times").over(Window.partitionBy(group))})
    at = F.bround((F.col("n") - 1) * F.lit(fraction), 0) + 1
    return totals.where((F.col("upto") >= at) & (F.col("upto") - F.col("times") < at)).select(group, F.col(value).alias("percentile"))


def coverage_fold(rows: DataFrame) -> DataFrame:
    """rows(group, batch, matched, value): folded counts and the distinct values in the order of first sight, whatever their case."""
    first = rows.where("value is not null").groupBy("group", F.lower("value").alias("folded")).agg(F.min(F.struct("batch", "value")).alias("x"))
    values = first.groupBy("group").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["value"]).alias("values"))
    return rows.groupBy("group").agg(F.sum("matched").alias("matched"), F.min("complete").alias("complete")).join(values, "group", "left")


def split_of(key: Column, shares: dict[str, float]) -> Column:
    """A stable split by the hash of a key; shares are taken in their order. A null key has none."""
    point = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), key.cast("string"))), 1, 8), 16, 10).cast("long") % 10000
    out, at = F.when(F.lit(False), F.lit("")), 0
    for name, share in shares.items():
        at += round(10000 * share)
        out = out.when(point < at, F.lit(name))
    return out


def split_errors(rows: DataFrame, key: str, least: dict[str, int]) -> DataFrame:
    """rows(key, split): (error, subject, n) of keys that stand in several splits, and of splits with fewer rows than wanted."""
    sizes = rows.groupBy("split").agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame(list(least.items()), "split string, least long")
    small = wanted.join(sizes, "split", "left").where("coalesce(n, 0) < least").select(F.lit("too_small").alias("error"), F.col("split").alias("subject"), F.coalesce("n", F.lit(0)).alias("n"))
    shared = rows.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("shared_key").alias("error"), F.col(key).alias("subject"), "n")
    return small.unionByName(shared)
