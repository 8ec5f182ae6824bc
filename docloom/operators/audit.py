"""Audits and session state: rule coverage, example audits, batch health, scopes, previews and the evidence fold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_coverage(firings: DataFrame, samples: int = 3) -> DataFrame:
    """firings(rule_id, document_id, element_id, status): how often and where each rule fired, with its first elements."""
    first = firings.select("rule_id", "document_id", "element_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("rule_id").orderBy("document_id", "element_id"))).where(F.col("n") <= samples)
    sample = first.groupBy("rule_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "element_id"))), lambda x: x["element_id"]).alias("samples"))
    counts = firings.groupBy("rule_id").agg(F.count("*").alias("firings"), F.countDistinct("document_id").alias("documents"), F.sort_array(F.collect_set("status")).alias("statuses"))
    return counts.join(sample, "rule_id")


def example_audit(calls: DataFrame) -> DataFrame:
    """calls(example_id, session, step, action, target, valid, accepted): one row of counts and rates."""
    w = Window.partitionBy("session").orderBy("step")
    same = (F.col("action") == F.lag("action").over(w)) & F.col("target").eqNullSafe(F.lag("target").over(w))
    nth = F.row_number().over(Window.partitionBy("example_id").orderBy("session", "step"))
    marked = calls.withColumn("again", F.coalesce(same, F.lit(False))).withColumn("nth", nth)
    return marked.agg(
        F.count("*").alias("examples"), F.count_if("valid").alias("valid"), F.round(F.avg(F.col("valid").cast("int")), 6).alias("valid_rate"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted"), F.count_if("again").alias("repeats"),
        F.count_if(F.col("nth") > 1).alias("duplicate_ids"), F.countDistinct("session").alias("sessions"),
    )


def accepted_examples(calls: DataFrame) -> DataFrame:
    """Accepted calls as training examples, one an id."""
    return calls.where("valid and accepted").groupBy("example_id").agg(F.min(F.struct("session", "step", "action", "target")).alias("x")).select("example_id", F.to_json("x").alias("target_text"))


def batch_health(cases: DataFrame) -> DataFrame:
    """cases(case_id, status): succeeded, degraded and failed."""
    status = F.coalesce("status", F.lit("failed"))
    return cases.agg(F.count_if(status == "ready").alias("succeeded"), F.count_if(status.isin("stopped_incomplete", "budget_exhausted")).alias("degraded"), F.count_if(~status.isin("ready", "stopped_incomplete", "budget_exhausted")).alias("failed"))


def scope_pages(scopes: DataFrame, most: int | None = None) -> DataFrame:
    """scopes(question_id, scope text, pages: how many the document has, if not `most`) -> page numbers 1..pages that are meant; a text without a scope gives none."""
    s = F.lower("scope")
    number = lambda pattern: F.regexp_extract(s, pattern, 1).try_cast("int")
    first, last = number(r"first ([0-9]+)"), number(r"last ([0-9]+)")
    lo, hi = number(r"pages? ([0-9]+)\s*(?:-|to)\s*[0-9]+"), number(r"pages? [0-9]+\s*(?:-|to)\s*([0-9]+)")
    listed = F.transform(F.regexp_extract_all(F.regexp_extract(s, r"(pages? [0-9]+(?:(?:\s*,\s*|\s+and\s+)[0-9]+)*)", 1), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    pages = F.lit(most) if most is not None else F.col("pages").cast("int")
    found = (
        F.when(s.contains("whole document"), F.sequence(F.lit(1), pages)).when(first.isNotNull(), F.sequence(F.lit(1), F.least(first, pages))).when(last.isNotNull(), F.sequence(F.greatest(F.lit(1), pages - last + 1), pages))
        .when(lo.isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(listed)
    )
    return scopes.select("question_id", F.explode(F.array_distinct(F.filter(found, lambda p: (p >= 1) & (p <= pages)))).alias("page_number"))


def page_of_label(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """mentions(document_id, label), pages(document_id, page_id, page_index, label): the page that prints the label; its place in order only where no page prints it."""
    doc = "document_id"
    printed = mentions.join(pages.select(doc, "label", F.col("page_id").alias("printed_id")), [doc, "label"], "left")
    counted = printed.join(pages.select(doc, (F.col("page_index") + 1).cast("string").alias("label"), F.col("page_id").alias("counted_id")), [doc, "label"], "left")
    by = F.when(F.max("printed_id").isNotNull(), "printed").when(F.max("counted_id").isNotNull(), "physical").otherwise("unresolved")
    return counted.groupBy(doc, "label").agg(F.coalesce(F.min("printed_id"), F.min("counted_id")).alias("page_id"), by.alias("by"), F.countDistinct("printed_id").alias("printed"))


def match_scope(ranges: Column, content_start: Column, content_end: Column) -> Column:
    """content, metadata or mixed, by where matched ranges lie; unknown without ranges."""
    inside = lambda r: (r["start"] >= content_start) & (r["stop"] <= content_end)
    some, every = F.exists(ranges, inside), F.forall(ranges, inside)
    return F.when(F.size(ranges) == 0, "unknown").when(every, "content").when(some, "mixed").otherwise("metadata")


def preview_route(bm25_scope: Column, dense_scope: Column, bm25_share: Column, dense_share: Column) -> Column:
    """Which route's match is shown: a match in the content before one in metadata, else the larger share of the fused score, else the words."""
    good = lambda c: c.isin("content", "mixed")
    return F.when(good(bm25_scope) & ~F.coalesce(good(dense_scope), F.lit(False)), "bm25").when(good(dense_scope) & ~F.coalesce(good(bm25_scope), F.lit(False)), "dense").when(dense_share > bm25_share, "dense").otherwise("bm25")


def best_row_with_neighbours(rows: DataFrame) -> DataFrame:
    """rows(table_id, r, text, relevance): the best row of each table and the ones around it."""
    w = Window.partitionBy("table_id").orderBy("r")
    around = rows.select("*", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))
    return around.groupBy("table_id").agg(F.max_by(F.struct("r", "before", "text", "after"), F.struct(F.col("relevance"), -F.col("r"))).alias("x")).select("table_id", "x.*")


def evidence_fold(deltas: DataFrame) -> DataFrame:
    """deltas(session, step, op, evidence_id, observation_id): what each session holds in the end, and what was rejected.

    add needs an id that is not held, replace and remove one that is; a delta that breaks this changes nothing and is counted.
    Whether a delta holds depends only on those before it that name the same id: it is held if the last add or remove was an add.
    So windows of a session's ids fold all, after one shuffle by session.
    """
    before = Window.partitionBy("session", "evidence_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("add", "remove"), F.col("op")), ignorenulls=True).over(before)
    rows = deltas.select("session", "step", "op", "evidence_id", "observation_id").repartition("session").withColumn("held", F.coalesce(last == "add", F.lit(False)))
    right = F.coalesce(F.when(F.col("op") == "add", ~F.col("held")).when(F.col("op").isin("replace", "remove"), F.col("held")), F.lit(False))
    rows = rows.withColumn("right", right)
    # what an id has is what the last delta that held has given it; a removed one is not among what is kept
    kept = F.max_by(F.struct("op", "observation_id"), F.when(F.col("right"), F.col("step")))
    ids = rows.groupBy("session", "evidence_id").agg(kept.alias("x"), F.count_if(~F.col("right")).alias("rejected"))
    found = F.collect_list(F.when(F.col("x.op") != "remove", F.struct("evidence_id", "x.observation_id")))
    whole = ids.groupBy("session").agg(F.sum("rejected").cast("int").alias("rejected"), found.alias("found"))
    return whole.select("session", "rejected", F.explode_outer("found").alias("e")).select("session", "e.evidence_id", "e.observation_id", "rejected")


def balanced_pick(features: dict[str, dict[str, int]], size: int, wanted: dict[str, float]) -> list[str]:
    """A subset of documents, few enough for the driver, whose feature totals come near what is wanted; greedy, ties by name."""
    picked: list[str] = []
    total = dict.fromkeys(wanted, 0.0)
    while len(picked) < min(size, len(features)):
        gap = lambda d: sum(abs(wanted[k] - total[k] - features[d].get(k, 0)) for k in wanted)
        best = min((d for d in features if d not in picked), key=lambda d: (gap(d), d))
        picked.append(best)
        for k in total:
            total[k] += features[best].get(k, 0)
    return picked


def literal_pages(text: str | None) -> list[int]:
    """'[3, 5]' as page numbers; anything else has none."""
    return [int(x) for x in re.findall(r"\d+", text)] if text and re.fullmatch(r"\s*\[[\d,\s]*\]\s*", text) else []
