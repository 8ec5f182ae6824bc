"""Inventories and summaries of documents: headings, styles, page patterns, coverage, drift, captions, listing chains, uncovered lines, audits.

Null texts are empty; a document without rows of a kind gives none; equal candidates are told apart by their ids; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions.walks import walked
from docloom.operators.relations import DOC


def repeated_short_headings(headings: DataFrame, words: int = 4, least: int = 3) -> DataFrame:
    """headings(document_id, page_index, text): how many short headings each document repeats three times or more."""
    text = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    often = headings.where((text != "") & (F.size(F.split(text, " ")) <= words)).groupBy(DOC, text.alias("text")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.groupBy(DOC).agg(F.count("*").alias("headings"), F.max("n").alias("most"))


def page_patterns(elements: DataFrame) -> DataFrame:
    """The share of a document's pages that have its most frequent signature, the kinds of their blocks in order."""
    signature = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "element_type"))), lambda x: F.substring(x["element_type"], 1, 2)), "")
    pages = elements.groupBy(DOC, "page_index").agg(signature.alias("signature"))
    each = pages.groupBy(DOC, "signature").agg(F.count("*").alias("n"))
    return each.groupBy(DOC).agg((F.max("n") / F.sum("n")).alias("ratio"), F.min_by("signature", F.struct(-F.col("n"), F.col("signature"))).alias("signature"))


def style_profiles(headings: DataFrame) -> DataFrame:
    """headings(document_id, page_index, style, prominence, level or null): count, pages, median prominence and, where all numbered headings of a style agree, the level that anchors it."""
    out = headings.groupBy(DOC, "style").agg(F.count("*").alias("n"), F.countDistinct("page_index").alias("pages"), F.percentile("prominence", F.lit(0.5)).alias("prominence"), F.min("level").alias("_lo"), F.max("level").alias("_hi"))
    return out.withColumn("anchor", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).drop("_lo", "_hi")


def style_key(font: Column, size: Column, bold: Column, upper: Column) -> Column:
    """Font, size to the half point, and what stands out, as one text."""
    return F.concat_ws("/", F.coalesce(F.lower(font), F.lit("?")), F.coalesce((F.round(size * 2) / 2).cast("string"), F.lit("?")), F.when(bold, "b"), F.when(upper, "u"))


def first_positions(headings: DataFrame, pattern: str) -> DataFrame:
    """headings(document_id, page_index, reading_order, text): where a heading of a pattern comes first."""
    found = headings.where(F.rlike("text", F.lit(pattern)))
    return found.groupBy(DOC).agg(F.min(F.struct("page_index", "reading_order")).alias("x")).select(DOC, "x.*")


def document_titles(headings: DataFrame) -> DataFrame:
    """headings(document_id, page_index, reading_order, element_id, text, prominence, y1, y2): the title among those of the first page: the tallest, most prominent, first.

    It is none if it comes after two others and is no large cover line (a tenth of the page high), if it is numbered, a known section's name, or begins below a fifth of the page and is no cover line.
    """
    tall = F.col("y2") - F.col("y1")
    first = headings.where("page_index = 0").groupBy(DOC).agg(F.max_by(F.struct("element_id", "text", "reading_order", "y1", "y2"), F.struct(tall, F.col("prominence"), -F.col("reading_order"))).alias("x")).select(DOC, "x.*")
    cover = tall >= 0.1
    known = F.lower(F.trim("text")).isin("abstract", "introduction", "contents", "references", "summary")
    rejected = F.when((F.col("reading_order") > 1) & ~cover, "late").when(F.rlike("text", F.lit(r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s")), "numbered").when(known, "section_name").when((F.col("y1") > 0.20) & ~cover, "low")
    return first.select(DOC, "element_id", F.when(rejected.isNull(), F.col("text")).alias("title"), rejected.alias("rejected"))


def entity_titles(names: DataFrame, least: int = 2) -> DataFrame:
    """names(document_id, name): the name that a document says most, if twice at least; of equals the first in order."""
    each = names.where("trim(name) <> ''").groupBy(DOC, F.trim("name").alias("name")).agg(F.count("*").alias("n"))
    return each.groupBy(DOC).agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"), F.max("n").alias("n")).where(F.col("n") >= least)


def best_observations(rows: DataFrame) -> DataFrame:
    """rows(document_id, page_index, label, confidence, y): of a page's labels the surest, then the one nearest to the page's edge; of two alike the upper one."""
    w = Window.partitionBy(DOC, "page_index").orderBy(F.desc("confidence"), F.least("y", 1 - F.col("y")), "label", "y")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def coverage(rows: DataFrame, operator: str, k: int = 3) -> DataFrame:
    """rows(set_id, item, value): what an operator over a whole set gives, as (set_id, item, value): COUNT, COLLECT_ALL, TOP_K, ARGMAX, ARGMIN, or COMPLEMENT of the items whose value is positive."""
    place = lambda d: F.row_number().over(Window.partitionBy("set_id").orderBy(d, "item"))
    if operator == "COUNT":
        return rows.groupBy("set_id").agg(F.lit(None).cast("string").alias("item"), F.count_if(F.col("value") > 0).cast("double").alias("value")).select("set_id", "item", "value")
    if operator == "COLLECT_ALL":
        return rows.where("value > 0").select("set_id", "item", "value")
    if operator == "COMPLEMENT":
        return rows.where("not coalesce(value > 0, false)").select("set_id", "item", "value")
    order, most = {"TOP_K": (F.desc("value"), k), "ARGMAX": (F.desc("value"), 1), "ARGMIN": (F.asc("value"), 1)}[operator]
    return rows.where("value is not null").withColumn("_rn", place(order)).where(F.col("_rn") <= most).select("set_id", "item", "value")


def coverage_items(elements: DataFrame, kinds: tuple[str, ...], groups: DataFrame) -> DataFrame:
    """The items of some kinds, each confirmed group of fragments as one: groups(document_id, element_id, group_id) -> (document_id, item, first_page, fragments)."""
    own = elements.where(F.col("element_type").isin(*kinds)).join(groups, [DOC, "element_id"], "left")
    return own.groupBy(DOC, F.coalesce("group_id", "element_id").alias("item")).agg(F.min("page_index").alias("first_page"), F.count("*").alias("fragments"))


def fragment_edges(fragments: DataFrame) -> DataFrame:
    """fragments(document_id, group_id, fragment_index, element_id): from each fragment to the next."""
    ahead = F.lead("element_id").over(Window.partitionBy(DOC, "group_id").orderBy("fragment_index"))
    return fragments.select(DOC, "group_id", F.col("element_id").alias("source_id"), ahead.alias("target_id")).where("target_id is not null")


def asset_drift(assets: DataFrame, elements: DataFrame) -> DataFrame:
    """assets(document_id, element_id, sha256, page_index), elements of the same: (document_id, element_id, drift) of assets whose element is gone or another, and of elements without an asset."""
    met = assets.select(DOC, "element_id", F.col("sha256").alias("_a"), F.col("page_index").alias("_p")).join(elements.select(DOC, "element_id", "sha256", "page_index"), [DOC, "element_id"], "full")
    drift = F.when(F.col("page_index").isNull(), "gone").when(F.col("_p").isNull(), "not_indexed").when(~F.col("_a").eqNullSafe(F.col("sha256")), "other_content").when(F.col("_p") != F.col("page_index"), "other_page")
    return met.withColumn("drift", drift).where("drift is not null").select(DOC, "element_id", "drift")


def captions_of(relations: DataFrame, elements: DataFrame, least: float = 0.75) -> DataFrame:
    """The texts of each target's confirmed captions, in page order."""
    text = elements.select(DOC, F.col("element_id").alias("source_id"), "text", "page_index", "reading_order")
    met = relations.where((F.col("kind") == "caption_of") & (F.col("confidence") >= least)).join(text, [DOC, "source_id"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page_index", "reading_order", "text"))), lambda x: x["text"])
    return met.groupBy(DOC, "target_id").agg(F.array_join(F.array_distinct(parts), " | ").alias("captions"))


def preview_text(elements: DataFrame, captions: DataFrame) -> DataFrame:
    """What stands for a visual in a list: its descriptor, or label, captions and text without repeats, or a plain sentence."""
    parts = F.array_distinct(F.filter(F.array(F.trim(F.coalesce("label", F.lit(""))), F.trim(F.coalesce("captions", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))), lambda x: x != ""))
    said = F.nullif(F.array_join(parts, " | "), F.lit(""))
    rows = elements.join(captions.withColumnRenamed("target_id", "element_id"), [DOC, "element_id"], "left")
    return rows.select(DOC, "element_id", F.coalesce(F.nullif(F.trim("descriptor"), F.lit("")), said, F.concat(F.lit("A "), "element_type", F.lit(" without text."))).alias("preview"))


def follow(relations: DataFrame, starts: DataFrame) -> DataFrame:
    """starts(document_id, element_id, kind): the other ends of its relations of a kind, in both directions; a relation of an element with itself goes out only."""
    both = relations.select(DOC, "kind", F.col("source_id").alias("element_id"), F.col("target_id").alias("other_id"), F.lit("out").alias("direction")).unionByName(
        relations.where("source_id <> target_id").select(DOC, "kind", F.col("target_id").alias("element_id"), F.col("source_id").alias("other_id"), F.lit("in").alias("direction")))
    return starts.join(both, [DOC, "element_id", "kind"]).select(DOC, "element_id", "kind", "direction", "other_id").distinct()


def listing_chains(edges: DataFrame, anchors: DataFrame, least: float = 0.70) -> DataFrame:
    """edges(document_id, source_id, target_id, confidence), anchors(document_id, element_id, section_id): code that candidate continuations tie to an anchored listing gets its section; what two sections reach gets none."""
    text = lambda c: F.col(c).cast("string")
    sure = edges.where((F.col("confidence") >= least) & F.col(DOC).isNotNull() & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    rows = sure.select(DOC, F.lit(True).alias("edge"), text("source_id").alias("a"), text("target_id").alias("b")).union(anchors.select(DOC, F.lit(False), text("element_id"), text("section_id")))
    return walked(rows, DOC, _tied, f"{DOC} {anchors.schema[DOC].dataType.simpleString()}, element_id string, section_id string")


def _tied(rows: list[dict]) -> list[tuple]:
    """Elements of one document that are tied to one section alone."""
    parent: dict = {}

    def root(x: str | None) -> str | None:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in rows:
        if r["edge"]:
            parent[root(r["a"])] = root(r["b"])
    sections: dict = {}
    for r in rows:
        if not r["edge"]:
            sections.setdefault(root(r["a"]), set()).add(r["b"])
    alone = {x: next(iter(own)) for x, own in sections.items() if len(own) == 1}
    return [(x, alone[at]) for x in list(parent) if (at := root(x)) in alone]


def uncovered_lines(lines: DataFrame, elements: DataFrame) -> DataFrame:
    """lines(document_id, page_index, line_id, text, x1, y1, x2, y2): those that no element of their page holds, by its text or, for visuals and tables, by two fifths of the line's box."""
    a = lines.select(DOC, "page_index", "line_id", F.regexp_replace(F.lower("text"), r"\s+", "").alias("a_t"), *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    b = elements.select(DOC, "page_index", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", "").alias("b_t"), "element_type", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    shared = F.greatest(F.lit(0.0), F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * F.greatest(F.lit(0.0), F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    area = (F.col("a_x2") - F.col("a_x1")) * (F.col("a_y2") - F.col("a_y1"))
    held = F.contains("b_t", "a_t") | (F.col("element_type").isin("figure", "chart", "table") & (shared >= 0.40 * area))
    covered = a.join(b, [DOC, "page_index"]).where(held).select(DOC, "line_id").distinct()
    return lines.where("trim(text) <> ''").join(covered, [DOC, "line_id"], "left_anti").select(DOC, "page_index", "line_id", "text")


def dataset_issues(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """questions(question_id, document_id, pages array), documents(document_id, n_pages): (question_id, issue) of unknown documents, pages out of range and repeated ids, and documents without questions."""
    met = questions.join(documents, DOC, "left")
    named = lambda rows, issue: rows.select("question_id", F.lit(issue).alias("issue"))
    out = named(met.where("n_pages is null"), "unknown_document").union(named(met.where(F.exists("pages", lambda p: (p < 1) | (p > F.col("n_pages")))), "page_out_of_range"))
    out = out.union(named(questions.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated_id"))
    return out.union(documents.join(questions, DOC, "left_anti").select(F.col(DOC).alias("question_id"), F.lit("document_without_questions").alias("issue")))


def directory_index(files: DataFrame) -> DataFrame:
    """files(path): the key of each document folder (the folder's name, lower case) and its path; a key that several folders share is left out."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    dirs = files.where(F.rlike("path", F.lit(r"/document\.json$"))).select(folder.alias("directory")).distinct().withColumn("key", F.lower(F.substring_index("directory", "/", -1)))
    return dirs.groupBy("key").agg(F.min("directory").alias("directory"), F.count("*").alias("n")).where("n = 1").drop("n")


def gold_free(questions: DataFrame, index: DataFrame, kept: tuple[str, ...] = ("question_id", DOC, "question")) -> DataFrame:
    """Questions as cases for a model: the columns of a whitelist and the document's folder, for documents that are there."""
    return questions.select(*kept).join(index.withColumnRenamed("key", DOC), DOC).select(F.concat_ws("-", DOC, "question_id").alias("case_id"), *kept, "directory")


def visual_inventory(elements: DataFrame) -> DataFrame:
    """elements(document_id, element_id, element_type, asset, sha256, duplicate): each visual with the reason why it is not indexed, or null, and how many mappings its content has."""
    visual = elements.where("element_type in ('figure', 'chart', 'table')")
    reason = F.when(F.coalesce("asset", F.lit("")) == "", "no_asset").when(F.col("sha256").isNull(), "unreadable_asset").when(F.col("duplicate"), "duplicate_of_another").when(~F.lower("asset").rlike(r"\.(?:png|jpe?g|webp)$"), "unsupported_format")
    rows = visual.withColumn("skipped", reason)
    return rows.select(DOC, "element_id", "sha256", "skipped", F.when(F.col("skipped").isNull(), F.count(F.when(F.col("skipped").isNull(), 1)).over(Window.partitionBy("sha256"))).alias("mappings"))


def cross_page_relations(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Relations whose ends stand on different pages, with the pages."""
    side = lambda k: elements.select(DOC, F.col("element_id").alias(f"{k}_id"), F.col("page_index").alias(f"{k}_page"))
    met = relations.join(side("source"), [DOC, "source_id"]).join(side("target"), [DOC, "target_id"])
    return met.where("source_page <> target_page").select(DOC, "relation_id", "kind", "source_page", "target_page")


def metric_summary(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(group, metric, n, mean, median, p90, total) of each metric; nulls are left out."""
    each = rows.select(group, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(group, "x.*").where("v is not null")
    return each.groupBy(group, "metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.9)).alias("p90"), F.sum("v").alias("total"))


def policy_comparison(calls: DataFrame) -> DataFrame:
    """calls(model, session, step, attempt, action, target, gold_action, gold_target, valid): exact and route matches, first attempts that are valid, and last attempts that repeat the step before."""
    last = calls.withColumn("_rn", F.row_number().over(Window.partitionBy("model", "session", "step").orderBy(F.desc("attempt")))).where("_rn = 1")
    w = Window.partitionBy("model", "session").orderBy("step")
    again = (F.col("action") == F.lag("action").over(w)) & F.col("target").eqNullSafe(F.lag("target").over(w))
    route = F.coalesce(F.col("action") == F.col("gold_action"), F.lit(False))
    marked = last.select("model", route.alias("route"), (route & F.col("target").eqNullSafe(F.col("gold_target"))).alias("exact"), F.coalesce(again, F.lit(False)).alias("again"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    first = calls.where("attempt = 1").groupBy("model").agg(F.round(F.avg(F.coalesce("valid", F.lit(False)).cast("int")), 6).alias("first_valid"))
    return marked.groupBy("model").agg(F.count("*").alias("steps"), rate("exact").alias("exact"), rate("route").alias("route"), F.count_if("again").alias("repeats")).join(first, "model")


def overlapping_html(layout: DataFrame, preproc: DataFrame, least: float = 0.95) -> DataFrame:
    """Tables without HTML and preprocessed tables of their page: the one whose box is theirs, if it is the only one."""
    a = layout.select(DOC, "page_index", "block_index", *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    b = preproc.select(DOC, "page_index", "html", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    met = a.join(b, [DOC, "page_index"]).where(G.iou("a_", "b_") >= least)
    return met.groupBy(DOC, "page_index", "block_index").agg(F.count("*").alias("n"), F.min("html").alias("html")).where("n = 1").drop("n")


def cells_at(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """cells(table_id, r, c, rowspan, colspan, text), asked(table_id, row, col): the cell whose span covers a place; null where none does."""
    grid = cells.select("table_id", "r", "c", "text", "colspan", F.explode(F.sequence("r", F.col("r") + F.col("rowspan") - 1)).alias("row")).select("table_id", "r", "c", "text", "row", F.explode(F.sequence("c", F.col("c") + F.col("colspan") - 1)).alias("col"))
    one = grid.groupBy("table_id", "row", "col").agg(F.min(F.struct("r", "c", "text")).alias("x"))
    return asked.join(one, ["table_id", "row", "col"], "left").select("table_id", "row", "col", "x.text", F.col("x.r").alias("r"), F.col("x.c").alias("c"))
