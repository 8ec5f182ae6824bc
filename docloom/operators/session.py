"""Search units, search sessions and previews: what is searched, how routes become one list, what of it is shown.

Null texts are empty; ties are broken by ids; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import drop_adjacent_repeats, html_to_text, normalize_text
from docloom.operators.retrieval import BATCH, rrf, stable_shuffle_key
from docloom.operators.relations import DOC


def display_label(label: Column, text: Column) -> Column:
    """A visual's label, or else the first line of its text, at most 120 characters of it."""
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.nullif(F.substring(F.substring_index(F.trim(text), "\n", 1), 1, 120), F.lit("")))


def search_texts(elements: DataFrame, paths: DataFrame, pages: DataFrame) -> DataFrame:
    """elements(document_id, element_id, page_index, element_type, text, html, label, generated, section_id), paths(document_id, section_id, path), pages(document_id, page_index) -> content, search text and the reason why a unit is left out.

    Headings are searched without their own title in the path, figures and charts by label and text unless that is generated, tables by their HTML and
    text, or the label where both are empty; everything else by its text. The search text is the path and the content, without adjacent repeats.
    """
    text, label = normalize_text(F.coalesce("text", F.lit(""))), normalize_text(F.coalesce("label", F.lit("")))
    visual = F.col("element_type").isin("figure", "chart")
    join = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")
    table = join(html_to_text(F.coalesce("html", F.lit(""))), text)
    content = F.when(visual & F.col("generated"), label).when(visual, join(label, text)).when(F.col("element_type") == "table", F.when(table != "", table).otherwise(label)).otherwise(text)
    rows = elements.join(paths, [DOC, "section_id"], "left").join(pages.select(DOC, "page_index", F.lit(True).alias("_paged")), [DOC, "page_index"], "left")
    path = F.coalesce("path", F.array().cast("array<string>"))
    own = F.when((F.col("element_type") == "heading") & (F.element_at(F.concat(path, F.array(F.lit(""))), F.greatest(F.size(path), F.lit(1))) == text), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    rows = rows.select(DOC, "element_id", "element_type", content.alias("content"), own.alias("_own"), "generated", "_paged")
    skipped = (
        F.when(F.col("_paged").isNull(), "missing_page").when(visual & F.col("generated") & (F.col("content") == ""), "unverified_generated_visual_text").when(visual & (F.col("content") == ""), "no_searchable_visual_text").when(F.col("content") == "", "empty_searchable_content")
    )
    searched = F.array_join(drop_adjacent_repeats(F.filter(F.concat("_own", F.array("content")), lambda x: F.trim(x) != "")), "\n")
    return rows.select(DOC, "element_id", "content", F.when(skipped.isNull(), searched).alias("search_text"), skipped.alias("skipped"))


def text_visual_quota(text: DataFrame, visual: DataFrame, n_text: int = 3, n_visual: int = 2) -> DataFrame:
    """text, visual(query_id, element_id, rank) -> batches of n_text and n_visual while both last, then of what is left; an element of both lists is the text's. Inside a batch the order is a stable hash, so that it says nothing of the routes."""
    own = visual.join(text.select("query_id", "element_id"), ["query_id", "element_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "element_id"))
    parts = [d.withColumn("_k", nth).select("query_id", "element_id", F.lit(r).alias("route"), F.floor((F.col("_k") - 1) / n).alias("batch")) for d, r, n in ((text, "text", n_text), (own, "visual", n_visual))]
    place = F.row_number().over(Window.partitionBy("query_id", "batch").orderBy(stable_shuffle_key(F.col("query_id"), F.col("element_id")), "element_id"))
    return parts[0].unionByName(parts[1]).withColumn("place", place)


def start(rankings: DataFrame, policy: str, weights: dict[str, float], exact: DataFrame | None = None, size: int = BATCH) -> DataFrame:
    """rankings(query_id, route, element_id, page_number, rank) -> the first batch of a session: (query_id, element_id, position, batch). exact(query_id, element_id) are shown beforehand and left out here."""
    if exact is not None:
        rankings = rankings.join(exact, ["query_id", "element_id"], "left_anti")
    if policy == "rrf":
        ranked = rrf(rankings, weights).select("query_id", "element_id", "position")
    elif policy == "round_robin":
        from docloom.operators.retrieval import round_robin

        ranked = round_robin(rankings, list(weights)).select("query_id", "element_id", "position")
    elif policy in weights:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "element_id"))
        ranked = rankings.where(F.col("route") == policy).select("query_id", "element_id", place.alias("position"))
    else:
        raise ValueError(f"no such policy: {policy}")
    return ranked.where(F.col("position") <= size).withColumn("batch", F.lit(0))


def identity_errors(results: DataFrame, fields: tuple[str, ...] = ("question_id", "document_id", "index_version")) -> DataFrame:
    """results(session, route, fields): (session, field, values) where the results of a session differ in what must be one."""
    rows = results.select("session", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("session", "x.*")
    return rows.groupBy("session", "field").agg(F.sort_array(F.collect_set(F.coalesce("value", F.lit("null")))).alias("v")).where(F.size("v") > 1).select("session", "field", F.array_join("v", ",").alias("values"))


def candidate_errors(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """candidates(document_id, element_id, page_index, element_type) against units of the same: (document_id, element_id, error); elements are told apart by document."""
    own = units.select(DOC, "element_id", *(F.col(c).alias(f"_{c}") for c in ("page_index", "element_type")), F.lit(True).alias("_known")).distinct()
    met = candidates.join(own, [DOC, "element_id"], "left")
    rules = [F.when(F.col("_known").isNull(), "unknown_unit")] + [F.when(F.col(f"_{c}") != F.col(c), f"other_{c}") for c in ("page_index", "element_type")]
    return met.select(DOC, "element_id", F.explode(F.array_compact(F.array(*rules))).alias("error"))


def table_preview(rows: DataFrame, labels: int = 6) -> DataFrame:
    """rows(query_id, table_id, r, cells, header, relevance): header line, best row with one before and after, first cells of other rows, and whether the rows align with the header.

    cells are arrays of texts. A row of another number of cells than the header is a warning.
    """
    line = lambda c: F.array_join(F.transform(c, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), " | ")
    key = ["query_id", "table_id"]
    heads = rows.where("header").groupBy(*key).agg(F.min_by(F.struct(line(F.col("cells")).alias("line"), F.size("cells").alias("n")), "r").alias("h"))
    w = Window.partitionBy(*key).orderBy("r")
    body = rows.where("not header").select(*key, "r", line(F.col("cells")).alias("line"), F.get("cells", F.lit(0)).alias("label"), F.size("cells").alias("n"), "relevance")
    body = body.withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)})
    best = body.groupBy(*key).agg(F.max_by(F.struct("r", "before", "line", "after"), F.struct("relevance", -F.col("r"))).alias("b"), F.sort_array(F.collect_list(F.struct("r", "label", "n"))).alias("all"))
    met = best.join(heads, key, "left")
    others = F.transform(F.slice(F.filter("all", lambda x: (F.abs(x["r"] - F.col("b.r")) > 1)), 1, labels), lambda x: x["label"])
    clear = F.forall("all", lambda x: x["n"] == F.coalesce(F.col("h.n"), x["n"]))
    return met.select(*key, F.col("h.line").alias("header"), F.col("b.r").alias("row"), "b.before", F.col("b.line").alias("best"), "b.after", F.array_join(others, ", ").alias("others"), clear.alias("aligned"))


def row_hints(rows: DataFrame, most: int = 3) -> DataFrame:
    """rows(query_id, table_id, r, line, overlap): all rows at a query's best overlap, three at most, the first ones."""
    w = Window.partitionBy("query_id", "table_id")
    best = rows.where("overlap > 0").withColumn("_top", F.max("overlap").over(w)).where("overlap = _top")
    return best.withColumn("place", F.row_number().over(w.orderBy("r"))).where(F.col("place") <= most).drop("_top")


def scope_audit(rankings: DataFrame, first: int = 5) -> DataFrame:
    """rankings(query_id, route, rank, scope): how many of each route's first five match in metadata alone."""
    own = rankings.where(F.col("rank") <= first)
    return own.groupBy("route").agg(F.count("*").alias("shown"), F.count_if(F.col("scope") == "metadata").alias("metadata"), F.countDistinct(F.when(F.col("scope") == "metadata", F.col("query_id"))).alias("queries"))


def visible_errors(actions: DataFrame, visible: DataFrame) -> DataFrame:
    """actions(action_id, session, step, ids array), visible(session, step, id): (action_id, id) of what an action names without having been shown it at its step."""
    named = actions.select("action_id", "session", "step", F.explode("ids").alias("id"))
    return named.join(visible, ["session", "step", "id"], "left_anti").select("action_id", "id")
