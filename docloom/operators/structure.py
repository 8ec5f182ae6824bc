"""Document structure by aggregates and windows: furniture, profiles, outlines, page labels, continuations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated_lines(lines: DataFrame, group: list[str], least_pages: int = 3) -> DataFrame:
    """lines(doc, page, text): texts on as many pages of their document as furniture is: min(least, max(2, pages))."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    found = lines.groupBy("doc", *group).agg(F.countDistinct("page").alias("on_pages"), F.count("*").alias("times"), F.min("page").alias("first_page"))
    return found.join(pages, "doc").where(F.col("on_pages") >= F.least(F.lit(least_pages), F.greatest(F.lit(2), F.col("pages"))))


def density_profile(elements: DataFrame) -> DataFrame:
    """elements(doc, page, n_chars) -> page medians and the share of sparse pages of each document."""
    page = elements.groupBy("doc", "page").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("items"))
    sparse = (F.col("chars") <= 1600) & (F.col("items") <= 24)
    return page.groupBy("doc").agg(F.count("*").alias("pages"), F.percentile("chars", F.lit(0.5)).alias("median_chars"), F.percentile("items", F.lit(0.5)).alias("median_items"), F.avg(sparse.cast("int")).alias("sparse_ratio"))


def profile(features: DataFrame) -> DataFrame:
    """features of a document -> its profile and confidence, by the first rule that holds."""
    c = F.col
    rules = [
        ("academic", 0.94, c("has_abstract") | (c("has_references") & (c("numbered_headings") >= 2))), ("manual", 0.96, (c("chapter_headings") >= 2) | (c("has_contents") & c("has_index"))),
        ("form", 0.94, (c("section_labels") >= 3) & ((c("table_ratio") >= 0.08) | (c("full_page_tables") >= 3))), ("brochure", 0.95, c("brochure_identity")),
        ("brochure", 0.88, (c("brochure_terms") >= 6) & (c("repeated_short_headings") >= 2) & (c("sparse_ratio") >= 0.4) & ~c("has_abstract")),
        ("slides", 0.94, (c("pages") >= 4) & (c("landscape_ratio") >= 0.8) & (c("sparse_ratio") >= 0.7) & (c("median_chars") <= 1200) & (c("median_items") <= 18) & (c("pattern_ratio") >= 0.25)),
    ]
    choice = F.when(F.lit(False), F.struct(F.lit("").alias("profile"), F.lit(0.0).alias("confidence")))
    for name, confidence, rule in rules:
        choice = choice.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(name).alias("profile"), F.lit(confidence).alias("confidence")))
    return features.withColumn("x", choice.otherwise(F.struct(F.lit("report").alias("profile"), F.lit(0.7).alias("confidence")))).select("*", "x.*").drop("x")


def interpolate_labels(pages: DataFrame, most: int = 12) -> DataFrame:
    """pages(page_index, label number or null) -> labels of pages between two labelled ones whose numbers and places grow alike."""
    known = pages.where("number is not null").withColumn("next_page", F.lead("page_index").over(Window.partitionBy("doc").orderBy("page_index"))).withColumn("next_number", F.lead("number").over(Window.partitionBy("doc").orderBy("page_index")))
    gap = F.col("next_page") - F.col("page_index")
    fit = known.where((gap > 1) & (gap <= most) & (F.col("next_number") - F.col("number") == gap))
    return fit.select("doc", F.explode(F.sequence(F.col("page_index") + 1, F.col("next_page") - 1)).alias("p"), "page_index", "number").select("doc", F.col("p").alias("page_index"), (F.col("number") + F.col("p") - F.col("page_index")).alias("number"))


def label_runs(pages: DataFrame, least: int = 3) -> DataFrame:
    """Runs of labelled pages in step (gaps and islands): doc, first page, last page, first number, length."""
    rn = F.row_number().over(Window.partitionBy("doc").orderBy("page_index"))
    islands = pages.where("number is not null").withColumn("island", F.col("page_index") - rn).withColumn("offset", F.col("number") - F.col("page_index"))
    return islands.groupBy("doc", "island", "offset").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.min("number").alias("first_number"), F.count("*").alias("length")).where(F.col("length") >= least)


def extrapolate_backward(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Unlabelled pages right before a run get the numbers that lead to it, down to 1."""
    labelled = pages.where("number is not null").select("doc", F.col("page_index").alias("q"))
    before = runs.join(labelled, "doc", "left").groupBy("doc", "first_page", "first_number").agg(F.coalesce(F.max(F.when(F.col("q") < F.col("first_page"), F.col("q"))), F.lit(-1)).alias("q"))
    start = F.greatest(F.col("q") + 1, F.col("first_page") - F.col("first_number") + 1)
    rows = before.withColumn("start", start).where("start < first_page")
    return rows.select("doc", F.explode(F.sequence("start", F.col("first_page") - 1)).alias("page_index"), "first_page", "first_number").select("doc", "page_index", (F.col("first_number") - F.col("first_page") + F.col("page_index")).alias("number"))


def outline_lines(headings: DataFrame) -> DataFrame:
    """headings(doc, pos, level, title) -> the outline of each document as indented lines."""
    line = F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.lit("- "), "title")
    return headings.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("outline"))
