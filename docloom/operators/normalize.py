"""Normalisation of elements row by row and by their neighbours: types, numbered questions, notes, captions' labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import by_ascii

# Fixed patterns by which code is told from prose, one point each.
CODE_SIGNS = (
    r"(?m)^\s*(?:def|class|function|public|private|static|import|from|#include|package)\b", r"[{}];?\s*(?m:$)", r"(?m);\s*$", r"\b(?:if|for|while|switch)\s*\(", r"(?:==|!=|&&|\|\||->|=>|:=|\+=)", r"\b[A-Za-z_]\w*\([^)]*\)\s*[;{:]", r"(?m)^\s{4,}\S", r"(?m)^\s*(?://|#|--)\s",
)


def code_score(text: Column, language: Column) -> Column:
    total = F.when(F.coalesce(language, F.lit("")) != "", 2).otherwise(0)
    for pattern in CODE_SIGNS:
        total = total + F.when(F.rlike(text, F.lit(by_ascii(pattern))), 1).otherwise(0)
    return total


def code_kind(text: Column, language: Column) -> Column:
    """algorithm, figure (a screen), code or paragraph, by the first rule that holds."""
    return (
        F.when(F.rlike(text, F.lit(r"(?i)^\s*algorithm\s+[0-9]+")), "algorithm").when(F.rlike(text, F.lit(r"(?i)\b(?:click|button|menu|window|tab)\b")) & (code_score(text, language) == 0) & (F.length(text) < 200), "figure")
        .when(F.rlike(text, F.lit(r"(?i)^\s*(?:system|user|assistant|prompt)\s*:")), "code").when(code_score(text, language) >= 2, "code").otherwise("paragraph")
    )


def numbered_units(items: DataFrame) -> DataFrame:
    """items(element_id, text): lists split where a new number begins."""
    parts = F.filter(F.split("text", r"\n(?=\s*(?:[0-9]{1,3}[.)]|Q[0-9]+)\s)"), lambda x: F.trim(x) != "")
    return items.select("element_id", F.posexplode(parts).alias("unit", "text")).withColumn("number", F.regexp_extract("text", r"^\s*(?:Q)?([0-9]{1,3})[.)]?\s", 1))


def question_runs(elements: DataFrame) -> DataFrame:
    """Runs of blocks on a page that are all numbered questions, of two blocks at least: gaps and islands."""
    is_question = F.rlike("text", F.lit(r"^\s*(?:Q?[0-9]{1,3}[.)])\s+.*\?\s*$"))
    w = Window.partitionBy("document_id", "page_index").orderBy("reading_order")
    marked = elements.withColumn("q", F.coalesce(is_question, F.lit(False))).withColumn("rn", F.row_number().over(w))
    runs = marked.where("q").withColumn("island", F.col("rn") - F.row_number().over(w))
    return runs.groupBy("document_id", "page_index", "island").agg(F.count("*").alias("blocks"), F.min("reading_order").alias("first"), F.max("reading_order").alias("last")).where("blocks >= 2").drop("island")


def lettered_notes(elements: DataFrame) -> DataFrame:
    """Paragraphs right after a table that are lettered a, b, c in order, two at least: (table_id, element_id, letter)."""
    w = Window.partitionBy("document_id", "page_index").orderBy("reading_order")
    letter = F.regexp_extract("text", r"^\s*\(?([a-z])[).]\s", 1)
    rows = elements.withColumn("letter", F.when(F.col("element_type") == "paragraph", letter)).withColumn("table_id", F.last(F.when(F.col("element_type") == "table", F.col("element_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("since", F.row_number().over(Window.partitionBy("document_id", "page_index", "table_id").orderBy("reading_order")) - 2).where("table_id is not null and element_type <> 'table'")
    fit = rows.where(F.coalesce(F.ascii("letter"), F.lit(0)) == F.ascii(F.lit("a")) + F.col("since"))
    return fit.withColumn("n", F.count("*").over(Window.partitionBy("document_id", "table_id"))).where("n >= 2").select("document_id", "table_id", "element_id", "letter")


def footnote_kind(text: Column, profile: Column, next_types: Column, overlap: Column, has_target: Column) -> Column:
    """Struct(kind, confidence, resolved) of a parser's footnote by the first rule that holds."""
    made = lambda kind, confidence, resolved: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(resolved).alias("resolved"))
    prefixed = F.rlike(text, F.lit(r"^\s*(?:\*+|[†‡§]|\[?[0-9]{1,3}\]?[.)]?|[a-z][.)])\s"))
    return (
        F.when(F.rlike(text, F.lit(r"(?i)^\s*(?:source|sources|photo|credit|image)s?\s*:")), made("footnote", 0.97, True)).when(F.rlike(text, F.lit(r"(?i)^\s*(?:step\s+[0-9]|call\b|visit\b|contact\b|e-?mail\b)")), made("paragraph", 0.94, True))
        .when((profile == "slides") & (F.length(text) < 80) & ~prefixed, made("paragraph", 0.92, True)).when(prefixed, made("footnote", 0.98, True)).when(F.array_contains(next_types, "table"), made("paragraph", 0.95, True))
        .when(~has_target, made("footnote", 0.70, False)).when(overlap >= 0.30, made("paragraph", 0.96, True)).otherwise(made("footnote", 0.70, True))
    )


def leading_label(text: Column) -> Column:
    """Struct(kind, number) of the label that a caption begins with, or null."""
    kind = F.lower(F.regexp_extract(text, r"(?i)^\s*(figure|fig\.?|table|tab\.|chart|listing)\s*([0-9]+(?:\.[0-9]+)*[a-z]?|[IVXLC]+)\b", 1))
    number = F.lower(F.regexp_extract(text, r"(?i)^\s*(?:figure|fig\.?|table|tab\.|chart|listing)\s*([0-9]+(?:\.[0-9]+)*[a-z]?|[IVXLC]+)\b", 1))
    name = F.when(kind.startswith("fig"), "figure").when(kind.startswith("tab"), "table").when(kind != "", kind)
    return F.when(name.isNotNull(), F.struct(name.alias("kind"), number.alias("number")))
