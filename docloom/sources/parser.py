"""Parser artifacts: pages of typed blocks with a layout, as tables of pages, elements and warnings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.geometry import normalized

# Fixed values of the format: block types and what they become.
BLOCK_TYPES = {
    "title": "heading", "heading": "heading", "paragraph": "paragraph", "text": "paragraph", "table": "table", "image": "figure", "figure": "figure", "chart": "chart", "code": "code", "algorithm": "algorithm", "caption": "caption",
    "footnote": "footnote", "page_footnote": "footnote", "page_header": "paragraph", "page_footer": "paragraph", "header": "paragraph", "footer": "paragraph", "list": "list", "index": "list", "equation": "equation", "equation_interline": "equation",
}
IGNORED = ("page_number", "page_aside_text")
KNOWN_KEYS = ("type", "bbox", "content", "sub_type", "anchor", "score")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_index, page_number, width, height) of a layout file."""
    schema = "doc_id string, title string, pdf_info array<struct<page_idx:int,page_number:int,page_size:array<double>>>"
    pages = spark.read.schema(schema).json(path, multiLine=True).select("doc_id", F.explode("pdf_info").alias("p"))
    return pages.select("doc_id", F.col("p.page_idx").alias("page_index"), F.coalesce("p.page_number", F.col("p.page_idx") + 1).alias("page_number"), F.col("p.page_size")[0].alias("width"), F.col("p.page_size")[1].alias("height"))


def read_blocks(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """(doc_id, page_index, block_index, type, bbox, block) of content files: pages of blocks; a block stays a variant, for its content differs by type.

    A document is named by doc_id, or by its file: what stands before "_content" or the ending in the file's name, or its folder's name where that is nothing.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)/([^/]*)$", 2)
    own = F.regexp_replace(name, r"(?:_?content(?:_list)?(?:_v[0-9]+)?)?\.json$", "")
    key = F.lit(doc_id) if doc_id is not None else F.when(own != "", own).otherwise(F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1))
    text = spark.read.text(path, wholetext=True).select(key.alias("doc_id"), F.try_parse_json("value").alias("v"))
    pages = text.select("doc_id", F.posexplode(F.expr("variant_get(v, '$', 'array<array<variant>>')")).alias("page_index", "blocks"))
    blocks = pages.select("doc_id", "page_index", F.posexplode("blocks").alias("block_index", "block"))
    return blocks.select("doc_id", "page_index", "block_index", F.expr("try_variant_get(block, '$.type', 'string')").alias("type"), F.expr("try_variant_get(block, '$.bbox', 'array<double>')").alias("bbox"), "block")


def spans_text(name: str) -> Column:
    """The texts of an array of spans, joined by spaces."""
    spans = F.expr(f"try_variant_get(block, '$.content.{name}', 'array<struct<type:string,content:string>>')")
    return F.nullif(F.array_join(F.transform(spans, lambda s: s["content"]), " "), F.lit(""))


def elements(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """Elements with the captions and footnotes derived from visual blocks, their boxes in [0, 1] or null."""
    kinds = F.create_map(*(F.lit(x) for kv in BLOCK_TYPES.items() for x in kv))
    own = blocks.where(~F.col("type").isin(*IGNORED)).withColumn("element_type", kinds[F.col("type")]).where("element_type is not null")
    texts = [spans_text(f"{k}_content") for k in ("title", "paragraph", "text", "list", "code", "equation")]
    get = lambda path, kind: F.expr(f"try_variant_get(block, '$.{path}', '{kind}')")
    box = "array<double>"
    part = lambda kind, text, html, bbox, order: F.struct(kind.alias("element_type"), text.alias("text"), html.alias("html"), bbox.alias("bbox"), F.lit(order).alias("part"))
    none = F.lit(None).cast("string")
    parts = F.array(
        part(F.col("element_type"), F.coalesce(*texts, get("content.content", "string")), get("content.html", "string"), F.col("bbox"), 1),
        *(part(F.lit(kind), spans_text(f"{v}_{kind}"), none, get(f"content.{kind}_bbox", box), order) for v in ("table", "image", "chart") for kind, order in (("caption", 0), ("footnote", 2))),
    )
    rows = own.select("doc_id", "page_index", "block_index", "type", F.explode(parts).alias("e")).where("e.part = 1 or e.text is not null")
    rows = rows.select("doc_id", "page_index", "block_index", "type", "e.*", *(F.col("e.bbox")[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))))
    placed = rows.join(layout, ["doc_id", "page_index"], "left").withColumn("box", normalized("", F.col("width"), F.col("height"))).drop("x1", "y1", "x2", "y2", "bbox")
    order = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("block_index", "part")) - 1
    placed = placed.withColumn("reading_order", order)
    visual = F.col("element_type").isin("figure", "chart", "table")
    available = F.when(visual & (F.col("text").isNotNull() | F.col("html").isNotNull()) & (F.col("element_type") != "table"), "mixed").when(F.col("html").isNotNull(), "structured").when(F.col("text").isNotNull(), "text_only").when(visual, "visual_only").otherwise("unavailable")
    return placed.withColumn("content_availability", available).drop("width", "height", "part")


def warnings(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page_index, block_index, warning): unknown block types, unknown fields, boxes that are none."""
    unknown = blocks.where(~F.col("type").isin(*BLOCK_TYPES, *IGNORED)).select("doc_id", "page_index", "block_index", F.concat(F.lit("unknown_type:"), "type").alias("warning"))
    keys = F.expr("map_keys(variant_get(block, '$', 'map<string,variant>'))")
    fields = blocks.select("doc_id", "page_index", "block_index", F.explode(F.array_except(keys, F.array(*(F.lit(k) for k in KNOWN_KEYS)))).alias("k")).select("doc_id", "page_index", "block_index", F.concat(F.lit("unknown_field:"), "k").alias("warning"))
    boxes = rows.where("box is null").select("doc_id", "page_index", "block_index", F.lit("no_box").alias("warning"))
    return unknown.union(fields).union(boxes)


def align(layout_blocks: DataFrame, content_blocks: DataFrame) -> DataFrame:
    """Blocks of two files matched within page and type by their order."""
    nth = lambda d, i: d.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page_index", "type").orderBy(i)))
    a = nth(content_blocks.select("doc_id", "page_index", "type", "block_index"), "block_index")
    b = nth(layout_blocks.select("doc_id", "page_index", "type", F.col("block_index").alias("layout_index")), "layout_index")
    return a.join(b, ["doc_id", "page_index", "type", "nth"], "left").select("doc_id", "page_index", "block_index", "layout_index")


def missing_embeddings(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key the cache does not hold."""
    return wanted.join(cache.select("key"), "key", "left_anti")


def fill_cache(wanted: DataFrame, cache: DataFrame, encode, path: str) -> None:
    """Encodes what is missing, one text once, and appends it to the cache table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "vector": [list(map(float, v)) for v in encode(frame["text"].tolist())]})

    todo = missing_embeddings(wanted, cache).dropDuplicates(["key"])
    todo.select("key", "text").mapInPandas(run, "key string, vector array<float>").write.mode("append").parquet(path)


def write_document(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below a folder; a failed run leaves no partial table behind that reads as whole."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the one of the last source."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")
