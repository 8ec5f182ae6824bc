"""Tables in and out: page-label signals of parser files, document tables, run packets, rule reports, and files of any format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.geometry import normalized
from docloom.sources.parser import spans_text

#: Schemas of the tables that parser.write_document() writes.
SCHEMAS = {
    "pages": "document_id string, page_id string, page_index long, page_number long, width double, height double",
    "elements": "document_id string, element_id string, page_index long, reading_order long, element_type string, text string, x1 double, y1 double, x2 double, y2 double, section_id string",
    "sections": "document_id string, section_id string, title string, level long, parent_id string",
    "relations": "document_id string, relation_id string, source_id string, target_id string, kind string, confidence double, origin long",
}


def page_label_signals(blocks: DataFrame, layout: DataFrame, margin: tuple[float, float] = (0.10, 0.87)) -> DataFrame:
    """The page numbers that a parser has set aside: (doc_id, page_index, text, box, marginal); blocks and layout as the parser source reads them."""
    text = F.coalesce(spans_text("page_number_content"), F.expr("try_variant_get(block, '$.content.content', 'string')"), F.expr("try_variant_get(block, '$.text', 'string')"))
    rows = blocks.where("type = 'page_number'").select("doc_id", "page_index", "block_index", F.trim(text).alias("text"), *(F.col("bbox")[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))))
    placed = rows.where("text <> ''").join(layout, ["doc_id", "page_index"], "left").withColumn("box", normalized("", F.col("width"), F.col("height")))
    return placed.select("doc_id", "page_index", "text", "box", F.coalesce((F.col("box.y2") <= margin[0]) | (F.col("box.y1") >= margin[1]), F.lit(False)).alias("marginal"))


def load_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables below a folder that parser.write_document() wrote; a table that is not there is empty."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = {s.getPath().getName() for s in files.listStatus(root)}
    return {k: spark.read.schema(s).json(f"{path}/{k}") if k in there else spark.createDataFrame([], s) for k, s in SCHEMAS.items()}


def write_run(rows: DataFrame, path: str) -> None:
    """rows(run_id, component, ...): the packets of runs, a folder for each run and component; a run that is written again replaces its own folders alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "component").json(path)


def read_run(spark: SparkSession, path: str, run_id: str, schema: str) -> DataFrame:
    """The packets of one run; other runs' folders are not read."""
    whole = StructType.fromDDL(f"{schema}, run_id string, component string")
    return spark.read.schema(whole).json(path).where(F.col("run_id") == run_id)


def coverage_markdown(coverage: DataFrame) -> str:
    """A rule-coverage table (few rows: one a rule) as Markdown, rules in order."""
    lines = ["| rule | firings | documents | statuses | samples |", "| --- | --- | --- | --- | --- |"]
    for r in coverage.orderBy("rule_id").collect():
        lines.append(f"| {r.rule_id} | {r.firings} | {r.documents} | {', '.join(r.statuses)} | {', '.join(r.samples)} |")
    return "\n".join(lines) + "\n"


def write_coverage(coverage: DataFrame, path: str) -> None:
    """A rule-coverage table as JSON lines and, beside them, as Markdown."""
    coverage.write.mode("overwrite").json(f"{path}/rules")
    spark = coverage.sparkSession
    spark.createDataFrame([(coverage_markdown(coverage).removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def read_table(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of any format that Spark has a reader for (parquet, orc, json, csv, avro, jdbc, kafka ...), with a schema where the format has none of its own."""
    reader = spark.read.format(kind).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load(path) if path else reader.load()
