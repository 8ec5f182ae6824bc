"""The corpus pipeline over documents: quality, near-duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.

Defined results: null texts are scored, compared, searched and packed as empty ones, and stay null until they are packed; documents
without words are taken by no mix, so they end there; rows with a null doc_id are never near copies of others, and are mixed and packed
like the rest; of rows that repeat an id and a text one stays; ties go to the smallest doc_id; an empty table gives an empty result; columns
beyond those of documents are kept until the mix, whatever their names but those that begin with "_mix_" or "_minhash_".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import minhash, mixing, packing, quality, secrets
from docloom.llm.common import table
from docloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return minhash.distinct_documents(docs, minhash.FIVE_80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mask."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The classifier, the sketches and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
