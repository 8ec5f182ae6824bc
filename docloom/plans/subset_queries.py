"""Splits of documents by seeded trials, and sources that cover a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN, casefold
from docloom.operators import subsets as S
from docloom.plans.registry import query, read

SHARE = 0.2


def words_of_sources(documents: DataFrame) -> DataFrame:
    """documents(source, text) -> (item_id, element): each folded token of a source, as base_tokens() has them. Tokens are cut from the texts as they are, and each different one of a source is folded once."""
    cut = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    found = documents.select(F.col("source").alias("item_id"), F.explode(F.array_distinct(cut)).alias("element")).distinct()
    return found.select("item_id", casefold(F.col("element")).alias("element"))


@query()
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the reports (ten documents each) that holds a fifth of each language's documents and of all characters, the best of 50,000 trials."""
    items = read(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("item_id")).agg(*(F.count_if(F.col("lang") == x).alias(x) for x in ("de", "en", "es", "fr")), F.sum("n_chars").alias("chars"))
    totals = items.agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in items.columns[1:])).first()
    return S.balanced(items, round(SHARE * totals["items"]), {c: SHARE * (totals[c] or 0) for c in items.columns[1:]})


@query(f"""with t as (select distinct source as item_id, unnest(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: replace(lower(x), 'ß', 'ss'))) as element from documents), g as (select item_id, count(*) as gain from t group by item_id)
    select 0 as round, item_id, gain from g order by gain desc, item_id limit 1""")
def vocabulary_cover_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source that covers most words."""
    return S.cover(words_of_sources(read(spark, sf_dir, "documents")), 1)


@query()
def vocabulary_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources one by one, each by the words it adds, until all words are covered or eight are taken."""
    return S.cover(words_of_sources(read(spark, sf_dir, "documents")), 8)
