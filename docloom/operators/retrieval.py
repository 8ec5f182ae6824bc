"""Retrieval: postings, BM25, dense and late-interaction scores, rank fusion, batches, snippets and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import base_tokens
from docloom.lineage import cut_lineage

K1, B = 1.2, 0.75
RRF_K, BM25_WEIGHT, DENSE_WEIGHT, VISUAL_WEIGHT = 20, 1.0, 1.25, 1.0
BATCH = 5


def with_terms(units: DataFrame, text: str = "line") -> DataFrame:
    """Units with their terms and length; a unit without terms is kept, for it counts in the average."""
    return units.withColumn("terms", base_tokens(F.col(text))).withColumn("length", F.size("terms"))


def postings(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf, length) of units with terms."""
    return units.select(*keys, "length", F.explode("terms").alias("term")).groupBy(*keys, "length", "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def count_terms(units: DataFrame, query: list[str], keys: list[str]) -> DataFrame:
    """units with terms and length -> keys, length, tf0, tf1 ...: how often each has the query's terms. Terms hold no spaces, so they are counted in the spaced text."""
    spaced = F.concat(F.lit(" "), F.array_join("terms", "  "), F.lit(" "))
    rows = units.select(*keys, "length", spaced.alias("_spaced"))
    count = lambda t: ((F.octet_length("_spaced") - F.octet_length(F.replace("_spaced", F.lit(f" {t} "), F.lit("")))) / F.octet_length(F.lit(f" {t} "))).cast("int")
    return rows.select(*keys, "length", *(count(t).alias(f"tf{i}") for i, t in enumerate(query)))


def bm25(units: DataFrame, query: list[str], keys: list[str], scope: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """Scores of the units that hold a query term: keys, score, matched.

    units: with terms and length; scope: the columns within which units are counted (none: the corpus). A query without terms finds nothing.
    Texts are read once: a unit's length and its counts of the query's terms are written as a table of a few numbers a unit, from which come the
    statistics of a scope and the units that match. No posting of another term is ever shuffled.
    """
    query = sorted(set(query))
    if not query:
        return units.select(*keys, F.lit(0.0).alias("score"), F.lit(0).alias("matched")).where("false")
    counted = cut_lineage(count_terms(units, query, keys))
    stats = counted.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    hits = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(query))))
    # without a scope the statistics are one row
    hits = hits.join(stats, scope) if scope else hits.crossJoin(F.broadcast(stats))
    part = lambda i: F.when(F.col(f"tf{i}") > 0, idf(F.col("n"), F.col(f"df{i}")) * (F.col(f"tf{i}") * (k1 + 1)) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))).otherwise(0.0)
    score = sum((part(i) for i in range(1, len(query))), part(0))
    matched = sum((F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in range(1, len(query))), F.when(F.col("tf0") > 0, 1).otherwise(0))
    return hits.select(*keys, score.alias("score"), matched.alias("matched"))


def best_part(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by a total order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rn = 1").drop("_rn")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def valid_vector(a: Column, dimension: int) -> Column:
    return (F.size(a) == dimension) & ~F.exists(a, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (norm(a) > 0)


def cosine_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> with score, clipped to [-1, 1]; the query is a constant of the plan."""
    q = F.array(*(F.lit(float(v)) for v in query))
    score = dot(F.col("embedding"), q) / (norm(F.col("embedding")) * norm(q))
    return vectors.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def late_interaction(passages: DataFrame, query: list[list[float]]) -> DataFrame:
    """passages(id, tokens array<array<float>>) -> (id, score): the sum over query vectors of the best match."""
    q = np.array(query, float)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tokens in frame["tokens"]:
                m = np.array([list(t) for t in tokens], float)
                out.append(float((q @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T).max(1).sum()) if len(m) else 0.0)
            yield pd.DataFrame({"id": frame["id"], "score": out})

    return passages.select("id", "tokens").mapInPandas(score, "id string, score double")


def rrf(rankings: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """rankings(query_id, route, element_id, page_number, rank) -> fused ranking per query: one aggregate over all routes."""
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    fused = rankings.where(F.col("route").isin(*weights)).groupBy("query_id", "element_id").agg(
        F.sum(weight[F.col("route")] / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), F.min("page_number").alias("page_number"))
    fused = fused.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "page_number", "element_id")
    return fused.withColumn("position", F.row_number().over(order))


def round_robin(rankings: DataFrame, routes: list[str]) -> DataFrame:
    """Ranks taken in turns, earlier routes first; an element keeps its first place."""
    turn = F.array_position(F.array(*(F.lit(r) for r in routes)), F.col("route"))
    first = rankings.where(F.col("route").isin(*routes)).groupBy("query_id", "element_id").agg(F.min(F.struct(F.col("rank"), turn.alias("turn"))).alias("at"))
    return first.select("query_id", "element_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "element_id")).alias("position"))


def fixed_quota(rankings: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Batches of a fixed number from each route; what one route lacks or repeats the next ones fill up.

    One query's lists are walked together, for where an element goes depends on all before it.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        lists = {r: frame[frame["route"] == r].sort_values(["rank", "element_id"])["element_id"].tolist() for r in quotas}
        at, seen, out = dict.fromkeys(quotas, 0), set(), []

        def take(route: str, n: int) -> int:
            while n and at[route] < len(lists[route]):
                x = lists[route][at[route]]
                at[route] += 1
                if x not in seen:
                    seen.add(x)
                    out.append((x, route))
                    n -= 1
            return n

        while any(at[r] < len(lists[r]) for r in quotas):
            lacking = sum(take(r, n) for r, n in quotas.items())
            for r in quotas:
                lacking = take(r, lacking)
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "element_id": [x for x, _ in out], "route": [r for _, r in out], "position": range(1, len(out) + 1)})

    return rankings.groupBy("query_id").applyInPandas(lambda f: walk(f), "query_id string, element_id string, route string, position int")


def batches(ranked: DataFrame, size: int = BATCH) -> DataFrame:
    """Ranked rows with the batch and the place inside it."""
    return ranked.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int")).withColumn("place", ((F.col("position") - 1) % size).cast("int"))


def next_batch(session: DataFrame, ranked: DataFrame, size: int = BATCH) -> DataFrame:
    """session(query_id, cursor): the next rows of each query; what was shown is always a prefix of the ranking."""
    return ranked.join(session, "query_id").where((F.col("position") > F.col("cursor")) & (F.col("position") <= F.col("cursor") + size))


def stable_shuffle_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, 12)


def snippet_bounds(text: Column, start: Column, end: Column, most: int = 320, context: int = 80) -> tuple[Column, Column]:
    """Begin and end (0-based) of a window of at most `most` characters around [start, end), with some context before."""
    n = F.length(text)
    begin = F.greatest(F.lit(0), start - context)
    begin = F.when(end - begin > most, start).otherwise(begin)
    stop = F.least(n, begin + most)
    return F.greatest(F.lit(0), F.least(begin, stop - most)), stop


def metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked(query_id, element_id, position), gold(query_id, element_id) -> recall, reciprocal rank and gain of each query."""
    hit = gold.join(ranked, ["query_id", "element_id"], "left")
    per = hit.groupBy("query_id").agg(
        F.count("*").alias("gold"), *((F.count_if(F.col("position") <= k) / F.count("*")).alias(f"recall_{k}") for k in (1, 5, 10)),
        F.coalesce(1 / F.min("position"), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(F.when(F.col("position") <= 10, 1 / F.log2(F.col("position") + 1))), F.lit(0.0)).alias("dcg"),
        F.floor((F.min("position") - 1) / BATCH).alias("first_batch"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.withColumn("ndcg_10", F.col("dcg") / ideal).drop("dcg")


def required_vectors(shards: DataFrame, required: DataFrame, key: str = "sha256") -> DataFrame:
    """The vectors whose key is asked for, each once; where a key has several, the one of the last shard."""
    own = shards.join(required.select(key).distinct(), key, "left_semi")
    return best_part(own, [key], [F.desc("shard")])


def visible(rows: DataFrame, hidden: tuple[str, ...] = ("score", "rank", "best_rank", "route", "bm25_rank", "dense_rank")) -> DataFrame:
    """Rows without what a policy must not see: scores, ranks and routes."""
    return rows.drop(*hidden)
