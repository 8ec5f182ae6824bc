"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, release

#: Steps halve the distance to the smallest id; so many would do for 2**60 nodes in a row. More is an error.
MAX_STEPS = 64


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any order, loops and repeats allowed -> (node, component): the smallest id reachable, for every node of an edge.

    Each step is an aggregate with map-side combine and a join that Spark may split, so a node with very
    many edges is no bottleneck. An empty edge table gives an empty result; edges with a null end are dropped.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    for _ in range(MAX_STEPS):
        # large star: every neighbour above u is tied to the least of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its neighbours below u are tied to the least of these; u > v holds in every row
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, now = now, cut_lineage(small)
        release(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components have not settled after {MAX_STEPS} steps")
    # every node now points at its root; the roots point at themselves
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
