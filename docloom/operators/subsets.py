"""Choosing some of many: subsets near given totals by seeded trials, and small sets that cover all by greedy rounds.

balanced() tries subsets that numbered seeds give. Trials are rows: each task draws and scores its own, with the items' features as one matrix, and one aggregate keeps the
best. Which subset a seed gives depends on the seed, the trial and the items' order by id alone. The matrix is sent to every task, so its size is checked.

cover() takes the item that covers most of what is not yet covered, round by round (ties: the smallest id); a round is an aggregate and an anti join.

Defined results: null features count 0; items of one id are one, features added up; with fewer items than asked for all are chosen; null elements need no cover, a null
item covers nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.lineage import cut_lineage, release

TRIALS = 50_000
#: Numbers of the matrix that is sent to tasks, at most.
SENT = 4_000_000
TOGETHER = 512


def drawn(seed: int, trial: int, n: int, size: int) -> np.ndarray:
    """The items of a trial, by their places."""
    return np.sort(np.random.default_rng((seed, trial)).permutation(n)[:size])


def score(features: np.ndarray, chosen: np.ndarray, targets: np.ndarray) -> float:
    """Distances to the targets, each as a share of it, summed."""
    return float((np.abs(features[chosen].sum(0) - targets) / np.maximum(np.abs(targets), 1.0)).sum())


def balanced(items: DataFrame, size: int, targets: dict[str, float], trials: int = TRIALS, seed: int = 7) -> DataFrame:
    """items(item_id, one column a target) -> (trial, score, item_id): the subset of so many items whose totals are nearest to the targets; ties go to the first trial."""
    names = list(targets)
    summed = items.where("item_id is not null").groupBy("item_id").agg(*(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in names))
    n = summed.count()
    if n * len(names) > SENT:
        raise ValueError(f"{n} items are more than may be sent to every task; choose among groups of them")
    rows = summed.orderBy("item_id").collect()
    ids, matrix, wanted = [r.item_id for r in rows], np.array([[r[c] for c in names] for r in rows]).reshape(n, len(names)), np.array([targets[c] for c in names], float)
    spark, k = items.sparkSession, min(size, n)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([score(matrix, drawn(seed, int(t), n, k), wanted) for t in numbers], pa.float64())], ["trial", "score"])

    best = spark.range(trials).mapInArrow(tried, "trial long, score double").agg(F.min(F.struct("score", "trial")).alias("x")).select("x.trial", "x.score").first()
    kind = items.schema["item_id"].dataType.simpleString()
    chosen = [] if best.trial is None else [(best.trial, best.score, ids[i]) for i in drawn(seed, best.trial, n, k)]
    return spark.createDataFrame(chosen, f"trial long, score double, item_id {kind}")


def cover(pairs: DataFrame, most: int) -> DataFrame:
    """pairs(item_id, element) -> (round, item_id, gain): items that together cover the elements, `most` of them at most, each by what it adds."""
    left = pairs.where("item_id is not null and element is not null").select("item_id", "element").distinct()
    left, again = (cut_lineage(left), True) if most > 1 else (left, False)  # one round reads them once
    spark, out = pairs.sparkSession, []
    for number in range(most):
        gains = left.groupBy("item_id").agg(F.count("*").alias("gain"))
        best = gains.orderBy(F.desc("gain"), "item_id").first()
        if best is None:
            break
        out.append((number, best.item_id, best.gain))
        if number + 1 == most:
            break
        taken = left.where(F.col("item_id") == F.lit(best.item_id)).select("element")
        before, left = left, cut_lineage(left.join(taken, "element", "left_anti").select("item_id", "element"))
        release(before)
    if again:
        release(left)
    return spark.createDataFrame(out, f"round int, item_id {pairs.schema['item_id'].dataType.simpleString()}, gain long")
