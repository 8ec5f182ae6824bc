"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

The documents of each source are shuffled by a hash and queued REPEATS times over. The virtual finish time of a copy of a
document is the number of its source's words up to and with it, divided by the source's weight. All copies are range-sorted
by finish time; the words of the range partitions, summed up in order, show in which of them the budget ends, which is range-sorted
once more, and a running total inside one partition of that gives the copy at which the queue is truncated. A document is taken as often as its
copies come up to there. So every source gets words by weight until it has no more, and those that run out leave their share to the others.

A source's target is min(REPEATS * words, level * weight), where the targets add up to the budget; the level rises until no
further source is above its cap. Where a large copy ends beyond the truncation, its source is short of its target and others are above theirs. So
what was served is settled: a source gives back the copies that finish above its target; then, HALVINGS times at most, it takes in its
queue's order what is left of documents of at most half its gap, as far as the gap goes, which halves the gap each time; then, FILLS times,
the one document that brings it nearest to its target, if one does.

Cumulative words come from two levels of sums: SLICES slices of a source by hash, then the documents inside a slice; joins are
by source and slice. So a source with a third of all rows is spread over as many tasks.

Defined results: null text has size 0; documents of size 0 are taken 0 times; a null source is one source,
the last; repeated rows count each, ties in the shuffle go by doc_id and size; an empty table gives an
empty result; other columns are kept, helper columns have names that start with "_mix_".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3
SLICES = 1024
#: Rounds in which a source takes one more document; without any, nothing is settled after the truncation.
FILLS = 3
#: Rounds in which a source takes what half its gap holds, at most; they end when all gaps are below NEAR of their targets.
HALVINGS = 12
NEAR = 0.001
_P = "_mix_"
_SOURCE, _SLICE, _BEFORE, _COPIES, _WORDS, _WEIGHT, _TARGET, _PART = (f"{_P}{k}" for k in ("source", "slice", "before", "copies", "words", "weight", "target", "part"))


def _parts(rows: DataFrame, *order: str) -> DataFrame:
    """The rows range-sorted over partitions, written with the number of each row's partition."""
    return cut_lineage(rows.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()))


def _sums(parts: DataFrame, value: str) -> DataFrame:
    """For each range partition, one row: the total of those before it, and the total with it."""
    sums = parts.groupBy(_PART).agg(F.sum(value).alias(f"{_P}sum"))
    upto = F.sum(f"{_P}sum").over(Window.orderBy(_PART))
    return sums.select(_PART, (upto - F.col(f"{_P}sum")).alias(f"{_P}lo"), upto.alias(f"{_P}hi"))


def _weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights in turn, in the order of the sources."""
    parts = _parts(sources.withColumn(f"{_P}one", F.lit(1)), _SOURCE)
    place = F.col(f"{_P}lo") + F.row_number().over(Window.partitionBy(_PART).orderBy(_SOURCE)) - 1
    # _sums has one row a partition
    placed = parts.join(F.broadcast(_sums(parts, f"{_P}one")), _PART)
    return placed.select(_SOURCE, _WORDS, F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int")).alias(_WEIGHT))


def _targets(sources: DataFrame, share: float) -> DataFrame:
    """Adds the target; one aggregate a rise of the level."""
    cap = F.col(_WORDS).cast("double") * REPEATS
    first = sources.agg(F.sum(_WORDS).alias("words"), F.sum(_WEIGHT).alias("weight")).first()
    total = (first.words or 0) * share
    level, before = total / first.weight if first.weight else 0.0, None
    while level != before:
        full = cap <= level * F.col(_WEIGHT)
        now = sources.agg(F.sum(F.when(full, cap).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col(_WEIGHT))).alias("free")).first()
        before, level = level, (total - now.full) / now.free if now.free else level
    return sources.withColumn(_TARGET, F.least(cap, F.lit(level) * F.col(_WEIGHT)))


def _finish(copy: Column) -> Column:
    """The virtual finish time of a copy, counted from 0."""
    return (copy * F.col(_WORDS) + F.col(_BEFORE) + F.col("size")) / F.col(_WEIGHT)


def _last(queue: DataFrame, budget: float, again: bool = True) -> tuple[float, str] | None:
    """Finish time and source of the last copy that the budget holds."""
    order = (f"{_P}finish", _SOURCE)
    parts = _parts(queue, *order)
    sums = _sums(parts, "size")
    served = sums.where(F.col(f"{_P}lo") <= budget).agg(F.max_by(_PART, f"{_P}lo").alias("part"), F.max(f"{_P}lo").alias("lo")).first()
    last = None
    if served.part is not None:
        # inside the one range partition in which the budget ends
        inside = parts.where(F.col(_PART) == served.part)
        if again:
            last = _last(inside.drop(_PART), budget - served.lo, again=False)
        else:
            upto = inside.withColumn(f"{_P}upto", F.sum("size").over(Window.orderBy(*order)) + F.lit(served.lo)).where(F.col(f"{_P}upto") <= budget)
            last = upto.agg(F.max(F.struct(*order)).alias("x")).first().x
        if last is None:  # the budget ends with the partition before
            last = parts.where(F.col(_PART) < served.part).agg(F.max(F.struct(*order)).alias("x")).first().x
    release(parts)
    return last and (last[0], last[1])


def _truncation(placed: DataFrame, budget: float) -> tuple[float, str] | None:
    """Finish time and source of the last copy that the budget holds, by a global range sort of all copies."""
    copies = placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias(f"{_P}copy"))
    return _last(copies.select(_finish(F.col(f"{_P}copy")).alias(f"{_P}finish"), _SOURCE, "size"), budget)


def _gaps(placed: DataFrame, slices: DataFrame) -> DataFrame:
    """What each source lacks to its target, a row for each of its slices."""
    taken = placed.groupBy(_SOURCE).agg(F.sum(F.col(_COPIES) * F.col("size")).alias(f"{_P}taken"))
    return slices.join(taken, _SOURCE).select(_SOURCE, _SLICE, _TARGET, (F.col(_TARGET) - F.col(f"{_P}taken")).alias(f"{_P}gap"))


def _halved(placed: DataFrame, gaps: DataFrame) -> DataFrame:
    """Each source takes once more, in its queue's order, documents of at most half its gap, as far as the gap goes."""
    half = F.when((F.col(_COPIES) < REPEATS) & (F.col("size") * 2 <= F.col(f"{_P}gap")), F.col("size")).otherwise(0)
    of_slice = placed.join(gaps, [_SOURCE, _SLICE]).groupBy(_SOURCE, _SLICE, f"{_P}gap").agg(F.sum(half).alias(f"{_P}halves"))
    along = Window.partitionBy(_SOURCE).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    of_slice = of_slice.withColumn(f"{_P}lo", F.coalesce(F.sum(f"{_P}halves").over(along), F.lit(0))).drop(f"{_P}halves")
    inside = Window.partitionBy(_SOURCE, _SLICE).orderBy(_BEFORE, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(of_slice, [_SOURCE, _SLICE]).withColumn(f"{_P}upto", F.col(f"{_P}lo") + F.sum(half).over(inside))
    more = F.when((half > 0) & (F.col(f"{_P}upto") <= F.col(f"{_P}gap")), 1).otherwise(0)
    return cut_lineage(rows.withColumn(_COPIES, F.col(_COPIES) + more).select(*placed.columns))


def _fill(placed: DataFrame, slices: DataFrame) -> DataFrame:
    """One document for each source, the one that brings it nearest to its target: (source, slice, before, 1)."""
    gap = F.col(f"{_P}gap")
    fit = F.abs(F.col("size") - gap)
    return (
        placed.where((F.col(_COPIES) < REPEATS) & (F.col("size") > 0)).join(_gaps(placed, slices), [_SOURCE, _SLICE]).where(fit < F.abs(gap)).groupBy(_SOURCE)
        .agg(F.min(F.struct(fit.alias("fit"), F.col(_BEFORE).alias("at"), F.col(_SLICE).alias("slice"))).alias("x"))
        .select(_SOURCE, F.col("x.slice").alias(_SLICE), F.col("x.at").alias(_BEFORE), F.lit(1).alias(f"{_P}more"))
    )


def _with_fills(placed: DataFrame, fills: list[DataFrame]) -> DataFrame:
    """placed, with the documents that fills took once more."""
    if not fills:
        return placed
    taken = fills[0]
    for f in fills[1:]:
        taken = taken.union(f)
    taken = taken.groupBy(_SOURCE, _SLICE, _BEFORE).agg(F.sum(f"{_P}more").alias(f"{_P}more"))
    # documents of no words share the place of the one that follows them
    more = F.when(F.col("size") > 0, F.coalesce(f"{_P}more", F.lit(0))).otherwise(0)
    return placed.join(taken, [_SOURCE, _SLICE, _BEFORE], "left").withColumn(_COPIES, F.col(_COPIES) + more).select(*placed.columns)


def _settled(placed: DataFrame, slices: DataFrame) -> DataFrame:
    """What the truncation served, brought near each source's target."""
    own = sum((((F.lit(c) * F.col(_WORDS) + F.col(_BEFORE) + F.col("size")) <= F.col(_TARGET)).cast("long") for c in range(1, REPEATS)), (F.col(_BEFORE) + F.col("size") <= F.col(_TARGET)).cast("long"))
    held = placed = cut_lineage(placed.withColumn(_COPIES, F.least(F.col(_COPIES), own)))
    before = None
    for _ in range(HALVINGS):
        gaps = cut_lineage(_gaps(placed, slices))
        seen = gaps.agg(F.sum(f"{_P}gap").alias("all"), F.max(F.when(F.col(_TARGET) > 0, F.col(f"{_P}gap") / F.col(_TARGET))).alias("most")).first()
        done = seen.most is None or seen.most <= NEAR or seen["all"] == before
        before = seen["all"]
        if not done:
            placed = _halved(placed, gaps)
            release(held)
            held = placed
        release(gaps)
        if done:
            break
    fills: list[DataFrame] = []
    for _ in range(FILLS):
        fills.append(cut_lineage(_fill(_with_fills(placed, fills), slices)))
    return _with_fills(placed, fills)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, seed: int = 17, more: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source) -> a row for each: doc_id, size, source_size, target, taken, times, finish (of the first copy) and lap, with the columns named in more."""
    size, hash_ = F.col("size"), f"{_P}hash"
    light = cut_lineage(
        docs.select(
            "doc_id", *more, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            # "=" stands before ">", so this orders as the source does, null last
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(">")).alias(_SOURCE),
            F.xxhash64("doc_id", F.lit(seed)).alias(hash_),
        ).withColumn(_SLICE, F.shiftrightunsigned(hash_, 64 - SLICES.bit_length() + 1).cast("int"))
    )
    sums = cut_lineage(light.groupBy(_SOURCE, _SLICE).agg(F.sum(size).alias(f"{_P}slice_words")))
    sources = cut_lineage(_weighted(sums.groupBy(_SOURCE).agg(F.sum(f"{_P}slice_words").alias(_WORDS)), weights))
    along = Window.partitionBy(_SOURCE).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    slices = cut_lineage(sums.join(_targets(sources, share), _SOURCE).withColumn(f"{_P}base", F.coalesce(F.sum(f"{_P}slice_words").over(along), F.lit(0))).drop(f"{_P}slice_words"))
    release(sums)
    inside = Window.partitionBy(_SOURCE, _SLICE).orderBy(F.shiftleft(hash_, SLICES.bit_length() - 1), "doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn(f"{_P}cum", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(slices, [_SOURCE, _SLICE])
    placed = cut_lineage(placed.withColumn(_BEFORE, F.col(f"{_P}base") + F.col(f"{_P}cum")).drop(hash_, f"{_P}cum", f"{_P}base"))
    release(light)

    budget = (sources.agg(F.sum(_WORDS)).first()[0] or 0) * share
    last = _truncation(placed, budget)
    if last is None:
        served = F.lit(0)
    else:
        up_to = lambda c: (_finish(F.lit(c)) < last[0]) | ((_finish(F.lit(c)) == last[0]) & (F.col(_SOURCE) <= last[1]))
        served = F.when(size > 0, sum((up_to(c).cast("int") for c in range(1, REPEATS)), up_to(0).cast("int"))).otherwise(0)
    placed = placed.withColumn(_COPIES, served.cast("long"))
    if FILLS:
        placed = _settled(placed, slices)
    times = F.col(_COPIES)
    return placed.select(
        "doc_id", *more, "size", F.col(_WORDS).alias("source_size"), F.col(_TARGET).alias("target"), (times * size).alias("taken"), times.alias("times"),
        F.when(size > 0, _finish(F.lit(0))).alias("finish"), (F.col(_WORDS) / F.col(_WEIGHT)).alias("lap"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, range-sorted by the virtual finish times of its copies.

    Of rows that are equal in all columns one stands for all, as often as they are taken together.
    """
    names = docs.columns
    keyed = docs.withColumn(f"{_P}row", F.xxhash64(*(F.col(f"`{c}`") for c in names)))
    plan = cut_lineage(
        mix(keyed, weights, more=(f"{_P}row",)).groupBy("doc_id", f"{_P}row")
        .agg(F.sum("times").alias(f"{_P}times"), F.count("*").alias(f"{_P}rows"), F.min("finish").alias(f"{_P}finish"), F.min("lap").alias(f"{_P}lap")).where(f"{_P}times > 0")
        .select(F.col("doc_id").alias(f"{_P}id"), F.col(f"{_P}row").alias(f"{_P}r"), f"{_P}times", f"{_P}rows", f"{_P}finish", f"{_P}lap")
    )
    met = lambda own: keyed.join(own, F.col("doc_id").eqNullSafe(F.col(f"{_P}id")) & (F.col(f"{_P}row") == F.col(f"{_P}r")))
    single = met(plan.where(f"{_P}rows = 1"))
    repeated = met(plan.where(f"{_P}rows > 1")).dropDuplicates([f"{_P}id", f"{_P}r"])
    copies = single.union(repeated).withColumn(f"{_P}copy", F.explode(F.sequence(F.lit(0), (F.col(f"{_P}times") - 1).cast("int"))))
    placed = copies.withColumn(f"{_P}at", F.col(f"{_P}finish") + F.col(f"{_P}copy") * F.col(f"{_P}lap") / F.col(f"{_P}rows"))
    return placed.repartitionByRange(f"{_P}at", F.xxhash64("doc_id")).sortWithinPartitions(f"{_P}at").select(*(F.col(f"`{c}`") for c in names))
