"""The trie of conversation prefixes, with subtree totals by heavy-path decomposition.

Conversations are first rebuilt: the first turns of conversation c are those of conversation c - c % SHARED, as many as the
checksum of c says, then c's own follow. A node is a distinct sequence of the first turns of rebuilt conversations. A node's key is
its depth and 128 bits of exclusive-or over hashes of (role, text, place), so the key of the parent is the node's without its last turn.

A node's largest child is the one with most members (ties: the smallest member). The largest children of one another form a heavy path; every other child
begins a path of its own, one level further from the root. A member of a light child is at most every second member of its parent,
so there are at most log2(conversations) levels. Totals are summed from the end of every path to its top; that of a path's top is added to
the node that the path hangs on. All paths of a level are done in one round, the deepest level first.

Nothing is gathered by conversation, path or node: before() sums along rows that are range-sorted over partitions, first inside each
partition, then with what the partitions before it hold of the two keys at its edges. So one conversation with a third of all turns,
or a chain as long, is spread over tasks. The ids of the members that end at one node are sorted and written in runs by many tasks; only
the digest itself, which must read them in order, walks the runs of a node in one task, in bounded memory.

Defined results: null roles and texts are empty; turns of a conversation are ordered by turn, null first, then by role and text; repeated rows are turns
of their own; rows of a null conv_id belong to no conversation and are left out; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, release

WORD = r"[^\x20\x09-\x0D]+"
SHARED = 20
#: Remainders of the checksum: 0 to MOST_SHARED turns are shared.
MOST_SHARED = 3
#: Ids in one row of what digests read.
RUN = 512
_PART = "_part"

#: How two values of one kind are put together.
_KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))),
    "max": (F.max, F.greatest),
}


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows range-sorted over partitions, written with the number of each row's partition."""
    return cut_lineage(rows.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()))


def before(parts: DataFrame, key: list[str], order: list[Column | str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """ranged() rows, sorted by key and order, with what the earlier rows of the same key add up to; values: name -> (sum, xor or max, value)."""
    edge = F.struct(*key)
    edges = parts.groupBy(_PART).agg(F.min(edge).alias("a"), F.max(edge).alias("b")).select(_PART, F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).select(_PART, "k.*")
    own = {name: _KINDS[kind][0](value) for name, (kind, value) in values.items()}
    # two rows a range partition at most
    totals = parts.join(F.broadcast(edges), [_PART, *key]).groupBy(_PART, *key).agg(*(agg.alias(f"_t_{name}") for name, agg in own.items()))
    along = Window.partitionBy(*key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(_PART, *key, *(_KINDS[kind][0](F.col(f"_t_{name}")).over(along).alias(f"_c_{name}") for name, (kind, _) in values.items()))
    inside = Window.partitionBy(_PART, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.select("*", *(agg.over(inside).alias(f"_i_{name}") for name, agg in own.items())).join(F.broadcast(carried), [_PART, *key], "left")
    return found.select(*parts.columns, *(_KINDS[kind][1](F.col(f"_c_{name}"), F.col(f"_i_{name}")).alias(name) for name, (kind, _) in values.items()))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, place from 1, a and b: hash of role and text, words)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    whole = whole.withColumns({"at": F.coalesce("turn", F.lit(0)), "known": F.col("turn").isNotNull(), "a": F.xxhash64(F.lit(1), "role", "text"), "b": F.xxhash64(F.lit(2), "role", "text")}).drop("turn")
    light = whole.select("conv_id", "known", "at", "role", "a", "b", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    # turns that only their texts can order: only these texts are shuffled
    same = ["conv_id", "known", "at", "role"]
    tied = cut_lineage(light.groupBy(*same).agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).where("a0 <> a1 or b0 <> b1").select(*same))
    if tied.isEmpty():
        light = light.withColumn("nth", F.lit(0))
    else:
        texts = whole.join(tied, same, "left_semi").select(*same, "text", "a", "b").distinct()
        nth = texts.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("text"))).drop("text")
        light = light.join(nth, [*same, "a", "b"], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))
    order = ["known", "at", "role", "nth", "a", "b"]
    parts = ranged(light, "conv_id", *order)
    release(tied)
    return before(parts, ["conv_id"], order, {"place": ("sum", F.lit(1))}).select("conv_id", (F.col("place") + 1).alias("place"), "a", "b", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """numbered() turns -> (conv_id, depth, a, b, words, last) of the rebuilt conversations, and (conv_id, length) of all of them."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    given = lengths.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.least("n", F.lit(MOST_SHARED)).alias("m"))
    planned = lengths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % SHARED, "h": shared}).join(given, "base", "left").withColumn("g", F.least("h", F.coalesce("m", F.lit(0))))
    planned = cut_lineage(planned.select("conv_id", "base", "h", "g", (F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("place") <= MOST_SHARED)).withColumnRenamed("conv_id", "base")
    first = heads.join(planned.where("g > 0"), "base").where("place <= g").select("conv_id", F.col("place").alias("depth"), "a", "b", "words", "length")
    own = turns.where(F.col("place") > shared).join(planned, "conv_id").select("conv_id", (F.col("place") - F.col("h") + F.col("g")).alias("depth"), "a", "b", "words", "length")
    rows = first.unionByName(own).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return rows, planned


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of the node and of its parent."""
    tag = lambda k: F.xxhash64(F.lit(k), "a", "b", "depth")
    parts = ranged(rows.select("conv_id", "depth", tag(1).alias("t1"), tag(2).alias("t2"), "words", "last"), "conv_id", "depth")
    found = before(parts, ["conv_id"], ["depth"], {"p1": ("xor", F.col("t1")), "p2": ("xor", F.col("t2"))})
    out = cut_lineage(found.select(_PART, "conv_id", "depth", "words", "last", "p1", "p2", F.col("p1").bitwiseXOR(F.col("t1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("k2")))
    release(parts)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, conv_id) -> rows of at most RUN ids of a node, with the first of them."""

    def row(key: tuple[int, int], ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0], ",".join(map(str, ids)))], ["node", "depth", "first", "ids"])

    key, ids = None, []
    for batch in batches:
        out = []
        for *now, conv in zip(*(batch.column(k).to_pylist() for k in ("node", "depth", "conv_id")), strict=True):
            if now != key or len(ids) == RUN:
                if ids:
                    out.append(row(key, ids))
                key, ids = now, []
            ids.append(conv)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield row(key, ids)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, first, ids) -> a row for each node: the digest of all its ids, joined by commas."""
    row = lambda key, digest: (*key, digest.hexdigest())
    key, digest = None, hashlib.sha256()
    for batch in batches:
        out = []
        for *now, ids in zip(*(batch.column(k).to_pylist() for k in ("node", "depth", "ids")), strict=True):
            if now != key:
                if key:
                    out.append(row(key, digest))
                key, digest = now, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["node", "depth", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row(key, digest)], ["node", "depth", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(node, depth, conv_id) -> (node, depth, ends_sha256)."""
    key = ["node", "depth"]
    runs = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_runs, "node long, depth long, first long, ids string")
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digested, "node long, depth long, ends_sha256 string")


def _totals(paths: DataFrame) -> DataFrame:
    """paths: (level, top, top_depth, node, depth, parent, leaves, saved, ...), ranged by top, top_depth and falling depth -> (node, depth, n_leaves, saved_tokens)."""
    path, done, hung = ["top", "top_depth"], [], None
    for level in range(paths.agg(F.max("level")).first()[0], -1, -1):
        rows = paths.where(F.col("level") == level).select(_PART, *path, "node", "depth", "parent", "leaves", "saved")
        if hung is not None:
            rows = rows.join(hung, ["node", "depth"], "left")
            rows = rows.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        met = cut_lineage(rows)  # with what hangs on the path
        below = before(met, path, [F.desc("depth")], {"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))})
        done.append(cut_lineage(below.select("node", "depth", "parent", "top_depth", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"))))
        release(met)
        tops = done[-1].where("depth = top_depth")
        hung = tops.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("node", "depth", "n_leaves", "saved_tokens")


_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, planned = rebuilt(cut_lineage(numbered(conversations)))
    root = planned.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not root.n:
        return conversations.sparkSession.createDataFrame([], _OUT)
    turns = _keyed(rows)
    nodes = cut_lineage(turns.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("node"))).alias("best"))
    children = cut_lineage(children)
    largest = children.select((F.col("depth") + 1).alias("depth"), (-F.col("best.col2")).alias("node"), F.lit(0).alias("light"))
    # both joins have one row a node on either side
    known = nodes.select("depth", "k1", "k2", "node", "n_convs").join(children.drop("best"), ["depth", "k1", "k2"], "left").join(largest, ["depth", "node"], "left")
    known = known.withColumns({"light": F.coalesce("light", F.lit(1)), "n_children": F.coalesce("n_children", F.lit(0))})
    met = cut_lineage(turns.join(known, ["depth", "k1", "k2"]).select(_PART, "conv_id", "depth", "words", "last", "node", "light", "n_convs", "n_children"))
    release(turns, nodes)

    # along a conversation: the node above, the path that a node is on, and its level
    here = F.struct("depth", "node")
    above = before(met, ["conv_id"], ["depth"], {"up": ("max", here), "top": ("max", F.when(F.col("light") == 1, here)), "level": ("sum", F.col("light"))})
    top = F.when(F.col("light") == 1, here).otherwise(F.col("top"))
    member = above.where("conv_id = node").select(
        (F.col("level") + F.col("light")).alias("level"), F.coalesce(top["node"], F.lit(root.conv_id)).alias("top"), F.coalesce(top["depth"], F.lit(0)).alias("top_depth"),
        "node", "depth", F.coalesce("up.node", F.lit(root.conv_id)).alias("parent"), "n_convs", "n_children",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    begun = (children.where("depth = 0").first() or [None, None, None, 0])[3]
    spark = conversations.sparkSession
    trunk = spark.range(1).select(
        F.lit(0).cast("long").alias("level"), F.lit(root.conv_id).cast("long").alias("top"), F.lit(0).cast("long").alias("top_depth"), F.lit(root.conv_id).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent"), F.lit(root.n).cast("long").alias("n_convs"), F.lit(begun).cast("long").alias("n_children"), F.lit(int(begun == 0)).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    )
    paths = ranged(member.unionByName(trunk), "top", "top_depth", F.desc("depth"))
    ends = met.where("last").select("node", "depth", "conv_id").union(planned.where("length = 0").select(F.lit(root.conv_id).cast("long"), F.lit(0).cast("long"), "conv_id"))
    ended = cut_lineage(_ends(ends))
    release(met, children, planned)
    out = paths.select("node", "depth", "parent", "n_convs", "n_children").join(_totals(paths), ["node", "depth"]).join(ended, ["node", "depth"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
