"""Embedding near-duplicates: PCA-ordered tiled comparison inside labels.

Vectors are normalised in double precision and turned onto the principal axes, whose basis comes from the
covariance of all vectors (a sum of small matrices). Cells of the first axis that are as wide as
two linked vectors can differ part each label; only a cell and its neighbours are compared, in tiles of
bounded size, block by block. A block sums products over LEAD leading axes at a time; what the rest can still add is at most
the product of the suffix norms, so pairs that cannot reach the threshold are left, and a block ends when
none is left. Pairs that remain are decided on the whole vectors in their own axes.

Equal vectors of a label are one node that counts as often as it occurs. A tile returns one row for each of its
nodes, the number of links and the smallest node that it is connected with, never its pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
as do rows of a null label or a null vec_id and vectors of different dimensions; labels are compared as text; n_links counts other rows; each
input row gives one output row, where kept is false for a null vec_id; rows that repeat a vec_id are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, release
from docloom.llm.components import components

THRESHOLD = 0.98
#: Vectors on a side of a tile, and on a side of the blocks that it is compared in.
TILE, BLOCK = 4096, 1024
#: Leading axes that are summed at a time.
LEAD = 8
#: Dimensions that get a basis of their own, the most frequent first; others keep their axes.
BASES = 8
#: Vectors of more dimensions are not turned, their axes are ordered by variance: a basis is this many numbers squared, at most, on the driver.
TURNED = 512
_MARGIN = 1e-9


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """Stored vectors of d dimensions as doubles; those stored in four bytes a component are exact."""
    raw = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    out = np.empty((len(raw), d))
    short = np.array([len(v) == 4 * d for v in raw], bool)
    for own, kind in ((short, "<f4"), (~short, "<f8")):
        if own.any():
            out[own] = np.frombuffer(b"".join(v for v, k in zip(raw, own, strict=True) if k), kind).reshape(-1, d)
    return out


def _moments(turned: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per partition and dimension: the number of vectors and the sums of their outer products, or of their squares beyond `turned`."""
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            of = batch.column("d").to_numpy()
            for d in np.unique(of).tolist():
                x = unit(_vectors(batch.column("v").filter(pa.array(of == d)), d))
                n, m = sums.get(d, (0, 0.0))
                sums[d] = n + len(x), m + (x.T @ x if d <= turned else (x * x).sum(0))
        for d, (n, m) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["d", "n", "m"])

    return moments


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, of floats where those hold the values and else of doubles; null where a vector may link with nothing."""
    for batch in batches:
        column = batch.column("embedding")
        values = column.flatten()
        x = values.to_numpy(zero_copy_only=False).astype("<f8")
        x = np.where(np.asarray(values.is_valid()), x, np.nan) if values.null_count else x
        d = pa.compute.list_value_length(column).fill_null(0).to_numpy().astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(d)])
        some = np.flatnonzero(d)
        at = begin[some]
        with np.errstate(over="ignore"):
            floats = x.astype("<f4")
        good, short = np.zeros(len(d), bool), np.zeros(len(d), bool)
        if len(some):
            good[some] = np.logical_and.reduceat(np.isfinite(x), at) & np.logical_or.reduceat(x != 0, at)
            short[some] = np.logical_and.reduceat(floats == x, at)
        raw, half = x.tobytes(), floats.tobytes()
        out = [(half[4 * b : 4 * e] if f else raw[8 * b : 8 * e]) if g else None for b, e, g, f in zip(begin[:-1].tolist(), begin[1:].tolist(), good.tolist(), short.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(d.astype(np.int32)), pa.array(out, pa.binary())], ["vec_id", "label", "d", "v"])


def _turn(x: np.ndarray, bases: dict[int, np.ndarray]) -> np.ndarray:
    basis = bases.get(x.shape[1])
    return x if basis is None else x @ basis if basis.ndim == 2 else x[:, basis]


def _cells(bases: dict[int, np.ndarray], width: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, cell = batch.column("d").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(of).tolist():
                basis = bases.get(d)
                x = unit(_vectors(batch.column("v").filter(pa.array(of == d)), d))
                first = x[:, 0] if basis is None else x @ basis[:, 0] if basis.ndim == 2 else x[:, basis[0]]
                cell[of == d] = np.floor(first / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return cells


def reachable(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b that may reach the threshold, by leading axes and suffix norms."""
    rest = lambda x: np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]))
    ra, rb = rest(a), rest(b)
    d, done = a.shape[1], min(LEAD, a.shape[1])
    part = a[:, :done] @ b[:, :done].T
    bound = lambda k: (ra[:, k], rb[:, k]) if k < d else (np.zeros(len(a)), np.zeros(len(b)))
    sa, sb = bound(done)
    i, j = np.nonzero(part + np.outer(sa, sb) >= threshold - _MARGIN)
    part = part[i, j]
    while done < d and len(i):
        to = min(d, done + LEAD)
        for s in range(0, len(i), 1 << 18):
            t = slice(s, s + (1 << 18))
            part[t] += (a[i[t], done:to] * b[j[t], done:to]).sum(1)
        done = to
        sa, sb = bound(done)
        keep = part + sa[i] * sb[j] >= threshold - _MARGIN
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def _tile(bases: dict[int, np.ndarray], threshold: float, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable").reset_index(drop=True)
        x = unit(_vectors(frame["v"], int(frame["d"].iloc[0])))
        node, times = frame["node"].to_numpy(), frame["times"].to_numpy()
        turned = _turn(x, bases)
        first = frame["side"].to_numpy() == 0
        inner = bool(frame["inner"].iloc[0])
        a = np.arange(len(frame)) if inner else np.flatnonzero(first)
        b = a if inner else np.flatnonzero(~first)
        links, root = np.zeros(len(frame), np.int64), np.arange(len(frame))
        for s in range(0, len(a), block):
            for t in range(s if inner else 0, len(b), block):
                own, other = a[s : s + block], b[t : t + block]
                i, j = reachable(turned[own], turned[other], threshold)
                i, j = own[i], other[j]
                if inner:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 1 << 16):
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    linked = (x[p] * x[q]).sum(1) >= threshold
                    p, q = p[linked], q[linked]
                    np.add.at(links, p, times[q])
                    np.add.at(links, q, times[p])
                    while (root[p] != root[q]).any():  # hook roots to the smaller, then shorten the paths
                        low = np.minimum(root[p], root[q])
                        np.minimum.at(root, root[p], low)
                        np.minimum.at(root, root[q], low)
                        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        keep = links > 0
        return pd.DataFrame({"node": node[keep], "links": links[keep], "root": node[root[keep]]})

    return tile


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept)."""
    rows = cut_lineage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
                       .mapInArrow(_valid, "vec_id long, label string, d int, v binary"))
    fit = rows.where("label is not null and v is not null and vec_id is not null")
    sums = cut_lineage(fit.select("d", "v").mapInArrow(_moments(TURNED), "d long, n long, m array<double>"))
    common = [r.d for r in sums.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(BASES).collect()]
    bases = {}
    for d in common:  # TURNED squared numbers at most
        whole = sums.where(F.col("d") == d).select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).toPandas().sort_values("k")["x"].to_numpy()
        bases[d] = np.linalg.eigh(whole.reshape(d, d))[1][:, ::-1] if d <= TURNED else np.argsort(-whole, kind="stable")
    release(sums)

    nodes = fit.groupBy("label", "d", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    # linked unit vectors are apart by at most this on any axis
    width = (2 * (1 - threshold)) ** 0.5 * (1 + 1e-9) + 1e-12
    celled = cut_lineage(nodes.mapInArrow(_cells(bases, width), "label string, d int, v binary, node long, times long, cell int"))
    counts = celled.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    near = counts.withColumnsRenamed({"cell": "cell2", "blocks": "blocks2"})
    # for each cell, the blocks of itself and of its two neighbours, named from the lower cell
    around = counts.join(near, ["label", "d"]).where("abs(cell - cell2) <= 1").groupBy("label", "d", "cell").agg(
        F.first("blocks").alias("blocks"), F.collect_list(F.struct("cell2", "blocks2")).alias("around"))
    placed = celled.join(around, ["label", "d", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = placed.select("*", F.explode("around").alias("o")).select("*", F.explode(F.sequence(F.lit(0), F.col("o.blocks2") - 1)).alias("block2"))
    own = F.struct(F.col("cell").alias("c"), F.col("block").alias("b"))
    other = F.struct(F.col("o.cell2").alias("c"), F.col("block2").alias("b"))
    named = lambda x: F.concat_ws("/", x["c"], x["b"])
    tiles = met.select("label", "d", named(F.least(own, other)).alias("t1"), named(F.greatest(own, other)).alias("t2"), F.when(own <= other, 0).otherwise(1).alias("side"), (own == other).alias("inner"), "v", "node", "times")
    found = cut_lineage(tiles.groupBy("label", "d", "t1", "t2").applyInPandas(_tile(bases, threshold, BLOCK), "node long, links long, root long"))
    release(celled)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        nodes.join(links, "node", "left").join(joined, "node", "left")
        .select("label", "d", "v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    )
    out = rows.withColumn("able", F.col("vec_id").isNotNull()).join(named.withColumn("able", F.lit(True)), ["label", "d", "v", "able"], "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
