"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Every entry c is taken as the whole number floor(64 c). A partition keeps, for the vectors read so far, their number, the exact sums
of their entries, and all singular values and right singular vectors of the centred vectors: STEP vectors at a time are
decomposed and merged into what there is. merge() stacks the two decompositions and a row that corrects for the
distance of their means, and decomposes the stack again; as every dimension is kept, nothing is lost. The states of the partitions, of
at most dimension x (dimension + 2) numbers each, are merged FAN at a time in tasks until one is left, which the driver takes
and sends out with the tasks that project. Eigenvalues of the covariance are squares of singular values over the number of vectors,
so that small ones keep their digits. Where the largest entry of a component is negative, the component is turned.

identity_error is measured: the covariance of the whitened vectors is gathered like the states, centred in each partition and merged
with the correction for means, and compared with the identity.

Defined results: vectors that are null or hold null or non-finite entries, or entries of 2^40 and more, get no rows; nor do those of another
dimension than most vectors that remain (the larger one of equally frequent ones) and those of no dimension. Repeated vectors and ids count
each; a null vec_id stays null. deviation is null where it does not fit a long. In a component without variance (all vectors in a
subspace, or alike) whitened is null, and identity_error does not count it; where no component has variance, explained and identity_error
are null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, release

COMPONENTS = 32
SCALE = 64
#: Added to the whole numbers of the contract; no deviation, covariance or component depends on it.
SHIFT = 1_000_000
#: Vectors that are decomposed together.
STEP = 4096
#: Entries stay below it: times SCALE and STEP they fit 64 bits.
LIMIT = 1 << 40
#: States that one task merges.
FAN = 16
#: Singular values below this share of the largest, times the dimension, are rounding errors.
EPS = float(np.finfo(float).eps)

State = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # vectors, exact sums (Python's whole numbers), singular values, right singular vectors


def decompose(x: np.ndarray) -> State:
    """x: rows of whole numbers."""
    sums = x.sum(0)
    # n x - S is exact in whole numbers, so that centring rounds once
    n = len(x)
    _, s, v = np.linalg.svd((x * n - sums) / n, full_matrices=False)
    return n, sums.astype(object), s, v


def merge(a: State, b: State) -> State:
    n = a[0] + b[0]
    apart = (a[1] / a[0] - b[1] / b[0]).astype(float) * np.sqrt(a[0] * (b[0] / n))
    _, s, v = np.linalg.svd(np.concatenate([a[2][:, None] * a[3], b[2][:, None] * b[3], apart[None]]), full_matrices=False)
    d = len(apart)
    return n, a[1] + b[1], s[:d], v[:d]


def _pack(state: tuple[int, np.ndarray, ...]) -> list[bytes]:
    return [" ".join(map(str, x)).encode() if x.dtype == object else x.tobytes() for x in state[1:]]


def _state(n: int, dims: int, sums: bytes, values: bytes, vectors: bytes) -> State:
    return n, np.array([int(x) for x in sums.split()], object), np.frombuffer(values), np.frombuffer(vectors).reshape(-1, dims)


def _moments(n: int, dims: int, mean: bytes, scatter: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    return n, np.frombuffer(mean), np.frombuffer(scatter).reshape(dims, dims)


def _merge_moments(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * (b[0] / n))


#: How states are read back and merged, and their columns.
_KINDS = {"svd": (_state, merge, ("sums", "values", "vectors")), "moments": (_moments, _merge_moments, ("mean", "scatter"))}


def _ddl(kind: str) -> str:
    return "part long, n long, dims int, " + ", ".join(f"{c} binary" for c in _KINDS[kind][2])


def _gathered(states: DataFrame, kind: str, dims: int) -> tuple | None:
    """All states merged, FAN at a time, in rounds; the last merge is one row of fixed size."""
    read, join, columns = _KINDS[kind]

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = None
        for row in frame.itertuples():
            own = read(row.n, dims, *(getattr(row, c) for c in columns))
            total = own if total is None else join(total, own)
        return pd.DataFrame([[frame["part"].iloc[0] // FAN, total[0], dims, *_pack(total)]], columns=["part", "n", "dims", *columns])

    now = cut_lineage(states)
    while (most := now.agg(F.max("part")).first()[0]) is not None and most > 0:
        before, now = now, cut_lineage(now.groupBy((F.col("part") / FAN).cast("long").alias("group")).applyInPandas(merged, _ddl(kind)))
        release(before)
    last = now.first()
    release(now)
    return last and read(last.n, dims, *(bytes(last[c]) for c in columns))


def _numbers(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of whole numbers; the vectors are checked."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dims)


def _stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _decomposer(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _stepped(batches):
            own = decompose(_numbers(batch.column("vector"), dims))
            total = own if total is None else merge(total, own)
        if total is not None:
            yield _row(total, dims, "svd")

    return run


def _row(state: tuple, dims: int, kind: str) -> pa.RecordBatch:
    own = [[TaskContext.get().partitionId()], [state[0]], pa.array([dims], pa.int32()), *([x] for x in _pack(state))]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in own], ["part", "n", "dims", *_KINDS[kind][2]])


class Whitening:
    """What projects vectors: their number, sums, components (a row each) and eigenvalues."""

    def __init__(self, state: State, most: int):
        self.n, self.sums, s, v = state
        dims = len(self.sums)
        values, components = np.zeros(dims), np.zeros((dims, dims))
        values[: len(s)], components[: len(s)] = s * s / self.n, v
        self.trace = float(values.sum())
        good = s > EPS * max(self.n, dims) * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
        self.varied = np.zeros(dims, bool)
        self.varied[: len(s)] = good
        turned = np.sign(np.take_along_axis(components, np.abs(components).argmax(1)[:, None], 1))
        self.most = min(most, dims)
        self.values, self.varied = values[: self.most], self.varied[: self.most]
        self.components = (components * np.where(turned == 0, 1, turned))[: self.most]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n x - S; Python's whole numbers where 64 bits would not do."""
        if self.n * int(np.abs(x).max(initial=1)) + np.abs(self.sums).max() < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        centred = (self.exact(x) / self.n).astype(float)
        root = np.sqrt(np.where(self.varied, self.values, np.nan))
        return centred @ self.components.T / root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        exact = self.exact(x)
        if exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * len(self.sums) < 1 << 63:
            return (exact * exact).sum(1).tolist()
        sums = (exact.astype(object) ** 2).sum(1).tolist()
        return [int(x) if x < 1 << 63 else None for x in sums]


def fit(vectors: DataFrame, dims: int, most: int = COMPONENTS) -> Whitening | None:
    state = _gathered(vectors.mapInArrow(_decomposer(dims), _ddl("svd")), "svd", dims)
    return state and Whitening(state, most)


def _second_moments(model: Whitening, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _stepped(batches):
            w = np.nan_to_num(model.project(_numbers(batch.column("vector"), dims)))
            mean = w.mean(0)
            own = len(w), mean, (w - mean).T @ (w - mean)
            total = own if total is None else _merge_moments(total, own)
        if total is not None:
            yield _row(total, model.most, "moments")

    return run


def identity_error(vectors: DataFrame, model: Whitening, dims: int) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the components with variance."""
    n, _, scatter = _gathered(vectors.mapInArrow(_second_moments(model, dims), _ddl("moments")), "moments", model.most)
    error = np.abs(scatter / n - np.eye(model.most))[np.ix_(model.varied, model.varied)]
    return float(error.max()) if error.size else None


def _whitener(model: Whitening, dims: int, error: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.most
        for batch in _stepped(batches):
            x, rows = _numbers(batch.column("vector"), dims), batch.num_rows
            each = lambda values, kind: pa.array(np.tile(values, rows), kind)
            again = np.repeat(np.arange(rows), k)
            explained = np.array(model.values / model.trace if model.trace else np.full(k, np.nan))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(again)), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(rows * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(again)), pa.array(model.project(x).ravel(), from_pandas=True),
                    pa.array(np.tile(explained, rows), from_pandas=True), pa.array([error] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error."""
    entry = F.col("embedding").cast("array<double>")
    whole = F.forall(entry, lambda c: F.coalesce(F.abs(c) < float(LIMIT), F.lit(False)))  # not NaN, for that is above all numbers
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entry.alias("vector")).where(whole & (F.size("vector") > 0))
    dims = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).agg(F.max_by("dims", F.struct("n", "dims"))).first()[0]
    if dims is None:
        return embeddings.sparkSession.createDataFrame([], _OUT)
    vectors = vectors.where(F.size("vector") == dims)
    model = fit(vectors, dims, most)
    return vectors.mapInArrow(_whitener(model, dims, identity_error(vectors, model, dims)), _OUT)
