"""Helpers that several operators share: tables, lineage, word hashing on Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from docloom.lineage import cut_lineage, release  # noqa: F401

#: Bytes of text that one vectorised step holds at a time; a longer text is one step of its own.
STEP_BYTES = 4 << 20

Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Empty what operators remember in a worker process between tasks of theirs.
forgets: list[Callable[[], None]] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back(forget: bool = False) -> None:
    """Memory that this process has freed goes back to the system; with forget, after what operators remember in it."""
    if forget:
        for clear in forgets:
            clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Arrow, forget: bool = True) -> Arrow:
    """run for mapInArrow, in a worker that holds on to no more memory than run needs.

    Workers outlive their tasks and stages, and allocators keep what was freed: it is given back before and after a task and
    after each batch. With forget, what other operators remember in the worker goes first.
    """

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(forget)
        try:
            for batch in run(batches):
                yield batch
                del batch
                give_back()
        finally:
            give_back()

    return leaner


def map_batches(rows: DataFrame, run: Arrow) -> DataFrame:
    """mapInArrow over and into the same columns, whatever their names: they are numbered on the way."""
    names, plain = rows.columns, [f"c{k}" for k in range(len(rows.columns))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, plain)

    schema = StructType([StructField(p, f.dataType, True) for p, f in zip(plain, rows.schema.fields, strict=True)])
    return rows.toDF(*plain).mapInArrow(lean(named), schema).toDF(*names)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, as in SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings with nulls as empty texts."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("")


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text each, of one row at least."""
    if not len(column):
        return
    size = np.cumsum(np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), np.int64))
    at = 0
    while at < len(column):
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield at, to
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (with the end of the last)."""
    column = texts_of(column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word [^\\x20\\x09-\\x0D]+, and the index of each text's first word (with the end of the last)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin = ~space
    begin[1:] &= space[:-1] | edge[1:-1]
    end = ~space
    end[:-1] &= space[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, at)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[raw]


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes and length, eight bytes a step."""
    out = mix((ends - begins).astype(_U) + _U(0x9E3779B97F4A7C15))
    if not len(begins):
        return out
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", data, 0, (1,))
    left, todo, at = ends - begins, np.arange(len(begins)), begins
    while len(todo):
        short = np.minimum(left, 8)
        mask = np.where(short == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (_U(8) * (short.astype(_U) % _U(8)))) - _U(1))
        out[todo] = mix(out[todo] ^ ((eight[at] & mask) * _U(0xD6E8FEB86659FD93)))
        more = left > 8
        left, todo, at = left[more] - 8, todo[more], at[more] + 8
    return out
