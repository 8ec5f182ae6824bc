"""Packing by length patterns, fitted to the histogram of lengths by non-negative least squares.

A document is its ids and END_ID; one that is longer than a sequence is cut into full pieces and a rest. The histogram of
piece lengths (at most one row a length) is all that leaves the executors. patterns() enumerates every way in which at most
MOST pieces of lengths that occur fill a sequence exactly; fit() finds how often each is to be repeated by non-negative least
squares; the counts are rounded to whole ones that the histogram holds, and what is left of it is packed best-fit, longest first, as
counts too. That gives for each length a list of places, told apart by rank: the first so many pieces of a length go to the
copies of one pattern, the next to those of another. A piece's rank is its place in its partition and the number of equal pieces in
the partitions before. So nothing but the plan, whose size depends on the sequence length alone, is sent to tasks.

fit() is an active-set method. Each round adds patterns that share no length, those of the largest gradient first, solves the least
squares problem of the active ones by conjugate gradients and drops those that get no weight. It ends when no gradient is
above TOLERANCE or after ROUNDS: rounding and the packing of the rest follow in any case.

Defined results: null text is empty; an empty document still has its end id; repeated rows are packed as often as they occur; a null
doc_id stays null; an empty table gives an empty result; other columns are ignored. Which of equally long pieces stands where depends
on how the input is split; the pieces, their ids and the number of sequences do not.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, lean, steps, texts_of
from docloom.llm.packing import TOGETHER, encoder

SIZE = 2048
#: Pieces in a pattern, at most.
MOST = 3
END_ID = 0
ROUNDS = 60
#: Least gradient of a pattern that is added, as a share of the histogram's norm over the root of its number of lengths.
TOLERANCE = 1e-3
#: Patterns that a round looks through for those that share no length.
LOOKED_AT = 20_000
STEPS = 60

#: Runs of one length in a sequence, longest first: ((length, how many), ...).
Runs = tuple[tuple[int, int], ...]


def patterns(lengths: np.ndarray, size: int = SIZE, most: int = MOST) -> np.ndarray:
    """Every multiset of at most `most` of the lengths that adds up to size, falling; shorter ones end with zeros."""
    present = np.zeros(size + 1, bool)
    present[lengths] = True
    found = np.zeros((0, most), np.int64)

    def grow(begun: np.ndarray, rest: np.ndarray, left: int) -> None:
        """begun patterns of falling lengths that still lack `rest`, of which `left` pieces may follow."""
        nonlocal found
        whole = begun[rest == 0]
        found = np.concatenate([found, np.pad(whole, ((0, 0), (0, most - whole.shape[1])))])
        begun, rest = begun[rest > 0], rest[rest > 0]
        last = begun[:, -1] if begun.shape[1] else np.full(len(begun), size)
        if left == 1:
            ends = (rest <= last) & present[rest]
            whole = np.concatenate([begun[ends], rest[ends, None]], 1)
            found = np.concatenate([found, np.pad(whole, ((0, 0), (0, most - whole.shape[1])))])
        elif left and len(begun):
            for at in range(0, len(begun), 4096):
                part, lack, top = begun[at : at + 4096], rest[at : at + 4096], last[at : at + 4096]
                row, k = np.nonzero((lengths <= np.minimum(lack, top)[:, None]) & (lengths * left >= lack[:, None]))
                grow(np.concatenate([part[row], lengths[k][:, None]], 1), lack[row] - lengths[k], left - 1)

    grow(np.zeros((1, 0), np.int64), np.array([size]), most)
    return found


def _covered(some: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """How many pieces of each length the patterns hold, repeated so often."""
    out = np.bincount(some.ravel(), np.repeat(times, some.shape[1]), size + 1)
    out[0] = 0
    return out


def _least_squares(some: np.ndarray, want: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Conjugate gradients on the normal equations, from a first guess."""
    size = len(want) - 1
    x, left = start, want - _covered(some, start, size)
    slope = left[some].sum(1)
    way, square = slope, slope @ slope
    for _ in range(STEPS):
        moved = _covered(some, way, size)
        bend = moved @ moved
        if square == 0 or bend == 0:
            break
        step = square / bend
        x, left = x + step * way, left - step * moved
        slope, before = left[some].sum(1), square
        square = slope @ slope
        if square < 1e-16 * before:
            break
        way = slope + square / before * way
    return x


def fit(all_patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The patterns to use and how often (not yet whole numbers): min |covered - counts| with no negative number."""
    size = len(counts) - 1
    want = counts.astype(float)
    want[0] = 0
    active, times, left = np.zeros(0, np.int64), np.zeros(0), want
    least = TOLERANCE * np.sqrt((want @ want) / len(want))
    for _ in range(rounds):
        slope = left[all_patterns].sum(1)
        slope[active] = 0
        best = np.flatnonzero(slope > least)
        best = best[np.argsort(-slope[best], kind="stable")][:LOOKED_AT]
        used, fresh = set(), []
        for k, row in zip(best.tolist(), all_patterns[best].tolist(), strict=True):
            own = set(row) - {0}
            if not own & used:
                used |= own
                fresh.append(k)
        if not fresh:
            break
        active, times = np.concatenate([active, fresh]).astype(np.int64), np.concatenate([times, np.zeros(len(fresh))])
        while len(active):
            times = _least_squares(all_patterns[active], want, times)
            kept = times > 0
            if kept.all():
                break
            active, times = active[kept], times[kept]
        left = want - _covered(all_patterns[active], times, size)
    return all_patterns[active], times


def best_fit(counts: np.ndarray) -> list[tuple[Runs, int]]:
    """Best-fit, longest first, of so many pieces of each length; sequences that are filled alike are one entry with their number."""
    size = len(counts) - 1
    by_gap: dict[int, list[tuple[Runs, int]]] = {}
    gaps: list[int] = []
    full: list[tuple[Runs, int]] = []

    def put(gap: int, runs: Runs, times: int) -> None:
        if gap == 0:
            full.append((runs, times))
            return
        if gap not in by_gap:
            insort(gaps, gap)
        by_gap.setdefault(gap, []).append((runs, times))

    for length in np.flatnonzero(counts[1:])[::-1].tolist():
        length += 1
        todo = int(counts[length])
        while todo:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                most = size // length
                if todo >= most:
                    put(size - most * length, ((length, most),), todo // most)
                if todo % most:
                    put(size - todo % most * length, ((length, todo % most),), 1)
                break
            gap = gaps[at]
            runs, times = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            served = min(times, todo)
            each = min(gap // length, todo // served)
            if served < times:
                put(gap, runs, times - served)
            put(gap - each * length, (*runs, (length, each)) if runs[-1][0] != length else (*runs[:-1], (length, runs[-1][1] + each)), served)
            todo -= served * each
    return full + [x for found in by_gap.values() for x in found]


def plan(counts: np.ndarray, most: int = MOST) -> list[tuple[Runs, int]]:
    """counts of each length from 0 to the sequence's -> how sequences are filled, and how often."""
    size = len(counts) - 1
    left = counts.astype(np.int64)
    left[0] = 0
    out: list[tuple[Runs, int]] = [(((size, 1),), int(left[size]))] if left[size] else []
    left[size] = 0
    some, times = fit(patterns(np.flatnonzero(left), size, most), left)
    for k in np.argsort(-times, kind="stable"):
        lengths, each = np.unique(some[k][some[k] > 0], return_counts=True)
        whole = min(round(float(times[k])), int((left[lengths] // each).min()))
        if whole > 0:
            left[lengths] -= whole * each
            out.append((tuple(zip(lengths[::-1].tolist(), each[::-1].tolist(), strict=True)), whole))
    return out + best_fit(left)


def _places(filled: list[tuple[Runs, int]]) -> tuple[np.ndarray, ...]:
    """For ranks of each length, in order: length and first rank of a run's pieces, pieces of it in one sequence, first sequence, offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for runs, times in filled:
        offset = 0
        for length, each in runs:
            rows.append((length, rank.get(length, 0), each, sequence, offset))
            rank[length] = rank.get(length, 0) + each * times
            offset += length * each
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


_PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32()), "part": pa.int64(), "nth": pa.int64()}
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, part long, nth long"

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _cutter(path: str, size: int, with_ids: bool) -> Batches:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(path), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            text, doc = texts_of(batch.column("text")).cast(pa.large_string()), batch.column("doc_id").to_pylist()
            for a, b in steps(text, TOGETHER):
                rows = []
                for doc_id, ids in zip(doc[a:b], ids_of.encode(text[a:b]), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, size)):
                        own = ids[4 * start : 4 * (start + size)]
                        length = len(own) // 4
                        rows.append((doc_id, piece, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None, part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.values(), strict=True)], list(_PIECE))

    return cut


def _placer(places: tuple[np.ndarray, ...]) -> Batches:
    lengths, firsts, each, sequences, offsets = places
    begin = np.searchsorted(lengths, np.arange(int(lengths.max(initial=0)) + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                a, b = begin[length[own[0]]], begin[length[own[0]] + 1]
                run[own] = a + np.searchsorted(firsts[a:b], rank[own], side="right") - 1
            k, nth = np.divmod(rank - firsts[run], each[run])
            names = [c for c in batch.schema.names if c != "rank"]
            own = [batch.column(c) for c in names] + [pa.array(sequences[run] + k), pa.array(offsets[run] + nth * length)]
            yield pa.RecordBatch.from_arrays(own, [*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids its ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut_lineage(docs.mapInArrow(lean(_cutter(tokenizer, size, with_ids), forget=False), _DDL))
    counts = cut_lineage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    # a row a length: at most `size` of them
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).select(*columns, (F.col("before") + F.col("nth")).alias("rank"))
    types = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "array<int>"}
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(_places(plan(histogram, most))), schema)
