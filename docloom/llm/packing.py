"""Bounded-space online packing of token sequences.

Each partition keeps OPEN windows. A document that is longer than a window is cut into full windows and a
rest; the rest goes to the open window that it fills best, and where none has room, the fullest window is
emitted and a new one opened. At the end of its partition the open windows are leftovers; the leftovers of
a bounded number of partitions are merged, again best-fit, longest piece first, and the last piece of a
merge is cut where that saves a window. So memory is OPEN windows a task and OPEN * MERGED windows a merge.

Defined results: null text is empty; an empty document still has its end id; repeated rows are packed as
often as they occur; a null doc_id stays null; an empty table gives an empty result; other columns are
ignored. Sequence ids depend on how the input is split; the pieces and their ids do not.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, forgets, lean, steps, texts_of

WINDOW = 4096
OPEN = 64
#: Partitions whose leftovers are merged together.
MERGED = 16
#: Words or stems whose ids a worker remembers, at most, besides those of the texts at hand.
REMEMBERED = 500_000
END_ID = 2
#: Bytes of texts whose words are looked up together.
TOGETHER = 8 << 20
_TAIL = ".,!?%$#*&|;:"
#: Small letters of Latin-1.
_LETTERS = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_PLAIN = re.compile(f"[a-z{_LETTERS}]+").fullmatch

_encoders: dict[str, Encoder] = {}
forgets.append(_encoders.clear)


class Encoder:
    """ids of texts by a tokenizers file, remembering the ids of words between ASCII white space, or of their stems and punctuation.

    This needs a tokenizer whose units do not cross white space, whose normaliser lowers case and whose
    pre-tokenizer parts letters from trailing punctuation; the last two are tried out and else not used.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if one("It was\n\tso, as (it's) said 42 x") != [i for w in "It was so, as (it's) said 42 x".split() for i in one(w)]:
            raise ValueError("this tokenizer's ids depend on white space")
        # Words of these letters are one unit whatever normaliser and pre-tokenizer do: the model alone gives their ids.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        tried = ["a", "the", "thtionings", "zzxqjkv", "internationalisation", "ouwheandble" * 3, _LETTERS, *(f"{c}st{c}en{c}" for c in _LETTERS)]
        if any(one(w) != self.bare.encode(w, add_special_tokens=False).ids for w in tried):
            self.bare = self.tokenizer
        self.folds = one("Ab") == one("ab") and all(one("ab1" + c * k + d) == one("ab1") + one(c * k + d) for c in _TAIL for d in _TAIL for k in (1, 2))
        # other letters may fold to a letter and a mark, which the tokenizer joins with what follows
        letters = "".join(c for c in _LETTERS if all(one("ab" + c + d * 2) == one("ab" + c) + one(d * 2) for d in _TAIL))
        self.ends = f"[0-9a-z{letters}]$"
        self.controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, fresh: list[str]) -> None:
        plain = [u for u in fresh if _PLAIN(u)]
        other = [u for u in fresh if not _PLAIN(u)]
        for tokenizer, own in ((self.bare, plain), (self.tokenizer, other)):
            for u, e in zip(own, tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                ids = e.ids
                self.known[u] = struct.pack(f"<{len(ids)}I", *ids)

    def _units(self, units: pa.Array) -> pa.Array:
        """The ids of units that are all different."""
        own = units.to_pylist()
        fresh = [u for u in own if u not in self.known]
        if fresh and len(self.known) + len(fresh) > REMEMBERED:  # forget, and learn what these texts hold
            self.known.clear()
            fresh = own
        if fresh:
            self._learn(fresh)
        return pa.array([self.known[u] for u in own], pa.large_binary())

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of folded words that are all different: those of a stem and of the punctuation after it."""
        stem = pa.compute.ascii_rtrim(words, _TAIL)
        stem = pa.compute.if_else(pa.compute.match_substring_regex(stem, self.ends), stem, words)
        tailed = pa.compute.not_equal(pa.compute.binary_length(stem), pa.compute.binary_length(words))
        pairs = zip(words.filter(tailed).to_pylist(), stem.filter(tailed).to_pylist(), strict=True)
        tail = pa.array([""] + [w[len(s) :] for w, s in pairs], words.type)
        units = pa.concat_arrays([stem, tail]).dictionary_encode()
        ids, at = self._units(units.dictionary), units.indices
        after = np.full(len(words), len(words))  # where no tail is, the empty one
        after[np.flatnonzero(tailed.to_numpy(zero_copy_only=False))] += 1 + np.arange(len(tail) - 1)
        return pa.compute.binary_join_element_wise(ids.take(at[: len(words)]), ids.take(at.take(pa.array(after))), pa.scalar(b"", ids.type))

    def encode(self, texts: pa.Array | list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        # Arrow's functions of strings take a buffer to begin with the first text, which a cast slice's does not
        texts = pa.concat_arrays([texts, texts[:0]])
        folded = pa.compute.ascii_lower(texts)
        times = lambda c, own: pa.compute.sum(pa.compute.count_substring(own, c))
        # control strings are told by case: where folding makes one, words are taken as they are
        folds = self.folds and all(times(c, folded) == times(c, texts) for c in self.controls)
        rows = pa.compute.ascii_split_whitespace(folded if folds else texts)
        words = rows.flatten().dictionary_encode()
        ids = (self._words if folds else self._units)(words.dictionary).take(words.indices)
        _, at, data = ids.buffers()
        count = pa.compute.list_value_length(rows).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(at, np.int64)[np.cumsum(count)].tolist()
        data = b"" if data is None else memoryview(data)
        for a, b in pairwise([0, *ends]):
            yield bytes(data[a:b])


def encoder(path: str) -> Encoder:
    """One a worker process, kept between tasks of packing."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Windows:
    """Open windows by fill; place() says where a piece goes and which window is emitted for it."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.made = size, most, 0
        self.open: list[tuple[int, int]] = []  # (fill, window), sorted
        self.closed: set[int] = set()

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece of at most size."""
        if length == self.size:
            self.closed.add(window := self.new())
            return window, 0
        at = bisect_left(self.open, (self.size - length + 1, -1)) - 1
        if at >= 0:
            fill, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.closed.add(self.open.pop()[1])
            fill, window = 0, self.new()
        if fill + length == self.size:
            self.closed.add(window)
        else:
            insort(self.open, (fill + length, window))
        return window, fill


_PIECE = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "part": pa.int64(), "window": pa.int64(), "offset": pa.int64(), "left": pa.bool_(), "ids": pa.binary(),
}
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, left boolean, ids binary"


def _packer(path: str, size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, windows = encoder(path), TaskContext.get().partitionId(), Windows(size, most)
        kept: dict[int, list[tuple]] = {}  # the pieces of open windows, for a leftover may yet be cut
        end = np.array([END_ID], "<u4").tobytes()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.values(), strict=True)], list(_PIECE))

        for batch in batches:
            text, doc = texts_of(batch.column("text")).cast(pa.large_string()), batch.column("doc_id").to_pylist()
            for a, b in steps(text, TOGETHER):
                rows = []
                for doc_id, ids in zip(doc[a:b], ids_of.encode(text[a:b]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        window, offset = windows.place(len(piece) // 4)
                        kept.setdefault(window, []).append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, part, window, offset, False, piece))
                        for w in windows.closed:
                            rows += [(*r[:9], None) for r in kept.pop(w)]
                        windows.closed.clear()
                if rows:
                    yield made(rows)
        if rows := [(*r[:8], True, r[9]) for w in kept.values() for r in w]:
            yield made(rows)

    return pack


def _merger(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """Best-fit, longest first, into as few windows as the ids need; where no window has room, the piece is cut to fill the emptiest gap first."""
        windows = Windows(size, len(frame) + 1)
        need = -(-int(frame["length"].sum()) // size)
        frame = frame.sort_values(["length", "part", "window", "offset"], ascending=[False, True, True, True], kind="stable")
        out = []
        base = int(frame["part"].min())
        for doc_id, start, ids, total in zip(frame["doc_id"], frame["start"], frame["ids"], frame["doc_tokens"], strict=True):
            while ids:
                length = len(ids) // 4
                fits = bisect_left(windows.open, (size - length + 1, -1)) > 0
                if not fits and length < size and windows.made >= need:
                    length = size - windows.open[0][0]
                piece, ids = ids[: 4 * length], ids[4 * length :]
                window, offset = windows.place(length)
                out.append((doc_id, start, length, zlib.crc32(piece), total, base, window, offset))
                start += length
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset"])

    return merge


def pack(docs: DataFrame, tokenizer: str, size: int = WINDOW, open_windows: int = OPEN, merged: int = MERGED) -> DataFrame:
    """docs(doc_id, text) -> one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut_lineage(docs.mapInArrow(lean(_packer(tokenizer, size, open_windows), forget=False), _DDL))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    sequence = lambda left: (F.col("part") * 2 + left).cast("long") * (1 << 32) + F.col("window")
    done = pieces.where("not left").select(*columns, sequence(0).alias("sequence_id"), "offset")
    rest = (
        pieces.where("left").groupBy((F.col("part") / merged).cast("long").alias("block"))
        .applyInPandas(_merger(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long")
        .select(*columns, sequence(1).alias("sequence_id"), "offset")
    )
    return done.union(rest)
