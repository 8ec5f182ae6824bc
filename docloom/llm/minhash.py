"""HyperMinHash near-duplicates of documents.

A document's set holds its distinct shingles of Rule.width words (or its whole word sequence where it has fewer
words). Sets are sketched once: each shingle falls into one of Rule.registers buckets, the bucket keeps the
smallest value, stored as leading-zero count and MANTISSA bits. Small sets are first replicated under 4**c
seeds, which leaves their Jaccard similarity as it is and fills the buckets; sets whose size lies near
the edge of two replication classes get a sketch in both, so that any pair that can link shares a class.

Bands of Rule.rows registers give buckets of candidates. At the least similarity s of a rule, a pair shares no band
with probability (1 - s**rows)**bands, below 6e-8 for both rules here. Candidates are compared as stars around one member of
each bucket; what a star leaves unconnected within its bucket is compared in tiles of bounded bytes. Pairs
whose collision-corrected estimate is more than five deviations below the threshold are dropped, all others
are confirmed on the full sets. Links become components; classes of equal sets are one node.

Defined results: null or blank text gives n_shingles 0, linked with nothing; equal sets are linked; each
input row gives one output row; a null doc_id is never the name of a component unless all ids of it are null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Arrow, cut_lineage, lean, lower, mix, release, steps, text_bytes, texts_of, word_hashes, words
from docloom.llm.components import components

MANTISSA = 10
#: A tile compares at most so many members of a bucket with as many others, and holds about so many bytes of sets a side.
TILE, TILE_BYTES = 256, 16 << 20
_U = np.uint64
_FULL = (1 << 48) - 1
#: Places of band and class in the bits of `meta`; the set's size stands above them.
_BAND, _CLASS = 1 << 8, 1 << 16


class Rule(NamedTuple):
    """Links need 100 * intersection >= percent * union of sets of shingles of `width` words."""

    width: int
    percent: int
    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def fill(self) -> int:
        return 4 * self.registers

    @property
    def slack(self) -> float:
        s = self.percent / 100
        return 5 * (s * (1 - s) / self.registers) ** 0.5


#: Three words and 0.85, as op10 asks for; five words and 0.8, the rule of near-duplicate stages.
THREE_85 = Rule(3, 85, 36, 6)
FIVE_80 = Rule(5, 80, 43, 5)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's set."""
    odd = mix(np.arange(1, width + 1, dtype=_U)) | _U(1)
    for a, b in steps(column := texts_of(column)):
        raw, at = text_bytes(column[a:b])
        raw = lower(raw)
        begins, ends, first = words(raw, at)
        h = word_hashes(raw, begins, ends)
        n = max(0, len(h) - width + 1)
        grams = np.zeros(n, _U)
        for k in range(width):
            grams += mix(h[k : k + n] * odd[k])
        grams = mix(grams)
        for f, t in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if t - f >= width:
                yield np.unique(grams[f : t - width + 1])
            elif t > f:
                yield mix(np.array([int.from_bytes(hashlib.blake2b(h[f:t].tobytes(), digest_size=8).digest(), "little")], _U))
            else:
                yield np.zeros(0, _U)


def classes(n: int, rule: Rule) -> list[int]:
    """Replication classes of a set of n: its own, and those of sets that are similar enough to link."""
    one = lambda m: next(c for c in range(32) if m * 4**c >= rule.fill)
    return sorted({one(max(1, n * rule.percent // 100)), one(n), one(-(-n * 100 // rule.percent))})


def registers(grams: np.ndarray, c: int, rule: Rule) -> np.ndarray:
    """The sketch of a set in class c: a uint16 a register, leading zeros above the mantissa bits."""
    least = np.full(rule.registers, _FULL, np.int64)
    seeds = mix(np.arange(4**c, dtype=_U) + _U(1 + 4**c))
    for s in range(0, len(grams), 1 << 16):
        x = mix(grams[s : s + (1 << 16), None] + seeds[None, :] if c else grams[s : s + (1 << 16)] + seeds[0]).ravel()
        bucket = ((x >> _U(48)) * _U(rule.registers)) >> _U(16)
        np.minimum.at(least, bucket.astype(np.intp), (x & _U(_FULL)).astype(np.int64))
    part, power = np.frexp(least.astype(np.float64) + 1)
    return ((48 - np.minimum(power, 48)).astype(np.uint16) << MANTISSA) | ((2 * part - 1) * ((1 << MANTISSA) - 1)).astype(np.uint16)


def estimate(share: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the chance collisions of sets of n and m.

    With exponential minima of rates n and m, two disjoint registers fall into one cell of relative width
    2**-MANTISSA with probability n*m/(n+m)**2 / (2 ln 2) / 2**MANTISSA, about.
    """
    chance = 0.7213 * n * m / np.maximum(1.0, (n + m) ** 2.0) / 2**MANTISSA
    return np.clip((share - chance) / (1 - chance), 0, 1)


def band_keys(sketches: np.ndarray, c: int, rule: Rule) -> np.ndarray:
    """(documents, bands) keys of bands; the class and the band are part of a key."""
    s = sketches.reshape(-1, rule.bands, rule.rows).astype(_U)
    key = np.zeros(s.shape[:2], _U)
    for k in range(rule.rows):
        key = mix(key + s[:, :, k] + _U(1))
    return mix(key ^ mix(np.arange(rule.bands, dtype=_U) + _U(1000 * c + 7)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_SKETCH = {"n_shingles": pa.int64(), "digest": pa.binary(), "c1": pa.int32(), "s1": pa.binary(), "c2": pa.int32(), "s2": pa.binary()}


def _sketcher(rule: Rule) -> Arrow:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in _SKETCH}
            for grams in shingle_sets(batch.column("text"), rule.width):
                # no other set is similar enough to one that falls short even with a single shingle more
                own = classes(len(grams), rule) if len(grams) * 100 >= rule.percent * (len(grams) + 1) else []
                own = [(c, registers(grams, c, rule).tobytes()) for c in own[:2]] + [(None, None)] * 2
                rows["n_shingles"].append(len(grams))
                rows["digest"].append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                for k in (0, 1):
                    rows[f"c{k + 1}"].append(own[k][0])
                    rows[f"s{k + 1}"].append(own[k][1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[k], t) for k, t in _SKETCH.items())], ["doc_id", *_SKETCH])

    return sketch


def _bander(rule: Rule) -> Arrow:
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "n", "c"))
            sketch = np.frombuffer(b"".join(batch.column("s").to_pylist()), np.uint16).reshape(-1, rule.registers)
            for k in np.unique(c):
                at = np.flatnonzero(c == k)
                keys = band_keys(sketch[at], int(k), rule)
                meta = (n[at, None] * _CLASS + int(k) * _BAND + np.arange(rule.bands)[None, :]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rep[at], rule.bands)), pa.array(meta.ravel())], ["key", "rep", "meta"])

    return band


def _setter(rule: Rule) -> Arrow:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g.tobytes() for g in shingle_sets(batch.column("text"), rule.width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["rep", "grams"])

    return sets


def _liker(rule: Rule) -> Arrow:
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, rule.registers) for k in ("sa", "sb"))
            n, m = (batch.column(k).to_numpy().astype(float) for k in ("na", "nb"))
            keep = estimate((a == b).mean(1), n, m) >= rule.percent / 100 - rule.slack
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return likely


def _confirmer(rule: Rule) -> Arrow:
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True)
            keep = [similar(np.frombuffer(x, _U), np.frombuffer(y, _U), rule.percent) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirmed


def _tiler(rule: Rule) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of a tile that join different components; the pairs of its bucket's pivot are known already."""
        frame = frame.sort_values("rep", kind="stable").drop_duplicates("rep").reset_index(drop=True)
        rep, n, side, band = (frame[k].to_numpy() for k in ("rep", "n", "side", "band"))
        sketch = np.frombuffer(b"".join(frame["s"]), np.uint16).reshape(-1, rule.registers)
        sets = [np.frombuffer(x, _U) for x in frame["grams"]]
        root = {c: c for c in frame["comp"]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        bands = sketch.reshape(len(rep), rule.bands, rule.rows)
        earlier = int(band[0])
        for i in range(len(rep)):
            other = np.flatnonzero((np.arange(len(rep)) > i) & ((side != side[i]) | bool(frame["same"].iloc[0])))
            small, large = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
            other = other[small * 100 >= rule.percent * large]
            if earlier:  # a pair belongs to the first bucket that it shares
                other = other[~(bands[other, :earlier] == bands[i, :earlier]).all(2).any(1)]
            other = other[estimate((sketch[other] == sketch[i]).mean(1), n[other].astype(float), float(n[i])) >= rule.percent / 100 - rule.slack]
            for j in other:
                if (x := find(frame["comp"].iat[i])) != (y := find(frame["comp"].iat[j])) and similar(sets[i], sets[j], rule.percent):
                    root[max(x, y)] = min(x, y)
                    out.append((rep[i], rep[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return tile


def near_duplicates(docs: DataFrame, rule: Rule = THREE_85) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = cut_lineage(docs.mapInArrow(lean(_sketcher(rule)), "doc_id long, n_shingles long, digest binary, c1 int, s1 binary, c2 int, s2 binary"))
    groups = feats.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    nodes = feats.where("c1 is not null").join(groups.where("rep is not null").select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    sketches = nodes.select(
        F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"),
        F.explode(F.array(*(F.struct(F.col(f"c{k}").alias("c"), F.col(f"s{k}").alias("s")) for k in (1, 2)))).alias("x"),
    ).select("rep", "n", "x.c", "x.s").where("c is not null")
    sketches = cut_lineage(sketches)

    # a bucket's pivot is a member by hash, so that the buckets of one group have many pivots; all buffers are of fixed width and hash-aggregated
    bands = sketches.mapInArrow(lean(_bander(rule)), "key long, rep long, meta long")
    order = F.xxhash64("rep", "key")
    pivots = bands.groupBy("key").agg(
        F.count("*").alias("members"), F.sum(F.floor(F.col("meta") / _CLASS)).alias("size"), F.min_by("rep", order).alias("pivot"), F.min_by("meta", order).alias("pivot_meta"),
    ).where("members > 1")
    members = cut_lineage(
        bands.join(pivots, "key").select(
            "key", "rep", F.floor(F.col("meta") / _CLASS).alias("n"), (F.col("meta") % _BAND).cast("int").alias("band"), F.floor(F.col("meta") % _CLASS / _BAND).cast("int").alias("c"),
            "members", "size", "pivot", F.floor(F.col("pivot_meta") / _CLASS).alias("pn"),
        )
    )

    # stars: each member with the pivot of its bucket
    ends = lambda f: F.when(F.col("rep") < F.col("pivot"), f("rep", "n")).otherwise(f("pivot", "pn"))
    pairs = (
        members.where(f"rep <> pivot and least(n, pn) * 100 >= {rule.percent} * greatest(n, pn)")
        .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), ends(lambda r, n: F.col(n)).alias("na"), (F.col("n") + F.col("pn")).alias("nn"), "c")
        .groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nn").alias("nn"), F.min("c").alias("c")).withColumn("nb", F.col("nn") - F.col("na"))
    )
    side = lambda x: sketches.select(F.col("rep").alias(x), "c", F.col("s").alias(f"s{x}"))
    likely = cut_lineage(pairs.join(side("a"), ["a", "c"]).join(side("b"), ["b", "c"]).mapInArrow(lean(_liker(rule)), "a long, b long"))
    crowded = members.where("members > 2")
    asked = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(crowded.select("rep")).distinct()
    sets = cut_lineage(docs.join(asked, "doc_id", "left_semi").mapInArrow(lean(_setter(rule)), "rep long, grams binary"))
    half = lambda x: sets.select(F.col("rep").alias(x), F.col("grams").alias(f"g{x}"))
    links = cut_lineage(likely.join(half("a"), "a").join(half("b"), "b").mapInArrow(lean(_confirmer(rule)), "a long, b long"))
    release(likely)
    joined = components(links)

    # tiles: what the stars left apart within a bucket
    named = crowded.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    apart = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    blocks = F.ceil(F.greatest(F.col("members") / TILE, F.col("size") * 8 / TILE_BYTES)).cast("int")
    tiles = (
        named.where("rep <> pivot").join(apart, "key")
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "to").alias("t1"), F.greatest("block", "to").alias("t2"), F.col("block").alias("side"), (F.col("block") == F.col("to")).alias("same"), "rep", "n", "band", "c", "comp")
        .join(sketches.select("rep", "c", "s"), ["rep", "c"]).join(sets, "rep")
        .groupBy("key", "t1", "t2").applyInPandas(_tiler(rule), "a long, b long")
    )
    more = cut_lineage(tiles)
    release(members, sketches, sets)
    if not more.isEmpty():
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    named = groups.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("comp"))
    out = feats.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def distinct_documents(docs: DataFrame, rule: Rule = FIVE_80) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id, with all its columns.

    Of rows that repeat an id and a text, one stays; rows without an id cannot be named and all stay.
    """
    marked = near_duplicates(docs.where("doc_id is not null"), rule).where("kept").select("doc_id").distinct()
    hashed = docs.where("doc_id is not null").withColumn("_minhash_text", F.xxhash64("text"))
    kept = hashed.join(marked, "doc_id", "left_semi").dropDuplicates(["doc_id", "_minhash_text"]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.union(docs.where("doc_id is null"))
