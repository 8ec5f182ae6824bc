"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is described by character classes, repetition and word
shapes, in no language's terms; an encoder turns that into a vector, gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the weighted vector gives the score. Encoder, attention and
score are learned together from document labels, by gradient descent on batches of documents in an order of a fixed seed.

The model is fitted on all passages of at most SAMPLE labelled rows (the first by a hash of their id), which take about a fifth of
their texts' bytes on the driver; scoring reads every passage of every document.

Defined results: null text is empty; an empty text is one passage of zeros and is scored as such; a label
is the mean of an id's labels, null labels are left out; rows whose crc32 of the id as text is a multiple of 5 are held
out of learning; without labels of both kinds every score is 1; each input row gives one output row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import lean, lower, map_batches, mix, steps, text_bytes, texts_of, word_hashes, words

PASSAGE = 64
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 5000
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
#: Documents a batch, passes over all batches, and batches in all, at least.
BATCH, EPOCHS, LEAST_STEPS = 256, 30, 200
RATE, DECAY = 0.02, 1e-4
_U = np.uint64
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (44, 46)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
N_FEATURES = 20


def _distinct(of: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct keys of each of n owners, by 40 bits of a key."""
    packed = np.sort((of.astype(_U) << _U(40)) | (mix(keys) >> _U(24)))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    return np.bincount((packed[new] >> _U(40)).astype(np.intp), minlength=n)


def passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a run of texts: features of all their passages, and the first passage of each text (with the end of the last)."""
    for a, b in steps(column := texts_of(column)):
        raw, at = text_bytes(column[a:b])
        begins, ends, first = words(raw, at)
        n = np.diff(first)
        bags = np.maximum(1, -(-n // PASSAGE))
        bag = np.concatenate([[0], np.cumsum(bags)])
        out = np.zeros((bag[-1], N_FEATURES), np.float32)
        if len(begins):
            doc = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(begins)) - first[:-1][doc]
            passage = bag[:-1][doc] + place // PASSAGE
            start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            h = word_hashes(lower(raw), begins, ends)
            size = (ends - begins).astype(np.float32)

            def share(kind: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
                return (total[ends] - total[begins]) / size

            def again(far: int) -> np.ndarray:
                same = np.zeros(len(h), np.float32)
                same[far:] = (h[far:] == h[:-far]) & (doc[far:] == doc[:-far])
                return same

            last, one = raw[ends - 1], raw[begins]
            pair = np.zeros(len(h), _U)
            pair[:-1] = mix(h[:-1]) + h[1:]
            upper, symbol = share(_UPPER), share(_SYMBOLS)
            line = np.ones(len(h), np.float32)
            line[1:] = raw[ends[:-1]] == 10
            each = [
                size / 8, size * size / 100, upper, (upper > 0.6).astype(np.float32), symbol, (symbol == 1).astype(np.float32), _SYMBOLS[last].astype(np.float32), share(_DIGIT),
                again(1), again(2), again(3),
                (_UPPER[one] & (upper < 0.6)).astype(np.float32), (last == 46).astype(np.float32), (last == 44).astype(np.float32), line,
            ]
            counts = np.diff(np.concatenate([start, [len(h)]]))
            rows = passage[start]
            for k, x in enumerate(each):
                out[rows, k] = np.add.reduceat(x, start) / counts
            more = len(each)
            out[rows, more] = _distinct(passage, h, bag[-1])[rows] / counts
            out[rows, more + 1] = _distinct(passage, pair, bag[-1])[rows] / counts
            out[rows, more + 2] = (_distinct(doc, pair, len(n)) / np.maximum(1, n))[doc[start]]
            out[rows, more + 3] = np.log1p(counts) / 4
            out[rows, more + 4] = np.log1p(n[doc[start]]) / 8
        yield out, bag


class Model:
    """Parameters of the encoder (W, b), the gates (V, U, w) and the score (c, d), with the features' mean and spread."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        put = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": put(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": put(HIDDEN, GATE), "U": put(HIDDEN, GATE), "w": put(GATE), "c": put(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        n = np.diff(bag)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, bag[:-1]), n))
        a /= np.repeat(np.add.reduceat(a, bag[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, bag[:-1])
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "n": n, "s": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by parameter."""
        p, f = self.p, self.forward(x, bag)
        ds = (f["s"] - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], f["n"], 0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bag[:-1]), f["n"]))
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": de @ (f["t"] * f["g"]), "c": f["z"].T @ ds, "d": np.array([ds.sum()])}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, seed: int = 12) -> Model:
        p, m, v = self.p, {}, {}
        rng, n = np.random.default_rng(seed), np.diff(bag)
        batches = -(-len(y) // BATCH)
        steps = max(LEAST_STEPS, EPOCHS * batches)
        for step in range(1, steps + 1):
            if (step - 1) % batches == 0:
                order = rng.permutation(len(y))
            own = order[(step - 1) % batches :: batches]
            begin = np.concatenate([[0], np.cumsum(n[own])])
            rows = np.repeat(bag[:-1][own] - begin[:-1], n[own]) + np.arange(begin[-1])
            rate = RATE * min(1.0, 2 * (steps - step + 1) / steps)
            for k, g in self.gradient(x[rows], begin, y[own]).items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags, y = [], batch.column("y")
        for x, bag in passages(batch.column("text")):
            bags += [x[f:t].astype("<f4").tobytes() for f, t in zip(bag[:-1], bag[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), y], ["bag", "y"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers are broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("text", "y").mapInArrow(lean(_bags), "bag binary, y double")
    rows = sorted((bytes(r.bag), r.y) for r in rows.collect())
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    each = [np.frombuffer(r[0], "<f4").reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(each).astype(float)
    return Model(x.mean(0), x.std(0) + 1e-3).fit(x, np.concatenate([[0], np.cumsum([len(e) for e in each])]), y)


def _scorer(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.ones(len(bag) - 1) if model is None else model.forward(x, bag)["s"] for x, bag in passages(batch.column("text"))]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "_score" if "score" in batch.schema.names else "score"])

    return score


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> (doc_id, held_out, score, predicted)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(rows, labels, sample)
    return (
        rows.mapInArrow(lean(_scorer(model)), "doc_id long, text string, score double")
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    model = train(docs, labels, sample)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _scorer(model)(batches):
            keep = pa.compute.greater_equal(batch.column(batch.num_columns - 1), THRESHOLD)
            yield batch.select(list(range(batch.num_columns - 1))).filter(keep)

    return map_batches(docs, choose)
