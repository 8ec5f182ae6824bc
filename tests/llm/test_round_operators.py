"""Whitening, prefix tries and pattern packing: brute force, plain versions and edge rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docloom.llm import patterns, trie, whitening
from docloom.llm.queries import tokenizer_path

VECTORS = "vec_id long, embedding array<float>, label int, component string, n string, vector string, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "p") for i, v in rows], VECTORS)


def plain_whitening(x):
    """Eigenvectors of the covariance, by falling eigenvalue, and what they make of the rows."""
    values, components = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, components = values[::-1], components[:, ::-1]
    return values, (x - x.mean(0)) @ components / np.sqrt(values)


@pytest.mark.parametrize("step", [7, 4096])
def test_whitening_matches_eigenvectors(spark, monkeypatch, step):
    monkeypatch.setattr(whitening, "STEP", step)
    monkeypatch.setattr(whitening, "FAN", 2)
    r = np.random.default_rng(1)
    rows = (r.normal(size=(90, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2]) + 7).astype(np.float32)
    rows[40:60] = rows[40]  # a group of copies
    got = whitening.whiten(vectors(spark, enumerate(rows.tolist())).repartition(5), most=4).toPandas()
    x = np.floor(rows.astype(float) * 64).astype(int) + whitening.SHIFT
    values, want = plain_whitening(x.astype(float))
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(90)].to_numpy()
    turned = np.sign((table * want[:, :4]).sum(0))
    assert table.shape == (90, 4) and np.abs(table - want[:, :4] * turned).max() < 1e-8
    n = len(x)
    assert (got.groupby("vec_id").deviation.first().loc[range(90)].to_numpy() == ((n * x - x.sum(0)) ** 2).sum(1)).all()
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, values[:4] / values.sum(), rtol=1e-10)
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and 0 < got.identity_error.iloc[0] < 1e-9


def test_whitening_merges_lose_nothing():
    """Merged in any order, the decompositions give the covariance of all rows."""
    r = np.random.default_rng(2)
    x = r.integers(-5000, 5000, (61, 8))
    parts = [whitening.decompose(p) for p in np.split(x, [1, 3, 4, 20, 21])]
    for order in (range(6), [5, 0, 3, 1, 4, 2]):
        total = None
        for k in order:
            total = parts[k] if total is None else whitening.merge(total, parts[k])
        n, sums, s, v = total
        assert n == 61 and list(sums) == x.sum(0).tolist() and len(s) == 8
        assert np.allclose(v.T @ np.diag(s**2) @ v / n, np.cov(x.T, bias=True), rtol=1e-9)


def test_whitening_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [2.0, -1.0]), (3, [2.0, -1.0]), (None, [0.0, 0.5])]
    bad = [(4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, []), (9, [1.0]), (10, [1.0, 2.0, 3.0]), (11, [1e30, 1.0])]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert sorted(((r.vec_id or 0), r.component) for r in got) == sorted((i or 0, k) for i, _ in good for k in (1, 2))
    assert all(r.n == 5 for r in got)
    # no variance in the second component, and in none
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k]) for k in range(4)])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    same = whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(3)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    # exact beyond 64 bits on the way; null where the result does not fit
    far = whitening.whiten(vectors(spark, [(0, [2.0**33, 0.0]), (1, [-(2.0**33), 0.0]), (2, [1.0, 1.0])]), 1).collect()
    assert all(r.deviation is None for r in far if r.vec_id < 2)


TALKS = "conv_id long, turn long, role string, text string, depth string, node string, level int, _part int, words string"


def plain_trie(rows):
    """The trie by dictionaries, from (conv_id, turn, role, text)."""
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in talks.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def total(k):
        below = [total(x) for x in kids.get(k, [])]
        saved = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        return sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below)

    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *total(k), hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    )


def got_trie(spark, rows):
    r = random.Random(3)
    shown = [(*x, "x", "y", 1, 2, "w") for x in rows]
    r.shuffle(shown)
    return sorted(tuple(x) for x in trie.prefix_trie(spark.createDataFrame(shown, TALKS).repartition(3)).collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_matches_dictionaries(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 63), 100, 110, -7, -20, 10**12 + 3]:
        for t in range(r.choice([0, 1, 2, 3, 4, 4, 6]) + 1):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "a b", "c", "d e f", "", "ü  x"])))
    assert got_trie(spark, rows) == plain_trie(rows)


def test_trie_of_hot_and_long_conversations(spark, monkeypatch):
    """One conversation with most rows, many copies of another, and a chain of copies that each go one turn further."""
    monkeypatch.setattr(trie, "RUN", 3)
    rows = [(5, t, "user", f"t{t % 7} x") for t in range(400)]
    rows += [(1000 + 20 * c, t, "user", "same words") for c in range(40) for t in range(3)]
    rows += [(3000 + 20 * c, t, "user", f"step {t}") for c in range(25) for t in range(c + 1)]
    assert got_trie(spark, rows) == plain_trie(rows)


def test_trie_edge_rows(spark):
    rows = [
        (None, 1, "user", "nobody's"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, None, "b"), (0, 1, "x", "b"), (0, 2, "user", "same"), (0, 2, "user", "same"),
        (20, 1, "user", "  \t"), (21, 1, "user", "only a short one"), (22, 1, "u", "a"), (45, 1, "u", "goes where h is above 0"), (46, 1, "u", "a"), (60, 1, "z", "long " * 5000), (60, 1, "z", "long " * 5000 + "er"), (60, 1, "z", "long"),
    ]
    assert got_trie(spark, rows) == plain_trie(rows)
    assert got_trie(spark, []) == [] and got_trie(spark, rows[:1]) == []
    # a conversation whose own turns are all replaced by none
    alone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)
    assert got_trie(spark, [(alone, 0, "u", "gone")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_levels_of_a_trie_are_few(spark):
    """Every node of a binary trie has a light child: as many levels as the logarithm of its leaves."""
    rows = [(c * 20, t, "u", str(c >> t & 1)) for c in range(64) for t in range(6)]
    assert got_trie(spark, rows) == plain_trie(rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, part string, rank string"


def test_pattern_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    r = random.Random(4)
    texts = [(k, " ".join(r.choice(["one", "two", "three", "words,", "ÄÖ"]) for _ in range(r.choice([1, 5, 20, 60, 200])))) for k in range(80)]
    texts += [(900, None), (901, ""), (902, " \n"), (None, "no id"), (903, "same"), (903, "same"), (904, "Wörter and words, " * 3000)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in texts], DOCS).repartition(5)
    rows = patterns.pack(frame, tokenizer_path(), size=256, with_ids=True).collect()
    found = {}
    for x in rows:
        found.setdefault(x.doc_id, []).append(x)
        assert x.length == len(x.ids) == (256 if x.start + x.length < max(y.start + y.length for y in rows if y.doc_id == x.doc_id) else x.length)
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and x.start == 256 * x.piece
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        times = 2 if i == 903 else 1
        own = sorted(found[i], key=lambda x: x.piece)
        assert [y for x in own[::times] for y in x.ids] == ids and len(own) == times * -(-len(ids) // 256)
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    need = -(-sum(x.length for x in rows) // 256)
    assert len(by) <= need + 1 and set(by) == set(range(len(by)))
    without = patterns.pack(frame, tokenizer_path(), size=256)
    assert without.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert patterns.pack(frame.where("false"), tokenizer_path()).count() == 0


def all_patterns(lengths, size, most):
    if size == 0:
        return {()}
    return {tuple(sorted((x, *rest), reverse=True)) for x in lengths if x <= size and most for rest in all_patterns(lengths, size - x, most - 1)}


def test_every_pattern_is_enumerated():
    r = random.Random(5)
    for most in (1, 2, 3, 4):
        lengths = sorted(r.sample(range(1, 31), 12))
        got = [tuple(x for x in row if x) for row in patterns.patterns(np.array(lengths), 30, most).tolist()]
        assert len(got) == len(set(got)) and set(got) == all_patterns(lengths, 30, most)


def test_fit_is_the_least_squares_solution():
    """No pattern that is used or not could be repeated more or less often to come nearer to the histogram; none is used a negative number of times."""
    r = np.random.default_rng(6)
    for _ in range(5):
        counts = r.integers(0, 50, 41)
        counts[0] = 0
        every = patterns.patterns(np.flatnonzero(counts), 40)
        some, times = patterns.fit(every, counts, rounds=500)
        assert (times > 0).all()
        left = counts - np.bincount(some.ravel(), np.repeat(times, 3), 41)
        left[0] = 0
        assert left[every].sum(1).max() < 0.2 and np.abs(left[some].sum(1)).max() < 0.2
        # cyclic coordinate descent over all patterns gets no nearer
        x, rest = np.zeros(len(every)), counts.astype(float)
        columns = [np.bincount(p[p > 0], minlength=41) for p in every]
        for _ in range(300):
            for k, a in enumerate(columns):
                step = max(-x[k], (a @ rest) / (a @ a))
                x[k] += step
                rest -= step * a
        assert left @ left < rest @ rest * 1.02 + 1


def test_best_fit_by_counts_is_best_fit_by_piece():
    r = random.Random(7)
    for _ in range(50):
        counts = np.zeros(33, np.int64)
        for _ in range(r.choice([1, 5, 30])):
            counts[r.randint(1, 32)] += r.choice([1, 2, 9, 40])
        filled = patterns.best_fit(counts)
        got = np.zeros(33, np.int64)
        for runs, times in filled:
            assert sum(length * each for length, each in runs) <= 32
            for length, each in runs:
                got[length] += each * times
        assert (got == counts).all()
        gaps = []
        for length in range(32, 0, -1):
            for _ in range(counts[length]):
                fits = [g for g in gaps if g >= length]
                gap = min(fits) if fits else 32
                if fits:
                    gaps.remove(gap)
                gaps.append(gap - length)
        assert sum(times for _, times in filled) == len(gaps)


def test_plan_needs_hardly_more_than_the_ids_do():
    r = np.random.default_rng(8)
    for n in (300, 20_000):
        lengths = np.clip(r.lognormal(5.5, 1.0, n).astype(int), 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        filled = patterns.plan(counts)
        got = np.zeros(2049, np.int64)
        for runs, times in filled:
            for length, each in runs:
                got[length] += each * times
        assert (got == counts).all()
        assert sum(times for _, times in filled) <= -(-int(lengths.sum()) // 2048) * 1.001 + 1
