"""Near-duplicates, embeddings, mixing, chat and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import chat, components, embeddings, minhash, mixing
from docloom.llm.queries import op9_chat_formatting

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "k") for i, t, s in rows], DOCS)


def roots(nodes, links):
    root = {v: v for v in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def shingles(text, width=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width=3, percent=85):
    sets = {i: shingles(t, width) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


def near_rows(seed, groups=6, each=30):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 12)))
    out = [(1000, None, "s"), (1001, "", "s"), (1002, "A b", "s"), (1003, "a  B", "s"), (1004, "a", "s"), (1005, "Éa b c", "s"), (1006, "éa b c", "s"), (1007, "x " * 40000, "s")]
    n = 0
    for g in range(groups):
        base = [word() for _ in range((8, 20, 60, 200, 700, 2500)[g % 6])]
        for _ in range(each):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            out.append((n, (" " if r.random() < 0.5 else "\n").join(w), "s"))
            n += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize("rule", [minhash.THREE_85, minhash.FIVE_80])
def test_near_duplicates_match_brute_force(spark, rule):
    rows = near_rows(1)
    sets, comp = brute(rows, rule.width, rule.percent)
    out = minhash.near_duplicates(docs(spark, rows), rule).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], r.doc_id == comp[r.doc_id])


def test_near_duplicates_small_tiles(spark, monkeypatch):
    """A chain whose ends don't resemble each other, in buckets that are cut into several tiles."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 150]), "s") for i in range(0, 120, 2)]
    monkeypatch.setattr(minhash, "TILE", 8)
    _, comp = brute(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()} == comp


def test_near_duplicates_smallest_sets_that_link(spark):
    rows = [(1, "a b c d e f g h", "s"), (2, "a b c d e f g h i", "s"), (3, "k l m n o p q r", "s"), (4, "k l m n o p q", "s")]
    _, comp = brute(rows)
    assert comp == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()} == comp


@pytest.mark.parametrize("rule", [minhash.THREE_85, minhash.FIVE_80])
def test_near_duplicates_insertions_and_deletions_around_the_smallest_sets(spark, rule):
    """Bases of 1 to 14 shingles, with words added or taken away at the ends and inside."""
    rows, n = [], 0
    for size in range(1, 15):
        base = [f"{size}b{k}" for k in range(size + rule.width - 1)]
        for w in (base, [*base, "new"], ["new", *base], base[1:], base[:-1], base[: size // 2] + base[size // 2 + 1 :], [*base, "one", "two"], [*base[: size // 2], "new", *base[size // 2 :]]):
            rows.append((n, " ".join(w), "s"))
            n += 1
    sets, comp = brute(rows, rule.width, rule.percent)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), rule).collect()} == comp
    assert len({len(sets[i]) for i, c in comp.items() if i != c}) > 8


def test_near_duplicates_tiles_hold_bounded_bytes(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 150]), "s") for i in range(0, 120, 2)]
    monkeypatch.setattr(minhash, "TILE_BYTES", 8 * 150 * 8)
    _, comp = brute(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()} == comp


def test_near_duplicates_edge_rows(spark):
    assert minhash.near_duplicates(docs(spark, [(1, "a", "s")]).where("false")).count() == 0
    rows = [(5, "a b c d e f g", "s"), (5, "a b c d e f g", "s"), (None, "a b c d e f g", "s"), (None, "other text of its own", "s"), (7, None, "s")]
    out = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7)]
    kept = minhash.distinct_documents(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 7").count() == 1


@pytest.mark.parametrize("rule", [minhash.THREE_85, minhash.FIVE_80])
def test_sketch_estimates_and_classes(rule):
    rng = np.random.default_rng(4)
    for n in (6, 40, 300, 3000, 40000):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[: int(1.1 * n)]), np.unique(pool[int(0.1 * n) : int(1.2 * n)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        both = set(minhash.classes(len(a), rule)) & set(minhash.classes(len(b), rule))
        c = min(both)
        equal = (minhash.registers(a, c, rule) == minhash.registers(b, c, rule)).mean()
        assert abs(float(minhash.estimate(np.array([equal]), np.array([len(a)]), np.array([len(b)]))[0]) - true) < 0.16
    assert (1 - (rule.percent / 100) ** rule.rows) ** rule.bands < 6e-8


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(200)] + [(5, 5)]
    nodes = {v for a, b in links if a != b for v in (a, b)}
    out = {x.node: x.component for x in components.components(spark.createDataFrame(links + [(None, 4)], "a long, b long")).collect()}
    assert out == roots(nodes, links)


def vectors(seed):
    rng = np.random.default_rng(seed)
    out, n = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=24)
            for _ in range(rng.integers(1, 6)):
                out.append((n, [float(v) for v in (base + rng.normal(size=24) * rng.choice([0, 0.1, 0.2])).astype("f4")], label))
                n += 1
    return out + [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] * 24, 0), (n + 3, [None] * 24, 0), (n + 4, [1.0, 2.0], 0), (n + 5, [2.0, 4.0], 0), (n + 6, [], 0), (n + 7, [1e38] * 24, 0), (n + 8, [1e-38] * 24, 0)]


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "BLOCK", 5)
    rows = vectors(2)
    good = {i: (np.array(v, float), la) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), la) for i, (v, la) in good.items()}
    links = [(a, b) for a, (x, la) in unit.items() for b, (y, lb) in unit.items() if a < b and la == lb and len(x) == len(y) and float(x @ y) >= 0.98]
    comp = roots([i for i, _, _ in rows], links)
    count = {i: sum(i in p for p in links) for i, _, _ in rows}
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == len(rows) and len(links) > 50
    for r in out:
        assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_edge_rows(spark, monkeypatch):
    """Null and repeated ids, text labels, extra columns, components that only doubles hold, and axes that are ordered instead of turned."""
    monkeypatch.setattr(embeddings, "TURNED", 2)
    a, b = [1.0, 0.1, 0.0], [1.0, 0.1 + 1e-12, 0.0]
    rows = [(1, a, "x"), (2, b, "x"), (2, b, "x"), (None, a, "x"), (4, a, "y"), (5, [0.0, 1.0, 0.0], "x"), (6, [1.0, 0.0], "x"), (7, [2.0, 0.0], "x"), (None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<double>, label string, node int, kept string")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (None, 0, None, False)], key=str)


def test_reachable_loses_nothing():
    rng = np.random.default_rng(1)
    a = embeddings.unit(rng.normal(size=(60, 40)))
    b = embeddings.unit(a[:50] + rng.normal(size=(50, 40)) * 0.04)
    i, j = embeddings.reachable(a, b, 0.95)
    assert set(zip(*np.nonzero(a @ b.T >= 0.95), strict=True)) <= set(zip(i, j, strict=True))


def wanted_targets(words):
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed, total = {}, sum(words.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * words[s] + 1e-9]
        if not over:
            return {s: fixed.get(s, rest * weight[s] / w if free else 0.0) for s in names}
        fixed |= {s: 3.0 * words[s] for s in over}


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randint(1, 9) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "a", "b", "c", "é", None, "Z"])) for i in range(900)]
    rows += [(9000, "one two", "tiny"), (9001, None, "void"), (9002, None, None), (9004, "again and again", "a"), (9004, "again and again", "a")]
    frame = docs(spark, rows).repartition(5)
    out = mixing.mix(frame).collect()
    size = lambda t: len((t or "").split())
    words, taken = {}, {}
    for i, t, s in rows:
        words[s] = words.get(s, 0) + size(t)
    target = wanted_targets(words)
    source = {i: s for i, _, s in rows}
    for x in out:
        s = source[x.doc_id]
        assert abs(x.target - target[s]) < 1e-6 and x.source_size == words[s] and 0 <= x.taken <= 3 * x.size
        taken[s] = taken.get(s, 0) + x.taken
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 60 for s in words)
    again = mixing.mix(frame.repartition(2)).collect()
    assert sorted(out, key=str) == sorted(again, key=str)
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert sum(size(x.text) for x in mixed.collect()) == sum(taken.values())
    assert mixing.mix(frame.where("false")).count() == 0 and mixing.mixed_documents(frame.where("false")).count() == 0


def test_mixing_is_the_truncated_queue_of_finish_times(spark, monkeypatch):
    """Without fills, what is taken is the longest prefix of all copies by finish time that the budget holds."""
    monkeypatch.setattr(mixing, "FILLS", 0)
    r = random.Random(3)
    rows = [(i, "w " * r.choice([0, 1, 5, 40, 300]), r.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(900, "long " * 60000, "d"), (901, None, "d")]
    for share in (1.0, 0.3):
        out = mixing.mix(docs(spark, rows).repartition(3), share=share).collect()
        source = {i: s for i, _, s in rows}
        copies = sorted((x.finish + c * x.lap, "=" + source[x.doc_id] if source[x.doc_id] else ">", x.doc_id, x.size) for x in out if x.size for c in range(3))
        budget, times = share * sum(x.size for x in out), {}
        for _, _, i, n in copies:
            budget -= n
            if budget < 0:
                break
            times[i] = times.get(i, 0) + 1
        assert {x.doc_id: x.times for x in out} == {x.doc_id: times.get(x.doc_id, 0) for x in out}
        first = {}
        for x in sorted((x for x in out if x.size), key=lambda x: x.finish):
            first.setdefault(source[x.doc_id], []).append(x)
        for s, own in first.items():  # cumulative words over weight
            at = 0
            for x in own:
                at += x.size
                assert abs(x.finish - at * x.lap / x.source_size) < 1e-6 * at


LUMPS = {
    # one document as large as three sources together beside them
    "one large": [(k, 20, "abc"[k // 1000]) for k in range(3000)] + [(5000, 60_000, "d")],
    # several large documents inside sources of small ones, and a source of two large ones
    "eight sources": [(k, 20 + k * 7919 % 1981, "abcdefgh"[k % 8]) for k in range(320)] + [(900, 100_000, "h"), (901, 30_000, "b"), (902, 45_000, "b"), (903, 9_000, "i"), (904, 8_000, "i")],
    "all alike": [(k, 1000, "ab"[k % 3 == 0]) for k in range(60)],
    "small and single": [(1, 5, "a"), (2, 7, "b"), (3, 1, None)],
}


def subset_gap(sizes, target):
    """The least distance to the target that up to three of each size can reach."""
    reach = 1
    for n in sizes:
        for _ in range(3):
            reach |= reach << n
    near = [d for d in range(int(target) + 2) if any(x >= 0 and reach >> x & 1 for x in (int(target) - d, int(target) + d))]
    return near[0] + 1


@pytest.mark.parametrize("case", LUMPS)
def test_mixing_of_lumpy_sources(spark, case):
    """Sources with single large documents end near their targets, and so do the others; the best that any choice of copies could reach is the measure."""
    rows = [(i, "w " * n, s) for i, n, s in LUMPS[case]]
    out = mixing.mix(docs(spark, rows).repartition(4)).collect()
    source, sizes, taken = {i: s for i, _, s in LUMPS[case]}, {}, {}
    for x in out:
        sizes.setdefault(source[x.doc_id], []).append(x.size)
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
        assert x.taken in (0, x.size, 2 * x.size, 3 * x.size)
    target = wanted_targets({s: sum(n) for s, n in sizes.items()})
    for s, n in sizes.items():
        fits = [x for x in n if x <= target[s]]
        gap = abs(taken[s] - target[s])
        assert gap <= max(subset_gap(n, target[s]), max(fits, default=0) / 2), (s, taken[s], target[s])
        if len(n) > 30:
            assert gap <= max(25, 0.01 * target[s])
    # the budget is kept but for sources that one document makes or breaks
    assert abs(sum(taken.values()) - sum(target.values())) <= sum(max(subset_gap(n, target[s]), 0.002 * target[s]) for s, n in sizes.items())


def test_mixed_documents_holds_each_as_often_as_taken(spark):
    rows = [(i, f"text {i} " + "w " * (i % 17), "ab"[i % 3 == 0]) for i in range(120)] + [(500, "equal rows", "a")] * 5 + [(None, "no id", None)]
    frame = docs(spark, rows).repartition(3)
    times = {}
    for x in mixing.mix(frame).collect():
        times[x.doc_id] = times.get(x.doc_id, 0) + x.times
    got = {}
    for x in mixing.mixed_documents(frame).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
    assert got == {i: n for i, n in times.items() if n}


def test_chat_round_trip(spark, sf):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "a\\b <\\| <| \\<| <\\\\| é\n", "<|" * 3, "\\"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts * 2)] + [(2, None, None, None), (2, 0, "assistant", None), (None, 0, "<|end|>\n", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read(chat.render(frame)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t) for _, _, r, t in rows[:14]]
    assert [(t.role, t.text) for t in back[2].turns] == [("", ""), ("assistant", "")] and back[None].turns[0].role == "<|end|>\n"
    d = {r.conv_id: r for r in chat.digests(chat.render(frame)).collect()}
    loss = "".join(t for _, _, r, t in rows[:14] if r == "assistant")
    assert d[1].loss_chars == len(loss) and d[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:14]).encode()).hexdigest()
    assert chat.digests(chat.render(frame.where("false"))).count() == 0
    seven = op9_chat_formatting(spark, sf).where("conv_id = -7").collect()
    assert len(seven) == 1 and seven[0].loss_chars == 21


EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string, turns string, _turn string"


def fold(log):
    """The fold on plain Python: events in order, each applied to the turns so far."""
    order = {"message": 1, "edit": 2, "regenerate": 3, "delta": 4}
    low = lambda v: (v is not None, v)
    convs = {}
    for c, _, turn, kind, role, text, *_ in sorted((e for e in log if e[3] in order), key=lambda e: (low(e[1]), order[e[3]], low(e[2]), e[5] or "", low(e[4]))):
        turns = convs.setdefault(c, {})
        if kind in ("edit", "regenerate"):
            for t in [t for t in turns if low(t) >= low(turn)]:
                del turns[t]
        was = turns.setdefault(turn, [None, ""])
        was[0] = role if was[0] is None else was[0]
        was[1] += text or ""
    return sorted(((c, t, r or "", x) for c, turns in convs.items() for t, (r, x) in turns.items()), key=str)


def test_events_fold(spark):
    log = [
        (1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 2, "message", "user", "No"), (1, 5, 3, "delta", "assistant", "bad"),
        (1, 6, 1, "regenerate", "assistant", None), (1, 7, 1, "delta", "assistant", "Good "), (1, 8, 1, "delta", None, "day"), (1, 9, 2, "message", "user", "Ok"), (1, 10, 2, "edit", "user", "Okay"), (1, 11, 2, "like", "user", "x"),
        (2, 1, 0, "message", "user", "edit me"), (2, 3, 0, "edit", "user", "edited"), (2, 2, 1, "message", "assistant", "gone"),
    ]
    random.Random(1).shuffle(log)
    out = chat.reconstruct(spark.createDataFrame([(*e, "x", "y") for e in log], EVENTS)).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in out) == [(1, 0, "user", "Hi"), (1, 1, "assistant", "Good day"), (1, 2, "user", "Okay"), (2, 0, "user", "edited")]
    none = spark.createDataFrame([], EVENTS)
    assert chat.reconstruct(none).count() == 0


def test_events_fold_edge_rows(spark):
    """Equal sequence numbers, null roles, texts, turns and conversations, repeated events, unknown kinds."""
    log = [
        (1, 1, 0, "delta", None, "D"), (1, 1, 0, "message", None, "M"), (2, 1, None, "message", "user", "first"), (2, 2, 3, "edit", "user", "e"), (3, 1, 4, "message", "user", "x"), (3, 2, None, "edit", None, "all"),
        (4, 1, 1, "message", "user", "same"), (4, 1, 1, "message", "user", "same"), (None, None, 0, "message", None, None), (5, 1, 0, "like", "user", "x"), (6, 1, 0, "delta", None, "a" * 100000),
    ]
    r = random.Random(5)
    log += [(r.randint(10, 14), r.randint(0, 9), r.choice([None, 0, 1, 2, 3]), r.choice(["message", "delta", "edit", "regenerate", "delta", "none"]), r.choice([None, "user", "assistant"]), r.choice([None, "", "p", "q", "rs"])) for _ in range(150)]
    out = chat.reconstruct(spark.createDataFrame([(*e, "x", "y") for e in log], EVENTS).repartition(3)).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in out), key=str) == fold(log)
    assert ("DM" not in {r.text for r in out}) and ("MD" in {r.text for r in out})


def test_event_log_holds_each_kind_and_folds_to_the_messages(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} é👍 " * (7 * t)) for c in range(12) for t in range(c % 5 + 1)] + [(90, None, None, None), (90, 0, "assistant", None), (None, 3, "user", "z")]
    log = chat.event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    events = [tuple(e) for e in log.collect()]
    assert {e[3] for e in events} == {"message", "delta", "edit", "regenerate"}
    want, count = [], {}
    for c, t, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1])):
        count[c] = count.get(c, 0) + 1
        want.append((c, count[c], role or "", text or ""))
    assert fold(events) == sorted(want, key=str)
    out = chat.reconstruct(log).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in out), key=str) == sorted(want, key=str)
    # without the fold of edits and regenerations the drafts would be left
    assert any("draft of" in (e[5] or "") for e in events) and not any("draft of" in r.text or "too early" in r.text for r in out)


def test_pipeline(spark, sf):
    """Each stage against a plain form of its decision on its own input."""
    import corpus_pipeline

    from docloom.llm import quality, secrets

    given = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.predicted for r in quality.score(given, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    a = stages["quality"](spark, given, sf)
    first = a.collect()
    assert a.columns == given.columns and {r.doc_id for r in first} == {i for i, p in scores.items() if p}
    _, comp = brute([(r.doc_id, r.text, "") for r in first], 5, 80)
    a = spark.createDataFrame(first, given.schema)
    b = stages["near_dedup"](spark, a, sf).collect()
    assert {r.doc_id for r in b} == set(comp.values()) and len(b) == len(set(comp.values()))
    b = spark.createDataFrame(b, given.schema)
    c = stages["secrets"](spark, b, sf).collect()
    texts = {r.doc_id: r.text for r in b.collect()}
    assert len(c) == len(texts) and all(r.text == texts[r.doc_id] or secrets.MASK in r.text for r in c)
    c = spark.createDataFrame(c, given.schema)
    times = {r.doc_id: r.times for r in mixing.mix(c).collect()}
    d = stages["mixing"](spark, c, sf)
    got = [r.doc_id for r in d.collect()]
    assert all(got.count(i) == n for i, n in times.items())
    e = stages["packing"](spark, d, sf).groupBy("doc_id").sum("length").collect()
    assert len(e) == sum(n > 0 for n in times.values())


def test_pipeline_edge_rows(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows, ties, columns of clashing names, and empty tables go through every stage."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, size long, component_id long, sequence_id string, `a b.c` string"
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    more = (0.5, 1, 2, 3, "x", "y")
    rows = [(k, t, "en", "s", len(t), *more) for k, t in enumerate(prose)] + [(7, prose[0], "en", None, None, *[None] * 6), (1, prose[1], "en", "s", len(prose[1]), *more), (None, prose[2], None, None, None, *more), (20, None, None, None, None, *[None] * 6), (21, "", "en", "s", 0, *more), (22, " ".join(prose) * 200, "en", "t", None, *more)]
    frame = spark.createDataFrame(rows, schema)
    for docs_ in (frame, frame.where("false")):
        now = docs_
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            if name != "packing":
                assert now.columns == frame.columns, name
            found = now.collect()
            now = spark.createDataFrame(found, now.schema)
            if name == "near_dedup" and docs_ is frame:
                ids = sorted(-1 if r.doc_id is None else r.doc_id for r in found)
                assert 7 not in ids and ids.count(1) <= 1 and len(ids) == len(set(ids))
        assert (len(found) > 0) == (docs_ is frame) and all(0 < r.length <= 4096 for r in found)


def test_workers_give_memory_back(spark, sf):
    """What a task of one stage has freed or remembers in a worker does not add to the memory of the stages after it."""
    from docloom.llm import common, packing
    from docloom.llm.queries import tokenizer_path

    def spent(batches):
        for batch in batches:
            own = [bytes(2000) for _ in range(50_000)]
            pins.append(own[-1])  # what lies above it keeps the heap from shrinking
            del own
            yield batch

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024

    pins = []
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    common.give_back()
    before = held()
    assert sum(b.num_rows for b in common.lean(spent)(iter([batch]))) == 1 and held() < before + 30

    def remembered(batches):
        import sys

        there = sys.modules.get("docloom.llm.packing")
        n = -1 if there is None else sum(len(e.known) for e in there._encoders.values())
        for b in batches:
            yield b.set_column(0, "n", pa.array([n] * b.num_rows, pa.int64()))

    given = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    assert packing.pack(given, tokenizer_path()).count() >= given.count()
    look = spark.range(0, 64, 1, 16).withColumnRenamed("id", "n")
    assert any(r.n > 0 for r in look.mapInArrow(remembered, "n long").collect())
    found = [r.n for r in common.map_batches(look, remembered).collect()]
    assert len(found) == 64 and 0 in found and max(found) == 0
