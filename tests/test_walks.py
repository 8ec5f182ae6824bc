"""Folds, chains and question graphs against plain Python; each without rounds of joins or a frame a group."""

import random

from docloom.operators import audit as A
from docloom.operators import evidence as V
from docloom.operators import inventory as I


def test_fold_of_windows(spark):
    """Every op of an id depends on what the ids' ops before it have left."""
    r = random.Random(5)
    rows = [(f"s{s}", k, r.choice(["add", "add", "replace", "remove", "other"]), f"v{r.randint(0, 3)}", r.choice([None, f"o{k}"])) for s in range(40) for k in range(r.randint(1, 15))]
    want = set()
    for s in {x[0] for x in rows}:
        held, rejected = {}, 0
        for _, _, op, e, o in (x for x in rows if x[0] == s):
            if op == "add" and e not in held or op == "replace" and e in held:
                held[e] = o
            elif op == "remove" and e in held:
                del held[e]
            else:
                rejected += 1
        want |= {(s, e, o, rejected) for e, o in held.items()} or {(s, None, None, rejected)}
    found = A.evidence_fold(spark.createDataFrame(rows, "session string, step long, op string, evidence_id string, observation_id string").repartition(3))
    got = [tuple(x) for x in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_chains_take_one_shuffle(spark):
    """A chain of any length is walked at once, and nothing is joined."""
    edges = [("d", f"e{k}", f"e{k + 1}", 0.9) for k in range(300)] + [("d", "x", "y", 0.9), ("d", "y", "z", 0.1), ("d", None, "x", 0.9), (None, "e0", "q", 0.9)]
    anchors = [("d", "e150", "s1"), ("d", "x", "s1"), ("d", "y", "s2"), ("f", "e0", "s3"), ("d", "e7", "s1")]
    found = I.listing_chains(spark.createDataFrame(edges, "document_id string, source_id string, target_id string, confidence double"), spark.createDataFrame(anchors, "document_id string, element_id string, section_id string"))
    assert sorted(tuple(x) for x in found.collect()) == sorted([("d", f"e{k}", "s1") for k in range(301)] + [("f", "e0", "s3")])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_question_graphs_by_plain_search(spark):
    """Depths and members of cycles of random sets, as paths tell them; a long chain takes no rounds."""
    r = random.Random(9)
    rows = [(f"u{s}", f"q{k}", ",".join(f"q{r.randint(0, 7)}" for _ in range(r.choice([0, 0, 1, 1, 2])))) for s in range(60) for k in range(7)]
    rows += [("long", f"q{k}", f"q{k - 1}" if k else "") for k in range(3000)] + [("null", "q0", None)]
    found = V.question_walks(spark.createDataFrame(rows, "set_id string, question_id string, depends_on string"))
    got = {(x.set_id, x.question_id): (x.depth, x.cyclic) for x in found.collect()}
    assert len(got) == len(rows) and all(got["long", f"q{k}"] == (k + 1, False) for k in range(3000)) and got["null", "q0"] == (1, False)
    for s in {x[0] for x in rows} - {"long", "null"}:
        needs = {q: {x for x in d.split(",") if x} for u, q, d in rows if u == s}
        needs = {q: own & needs.keys() for q, own in needs.items()}
        reach = {q: set(own) - {q} for q, own in needs.items()}
        for _ in needs:
            reach = {q: own | {y for x in own for y in reach[x]} for q, own in reach.items()}
        whole = {q: set(own) for q, own in needs.items()}
        for _ in needs:
            whole = {q: own | {y for x in own for y in whole[x]} for q, own in whole.items()}
        deep = lambda q: 1 + max(map(deep, needs[q]), default=0)  # noqa: E731, B023
        for q in needs:
            endless = any(x in whole[x] for x in whole[q] | {q})
            assert got[s, q] == (None if endless else deep(q), q in reach[q]), (s, q, needs)
