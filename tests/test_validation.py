"""Faults by path, and signatures."""

import json

import pytest

from docloom.operators import validation as V

SCHEMA = {"a": {"allowed": ["x", 1]}, "b?": "text", "c": [{"n": "integer", "m?": "number"}], "d": {"e": "boolean", "f": "string"}}
GOOD = {"a": "x", "c": [{"n": 1}, {"n": 2, "m": 0.5}], "d": {"e": True, "f": ""}}
CASES = [
    (GOOD, []), (GOOD | {"b": None}, []), (GOOD | {"b": " "}, [("$.b", "blank")]), (GOOD | {"a": True}, [("$.a", "not_allowed")]), (GOOD | {"a": None}, [("$.a", "not_allowed")]),
    (GOOD | {"c": {}}, [("$.c", "wrong_type")]), (GOOD | {"c": [{"n": 1.0}, 5, {"m": "x"}]}, [("$.c[0].n", "wrong_type"), ("$.c[1]", "wrong_type"), ("$.c[2].n", "missing"), ("$.c[2].m", "wrong_type")]),
    (GOOD | {"d": {"e": 1, "g": 0}}, [("$.d.e", "wrong_type"), ("$.d.f", "missing"), ("$.d.g", "unknown_field")]), ({}, [("$.a", "missing"), ("$.c", "missing"), ("$.d", "missing")]), ([], [("$", "wrong_type")]), (None, [("$", "wrong_type")]),
]


@pytest.mark.parametrize("value, want", CASES)
def test_faults_have_paths(value, want):
    assert V.faults(value, SCHEMA) == want


def test_outputs_of_a_table(spark):
    texts = [json.dumps(v) for v, _ in CASES] + [None, "", "{", '{"a": NaN}', "[" * 100_000]
    frame = spark.createDataFrame([(f"c{k}", t, "x", "y") for k, t in enumerate(texts)], "case_id string, output string, path string, fault string").repartition(3)
    got = {}
    for r in V.check(frame, SCHEMA).collect():
        got.setdefault(r.case_id, []).append((r.path, r.fault))
    want = {f"c{k}": f for k, (_, f) in enumerate(CASES) if f} | {f"c{len(CASES) + k}": [("$", "not_json")] for k in range(5)}
    assert got == want
    assert V.check(frame.where("false"), SCHEMA).count() == 0


def test_signatures_tell_repeats_apart(spark):
    runs = [("a", '{"x": 1, "y": [1, {"t": 5}]}'), ("a", '{"y": [1, {"t": 6}], "x": 1}'), ("b", '{"x": 1}'), ("b", '{"x": 2}'), ("c", "{"), ("c", '{"x": 1}'), ("d", None)]
    out = {r.case_id: (r.runs, r.readable, r.signatures, r.stable) for r in V.signatures(spark.createDataFrame(runs, "case_id string, output string"), ignored=("t",)).collect()}
    assert out == {"a": (2, 2, 1, True), "b": (2, 2, 2, False), "c": (2, 1, 1, False), "d": (1, 0, 0, False)}
