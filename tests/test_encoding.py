"""Encoders: one text once, retries, failures that are tried again later; the functions that run in Arrow."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.functions.chunking import token_spans
from docloom.functions.udfs import token_table, trimmed_mean
from docloom.operators import encoding as N

TEXTS = "text string, key string, vector string, id int"


def frame(spark, texts):
    return spark.createDataFrame([(t, "k", "v", i) for i, t in enumerate(texts)], TEXTS).repartition(3)


def flaky(folder, bad):
    """Clients of which every second call fails, and every call with a text that is bad."""

    class Flaky:
        def encode(self, texts):
            name = f"{folder}/{abs(hash(tuple(texts)))}"
            first = not os.path.exists(name)
            open(name, "w").close()
            if first or any(b in texts for b in bad):
                raise OSError("no answer")
            return np.array([[len(t), 1.0] for t in texts])

    return Flaky


def test_texts_are_encoded_once_and_calls_are_rows(spark, tmp_path):
    texts = ["a", "bb", "a", None, "", "ccc", "bad one"]
    path, folder = str(tmp_path / "cache"), str(tmp_path / "seen")
    os.mkdir(folder)
    rows = frame(spark, texts)
    assert tuple(N.cache_report(rows, path, "m").first()) == (5, 0, 5)
    calls = N.encode_missing(rows, path, "m", flaky(folder, ["bad one"]), batch=1, retries=3).collect()
    assert sorted((c.texts, c.chars, c.attempts, c.ok) for c in calls) == [(1, 0, 2, True), (1, 1, 2, True), (1, 2, 2, True), (1, 3, 2, True), (1, 7, 3, False)]
    assert tuple(N.cache_report(rows, path, "m").first()) == (5, 4, 1)
    got = {r.id: r.v for r in N.encoded(rows.withColumnRenamed("vector", "other"), path, "m").select("id", F.col("vector").alias("v")).collect()}
    assert got == {i: (None if t == "bad one" else [float(len(t or "")), 1.0]) for i, t in enumerate(texts)}
    # the next run tries only what is missing
    again = N.encode_missing(rows, path, "m", flaky(folder, []), batch=4).collect()
    assert [(c.texts, c.attempts, c.ok) for c in again] == [(1, 1, True)]
    assert N.encode_missing(rows, path, "m", flaky(folder, [])).count() == 0
    # another encoder has keys of its own
    assert tuple(N.cache_report(rows, path, "n").first()) == (5, 0, 5)
    assert N.encode_missing(rows.where("false"), path, "n", flaky(folder, [])).count() == 0


def test_answers_of_another_shape_fail(spark, tmp_path):
    class Odd:
        def encode(self, texts):
            return np.full((len(texts), 2), np.nan) if texts[0] == "nan" else np.zeros((len(texts) + 1, 2))

    calls = N.encode_missing(frame(spark, ["nan", "more"]), str(tmp_path / "c"), "m", Odd, batch=1, retries=2).collect()
    assert [(c.attempts, c.ok) for c in calls] == [(2, False)] * 2


def test_stand_in_is_deterministic():
    a = N.HashClient(16).encode(["One two", "two  ONE", "", "three"])
    assert np.allclose(a[0], a[1]) and not a[2].any() and np.allclose(np.linalg.norm(a[[0, 3]], axis=1), 1)


def test_token_table_and_trimmed_mean(spark):
    texts = ["A-1.b Straße 中文", None, "", "x/y"]
    got = {r.id: [] for r in frame(spark, texts).select("id").collect()}
    for r in frame(spark, texts).lateralJoin(token_table(F.col("text").outer())).select("id", "term", "start", "stop").collect():
        got[r.id].append((r.start, r.stop, r.term))
    assert got == {i: token_spans(t or "") for i, t in enumerate(texts)}
    values = [None, 1.0, 100.0, *map(float, range(2, 20))]
    out = spark.createDataFrame([("a", v) for v in values] + [("b", None), ("c", 5.0)], "k string, v double").groupBy("k").agg(trimmed_mean("v").alias("m")).collect()
    own = sorted(v for v in values if v is not None)[2:-2]
    assert {r.k: r.m for r in out} == {"a": float(pd.Series(own).mean()), "b": None, "c": 5.0}


def test_label_numbers_match_the_patterns(spark):
    import re

    from docloom.functions.text import LABEL_NUMBERS, label_number

    texts = ["Figure 3: x", "fig. IV", "Fig 2 (a)", "Figure 12b-c and", "figure 3 a \u2013 c.", "Figure 3abc", "FIGURE iv", "图 7 (B)", "Table 2y los", "表3", "2.3.1 Terms", "2.", "2.x", "IV. Part", "iv part", "第 3.2 节", "Listing 4", "listing 4a", "none", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, patterns in LABEL_NUMBERS.items():
        got = [r[0] for r in rows.select(label_number(kind, F.col("t"))).collect()]
        want = []
        for t in texts:
            m = next((m for p in patterns if (m := re.search(re.sub(r"\\x\{(\w+)\}", lambda k: chr(int(k[1], 16)), p), t or ""))), None)
            part = "".join(g or "" for g in m.groups()[1:]) if m else ""
            want.append(m and m[1].lower() + re.sub("[\u2012\u2013\u2014]", "-", re.sub(r"\s+", "", part)).lower())
        assert got == want, kind


def test_collections():
    from docloom.functions.udfs import collection

    assert collection("['B. ', \"a  b\", 3]") == ["3", "a b", "b"] and collection("[]") == [] and collection(" [1, 'x'] ") == ["1", "x"]
    assert collection("x") is None and collection("[x]") is None and collection(None) is None and collection("[1][0]") is None


def test_document_errors(spark):
    from docloom.operators.relations import document_errors

    pages = spark.createDataFrame([("d", "p1", ["e1", "e9"]), ("d", "p2", ["e1"]), ("z", "p1", None)], "document_id string, page_id string, element_ids array<string>")
    elements = spark.createDataFrame([("d", "e1", "p1", "s1"), ("d", "e2", "p7", None), ("z", "e1", None, "s1")], "document_id string, element_id string, page_id string, section_id string")
    sections = spark.createDataFrame([("d", "s1", "e1", None, ["p1", "p8"], ["e2"]), ("d", "s2", "e7", "s9", [], ["e8"])], "document_id string, section_id string, heading_id string, parent_id string, page_ids array<string>, element_ids array<string>")
    relations = spark.createDataFrame([("d", "r1", "e1", "s2"), ("d", "r2", "p2", "q"), ("z", "r1", "s1", "p1")], "document_id string, relation_id string, source_id string, target_id string")
    got = sorted(tuple(map(str, r)) for r in document_errors(pages, elements, sections, relations).select("document_id", "owner", "id", "error", "missing").collect())
    assert got == sorted([
        ("d", "page", "p1", "missing_element", "e9"), ("d", "element", "e1", "other_page", "p2"), ("d", "element", "e2", "missing_page", "p7"), ("z", "element", "e1", "missing_page", "None"), ("z", "element", "e1", "missing_section", "s1"),
        ("d", "section", "s1", "missing_page", "p8"), ("d", "section", "s2", "missing_heading", "e7"), ("d", "section", "s2", "missing_parent", "s9"), ("d", "section", "s2", "missing_element", "e8"), ("d", "relation", "r2", "missing_target", "q"), ("z", "relation", "r1", "missing_source", "s1"),
    ])
