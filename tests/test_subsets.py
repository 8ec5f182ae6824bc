"""Trials and covers against plain loops."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from docloom.functions.text import base_tokens
from docloom.operators import subsets as S
from docloom.plans.subset_queries import words_of_sources


@pytest.mark.parametrize("size", [1, 5, 40])
def test_trials_match_a_plain_search(spark, size):
    r = random.Random(size)
    rows = [(k, r.randint(0, 9), float(r.randint(0, 100))) for k in range(30)]
    targets = {"a": 20.0, "b": 0.0}
    frame = spark.createDataFrame([*rows, (None, 5, 5.0), (3, 1, None)], "item_id long, a int, b double").repartition(3)
    got = S.balanced(frame, size, targets, trials=700, seed=3).collect()
    features = np.array([[a + (k == 3), b] for k, a, b in rows], float)
    scores = [S.score(features, S.drawn(3, t, 30, min(size, 30)), np.array([20.0, 0.0])) for t in range(700)]
    best = int(np.argmin(scores))
    assert [x.item_id for x in got] == S.drawn(3, best, 30, min(size, 30)).tolist() and {(x.trial, x.score) for x in got} == {(best, scores[best])}
    assert S.balanced(frame.where("false"), size, targets, trials=10).count() == 0


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(S, "SENT", 5)
    with pytest.raises(ValueError):
        S.balanced(spark.range(6).selectExpr("id as item_id", "1 as a"), 2, {"a": 1.0}, trials=5)


def test_cover_matches_plain_rounds(spark):
    r = random.Random(9)
    pairs = [(f"i{k}", r.randint(0, 40)) for k in range(12) for _ in range(r.randint(1, 15))] + [(None, 99), ("i0", None), ("i1", 3), ("i1", 3)]
    got = [(x.round, x.item_id, x.gain) for x in sorted(S.cover(spark.createDataFrame(pairs, "item_id string, element int"), 20).collect(), key=lambda x: x.round)]
    left = {}
    for i, e in pairs:
        if i is not None and e is not None:
            left.setdefault(i, set()).add(e)
    want = []
    while any(left.values()):
        i = min(left, key=lambda i: (-len(left[i]), i))
        own = set(left[i])
        want.append((len(want), i, len(own)))
        left = {k: v - own for k, v in left.items()}
    assert got == want
    assert S.cover(spark.createDataFrame([], "item_id string, element int"), 3).count() == 0


def test_a_cover_writes_only_what_a_later_round_reads(spark, monkeypatch):
    written = []
    monkeypatch.setattr(S, "cut_lineage", lambda rows, cut=S.cut_lineage: written.append(rows) or cut(rows))
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 3), ("c", 3)], "item_id string, element int")
    for most, tables, gains in ((1, 0, [("a", 2)]), (2, 2, [("a", 2), ("b", 1)]), (9, 3, [("a", 2), ("b", 1)])):
        written.clear()
        got = [(x.item_id, x.gain) for x in sorted(S.cover(pairs, most).collect(), key=lambda x: x.round)]
        assert (got, len(written)) == (gains, tables)


def test_words_are_folded_once_a_source_and_not_once_a_text(spark):
    texts = ["Straße STRASSE straße ẞ", "ΟΔΟΣ οδος ſo İzmir 300K ŉ", "ﬁn Fin ﬁN", "A-1.b a-1.B 中文", "", None, "Größe größe Größe"]
    rows = spark.createDataFrame([(s, t) for s in ("x", "y", None) for t in texts * 3], "source string, text string")
    found = words_of_sources(rows)
    want = rows.select(F.col("source").alias("item_id"), F.explode(base_tokens(F.col("text"))).alias("element")).distinct()
    assert sorted(map(tuple, found.distinct().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # before folding a token is there once a source, and no text is folded token by token
    assert found.where("item_id = 'x' and element = 'gr'").count() == 2
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
