"""Phrases in texts, by automata and by words, against looking for each in each."""

from __future__ import annotations

import random

import pytest

from rankloom.operators import joins


def pairs(df):
    return sorted((r.i, r.j) for r in df.collect())


@pytest.mark.parametrize("block,most", [(4_000_000, 32_000_000), (40, 32_000_000), (60, 10)])
def test_against_every_pair(spark, monkeypatch, block, most):
    """One automaton, many small ones, and the join by words beyond a size; overlapping, nested and repeated phrases."""
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "MOST", most)
    r = random.Random(block + most)
    words = ["a", "b", "aa", "ab", "é", "𝔘", "x.", ""]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "a b a b a b"), (62, "a b a b a b")]
    some = [(j, " ".join(r.choice(words) for _ in range(r.randint(1, 7)))) for j in range(50)] + [(50, None), (51, ""), (52, "a"), (52, "a"), (53, " "), (54, "no such phrase here")]
    docs, phrases = spark.createDataFrame(texts, "i long, t string").repartition(3), spark.createDataFrame(some, "j long, p string")
    want = sorted((i, j) for i, t in texts for j, p in some if t is not None and p is not None and p in t)
    got = joins.containing(docs, phrases, "t", "p")
    assert got.columns == ["i", "t", "j", "p"] and pairs(got) == want
    assert joins.containing(docs.limit(0), phrases, "t", "p").count() == 0 and joins.containing(docs, phrases.limit(0), "t", "p").count() == 0


def test_no_nested_loop(spark):
    docs, phrases = spark.createDataFrame([(1, "one two")], "i long, t string"), spark.createDataFrame([(1, "two"), (2, "e t")], "j long, p string")
    df = joins.containing(docs, phrases, "t", "p")
    assert pairs(df) == [(1, 1), (1, 2)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
