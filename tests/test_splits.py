"""Stratified splits: every label less than one row off its share, held against all possible splits where they're few."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from rankloom.operators import splits


def worst(rows, labels, sizes, split_of):
    """The largest distance of a label's count in a group from its share."""
    n, out = len(rows), 0.0
    for c in labels:
        for v in {r[c] for r in rows}:
            own = [r for r in rows if r[c] == v]
            for g, z in sizes.items():
                out = max(out, abs(sum(split_of[r["id"]] == g for r in own) - len(own) * z / n))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed):
    """Correlated labels, rare ones, nulls, and a label that a third of all rows have."""
    r = random.Random(seed)
    n = r.choice([333, 1000, 2500])
    rows = []
    for i in range(n):
        k = r.randrange(12)
        rows.append({"id": i, "a": "hot" if r.random() < 0.33 else f"a{k % 5}", "b": None if r.random() < 0.1 else f"b{k % 4}", "c": r.choice("pqrstuvwxyz"), "d": k % 3 == 0, "e": "rare" if r.random() < 0.004 else "usual"})
    sizes = {"train": n - n // 10 - n // 4, "val": n // 4, "test": n // 10}
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "id long, a string, b string, c string, d boolean, e string")
    got = {x.id: x.split for x in splits.stratified(df, "id", list("abcde"), sizes, seed, "t").collect()}
    assert len(got) == n and Counter(got.values()) == sizes
    assert worst(rows, "abcde", sizes, got) < 1
    table = splits.margins(splits.stratified(df, "id", list("abcde"), sizes, seed, "t"), list("abcde")).collect()
    assert {(x.field, x.value, x.split): x.n for x in table if x.n} == Counter((c, str("none" if x[c] is None else x[c]).lower(), got[x["id"]]) for x in rows for c in "abcde")
    assert all(abs(x.n - x.share) < 1 for x in table)


@pytest.mark.parametrize("seed", range(6))
def test_small_tables_against_all_splits(spark, seed):
    """Wherever any split of these sizes keeps every label within a row, so does this one."""
    r = random.Random(100 + seed)
    rows = [{"id": i, "a": r.choice("xyz"), "b": r.choice("pq"), "c": r.choice("uvw")} for i in range(9)]
    sizes = {"one": 5, "two": 4}
    possible = min(worst(rows, "abc", sizes, {i: "one" if i in some else "two" for i in range(9)}) for some in itertools.combinations(range(9), 5))
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "id long, a string, b string, c string")
    got = {x.id: x.split for x in splits.stratified(df, "id", list("abc"), sizes, seed, "t").collect()}
    assert Counter(got.values()) == sizes and (worst(rows, "abc", sizes, got) < 1 or possible >= 1)


def test_swaps_move_only_what_differs():
    """Two tuples that differ in one label: one swap mends that label and touches no other."""
    codes = np.array([[0, 2]] * 6 + [[1, 2]] * 6)
    group = np.array([0] * 5 + [1] + [0] * 1 + [1] * 5)
    apart = np.array([[2.0, -2.0], [-2.0, 2.0], [0.0, 0.0]])
    done = splits.swaps(codes, group, apart)
    assert len(done) >= 2 and np.abs(apart).max() < 1 and (apart[2] == 0).all()
    assert all(group[i] != group[j] for i, j in done[:1])
    assert splits.swaps(codes[:0], group[:0], np.full((3, 2), 5.0)) == []


def test_more_labels_than_allowed(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_LABELS", 3)
    df = spark.range(50).selectExpr("id", "string(id % 7) AS l")
    with pytest.raises(ValueError, match="different labels"):
        splits.stratified(df, "id", ["l"], {"a": 30, "b": 20}, 1, "t")
