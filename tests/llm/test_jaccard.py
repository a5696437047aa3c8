"""Operator 7 against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import common, components, jaccard
from rankloom.llm.queries import op7_jaccard

SCHEMA = "doc_id long, text string, n long"


def brute(data, k=4, percent=85):
    """(n_shingles, component) of each row's place."""
    own = []
    for _, text in data:
        w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        own.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(data)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            small, large = sorted((len(own[i]), len(own[j])))
            if small and 100 * small >= percent * large and top(i) != top(j):
                both = len(own[i] & own[j])
                if 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                    up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(own[i]), least.get(top(i)) if own[i] else d) for i, (d, _) in enumerate(data)]


def planted(seed):
    """Groups of near copies, chains, passages that unlike texts share, and odd rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    data = []

    def add(ws):
        data.append((len(data) * 3, " ".join(ws)))

    passage = r.choices(words, k=60)
    for _ in range(6):
        base = r.choices(words, k=r.randint(30, 200))
        for _ in range(r.randint(2, 14)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 50))):
                own[r.randrange(len(own))] = r.choice(words)
            add(own)
            if r.random() < 0.3:
                add([x.upper() for x in own])
    for n in range(30):
        add(passage + r.choices(words, k=5 + n))
    chain = r.choices(words, k=120)
    for _ in range(25):
        add(chain)
        chain = chain[1:] + [r.choice(words)] if r.random() < 0.7 else chain[:50] + [r.choice(words)] + chain[51:]
    for ws in ([], ["a"], ["A"], ["a", "b", "c"], ["a"] * 50, ["a"] * 5000, ["b", "a"] * 40):
        add(ws)
    r.shuffle(data)
    return [*data, (5000, None), (None, "no id at all here"), (None, data[0][1]), data[1], data[1], (5001, "É\té    x")]


@pytest.mark.parametrize(("seed", "rows", "picks"), [(1, 2048, 8), (2, 1, 1), (3, 3, 2)])
def test_all_links(spark, monkeypatch, seed, rows, picks):
    monkeypatch.setattr(jaccard, "ROWS", rows)
    monkeypatch.setattr(jaccard, "PICKS", picks)
    data = planted(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], SCHEMA)
    got = sorted(map(tuple, jaccard.near_copies(docs).collect()), key=str)
    assert got == sorted(brute(data), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_jaccard(spark, sf).collect())) == sorted(brute(data))


def test_keep_first_and_nothing(spark):
    data = planted(5)
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], SCHEMA)
    want = {d for d, _, c in brute(data) if d == c and d is not None}
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert jaccard.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 1000])
def test_overlap(monkeypatch, dense):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    r = np.random.default_rng(4)
    left, right = ([np.unique(r.integers(0, 60, k)).astype(np.uint64) for k in r.integers(1, 40, n)] for n in (30, 17))
    assert jaccard._overlap(left, right).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]


def test_unlinked_group(spark, monkeypatch):
    """A large group of texts that share prefix shingles and have few links, in blocks."""
    monkeypatch.setattr(jaccard, "ROWS", 16)
    r = random.Random(9)
    base, data = [f"b{i}" for i in range(60)], []
    for i in range(120):
        own = list(base)
        for _ in range(r.choice([1, 2, 3])):
            own[r.randrange(60)] = f"x{i % 90}"
        data.append((i, " ".join(own)))
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], SCHEMA)
    assert sorted(map(tuple, jaccard.near_copies(docs).collect())) == sorted(brute(data))


def test_keep_first_by_text(spark):
    """Rows of one doc_id with different texts, and copies without one."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    data = [(1, a), (1, b), (2, b), (None, a), (None, " ".join(f"c{i}" for i in range(30))), (None, " ".join(f"c{i}" for i in range(30))), (3, ""), (3, None), (4, a), (4, a)]
    docs = spark.createDataFrame([(d, t, "k", t) for d, t in data], "doc_id long, text string, kept_id string, kept_th string")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(1, a), (1, b), (None, data[4][1]), (3, ""), (3, None)], key=str)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {(x.node, x.label) for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(n, top(n)) for n in list(up) if top(n) != n}


def test_filter_lets_all_wanted_texts_through(spark):
    """And few others, null ids and rows of one id with other texts among them."""
    rows = [(None if i % 50 == 0 else i % 4000, f"text {i}") for i in range(5000)]
    docs = jaccard._texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    few = docs.where("pmod(xxhash64(text), 16) = 0").select(F.struct("doc_id", "th").alias("rep"))
    want = {(r.rep.doc_id, r.rep.th) for r in few.collect()}
    got = [(r.doc_id, r.th) for r in jaccard._passed(docs, few).collect()]
    assert want <= set(got) and len(got) < len(want) + 0.06 * len(rows)
    assert jaccard._passed(docs, few.limit(0)).count() == 0


def test_only_what_is_read_stays_staged(spark):
    """Of the staged tables texts, nodes and links stay, one each; the rest is deleted as soon as nothing reads it."""
    n = len(common.staged.made)
    texts = [" ".join(f"w{(i + k * (k % 7 == 0)) % 300}" for k in range(60)) for i in range(40)]
    df = jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    made = common.staged.made[n:]
    assert sorted(f.rsplit("/", 1)[-1].rpartition("-")[0] for f in made) == ["edges", "nodes", "texts"]
    assert df.count() == len(texts) and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_prefix_rows_without_partner_of_their_size_go(spark):
    """(token, node, n, reach): alone, two too far apart, beyond one's reach, and three of which two fit; no linked pair is lost."""
    rows = [(1, 1, 100, 117), (2, 1, 100, 117), (2, 2, 200, 235), (3, 3, 100, 90), (3, 4, 95, 111), (4, 1, 100, 117), (4, 5, 110, 129), (4, 2, 200, 235), (5, 6, 50, 58), (5, 6, 50, 58)]
    got = jaccard._shared(spark.createDataFrame(rows, "token long, node long, n long, reach long"), 85)
    assert sorted((r.key, r.node) for r in got.collect()) == [(4, 1), (4, 5)]
