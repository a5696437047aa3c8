"""Operator 11."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import common, spelling
from rankloom.llm.queries import op11_spelling

SF = "/root/testdata/sf0.001"


def around(word, letters):
    """All strings that differ from `word` by exactly one code point inserted, deleted or replaced."""
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    less = {a + b[1:] for a, b in cuts if b}
    other = {a + c + b[1:] for a, b in cuts if b for c in letters if c != b[0]}
    return less | other | {a + c + b for a, b in cuts for c in letters}


def plain(counts, times=2):
    """{word: (form, root, n, n_near, form_n)} by making up all strings around each word."""
    letters, form, out = set("".join(counts)), {}, {}
    for w, n in counts.items():
        close = sorted((-counts[x], x) for x in around(w, letters) if x in counts)
        form[w] = close[0][1] if close and -close[0][0] >= times * n else None
        out[w] = len(close)
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, out[w], counts[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def counted(rows, length=5, least=3):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in c.items() if len(w) >= length and n >= least}


def test_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = counted((r.doc_id, r.text) for r in rows)
    assert len(want) > 1000
    df = op11_spelling(spark, SF)
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert got(df) == plain(want)


@pytest.mark.parametrize("seed", range(3))
def test_dense_words(spark, seed):
    """Few letters: repeated letters, transpositions, many neighbours, ties and chains."""
    r = random.Random(seed)
    words = {"".join(r.choice("aab𝔘é") for _ in range(r.randint(1, 6))): r.choice([3, 3, 4, 6, 7, 12, 24, 48, 100]) for _ in range(400)}
    df = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    want = plain(words)
    assert got(df) == want
    totals = {x.root: (x.n_words, x.n) for x in spelling.members(df).collect()}
    roots = [v[1] for v in want.values()]
    assert totals == {x: (roots.count(x), sum(v[2] for v in want.values() if v[1] == x)) for x in set(roots)}


def test_long_chain(spark):
    words = {"a" * k: 2 ** (40 - k) for k in range(5, 38)}
    assert {v[1] for v in got(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))).values()} == {"aaaaa"}


def test_odd_rows(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(5_000))
    rows = [(1, None, "x"), (2, "", "x"), (None, "Aérons aérons AÉRONS aérons ab×÷cd", "x"), (None, "aérons", None), (3, "hallo Hallo HALLO hallo", "x"), (3, "hallx hallx hallx", "x")] + [(k, long + (" " + long[1:] if k < 13 else ""), "x") for k in range(10, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = {w: n for w, n in Counter(re.sub("[A-Z]", lambda m: m[0].lower(), x) for _, t, _ in rows for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")).items() if len(w) >= 5 and n >= 3}
    assert got(spelling.group_variants(spelling.count_words(docs))) == plain(want)
    assert want[long] == 4 and want[long[1:]] == 3
    assert got(spelling.group_variants(spelling.count_words(docs.limit(0)))) == {}
    assert spelling.members(spelling.group_variants(spelling.count_words(docs.where("doc_id < 3")))).count() == 0


def test_keys_are_those_of_the_cut_words():
    words = ["", "a", "aa", "abba", "𝔘é", "aab" * 50]
    which, key, lo, hi = spelling.deletion_keys(pa.array(words))
    cuts = sorted({(w, w[:k] + w[k + 1 :]) for w in words for k in range(len(w))})
    whole = dict(zip((c for _, c in cuts), spelling.deletion_keys(pa.array([c for _, c in cuts]))[1].tolist(), strict=False))
    seen = [(words[i], a, b, k) for i, a, b, k in zip(which, lo, hi, key, strict=True) if a >= 0]
    assert len(seen) == len(cuts)
    for w, a, b, k in seen:
        assert {w[:p] + w[p + 1 :] for p in range(a, b + 1)} == {w[:a] + w[a + 1 :]}
        assert whole[w[:a] + w[a + 1 :]] == k
    assert len(spelling.deletion_keys(pa.array([], pa.string()))[0]) == 0


def test_no_table_of_words_is_broadcast(spark):
    """Words grow with the input; a small file of them has many keys, and none of its joins may go through the driver."""
    words = spark.range(2000).selectExpr("concat('word', chr(97 + id % 26), chr(97 + id div 26 % 26), chr(97 + id div 676)) AS word", "id % 50 + 3 AS n")
    n = len(common.staged.made)
    plans = [spelling.forms(words.withColumn("wid", F.monotonically_increasing_id())), spelling.group_variants(words)]
    assert len(common.staged.made) > n and plans[1].count() == 2000
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
