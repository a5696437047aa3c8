"""Spelling variants: words at distance one are found by shared deletions, and each is led to its most frequent form.

Every word emits itself and its distinct single deletions (as 64-bit keys), an equi-join on the keys gives candidates, and
the words themselves are compared: exactly one code point inserted, deleted or replaced. A key's group is bounded by the
alphabet and the word's length, not by the input: a word less one code point, and what one code point more makes of it.
Keys of a word cost time and room in proportion to its length, as they come from prefix sums and not from cut strings.
All joins sort and merge: words grow with the input, and a table of few bytes in files, of which Spark would think that it
can be broadcast, has some ten keys for each word, all of which would go through the driver.

Null and empty texts have no words; rows of one id count each, as do rows without an id; other columns are not looked at.
A table without words gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of letters, once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
#: An odd base of the keys' polynomial and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def less_one(run: Column, key: Column) -> Column:
    """`run` without the code point at `key` modulo its length, from 0."""
    at = (key % F.length(run)).cast("int")
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))


def count_words(docs: DataFrame, spelled=None, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): lower-cased words of at least `length` code points that occur `least` times or more in `docs` (doc_id, text).

    `spelled` may give another spelling of a run, from the columns doc_id and run, before it is counted. Counts are summed
    in each task before they are shuffled, so a word that makes up a third of all texts is no burden.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    word = spelled(F.col("doc_id"), F.col("run")) if spelled else F.col("run")
    counts = runs.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, key, lo, hi) of all distinct single deletions, any place from lo to hi; the word itself has -1, -1.

    A string's key is the mixed sum of its code points' hashes times powers of BASE; from prefix sums, that of the string
    without place i is what stands before i, and what stands behind it divided by BASE.
    """
    if len(words) == 0:
        return (np.empty(0, np.int64),) * 4
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    which = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - start[which]
    with np.errstate(over="ignore"):
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, int(size.max()) - 1), BASE, np.uint64))])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64)) * powers[place], dtype=np.uint64)])
        whole = sums[end] - sums[start]
        first = np.ones(len(codes), bool)  # of a stretch of one code point
        first[1:] = (codes[1:] != codes[:-1]) | (which[1:] != which[:-1])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(codes))[: len(at)] - 1
        own = which[at]
        cut = sums[at] - sums[start[own]] + (sums[end[own]] - sums[at + 1]) * np.uint64(INVERSE)
    every, self_at = np.arange(len(words)), np.full(len(words), -1, np.int64)
    keys = mix(np.concatenate([whole, cut])).view(np.int64)
    return np.concatenate([every, own]), keys, np.concatenate([self_at, place[at]]), np.concatenate([self_at, place[last]])


def _emitted(words: DataFrame) -> DataFrame:
    """(key, wid, lo, hi) of `words` (wid, word)."""
    common.ship(words.sparkSession)

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, 1 << 20):
                which, key, lo, hi = deletion_keys(part.column(1))
                wid = part.column(0).take(pa.array(which))
                for k in range(0, len(key), 1 << 17):
                    cut = slice(k, k + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut]), wid[cut], pa.array(lo[cut]), pa.array(hi[cut])], names=["key", "wid", "lo", "hi"])

    return words.select("wid", "word").mapInArrow(run, "key long, wid long, lo long, hi long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(u, v, u_word, v_word, u_n, v_n) of words (wid, word, n) at distance exactly one; each pair once, u < v by wid.

    Of words that share a key one is the key, or both have a code point more than the key; the latter are candidates only
    where it stands at the same place. A pair meets so in one key only.
    """
    a, b = (_emitted(words).select(*(F.col(c).alias(f"{side}_{c}") for c in ("key", "wid", "lo", "hi"))) for side in "ab")
    same_place = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    met = a.join(b.hint("merge"), (F.col("a_key") == F.col("b_key")) & (F.col("a_wid") < F.col("b_wid")) & ((F.col("a_lo") < 0) | (F.col("b_lo") < 0) | same_place))
    pairs = met.select(F.col("a_wid").alias("u"), F.col("b_wid").alias("v"))
    for side in "uv":
        pairs = pairs.join(words.select(F.col("wid").alias(side), F.col("word").alias(f"{side}_word"), F.col("n").alias(f"{side}_n")).hint("merge"), side)
    return pairs.where(F.levenshtein("u_word", "v_word", 1) == 1)


def forms(words: DataFrame, times: int = 2) -> DataFrame:
    """Adds n_near, form, form_n and next (the form's wid) to words (wid, word, n).

    The form is the near word of largest n (ties: the smallest in code-point order) if that is `times` the word's n or
    more; else null.
    """
    ends = [F.struct(F.col(f"{x}").alias("wid"), F.col(f"{y}").alias("next"), F.col(f"{y}_word").alias("form"), F.col(f"{y}_n").alias("form_n")) for x, y in ("uv", "vu")]
    sides = near_pairs(words).select(F.explode(F.array(*ends)).alias("e")).select("e.*")
    best = sides.groupBy("wid").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "next")).alias("best"))
    whole = words.join(best.hint("merge"), "wid", "left")
    led = -F.col("best.less") >= times * F.col("n")
    return whole.select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"), F.when(led, F.col("best.next")).alias("next"))


def last_of(links: DataFrame) -> DataFrame:
    """(wid, next): each word's link led on to the last. links: (wid, next) without cycles and nulls.

    Every round joins the links with themselves, so a chain's length halves; chains of forms are short, as counts double.
    """
    links = common.stage(links.select("wid", "next", F.lit(True).alias("moved")), "links")
    while not links.where("moved").isEmpty():
        on = links.select(F.col("wid").alias("next"), F.col("next").alias("further"))
        links = common.stage(links.join(on.hint("merge"), "next", "left").select("wid", F.coalesce("further", "next").alias("next"), F.col("further").isNotNull().alias("moved")), "links")
    return links.select("wid", "next")


def group_variants(counts: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of counts (word, n), words being distinct.

    The root is where forms lead to from the word, itself if it has none. Words are numbered in a written table, so that
    wide ones needn't be shuffled with each of their keys.
    """
    words = common.stage(counts.select("word", "n", F.monotonically_increasing_id().alias("wid")), "words")
    formed = common.stage(forms(words, times), "forms")
    roots = last_of(formed.where("next IS NOT NULL").select("wid", "next")).join(words.select(F.col("wid").alias("next"), F.col("word").alias("root")).hint("merge"), "next").drop("next")
    return formed.join(roots.hint("merge"), "wid", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def members(grouped: DataFrame) -> DataFrame:
    """(root, n_words, n): how many words lead to each root, itself included, and their occurrences."""
    return grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n"))
