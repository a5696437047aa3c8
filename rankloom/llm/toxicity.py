"""Toxicity by a factorization machine over hashed terms (operator 5).

A text is the set of its words, each hashed to one of BUCKETS terms. score = sigmoid(b + sum w_i + sum over pairs
<v_i, v_j>): the factors v learn which terms matter together, such as an insult and the mention of a group, which
additive weights miss. It is fitted on the driver, on at most `most` labelled rows (those of the least hash of their
id), over `terms` terms: those that tell the classes apart best there, alone or beside one that does. All frequent terms
without such a choice did worse on held-out texts. Every text is scored whole.

Null or empty text: the score of no term. Very long texts: their distinct words, in memory of one text. Null label: not
a training row; several labels of one row each count. No labelled rows, or of one class: a constant score. Null doc_id:
scored; as text it counts as empty for the fold. Ties in the choice: the lower term. Repeated rows are scored alike.
Other columns go through `score`; where one is called like the score, the score is called otherwise (`common.fresh`). Empty table: empty result. The model is of
a fixed size and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import ALNUM, Words

BUCKETS = 1 << 18


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of all texts, text by text, and where each text begins."""
    words = Words(texts, ALNUM)
    n = len(words.first) - 1
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(words.first))
    key = np.unique(text * BUCKETS + (words.hash >> np.uint64(46)).astype(np.int64))
    return key % BUCKETS, np.searchsorted(key, np.arange(n + 1) * BUCKETS)


@dataclass
class Model:
    slot: np.ndarray  # of each bucket, or -1
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        found, first = terms(texts)
        at = self.slot[found]
        row = np.repeat(np.arange(len(texts)), np.diff(first))[at >= 0]
        at = at[at >= 0]
        z = np.full(len(texts), self.bias) + np.bincount(row, self.w[at], len(texts))
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            z += 0.5 * (np.bincount(row, x, len(texts)) ** 2 - np.bincount(row, x * x, len(texts)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _apart(toxic: np.ndarray, all_: np.ndarray, p: float, least: int) -> np.ndarray:
    """By how many deviations terms in `all_` texts, `toxic` of them toxic, are off the rate p; 0 for rare terms."""
    z = (toxic - all_ * p) / np.sqrt(all_ * p * (1 - p) + 1)
    return np.where(all_ < least, 0, np.abs(z))


def chosen(rows: list[np.ndarray], y: np.ndarray, terms: int, least: int = 5, anchors: int = 64, sure: float = 2.0) -> np.ndarray:
    """Three quarters are the terms that tell the classes apart best alone; the rest those that do so best in the texts
    of one of the `anchors` best terms, by `sure` deviations or more: an innocent word that matters beside an insult is among them."""
    texts, flat = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)
    count = lambda on: (np.bincount(flat[on], y[texts[on]], BUCKETS), np.bincount(flat[on], minlength=BUCKETS))
    alone = _apart(*count(slice(None)), y.mean(), least)
    order = np.argsort(-alone, kind="stable")
    beside = np.zeros(BUCKETS)
    for term in order[:anchors][alone[order[:anchors]] > 0]:
        has = np.zeros(len(rows), bool)
        has[texts[flat == term]] = True
        beside = np.maximum(beside, _apart(*count(has[texts]), y[has].mean(), least))
    best = order[: terms - terms // 4]
    beside[best] = 0
    beside[beside < sure] = 0
    more = np.argsort(-beside, kind="stable")[: terms // 4]
    return np.concatenate([best[alone[best] > 0], more[beside[more] > 0]])


def fit(rows: list[np.ndarray], y: np.ndarray, terms: int = 2048, factors: int = 8, epochs: int = 25, rate: float = 0.1, decay: float = 2e-4, seed: int = 5) -> Model:
    """rows: the terms of each text. Without factors: additive weights alone."""
    slot = np.full(BUCKETS, -1, np.int32)
    n, yes = len(y), int(y.sum())
    prior = np.log((yes + 1) / (n - yes + 1))
    if yes == 0 or yes == n:
        return Model(slot, float(prior), np.zeros(1), np.zeros((1, factors)))
    used = chosen(rows, y, terms)
    slot[used] = np.arange(len(used))
    own = [slot[x] for x in rows]
    own = [x[x >= 0] for x in own]
    r, size = np.random.default_rng(seed), len(used)
    b, w, v = float(prior), np.zeros(size), r.normal(0, 0.02, (size, factors))
    gb, gw, gv = 1e-6, np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
    for _ in range(epochs):
        for at in np.array_split(r.permutation(n), max(1, n // 256)):
            term = np.concatenate([own[i] for i in at])
            row = np.repeat(np.arange(len(at)), [len(own[i]) for i in at])
            sums = lambda values: np.bincount(row, values, len(at))  # noqa: B023, E731
            into = lambda values: np.bincount(term, values, size)  # noqa: B023, E731
            s = np.array([sums(v[term, f]) for f in range(factors)]).reshape(factors, len(at))
            z = b + sums(w[term]) + 0.5 * ((s * s).sum(0) - sums((v[term] ** 2).sum(1)))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            de = into(e[row])
            dw, db = de + decay * w, e.sum()
            dv = np.array([into(e[row] * s[f][row]) for f in range(factors)]).reshape(factors, size).T - v * de[:, None] + decay * v
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            b, w, v = b - rate * db / gb**0.5, w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
    return Model(slot, float(b), w, v)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, **options) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = common.stage(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most), "training")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `most` rows

    def make():
        def fn(batch):
            found, first = terms(common.text_of(batch))
            return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found, pa.int32()))]

        return fn

    rows = common.map_arrow(texts, make, [common.field("terms", "array<int>")], ["doc_id", "toxic"]).orderBy("doc_id", "toxic").toArrow()
    lists = [np.asarray(x, np.int64) for x in rows["terms"].to_pylist()]
    return fit(lists, np.array([float(t) for t in rows["toxic"].to_pylist()]), **options)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` without text and with the scores as its last column, called common.fresh(docs, name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: [pa.array(shared.value.score(common.text_of(batch)))]

    return common.map_arrow(docs, make, [common.field(common.fresh(docs, name), "double")], [c for c in docs.columns if c != "text"])
