"""Benchmark decontamination by suffix arrays over the training texts (operator 6).

Rows pass by in shards. In each, the words that the benchmark also has are numbered, every other word and each text's
end is a stop, and the places of the suffixes that begin a run of numbered words long enough for any window are sorted
by their first `window` words, the shard's suffix array: no decision needs a deeper order. Every test suffix is searched
in it by bisection: the places where its window occurs are a range of the array. Windows that follow each other in item
and text are put together, which gives the longest verbatim matches at any length. Words are compared by 64-bit hashes,
and matches byte by byte after that.

The benchmark is the query set: it is read in blocks of at most `block` characters or one item, each of which is
broadcast; the training rows stream past one block after the other, without a shuffle. A block takes memory in
proportion to its words, however long its items are.

Null or empty text: no words, no hits. Very long texts are one shard each. Item without words: never matched. An empty
benchmark hits nothing; an empty table gives an empty result. Repeated rows are judged one by one, equal items are all
reported. Columns that clash with the new ones' names stay; `find` tells the new names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import ALNUM, LOWER, Words

WINDOW = 10
SUFFIXES = 6_000_000  # numbers in a shard's suffix array, its depth times its length


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of n places."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Block:
    """Test suffixes of some items, searchable."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM)
        self.names = [n for n, _ in items]
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        at = np.unique(ids, return_index=True)[1]
        #: The vocabulary's spelling: bytes, and where each word begins.
        self.size = words.end[at] - words.start[at] if len(at) else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = LOWER[words.data[_spans(words.start[at], self.size)]] if len(at) else np.zeros(0, np.uint8)
        length = np.diff(words.first)
        item = np.repeat(np.arange(len(items)), np.where(length < window, np.minimum(length, 1), length - window + 1))
        first = np.flatnonzero(np.diff(item, prepend=-1)) if len(item) else np.zeros(0, int)
        self.item = item
        #: Place in its item and width of the window of each test suffix.
        self.place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        self.width = np.minimum(length[item], window)
        self.depth = max(1, min(window, int(length.max(initial=1))))
        self.least = int(self.width.min(initial=window))
        self.ids = np.zeros((len(item), self.depth), ">u4")
        where = words.first[item] + self.place
        for j in range(self.depth):
            on = length[item] - self.place > j
            self.ids[on, j] = ids[where[on] + j] + 1

    def prefix(self, fill: int) -> np.ndarray:
        out = self.ids.copy()
        out[np.arange(self.depth) >= self.width[:, None]] = fill
        return _keys(out)


def _differ(words: Words, at: np.ndarray, block: Block, ids: np.ndarray) -> np.ndarray:
    """Which of the words at places `at` are spelled unlike the vocabulary's words `ids`."""
    n = words.end[at] - words.start[at]
    out = n != block.size[ids]
    same = np.flatnonzero(~out)
    if len(same):
        n, at, ids = n[same], at[same], ids[same]
        unlike = LOWER[words.data[_spans(words.start[at], n)]] != block.bytes[_spans(block.begin[ids], n)]
        out[same] = np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    return out


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    rows = np.ascontiguousarray(rows, ">u4")
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def numbered(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The benchmark's numbers of the words, 0 for others and after each text; and where each text begins there."""
    n = len(words.hash)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out = np.zeros(n + len(words.first), np.uint32)
    if n and len(block.vocabulary):
        at = np.minimum(np.searchsorted(block.vocabulary, words.hash), len(block.vocabulary) - 1)
        out[np.arange(n) + doc] = np.where(block.vocabulary[at] == words.hash, at + 1, 0)
    return out, words.first + np.arange(len(words.first))


def search(words: Words, block: Block):
    """(window, place in `numbered`) of every occurrence; ids; where each text begins."""
    ids, first = numbered(words, block)
    none = np.zeros(0, np.int64)
    if len(block.item) == 0 or not ids.any():
        return none, none, ids, first
    stops = np.flatnonzero(ids == 0)
    nextstop = stops[np.searchsorted(stops, np.arange(len(ids)))]
    suffix = np.flatnonzero(nextstop - np.arange(len(ids)) >= block.least)
    low, high = block.prefix(0), block.prefix(0xFFFFFFFF)
    found, places = [], []
    step = max(64, SUFFIXES // block.depth)
    for a in range(0, len(suffix), step):
        at = suffix[a : a + step]
        reach = at[:, None] + np.arange(block.depth)
        rows = np.where(reach < nextstop[at][:, None], ids[np.minimum(reach, len(ids) - 1)], 0)
        keys = _keys(rows)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
        n = hi - lo
        w = np.repeat(np.arange(len(n)), n)
        found.append(w)
        places.append(at[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(w))]])
    return np.concatenate(found) if found else none, np.concatenate(places) if places else none, ids, first


def matches(words: Words, block: Block) -> list[tuple]:
    """For each text: its number, hit words, and longest matches (item, place in the item, place in the text, words)."""
    window, place, ids, first = search(words, block)
    if len(window) == 0:
        return []
    width = block.width[window]
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, place, 1)
    np.add.at(mark, place + width, -1)
    hit = np.cumsum(mark[:-1]) > 0
    doc_of = np.searchsorted(first, np.flatnonzero(hit), "right") - 1
    word_at = np.flatnonzero(hit) - doc_of  # a stop stands after each text
    unlike = _differ(words, word_at, block, ids[hit].astype(np.int64) - 1)
    if unlike.any():  # two words of one hash
        words.hash[word_at[unlike]] ^= np.uint64(1)
        return matches(words, block)
    doc = np.searchsorted(first, place, "right") - 1
    item, start = block.item[window], block.place[window]
    # Windows one word apart in item and text lie on a diagonal; their runs are the verbatim matches.
    diagonal = place - start
    order = np.lexsort((place, diagonal, item))
    item, start, place, width, doc, diagonal = (x[order] for x in (item, start, place, width, doc, diagonal))
    new = np.ones(len(item), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(place) != 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(item)) - 1
    length = place[end] + width[end] - place[begin]
    n_hit = np.bincount(doc_of, minlength=len(first))
    out: dict[int, tuple] = {}
    for b, n in zip(begin.tolist(), length.tolist(), strict=True):
        d = int(doc[b])
        out.setdefault(d, (d, int(n_hit[d]), []))[2].append((int(item[b]), int(start[b]), int(place[b] - first[d]), n))
    return list(out.values())


def blocks(benchmark: DataFrame, window: int, block: int):
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= block:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


SPAN = "array<struct<item_id:string,item_word:long,doc_word:long,length:long>>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = 4_000_000, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Appends n_words, n_hit and matches (SPAN: verbatim matches of at least a window), and tells the columns' names.

    `keep`: which columns to keep (all, if None); `text` is read.
    """
    kept = docs.columns if keep is None else keep
    names = {k: common.fresh(docs, k) for k in ("n_words", "n_hit", "matches")}
    item_type = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())]))
    spark, hits = docs.sparkSession, common.fresh(docs, "hit_ranges")
    common.ship(spark)
    fields = [common.field(names["n_words"], "long"), common.field(names["matches"], SPAN), common.field(hits, "array<struct<a:long,b:long>>")]
    range_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    df, carried = docs, [*dict.fromkeys([*kept, "text"])]

    def step(shared, old: bool):
        def make():
            block = shared.value

            def fn(batch):
                words = Words(common.text_of(batch), ALNUM)
                found = [[] for _ in range(batch.num_rows)] if not old else batch.column(batch.schema.get_field_index(names["matches"])).to_pylist()
                ranges = [[] for _ in range(batch.num_rows)] if not old else batch.column(batch.schema.get_field_index(hits)).to_pylist()
                for d, _, ms in matches(words, block) if block else ():
                    found[d] = found[d] + [{"item_id": block.names[i], "item_word": p, "doc_word": w, "length": n} for i, p, w, n in ms]
                    ranges[d] = _union(ranges[d] + [{"a": w, "b": w + n} for _, _, w, n in ms])
                return [pa.array(np.diff(words.first), pa.int64()), pa.array(found, item_type), pa.array(ranges, range_type)]

            return fn

        return make

    some = False
    for b in blocks(benchmark, window, block):
        df = common.map_arrow(df, step(spark.sparkContext.broadcast(b), some), fields, carried)
        some = True
    if not some:
        df = common.map_arrow(df, step(spark.sparkContext.broadcast(None), False), fields, carried)
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return df.select(*kept, names["n_words"], n_hit.alias(names["n_hit"]), names["matches"]), names


def _union(ranges: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in sorted(ranges, key=lambda r: r["a"]):
        if out and r["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], r["b"])
        else:
            out.append(dict(r))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of which no word is hit, with their own columns."""
    df, names = find(docs, benchmark, **options)
    return df.where(F.col(names["n_hit"]) == 0).select(*docs.columns)
