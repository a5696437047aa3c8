"""Packing by multiway Karmarkar-Karp differencing (operator 3).

Texts become ids; an id list longer than a sequence gives full sequences, and the rest of each, a whole text where it is
no longer than a sequence, is packed in groups of about `group` sequences: every piece is a partition into k windows of
which one is filled, the two partitions with the largest imbalance are merged again and again, the fullest windows of
one with the emptiest of the other, until one partition is left: k near-equal windows. k is the least that could hold the
ids and rises while windows exceed their capacity by more than `spare` of the group's ids. What is over then is cut off
the windows' largest pieces and fills the emptiest windows, so few texts are cut. Groups are formed as rows pass by, so
nothing is shuffled and memory is bounded by a group.

Null or empty text: one piece that holds the end id. Very long texts: mostly full sequences. Repeated rows, doc_ids and
null doc_ids are packed one by one. Equal sizes: in order of arrival. Empty table: empty result. Any other column is not
read. A sequence's padding (up to `length`, none at a power of two) isn't stored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, of each size, by Karmarkar and Karp's differencing."""
    if k == 1 or len(sizes) == 0:
        return np.zeros(len(sizes), np.int64)
    nodes: list[tuple] = []
    heap = []
    for i, s in enumerate(sizes):
        nodes.append((i,))
        heap.append((-int(s), i, np.array([s], np.int64)))  # sums of the windows that aren't empty, the largest first
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        if len(x) + len(y) <= k:
            sums = np.concatenate([x, y])
        else:
            sums = np.zeros(k, np.int64)
            sums[: len(x)] = x
            sums[k - len(y) :] += y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        nodes.append((a, b, len(x), len(y), order))
        heapq.heappush(heap, (int((sums[-1] if len(sums) == k else 0) - sums[0]), len(nodes) - 1, sums))
    out = np.zeros(len(sizes), np.int64)
    todo = [(len(nodes) - 1, np.arange(len(heap[0][2])))]
    while todo:
        at, windows = todo.pop()
        if len(nodes[at]) == 1:
            out[nodes[at][0]] = windows[0]
            continue
        a, b, n, m, order = nodes[at]
        slots = np.empty(len(order), np.int64)
        slots[order] = windows
        todo += [(a, slots[:n]), (b, slots[n:] if n + m == len(order) <= k and n + m <= k else slots[k - m :][::-1])]
    return out


def windows(sizes: np.ndarray, capacity: int, spare: float = 0.0) -> tuple[np.ndarray, int]:
    """The window of each size and their count, the least tried of which at most `spare` of all is over the capacities."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, k)
        over = np.maximum(np.bincount(at, sizes, k) - capacity, 0).sum()
        if over <= spare * sizes.sum():
            return at, k
        k = min(len(sizes), k + max(1, int(over) // capacity))


def settled(rows: list[tuple], at: np.ndarray, k: int, capacity: int, width: int) -> list[tuple]:
    """(piece, window): what is over a window's capacity is cut off its largest pieces and put where most room is.

    A piece: doc_id, start, length, doc_tokens, ids.
    """
    fill = np.bincount(at, [r[2] for r in rows], k).astype(np.int64)
    part = lambda row, a, n: (row[0], row[1] + a, n, row[3], row[4][a * width : (a + n) * width])
    out, tails = [], []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][2], i)):
        row, w = rows[i], int(at[i])
        n = int(min(max(fill[w] - capacity, 0), row[2]))
        if n:
            fill[w] -= n
            tails.append(part(row, row[2] - n, n))
        if n < row[2]:
            out.append((part(row, 0, row[2] - n) if n else row, w))
    for row in sorted(tails, key=lambda r: -r[2]):
        done = 0
        while done < row[2]:
            w = int(fill.argmin())
            n = int(min(row[2] - done, capacity - fill[w]))
            out.append((part(row, done, n), w))
            fill[w] += n
            done += n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, group: int = 96, spare: float = 0.005, ordinary: bool = False) -> DataFrame:
    """A row for each piece (SCHEMA): ids as packed integers of `tokens.id_type`; ordinary: see `tokens`."""
    common.ship(docs.sparkSession)
    dtype = tokens.id_type(tokenizer)
    width = np.dtype(dtype).itemsize
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def run(batches):
        encode, end = tokens.encoder(tokenizer, dtype, ordinary), np.array([end_id], dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 32
        rest, held = [], 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def close(rows, sequence):
            at, k = windows(np.array([r[2] for r in rows]), length, spare)
            fill = [0] * k
            done = []
            for row, w in settled(rows, at, k, length, width):
                done.append((*row[:4], sequence + w, fill[w], row[4]))
                fill[w] += row[2]
            return sorted(done, key=lambda r: r[4:6]), sequence + k

        for batch in batches:
            for part in common.pieces(batch, 1 << 20):
                full = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode.packed(common.text_of(part).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // width
                    cut = n // length * length
                    for at in range(0, cut, length):
                        full.append((doc_id, at, length, n, sequence, 0, ids[at * width : (at + length) * width]))
                        sequence += 1
                    if cut < n:
                        rest.append((doc_id, cut, n - cut, n, ids[cut * width :]))
                        held += n - cut
                        if held >= (group - 1) * length:
                            rows, sequence = close(rest, sequence)
                            yield out(rows)
                            rest, held = [], 0
                if full:
                    yield out(full)
        if rest:
            yield out(close(rest, sequence)[0])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)


def digest(packed: DataFrame, tokenizer: str) -> DataFrame:
    """Replaces the ids by their unsigned crc32 as 32-bit integers."""
    dtype = tokens.id_type(tokenizer)
    kept = [c for c in packed.columns if c != "ids"]

    def make():
        def crc(batch):
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            return [pa.array([zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in ids], pa.int64())]

        return crc

    return common.map_arrow(packed, make, [common.field("ids_crc32", "long")], kept)
