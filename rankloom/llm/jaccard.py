"""N-gram Jaccard join with several global token orders (operator 7).

A text is the set of its word shingles, held as 64-bit hashes. Texts of equal sets are one node. If the sets x and y
have |x & y| >= t |x | y|, then under any total order of all shingles their prefixes of |x| - ceil(t |x|) + 1 shingles
share one, and the first they share leaves enough after it in both. A pair is verified only if it shares prefix
shingles under each of three orders.

Orders: by how common a shingle is, then by a hash of its own for each order. How common: all shingles of all rows are
counted by the first 32 bits of their hashes, each range of these in a task; of each run of 256 neighbours the largest
count, as a power of two, and of each run of 32 whether any comes twice is told to the executors: 2 ** 25 bytes, at
every size. Any order gives the same links; this one keeps common passages out of prefixes, the less the more different
shingles fall into each run. A shingle in whose run of 32 none comes twice has no partner, and isn't shuffled. Prefix
shingles are shuffled once, and a node goes on only with those that it shares with a node of a size that fits; what no
later step reads is deleted at once.

Nodes that share a prefix shingle of the first order are a bucket. A bucket is compared in blocks: some of its nodes,
the left ones, meet all of its nodes, each block of left ones with each block of all in a step of its own, of bounded
size. There the prefixes of the second and the third order are intersected, and what shares both is verified. No pair
is a row: a block gives only as many links as tie what its links tie. Buckets of the same nodes are compared once.
(1) Under three more orders, by hash alone, a prefix of one shingle gives buckets that most near copies of a group
share; PICKS nodes of each are its left ones. That ties large groups in as many comparisons as there are nodes. (2) In
the buckets of the first order's whole prefix, all nodes outside the bucket's largest component are left ones: every
link is found or runs within a component.

Null or empty text, or one without words: n_shingles 0, linked with nothing. Very long texts: one set each, in a block
of its own if it must. Repeated rows are one node. Null doc_id: never a component's id unless it has no other. Empty
table: empty result. Other columns are not read; keep_first gives them back, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import tokens as token_ids
from .components import components
from .words import SOLID, Words, mix, shingles

WORDS = 1 << 20  # of the wanted texts' filter: 16 MB
RANGES = 256  # of the counted hashes; each has 2 ** 24 of them
FLUSH = 4_000_000
PICKS = 8
ROWS, SHINGLES = 1024, 200_000  # of a block
DENSE = 8  # rows of a block that hold a shingle, from which it is a column of a matrix
LEAST = ["m0", "m1", "m2"]
ORDERS = [np.uint64(0x51ED270B35AE1F4D), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]
PIVOTS = [np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)]


def sets(texts: pa.Array, k: int):
    """The sorted shingle hashes of each text."""
    words = Words(texts, SOLID)
    for a, b in zip(words.first, words.first[1:], strict=False):
        yield np.unique(shingles(words.hash[a:b], k))


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    with np.errstate(over="ignore"):
        both = mix(own ^ np.uint64(len(own))).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(own))
    return int(mix(np.array([both]))[0].astype(np.int64))


def level(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[own >> np.uint64(40)]


def prefix_size(n: int, percent: int) -> int:
    """As many first shingles as every linked set must share one of."""
    return n - -(-percent * n // 100) + 1


def ranked(own: np.ndarray, order: int, levels: np.ndarray) -> np.ndarray:
    """A set's shingles under an order."""
    rank = (mix(own ^ ORDERS[order]) >> np.uint64(8)) | (level(own, levels).astype(np.uint64) << np.uint64(56))
    return own[np.argsort(rank, kind="stable")]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _counted(tokens: list[np.ndarray]):
    """(range, counts) of 32-bit hashes: how many there are in each of the range's 256 parts, their low halves, and times."""
    found, times = np.unique(np.concatenate(tokens), return_counts=True)
    edges = np.searchsorted(found, np.arange(1 << 16, dtype=np.uint64) << np.uint64(16))
    edges = np.append(edges, len(found))
    for r in range(RANGES):
        parts = edges[256 * r : 256 * r + 257]
        a, b = parts[0], parts[-1]
        if a < b:
            many = zlib.compress(np.minimum(times[a:b], 65535).astype("<u2").tobytes(), 1)
            yield r, np.diff(parts).astype("<u4").tobytes() + found[a:b].astype("<u2").tobytes() + many


def _add(counts: np.ndarray, data: bytes) -> None:
    parts = np.frombuffer(data, "<u4", 256)
    n = int(parts.sum())
    at = (np.repeat(np.arange(256, dtype=np.uint32), parts) << np.uint32(16)) + np.frombuffer(data, "<u2", n, 1024)
    counts[at] += np.minimum(np.frombuffer(zlib.decompress(data[1024 + 2 * n :]), "<u2"), 65535 - counts[at])


def _measured(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """A row for each text (doc_id, th, n, node, m0 to m2) and the shingles' counts (part, counts), from one pass."""
    common.ship(docs.sparkSession)
    schema = "doc_id long, th long, n long, node long, m0 long, m1 long, m2 long, part int, counts binary"
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        token_ids.release()
        tokens, held = [], 0
        for batch in batches:
            for part in common.pieces(batch):
                rows = []
                for doc_id, th, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets(common.text_of(part), k), strict=True):
                    if len(own) == 0:
                        rows.append((doc_id, th, 0, None, None, None, None, None, None))
                        continue
                    rows.append((doc_id, th, len(own), node_of(own), *(int(mix(own ^ s).min().astype(np.int64)) for s in PIVOTS), None, None))
                    tokens.append((own >> np.uint64(32)).astype(np.uint32))
                    held += len(own)
                yield out(rows)
                if held >= FLUSH:
                    yield from (out([(None,) * 7 + x]) for x in _counted(tokens))
                    tokens, held = [], 0
        if tokens:
            yield from (out([(None,) * 7 + x]) for x in _counted(tokens))

    both = common.stage(_texts(docs).mapInArrow(run, schema), "measured")
    return both.where("part IS NULL").drop("part", "counts"), both.where("part IS NOT NULL").select("part", "counts")


def _levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each run of 256 hashes the largest count's power of two; for each run of 32 a bit: whether any comes twice."""

    def run(batches):
        now, counts = None, None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    if now is not None:
                        yield told(now, counts)
                    now, counts = part, np.zeros(1 << 24, np.uint16)
                _add(counts, data.as_py())
        if now is not None:
            yield told(now, counts)

    def told(part, counts):
        most = counts.reshape(-1, 256).max(1)
        twice = np.packbits(counts.reshape(-1, 32).max(1) > 1, bitorder="little")
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([np.log2(np.maximum(most, 1)).astype(np.uint8).tobytes()]), pa.array([twice.tobytes()])], names=["part", "levels", "twice"])

    ordered = counts.repartition("part").sortWithinPartitions("part")
    out = np.zeros(1 << 24, np.uint8), np.zeros(1 << 24, np.uint8)
    for part, *both in common.stage(ordered.mapInArrow(run, "part int, levels binary, twice binary"), "levels").toLocalIterator():  # RANGES rows of 131,072 bytes
        for whole, own in zip(out, both, strict=True):
            whole[part << 16 : part + 1 << 16] = np.frombuffer(own, np.uint8)
    return out


def comes_twice(own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether shingles, or others of their run of 32, come twice."""
    return bits[own >> np.uint64(40)] >> ((own >> np.uint64(37)) & np.uint64(7)).astype(np.uint8) & 1 > 0


def _prefixes(docs: DataFrame, levels, k: int, percent: int) -> DataFrame:
    """(token, node, n, reach): the prefix of each set under the first order.

    reach: the largest partner for which this can be the first shared shingle, as those before it are not shared.
    """

    def run(batches):
        seen: set[int] = set()  # nodes of this task
        for batch in batches:
            for part in common.pieces(batch):
                tokens, nodes, counts, sizes, reach = [], [], [], [], []
                for own in sets(common.text_of(part), k):
                    if len(own) and (node := node_of(own)) not in seen:
                        seen.add(node)
                        first = ranked(own, 0, levels.value[0])[: prefix_size(len(own), percent)]
                        place = np.flatnonzero(comes_twice(first, levels.value[1]))
                        tokens.append(first[place])
                        reach.append((100 * len(own) - (100 + percent) * place) // percent)
                        nodes.append(node)
                        counts.append(len(tokens[-1]))
                        sizes.append(len(own))
                if tokens:
                    yield pa.record_batch([signed(np.concatenate(tokens)), np.repeat(np.array(nodes, np.int64), counts), np.repeat(np.array(sizes, np.int64), counts), np.concatenate(reach).astype(np.int64)], names=["token", "node", "n", "reach"])

    return docs.select("text").mapInArrow(run, "token long, node long, n long, reach long")


def _shared(posted: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, reach) of the prefixes' rows that may have a partner under their shingle, in one shuffle.

    By size a row's nearest neighbours tell: if the next larger set is beyond reach and the next smaller one too small, all
    others are. Of two rows alone each knows the other, and its reach.
    """
    by_size = Window.partitionBy("token").orderBy("n", "node")
    beside = {f"{side}{k}": f(F.struct("n", "reach"), k).over(by_size) for side, f in (("below", F.lag), ("above", F.lead)) for k in (1, 2)}
    rows = posted.repartition("token").dropDuplicates(["token", "node"]).withColumns(beside)
    two = F.col("below2").isNull() & F.col("above2").isNull() & (F.col("below1").isNull() | F.col("above1").isNull())
    other = F.coalesce("below1", "above1")
    fits = F.when(two, (other["n"] <= F.col("reach")) & (F.col("n") <= other["reach"])).otherwise((100 * F.col("below1.n") >= percent * F.col("n")) | (F.col("above1.n") <= F.col("reach")))
    return rows.where(fits).select(F.col("token").alias("key"), "node", "n", "reach")


def _passed(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Rows (doc_id, text, th) that a Bloom filter of the texts in `few` (rep) lets through: all of those, and of the others
    some two in a hundred (more beyond 4 million wanted texts). Two bits of one 64-bit word for each text; the words, at
    most WORDS of them, are broadcast, so that texts are filtered where they're read, at every size of the input."""
    words = min(WORDS, max(64, few.count() // 4))
    marks = "shiftleft(1L, CAST(_h & 63 AS INT)) | shiftleft(1L, CAST(shiftright(_h, 6) & 63 AS INT))"

    def marked(df: DataFrame, doc_id: str, th: str) -> DataFrame:
        both = df.withColumns({"_word": F.pmod(F.xxhash64(doc_id, th), F.lit(words)), "_h": F.xxhash64(doc_id, th, F.lit(1))})
        return both.withColumn("_marks", F.expr(marks)).drop("_h")

    bits = marked(few, "rep.doc_id", "rep.th").groupBy("_word").agg(F.bit_or("_marks").alias("_bits"))
    met = marked(rows, "doc_id", "th").join(F.broadcast(bits), "_word")  # at most WORDS rows
    return met.where(F.col("_bits").bitwiseAND(F.col("_marks")) == F.col("_marks")).select(*rows.columns)


def _candidates(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, levels, k: int, percent: int) -> DataFrame:
    """(node, n, m0, m1, m2, own, pc): the sets of the wanted nodes, each from one row, in the second order, so that they
    begin with that order's prefix, and their prefixes under the third order. They're shuffled once, by node, and kept in
    buckets by node, so that no join on it moves them again. Equal sets have one node, whichever row they come from."""
    few = common.stage(wanted.join(nodes, "node").select("node", "rep", *LEAST), "wanted")

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch):
                rows = []
                for own in sets(common.text_of(part, "text"), k):
                    if len(own):
                        third = ranked(own, 2, levels.value[0])[: prefix_size(len(own), percent)]
                        rows.append((node_of(own), len(own), ranked(own, 1, levels.value[0]).tobytes(), third.tobytes()))
                if rows:
                    kinds = [pa.int64()] * 2 + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "n", "own", "pc"])

    found = _passed(_texts(docs), few).select("text").mapInArrow(run, "node long, n long, own binary, pc binary")
    return common.stage_by(found.dropDuplicates(["node"]).join(few.drop("rep"), "node"), "sets", "node")


def _overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share: a product of matrices where an element is in many sets, else pair by pair."""
    out = np.zeros((len(left), len(right)), np.int32)
    x, y = np.concatenate(left), np.concatenate(right)
    row, col = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (left, right))
    _, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = at[: len(x)], at[len(x) :]
    n = int(at.max()) + 1
    cp, cq = np.bincount(p, minlength=n), np.bincount(q, minlength=n)
    shared = (cp > 0) & (cq > 0)
    many = np.flatnonzero(shared & (cp + cq > DENSE))
    place = np.full(n, -1)
    place[many] = np.arange(len(many))
    for a in range(0, len(many), 1024):
        sides = []
        for token, line, size in ((p, row, len(left)), (q, col, len(right))):
            on = (place[token] >= a) & (place[token] < a + 1024)
            side = np.zeros((size, min(1024, len(many) - a)), np.float32)
            side[line[on], place[token[on]] - a] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int32)  # counts up to 1,024 are exact
    some = shared & (place < 0)
    on_p, on_q = np.flatnonzero(some[p]), np.flatnonzero(some[q])
    if len(on_p):
        on_p = on_p[np.argsort(p[on_p], kind="stable")]
        times = cp[q[on_q]]
        first = np.searchsorted(p[on_p], q[on_q])
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        pairs = row[on_p[np.repeat(first, times) + step]] * len(right) + np.repeat(col[on_q], times)
        out += np.bincount(pairs, minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def _links(node, n, reach, comp, lefts, rights, own, third, percent: int) -> list[tuple[int, int]]:
    """Links between the left and right rows of a block, as few as tie the same nodes; (node, least node tied to it)."""
    l, r = np.flatnonzero(lefts), np.flatnonzero(rights)  # noqa: E741
    if not len(l) or not len(r):
        return []
    ok = (comp[l][:, None] != comp[r]) & (n[r] <= reach[l][:, None]) & (n[l][:, None] <= reach[r])
    ok &= (percent * n[r] <= 100 * n[l][:, None]) & (percent * n[l][:, None] <= 100 * n[r])
    second = [x[: prefix_size(len(x), percent)] for x in own]
    for prefixes in (second, third):
        if ok.any():
            # Rows without a candidate need no further look.
            l, r, ok = l[ok.any(1)], r[ok.any(0)], ok[ok.any(1)][:, ok.any(0)]  # noqa: E741
            ok &= _overlap([prefixes[i] for i in l], [prefixes[i] for i in r]) > 0
    if not ok.any():
        return []
    l, r, ok = l[ok.any(1)], r[ok.any(0)], ok[ok.any(1)][:, ok.any(0)]  # noqa: E741
    both = _overlap([own[i] for i in l], [own[i] for i in r])
    ok &= (100 + percent) * both.astype(np.int64) >= percent * (n[l][:, None] + n[r])
    label, most = node.copy(), np.iinfo(np.int64).max
    while True:
        before = label.copy()
        label[l] = np.minimum(label[l], np.where(ok, label[r], most).min(1))
        label[r] = np.minimum(label[r], np.where(ok, label[l][:, None], most).min(0))
        if (label == before).all():
            on = label != node
            return list(zip(node[on].tolist(), label[on].tolist(), strict=True))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit numbers of each binary value, without a copy."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [data[a:b].view("<u8") for a, b in zip(at, at[1:], strict=False)]


def _compared(rows: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the left rows and all rows of each bucket; rows: key, node, n, reach, comp, left.

    A bucket's left rows and all its rows are dealt to blocks of at most about ROWS rows and SHINGLES shingles, and each
    block of left rows meets each block of rows in a task of its own.
    """
    count = lambda c, w: F.greatest(F.lit(1), F.ceil(c / ROWS), F.ceil(w / SHINGLES)).cast("int")
    lefts = F.col("left").cast("long")
    sizes = rows.groupBy("key").agg(count(F.sum(lefts), F.sum(lefts * F.col("n"))).alias("nl"), count(F.count(F.lit(1)), F.sum("n")).alias("nr"), F.sum(lefts).alias("some"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    dealt = rows.join(sizes.where("some > 0 AND c0 <> c1").drop("some", "c0", "c1"), "key")
    dealt = dealt.withColumns({"i": F.when(F.col("left"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("nl"))).otherwise(-1).cast("int"), "j": F.pmod(F.xxhash64("node", F.lit(2)), F.col("nr")).cast("int")})
    block = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    as_left = F.when(F.col("left"), F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda b: block(F.col("i"), b)))
    as_right = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda a: block(a, F.col("j")))
    both = F.array_distinct(F.concat(F.coalesce(as_left, F.array().cast("array<struct<a:int,b:int>>")), as_right))
    dealt = dealt.select("key", "node", "n", "reach", "comp", "i", "j", F.explode(both).alias("at"))
    dealt = dealt.select("key", F.col("at.a").alias("a"), F.col("at.b").alias("b"), "node", "n", "reach", "comp", (F.col("i") == F.col("at.a")).alias("l"), (F.col("j") == F.col("at.b")).alias("r"))
    dealt = dealt.join(own.select("node", "own", "pc"), "node").select("key", "a", "b", "node", "n", "reach", "comp", "l", "r", "own", "pc")

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if held is None or held.num_rows == 0:
                continue
            key, a, b, node, n, reach, comp, lefts, rights = (held.column(c).to_numpy(zero_copy_only=False) for c in range(9))
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            edges = [0, *edges.tolist()] + ([held.num_rows] if batch is None else [])
            own, third, found = _arrays(held.column(9)), _arrays(held.column(10)), []
            for x, y in zip(edges, edges[1:], strict=False):
                s = slice(x, y)
                found += _links(node[s], n[s], reach[s], comp[s], lefts[s], rights[s], own[s], third[s], percent)
            if found:
                yield pa.record_batch([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])
            held = held.slice(edges[-1])  # its last block may go on

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long").distinct()


def _signature() -> list:
    """Equal for buckets of the same nodes (and, but for a hash collision, of no others), which are compared once."""
    return [F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", F.lit(3))), F.bit_xor(F.xxhash64("node", F.lit(4)))).alias("same")]


def _merged(rows: DataFrame) -> DataFrame:
    """Buckets of one signature as one; rows: same, node, n, reach, comp, left."""
    rows = rows.groupBy(F.col("same").alias("key"), "node").agg(F.first("n").alias("n"), F.max("reach").alias("reach"), F.first("comp").alias("comp"), F.max("left").alias("left"))
    return common.stage(rows, "buckets")


def _stars(own: DataFrame, percent: int) -> DataFrame:
    """Buckets of nodes with the same first shingle under a hash; PICKS of each, chosen by hashes, are its left rows."""
    rows = own.select("node", "n", F.explode(F.array(*LEAST)).alias("key"))
    picks = F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(10 + i)).alias("h"), "node"))["node"] for i in range(PICKS)))
    some = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), picks.alias("picks"), *_signature()).where("c > 1").drop("c")
    reach = F.floor(100 * F.col("n") / percent).cast("long")
    return _merged(rows.join(some, "key").select("same", "node", "n", reach.alias("reach"), F.col("node").alias("comp"), F.array_contains("picks", F.col("node")).alias("left")))


def _open(posted: DataFrame, tied: DataFrame) -> DataFrame:
    """Buckets of the first order's prefix that hold several components; rows outside the largest of them are left rows."""
    sizes = tied.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    tied = tied.join(sizes, "label")
    tied = tied.unionByName(sizes.select(F.col("label").alias("node"), "label", "size"))
    rows = posted.join(tied, "node", "left").select("key", "node", "n", "reach", F.coalesce("label", "node").alias("comp"), F.coalesce("size", F.lit(0)).alias("size"))
    rows = common.stage(rows, "labelled")
    several = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    rows = common.stage(rows.join(several, "key"), "mixed")
    stats = rows.groupBy("key").agg(*_signature(), F.min("n").alias("least"), F.max("reach").alias("far"), F.max(F.struct("size", "comp"))["comp"].alias("main"))
    # Staged, so that the join deals both sides anew and Spark splits a key that stands in many rows.
    rows = rows.join(common.stage(stats, "stats"), "key").where("reach >= least AND n <= far")  # others have no partner here
    return _merged(rows.select("same", "node", "n", "reach", "comp", (F.col("comp") != F.col("main")).alias("left")))


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, node) of each row, and (node, comp, least): the component of each node, with its least doc_id."""
    spark, since = docs.sparkSession, len(common.staged.made)
    texts, counts = _measured(docs, k)
    first = F.min(F.struct("doc_id", "th")).alias("rep")
    nodes = common.stage(texts.where("n > 0").groupBy("node").agg(first, F.min("doc_id").alias("least"), F.min("n").alias("n"), *(F.min(m).alias(m) for m in LEAST)), "nodes")
    levels = spark.sparkContext.broadcast(_levels(counts))  # 32 MB
    texts = common.stage(texts.select("doc_id", "th", "n", "node"), "texts")
    common.done(spark, since, "measured", "levels")
    posted = common.stage(_shared(_prefixes(docs, levels, k, percent), percent), "shared")
    own = _candidates(docs, nodes, posted.select("node").distinct(), levels, k, percent)
    levels.destroy()  # what needs it has been written
    common.done(spark, since, "wanted")
    tied = components(_compared(_stars(own, percent), own, percent))
    common.done(spark, since, "buckets")
    before = common.staged.made[-1]
    more = _compared(_open(posted, tied), own, percent)
    common.done(spark, since, "shared", "labelled", "mixed", "stats")
    tied = components(more.unionByName(tied.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    common.done(spark, since, "buckets", "sets")
    common.delete(spark, [before])
    common.staged.made.remove(before)
    labelled = nodes.select("node", "least").join(tied, "node", "left").select("node", "least", F.coalesce("label", "node").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("least").alias("least"))
    return texts, labelled.drop("least").join(least, "comp")


def near_copies(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) for each row of `docs` (doc_id, text)."""
    texts, labelled = _grouped(docs, k, percent)
    out = texts.join(labelled, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component, that of its least doc_id (null: last), then text hash; and all rows without a shingle."""
    texts, labelled = _grouped(docs, k, percent)
    rows = texts.where("n > 0").join(labelled, "node")
    own_id, own_th = (common.fresh(docs, c) for c in ("kept_id", "kept_th"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))).alias("f")
    kept = rows.groupBy("comp").agg(first).select(F.col("f.doc_id").alias(own_id), F.col("f.th").alias(own_th))
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    worded = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    on = docs["doc_id"].cast("long").eqNullSafe(kept[own_id]) & (th == kept[own_th])
    chosen = docs.where(worded).join(kept, on).dropDuplicates([own_id, own_th]).select(*docs.columns)
    return chosen.unionByName(docs.where(~worded))
