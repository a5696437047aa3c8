"""Operators 1, 3, 6, 9 and 10 against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rankloom.llm import decontaminate, line_chunks, packing, quality, token_files
from rankloom.llm.queries import op6_decontaminate, op9_line_chunks, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_words string"
ODD = [
    (1, None, "a", "x"),
    (2, "", "a", None),
    (3, "  \n ", None, "x"),
    (4, "a b c d e f g h i j k l a b c d e f g", "a", "x"),
    (4, "a b c d e f g h i j k l a b c d e f g", "a", "x"),
    (None, "one two three four five six seven eight nine ten", "b", "x"),
    (6, "w" * 200_000, "b", "x"),
    (7, "é ü—ß 12,5 <b> $$$\n\nsame line\nsame line\n \nsame line", "b", "x"),
    (8, "x y " * 4000, "b", "x"),
    (9, "<|endoftext|> a  b \n c　d e don't ퟿𝔘", "c", "x"),
]


def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    return [(r[0], r[1], r[2], "x") for r in docs] + [(None if i is None else 10_000 + i, *rest) for i, *rest in ODD]


@lru_cache
def plain(path):
    return Tokenizer.from_file(path)


def ids_of(path, text, end):
    return plain(path).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path):
    path, data = tokenizer_path("byte_bpe_50k.json"), rows(spark)
    manifest = token_files.write_token_files(spark.createDataFrame(data, SCHEMA).repartition(5), f"file://{tmp_path}/ids", path, length=64, rows=3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()))
    start, want = 0, []
    for i, t, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(path, t, 0)
        want.append((i is not None, i or 0, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    first = min(manifest.collect(), key=lambda r: r.shard)
    file = token_files.TokenFile(first.path)
    ids, mask = zip(*(file.sequence(k) for k in range(first.n_sequences)), strict=True)
    mask = [m.to_numpy(zero_copy_only=False) for m in mask]
    assert {len(x) for x in ids} == {64} and np.concatenate(mask).sum() == first.n_tokens
    assert np.concatenate(mask)[: first.n_tokens].all()
    before = pa.total_allocated_bytes()
    views = [file.sequence(k) for k in range(first.n_sequences)]
    assert pa.total_allocated_bytes() == before and all(not x.flags.owndata for x, _ in views)


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    manifest = token_files.write_token_files(empty, f"file://{tmp_path}/none", tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read_token_files(manifest).count() == 0


def test_packing(spark):
    path, data = tokenizer_path("word_bpe_49k.json"), rows(spark)
    packed = packing.digest(packing.pack(spark.createDataFrame(data, SCHEMA).coalesce(1), path), path).collect()
    want = Counter()
    for i, t, *_ in data:
        ids = ids_of(path, t, 1)
        want[i, len(ids)] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, t, *_ in data:
        ids = ids_of(path, t, 1)
        own = sorted(set(pieces[i, len(ids)]))
        assert sum(n for _, n, _ in own) == len(ids) and [crc(ids[a : a + n]) for a, n, _ in own] == [c for *_, c in own]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in packed)
    assert total / (2048 * len(sequences)) > 0.95
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_packing_keeps_texts_whole():
    """Only what is over a capacity is cut, and the pieces are those of the texts."""
    r = np.random.default_rng(8)
    rows = [(i, 0, int(n), int(n), bytes(r.integers(0, 256, 2 * n, np.uint8))) for i, n in enumerate(np.minimum(r.lognormal(6.3, 0.9, 300).astype(int) + 1, 2047))]
    sizes = np.array([x[2] for x in rows])
    at, k = packing.windows(sizes, 2048, 0.005)
    out = packing.settled(rows, at, k, 2048, 2)
    fill = np.bincount([w for _, w in out], [x[2] for x, _ in out], k)
    assert fill.max() <= 2048 and sizes.sum() / (2048 * k) > 0.97
    whole = defaultdict(bytes)
    for (i, start, n, total, ids), _ in sorted(out, key=lambda x: x[0][:2]):
        assert len(whole[i]) == 2 * start and len(ids) == 2 * n and total == sizes[i]
        whole[i] += ids
    assert [whole[i] for i in range(300)] == [x[4] for x in rows]
    assert len(out) - len(rows) < 60
    at, k = packing.windows(sizes, 2048)
    assert np.bincount(at, sizes, k).max() <= 2048


@pytest.mark.parametrize("k", [1, 2, 5, 17])
def test_differencing_is_near_equal(k):
    sizes = np.random.default_rng(k).integers(1, 300, 400)
    sums = np.bincount(packing.difference(sizes, k), sizes, k)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 3


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items):
    """(n_words, n_hit, items) of each text, window by window."""
    grams = defaultdict(set)
    for name, text in items:
        w = lowered(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            grams[tuple(w[k : k + 10])].add(name)
    out = []
    for _, text, *_ in docs:
        w, hit, found = lowered(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= g
        out.append((len(w), len(hit), ",".join(sorted(found))))
    return out


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_decontaminate(spark, block):
    data = rows(spark)
    items = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [("900", None), ("901", ""), ("902", "SAME line"), ("903", items[3][1]), ("904", "é"), ("905", "x y " * 30)]
    data.append((77_777, "before " + items[3][1] + " after", "a", "x"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    df, names = decontaminate.find(spark.createDataFrame(data, SCHEMA), bench, block=block)
    got = Counter((r.doc_id, r[names["n_words"]], r[names["n_hit"]], ",".join(sorted({m.item_id for m in r[names["matches"]]}))) for r in df.collect())
    assert names["n_words"] == "n_words_" and df.columns[:4] == ["doc_id", "text", "source", "n_words"]
    assert got == Counter((d[0], *c) for d, c in zip(data, contaminated(data, items), strict=True))
    longest = max(m.length for r in df.where("doc_id = 77777").collect() for m in r.matches if m.item_id == "903")
    assert longest == len(lowered(items[3][1]))
    assert decontaminate.find(spark.createDataFrame([], SCHEMA), bench)[0].count() == 0
    assert decontaminate.decontaminate(spark.createDataFrame(data, SCHEMA), bench.limit(0)).count() == len(data)


def test_very_long_item():
    """An item of 200,000 words takes memory in proportion, and its longest match is found."""
    import tracemalloc

    from rankloom.llm.words import ALNUM, Words

    r = np.random.default_rng(2)
    words = [f"w{i}" for i in r.integers(0, 5000, 200_000)]
    texts = ["before " + " ".join(words[50_000:120_000]) + " after", "nothing of it", " ".join(words[:9])]
    tracemalloc.start()
    block = decontaminate.Block([("long", " ".join(words)), ("short", "after")], 10)
    found = decontaminate.matches(Words(pa.array(texts), ALNUM), block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, n) for d, n, _ in found] == [(0, 70_001)] and max(found[0][2], key=lambda m: m[3]) == (0, 50_000, 1, 70_000)
    assert peak < 1 << 30


def test_words_of_one_hash():
    """Words that only share a hash aren't hits."""
    from rankloom.llm.words import ALNUM, Words

    block = decontaminate.Block([("a", "one two")], 10)
    words = Words(pa.array(["one two", "six two", "seven two"]), ALNUM)
    words.hash[[2, 4]] = words.hash[0]
    assert [(d, n) for d, n, _ in decontaminate.matches(words, block)] == [(0, 2)]


def test_decontaminate_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in op6_decontaminate(spark, SF).collect()}
    assert got == {d[0]: (n, h, hashlib.sha256(x.encode()).hexdigest(), h > 0) for d, (n, h, x) in zip(docs, contaminated(docs, items), strict=True)}


def measures(text):
    text = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", text) if x]
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    data = rows(spark)
    df, names = quality.apply_rules(spark.createDataFrame(data, SCHEMA))
    got = Counter((r.doc_id, *(r[names[k]] for k in quality.MEASURES), r[names["base_failed"]]) for r in df.collect())
    want = Counter()
    for i, t, *_ in data:
        m = measures(t)
        want[(i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want
    assert quality.apply_rules(spark.createDataFrame([], SCHEMA))[0].count() == 0


GOOD = "these are ten different words that make up one text"


def test_bad_hosts_lose_all_their_texts(spark):
    data = [(i, "junk" if i % 20 else GOOD, "bad", "") for i in range(200)] + [(1000 + i, GOOD, f"s{i % 9}", "") for i in range(300)]
    df, names = quality.apply_rules(spark.createDataFrame([(i, t, s) for i, t, s, _ in data], "doc_id long, text string, source string"))
    assert {r.source for r in df.where(names["kept"]).collect()} == {f"s{i}" for i in range(9)}
    assert df.where(names["kept"]).count() == 300


def test_suspect_hosts_and_equal_hosts(spark, tmp_path):
    """Real texts and sources, and one more source of many symbols: its failing texts go, its others stay; as in the SQL."""
    import duckdb

    from rankloom.llm.queries import SQL, op10_quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(100_000 + i, GOOD + (" " + "$%" * 20 if i % 4 == 0 else f" {i}"), "en", "noisy", 0) for i in range(400)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op10_quality(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(SQL["op10_quality"]).fetchall())
    turned = {r[0] for r in got if not r[6] and not r[7]}
    assert turned == {i for i, t, *_ in odd if "$" in t and not next(r[6] for r in got if r[0] == i)} and turned
    assert op10_quality(spark, "/root/testdata/sf0.01").where("kept = base_failed").count() == 0


LINES = ["alpha one two three", "beta four five", "gamma six", "delta seven eight nine", "epsilon ten", "zeta eleven twelve"]


def own_lines(i):
    return [f"own line {i} {k} only here" for k in range(4)]


@pytest.mark.parametrize("bits", [62, 2])
def test_line_chunks(spark, bits):
    """Against first-come removal in Python, chunk texts compared; 2 bits make most hashes collide."""
    from pyspark.sql import functions as F

    shared = [f"shared passage line number {k} of many words" for k in range(30)]
    data = [(i, "\n".join([*own_lines(i), *shared, *own_lines(i + 100)]), "s", "x") for i in range(6)]
    data += [(50, None, "s", "x"), (51, "", "s", "x"), (52, "\n\n\n", "s", "x"), (53, "\n".join(own_lines(53)), "s", "x"), (None, "a\nb", "s", "x")]
    docs = spark.createDataFrame(data, SCHEMA).cache()
    seen, want, chunked = set(), {}, {}
    for r in docs.where("length(text) > 0").select("doc_id", line_chunks.chunks_of(F.split("text", "\n", -1), 3, bits).alias("cs")).collect():
        chunked[r.doc_id] = r.cs
    for i, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, out = (text or "").split("\n"), []
        for c in chunked.get(i, ()):
            own = lines[c["first"] - 1 : c["first"] - 1 + c["n"]]
            if c["worded"] < 2 or "\n".join(own) not in seen:
                out += own
            if c["worded"] >= 2:
                seen.add("\n".join(own))
        want[i] = (text if not text else "\n".join(out), (len(lines) if text else 0), len(lines) - len(out) if text else 0)
    df, names = line_chunks.dedup_lines(docs, bits=bits)
    assert df.columns[:4] == ["doc_id", "text", "source", "n_words"]
    got = {r.doc_id: (r.text, r[names["n_lines"]], r[names["n_removed"]]) for r in df.collect()}
    assert got == want
    assert all(want[i][2] >= 15 for i in range(1, 6)) and want[0][2] == 0
    assert line_chunks.dedup_lines(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_line_chunks_shift_resistant(spark):
    """A run of lines is cut alike behind any number of other lines."""
    from pyspark.sql import functions as F

    run = [f"line {k}" for k in range(40)]
    data = [(i, [f"x{i}{j}" for j in range(i)] + run) for i in range(5)]
    df = spark.createDataFrame(data, "i int, lines array<string>").select("i", F.explode(line_chunks.chunks_of(F.col("lines"), 3, 62)).alias("c"))
    hashes = defaultdict(set)
    for r in df.collect():
        hashes[r.i].add(r.c["hash"])
    assert len(set.intersection(*hashes.values())) >= len(hashes[0]) - 1


def without_passages(data):
    """{doc_id: (text left, lines removed)}: passages of two worded lines or more that stood before go."""
    seen, want = {}, {}
    for i, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        at, gone = [j for j, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")], set()
        for a, b in zip(at, at[1:]):
            first = seen.setdefault("\n".join(lines[a : b + 1]), (i, a, b))
            if first != (i, a, b):
                gone |= set(range(a + (first[0] == i and first[2] == a), b + 1))
        want[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone) if text else text, len(gone)
    return want


@pytest.mark.parametrize("bits", [62, 4])
def test_every_repeated_passage_goes(spark, bits):
    """Passages of two lines and more between different neighbours: all lines, against first-come removal in Python."""
    data, wanted = [], []
    for k in (2, 3, 4, 6, 10, 20):
        for n in range(5):
            shared = [f"passage {k} {n} line {j} with ten words or so in it all" for j in range(k)]
            if n == 4:
                shared.insert(1, " ")
            wanted += shared
            for copy in range(2):
                i = 1000 * copy + 10 * k + n
                data.append((i, "\n".join([*own_lines(i), *shared, *own_lines(i + 5000)]), "s", "x"))
    data += [(3000, "r\nr\nr\nr", "s", "x"), (3001, "q\nr\nr\nr", "s", "x"), (3002, "u\nv\nu\nv", "s", "x"), (3003, "one line\n\n", "s", "x"), (3004, "one line", "s", "x"), (3005, None, "s", "x"), (3006, "", "s", "x"), (None, "u\nw", "s", "x"), (3007, "x\nu\nw", "s", "x")]
    want = without_passages(data)
    df, names = line_chunks.dedup_lines(spark.createDataFrame(data, SCHEMA), bits=bits, candidates=line_chunks.pairs_of)
    got = {r.doc_id: (r.text, r[names["n_removed"]]) for r in df.collect()}
    assert got == want
    assert Counter(x for t, _ in got.values() for x in (t or "").split("\n") if x.startswith("passage")) == Counter(x for x in wanted if x != " ")
    assert got[3000][0] == "r\nr" and got[3001][0] == "q" and got[3002][0] == "u\nv" and got[3007][0] == "x"


def test_line_query_removes_short_passages(spark, tmp_path):
    data = [(i, "\n".join([f"own {i}", "first shared line", "second shared line", f"own too {i}"])) for i in range(30)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in op9_line_chunks(spark, str(tmp_path)).collect()}
    assert got == {i: (4, 2 if i else 0) for i in range(30)}
