"""Line deduplication by content-defined chunks (operator 9), with DataFrame functions only.

A text's lines are hashed, a rolling hash over each two neighbouring line hashes says where a chunk ends (one place in
`every`), so equal runs of lines are cut alike wherever they stand. A chunk of two lines or more with words that comes
again anywhere is removed from all places but the first (by doc_id, text hash, place). Which chunks come again is
found from (hash, place) alone; the texts of those chunks are then compared byte by byte, and chunks whose hashes only
collide are told apart.

`chunks_of` keeps a passage's lines before its first and after its last shared boundary. `pairs_of` has a boundary
behind each worded line and joins each two neighbouring one-line chunks, so that candidates overlap and every passage of
two worded lines or more is made of them: all its lines are removed from all places but the first. Of a line that
stands three times or more in a row, two are left where the run comes first.

Null text: stays null. Empty text: no chunk. Very long texts: time in proportion to their lines, in memory of one text.
Rows that are equal in doc_id and text share their decisions. Null doc_id: first in order; ties in doc_id: by the text's
hash. Other columns go through; those that clash with the new ones' names stay, the new names are told. Empty table:
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


_WORDED = r"[^\x20\x09-\x0D]"


def chunks_of(lines: Column, every: int, bits: int) -> Column:
    """Chunks of an array of lines: hash, first (from 1), n (lines), worded (lines with words)."""
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    n = F.size(lines)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(F.xxhash64(F.get(hashes, i - 2), F.get(hashes, i - 1)), F.lit(every)) == 0))
    begins = F.concat(F.array(F.lit(1)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))

    def chunk(a, b):
        own = F.slice(lines, a, b - a + 1)
        worded = F.size(F.filter(own, lambda x: x.rlike(_WORDED)))
        return F.struct(F.pmod(F.xxhash64(own), F.lit(1 << bits)).alias("hash"), a.alias("first"), (b - a + 1).alias("n"), worded.alias("worded"), F.lit(False).alias("twin"))

    return F.zip_with(begins, ends, chunk)


def pairs_of(lines: Column, every: int, bits: int) -> Column:
    """Each two neighbouring worded lines, with the blank ones between them, as chunks; twin: the two are equal."""
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).rlike(_WORDED))

    # Slices, as a lambda that reads `at` would find it again for each line.
    def pair(a, b):
        own = F.slice(lines, a, b - a + 1)
        return F.struct(F.pmod(F.xxhash64(own), F.lit(1 << bits)).alias("hash"), a.alias("first"), (b - a + 1).alias("n"), F.lit(2).alias("worded"), (F.get(lines, a - 1) == F.get(lines, b - 1)).alias("twin"))

    rest = F.greatest(F.size(at) - 1, F.lit(0))
    return F.zip_with(F.slice(at, F.lit(1), rest), F.slice(at, F.lit(2), rest), pair)


def dedup_lines(docs: DataFrame, every: int = 3, bits: int = 62, candidates=chunks_of) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the remaining text, and how many lines it had and lost; tells these two columns' names."""
    names = {k: common.fresh(docs, k) for k in ("n_lines", "n_removed")}
    th, lines, marks = (common.fresh(docs, k) for k in ("chunk_text_hash", "chunk_lines", "chunk_marks"))
    key = [F.col("doc_id"), F.xxhash64("text").alias("th")]
    cut = docs.select("doc_id", "text").where(F.length("text") > 0).select(*key, _lines(F.col("text")).alias("lines"))
    cut = cut.select("doc_id", "th", F.explode(candidates(F.col("lines"), every, bits)).alias("c")).where("c.worded >= 2")
    narrow = common.stage(cut.select("doc_id", "th", "c.hash", "c.first", "c.n", "c.twin"), "chunks")
    place = F.struct("doc_id", "th", "first")
    # Staged, so that the join below deals both sides anew and Spark splits a hash that stands in many texts.
    again = common.stage(narrow.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("kept")).where("times > 1").drop("times"), "again")
    occurs = narrow.join(again, "hash").select("doc_id", "th", F.struct("first", "n", "hash", "twin", F.col("kept").eqNullSafe(place).alias("keep")).alias("m"))
    marked = occurs.groupBy("doc_id", "th").agg(F.collect_set("m").alias(marks)).select(F.col("doc_id").alias("chunk_doc"), F.col("th").alias("chunk_th"), marks)
    rows = docs.withColumn(th, F.xxhash64("text"))
    on = rows["doc_id"].eqNullSafe(marked["chunk_doc"]) & (rows[th] == marked["chunk_th"])
    rows = common.stage(rows.join(marked, on, "left").drop("chunk_doc", "chunk_th"), "marked")
    pieces = rows.where(F.col(marks).isNotNull()).select("doc_id", F.col(th).alias("th"), _lines(F.col("text")).alias("lines"), F.explode(marks).alias("m"))
    pieces = pieces.select("doc_id", "th", "m.hash", "m.first", F.array_join(F.slice("lines", F.col("m.first"), F.col("m.n")), "\n").alias("chunk"))
    collide = common.stage(pieces.select("hash", "chunk").distinct().groupBy("hash").count().where("count > 1").select("hash"), "collide")
    if not collide.isEmpty():
        rows = _tell_apart(rows, pieces.join(collide, "hash"), th, marks)
    gone = F.filter(marks, lambda m: ~m["keep"])
    # A twin that begins on the last line of the first, kept twin leaves that line.
    last = F.transform(F.filter(marks, lambda m: m["keep"] & m["twin"]), lambda m: F.struct((m["first"] + m["n"] - 1).alias("at"), m["hash"].alias("hash")))
    begin = lambda m, l: m["first"] + F.when(m["twin"] & F.array_contains(l, F.struct(m["first"].alias("at"), m["hash"].alias("hash"))), 1).otherwise(0)  # noqa: E731, E741
    drop = F.transform(F.array(last), lambda l: F.flatten(F.transform(gone, lambda m: F.sequence(begin(m, l), m["first"] + m["n"] - 1))))
    drop = F.array_distinct(F.coalesce(F.get(drop, F.lit(0)), F.array().cast("array<int>")))
    rows = rows.withColumn(lines, _lines(F.col("text"))).withColumn(marks, drop)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), marks), lambda i: F.get(lines, i - 1)), "\n")
    lost = F.size(marks).cast("long")
    text = F.when(F.size(marks) > 0, left).otherwise(F.col("text")).alias("text")
    counts = [F.when(F.length("text") > 0, F.size(lines)).otherwise(0).cast("long").alias(names["n_lines"]), lost.alias(names["n_removed"])]
    return rows.select(*(text if c == "text" else c for c in docs.columns), *counts), names


def _tell_apart(rows: DataFrame, pieces: DataFrame, th: str, marks: str) -> DataFrame:
    """Decides again about chunks whose hashes collide, each by its own text."""
    place = F.struct("doc_id", "th", "first")
    first = pieces.groupBy("hash", "chunk").agg(F.min(place).alias("kept"))
    again = pieces.join(first, ["hash", "chunk"]).where(F.col("kept").eqNullSafe(place))
    keep = again.groupBy(F.col("doc_id").alias("chunk_doc"), F.col("th").alias("chunk_th")).agg(F.collect_set("first").alias("chunk_keep"))
    on = rows["doc_id"].eqNullSafe(keep["chunk_doc"]) & (rows[th] == keep["chunk_th"])
    kept = F.coalesce("chunk_keep", F.array().cast("array<int>"))
    fixed = F.transform(marks, lambda m: F.struct(m["first"], m["n"], m["hash"], m["twin"], (m["keep"] | F.array_contains(kept, m["first"])).alias("keep")))
    return rows.join(keep, on, "left").withColumn(marks, fixed).drop("chunk_doc", "chunk_th", "chunk_keep")


def counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, made that of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
