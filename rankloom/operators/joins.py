"""Joins with labels and key checks that keep evaluation data out of training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attach(left: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """Inner join, one to one, with the label's columns as a struct."""
    nested = labels.select(key, F.struct(*(c for c in labels.columns if c != key)).alias(name))
    return left.join(nested, key)


def attach_or_default(left: DataFrame, labels: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join; where there is no label, constants."""
    return left.join(labels, key, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only one side has ('left' or 'right')."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def partition_proof(parts: dict[str, DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """One row: rows in all parts, distinct keys in them, keys missing and keys foreign."""
    rows = reduce(DataFrame.unionByName, (p.select(key) for p in parts.values()))
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
    diff = key_differences(whole, rows, key).agg(F.count_if(F.col("side") == "left").alias("missing"), F.count_if(F.col("side") == "right").alias("foreign"))
    return n.crossJoin(F.broadcast(diff))  # one row each


def merge_shards(shards: list[DataFrame], manifest: DataFrame, key: str, position: str) -> DataFrame:
    """All shards' rows with their place in the source."""
    return reduce(DataFrame.unionByName, shards).join(manifest.select(key, position), key)


def resume(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, and new ones that aren't among them."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def within_budget(df: DataFrame, order: str, cost: str, budget: float) -> DataFrame:
    """The first rows in order whose costs together stay within a budget.

    The running total of each chunk of `order` is summed first, so only one row for each chunk meets in one task.
    """
    from pyspark.sql import Window

    chunk = df.withColumn("chunk", F.floor(F.col(order) / 4096))
    sums = chunk.groupBy("chunk").agg(F.sum(cost).alias("chunk_cost"))
    before = sums.withColumn("carried", F.coalesce(F.sum("chunk_cost").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum(cost).over(Window.partitionBy("chunk").orderBy(order)) + F.col("carried")
    return chunk.join(before.drop("chunk_cost"), "chunk").withColumn("spent", run).where(F.col("spent") <= budget).drop("chunk", "carried")


def fresh_only(candidates: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    """Distinct candidates that aren't golden rows."""
    return candidates.dropDuplicates([key]).join(golden.select(key).distinct(), key, "left_anti")


def resolve_cache(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hits with their cached columns, and requests that miss."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def record_id(df: DataFrame) -> Column:
    """scenario_id, else id, as text; a row that has neither fails the job."""
    own = [F.col(c).cast("string") for c in ("scenario_id", "id") if c in df.columns]
    return F.coalesce(*own, F.raise_error(F.lit("a row has neither scenario_id nor id")).cast("string"))


def read_through(requests: DataFrame, cache: DataFrame, key: str, fetch=None) -> DataFrame:
    """Cached rows, and what `fetch` makes of the requests that miss; without it a miss fails the job. Appends cached."""
    if fetch is None:
        # The error depends on the cache's side, so it isn't pushed below the join.
        both = requests.join(cache.withColumn("cached", F.lit(True)), key, "left")
        missed = F.raise_error(F.concat(F.lit("not in the cache: "), F.col(key).cast("string"))).cast("boolean")
        return both.select(*cache.columns, F.coalesce("cached", missed).alias("cached"))
    hits, misses = resolve_cache(requests, cache, key)
    return hits.select(*cache.columns, F.lit(True).alias("cached")).unionByName(fetch(misses).select(*cache.columns).withColumn("cached", F.lit(False)))


def shard_plan(rows: DataFrame, place: str, tokens: Column, size: int, price: float) -> DataFrame:
    """shard, n, tokens and what they cost at a price for a million; `size` rows to a shard, in order of their place."""
    from rankloom.functions.scalars import half_up

    shards = rows.select(F.floor(F.col(place) / size).alias("shard"), tokens.alias("t"))
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("t").cast("long").alias("tokens"), half_up(F.sum("t") / 1e6 * price, 6).alias("cost"))


#: Characters of the phrases of one automaton, and how many of all phrases go through automata whatever their words.
BLOCK, MOST = 4_000_000, 32_000_000
#: Characters of texts in one batch of pairs.
BATCH = 8_000_000


def _hash_of(width: int):
    return lambda i: F.xxhash64(F.slice("_cut", i, width))


def _words(c: str) -> Column:
    return F.split(c, " ", -1)


def containing(docs: DataFrame, phrases: DataFrame, text: str, phrase: str, width: int = 3) -> DataFrame:
    """Pairs of rows and phrases they contain, with the columns of both (names must differ); an empty phrase is in every text.

    Distinct phrases are dealt in blocks of about BLOCK characters, each block is one automaton that every task runs over
    its texts: one pass for phrases of all widths. Past MOST characters only phrases of less than three words go that way;
    the others meet texts by their words in an equi-join, which has no size that must fit anywhere. Null texts and phrases
    have no pair; repeated rows have one each.
    """
    known = phrases.where(F.col(phrase).isNotNull())
    distinct = known.select(F.col(phrase).alias("_phrase")).distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("_phrase") + 1), F.lit(0)).alias("n")).first().n
    if size <= MOST:
        return _by_automaton(docs, known, distinct, size, text, phrase)
    long = F.size(_words("_phrase")) > 2
    short = distinct.where(~long)
    size = short.agg(F.coalesce(F.sum(F.length("_phrase") + 1), F.lit(0)).alias("n")).first().n
    return _by_automaton(docs, known, short, size, text, phrase).unionByName(_by_words(docs, known.where(F.size(_words(phrase)) > 2), text, phrase, width))


def _by_automaton(docs: DataFrame, phrases: DataFrame, distinct: DataFrame, size: int, text: str, phrase: str) -> DataFrame:
    """Pairs by automata over the `distinct` phrases (_phrase), `size` characters in all."""
    sc, out = docs.sparkSession.sparkContext, None
    blocks = size // BLOCK + 1
    dealt = distinct.withColumn("_block", F.pmod(F.xxhash64("_phrase"), F.lit(blocks)))
    schema = T.StructType([*docs.schema.fields, T.StructField("_phrase", T.StringType())])

    def search(own, most=BATCH):
        def run(batches):
            import ahocorasick
            import pyarrow as pa

            words, automaton = own.value, ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, word in enumerate(words):
                if word:
                    automaton.add_word(word, i)
            automaton.make_automaton()
            everywhere = {i for i, word in enumerate(words) if not word}
            for batch in batches:
                rows, found, held = [], [], 0

                def pairs(batch=batch, rows=rows, found=found):
                    some = batch.take(pa.array(rows, pa.int64()))
                    return pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.string())], names=schema.names)

                for k, value in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                    hits = () if value is None else everywhere | {i for _, i in automaton.iter(value)} if len(automaton) else everywhere
                    for i in sorted(hits):  # the text is repeated for each of its phrases: a bounded number of characters at a time
                        rows.append(k)
                        found.append(words[i])
                        held += len(value)
                        if held > most:
                            yield pairs()
                            rows.clear(), found.clear()
                            held = 0
                if rows:
                    yield pairs()

        return run

    for block in range(blocks):
        own = [r[0] for r in dealt.where(F.col("_block") == block).select("_phrase").collect()]  # about BLOCK characters
        if own:
            part = docs.mapInArrow(search(sc.broadcast(own)), schema)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.crossJoin(phrases).limit(0)
    return out.join(phrases, F.col("_phrase") == F.col(phrase)).select(*docs.columns, *phrases.columns)


def _by_words(docs: DataFrame, phrases: DataFrame, text: str, phrase: str, width: int) -> DataFrame:
    """Pairs of rows and phrases of three words or more.

    What stands between two spaces of a phrase stands between spaces in every text that contains it: rows and phrases
    meet by the first `width` such words in a row (fewer, if there are fewer), and what meets is compared in full.
    """
    sized = phrases.withColumn("_width", F.least(F.size(_words(phrase)) - 2, F.lit(width)))
    rows, found = docs.withColumn("_row", F.xxhash64(*docs.columns)), docs.crossJoin(phrases).limit(0)
    for w in range(1, width + 1):
        own = sized.where(F.col("_width") == w).drop("_width").withColumn("_words", F.xxhash64(F.slice(_words(phrase), 2, w)))
        cut = rows.select("_row", _words(text).alias("_cut")).where(F.size("_cut") >= w)
        pieces = F.transform(F.sequence(F.lit(1), F.size("_cut") - w + 1), _hash_of(w))
        some = cut.select("_row", F.explode(F.array_distinct(pieces)).alias("_words"))
        some = some.join(own.select("_words").distinct(), "_words", "left_semi").distinct()
        found = found.unionByName(rows.join(some.join(own, "_words").drop("_words"), "_row").drop("_row").where(F.contains(F.col(text), F.col(phrase))))
    return found


#: Column names of expert rows, and what the engine calls them: fixed values.
GOLDEN_NAMES = {"id": "scenario_id", "fable_top3": "teacher_top3", "fable_annotation": "teacher_annotation"}


def golden_names(df: DataFrame) -> DataFrame:
    """Expert rows under the engine's names; a name that is there already wins where it isn't null."""
    for old, new in GOLDEN_NAMES.items():
        if old in df.columns and new in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old)
        elif old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df
