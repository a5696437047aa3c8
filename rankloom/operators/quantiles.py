"""Exact percentiles of groups of any size, by selection: no task ever holds a group's values.

A first pass sketches each group and brackets every wanted place between two approximate percentiles. A second pass counts
rows by where they lie between the brackets' ends; only those inside a bracket, a few of ten thousand, are counted by
value. Running counts then tell which value has the wanted place. Equal values are one row with a count, so ties cost
nothing, and sums over tasks are combined before they are shuffled: a group with a third of all rows is no burden.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the sketch are off by one in so many at most; brackets are twice as wide to both sides.
ACCURACY = 10_000
#: Groups whose brackets go to all tasks; beyond, rows meet their group's brackets in a join.
MOST_GROUPS = 10_000


def _brackets(fractions: list[float], accuracy: int) -> list[float]:
    return [min(1.0, max(0.0, f + side * 2 / accuracy)) for f in fractions for side in (-1, 1)]


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


def percentiles(df: DataFrame, value: Column, fractions: dict[str, float], by: list[str] = (), nearest: bool = False, also: dict[str, Column] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """by, n, the aggregates of `also`, and for each name of `fractions` the percentile of a group's values that aren't null.

    Between two values it is interpolated (place (n - 1) f); with `nearest` it is the value at that place, rounded half to
    even. Null for a group without values. Null is a group of its own; without `by` there is one group, empty or not.
    """
    keys, names = [f"_k{i}" for i in range(len(by))], list(fractions)
    ends = _brackets(list(fractions.values()), accuracy)
    sketch = F.percentile_approx(value, F.array(*map(F.lit, ends)), F.lit(accuracy))
    also = also or {}
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), *(c.alias(k) for k, c in also.items()), sketch.alias("_b"))
    few = stats.limit(MOST_GROUPS + 1).collect()  # brackets of groups, not values
    spark, many = df.sparkSession, len(few) > MOST_GROUPS
    if not many:
        stats = spark.createDataFrame(few, stats.schema)
    bounds = stats.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), *(F.get("_b", F.lit(i)).alias(f"_b{i}") for i in range(len(ends))), F.col("n").alias("_n"))
    rows = df.select(*(F.col(b).alias(f"{k}_") for b, k in zip(by, keys, strict=True)), value.alias("_x")).where("_x IS NOT NULL")
    bounds = bounds if many else F.broadcast(bounds)  # at most MOST_GROUPS rows
    met = rows.join(bounds, _all(F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys)) if keys else rows.crossJoin(bounds)
    x = F.col("_x")
    cell = reduce(lambda a, b: a + b, ((F.col(f"_b{i}") < x).cast("int") + (F.col(f"_b{i}") <= x).cast("int") for i in range(len(ends))))
    inside = reduce(lambda a, b: a | b, (x.between(F.col(f"_b{i}"), F.col(f"_b{i + 1}")) for i in range(0, len(ends), 2)))
    counts = met.groupBy(*keys, "_n", cell.alias("_cell"), F.when(inside, x).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))

    # Places: those of the cells from the cells' counts (a few for each group), those of the values within their cell.
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_all"))
    before = F.sum("_all").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell")) - F.col("_all")
    cells = cells.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_cell").alias("_cell_"), before.alias("_before"))
    on = _all([F.col("_cell") == F.col("_cell_"), *(F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys)])
    placed = counts.join(cells, on).select(*keys, "_n", "_v", "_lo", "_hi", "_c", (F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_cell").orderBy("_v")) - F.col("_c")).alias("_at"))

    def value_at(place: Column) -> Column:
        """Aggregate: the value at a place; outside all brackets only a cell's first and last are known."""
        own = (F.col("_at") <= place) & (place < F.col("_at") + F.col("_c"))
        first, last = place == F.col("_at"), place == F.col("_at") + F.col("_c") - 1
        return F.max(F.when(own & F.col("_v").isNotNull(), F.col("_v")).when(first, F.col("_lo")).when(last, F.col("_hi")))

    def places(f: float) -> list[Column]:
        exact = (F.col("_n") - 1) * F.lit(float(f))
        return [F.bround(exact).cast("long")] if nearest else [F.floor(exact), F.least(F.floor(exact) + 1, F.col("_n") - 1)]

    found = placed.groupBy(*keys, "_n").agg(*(value_at(p).alias(f"_{k}_{i}") for k, f in fractions.items() for i, p in enumerate(places(f))))
    lost = F.raise_error(F.lit(f"a percentile lies outside its bracket at accuracy {accuracy}; a higher one is needed"))

    def result(k: str, f: float) -> Column:
        low = F.col(f"_{k}_0")
        if nearest:
            return F.when(low.isNull(), lost).otherwise(low)
        low, high, over = low.cast("double"), F.col(f"_{k}_1").cast("double"), (F.col("_n") - 1) * F.lit(float(f)) - F.floor((F.col("_n") - 1) * F.lit(float(f)))
        return F.when(low.isNull() | high.isNull(), lost).when(high == low, low).otherwise(low + (high - low) * over)

    found = found.select(*(F.col(k).alias(f"{k}_") for k in keys), *(result(k, f).alias(k) for k, f in fractions.items()))
    stats = stats.select(*by, "n", *also)
    joined = stats.join(found, _all(F.col(b).eqNullSafe(F.col(f"{k}_")) for b, k in zip(by, keys, strict=True)), "left") if keys else stats.join(found, F.lit(True), "left")
    return joined.select(*by, "n", *also, *names)
