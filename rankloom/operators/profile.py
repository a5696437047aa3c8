"""Profiles: numeric summaries, frequencies, marginals, funnels and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalars import half_up
from rankloom.operators.quantiles import percentiles

QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def numeric_summary(df: DataFrame, value: str, by: list[str] = (), digits: int = 4) -> DataFrame:
    """count, min, p10, p25, mean, median, p75, p90, max; exact, nulls skipped."""
    x = F.col(value).cast("double")
    parts = {"min": F.min(x), "mean": F.avg(x), "max": F.max(x)}
    df = percentiles(df, x, QUANTILES, by, also=parts)
    return df.select(*by, "n", *(half_up(F.col(k), digits).alias(k) for k in (*parts, *QUANTILES)))


def nearest_ranks(df: DataFrame, value: str, fractions: dict[str, float], by: list[str] = ()) -> DataFrame:
    """by, n and for each name the value at place round((n - 1) f), half to even; 0 if there is none."""
    df = percentiles(df, F.col(value), fractions, by, nearest=True)
    return df.select(*by, "n", *(F.coalesce(k, F.lit(0)).alias(k) for k in fractions))


def categorical(df: DataFrame, value: str) -> DataFrame:
    """value, n, pct of all."""
    n = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", half_up(100.0 * F.col("n") / F.col("total")).alias("pct"))


def marginals(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n, pct for several fields in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.lower(F.col(c).cast("string")).alias("value")) for c in fields)))
    n = df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("field").agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), "field").select("field", "value", "n", half_up(100.0 * F.col("n") / F.col("total")).alias("pct"))  # a row for each field


def funnel(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """key, attempts, successes, success_rate_pct and a zero-filled count for each status."""
    counts = {v: F.count_if(F.col(status) == v) for v in values}
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), *(c.alias(v) for v, c in counts.items()))
    return out.withColumn("success_rate_pct", half_up(100.0 * F.col("success") / F.col("attempts"), 2))


def pearson(df: DataFrame, x: str, y: str, by: list[str] = (), digits: int = 6) -> DataFrame:
    """Correlation of the rows that have both; null if there are fewer than two or one is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.groupBy(*by).agg(F.count(a).alias("n"), half_up(r, digits).alias("r"))


def variation(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """field, varying: groups in which a field has more than one value; null is a value, and 1 is not 1.0."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}).alias("v")) for f in fields)))
    distinct = df.select(by, pairs.alias("p")).groupBy(by, "p.field").agg(F.min("p.v").alias("a"), F.max("p.v").alias("b"))
    return distinct.groupBy("field").agg(F.count_if(F.col("a") != F.col("b")).alias("varying"))


def summary(scored: DataFrame, by: str = "scenario_id") -> DataFrame:
    """One row on scored options: panels, options, distinct ids, insurers and products, options a panel, how many are unlimited,
    the correlation of price and coverage score, and the share of the recommended (rank 1) that are their panel's cheapest."""
    cheapest = F.min("price_annual").over(Window.partitionBy(by))
    df = scored.select("*", F.coalesce(F.col("coverage_score").cast("double"), F.lit(0.0)).alias("_s"), F.when(F.col("rank") == 1, (F.col("price_annual") == cheapest).cast("double")).alias("_won"))
    x, y = F.col("price_annual"), F.col("_s")
    counts = {"scenarios": by, "tariffs": "tariff_id", "insurers": "insurer", "products": F.struct("insurer", "product")}
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    df = df.agg(F.count(F.lit(1)).alias("quotes"), F.count_if("insured_unlimited").alias("unlimited"), half_up(r, 4).alias("price_score_r"), half_up(F.avg("_won")).alias("cheapest_share"), *(F.count_distinct(c).alias(k) for k, c in counts.items()))
    return df.withColumn("quotes_per_scenario", half_up(F.try_divide("quotes", "scenarios")))


def option_statistics(scored: DataFrame, by: str = "scenario_id") -> DataFrame:
    """measure, n, min, mean, max and percentiles: options a panel, price, coverage score and reward of all options, price and
    coverage score of the recommended ones, and by how much the first reward exceeds the second."""
    first = F.col("rank") == 1
    w = Window.partitionBy(by)
    second = F.max(F.when(F.col("rank") == 2, F.col("reward"))).over(w)
    score = F.coalesce(F.col("coverage_score").cast("double"), F.lit(0.0))
    values = {
        "price_all": F.col("price_annual").cast("double"),
        "coverage_score_all": score,
        "reward_all": F.col("reward"),
        "price_recommended": F.when(first, F.col("price_annual").cast("double")),
        "coverage_score_recommended": F.when(first, score),
        "reward_margin": F.when(first, F.col("reward") - second),
        "options": F.when(first, F.count(F.lit(1)).over(w).cast("double")),
    }
    named = [F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in values]
    long = scored.select(*(c.alias(k) for k, c in values.items())).select(F.explode(F.array(*named)).alias("e")).select("e.*")
    return numeric_summary(long.where("value IS NOT NULL"), "value", ["measure"])


def leave_one_out(sums: DataFrame, by: str, fold: str, measures: list[str]) -> DataFrame:
    """For each fold, the sums over all others, by subtraction."""
    w = Window.partitionBy(by)
    return sums.select(by, fold, *((F.sum(m).over(w) - F.col(m)).alias(f"{m}_rest") for m in measures), *measures)


def rates(measures: dict[str, tuple[str, str]]) -> list[Column]:
    """hits / trials, 0 without trials, rounded to 6."""
    return [F.coalesce(half_up(F.try_divide(F.col(a), F.col(b)), 6), F.lit(0.0)).alias(k) for k, (a, b) in measures.items()]
