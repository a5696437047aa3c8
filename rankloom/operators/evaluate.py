"""Evaluation of predicted rankings, reconciliation of batch responses, subgroup comparison and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scalars import half_up
from rankloom.operators import ranking


def judged(predictions: DataFrame) -> DataFrame:
    """Appends pick, hit, recall, pick_reward, best_reward and ratio; predictions: ids, teacher (arrays), rewards (map)."""
    df = predictions.withColumn("pick", F.get("ids", F.lit(0)))
    best, mine = F.array_max(F.map_values("rewards")), F.try_element_at("rewards", F.col("pick"))
    df = df.withColumns({"pick_reward": mine, "best_reward": best})
    return df.withColumns({
        "hit": F.coalesce(F.col("pick") == F.get("teacher", F.lit(0)), F.lit(False)),
        "recall": F.when(F.size("teacher") > 0, ranking.overlap(F.col("ids"), F.col("teacher"))),
        "ratio": F.try_divide(F.nullif(F.col("pick_reward"), F.lit(0.0)), F.nullif(F.col("best_reward"), F.lit(0.0))),
    })


def of_answered(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Hosted-model form: rates over rows that have a pick, means over their known values."""
    said = F.col("pick").isNotNull()
    hit = F.try_divide(F.count_if(said & F.col("hit")).cast("double"), F.count_if(said))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("scenarios"), F.count_if(said).alias("answered"), half_up(hit).alias("top1_accuracy"), half_up(F.avg(F.when(said, F.col("recall")))).alias("top3_recall"), half_up(F.avg(F.when(said, F.col("ratio")))).alias("reward_ratio"))


def of_all(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Local form: all rows in the denominator, an unknown ratio counts 0; and the mean ratio of valid picks."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("scenarios"), half_up(F.avg(F.col("hit").cast("double"))).alias("top1_accuracy"), half_up(F.avg("recall")).alias("top3_recall"), half_up(F.avg(F.coalesce("ratio", F.lit(0.0)))).alias("reward_ratio"), half_up(F.avg("ratio")).alias("valid_reward_ratio"))


def token_cost(rows: DataFrame, price_in: float, price_out: float, by: list[str] = ()) -> DataFrame:
    """Cost of 1,000 rows at prices for a million tokens."""
    cost = F.sum("tokens_in") / 1e6 * price_in + F.sum("tokens_out") / 1e6 * price_out
    return rows.groupBy(*by).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), half_up(cost / F.count(F.lit(1)) * 1000).alias("cost_per_1k"))


def utilisation_cost(levels: DataFrame, hourly: float, tokens: float, shares: list[float]) -> DataFrame:
    """Serving cost of 1,000 requests and of a million tokens at several utilisations, not rounded; levels: level, rps."""
    table = F.explode(F.array(*map(F.lit, shares))).alias("utilisation")
    df = levels.select("level", "rps", table)
    per_1k = F.try_divide(F.lit(hourly / 3.6), F.col("rps") * F.col("utilisation"))
    return df.select("level", "utilisation", per_1k.alias("per_1k"), (per_1k / tokens * 1000).alias("per_mtok"))


def subgroups(rows: DataFrame, fields: list[str], least: int = 10) -> DataFrame:
    """field, value, n, two policies' hit rates and their difference, and whether the group is large enough to count."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    df = rows.select(pairs.alias("g"), "hit_a", "hit_b").groupBy("g.field", "g.value")
    df = df.agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(F.col("hit_a").cast("double"))).alias("rate_a"), half_up(F.avg(F.col("hit_b").cast("double"))).alias("rate_b"))
    return df.withColumn("delta", half_up(F.col("rate_a") - F.col("rate_b"))).withColumn("counts", F.col("n") >= least)


def reconcile(manifest: DataFrame, responses: DataFrame, key: str, text: str, status: str) -> DataFrame:
    """Manifest rows with their response and error: missing, http, unparsed or null."""
    from rankloom.functions.json_text import parse_lenient

    df = manifest.join(responses, key, "left").withColumn("ids", parse_lenient(F.coalesce(text, F.lit(""))))
    error: Column = F.when(F.col(status).isNull(), "missing").when(F.col(status) != 200, "http").when(F.size("ids") < 3, "unparsed")
    return df.withColumn("error", error)
