"""Value-for-money scores within panels, ranking and top k: one shuffle, by the panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalars import half_up, minmax

#: The five inputs of a score.
FIELDS = ["num_coverages", "insured", "deductible", "coverage_score", "price_annual"]


@dataclass(frozen=True)
class Weights:
    """Strength of each term; the price term divides."""

    cov: float = 0.4
    ins: float = 0.3
    ded: float = 0.3
    price: float = 1.0
    score: float = 0.0

    @property
    def total(self) -> float:
        return self.cov + self.ins + self.ded + self.score or 1.0

    def reward(self, norms: dict[str, Column]) -> tuple[Column, Column]:
        """Protection and reward from norms by FIELDS."""
        protection = (
            F.lit(self.cov) * norms["num_coverages"]
            + F.lit(self.ins) * norms["insured"]
            + F.lit(self.ded) * (1.0 - norms["deductible"])
            + F.lit(self.score) * norms["coverage_score"]
        ) / F.lit(self.total)
        return protection, protection / (1.0 + F.lit(self.price) * norms["price_annual"])


def norms(quotes: DataFrame, by: str = "scenario_id") -> DataFrame:
    """Appends insured (null or unlimited: the panel's largest, or 1) and n_<field> for each of FIELDS."""
    w = Window.partitionBy(by)
    most = F.coalesce(F.max(F.when(~F.col("insured_unlimited"), F.col("insured_amount"))).over(w), F.lit(1.0))
    df = quotes.withColumn("insured", F.coalesce(F.when(~F.col("insured_unlimited"), F.col("insured_amount")), most))
    zero = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in ("num_coverages", "deductible", "coverage_score")}
    df = df.withColumns(zero)
    ends = {f"{e}_{f}": fn(f).over(w) for f in FIELDS for e, fn in (("lo", F.min), ("hi", F.max))}
    df = df.select("*", *(c.alias(k) for k, c in ends.items()))
    return df.select(*quotes.columns, "insured", *(minmax(F.col(f), F.col(f"lo_{f}"), F.col(f"hi_{f}")).alias(f"n_{f}") for f in FIELDS))


def score(quotes: DataFrame, weights: Weights = Weights(), by: str = "scenario_id", order: str = "pos") -> DataFrame:
    """Appends protection, reward (4 digits, rounded before ranking) and rank (ties: in order)."""
    df = norms(quotes, by)
    protection, reward = weights.reward({f: F.col(f"n_{f}") for f in FIELDS})
    df = df.withColumns({"protection": half_up(protection), "reward": half_up(reward)})
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("reward"), F.asc(order))))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    return scored.where(F.col("rank") <= k)


def recommend(scored: DataFrame, by: str = "scenario_id") -> DataFrame:
    """The best option of each panel, by aggregation: no window, no sort."""
    best = F.max_by(F.struct("tariff_id", "reward"), F.struct("reward", (-F.col("pos")).alias("p")))
    return scored.groupBy(by).agg(best.alias("b"), F.count(F.lit(1)).alias("quote_count")).select(by, "b.tariff_id", "b.reward", "quote_count")


def panel_arrays(scored: DataFrame, by: str = "scenario_id", **more: Column) -> DataFrame:
    """One row for each panel: options as an array of structs in order, for scoring without a shuffle; and more aggregates."""
    item = F.struct("pos", "tariff_id", *(f"n_{f}" for f in FIELDS))
    return scored.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("options"), *(c.alias(k) for k, c in more.items()))


def order_in_array(options: Column, weights: Column | Weights) -> Column:
    """Tariff ids of a panel array by reward, then order; weights: constants or a struct column (cov, ins, ded, score, price)."""
    w = {k: (F.lit(getattr(weights, k)) if isinstance(weights, Weights) else weights[k]) for k in ("cov", "ins", "ded", "score", "price")}
    total = F.lit(weights.total) if isinstance(weights, Weights) else w["cov"] + w["ins"] + w["ded"] + w["score"]

    def reward(x):
        protection = (w["cov"] * x["n_num_coverages"] + w["ins"] * x["n_insured"] + w["ded"] * (1.0 - x["n_deductible"]) + w["score"] * x["n_coverage_score"]) / total
        return half_up(protection / (1.0 + w["price"] * x["n_price_annual"]))

    ranked = F.array_sort(F.transform(options, lambda x: F.struct((-reward(x)).alias("r"), x["pos"].alias("pos"), x["tariff_id"].alias("tariff_id"))))
    return F.transform(ranked, lambda x: x["tariff_id"])
