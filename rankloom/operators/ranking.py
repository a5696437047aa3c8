"""Ranking metrics on id arrays and reward maps; all within a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Discounts of the three places, and weights of the four rewards: fixed values.
PLACES = [1.0, 0.5, 0.25]
REWARDS = {"strict": 0.10, "valid": 0.10, "top1": 0.40, "gain": 0.40}


def reward_map(key: str, value: str) -> Column:
    """Aggregate: key -> value; of equal keys the largest value."""
    items = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    last = F.filter(items, lambda x, i: F.coalesce(F.get(items, i + 1)["k"] != x["k"], F.lit(True)))
    return F.map_from_entries(last)


def top_ids(labels: DataFrame, by: str = "scenario_id", k: int = 3) -> DataFrame:
    """by, top3: ids in order of rank."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "tariff_id")))
    return labels.groupBy(by).agg(F.slice(F.transform(ranked, lambda x: x["tariff_id"]), 1, k).alias("top3"))


def first_ids(rank: str, k: int = 3) -> Column:
    """Aggregate: the ids of a group's first k ranks."""
    ranked = F.array_sort(F.collect_list(F.when(F.col(rank) <= k, F.struct(rank, "tariff_id"))))
    return F.transform(ranked, lambda x: x["tariff_id"])


def utilities(m: Column) -> Column:
    """Values of a map into [0, 1]; all 1 if they are equal."""
    lo, hi = F.array_min(F.map_values(m)), F.array_max(F.map_values(m))
    return F.transform_values(m, lambda _, v: F.when(hi == lo, 1.0).otherwise(F.try_divide(v - lo, hi - lo)))


def _discounted(values: Column) -> Column:
    terms = [F.get(values, F.lit(i)) * w for i, w in enumerate(PLACES)]
    return reduce(lambda a, b: a + b, terms)


def gain(ids: Column, m: Column) -> Column:
    """Discounted utility of three distinct known ids over the ideal; 0 if they aren't, 1 if the ideal is 0."""
    u = utilities(m)
    fine = (F.size(ids) == 3) & (F.size(F.array_distinct(ids)) == 3) & (F.size(F.array_except(ids, F.map_keys(u))) == 0)
    ideal = _discounted(F.sort_array(F.map_values(u), asc=False))
    mine = _discounted(F.transform(ids, lambda x: F.try_element_at(u, x)))
    return F.when(~fine, 0.0).when(ideal == 0, 1.0).otherwise(F.try_divide(mine, ideal))


def valid_share(ids: Column, m: Column) -> Column:
    """Share of three places that distinct offered ids take."""
    return F.least(F.size(F.array_intersect(F.slice(ids, 1, 3), F.map_keys(m))), F.lit(3)) / 3.0


def top1_utility(ids: Column, m: Column) -> Column:
    return F.coalesce(F.try_element_at(utilities(m), F.get(ids, F.lit(0))), F.lit(0.0))


def weighted_total(parts: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * parts[k] for k, w in REWARDS.items()))


def overlap(a: Column, b: Column) -> Column:
    """Common ids of two rankings, of three."""
    return F.size(F.array_intersect(a, b)) / 3.0


def concordance(predicted: Column, teacher: Column) -> tuple[Column, Column]:
    """Pairs that a full ranking orders as the teacher's top three does, and all such pairs: 3 + 3 (n - 3).

    Behind one of the three stand as many others as places are left, less those of the three that stand behind it too.
    """
    n, at = F.size(predicted), [F.array_position(predicted, F.get(teacher, F.lit(i))) for i in range(3)]
    count = lambda tests: reduce(lambda a, b: a + b, (t.cast("int") for t in tests))
    right = count([at[0] < at[1], at[0] < at[2], at[1] < at[2]])
    for i, x in enumerate(at):
        right = right + (n - x) - count([y > x for j, y in enumerate(at) if j != i])
    return right.cast("int"), (3 + 3 * (n - count([x > 0 for x in at]))).cast("int")
