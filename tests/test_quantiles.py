"""Percentiles by selection against numpy, however values and groups are spread."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import profile, quantiles

AT = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def rows_of(r):
    """A hot group of a third of all rows, one of ties, few values, one value, nulls only, and many small ones."""
    out = [("hot", r.gauss(0, 1e6)) for _ in range(3000)] + [("ties", float(r.choice([1, 1, 1, 2, 9]))) for _ in range(1000)]
    out += [("one", 5.0)] * 700 + [("nulls", None)] * 20 + [(None, r.random()) for _ in range(501)] + [("two", 1.0), ("two", 4.0), ("single", 3.0)]
    out += [(f"g{k}", float(r.randrange(50))) for k in range(60) for _ in range(r.randint(1, 40))]
    r.shuffle(out)
    return [(g, None if r.random() < 0.02 else x) for g, x in out]


@pytest.mark.parametrize("accuracy", [quantiles.ACCURACY, 400, 50])
@pytest.mark.parametrize("many", [False, True])
def test_against_numpy(spark, accuracy, many, monkeypatch):
    """A coarse sketch leaves most rows outside the brackets; beyond MOST_GROUPS the brackets are joined."""
    if many:
        monkeypatch.setattr(quantiles, "MOST_GROUPS", 5)
    rows = rows_of(random.Random(accuracy))
    by = defaultdict(list)
    for g, x in rows:
        by[g] += [x] if x is not None else []
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for nearest in (False, True):
        got = {r.g: r for r in quantiles.percentiles(df, F.col("x"), AT, ["g"], nearest, {"top": F.max("x")}, accuracy).collect()}
        assert set(got) == set(by)
        for g, xs in by.items():
            assert got[g].n == len(xs) and got[g].top == max(xs, default=None)
            xs.sort()
            for k, f in AT.items():
                if not xs:
                    assert got[g][k] is None
                elif nearest:
                    assert got[g][k] == xs[round((len(xs) - 1) * f)]
                else:
                    assert got[g][k] == pytest.approx(np.percentile(xs, 100 * f), rel=1e-12)


def test_whole_table(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "x double")
    half = {"a": 0.5, "b": 0.95}
    assert quantiles.percentiles(df, F.col("x"), half).first()[:] == (4, 2.5, pytest.approx(3.85, rel=1e-15))
    assert quantiles.percentiles(df.where("x > 9"), F.col("x"), half).first()[:] == (0, None, None)
    assert quantiles.percentiles(df.where("x > 9").withColumn("g", F.lit(1)), F.col("x"), half, ["g"]).count() == 0
    near = {"p50": 0.5, "low": 0.0, "high": 1.0}
    assert profile.nearest_ranks(df, "x", near).first()[:] == (4, 3.0, 1.0, 4.0)  # round(1.5) is 2, half to even
    assert profile.nearest_ranks(df.where("x > 9"), "x", near).first()[:] == (0, 0.0, 0.0, 0.0)
    long = spark.range(0, 200_001, 1, 8).select((F.col("id") * 7 % 200_001).alias("x"))
    assert profile.nearest_ranks(long, "x", near).first()[:] == (200_001, 100_000, 0, 200_000)


def test_lost_places_are_told(spark, monkeypatch):
    """Brackets that miss a place end the job instead of giving another value."""
    monkeypatch.setattr(quantiles, "_brackets", lambda fractions, accuracy: [0.9] * 2 * len(fractions))
    with pytest.raises(Exception, match="outside its bracket"):
        quantiles.percentiles(spark.range(1000), F.col("id"), {"p50": 0.5}).collect()


def test_no_task_holds_a_group(spark):
    """Of 100,000 different values of one group a few go on beyond the counts of the second pass."""
    df = spark.range(0, 100_000, 1, 8).select(F.lit("all").alias("g"), F.col("id").cast("double").alias("x"))
    plan = quantiles.percentiles(df, F.col("x"), {"p50": 0.5}, ["g"])
    assert plan.first()[:] == ("all", 100_000, 49_999.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and " percentile(" not in text


def test_dataset_summary(spark):
    """Two panels: the cheapest is recommended in one of them."""
    rows = [("a", 1, "t1", "i", "p", 10.0, 5.0, False, 0.9, 1), ("a", 2, "t2", "i", "q", 20.0, 3.0, True, 0.5, 2), ("a", 3, "t3", "k", "p", 30.0, None, False, 0.4, 3), ("b", 1, "t1", "i", "p", 15.0, 9.0, False, 0.3, 2), ("b", 2, "t4", "k", "p", 16.0, 9.5, False, 0.7, 1)]
    df = spark.createDataFrame(rows, "scenario_id string, pos int, tariff_id string, insurer string, product string, price_annual double, coverage_score double, insured_unlimited boolean, reward double, rank int")
    s = profile.summary(df).first()
    assert (s.scenarios, s.quotes, s.tariffs, s.insurers, s.products, s.unlimited, s.cheapest_share, s.quotes_per_scenario) == (2, 5, 4, 2, 3, 1, 0.5, 2.5)
    assert s.price_score_r == pytest.approx(np.corrcoef([10, 20, 30, 15, 16], [5, 3, 0, 9, 9.5])[0, 1], abs=1e-4)
    got = {r.measure: r for r in profile.option_statistics(df).collect()}
    assert (got["reward_margin"].n, got["reward_margin"].min, got["reward_margin"].max) == (2, pytest.approx(0.4), pytest.approx(0.4))
    assert (got["options"].median, got["price_recommended"].median, got["price_all"].n, got["coverage_score_all"].min) == (2.5, 13.0, 5, 0.0)
    assert profile.summary(df.limit(0)).first().scenarios == 0 and profile.option_statistics(df.limit(0)).count() == 0
