"""Queries on panels: scoring, ranking, top k, arrays, weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import ranking, scoring, splits
from rankloom.plans import views as V
from rankloom.registry import query

_NORMS = [("cov", "num_coverages"), ("ins", "insured"), ("ded", "deductible"), ("score", "coverage_score"), ("price", "price_annual")]
NORMED = (
    V.PANELS
    + """,
ins AS (SELECT * EXCLUDE (num_coverages, deductible, coverage_score), coalesce(CAST(num_coverages AS DOUBLE), 0) AS num_coverages,
  coalesce(deductible, 0) AS deductible, coalesce(coverage_score, 0) AS coverage_score,
  coalesce(CASE WHEN NOT insured_unlimited THEN insured_amount END, max(CASE WHEN NOT insured_unlimited THEN insured_amount END) OVER (PARTITION BY scenario_id), 1.0) AS insured FROM panel),
ends AS (SELECT *, """
    + ", ".join(f"min({f}) OVER w AS lo_{n}, max({f}) OVER w AS hi_{n}" for n, f in _NORMS)
    + """ FROM ins WINDOW w AS (PARTITION BY scenario_id)),
normed AS (SELECT *, """
    + ", ".join(f"CASE WHEN hi_{n} - lo_{n} <= 0.01 * greatest(abs(hi_{n}), abs(lo_{n}), 1.0) THEN 0.5 ELSE ({f} - lo_{n}) / (hi_{n} - lo_{n}) END AS n_{n}" for n, f in _NORMS)
    + " FROM ends)"
)


def scored_sql(cov=0.4, ins=0.3, ded=0.3, score=0.0, price=1.0, total=1.0) -> str:
    return (
        NORMED
        + f""",
raw AS (SELECT *, ({cov!r} * n_cov + {ins!r} * n_ins + {ded!r} * (1.0 - n_ded) + {score!r} * n_score) / {total!r} AS p FROM normed),
rew AS (SELECT *, floor(p * 1e4 + 0.5) / 1e4 AS protection, floor(p / (1.0 + {price!r} * n_price) * 1e4 + 0.5) / 1e4 AS reward FROM raw),
scored AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY reward DESC, pos) AS rank FROM rew)"""
    )


SCORED = scored_sql()


def scored(spark, sf, weights=scoring.Weights()):
    return scoring.score(V.panels(spark, sf), weights)


def labelled(spark, sf):
    """scenario_id, m (reward of each option), ids and top3 (the score's and the labels' first three), in one shuffle."""
    df = scored(spark, sf).withColumn("teacher_rank", V.teacher_rank())
    return df.groupBy("scenario_id").agg(ranking.reward_map("tariff_id", "reward").alias("m"), ranking.first_ids("rank").alias("ids"), ranking.first_ids("teacher_rank").alias("top3"))


@query("panel_top3", "F1 F2 F3 F4 B2 C16", f"WITH {SCORED} SELECT scenario_id, tariff_id, price_annual, reward, CAST(rank AS INTEGER) AS rank FROM scored WHERE rank <= 3")
def panel_top3(spark, sf):
    return scoring.top_k(scored(spark, sf), 3).select("scenario_id", "tariff_id", "price_annual", "reward", "rank")


@query("panel_recommend", "F5", f"WITH {SCORED} SELECT scenario_id, tariff_id, reward, quote_count FROM scored WHERE rank = 1")
def panel_recommend(spark, sf):
    return scoring.recommend(scored(spark, sf))


@query("panel_norms", "F1 F3 H1", f"WITH {NORMED} SELECT scenario_id, pos, " + ", ".join(f"floor(n_{n} * 1e3 + 0.5) / 1e3 AS {n}_n" for n, _ in _NORMS) + " FROM normed")
def panel_norms(spark, sf):
    df = scoring.norms(V.panels(spark, sf))
    return df.select("scenario_id", F.col("pos").cast("long").alias("pos"), *(S.half_up(F.col(f"n_{f}"), 3).alias(f"{n}_n") for n, f in _NORMS))


@query("panel_components", "F4 H1 J30", f"WITH {SCORED} SELECT scenario_id, string_agg(tariff_id || '=' || CAST(CAST(floor(reward * 1e4 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS ranking, max(protection) AS best_protection FROM scored GROUP BY scenario_id")
def panel_components(spark, sf):
    item = F.struct("rank", F.concat("tariff_id", F.lit("="), F.floor(F.col("reward") * 1e4 + 0.5).cast("long").cast("string")).alias("t"))
    df = scored(spark, sf).groupBy("scenario_id").agg(F.array_sort(F.collect_list(item)).alias("r"), F.max("protection").alias("best_protection"))
    return df.select("scenario_id", F.array_join(F.transform("r", lambda x: x["t"]), ",").alias("ranking"), "best_protection")


FROZEN = scoring.Weights(cov=0.1, ins=0.25, ded=0.075, price=0.5, score=0.575)
FROZEN_SQL = scored_sql(0.1, 0.25, 0.075, 0.575, 0.5, FROZEN.total)


@query("panel_frozen_weights", "F4 J26 G14", f"WITH {FROZEN_SQL} SELECT scenario_id, tariff_id, reward FROM scored WHERE rank = 1")
def panel_frozen_weights(spark, sf):
    return scoring.top_k(scored(spark, sf, FROZEN), 1).select("scenario_id", "tariff_id", "reward")


@query("panel_order_arrays", "F6", f"WITH {FROZEN_SQL} SELECT scenario_id, string_agg(tariff_id, ',' ORDER BY rank) AS ranking FROM scored GROUP BY scenario_id")
def panel_order_arrays(spark, sf):
    df = scoring.panel_arrays(scoring.norms(V.panels(spark, sf)))
    return df.select("scenario_id", F.array_join(scoring.order_in_array(F.col("options"), FROZEN), ",").alias("ranking"))


@query("scorer_cross_check", "H5", "SELECT CAST(0 AS BIGINT) AS differing")
def scorer_cross_check(spark, sf):
    """Panels that the window form and the array form rank differently: none."""
    normed = scoring.norms(V.panels(spark, sf))
    arrays = scoring.panel_arrays(normed).select("scenario_id", F.array_join(scoring.order_in_array(F.col("options"), scoring.Weights()), ",").alias("a"))
    window = panel_components(spark, sf).select("scenario_id", F.regexp_replace("ranking", "=[0-9-]+", "").alias("b"))
    return arrays.join(window, "scenario_id", "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


@query("panel_margin", "E11", f"WITH {SCORED} SELECT a.scenario_id, floor((a.reward - b.reward) * 1e4 + 0.5) / 1e4 AS margin FROM scored a JOIN scored b ON a.scenario_id = b.scenario_id AND a.rank = 1 AND b.rank = 2")
def panel_margin(spark, sf):
    w = Window.partitionBy("scenario_id").orderBy("rank")
    return scored(spark, sf).withColumn("next", F.lead("reward").over(w)).where("rank = 1").select("scenario_id", S.half_up(F.col("reward") - F.col("next")).alias("margin"))


@query("rescored_ids", "G17 J9", f"""WITH {SCORED}, best AS (SELECT scenario_id, tariff_id, reward FROM scored WHERE rank = 1)
SELECT scenario_id, tariff_id, reward, printf('wg-%03d', row_number() OVER (ORDER BY scenario_id) - 1) AS new_id FROM best""")
def rescored_ids(spark, sf):
    """All panels, scored again and numbered."""
    best = scored(spark, sf).where("rank = 1").select("scenario_id", "tariff_id", "reward")
    return splits.numbered(best, "scenario_id", "n").withColumn("new_id", F.format_string("wg-%03d", "n")).drop("n")


@query("priced_until", "J7", f"WITH {SCORED} SELECT scenario_id, tariff_id, reward FROM scored WHERE rank = 1 ORDER BY scenario_id LIMIT 200")
def priced_until(spark, sf):
    """Panels of three options and more until there are 200, the stop that was asked for."""
    return scored(spark, sf).where("rank = 1").select("scenario_id", "tariff_id", "reward").orderBy("scenario_id").limit(200)


@query("utility_map", "F16 I11 I12", f"""WITH {SCORED}, e AS (SELECT scenario_id, min(reward) AS lo, max(reward) AS hi FROM scored GROUP BY 1)
SELECT s.scenario_id, s.tariff_id, floor((CASE WHEN hi = lo THEN 1.0 ELSE (reward - lo) / (hi - lo) END) * 1e6 + 0.5) / 1e6 AS utility FROM scored s JOIN e USING (scenario_id)""")
def utility_map(spark, sf):
    maps = scored(spark, sf).groupBy("scenario_id").agg(ranking.reward_map("tariff_id", "reward").alias("m"))
    return maps.select("scenario_id", F.explode(ranking.utilities(F.col("m"))).alias("tariff_id", "utility")).withColumn("utility", S.half_up(F.col("utility"), 6))


_DCG = f"""WITH {SCORED}, e AS (SELECT scenario_id, min(reward) AS lo, max(reward) AS hi FROM scored GROUP BY 1),
u AS (SELECT s.scenario_id, s.tariff_id, rank, CASE WHEN hi = lo THEN 1.0 ELSE (reward - lo) / (hi - lo) END AS utility FROM scored s JOIN e USING (scenario_id)),
ideal AS (SELECT scenario_id, sum(utility * CASE rank WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.25 END) AS d FROM u WHERE rank <= 3 GROUP BY 1),
{V.TEACHERS},
got AS (SELECT t.scenario_id, sum(utility * CASE t.rank WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.25 END) AS n FROM teacher t JOIN u USING (scenario_id, tariff_id) GROUP BY 1)
SELECT scenario_id, floor((CASE WHEN d = 0 THEN 1.0 ELSE n / d END) * 1e6 + 0.5) / 1e6 AS gain FROM got JOIN ideal USING (scenario_id)"""


@query("ranking_gain", "F17 F14", _DCG)
def ranking_gain(spark, sf):
    return labelled(spark, sf).select("scenario_id", S.half_up(ranking.gain(F.col("top3"), F.col("m")), 6).alias("gain"))


@query("valid_fraction", "I10 I9 J23", f"""WITH {SCORED}, {V.TEACHERS},
p AS (SELECT scenario_id, tariff_id FROM teacher WHERE rank <= 2 UNION ALL SELECT scenario_id, 'x' FROM (SELECT DISTINCT scenario_id FROM teacher)),
v AS (SELECT p.scenario_id, count(DISTINCT s.tariff_id) AS n FROM p LEFT JOIN scored s USING (scenario_id, tariff_id) GROUP BY 1)
SELECT scenario_id, floor(least(n, 3) / 3.0 * 1e6 + 0.5) / 1e6 AS valid, floor((0.1 + 0.1 * least(n, 3) / 3.0) * 1e6 + 0.5) / 1e6 AS weighted FROM v""")
def valid_fraction(spark, sf):
    top = labelled(spark, sf).withColumn("top3", F.concat(F.slice("top3", 1, 2), F.array(F.lit("x"))))
    valid = ranking.valid_share(F.col("top3"), F.col("m"))
    total = ranking.weighted_total({"strict": F.lit(1.0), "valid": valid, "top1": F.lit(0.0), "gain": F.lit(0.0)})
    return top.select("scenario_id", S.half_up(valid, 6).alias("valid"), S.half_up(total, 6).alias("weighted"))
