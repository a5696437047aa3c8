"""Queries on profiles and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import profile, splits
from rankloom.operators.quantiles import percentiles
from rankloom.plans import views as V
from rankloom.plans.panel_queries import SCORED, scored
from rankloom.registry import query

_h = lambda x, d=4: f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"
_SUMMARY = f"count({{0}}) AS n, {_h('min({0})')} AS min, {_h('avg({0})')} AS mean, {_h('max({0})')} AS max, " + ", ".join(f"{_h('quantile_cont({0}, ' + str(q) + ')')} AS {k}" for k, q in profile.QUANTILES.items())


@query("price_summary", "E1 E2 E3 B20 J15", "SELECT l_returnflag, " + _SUMMARY.format("l_extendedprice") + " FROM lineitem GROUP BY 1")
def price_summary(spark, sf):
    return profile.numeric_summary(V.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("value_summary", "E1", "SELECT " + _SUMMARY.format("value") + " FROM events")
def value_summary(spark, sf):
    return profile.numeric_summary(V.table(spark, sf, "events"), "value")


@query("length_stats", "E4 E22 J17", "WITH r AS (SELECT conv_id, sum(length(text)) AS n, count(*) AS turns FROM conversations GROUP BY 1), o AS (SELECT list(n ORDER BY n) AS l, count(*) AS c FROM r) SELECT CAST(l[1] AS BIGINT) AS min, CAST(l[1 + CAST(round_even((c - 1) * 0.5, 0) AS BIGINT)] AS BIGINT) AS p50, CAST(l[1 + CAST(round_even((c - 1) * 0.95, 0) AS BIGINT)] AS BIGINT) AS p95, CAST(l[c] AS BIGINT) AS max FROM o")
def length_stats(spark, sf):
    n = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    at = {"min": 0.0, "p50": 0.5, "p95": 0.95, "max": 1.0}
    return profile.nearest_ranks(n, "n", at).select(*at)


@query("categories", "E5 E23", f"SELECT event_type AS value, count(*) AS n, {_h('100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events)')} AS pct FROM events GROUP BY 1")
def categories(spark, sf):
    return profile.categorical(V.table(spark, sf, "events"), "event_type")


FIELDS = ["building_type", "construction_class", "roof_type", "attic_status", "owner_occupied", "with_deductible"]
MARGINALS = "m AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, lower(CAST({f} AS VARCHAR)) AS value, count(*) AS n, {_h('100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM risk)')} AS pct FROM risk GROUP BY 2" for f in FIELDS) + ")"


@query("risk_marginals", "E6 B17 J5", f"WITH {V.RISKS}, {MARGINALS} SELECT * FROM m")
def risk_marginals(spark, sf):
    return profile.marginals(V.risks(spark, sf), FIELDS)


_STATUS = "CASE WHEN c IS NULL THEN 'no_quotes' WHEN c < 3 THEN 'insufficient_quotes' ELSE 'success' END"
STATUSES = ["success", "no_quotes", "insufficient_quotes", "transient_error"]


def statuses(spark, sf):
    n = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("c"))
    df = V.table(spark, sf, "orders").join(n, "o_orderkey", "left")
    return df.withColumn("status", F.when(F.col("c").isNull(), "no_quotes").when(F.col("c") < 3, "insufficient_quotes").otherwise("success"))


_COUNTS = ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in STATUSES)


@query("funnel", "E7 E8 H10", f"WITH s AS (SELECT o_orderpriority, {_STATUS} AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) SELECT o_orderpriority, count(*) AS attempts, {_COUNTS}, {_h('100.0 * CAST(count(CASE WHEN status = ' + chr(39) + 'success' + chr(39) + ' THEN 1 END) AS DOUBLE) / count(*)', 2)} AS success_rate_pct FROM s GROUP BY 1")
def funnel(spark, sf):
    return profile.funnel(statuses(spark, sf), "o_orderpriority", "status", STATUSES)


@query("correlations", "E9", f"SELECT l_returnflag, count(*) AS n, {_h('covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0)')} AS r FROM lineitem GROUP BY 1")
def correlations(spark, sf):
    return profile.pearson(V.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], digits=4)


_VARY = ["insured_amount", "deductible", "num_coverages", "insurer"]


@query("field_variation", "E10", f"WITH {V.PANELS} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE d > 1) AS varying FROM (SELECT scenario_id, count(DISTINCT coalesce(CAST({f} AS VARCHAR), '')) AS d FROM panel GROUP BY 1)" for f in _VARY))
def field_variation(spark, sf):
    return profile.variation(V.panels(spark, sf), "scenario_id", _VARY)


@query("dataset_summary", "E11 H11 H2", f"WITH {SCORED} SELECT count(DISTINCT scenario_id) AS scenarios, count(*) AS quotes, count(DISTINCT tariff_id) AS tariffs, count(DISTINCT insurer) AS insurers, count(DISTINCT (insurer, product)) AS products, count(CASE WHEN insured_unlimited THEN 1 END) AS unlimited, {_h('corr(price_annual, coverage_score)')} AS price_score_r, {_h('avg(CASE WHEN rank = 1 THEN CAST(price_annual = lo_price AS INTEGER) END)')} AS cheapest_share, {_h('CAST(count(*) AS DOUBLE) / count(DISTINCT scenario_id)')} AS quotes_per_scenario FROM scored")
def dataset_summary(spark, sf):
    return profile.summary(scored(spark, sf))


_MEASURED = {"price_all": "price_annual FROM scored", "coverage_score_all": "coverage_score FROM scored", "reward_all": "reward FROM scored", "price_recommended": "price_annual FROM scored WHERE rank = 1", "coverage_score_recommended": "coverage_score FROM scored WHERE rank = 1", "reward_margin": "a.reward - b.reward FROM scored a JOIN scored b ON a.scenario_id = b.scenario_id AND a.rank = 1 AND b.rank = 2", "options": "CAST(count(*) AS DOUBLE) FROM scored GROUP BY scenario_id"}


@query("option_statistics", "E11 E1 H2", f"WITH {SCORED}, v(measure, value) AS (" + " UNION ALL ".join(f"SELECT '{k}', {v}" for k, v in _MEASURED.items()) + ") SELECT measure, " + _SUMMARY.format("value") + " FROM v GROUP BY 1")
def option_statistics(spark, sf):
    """Seven measures of all panels in one selection."""
    return profile.option_statistics(scored(spark, sf))


@query("fold_sums", "E12 E13", """WITH s AS (SELECT l_returnflag AS candidate, l_orderkey % 5 AS fold, count(*) AS n, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS hits FROM lineitem GROUP BY 1, 2)
SELECT candidate, CAST(fold AS INTEGER) AS fold, n, hits, CAST(sum(n) OVER w - n AS BIGINT) AS n_rest, CAST(sum(hits) OVER w - hits AS BIGINT) AS hits_rest, floor(CAST(hits AS DOUBLE) / n * 1e6 + 0.5) / 1e6 AS rate FROM s WINDOW w AS (PARTITION BY candidate)""")
def fold_sums(spark, sf):
    line = V.table(spark, sf, "lineitem")
    sums = line.groupBy(F.col("l_returnflag").alias("candidate"), (F.col("l_orderkey") % 5).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("hits"))
    return profile.leave_one_out(sums, "candidate", "fold", ["n", "hits"]).select("*", *profile.rates({"rate": ("hits", "n")}))


@query("wilson_intervals", "E14 J12", f"""WITH s AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN event_type = 'click' THEN 1 END) AS DOUBLE) AS h FROM events GROUP BY 1), w AS (SELECT *, h / n AS p, 1 + 1.96e0 * 1.96e0 / n AS d FROM s)
SELECT user_id, {_h('(p + 1.96e0 * 1.96e0 / (2 * n)) / d - 1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4 * n * n)) / d', 6)} AS low, {_h('(p + 1.96e0 * 1.96e0 / (2 * n)) / d + 1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4 * n * n)) / d', 6)} AS high FROM w""")
def wilson_intervals(spark, sf):
    s = V.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("event_type") == "click").cast("double").alias("h"))
    low, high = S.wilson(F.col("h"), F.col("n"))
    return s.select("user_id", S.half_up(low, 6).alias("low"), S.half_up(high, 6).alias("high"))


_PART = MARGINALS.replace("m AS", "b AS").replace("FROM risk", "FROM part_risk")


@query("split_balance", "E15", f"WITH {V.RISKS}, part_risk AS (SELECT * FROM risk WHERE scenario_id % 7 = 0), {MARGINALS}, {_PART} SELECT {_h('max(abs(m.pct - coalesce(b.pct, 0)))')} AS deviation FROM m LEFT JOIN b ON m.field = b.field AND m.value = b.value")
def split_balance(spark, sf):
    risks = V.risks(spark, sf)
    return splits.deviation(risks, risks.where("scenario_id % 7 = 0"), FIELDS).select(S.half_up(F.col("deviation")).alias("deviation"))


@query("pivot_report", "J21 J22 B21", f"WITH {V.RISKS}, c AS (SELECT building_type, CASE WHEN scenario_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM risk), t AS (SELECT split, count(*) AS n FROM c GROUP BY 1) SELECT building_type, " + ", ".join(f"CAST(count(CASE WHEN split = '{s}' THEN 1 END) AS VARCHAR) || ' (' || printf('%.2f', 100.0 * count(CASE WHEN split = '{s}' THEN 1 END) / (SELECT n FROM t WHERE split = '{s}')) || '%)' AS {s}" for s in ("train", "test")) + " FROM c GROUP BY 1")
def pivot_report(spark, sf):
    df = V.risks(spark, sf).select("building_type", F.when(F.col("scenario_id") % 4 == 0, "test").otherwise("train").alias("split"))
    wide = df.groupBy("building_type").pivot("split", ["train", "test"]).count().fillna(0)
    totals = df.agg(*(F.count_if(F.col("split") == s).alias(f"all_{s}") for s in ("train", "test")))
    return wide.crossJoin(F.broadcast(totals)).select("building_type", *(F.format_string("%d (%.2f%%)", s, F.try_divide(100.0 * F.col(s), F.col(f"all_{s}"))).alias(s) for s in ("train", "test")))


@query("telemetry", "E19 J24", f"SELECT event_type, {_h('avg(value)')} AS mean, {_h('quantile_cont(value, 0.5)')} AS p50, {_h('quantile_cont(value, 0.95)')} AS p95, {_h('max(value)')} AS max, {_h('avg(value) * 120 / 3600')} AS energy_wh FROM events WHERE value IS NOT NULL GROUP BY 1")
def telemetry(spark, sf):
    x = F.col("value")
    parts = {"mean": F.avg(x), "max": F.max(x), "energy_wh": F.avg(x) * 120 / 3600}
    df = percentiles(V.table(spark, sf, "events").where(x.isNotNull()), x, {"p50": 0.5, "p95": 0.95}, ["event_type"], also=parts)
    return df.select("event_type", *(S.half_up(F.col(k)).alias(k) for k in ("mean", "p50", "p95", "max", "energy_wh")))


@query("latency_levels", "E18 F15", f"WITH s AS (SELECT user_id % 4 AS level, count(*) AS requests, {_h('quantile_cont(value, 0.5)')} AS p50, {_h('quantile_cont(value, 0.99)')} AS p99, {_h('count(*) / 60.0')} AS rps FROM events GROUP BY 1) SELECT *, rps = (SELECT max(rps) FROM s) AS best FROM s")
def latency_levels(spark, sf):
    df = V.table(spark, sf, "events").select((F.col("user_id") % 4).alias("level"), "value")
    s = percentiles(df, F.col("value"), {"p50": 0.5, "p99": 0.99}, ["level"], also={"requests": F.count(F.lit(1))})
    s = s.withColumns({"p50": S.half_up(F.col("p50")), "p99": S.half_up(F.col("p99")), "rps": S.half_up(F.col("requests") / 60.0)})
    return s.crossJoin(F.broadcast(s.agg(F.max("rps").alias("top")))).select("level", "requests", "p50", "p99", "rps", (F.col("rps") == F.col("top")).alias("best"))


@query("headline_checks", "K6", f"WITH {SCORED} SELECT count(*) > 0 AS has_rows, min(reward) >= 0 AS not_negative, max(reward) <= 1 AS at_most_one FROM scored")
def headline_checks(spark, sf):
    return scored(spark, sf).agg((F.count(F.lit(1)) > 0).alias("has_rows"), (F.min("reward") >= 0).alias("not_negative"), (F.max("reward") <= 1).alias("at_most_one"))


@query("duplicate_texts", "D2", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_texts(spark, sf):
    df = V.table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return df.where("n > 1").select("doc_id", "n")
