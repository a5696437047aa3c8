"""Queries on calibration, evaluation, parsing and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import json_text as J
from rankloom.functions import scalars as S
from rankloom.operators import calibrate, context, evaluate, lineage, ranking, scoring, splits
from rankloom.plans import views as V
from rankloom.plans.panel_queries import FROZEN, FROZEN_SQL, NORMED, SCORED, labelled, scored
from rankloom.plans.profile_queries import STATUSES, statuses
from rankloom.registry import query
from rankloom.sources.versioned import Versioned

_h = lambda x, d=4: f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"

# The search: all panels, folds by seeded hash, 10 anchors and more.
_FOLDS = "folded AS (SELECT scenario_id, (row_number() OVER (ORDER BY sha256('9:sample:' || scenario_id)) - 1) % 5 AS fold FROM (SELECT DISTINCT scenario_id FROM panel))"


def _cands(points) -> str:
    """Candidates (id, *point) as SQL, with the weights that calibrate.weights_of gives."""
    rows = ", ".join(f"({i}, {', '.join(f'CAST({float(x)!r} AS DOUBLE)' for x in p[:4])})" for i, p in points)
    return f"cand(id, static, ins0, sc0, w_price) AS (VALUES {rows}), w AS (SELECT id, w_price, static / (static + ins0 + sc0) * 4.0 / 7.0 AS w_cov, ins0 / (static + ins0 + sc0) AS w_ins, static / (static + ins0 + sc0) * 3.0 / 7.0 AS w_ded, sc0 / (static + ins0 + sc0) AS w_score FROM cand)"


def _search(points, teachers: str = V.TEACHERS) -> str:
    """Common table expressions up to `sums`, the measures by candidate and fold."""
    return f"""{NORMED}, {teachers}, {_FOLDS}, {_cands(points)},
rr AS (SELECT id, fold, n.scenario_id, tariff_id, pos, {_h('(w_cov * n_cov + w_ins * n_ins + w_ded * (1.0 - n_ded) + w_score * n_score) / (w_cov + w_ins + w_ded + w_score) / (1.0 + w_price * n_price)')} AS reward FROM normed n JOIN folded USING (scenario_id) CROSS JOIN w),
ord AS (SELECT *, row_number() OVER (PARTITION BY id, scenario_id ORDER BY reward DESC, pos) AS place FROM rr),
lab AS (SELECT o.*, t.rank AS t FROM ord o LEFT JOIN teacher t ON t.scenario_id = o.scenario_id AND t.tariff_id = o.tariff_id),
hits AS (SELECT id, fold, scenario_id, count(CASE WHEN place = 1 AND t = 1 THEN 1 END) AS top1, count(CASE WHEN place <= 3 AND t IS NOT NULL THEN 1 END) AS top3, 3 + 3 * (count(*) - 3) AS constraints FROM lab GROUP BY 1, 2, 3),
prs AS (SELECT a.id, a.scenario_id, count(*) AS pairs FROM lab a JOIN lab b ON a.id = b.id AND a.scenario_id = b.scenario_id AND a.t IS NOT NULL AND (b.t IS NULL OR b.t > a.t) AND a.place < b.place GROUP BY 1, 2),
sums AS (SELECT h.id, h.fold, count(*) AS n, CAST(sum(top1) AS BIGINT) AS top1, CAST(sum(top3) AS BIGINT) AS top3, CAST(sum(coalesce(pairs, 0)) AS BIGINT) AS pairs, CAST(sum(constraints) AS BIGINT) AS constraints FROM hits h LEFT JOIN prs p ON p.id = h.id AND p.scenario_id = h.scenario_id GROUP BY 1, 2)"""


SEARCH = _search(enumerate(calibrate.ANCHORS))


def folded(spark, sf):
    """All panels as arrays, with their labels' first three and their fold: one shuffle of options, and counts by panel."""
    df = scoring.norms(V.panels(spark, sf)).withColumn("teacher_rank", V.teacher_rank())
    panels = scoring.panel_arrays(df, top3=ranking.first_ids("teacher_rank"))
    chosen = splits.hash_rank(V.panel_ids(spark, sf), "scenario_id", 9, "sample")
    return panels.join(chosen.select("scenario_id", (F.col("place") % 5).alias("fold")), "scenario_id")


def anchors(spark):
    return calibrate.candidates(spark, len(calibrate.ANCHORS), 1)


@query("candidate_sums", "D10 F7 H3 G14 J31", f"WITH {SEARCH} SELECT * FROM sums")
def candidate_sums(spark, sf):
    return calibrate.evaluate(folded(spark, sf), anchors(spark))


def _distance() -> str:
    return f"SELECT id, abs(w_cov - 0.4) + abs(w_ins - 0.3) + abs(w_ded - 0.3) + abs(w_score) + 0.25 * abs(ln((w_price + 0.05) / 1.05)) AS distance FROM w"


_TOTALS = f"d AS ({_distance()}), tot AS (SELECT id, sum(n) AS n, sum(top1) AS top1, sum(top3) AS top3, sum(pairs) AS pairs FROM sums GROUP BY 1)"
_TOTAL = f"SELECT tot.id, CAST(n AS BIGINT) AS n, CAST(top1 AS BIGINT) AS top1, CAST(top3 AS BIGINT) AS top3, CAST(pairs AS BIGINT) AS pairs, {_h('distance')} AS distance"
_HELD_OUT = f"d AS ({_distance()}), rest AS (SELECT s.*, distance, sum(top1) OVER x - top1 AS r1, sum(top3) OVER x - top3 AS r3, sum(pairs) OVER x - pairs AS rp FROM sums s JOIN d ON d.id = s.id WINDOW x AS (PARTITION BY s.id)), held AS (SELECT fold, id, n, top1, top3, pairs, constraints FROM rest QUALIFY row_number() OVER (PARTITION BY fold ORDER BY r1 DESC, r3 DESC, rp DESC, distance, id) = 1)"


@query("candidate_ranks", "F8 F9 H4 J13", f"WITH {SEARCH}, {_TOTALS} {_TOTAL}, row_number() OVER (ORDER BY top1 DESC, top3 DESC, pairs DESC, distance, tot.id) AS rank FROM tot JOIN d ON d.id = tot.id")
def candidate_ranks(spark, sf):
    cands = anchors(spark)
    df = calibrate.ranked(calibrate.evaluate(folded(spark, sf), cands), cands)
    return df.select("id", "n", "top1", "top3", "pairs", S.half_up(F.col("distance")).alias("distance"), "rank")


@query("cross_validation", "F10 E12 E13", f"WITH {SEARCH}, {_HELD_OUT} SELECT * FROM held")
def cross_validation(spark, sf):
    cands = anchors(spark)
    return calibrate.cross_validated(calibrate.evaluate(folded(spark, sf), cands), cands)


@query("kept_sums", "E12 A4", f"WITH {SEARCH.replace('panel AS (SELECT * FROM q WHERE quote_count >= 3)', 'panel AS (SELECT * FROM q WHERE quote_count >= 3 AND scenario_id % 4 <> 1)').replace('folded AS (SELECT scenario_id,', 'folded AS (SELECT * FROM (SELECT scenario_id,').replace('FROM (SELECT DISTINCT scenario_id FROM panel))', 'FROM (SELECT l_orderkey AS scenario_id FROM lineitem GROUP BY 1 HAVING count(*) >= 3)))')} SELECT * FROM sums")
def kept_sums(spark, sf):
    """Sums kept of three shards of panels; a fourth comes and one goes, and no panel of the other two is read again."""
    panels = folded(spark, sf).withColumn("shard", F.col("scenario_id") % 4)
    store, cands = Versioned(spark, lineage.scratch(spark, "sums")), anchors(spark)
    sums = lambda *shards: calibrate.by_shard(panels.where(F.col("shard").isin(*shards)), cands, "shard", 5)
    store.replace(sums(0, 1, 2), by=["shard"])
    total = calibrate.merged(store.read(), come=sums(3), gone=store.read().where("shard = 1"))
    return total.select("id", F.col("fold").cast("long").alias("fold"), *calibrate.MEASURES)


#: Candidates of a whole search, and those of them that SQL follows: the anchors and every thousandth.
TRIALS, SEED, CONTROL_TRIALS = 20_000, 17, 60
FOLLOWED = [*range(len(calibrate.ANCHORS)), *range(1_000, TRIALS, 1_000)]


@query("calibration", "H6 G13")
def calibration(spark, sf):
    """A search over 20,000 candidates and all panels: the ten best (a top-ten report)."""
    cands = calibrate.candidates(spark, TRIALS, SEED)
    return calibrate.ranked(calibrate.evaluate(folded(spark, sf), cands), cands).where("rank <= 10")


_POINTS = calibrate.points(TRIALS, SEED)


@query("calibration_totals", "H6 G13", f"WITH {_search([(i, _POINTS[i]) for i in FOLLOWED])}, {_TOTALS} {_TOTAL} FROM tot JOIN d ON d.id = tot.id")
def calibration_totals(spark, sf):
    """The same search's totals of the candidates that SQL follows; all 20,000 are ranked on the way."""
    cands = calibrate.candidates(spark, TRIALS, SEED)
    df = calibrate.totals(calibrate.evaluate(folded(spark, sf), cands), cands).where(F.col("id").isin(FOLLOWED))
    return df.select("id", "n", "top1", "top3", "pairs", S.half_up(F.col("distance")).alias("distance"))


_SHUFFLED = "teacher AS (SELECT scenario_id, rank, tariff_id FROM (SELECT scenario_id, tariff_id, row_number() OVER (PARTITION BY scenario_id ORDER BY sha256('13:permute:' || scenario_id || ':' || tariff_id), tariff_id) AS rank FROM panel) WHERE rank <= 3)"


@query("permutation_control", "H7 G12", f"WITH {_search(enumerate(_POINTS[:CONTROL_TRIALS]), _SHUFFLED)}, {_HELD_OUT}, got AS (SELECT CAST(sum(top1) AS DOUBLE) / sum(n) AS r FROM held), luck AS (SELECT avg(1.0 / quote_count) AS c FROM (SELECT DISTINCT scenario_id, quote_count FROM panel)) SELECT {_h('r', 6)} AS top1_rate, {_h('c', 6)} AS chance, r <= c + 0.05 AS passes FROM got, luck")
def permutation_control(spark, sf):
    """The search and its cross-validation under shuffled labels, against what chance gives."""
    panels = folded(spark, sf).drop("top3").join(calibrate.permuted(V.panels(spark, sf), 13), "scenario_id")
    cands = calibrate.candidates(spark, CONTROL_TRIALS, SEED)
    sums = calibrate.evaluate(panels, cands)
    df = calibrate.control_passes(calibrate.cross_validated(sums, cands), panels)
    return df.select(S.half_up(F.col("top1_rate"), 6).alias("top1_rate"), S.half_up(F.col("chance"), 6).alias("chance"), "passes")


_PICKS = f"""{FROZEN_SQL.replace('scored AS', 'frozen AS')}, {V.TEACHERS},
base AS (SELECT scenario_id, tariff_id AS base_pick FROM ({{base}}) WHERE rank = 1),
pick AS (SELECT f.scenario_id, f.tariff_id = t.tariff_id AS hit_a, b.base_pick = t.tariff_id AS hit_b FROM frozen f JOIN teacher t ON t.scenario_id = f.scenario_id AND t.rank = 1 JOIN base b ON b.scenario_id = f.scenario_id WHERE f.rank = 1)"""
_BASE = f"SELECT scenario_id, tariff_id, row_number() OVER (PARTITION BY scenario_id ORDER BY {_h('(0.4 * n_cov + 0.3 * n_ins + 0.3 * (1.0 - n_ded) + 0.0 * n_score) / 1.0 / (1.0 + 1.0 * n_price)')} DESC, pos) AS rank FROM normed"
_GROUPS = ["building_type", "construction_class", "roof_type"]


def picks(spark, sf):
    """Whether the frozen and the default weights' first picks are the labels' first, from one shuffle."""
    df = scoring.norms(V.panels(spark, sf)).withColumn("teacher_rank", V.teacher_rank())
    by = {"a": FROZEN, "b": scoring.Weights()}
    df = df.withColumns({f"r_{k}": S.half_up(w.reward({f: F.col(f"n_{f}") for f in scoring.FIELDS})[1]) for k, w in by.items()})
    best = [F.max_by("tariff_id", F.struct(f"r_{k}", (-F.col("pos")).alias("p"))).alias(k) for k in by]
    df = df.groupBy("scenario_id").agg(*best, F.max(F.when(F.col("teacher_rank") == 1, F.col("tariff_id"))).alias("first"))
    return df.select("scenario_id", (F.col("a") == F.col("first")).alias("hit_a"), (F.col("b") == F.col("first")).alias("hit_b"))


@query("subgroups", "E24", f"WITH {_PICKS.format(base=_BASE)}, {V.RISKS}, g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, hit_a, hit_b FROM pick JOIN risk USING (scenario_id)" for f in _GROUPS) + f"), r AS (SELECT field, value, count(*) AS n, {_h('avg(CAST(hit_a AS DOUBLE))')} AS rate_a, {_h('avg(CAST(hit_b AS DOUBLE))')} AS rate_b FROM g GROUP BY 1, 2) SELECT *, {_h('rate_a - rate_b')} AS delta, n >= 10 AS counts FROM r")
def subgroups(spark, sf):
    return evaluate.subgroups(picks(spark, sf).join(V.risks(spark, sf), "scenario_id"), _GROUPS)


@query("two_policies", "H8 E20", f"WITH {_PICKS.format(base=_BASE)} SELECT count(*) AS n, {_h('avg(CAST(hit_a AS DOUBLE))')} AS top1_a, {_h('avg(CAST(hit_b AS DOUBLE))')} AS top1_b FROM pick")
def two_policies(spark, sf):
    rate = lambda c: S.half_up(F.avg(F.col(c).cast("double")))
    return picks(spark, sf).agg(F.count(F.lit(1)).alias("n"), rate("hit_a").alias("top1_a"), rate("hit_b").alias("top1_b"))


def predictions(spark, sf):
    """Predicted rankings: the score's own, none for every seventh panel, an unknown first pick for every fifth."""
    k = F.col("scenario_id")
    said = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.concat(F.array(F.lit("x")), F.slice("ids", 2, 2))).otherwise(F.col("ids"))
    return labelled(spark, sf).select("scenario_id", said.alias("ids"), F.col("m").alias("rewards"), F.col("top3").alias("teacher"))


_JUDGED = f"""{SCORED}, {V.TEACHERS}, best AS (SELECT scenario_id, max(reward) AS best_reward FROM scored GROUP BY 1),
one AS (SELECT s.scenario_id, best_reward, CASE WHEN s.scenario_id % 7 = 0 THEN NULL WHEN s.scenario_id % 5 = 0 THEN 'x' ELSE s.tariff_id END AS pick, CASE WHEN s.scenario_id % 7 <> 0 AND s.scenario_id % 5 <> 0 THEN s.reward END AS pick_reward FROM scored s JOIN best USING (scenario_id) WHERE rank = 1),
rec AS (SELECT t.scenario_id, count(s.tariff_id) / 3.0 AS recall FROM teacher t LEFT JOIN scored s ON s.scenario_id = t.scenario_id AND s.tariff_id = t.tariff_id AND s.rank <= 3 AND s.scenario_id % 7 <> 0 AND (s.scenario_id % 5 <> 0 OR s.rank > 1) GROUP BY 1),
judged AS (SELECT o.*, coalesce(pick = t.tariff_id, FALSE) AS hit, recall, nullif(pick_reward, 0) / nullif(best_reward, 0) AS ratio FROM one o JOIN teacher t ON t.scenario_id = o.scenario_id AND t.rank = 1 JOIN rec ON rec.scenario_id = o.scenario_id)"""


@query("judged_rows", "J18 D11 J16", f"WITH {_JUDGED} SELECT scenario_id, pick, hit, {_h('recall')} AS recall, pick_reward, best_reward, {_h('ratio')} AS ratio FROM judged")
def judged_rows(spark, sf):
    return evaluate.judged(predictions(spark, sf)).select("scenario_id", "pick", "hit", S.half_up(F.col("recall")).alias("recall"), "pick_reward", "best_reward", S.half_up(F.col("ratio")).alias("ratio"))


@query("metrics_of_answered", "E16", f"WITH {_JUDGED} SELECT count(*) AS scenarios, count(pick) AS answered, {_h('CAST(count(CASE WHEN pick IS NOT NULL AND hit THEN 1 END) AS DOUBLE) / count(pick)')} AS top1_accuracy, {_h('avg(CASE WHEN pick IS NOT NULL THEN recall END)')} AS top3_recall, {_h('avg(CASE WHEN pick IS NOT NULL THEN ratio END)')} AS reward_ratio FROM judged")
def metrics_of_answered(spark, sf):
    return evaluate.of_answered(evaluate.judged(predictions(spark, sf)))


@query("metrics_of_all", "E17", f"WITH {_JUDGED} SELECT count(*) AS scenarios, {_h('avg(CAST(hit AS DOUBLE))')} AS top1_accuracy, {_h('avg(recall)')} AS top3_recall, {_h('avg(coalesce(ratio, 0))')} AS reward_ratio, {_h('avg(ratio)')} AS valid_reward_ratio FROM judged")
def metrics_of_all(spark, sf):
    return evaluate.of_all(evaluate.judged(predictions(spark, sf)))


@query("token_cost", "E16 E21", f"SELECT role, CAST(sum(ceil(length(text) / 3.0)) AS BIGINT) AS tokens_in, CAST(sum(length(text) // 10) AS BIGINT) AS tokens_out, {_h('(sum(ceil(length(text) / 3.0)) / 1e6 * 1.25 + sum(length(text) // 10) / 1e6 * 10.0) / count(*) * 1000')} AS cost_per_1k FROM conversations GROUP BY 1")
def token_cost(spark, sf):
    c = V.table(spark, sf, "conversations").select("role", J.token_estimate(F.col("text")).alias("tokens_in"), F.floor(F.length("text") / 10).alias("tokens_out"))
    return evaluate.token_cost(c, 1.25, 10.0, ["role"])


@query("utilisation_cost", "E21", f"WITH s AS (SELECT user_id % 4 AS level, count(*) / 60.0 AS rps FROM events GROUP BY 1) SELECT level, CAST(u AS DOUBLE) AS utilisation, {_h('0.65e0 / 3.6e0 / (rps * CAST(u AS DOUBLE))', 6)} AS per_1k, {_h('0.65e0 / 3.6e0 / (rps * CAST(u AS DOUBLE)) / 1000.0e0 * 1000', 6)} AS per_mtok FROM s, unnest([0.25, 0.5, 0.75, 1.0]) AS t(u)")
def utilisation_cost(spark, sf):
    levels = V.table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("level")).agg((F.count(F.lit(1)) / 60.0).alias("rps"))
    df = evaluate.utilisation_cost(levels, 0.65, 1000.0, [0.25, 0.5, 0.75, 1.0])
    return df.select("level", "utilisation", *(S.half_up(F.col(c), 6).alias(c) for c in ("per_1k", "per_mtok")))


def _texts(spark, sf):
    """Model outputs of several qualities around a ranking."""
    top = ranking.top_ids(V.teachers(spark, sf))
    k, target = F.col("scenario_id") % 5, J.ranking_json(F.col("top3"))
    one = F.concat(F.lit('broken {"tariff_id": "'), F.get("top3", F.lit(0)), F.lit('", "tariff_id":"'), F.get("top3", F.lit(1)), F.lit('"'))
    alt = F.concat(F.lit('{"recommendations": '), F.to_json("top3"), F.lit("}"))
    text = F.when(k == 0, target).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), target, F.lit("\n``` done"))).when(k == 2, one).when(k == 3, alt).otherwise("no idea")
    return top.select("scenario_id", "top3", text.alias("text"))


_TOP3 = f"WITH {V.PANELS}, {V.TEACHERS}, t AS (SELECT scenario_id, string_agg(tariff_id, ',' ORDER BY rank) AS top3, string_agg(tariff_id, ',' ORDER BY rank) FILTER (WHERE rank <= 2) AS top2 FROM teacher GROUP BY 1)"


@query("parsed_rankings", "I1 I2 I3 I9", f"{_TOP3} SELECT scenario_id, CASE scenario_id % 5 WHEN 2 THEN top2 WHEN 4 THEN '' ELSE top3 END AS lenient, CASE scenario_id % 5 WHEN 2 THEN top2 WHEN 4 THEN '' ELSE top3 END AS ids, scenario_id % 5 = 0 AS strict, scenario_id % 5 IN (0, 3) AS json, scenario_id % 5 = 0 AS valid FROM t")
def parsed_rankings(spark, sf):
    strict, checked = J.parse_strict(F.col("text")), J.parse_checked(F.col("text"), F.col("top3"))
    join = lambda c: F.array_join(c, ",")
    return _texts(spark, sf).select("scenario_id", join(J.parse_lenient(F.col("text"))).alias("lenient"), join(strict["ids"]).alias("ids"), strict["strict"].alias("strict"), checked["json"].alias("json"), checked["valid"].alias("valid"))


@query("ranking_targets", "I4 C12", f"""WITH {V.PANELS}, {V.TEACHERS} SELECT scenario_id, '{{"top_3":[' || string_agg('{{"rank":' || rank || ',"tariff_id":"' || tariff_id || '"}}', ',' ORDER BY rank) || ']}}' AS target FROM teacher GROUP BY 1""")
def ranking_targets(spark, sf):
    return ranking.top_ids(V.teachers(spark, sf)).select("scenario_id", J.ranking_json(F.col("top3")).alias("target"))


_FIELDS = ["tariff_id", "insurer", "price_annual", "num_coverages"]
_INSTRUCTION = "Name the best three, best first."


def prompts(spark, sf):
    item = F.struct("pos", *(F.col(f).cast("string").alias(f) if f == "price_annual" else f for f in _FIELDS))
    panel = V.panels(spark, sf).withColumn("price_annual", F.floor(F.col("price_annual")).cast("long")).groupBy("scenario_id").agg(F.array_sort(F.collect_list(item)).alias("options"))
    df = panel.join(context.enrich(V.risks(spark, sf)), "scenario_id")
    lines = F.transform("options", lambda x: J.option_line(x, _FIELDS))
    return df.select("scenario_id", J.prompt_text(["BUILDING:", F.concat(F.col("building_type"), F.lit(" "), F.col("postal_code")), "", "AVAILABLE TARIFFS:"], lines, _INSTRUCTION).alias("prompt"))


@query("prompts", "I5 I13", f"""WITH {V.PANELS}, {V.RISKS}, l AS (SELECT scenario_id, string_agg('{{"tariff_id": "' || tariff_id || '", "insurer": ' || insurer || ', "price_annual": "' || CAST(floor(price_annual) AS BIGINT) || '", "num_coverages": ' || num_coverages || '}}', chr(10) ORDER BY pos) AS lines FROM panel GROUP BY 1)
SELECT scenario_id, 'BUILDING:' || chr(10) || building_type || ' ' || postal_code || chr(10) || chr(10) || 'AVAILABLE TARIFFS:' || chr(10) || lines || chr(10) || chr(10) || '{_INSTRUCTION}' AS prompt FROM l JOIN risk USING (scenario_id)""")
def prompt_texts(spark, sf):
    return prompts(spark, sf)


@query("chat_rows", "I6 C12", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def chat_rows(spark, sf):
    df = J.messages(V.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m["content"]))
    return df.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), chars.alias("chars"))


@query("completions", "I8 I14", "SELECT conv_id, string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant') AS said, arg_max(text, turn) AS last FROM conversations GROUP BY 1")
def completions(spark, sf):
    df = J.messages(V.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    kind = lambda m: F.when(m["role"] == "assistant", "message").otherwise("reasoning")
    output = F.transform("messages", lambda m: F.struct(kind(m).alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), m["content"].alias("text"))).alias("content")))
    said = F.nullif(J.output_text(output), F.lit(""))
    none = F.lit(None).cast("struct<content:string>")
    return df.select("conv_id", said.alias("said"), J.completion_text(F.lit(None).cast("string"), none, F.col("messages")).alias("last"))


@query("reward_rows", "I7 C13 J26", f"WITH {FROZEN_SQL} SELECT scenario_id, count(*) >= 3 AS fine, string_agg(tariff_id || '=' || CAST(CAST(floor(reward * 1e4 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY tariff_id) AS rewards FROM scored GROUP BY 1")
def reward_rows(spark, sf):
    """Rows for preference training: rewards of all options, no label."""
    maps = scored(spark, sf, FROZEN).groupBy("scenario_id").agg(ranking.reward_map("tariff_id", "reward").alias("m"))
    shown = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1e4 + 0.5).cast("long").cast("string")))
    return maps.select("scenario_id", (F.cardinality("m") >= 3).alias("fine"), F.array_join(shown, ",").alias("rewards"))


@query("response_schema", "J14", f"""WITH {V.PANELS} SELECT scenario_id, '{{"type":"string","enum":[' || string_agg('"' || tariff_id || '"', ',' ORDER BY pos) || ']}}' AS id_schema FROM panel GROUP BY 1""")
def response_schema(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tariff_id"))), lambda x: x["tariff_id"])
    return V.panels(spark, sf).groupBy("scenario_id").agg(F.to_json(F.struct(F.lit("string").alias("type"), ids.alias("enum"))).alias("id_schema"))


@query("reconciled", "I15", f"{_TOP3} SELECT CASE WHEN scenario_id % 11 = 0 THEN 'missing' WHEN scenario_id % 13 = 0 THEN 'http' WHEN scenario_id % 5 IN (2, 4) THEN 'unparsed' END AS error, count(*) AS n FROM t GROUP BY 1")
def reconciled(spark, sf):
    texts = _texts(spark, sf)
    k = F.col("scenario_id")
    answers = texts.where(k % 11 != 0).select("scenario_id", "text", F.when(k % 13 == 0, 500).otherwise(200).alias("status"))
    df = evaluate.reconcile(texts.select("scenario_id"), answers, "scenario_id", "text", "status")
    return df.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("status_counts", "E8 H10", "WITH s AS (SELECT CASE WHEN c IS NULL THEN 'no_quotes' WHEN c < 3 THEN 'insufficient_quotes' ELSE 'success' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) SELECT " + ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in STATUSES) + " FROM s")
def status_counts(spark, sf):
    return statuses(spark, sf).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
