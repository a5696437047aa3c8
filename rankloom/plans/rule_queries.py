"""Queries on scalars, context, data rules, joins and key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import json_text as J
from rankloom.functions import scalars as S
from rankloom.operators import audit, context, joins, lineage, quality, splits
from rankloom.plans import views as V
from rankloom.plans.panel_queries import SCORED, scored
from rankloom.registry import query
from rankloom.sources import readers, sinks
from rankloom.sources.versioned import Refused, Versioned, fetch_once

_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
FLOOD = f"CASE WHEN substr(trim(postal_code), 1, 2) IN {_in(context.FLOOD_HIGH)} THEN 'high' WHEN substr(trim(postal_code), 1, 2) IN {_in(context.FLOOD_ELEVATED)} THEN 'elevated' ELSE 'moderate' END"
HAIL = f"CASE WHEN substr(trim(postal_code), 1, 2) IN {_in(context.HAIL_BELT)} THEN 'elevated' ELSE 'moderate' END"
_MONEY = "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'n/a' WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) || '.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') ELSE CAST(p_partkey AS VARCHAR) || '.' || lpad(CAST(p_size AS VARCHAR), 3, '0') END"


def _money():
    two = lambda n, k: F.lpad((F.col("p_partkey") % n).cast("string"), k, "0")
    k = F.col("p_partkey")
    return F.when(k % 7 == 0, "").when(k % 7 == 1, "n/a").when(k % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("."), two(1000, 3), F.lit(","), two(100, 2))).otherwise(F.concat(k.cast("string"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 3, "0")))


@query("german_numbers", "B1 B20 A9", f"SELECT p_partkey, floor(TRY_CAST(CASE WHEN contains(s, ',') THEN replace(replace(s, '.', ''), ',', '.') ELSE s END AS DOUBLE) * 100 + 0.5) / 100 AS amount FROM (SELECT p_partkey, {_MONEY} AS s FROM part)")
def german_numbers(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.german_number(_money()).alias("amount"))


@query("insured_sums", "B2 A9", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 AND p_size % 4 <> 0 THEN CAST(p_partkey * 1000 AS BIGINT) END AS insured_amount, p_size % 5 = 0 AS insured_unlimited FROM part")
def insured_sums(spark, sf):
    p = V.table(spark, sf, "part")
    raw = F.when(F.col("p_size") % 5 == 0, " Unbegrenzt").when(F.col("p_size") % 4 != 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".000,00")))
    amount, unlimited = S.insured_sum(raw)
    return p.select("p_partkey", amount.alias("insured_amount"), unlimited.alias("insured_unlimited"))


@query("fee_maps", "B3", """WITH f AS (SELECT p_partkey, unnest(['annual', 'half_yearly', 'quarterly', 'monthly']) AS frequency, unnest([p_retailprice, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice / 2 END, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice / 4 END, p_retailprice / 12]) AS fee FROM part)
SELECT p_partkey, frequency, floor(fee * 100 + 0.5) / 100 AS fee FROM f WHERE fee > 0""")
def fee_maps(spark, sf):
    price, size = F.col("p_retailprice"), F.col("p_size")
    parts = [price.cast("string"), F.when(size % 3 == 0, "0").otherwise((price / 2).cast("string")), F.when(size % 4 == 0, "x").otherwise((price / 4).cast("string")), (price / 12).cast("string"), F.lit("9")]
    return V.table(spark, sf, "part").select("p_partkey", F.explode(S.fee_map(F.concat_ws(";", *parts))).alias("frequency", "fee"))


@query("yes_flags", "B4", "SELECT c_custkey, c_custkey % 3 = 0 AS flag FROM customer")
def yes_flags(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, " JA ").when(F.col("c_custkey") % 3 == 1, "nein")
    return V.table(spark, sf, "customer").select("c_custkey", S.yes(raw).alias("flag"))


#: Wire names of public values: fixed values.
TYPES_WIRE = {"single-family": "Einfamilienhaus", "two-family": "Zweifamilienhaus", "multi-family": "Mehrfamilienhaus", "semi-detached": "Doppelhaushälfte", "terraced": "Reihenhaus"}
ROOFS_WIRE = {"gable": "Giebeldach", "flat": "Flachdach", "other": "Sonstiges"}
_sqlcase = lambda c, d: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"


@query("wire_parameters", "B5 J25", f"WITH {V.RISKS} SELECT scenario_id, postal_code AS plz, {_sqlcase('building_type', TYPES_WIRE)} AS gebaeude, substr(construction_class, 1, 3) || ' ' || substr(construction_class, 4) AS bauart, CAST(construction_year AS VARCHAR) AS baujahr, {_sqlcase('roof_type', ROOFS_WIRE)} AS dachart, CASE WHEN owner_occupied THEN 'ja' ELSE 'nein' END AS selbstgenutzt, CASE WHEN {FLOOD} IN ('high', 'elevated') THEN '0' END AS schaeden_anz FROM risk")
def wire_parameters(spark, sf):
    df = context.enrich(context.with_defaults(V.risks(spark, sf)))
    ja = lambda c: F.when(c, "ja").otherwise("nein")
    natural = context.cover_policy()["natural_hazard"]
    return df.select("scenario_id", F.col("postal_code").alias("plz"), S.mapped(F.col("building_type"), TYPES_WIRE).alias("gebaeude"), F.regexp_replace("construction_class", "^(...)", "$1 ").alias("bauart"), F.col("construction_year").cast("string").alias("baujahr"), S.mapped(F.col("roof_type"), ROOFS_WIRE).alias("dachart"), ja(F.col("owner_occupied")).alias("selbstgenutzt"), F.when(natural, "0").alias("schaeden_anz"))


_NOTES = context.NOTES


@query("risk_context", "B6 B7 B8 B15 J8", f"""WITH {V.RISKS} SELECT scenario_id, {FLOOD} AS flood, {HAIL} AS hail, construction_year <= 2000 AS surge, 2026 - construction_year AS age,
  concat_ws('|', CASE WHEN 2026 - construction_year >= 60 THEN '{_NOTES["old"]}' END, CASE WHEN construction_class IN ('FHG2', 'FHG3') THEN '{_NOTES["timber"]}' END, CASE WHEN dwelling_units >= 3 THEN '{_NOTES["units"]}' END, CASE WHEN NOT owner_occupied THEN '{_NOTES["rented"]}' END) AS notes,
  CAST(CASE {FLOOD} WHEN 'high' THEN 0.9 WHEN 'elevated' THEN 0.6 ELSE 0.25 END AS DOUBLE) AS natural_hazard, CAST(CASE WHEN building_type IN ('multi-family', 'two-family') THEN 0.5 ELSE 0.3 END AS DOUBLE) AS glass, {FLOOD} IN ('high', 'elevated') AS cover_natural_hazard FROM risk""")
def risk_context(spark, sf):
    c = lambda x: F.col(f"risk_context.{x}")
    df = context.enrich(V.risks(spark, sf))
    return df.select("scenario_id", c("hazard_exposure.flood_heavy_rain").alias("flood"), c("hazard_exposure.storm_hail").alias("hail"), c("hazard_exposure.surge_overvoltage_relevant").alias("surge"), c("building_age_years").alias("age"), F.array_join(c("construction_notes"), "|").alias("notes"), c("coverage_emphasis.natural_hazard").alias("natural_hazard"), c("coverage_emphasis.glass").alias("glass"), context.cover_policy()["natural_hazard"].alias("cover_natural_hazard"))


@query("bands", "B9 B10", f"WITH {V.RISKS}, n AS (SELECT l_orderkey AS scenario_id, count(*) AS c FROM lineitem GROUP BY 1) SELECT scenario_id, CASE WHEN construction_year <= 1959 THEN 'old' WHEN construction_year <= 1994 THEN 'middle' ELSE 'modern' END AS age_band, CASE WHEN c <= 5 THEN '4-5' WHEN c <= 7 THEN '6-7' ELSE '8-9' END AS count_band FROM risk JOIN n USING (scenario_id) WHERE c >= 4")
def bands(spark, sf):
    n = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scenario_id")).agg(F.count(F.lit(1)).alias("c")).where("c >= 4")
    return V.risks(spark, sf).join(n, "scenario_id").select("scenario_id", S.age_band(F.col("construction_year")).alias("age_band"), S.count_band(F.col("c")).alias("count_band"))


CANONICAL = """'{"attic_status":"' || attic_status || '","building_type":"' || building_type || '","construction_class":"' || construction_class || '","construction_year":' || construction_year || ',"dwelling_units":' || dwelling_units || ',"living_space_sqm":' || living_space_sqm || ',"owner_occupied":' || CASE WHEN owner_occupied THEN 'true' ELSE 'false' END || ',"postal_code":"' || postal_code || '","rebuild_sum":' || rebuild_sum || ',"roof_type":"' || roof_type || '","with_deductible":' || CASE WHEN with_deductible THEN 'true' ELSE 'false' END || '}'"""


@query("content_ids", "B11 B12 B14 J20 J4", f"WITH {V.RISKS} SELECT scenario_id, {CANONICAL} AS canonical, sha256({CANONICAL}) AS content_id FROM risk")
def content_ids(spark, sf):
    return V.risks(spark, sf).select("scenario_id", S.canonical_json(quality.RISK_FIELDS).alias("canonical"), S.content_id(quality.RISK_FIELDS).alias("content_id"))


@query("stable_hashes", "B13 F11 G10", "SELECT o_orderkey, sha256('42:output:' || o_orderkey) AS h, row_number() OVER (ORDER BY sha256('42:output:' || o_orderkey), o_orderkey) - 1 AS place FROM orders")
def stable_hashes(spark, sf):
    """All rows with their hash and place in the seeded order."""
    o = V.table(spark, sf, "orders").select("o_orderkey", S.stable_hash(42, "output", F.col("o_orderkey")).alias("h"))
    return splits.hash_rank(o, "o_orderkey", 42, "output")


@query("sanitized_errors", "B18 B19", r"""SELECT event_id, substr('GET https://x.example/a?[redacted] ID=[redacted]&pa=[redacted] ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' Timed Out' ELSE '' END, 1, 500) AS message, event_id % 3 = 0 AS transient FROM events""")
def sanitized_errors(spark, sf):
    raw = F.concat(F.lit("GET https://x.example/a?k="), F.col("event_id").cast("string"), F.lit(" ID="), F.col("user_id").cast("string"), F.lit("&pa=secret "), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, " Timed Out").otherwise(""))
    return V.table(spark, sf, "events").select("event_id", S.sanitize(raw).alias("message"), S.transient(raw).alias("transient"))


_RULES = [("enum_" + c, f"{c} IN {_in(v)}") for c, v in quality.ENUMS.items()] + [
    ("year", "construction_year BETWEEN 1900 AND 2020"),
    ("units", "dwelling_units >= 1 AND CASE building_type WHEN 'single-family' THEN dwelling_units = 1 WHEN 'two-family' THEN dwelling_units = 2 WHEN 'multi-family' THEN dwelling_units BETWEEN 3 AND 8 ELSE dwelling_units IN (1, 2) END"),
    ("rebuild_sum", "rebuild_sum BETWEEN 40000 AND 3000000 AND rebuild_sum / living_space_sqm BETWEEN 800 AND 5000"),
]


@query("risk_violations", "C2 C3 C4 C5 J3", f"WITH {V.RISKS} " + " UNION ALL ".join(f"SELECT scenario_id, '{n}' AS rule FROM risk WHERE NOT ({c})" for n, c in _RULES))
def risk_violations(spark, sf):
    return quality.violations(V.risks(spark, sf), quality.risk_rules(), "scenario_id")


@query("json_key_check", "C1", "SELECT event_id, 'n' AS missing, 'k' AS extra FROM events")
def json_key_check(spark, sf):
    missing, extra = quality.json_key_violations(F.col("props"), ["n"])
    return V.table(spark, sf, "events").select("event_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


@query("batch_check", "C6 J2", f"WITH {V.RISKS}, c AS (SELECT *, {CANONICAL} AS j FROM risk), g AS (SELECT DISTINCT j FROM c WHERE scenario_id % 10 = 0) SELECT count(*) AS n, count(DISTINCT sha256(j)) AS n_ids, count(CASE WHEN j IN (SELECT j FROM g) THEN 1 END) AS collisions, count(DISTINCT {FLOOD}) AS hazards, count(DISTINCT CASE WHEN construction_year <= 1959 THEN 1 WHEN construction_year <= 1994 THEN 2 ELSE 3 END) AS ages FROM c")
def batch_check(spark, sf):
    df = V.risks(spark, sf).withColumn("content_id", S.content_id(quality.RISK_FIELDS))
    golden = df.where("scenario_id % 10 = 0").select("content_id").distinct().withColumn("golden", F.lit(True))
    return df.join(golden, "content_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_id").alias("n_ids"), F.count("golden").alias("collisions"), F.count_distinct(context.flood_tier(F.col("postal_code"))).alias("hazards"), F.count_distinct(S.age_band(F.col("construction_year"))).alias("ages"))


@query("output_audit", "C7", f"""WITH {SCORED}, x AS (SELECT *, lag(reward) OVER (PARTITION BY scenario_id ORDER BY pos) AS b FROM scored)
SELECT 'unsorted' AS problem, count(*) AS n FROM x WHERE reward > b UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT scenario_id, tariff_id FROM scored GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'status', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT scenario_id FROM panel)) UNION ALL SELECT 'credentials', count(*) FROM documents WHERE regexp_matches(text, '(?i)(token|api_key|password)\\s*=')""")
def output_audit(spark, sf):
    s = scored(spark, sf)
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    unsorted = quality.unsorted_rows(s, "scenario_id", "pos", "reward")
    twice = s.groupBy("scenario_id", "tariff_id").count().where("count > 1")
    failed = V.table(spark, sf, "orders").join(s.select(F.col("scenario_id").alias("o_orderkey")), "o_orderkey", "left_anti")
    leaks = V.table(spark, sf, "documents").where(F.col("text").rlike(r"(?i)(token|api_key|password)\s*="))
    return count(unsorted, "unsorted").unionByName(count(twice, "duplicate_ids")).unionByName(count(failed, "status")).unionByName(count(leaks, "credentials"))


@query("panel_check", "C8 C11", f"WITH {V.QUOTES} SELECT scenario_id, count(*) AS n, count(*) >= 3 AND count(DISTINCT tariff_id) = count(*) AS fine FROM q GROUP BY 1")
def panel_check(spark, sf):
    ids = F.collect_list("tariff_id")
    df = V.quotes(spark, sf).groupBy("scenario_id").agg(ids.alias("ids"))
    return df.select("scenario_id", F.size("ids").cast("long").alias("n"), ((F.size("ids") >= 3) & (F.size("ids") == F.size(F.array_distinct("ids")))).alias("fine"))


@query("annotation_check", "C9 F14", f"WITH {V.PANELS}, {V.TEACHERS} SELECT t.scenario_id, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) = '1,2,3' AND count(DISTINCT t.tariff_id) = 3 AND count(p.tariff_id) = 3 AS fine FROM teacher t LEFT JOIN panel p ON p.scenario_id = t.scenario_id AND p.tariff_id = t.tariff_id GROUP BY 1")
def annotation_check(spark, sf):
    top = V.teachers(spark, sf).groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tariff_id"))).alias("t"))
    offered = V.panels(spark, sf).groupBy("scenario_id").agg(F.collect_list("tariff_id").alias("offered"))
    ids = F.transform("t", lambda x: x["tariff_id"])
    fine = (F.transform("t", lambda x: x["rank"]) == F.array(*map(F.lit, (1, 2, 3)))) & (F.size(F.array_distinct(ids)) == 3) & (F.size(F.array_except(ids, "offered")) == 0)
    return top.join(offered, "scenario_id").select("scenario_id", fine.alias("fine"))


@query("cache_lookup", "A6 C10", "SELECT o.o_orderkey, o.o_orderstatus IN ('F', 'O') AND o.o_orderkey % 4 <> 0 AS hit FROM orders o")
def cache_lookup(spark, sf):
    o = V.table(spark, sf, "orders")
    cache = o.where("o_orderkey % 4 <> 0").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", F.lit(True).alias("hit"))
    hits, misses = joins.resolve_cache(o.select("o_orderkey"), cache, "o_orderkey")
    return hits.unionByName(misses.withColumn("hit", F.lit(False)))


@query("length_audit", "C14 J19", "SELECT doc_id, length(text) AS n, length(text) + 500 > 2000 AS over FROM documents ORDER BY n DESC, doc_id LIMIT 5")
def length_audit(spark, sf):
    """The five longest texts, a report."""
    n = F.length("text").cast("long")
    return V.table(spark, sf, "documents").select("doc_id", n.alias("n"), (n + 500 > 2000).alias("over")).orderBy(F.desc("n"), "doc_id").limit(5)


@query("length_summary", "C14 J19", "SELECT count(text) AS n_texts, " + ", ".join(f"floor(quantile_cont(length(text), {p / 100}) * 1e4 + 0.5) / 1e4 AS p{p}" for p in (50, 90, 95, 99)) + ", max(length(text)) AS longest, count(CASE WHEN length(text) + 500 > 2000 THEN 1 END) AS n_over FROM documents")
def length_summary(spark, sf):
    """Percentiles of all texts' lengths and how many are over the limit, one row."""
    return quality.length_summary(V.table(spark, sf, "documents"), F.length("text").cast("long"), 1500)


@query("label_join", "D1 D2", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) l ON d.doc_id = l.doc_id WHERE l.doc_id NOT IN (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)")
def label_join(spark, sf):
    labels = V.table(spark, sf, "labels")
    once = labels.join(quality.duplicates(labels, "doc_id"), "doc_id", "left_anti")
    return joins.attach(V.table(spark, sf, "documents").select("doc_id", "source"), once, "doc_id", "label").select("doc_id", "source", "label.quality", "label.toxic")


@query("label_join_default", "D4 B16", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_join_default(spark, sf):
    return joins.attach_or_default(V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", {"quality": -1, "toxic": 0})


@query("key_differences", "D3", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def key_differences(spark, sf):
    return joins.key_differences(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"), "doc_id")


@query("fresh_candidates", "D5", "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def fresh_candidates(spark, sf):
    golden = V.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    firsts = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return joins.fresh_only(firsts, golden, "o_custkey").select("o_orderkey", "o_custkey")


@query("partition_proof", "D6 D7", "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS foreign_keys FROM orders")
def partition_proof(spark, sf):
    o = V.table(spark, sf, "orders")
    parts = {k: o.where(f"o_orderkey % 3 = {k}") for k in range(3)}
    return joins.partition_proof(parts, o, "o_orderkey").withColumnRenamed("foreign", "foreign_keys")


@query("merged_shards", "D8 F13", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS source_index, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS shard FROM orders")
def merged_shards(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey")
    manifest = splits.numbered(o, "o_orderkey", "source_index")
    shards = [o.where(f"o_orderkey % 2 = {k}") for k in range(2)]
    return joins.merge_shards(shards, manifest, "o_orderkey", "source_index").withColumn("shard", F.floor(F.col("source_index") / 100))


@query("shard_plan", "J27 F13", "WITH p AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard, CAST(ceil(coalesce(length(text), 0) / 3.0e0) AS BIGINT) AS tokens FROM documents) SELECT shard, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, floor(sum(tokens) / 1e6 * 1.25e0 * 1e6 + 0.5) / 1e6 AS cost FROM p GROUP BY 1")
def shard_plan(spark, sf):
    """Shards of 100 documents in order, with an estimate of their tokens and cost."""
    d = splits.numbered(V.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "place")
    return joins.shard_plan(d, "place", J.token_estimate(F.col("text")), 100, 1.25)


@query("resumed", "D9", "SELECT o_orderkey, sum(CAST(o_orderkey % 7 AS BIGINT)) OVER (ORDER BY o_orderkey) AS spent FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) QUALIFY spent <= 1000")
def resumed(spark, sf):
    """New rows that a budget of 1000 pays for, in order."""
    o = V.table(spark, sf, "orders")
    todo = o.join(o.where("o_orderkey % 5 = 0").select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey", (F.col("o_orderkey") % 7).alias("cost"))
    return joins.within_budget(todo, "o_orderkey", "cost", 1000).select("o_orderkey", "spent")


@query("phrase_leaks", "D13", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def phrase_leaks(spark, sf):
    phrases = V.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return joins.containing(V.table(spark, sf, "documents").select("doc_id", "text"), phrases, "text", "phrase").select("doc_id", "item_id")


@query("path_policy", "J28", "SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 1 AS allowed FROM part")
def path_policy(spark, sf):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, "data/train.jsonl").when(k % 4 == 1, "evaluation/golden.jsonl").when(k % 4 == 2, "../escape.json").otherwise("Cache/quote.json")
    return V.table(spark, sf, "part").select("p_partkey", audit.allowed_path(path).alias("allowed"))


@query("golden_names", "D12", "SELECT o_orderkey AS scenario_id, o_orderstatus AS teacher_top3 FROM orders")
def golden_names(spark, sf):
    return joins.golden_names(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("fable_top3")))


@query("record_ids", "J1", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS record_id FROM orders")
def record_ids(spark, sf):
    """One id or the other; a row with neither fails the job."""
    k = F.col("o_orderkey")
    df = V.table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("scenario_id"), F.col("o_custkey").alias("id"))
    return df.select("o_orderkey", joins.record_id(df).alias("record_id"))


@query("read_through", "J10 H10", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus ELSE 'fetched' END AS status, o_orderkey % 4 <> 0 AS cached FROM orders")
def read_through(spark, sf):
    """Cached answers, and fetched ones for what misses."""
    o = V.table(spark, sf, "orders")
    cache = o.where("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return joins.read_through(o.select("o_orderkey"), cache, "o_orderkey", lambda misses: misses.withColumn("status", F.lit("fetched")))


@query("kept_cache", "J10 A6 H10", "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS run FROM orders")
def kept_cache(spark, sf):
    """The cache after two runs: the second fetches what the first hadn't, and a third finds no miss."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    cache = Versioned(spark, lineage.scratch(spark, "cache"))

    def run(requests, number):
        def fetch(misses):
            return misses.join(o, "o_orderkey").withColumn("run", F.lit(number))

        return fetch_once(requests.select("o_orderkey"), cache, "o_orderkey", fetch, "o_orderkey long, status string, run int")

    run(o.where("o_orderkey % 3 = 0"), 1)
    run(o, 2)
    return run(o, 3)


@query("committed_rows", "A4 C14 C15 A7", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def committed_rows(spark, sf):
    """A table of which only a version is read whose rows keep their rules: a later one is refused, with its job."""
    c = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    path, rules = lineage.scratch(spark, "customers"), {"balance": F.col("c_acctbal") >= 0, "name": F.length("c_name") <= 30}
    sinks.write_csv(c.where("c_acctbal >= 0"), path, rules)
    try:
        sinks.write_csv(c, path, rules)
        raise AssertionError("rows with a negative balance were committed")
    except Refused as e:
        if set(e.broken) != {"balance"}:
            raise
    return readers.read_csv(spark, path, c.schema)


@query("file_checksums", "K1 K3", "SELECT 'customers' AS name, sha256(string_agg('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' || chr(10), '' ORDER BY c_custkey)) AS sha256, CAST(1 AS BIGINT) AS n_differing FROM customer")
def file_checksums(spark, sf):
    """The checksum of all customers written as one file, and how many files of a manifest that names one more are missing."""
    path = lineage.scratch(spark, "export")
    rows = V.table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey")
    sinks.write_jsonl(rows, path, single=True)
    sums = audit.checksums(spark, Versioned(spark, path).folders()[0]).where(F.col("path").like("%.json"))
    manifest = sums.unionByName(sums.withColumn("path", F.concat("path", F.lit(".gone"))))
    differing = audit.mismatches(sums, manifest).agg(F.count(F.lit(1)).alias("n_differing"))
    return sums.select(F.lit("customers").alias("name"), "sha256").crossJoin(F.broadcast(differing))  # one row


@query("broken_lines", "A1 A2 A3", "SELECT row_number() OVER (ORDER BY o_orderkey) AS line, o_orderkey FROM orders QUALIFY o_orderkey % 1000 = 7")
def broken_lines(spark, sf):
    """Line numbers of what is no JSON object in a file of all orders, some of whose lines are broken; ranges of 64 kB."""
    k, path = F.col("o_orderkey"), lineage.scratch(spark, "lines")
    good = F.to_json(F.struct(k, "o_orderstatus"))
    rows = V.table(spark, sf, "orders").orderBy(k).select(F.when(k % 1000 == 7, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(good).alias("value"))
    rows.coalesce(1).write.text(path)
    return readers.bad_lines(spark, path, 1 << 16).select("line", F.regexp_extract("value", "[0-9]+", 0).cast("long").alias("o_orderkey"))


@query("bundle_files", "J29", "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'data/' WHEN 1 THEN 'src/cache/' ELSE 'src/' END || p_brand AS path FROM part WHERE p_size % 3 = 2")
def bundle_files(spark, sf):
    k = F.col("p_size") % 3
    path = F.concat(F.when(k == 0, "data/").when(k == 1, "src/cache/").otherwise("src/"), F.col("p_brand"))
    return audit.selected(V.table(spark, sf, "part").select(path.alias("path")), ["src"], ["cache"])


@query("raw_options", "A9 A10", "SELECT CAST(event_id AS VARCHAR) AS tariff_id, floor(CAST(user_id AS DOUBLE) * 100 + 0.5) / 100 AS price_annual FROM events WHERE event_id % 3 <> 0 AND user_id > 0")
def raw_options(spark, sf):
    """Raw options as a source gives them, typed, without those that have no id or no price."""
    from pyspark.sql import types as T

    k = F.col("event_id")
    given = {"id": F.when(k % 3 != 0, k.cast("string")), "gesellschaft": F.lit(" x "), "tarif": F.lit("y"), "jahresbeitrag": F.concat(F.col("user_id").cast("string"), F.lit(",00"))}
    names = T._parse_datatype_string(readers.RAW).names
    raw = V.table(spark, sf, "events").select(*(given.get(c, F.lit(None).cast("string")).alias(c) for c in names))
    return readers.normalise_raw(raw).select("tariff_id", S.half_up(F.col("price_annual"), 2).alias("price_annual"))
