"""Micro panels with known answers, sources and sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import json_text as J
from rankloom.functions import scalars as S
from rankloom.operators import audit, calibrate, context, joins, profile, quality, ranking, scoring, splits
from rankloom.sources import readers, sinks

QUOTE = "scenario_id long, pos int, tariff_id string, price_annual double, insured_amount double, insured_unlimited boolean, deductible double, coverage_score double, num_coverages int"


def panel(spark, rows):
    return spark.createDataFrame([(1, i, f"t{i}", *r) for i, r in enumerate(rows)], QUOTE)


def test_flat_fields_are_neutral(spark):
    df = scoring.norms(panel(spark, [(100.0, 1000.0, False, 5.0, 1.0, 1), (200.0, 1005.0, False, 5.0, 1.0, 1), (300.0, None, True, 5.0, None, None)]))
    rows = df.orderBy("pos").collect()
    assert [r.n_insured for r in rows] == [r.n_deductible for r in rows] == [0.5] * 3
    assert [r.n_price_annual for r in rows] == [0.0, 0.5, 1.0]
    assert rows[2].insured == 1005.0 and rows[2].n_num_coverages == 0.0


def test_all_unlimited(spark):
    df = scoring.norms(panel(spark, [(1.0, None, True, 0.0, 0.0, 0)] * 3))
    assert {r.insured for r in df.collect()} == {1.0}


def test_ties_keep_order(spark):
    df = scoring.score(panel(spark, [(100.0, 10.0, False, 0.0, 0.0, 0)] * 4))
    assert [(r.tariff_id, r["rank"]) for r in df.orderBy("rank").collect()] == [(f"t{i}", i + 1) for i in range(4)]
    assert scoring.recommend(df).first().tariff_id == "t0"


def test_array_form_is_window_form(spark):
    rows = [(100.0 + 7 * i % 31, 1000.0 * (i % 4), i % 5 == 0, i % 3 * 1.0, i % 7 * 1.0, i % 2) for i in range(9)]
    w = scoring.Weights(0.2, 0.3, 0.1, 0.7, 0.4)
    df = panel(spark, rows)
    by_window = [r.tariff_id for r in scoring.score(df, w).orderBy("rank").collect()]
    by_array = scoring.panel_arrays(scoring.norms(df)).select(scoring.order_in_array(F.col("options"), w).alias("o")).first().o
    assert by_window == by_array


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("1.037,89", 1037.89), ("469.213902", 469.21), ("531,15", 531.15), ("", None), ("junk", None), (None, None)])
def test_german_numbers(spark, text, want):
    assert one(spark, S.german_number(F.lit(text).cast("string"))) == want


def test_fee_map_clips_and_drops(spark):
    assert one(spark, S.fee_map(F.lit("531.15;273.54;x;0;7"))) == {"annual": 531.15, "half_yearly": 273.54}
    assert one(spark, S.fee_map(F.lit("5"))) == {"annual": 5.0}


def test_scalars(spark):
    assert one(spark, S.insured_sum(F.lit(" Unbegrenzt"))[1]) is True and one(spark, S.insured_sum(F.lit(None).cast("string"))[0]) is None
    assert one(spark, S.sanitize(F.lit("GET https://h/p?q=1 id=7&pa=x token abc"), ("abc",))) == "GET https://h/p?[redacted] id=[redacted]&pa=[redacted] token [redacted]"
    assert one(spark, S.percent(F.lit(0.12345))) == "12.35%"
    assert one(spark, S.wilson(F.lit(0.0), F.lit(0.0))[0]) == 0.0
    low, high = (one(spark, x) for x in S.wilson(F.lit(188.0), F.lit(200.0)))
    assert (round(low, 4), round(high, 4)) == (0.8981, 0.9653)


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert profile.pearson(df, "x", "y").first().r is None
    assert profile.pearson(df, "y", "y").first().r == 1.0


def test_variation_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (2, 3), (2, 3)], "g int, v int")
    assert profile.variation(df, "g", ["v"]).first().varying == 1


def test_context_defaults(spark):
    df = spark.createDataFrame([(" 01234", None, None, None, 0, None)], "postal_code string, building_type string, construction_class string, construction_year int, dwelling_units int, owner_occupied boolean")
    c = context.enrich(df).first().risk_context
    assert c.hazard_exposure.flood_heavy_rain == "high" and c.building_age_years == 36 and c.construction_notes == [] and c.coverage_emphasis.natural_hazard == 0.9


def test_ranking_rewards(spark):
    m = F.create_map(*(F.lit(x) for x in ("a", 1.0, "b", 0.5, "c", 0.0)))
    ids = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, ranking.gain(ids("a", "b", "c"), m)) == 1.0
    assert one(spark, ranking.gain(ids("a", "a", "c"), m)) == 0.0 and one(spark, ranking.gain(ids("a", "b", "x"), m)) == 0.0
    assert one(spark, ranking.gain(ids("b", "a", "c"), m)) == pytest.approx(1.0 / 1.25)
    flat = F.create_map(*(F.lit(x) for x in ("a", 1.0, "b", 1.0, "c", 1.0)))
    assert one(spark, ranking.utilities(flat)) == {"a": 1.0, "b": 1.0, "c": 1.0}
    assert one(spark, ranking.top1_utility(ids("x"), m)) == 0.0 and one(spark, ranking.overlap(ids("a", "a"), ids("a", "b", "c"))) == 1 / 3
    right, all_ = ranking.concordance(ids("d", "a", "b", "c"), ids("a", "b", "c"))
    assert (one(spark, right), one(spark, all_)) == (3, 6)


STRICT = '{"top_3":[{"rank":1,"tariff_id":"a"},{"rank":2,"tariff_id":"b"},{"rank":3,"tariff_id":"c"}]}'


@pytest.mark.parametrize(
    ("text", "ids", "strict"),
    [
        (STRICT, ["a", "b", "c"], True),
        (f"Sure: {STRICT} bye", ["a", "b", "c"], False),
        (f"```json\n{STRICT}\n```", ["a", "b", "c"], False),
        (STRICT[:-1] + ',"x":1}', ["a", "b", "c"], False),
        (STRICT.replace('"rank":1', '"rank":"1"'), ["a", "b", "c"], False),
        (STRICT.replace('"b"', '"a"'), ["a", "a", "c"], False),
        (STRICT.replace('"b"', "2"), ["a", "2", "c"], False),
        ('{"recommendations": ["x", "y"]}', ["x", "y"], False),
        ('broken {"tariff_id": "q-1", "tariff_id":7', ["q-1", "7"], False),
        ('{"top_3":[]}', [], False),
        ("not json", [], False),
        ("", [], False),
    ],
)
def test_parsers(spark, text, ids, strict):
    got = one(spark, J.parse_strict(F.lit(text)))
    assert (got.ids, got.strict) == (ids, strict) and one(spark, J.parse_lenient(F.lit(text))) == ids


def test_checked_parser(spark):
    valid = F.array(*map(F.lit, "abc"))
    got = [tuple(one(spark, J.parse_checked(F.lit(t), valid))) for t in (STRICT, '{"top_3":[]}', "not json")]
    assert got == [(True, True, ["a", "b", "c"]), (True, False, []), (False, False, [])]


def test_splits_have_exact_sizes(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(20)], "id long, l string, m string")
    sizes = {"train": 12, "val": 5, "test": 3}
    for parts in (splits.systematic(df, "id", ["l", "m"], sizes, 1, "t"), splits.stratified(df, "id", ["l", "m"], sizes, 1, "t")):
        assert {r.split: r["count"] for r in parts.groupBy("split").count().collect()} == sizes
        assert parts.select("id").distinct().count() == 20
    folds = splits.folds(df, "id", ["l"], 3, 1)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [6, 7, 7]
    with pytest.raises(ValueError):
        splits.stratified(df, "id", ["l"], {"train": 3}, 1, "t")


def test_generated_risks_are_plausible_and_repeatable(spark):
    a = splits.generate_risks(spark, 60, 4)
    assert a.count() == a.select("scenario_id").distinct().count() == 60
    assert quality.violations(a, quality.risk_rules(), "scenario_id").count() == 0
    assert a.exceptAll(splits.generate_risks(spark, 60, 4)).count() == 0
    assert splits.generate_risks(spark, 60, 4, golden=a.limit(10)).join(a.limit(10), "scenario_id", "left_semi").count() == 0


def test_leaks_and_keys(spark):
    a, b = (spark.createDataFrame([(i,) for i in r], "k long") for r in (range(5), range(3, 8)))
    assert {(r.k, r.side) for r in joins.key_differences(a, b, "k").collect()} == {(0, "left"), (1, "left"), (2, "left"), (5, "right"), (6, "right"), (7, "right")}
    assert joins.resume(a, b, "k").count() == 8
    with pytest.raises(ValueError):
        quality.require_none(quality.duplicates(a.union(a), "k"), "duplicates")
    assert quality.schema_violations(a, ["k", "z"]) == ["missing:z"]
    docs = spark.createDataFrame([("xx secret yy",), ("clean",)], "t string")
    phrases = spark.createDataFrame([("secret",)], "p string")
    assert joins.containing(docs, phrases, "t", "p").count() == 1
    import random

    r = random.Random(3)
    texts = [(i, " ".join(r.choices(["a", "b", "cc", "d\ne", ""], k=r.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "a b"), (61, "a b")]
    some = [(j, t[r.randint(0, 5) :][: r.randint(1, 30)]) for j, (_, t) in enumerate(texts[:40])] + [(50, None), (51, "cc"), (52, "")]
    got = joins.containing(spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(some, "j long, p string"), "t", "p")
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((i, j) for i, t in texts for j, p in some if t is not None and p is not None and p in t)


def test_ids_caches_and_plans(spark):
    df = spark.createDataFrame([("s1", 1), (None, 2), (None, None)], "scenario_id string, id long")
    assert sorted(x[0] for x in df.where("scenario_id IS NOT NULL OR id IS NOT NULL").select(joins.record_id(df)).collect()) == ["2", "s1"]
    with pytest.raises(Exception, match="neither"):
        df.select(joins.record_id(df)).collect()
    asked, cache = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(Exception, match="not in the cache: 2"):
        joins.read_through(asked, cache, "k").collect()
    got = joins.read_through(asked, cache, "k", lambda m: m.withColumn("v", F.lit("new")))
    assert sorted(map(tuple, got.collect())) == [(1, "x", True), (2, "new", False)]
    with pytest.raises(ValueError, match="1 rows are over 1; the longest: 2: 2"):
        quality.require_lengths(spark.createDataFrame([(1, "a"), (2, "bb")], "k long, t string"), "k", F.length("t"), 1)


def test_numbering(spark):
    """Places in an order of dense runs, far values, ties and nulls, in many ranges."""
    values = [*range(300), *([10**12] * 50), *range(10**15, 10**15 + 200), None, None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(5)
    got = splits.numbered(df, "v", "n", rows=16).collect()
    known = sorted((x.n, x.v) for x in got if x.v is not None)
    assert [v for _, v in known] == sorted(v for v in values if v is not None) and [n for n, _ in known] == list(range(550))
    assert [x.n for x in got if x.v is None] == [None, None]
    assert splits.numbered(df.limit(0), "v", "n").count() == 0
    ranked = splits.hash_rank(df.where("v IS NOT NULL"), "i", 3, "t", rows=8)
    assert [x.i for x in ranked.orderBy("place").collect()] == [x.i for x in df.where("v IS NOT NULL").orderBy(F.sha2(F.concat(F.lit("3:t:"), F.col("i").cast("string")), 256)).collect()]


def test_splits_keep_every_label(spark):
    import random

    r = random.Random(6)
    rows = [(i, r.choice("aab"), r.choice(["x", "y", None]), r.choice("pqrstu")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, l string, m string, o string")
    sizes = {"train": 300, "val": 150, "test": 50}
    got = splits.stratified(df, "id", ["l", "m", "o"], sizes, 1, "t").collect()
    assert {s: sum(x.split == s for x in got) for s in sizes} == sizes and len({x.id for x in got}) == 500
    for c in "lmo":
        for v in {x[c] for x in got}:
            n = sum(x[c] == v for x in got)
            assert all(abs(sum(x[c] == v and x.split == s for x in got) - n * z / 500) < 1 for s, z in sizes.items())
    parts = splits.two_stage(df, "id", ["l", "o"], sizes, {"train": {"fit": 270, "check": 30}}, 1, "t")
    assert {x.split: x["count"] for x in parts.groupBy("split").count().collect()} == {"fit": 270, "check": 30, "val": 150, "test": 50}


def test_frozen_weights():
    own = {"w_cov": 0.4, "w_ins": 0.3, "w_ded": 0.3, "w_price": 0.5, "w_score": 0.0}
    assert calibrate.frozen({"status": "frozen", "weights": own}).price == 0.5
    for bad in ({"status": "draft", "weights": own}, {"status": "frozen"}, {"status": "frozen", "weights": own | {"x": 1}}, {"status": "frozen", "weights": own | {"w_cov": 0.41}}):
        with pytest.raises(ValueError):
            calibrate.frozen(bad)


@pytest.mark.parametrize(("path", "ok"), [("../escape.json", False), ("cache/quote.json", False), ("data/golden.jsonl", False), ("runpod/archive.tar", False), ("evaluation/golden.jsonl", True), ("data/train.jsonl", True)])
def test_release_paths(spark, path, ok):
    assert one(spark, audit.allowed_path(F.lit(path))) is ok


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    path = str(tmp_path / "rows")
    sinks.write_jsonl(df, path, single=True)
    assert sorted(map(tuple, readers.read_jsonl(spark, path, "id long, t string").collect())) == [(1, "a"), (2, None)]
    assert readers.read_jsonl_lenient(spark, str(tmp_path / "none"), "id long").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\nnope\n[1]\n')
    assert readers.bad_lines(spark, str(tmp_path / "bad.jsonl")).count() == 2
    assert sorted((x.line, x.value) for x in readers.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()) == [(3, "nope"), (4, "[1]")]
    with pytest.raises(ValueError, match="bad.jsonl:3: not a JSON object: nope"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long")
    (tmp_path / "blank.jsonl").write_text("\n\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_jsonl(spark, str(tmp_path / "blank.jsonl"), "id long")
    sinks.write_jsonl(df.limit(1), path)
    assert readers.read_jsonl(spark, path, "id long, t string").count() == 1 and [x.name for x in tmp_path.iterdir() if x.name.startswith("rows")] == ["rows"]
    with pytest.raises(ValueError):
        sinks.write_jsonl(df, path, single=True, most=1)
    with pytest.raises(PermissionError):
        sinks.check_path(f"file://{tmp_path}/safe/deep/x.json", (str(tmp_path / "safe"),))
    sinks.check_path(f"{tmp_path}/safer/x.json", (str(tmp_path / "safe"),))
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "k1.json").write_text('{"id": 5}')
    (cache / "k2.json").write_text("{broken")
    assert [(r.key, r.id) for r in readers.read_keyed(spark, str(cache), "id long").collect()] == [("k1", 5)]
    sinks.write_document(str(tmp_path / "doc.json"), {"b": 1, "a": [2]})
    assert json.loads((tmp_path / "doc.json").read_text()) == {"a": [2], "b": 1}
    with pytest.raises(PermissionError):
        sinks.write_csv(df, str(tmp_path / "golden_set"))
    sinks.write_csv(df, str(tmp_path / "table"))
    assert readers.read_csv(spark, str(tmp_path / "table"), "id long, t string").count() == 2
    import hashlib

    assert audit.directory_hash(str(cache)) == hashlib.sha256(b'k1.json{"id": 5}k2.json{broken').hexdigest()
    files = spark.createDataFrame([("src/a",), ("src/a",), ("srcs/b",), ("src/cache/c",), ("one",)], "path string")
    assert [x.path for x in audit.selected(files, ["src", "one"], ["cache"]).collect()] == ["one", "src/a"]
    sums = audit.checksums(spark, str(cache))
    assert audit.mismatches(sums, sums).count() == 0 and audit.mismatches(sums.limit(1), sums).count() == 1
    raw = spark.createDataFrame([("x1", " A ", "T", "1.037,89", None, "unbegrenzt", None, "531.15;0", "JA", "nein", "88"), ("", "A", "T", "5", *[None] * 7), ("x2", "A", "T", "0", *[None] * 7)], readers.RAW)
    row = readers.normalise_raw(raw).collect()
    assert len(row) == 1 and (row[0].price_annual, row[0].insured_unlimited, row[0].num_coverages, row[0].deductible) == (1037.89, True, 1, 0)


def test_search_finds_the_label_weights(spark):
    """Labels made by one candidate: the search ranks it first, permuted labels don't."""
    import random

    r = random.Random(0)
    rows = [(s, i, f"{s}-{i}", r.uniform(100, 400), r.choice([None, 1e5, 2e5, 3e5]), False, float(r.choice([0, 150])), float(r.randrange(60, 100)), r.randrange(3)) for s in range(40) for i in range(6)]
    quotes = spark.createDataFrame(rows, QUOTE)
    cands = calibrate.candidates(spark, 30, 5)
    w = next(c.w for c in cands.collect() if c.id == 4)
    best = scoring.score(quotes, scoring.Weights(w.cov, w.ins, w.ded, w.price, w["score"]))
    teachers = ranking.top_ids(best.where("rank <= 3"))
    panels = scoring.panel_arrays(scoring.norms(quotes)).withColumn("fold", F.col("scenario_id") % 5)
    sums = calibrate.evaluate(panels.join(teachers, "scenario_id"), cands)
    first = calibrate.ranked(sums, cands).where("rank = 1").first()
    assert (first.id, first.top1, first.top3, first.pairs) == (4, 40, 120, first.constraints)
    assert {(x.id, x.top1) for x in calibrate.cross_validated(sums, cands).collect()} == {(4, 8)}
    control = calibrate.evaluate(panels.join(calibrate.permuted(quotes, 1), "scenario_id"), cands)
    assert calibrate.control_passes(calibrate.cross_validated(control, cands), panels, slack=0.25).first().passes
