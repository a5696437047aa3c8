"""Queries that cover whole tables, and searches against the SQL over all candidates."""

from __future__ import annotations

import pytest

from rankloom import registry
from rankloom.operators import calibrate
from rankloom.plans import evaluation_queries

SF = "/root/testdata/sf0.001"


def by_sql(sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "events", "benchmark", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["wilson_intervals", "utilisation_cost", "cross_validation", "merged_shards", "stable_hashes", "rescored_ids", "length_summary", "shard_plan", "read_through", "record_ids", "bundle_files", "raw_options", "phrase_leaks", "generated_risks", "iterative_split_sizes", "two_stage_split_sizes", "stratified_margins", "option_statistics", "dataset_summary", "kept_cache", "kept_sums", "committed_rows", "file_checksums", "broken_lines", "calibration_totals", "permutation_control"])
def test_against_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns, want = by_sql(registry.SQL[name])
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))


def test_calibration_against_sql(spark):
    """The ten best of 500 candidates, with the same candidates as rows of the SQL."""
    cands = calibrate.candidates(spark, 500, 17).collect()
    rows = ", ".join(f"({c.id}, " + ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in (c.w.price, c.w.cov, c.w.ins, c.w.ded, c.w["score"])) + f", CAST('{c.distance!r}' AS DOUBLE))" for c in cands if c.id < 40)
    search = evaluation_queries.SEARCH.replace(evaluation_queries._cands(enumerate(calibrate.ANCHORS)), f"w(id, w_price, w_cov, w_ins, w_ded, w_score, distance) AS (VALUES {rows})")
    _, want = by_sql(f"WITH {search} SELECT id, sum(n), sum(top1), sum(top3), sum(pairs) FROM sums GROUP BY 1")
    sums = calibrate.evaluate(evaluation_queries.folded(spark, SF), calibrate.candidates(spark, 500, 17).where("id < 40"))
    got = calibrate.ranked(sums, calibrate.candidates(spark, 500, 17)).select("id", "n", "top1", "top3", "pairs").collect()
    assert sorted(map(tuple, got)) == sorted(want)
