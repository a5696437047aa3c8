"""The corpus pipeline, stage by stage, against brute force on its own inputs."""

from __future__ import annotations

import corpus_pipeline
from tokenizers import Tokenizer

from rankloom.llm.queries import tokenizer_path

from .test_jaccard import brute
from .test_text_rules import contaminated, measures, without_passages


def test_stages(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(90_001, None, "en", "src1", 0), (90_002, "too short", "en", "src1", 9)], docs.schema))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{src}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        before = [(r.doc_id, r.text) for r in now.collect()]
        if k < 4:
            assert out.dtypes == now.dtypes
            after = {r.doc_id: r for r in out.collect()}
            assert len(after) == out.count()
        if k == 0:
            m = {i: measures(t) for i, t in before}
            assert set(after) == {i for i, x in m.items() if x[0] >= 10 and 100 * x[4] <= 20 * x[0]}
        elif k == 1:
            assert set(after) == {i for i, _ in before}
            want = without_passages(before)
            assert {i: r.text for i, r in after.items()} == {i: t for i, (t, _) in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.values()) and any(n for _, n in want.values())
        elif k == 2:
            assert set(after) == {d for d, _, c in brute(before) if d == c}
        elif k == 3:
            assert set(after) == {i for (i, _), (_, hit, _) in zip(before, contaminated(before, items), strict=True) if not hit}
        else:
            t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            got = {}
            for r in out.collect():
                got.setdefault(r.doc_id, []).append((r.start, r.ids))
            assert set(got) == {i for i, _ in before}
            for i, text in before:
                ids = t.encode(text, add_special_tokens=False).ids + [1]
                assert b"".join(x for _, x in sorted(got[i])) == b"".join(n.to_bytes(2, "little") for n in ids)
        now = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_odd_rows_and_none(spark, tmp_path):
    """Repeated rows, null ids and texts, and an empty table."""
    src = "/root/testdata/sf0.001"
    spark.read.parquet(f"{src}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "en", "s", 0), (1, a, "en", "s", 0), (1, b, "en", "s", 0), (None, b, "en", None, 0), (None, None, None, None, None), (2, "", "en", "s", 0), (None, a + " more", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == [1, 1] and {r.start for r in got} == {0} and len({r.ids for r in got}) == 2
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
