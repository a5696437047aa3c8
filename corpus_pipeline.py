"""A training corpus from documents: rules, lines, near copies, benchmark, packing; each stage is written and reread.

Each stage does with nulls, empty and very long texts, ties, repeated rows and clashing columns what its operator's
docstring says: null and empty texts fail the quality rules; of rows of one text, or of near copies, one stays. An empty
table passes through all stages. A stage's own staged tables are deleted once the next begins, those of other threads'
runs are not touched.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import common, decontaminate, jaccard, line_chunks, packing, quality
from rankloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, names = quality.apply_rules(docs)
    return df.where(names["kept"]).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, _ = line_chunks.dedup_lines(docs, candidates=line_chunks.pairs_of)
    return line_chunks.counted(df.select(*docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


class _Left(threading.local):
    """What this thread's last stage staged for itself."""

    folders: tuple[str, ...] = ()


_left = _Left()


def _tidy(stage):
    """First deletes what the stage before has staged for itself: its result has been written and reread."""

    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.forget(spark, _left.folders, docs)
        n = len(common.staged.made)
        out = stage(spark, docs, sf_dir)
        _left.folders = tuple(common.staged.made[n:])
        return out

    return tidied


STAGES = [(name, _tidy(f)) for name, f in (("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard), ("benchmark decontamination", benchmark), ("packing", pack))]

#: SQL can't express line chunks by content, nor packing; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), ()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, f"stage-{k}")
            common.forget(spark, before, docs)
            before = (common.staged.made[-1],)
    return docs
