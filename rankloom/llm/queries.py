"""The registered queries of the training-data operators; each derives its digest columns from its operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, html_text, jaccard, line_chunks, matroska, packing, pii, quality, spelling, sql, token_files, toxicity, urls, whitening
from .common import table

TOKENIZER_FILES = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed tokenizer collection; every executor has it at the same place."""
    from importlib import import_module

    return import_module(TOKENIZER_FILES).path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back."""
    out = common.scratch(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(manifest)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    df = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {k: F.col(k) for k in pii.KINDS}
    whole = {k: pii.all_spans(k) for k in pii.KINDS}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return df.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(whole).alias("spans"), sum((F.size(v) for v in whole.values()), F.lit(0)).cast("long").alias("n_spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    path = tokenizer_path("word_bpe_49k.json")
    packed = packing.pack(table(spark, sf_dir, "documents"), path, end_id=1)
    return packing.digest(packed, path).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all urls. A page's outcome is the quality label of the document that its url names: /<lang>/<doc_id>."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    host, path = urls.split_url(pages["url"])
    cut = pages.select("page_id", host.alias("host"), path.alias("path")).distinct()  # repeated rows are one page
    named = F.nullif(F.regexp_extract("path", r"^/[a-z]+/([0-9]{1,18})", 1), F.lit(""))
    outcomes = cut.select("host", F.try_to_number(named, F.lit("9" * 18)).cast("long").alias("doc_id")).join(labels, "doc_id").select("host", (1 - F.col("quality")).alias("bad"))
    return urls.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    df = toxicity.score(docs, model)
    return df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df, _ = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return df.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), common.sha_join(items).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return jaccard.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    df = html_text.extract(table(spark, sf_dir, "pages"))
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of two lines or more that came before."""
    df, _ = line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), candidates=line_chunks.pairs_of)
    return df.select("doc_id", "n_lines", "n_removed", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    df, _ = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id", "source"])
    return df.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents; one (document, word) in 97 is misspelt on purpose."""

    def typo(doc_id: Column, run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
        return F.when(h % 97 == 0, spelling.less_one(run, h)).otherwise(run)

    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), typo))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantised(F.col("embedding")).alias("x"))
    vectors = whitening.usable(vectors, "x")
    model = whitening.fit(vectors, "x", 4)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*(F.lit(float(s * s) / (model.total or 1.0)) for s in model.deviations))
    df = whitening.transform(vectors, "x", model).select("vec_id", F.posexplode("white").alias("k", "whitened"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"))
    return df.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(model.error).alias("identity_error"))


def op13_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Matroska audio, stored in a binary column, read back by their packet tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = common.stage(matroska.audio_files(docs, "text"), "media", compression="zstd")
    of_file = [F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    df = matroska.samples(stored.select("doc_id", "n_bytes", *of_file, "media"), "media")
    said = F.concat_ws(":", *(F.col(f"features.{x}").cast("string") for x in ("codec", "packets", "blocks", "clusters", "cues", "cued", "duration_ns", "low", "high", "total", "squares", "crossings", "error")))
    digests = [F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32")]
    return df.select("doc_id", "n_bytes", *digests, "media_bytes", "media_sha256", said.alias("feature"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_pii, op3_packing, op4_urls, op5_toxicity, op6_decontaminate, op7_jaccard, op8_html, op9_line_chunks, op10_quality, op11_spelling, op12_whitening, op13_matroska)}
SQL = sql.SQL
