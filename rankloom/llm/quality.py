"""Quality rules of texts and of their hosts (operator 10), with DataFrame functions only.

`measure` counts words, symbols, repeated lines and words in repeated 5-word windows of each text. `host_verdicts`
adds up how often each rule fails on a host's texts and shrinks the rates by a beta prior, fitted to all hosts by
beta-binomial moments. A host of which the lower bound of a shrunk rate (mean less `z` deviations) exceeds `limit` is
rejected with all its texts. One of which it has over `times` the odds of the rule's rate on all texts is suspect: of
its texts those go that fail that rule, even where the base rules alone would keep them. `apply_rules` joins the
verdicts to the texts. Where hosts differ by no more than chance, none is told apart.

Null or empty text: no words, so it fails. Very long texts are measured whole. Null host: a host of its own. Repeated
rows each count. Ties are no matter. Empty table: empty result. Windows are compared by 64-bit hashes. Only hosts with
a verdict are joined, by Spark's own choice of join. Columns that clash with new ones stay; the new names are told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Appends MEASURES and base_failed; tells the columns' names, which differ if `docs` has them already."""
    names = {k: common.fresh(docs, k) for k in [*MEASURES, "base_failed"]}
    text, words, windows, sorted_, places = (common.fresh(docs, f"rule_{k}") for k in ("text", "words", "windows", "sorted", "places"))
    df = docs.withColumn(text, F.coalesce(docs["text"].cast("string"), F.lit(""))).withColumn(words, words_of(F.col(text)))
    n = F.size(words)
    df = df.withColumn(windows, F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.array().cast("array<bigint>")))
    # Only texts in which a window comes again are looked at more closely: equal hashes are neighbours when sorted.
    again = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn(sorted_, F.when(again, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: (x["h"] == F.get(sorted_, k - 1)["h"]) | (x["h"] == F.get(sorted_, k + 1)["h"])
    df = df.withColumn(places, F.sort_array(F.transform(F.filter(sorted_, lambda x, k: F.coalesce(near(x, k), (x["h"] == F.get(sorted_, k + 1)["h"]), (x["h"] == F.get(sorted_, k - 1)["h"]))), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate(places, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = F.length(text)
    df = df.withColumns(
        {
            names["n_words"]: n.cast("long"),
            names["word_chars"]: _without(F.col(text), SPACE).cast("long"),
            names["n_symbols"]: (size - _without(F.col(text), SYMBOLS)).cast("long"),
            names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            names["n_repeat_words"]: F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    failed = (F.col(names["n_words"]) < 10) | (100 * F.col(names["n_repeat_words"]) > 20 * F.col(names["n_words"]))
    df = df.withColumn(names["base_failed"], failed)
    return df.select(*docs.columns, *names.values()), names


def rules(names: dict[str, str]) -> dict[str, Column]:
    """What counts against a host: each is true where a text fails."""
    c = {k: F.col(v) for k, v in names.items()}
    return {
        "short": c["n_words"] < 10,
        "repeats": 100 * c["n_repeat_words"] > 20 * c["n_words"],
        "symbols": c["n_symbols"] > c["n_words"],
        "lines": 10 * c["n_dup_lines"] > c["n_words"],
        "long_words": c["word_chars"] > 40 * c["n_words"],
    }


def host_verdicts(measured: DataFrame, names: dict[str, str], host: str = "source", limit: float = 0.5, times: float = 2.0, z: float = 1.64) -> DataFrame:
    """host, n, the shrunk rate of each rule, rejected, and suspect (the rules that its texts must pass)."""
    failed = rules(names)
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.count_if(r).cast("double").alias(f"k_{k}") for k, r in failed.items()))
    hosts = common.stage(hosts, "hosts")
    fitted = {k: common.beta_moments(F.col(f"k_{k}"), F.col("n"), 1.0, 1e6) for k in failed}
    prior = hosts.agg(*(m.alias(f"m_{k}") for k, (m, _) in fitted.items()), *(t.alias(f"t_{k}") for k, (_, t) in fitted.items()))
    both = hosts.crossJoin(F.broadcast(prior))  # one row
    a = {k: F.col(f"k_{k}") + F.col(f"m_{k}") * F.col(f"t_{k}") for k in failed}
    b = {k: F.col("n") - F.col(f"k_{k}") + (1 - F.col(f"m_{k}")) * F.col(f"t_{k}") for k in failed}
    bound = {k: common.lower_bound(a[k], b[k], z) for k in failed}
    rejected = F.greatest(*bound.values()) > limit
    suspect = F.array_compact(F.array(*(F.when(common.worse(bound[k], F.col(f"m_{k}"), times), k) for k in failed)))
    return both.select("host", F.col("n").cast("long").alias("n"), *((a[k] / (a[k] + b[k])).alias(f"rate_{k}") for k in failed), rejected.alias("rejected"), suspect.alias("suspect"))


def apply_rules(docs: DataFrame, host: str = "source", keep: list[str] | None = None, **options) -> tuple[DataFrame, dict[str, str]]:
    """Appends MEASURES, base_failed and kept to the columns `keep` of `docs` (all, if None); `host` is one of them."""
    measured, names = measure(docs)
    measured = measured.select(*(docs.columns if keep is None else keep), *names.values())
    kept, reject, suspect, key = (common.fresh(measured, k) for k in ("kept", "host_rejected", "host_suspect", "rule_host"))
    measured = common.stage(measured, "measured")
    known = host_verdicts(measured, names, host, **options).where("rejected OR size(suspect) > 0")
    known = common.stage(known.select(F.col("host").alias(key), F.col("rejected").alias(reject), F.col("suspect").alias(suspect)), "verdicts")
    df = measured.join(known, F.col(host).eqNullSafe(F.col(key)), "left")
    fails = [F.array_contains(suspect, k) & r for k, r in rules(names).items()]
    out = F.coalesce(F.col(reject) | F.greatest(*fails), F.lit(False))
    df = df.withColumn(kept, ~F.col(names["base_failed"]) & ~out)
    return df.select(*measured.columns, kept), names | {"kept": kept}
