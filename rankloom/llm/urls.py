"""URL rules and empirical-Bayes host reputation (operator 4).

Rules name a host and a path; the longest rule that fits decides. For other urls a host's labelled outcomes decide:
hosts are nested in registered domains, and these in suffixes. A suffix's prior has the mean of all outcomes, a domain's
that of the suffix's other domains, a host's that of the domain's other hosts, so that no label counts twice; strengths
are fitted by beta-binomial moments to the spread of rates among the level's members beyond chance. A host with few
labels thus leans on its domain, and that on its suffix; where hosts differ by no more than chance, none is told apart.
A host is blocked if the lower bound of its posterior bad rate (mean less `z` deviations) has over `times` the odds of
the mean rate of all outcomes: a page is never blocked for want of evidence.

The registered domain is the suffix and the label before it; the suffix is the host's last two labels if both are
short country-style labels (such as co.uk), else its last. Null url, or one without "://": empty host and path, which
no rule fits. Very long urls are judged whole. Each row is judged; of rules of equal length the one of the longer host
decides. Outcomes count by row, null ones nowhere. Hosts, of which one may hold a third of all pages, are joined by
host, where Spark splits what is skewed, or sends the hosts if they are small. Other columns, whatever their names,
aren't read. Empty tables: empty result, or the general prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    labels = F.split(F.regexp_replace(host, r":.*$", ""), r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin("ac", "co", "com", "edu", "gov", "net", "org")
    last = F.when(two, 2).otherwise(1)
    join = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.least(n, k)), ".")
    return join(last + 1), join(last)


def reputations(outcomes: DataFrame, times: float = 2.0, z: float = 1.64, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """host, bad, good, rate (posterior mean), bound, blocked; outcomes: host, bad (0 or 1, null: unlabelled)."""
    count = lambda v: F.count_if(F.col("bad") == v).cast("double")
    hosts = outcomes.groupBy("host").agg(count(1).alias("bad"), (count(1) + count(0)).alias("n"))
    domain, suffix = domain_of(F.col("host"))
    hosts = common.stage(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("d_bad"), F.sum("n").alias("d_n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_bad").alias("s_bad"), F.sum("d_n").alias("s_n"))
    fitted = [suffixes.agg(common.beta_moments(F.col("s_bad"), F.col("s_n"), least, most)[1].alias("s_strength"))]
    fitted.append(domains.agg(common.beta_moments(F.col("d_bad"), F.col("d_n"), least, most)[1].alias("d_strength")))
    mean, strength = common.beta_moments(F.col("bad"), F.col("n"), least, most)
    fitted.append(hosts.agg(mean.alias("mean"), strength.alias("strength")))
    out = hosts.join(domains.join(suffixes, "suffix").drop("suffix"), "domain")
    for one in fitted:
        out = out.crossJoin(F.broadcast(one))  # one row
    up = (F.col("s_bad") - F.col("d_bad") + F.col("mean") * F.col("s_strength")) / (F.col("s_n") - F.col("d_n") + F.col("s_strength"))
    prior = (F.col("d_bad") - F.col("bad") + up * F.col("d_strength")) / (F.col("d_n") - F.col("n") + F.col("d_strength"))
    a, b = F.col("bad") + prior * F.col("strength"), F.col("n") - F.col("bad") + (1 - prior) * F.col("strength")
    out = out.select("host", F.col("bad").cast("long").alias("bad"), (F.col("n") - F.col("bad")).cast("long").alias("good"), "mean", a.alias("a"), b.alias("b"))
    out = out.withColumns({"rate": F.col("a") / (F.col("a") + F.col("b")), "bound": common.lower_bound(F.col("a"), F.col("b"), z)})
    return out.withColumn("blocked", common.worse(F.col("bound"), F.col("mean"), times)).drop("a", "b", "mean")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and bound; outcomes: host, bad (1: a bad outcome)."""
    host, path = split_url(pages["url"])
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = common.stage(reputations(outcomes, **options).select(F.col("host").alias("known"), "rate", "bound", "blocked"), "reputations")
    both = cut.join(known, F.col("host") == F.col("known"), "left")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("blocked"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "rate", "bound")
