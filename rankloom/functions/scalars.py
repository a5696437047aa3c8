"""Scalar expressions on columns. None of them raises on junk under ANSI mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 4) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same in every engine of IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def german_number(s: Column) -> Column:
    """'1.037,89' is 1037.89 and '469.213902' is 469.21; blank or junk: null."""
    t = F.trim(s)
    dotted = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    return half_up(dotted.try_cast("double"), 2)


def insured_sum(s: Column) -> tuple[Column, Column]:
    """A sum, and whether it is unlimited."""
    unlimited = F.coalesce(F.lower(F.trim(s)) == "unbegrenzt", F.lit(False))
    return F.when(~unlimited, german_number(s).cast("long")), unlimited


FREQUENCIES = ["annual", "half_yearly", "quarterly", "monthly"]


def fee_map(s: Column, keys: list[str] = FREQUENCIES) -> Column:
    """'531.15;273.54;;0' as a map of the positive parts by frequency."""
    parts = F.transform(F.split(s, ";"), lambda x: half_up(F.trim(x).try_cast("double"), 2))
    n = F.least(F.lit(len(keys)), F.size(parts))
    names = F.slice(F.array(*map(F.lit, keys)), F.lit(1), n)
    return F.map_filter(F.map_from_arrays(names, F.slice(parts, F.lit(1), n)), lambda _, v: F.coalesce(v > 0, F.lit(False)))


def yes(s: Column) -> Column:
    return F.lower(F.trim(F.coalesce(s, F.lit("")))) == "ja"


def mapped(c: Column, pairs: dict[str, str]) -> Column:
    """The value that a constant table has for a key."""
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), reversed(pairs.items()), F.lit(None).cast("string"))


def age_band(year: Column) -> Column:
    return F.when(year <= 1959, "old").when(year <= 1994, "middle").otherwise("modern")


def count_band(n: Column) -> Column:
    return F.when(n <= 5, "4-5").when(n <= 7, "6-7").otherwise("8-9")


def canonical_json(columns: list[str]) -> Column:
    """JSON text with sorted keys and no spaces."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_id(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def stable_hash(seed: int, namespace: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), key.cast("string")), 256)


def sanitize(message: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Hides url queries, id and pa parameters and known secrets; at most 500 characters."""
    out = F.regexp_replace(message, r"(https?://[^\s?]+)\?[^\s]*", "$1?[redacted]")
    out = F.regexp_replace(out, r"(?i)\b(id|pa)=([^&\s\"']+)", "$1=[redacted]")
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("[redacted]"))
    return F.substring(out, 1, 500)


def transient(message: Column) -> Column:
    return F.lower(message).rlike("timed out|temporarily unavailable|connection")


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", 100 * x)


def minmax(value: Column, lo: Column, hi: Column, rel_floor: float = 0.01) -> Column:
    """Into [0, 1] within a group; 0.5 if the spread is no signal."""
    spread = hi - lo
    flat = spread <= rel_floor * F.greatest(F.abs(hi), F.abs(lo), F.lit(1.0))
    return F.when(flat, 0.5).otherwise(F.try_divide(value - lo, spread))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval, not rounded; (0, 0) without trials."""
    p = hits / F.when(n > 0, n)
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    off = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return tuple(F.when(n > 0, x).otherwise(0.0) for x in (mid - off, mid + off))
