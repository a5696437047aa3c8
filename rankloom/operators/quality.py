"""Data rules as violation frames: a row for each row and rule that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scalars import half_up
from rankloom.operators.quantiles import percentiles

RISK_FIELDS = ["postal_code", "building_type", "construction_class", "construction_year", "roof_type", "attic_status", "living_space_sqm", "dwelling_units", "owner_occupied", "rebuild_sum", "with_deductible"]
#: Domains and ranges: fixed values.
ENUMS = {
    "building_type": ["single-family", "two-family", "multi-family", "semi-detached", "terraced"],
    "construction_class": ["BAK1", "BAK2", "FHG1", "FHG2", "FHG3"],
    "roof_type": ["gable", "flat", "other"],
    "attic_status": ["not-converted", "converted", "partially-converted", "none"],
}
YEARS, SUMS, PER_SQM = (1900, 2020), (40_000, 3_000_000), (800, 5_000)


def units_fit() -> Column:
    units, kind = F.col("dwelling_units"), F.col("building_type")
    fits = F.when(kind == "single-family", units == 1).when(kind == "two-family", units == 2).when(kind == "multi-family", units.between(3, 8)).when(kind.isin("semi-detached", "terraced"), units.isin(1, 2)).otherwise(True)
    return (units >= 1) & fits


def sum_fits() -> Column:
    per = F.try_divide(F.col("rebuild_sum").cast("double"), F.col("living_space_sqm"))
    return F.col("rebuild_sum").between(*SUMS) & (F.col("living_space_sqm") > 0) & per.between(*PER_SQM)


def risk_rules() -> dict[str, Column]:
    """What each risk must satisfy; null counts as broken."""
    rules = {f"enum_{c}": F.col(c).isin(values) for c, values in ENUMS.items()}
    return rules | {"year": F.col("construction_year").between(*YEARS), "units": units_fit(), "rebuild_sum": sum_fits()}


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, rule of every broken rule, in one pass."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def schema_violations(df: DataFrame, expected: list[str]) -> list[str]:
    """missing:<field> and extra:<field>, from the schema alone."""
    have = set(df.columns)
    return sorted([f"missing:{c}" for c in expected if c not in have] + [f"extra:{c}" for c in have.difference(expected)])


def json_key_violations(json: Column, expected: list[str]) -> tuple[Column, Column]:
    """Fields that a JSON object lacks, and those it has too many."""
    want, have = F.array(*map(F.lit, expected)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(want, have)), F.array_sort(F.array_except(have, want))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that are empty or occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull() | (F.col(key).cast("string") == ""))


def require_none(bad: DataFrame, what: str, show: int = 5) -> None:
    """Raises if a violation frame has rows."""
    if found := bad.take(show):
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def unsorted_rows(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value exceeds that of the row before in their group."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("before", before).where(F.col(value) > F.col("before")).drop("before")


def length_summary(rows: DataFrame, length: Column, limit: int) -> DataFrame:
    """One row: percentiles of a length, the longest and how many are over a limit."""
    n = F.col("n")
    parts = {"longest": F.max(n), "n_over": F.count_if(n > limit)}
    df = percentiles(rows.select(length.alias("n")), n, {f"p{p}": p / 100 for p in (50, 90, 95, 99)}, also=parts)
    return df.select(n.alias("n_texts"), *(half_up(F.col(f"p{p}")).alias(f"p{p}") for p in (50, 90, 95, 99)), *parts)


def require_lengths(rows: DataFrame, key: str, length: Column, limit: int) -> DataFrame:
    """The rows; raises, with the five longest, if any is over a limit."""
    over = rows.select(F.col(key).alias("key"), length.alias("n")).where(F.col("n") > limit)
    if worst := over.orderBy(F.desc("n"), "key").limit(5).collect():
        raise ValueError(f"{over.count()} rows are over {limit}; the longest: " + ", ".join(f"{r.key}: {r.n}" for r in worst))
    return rows
