"""The engine's tables as seen in the test data: panels are orders, options are their lines.

Each view exists twice: as a DataFrame for the engine and as a common table expression for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.quality import ENUMS

BUILDING_TYPES, CLASSES, ROOFS, ATTICS = (ENUMS[c] for c in ("building_type", "construction_class", "roof_type", "attic_status"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All options of all panels; pos is their stable order."""
    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return line.select(
        F.col("l_orderkey").alias("scenario_id"),
        F.row_number().over(w).alias("pos"),
        F.concat_ws(":", "l_partkey", "l_suppkey", F.row_number().over(w)).alias("tariff_id"),
        F.col("l_suppkey").alias("insurer"),
        F.col("l_partkey").alias("product"),
        F.col("l_extendedprice").alias("price_annual"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("insured_amount"),
        (F.col("l_returnflag") == "N").alias("insured_unlimited"),
        F.col("l_tax").alias("deductible"),
        (F.col("l_discount") * 100).alias("coverage_score"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("num_coverages"),
        F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("quote_count"),
    )


def panels(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Options of panels with at least `least` of them."""
    return quotes(spark, sf_dir).where(F.col("quote_count") >= least)


def panel_ids(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """scenario_id of the panels with at least `least` options."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scenario_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= least).select("scenario_id")


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("scenario_id"),
        F.lpad((cust % 100000).cast("string"), 5, "0").alias("postal_code"),
        pick(BUILDING_TYPES, key % 5).alias("building_type"),
        pick(CLASSES, F.floor(key / 5) % 5).alias("construction_class"),
        (1900 + key % 131).cast("int").alias("construction_year"),
        pick(ROOFS, key % 3).alias("roof_type"),
        pick(ATTICS, key % 4).alias("attic_status"),
        (60 + cust % 300).cast("int").alias("living_space_sqm"),
        (1 + key % 9).cast("int").alias("dwelling_units"),
        (key % 3 != 0).alias("owner_occupied"),
        F.floor(F.col("o_totalprice") * 2).cast("long").alias("rebuild_sum"),
        (key % 2 == 0).alias("with_deductible"),
    )


def teacher_rank() -> F.Column:
    """The place of an option in the ranking that stands for labels."""
    w = Window.partitionBy("scenario_id").orderBy(F.coalesce("insured_amount", F.lit(1e9)).desc(), "price_annual", "pos")
    return F.row_number().over(w)


def teachers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario_id, rank (1 to 3), tariff_id: the ranking that stands for labels."""
    ranked = panels(spark, sf_dir).withColumn("rank", teacher_rank())
    return ranked.where("rank <= 3").select("scenario_id", "rank", "tariff_id")


QUOTES = """q AS (
  SELECT l_orderkey AS scenario_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos,
    concat_ws(':', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS VARCHAR)) AS tariff_id,
    l_suppkey AS insurer, l_partkey AS product, l_extendedprice AS price_annual,
    CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS insured_amount, l_returnflag = 'N' AS insured_unlimited,
    l_tax AS deductible, l_discount * 100 AS coverage_score, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS num_coverages,
    count(*) OVER (PARTITION BY l_orderkey) AS quote_count
  FROM lineitem)"""
PANELS = QUOTES + ",\npanel AS (SELECT * FROM q WHERE quote_count >= 3)"
TEACHERS = """teacher AS (SELECT scenario_id, rank, tariff_id FROM (SELECT scenario_id, tariff_id,
    row_number() OVER (PARTITION BY scenario_id ORDER BY coalesce(insured_amount, 1e9) DESC, price_annual, pos) AS rank FROM panel) WHERE rank <= 3)"""


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


RISKS = f"""risk AS (
  SELECT o_orderkey AS scenario_id, lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS postal_code,
    {_case("o_orderkey % 5", BUILDING_TYPES)} AS building_type, {_case("(o_orderkey // 5) % 5", CLASSES)} AS construction_class,
    CAST(1900 + o_orderkey % 131 AS INTEGER) AS construction_year, {_case("o_orderkey % 3", ROOFS)} AS roof_type,
    {_case("o_orderkey % 4", ATTICS)} AS attic_status, CAST(60 + o_custkey % 300 AS INTEGER) AS living_space_sqm,
    CAST(1 + o_orderkey % 9 AS INTEGER) AS dwelling_units, o_orderkey % 3 <> 0 AS owner_occupied,
    CAST(floor(o_totalprice * 2) AS BIGINT) AS rebuild_sum, o_orderkey % 2 = 0 AS with_deductible
  FROM orders)"""
