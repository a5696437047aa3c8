"""Scans of JSON lines, keyed JSON folders and CSV, with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.operators.lineage import cut
from rankloom.sources import lines
from rankloom.sources.versioned import Versioned


def files_of(spark: SparkSession, path: str) -> list[str] | str:
    """Where the files of a path are: those of the newest version of a table that this package wrote, else the path."""
    table = Versioned(spark, path)
    return table.folders() if table.versions() else path


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict scan: raises with file and line number if a line is no JSON object, and if there are no rows.

    One look at the files tells both, before any row is parsed for use.
    """
    seen = _checked(spark, path, lines.RANGE)
    if bad := lines.with_numbers(seen).orderBy("file", "line").limit(1).collect():
        raise ValueError(f"{bad[0].file}:{bad[0].line}: not a JSON object: {bad[0].value[:80]}")
    if not seen.agg(F.sum("n_filled")).first()[0]:
        raise ValueError(f"{path} has no rows")
    return spark.read.schema(schema).json(files_of(spark, path), mode="FAILFAST")


def _checked(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The lines that are no JSON objects, and the rows that count ranges: kept, so the files are read once."""
    value = F.trim(F.regexp_replace("value", r"\s", " "))
    bad = (value != "") & (F.try_parse_json("value").isNull() | ~F.startswith(value, F.lit("{")))
    return cut(lines.ranged(spark, files_of(spark, path), size).where(F.col("line").isNull() | bad))


def bad_lines(spark: SparkSession, path: str, size: int = lines.RANGE) -> DataFrame:
    """file, line (from 1) and value of lines that aren't JSON objects; blank ones don't count."""
    return lines.with_numbers(_checked(spark, path, size))


def read_jsonl_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A missing input is an empty table; what doesn't fit the schema is null."""
    try:
        return spark.read.schema(schema).json(files_of(spark, path), mode="PERMISSIVE")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A folder of one JSON object a file, keyed by file name, in its order; files that can't be read are dropped."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder, mode="DROPMALFORMED")
    return df.withColumn("key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).orderBy("key")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(files_of(spark, path), mode="FAILFAST")


#: Raw option as a pricing source gives it.
RAW = "id string, gesellschaft string, tarif string, jahresbeitrag string, beitrag_netto string, versicherungssumme string, selbstbeteiligung string, beitraege string, glas string, elementar string, punkte string"


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Raw string options as typed ones, without those that have no id or no positive price."""
    from rankloom.functions import scalars as S

    amount, unlimited = S.insured_sum(F.col("versicherungssumme"))
    covers = F.struct(S.yes(F.col("glas")).alias("glass"), S.yes(F.col("elementar")).alias("natural_hazard"))
    df = raw.select(
        F.col("id").alias("tariff_id"),
        F.trim("gesellschaft").alias("insurer"),
        F.trim("tarif").alias("product"),
        S.german_number(F.col("jahresbeitrag")).alias("price_annual"),
        S.german_number(F.coalesce("beitrag_netto", "jahresbeitrag")).alias("price_net"),
        amount.alias("insured_amount"),
        unlimited.alias("insured_unlimited"),
        F.coalesce(S.german_number(F.col("selbstbeteiligung")).cast("int"), F.lit(0)).alias("deductible"),
        S.fee_map(F.coalesce("beitraege", F.lit(""))).alias("fee_by_frequency"),
        covers.alias("coverages"),
        F.coalesce(F.col("punkte").try_cast("int"), F.lit(0)).alias("coverage_score"),
    )
    df = df.withColumn("num_coverages", F.col("coverages.glass").cast("int") + F.col("coverages.natural_hazard").cast("int"))
    return df.where((F.coalesce("tariff_id", F.lit("")) != "") & (F.col("price_annual") > 0))
