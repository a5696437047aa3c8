"""Connected components by alternating large-star and small-star steps; no link or component leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: u > v. Neighbours larger (large) or not larger (small) than a node are tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        new = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether each u has one v, which isn't a u itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))).alias("e"))
    roles = ends.groupBy("e.x").agg(F.sum("e.low").alias("low"), F.max("e.top").alias("top"))
    return roles.where("low > 1 OR low = 1 AND top = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of `edges` (u, v) other than the least of its component, that least one."""
    spark, made = edges.sparkSession, common.staged.made
    edges = common.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars_only(edges):
        before = made[-1]
        edges = common.stage(_star(_star(edges, True), False), "edges")
        common.delete(spark, [before])
        made.remove(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
