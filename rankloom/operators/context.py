"""Enrichment of risks: hazard tiers, age, notes, emphasis and the cover policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-digit postcode prefixes of each tier: fixed values.
FLOOD_HIGH = ["01", "04", "07", "56", "67", "76", "77", "83", "94"]
FLOOD_ELEVATED = ["20", "21", "26", "27", "28", "50", "51", "53", "68", "80", "81", "84", "93"]
HAIL_BELT = ["70", "71", "72", "73", "74", "75", "76", "77", "78", "80", "81", "82", "83", "84", "85", "86", "87", "88", "89"]
#: Notes and emphasis: fixed values.
NOTES = {
    "old": "old building (>60y): higher water-damage / wiring risk, scrutinise construction class",
    "timber": "timber-frame / lightweight class: elevated fire exposure",
    "units": "multi-unit: liability & rented-share considerations",
    "rented": "rented: loss-of-rent and tenant-liability exposure",
}
EMPHASIS = {"high": 0.9, "elevated": 0.6, "moderate": 0.25}
YEAR = 2026
DEFAULTS = {"building_type": "single-family", "construction_class": "BAK1", "roof_type": "gable", "attic_status": "not-converted", "living_space_sqm": 140, "rebuild_sum": 350_000, "with_deductible": False}


def flood_tier(postcode: Column) -> Column:
    p = F.substring(F.trim(postcode), 1, 2)
    return F.when(p.isin(FLOOD_HIGH), "high").when(p.isin(FLOOD_ELEVATED), "elevated").otherwise("moderate")


def hail_tier(postcode: Column) -> Column:
    return F.when(F.substring(F.trim(postcode), 1, 2).isin(HAIL_BELT), "elevated").otherwise("moderate")


def enrich(risks: DataFrame) -> DataFrame:
    """Appends risk_context; missing or zero year and units count as 1990 and 1, missing ownership as true."""
    year = F.coalesce(F.nullif(F.col("construction_year"), F.lit(0)), F.lit(1990))
    units = F.coalesce(F.nullif(F.col("dwelling_units"), F.lit(0)), F.lit(1))
    age, flood = F.lit(YEAR) - year, flood_tier(F.coalesce("postal_code", F.lit("")))
    on = {"old": age >= 60, "timber": F.col("construction_class").isin("FHG2", "FHG3"), "units": units >= 3, "rented": ~F.coalesce("owner_occupied", F.lit(True))}
    notes = F.array_compact(F.array(*(F.when(c, F.lit(NOTES[k])) for k, c in on.items())))
    natural = F.element_at(F.create_map(*(F.lit(x) for kv in EMPHASIS.items() for x in kv)), flood)
    glass = F.when(F.col("building_type").isin("multi-family", "two-family"), 0.5).otherwise(0.3)
    exposure = F.struct(flood.alias("flood_heavy_rain"), hail_tier(F.coalesce("postal_code", F.lit(""))).alias("storm_hail"), (year <= 2000).alias("surge_overvoltage_relevant"))
    return risks.withColumn("risk_context", F.struct("postal_code", exposure.alias("hazard_exposure"), age.alias("building_age_years"), notes.alias("construction_notes"), F.struct(natural.alias("natural_hazard"), glass.alias("glass")).alias("coverage_emphasis")))


def cover_policy(context: str = "risk_context") -> Column:
    flood = F.col(f"{context}.hazard_exposure.flood_heavy_rain")
    return F.struct(F.lit(True).alias("fire"), F.lit(True).alias("glass"), flood.isin("high", "elevated").alias("natural_hazard"))


def with_defaults(risks: DataFrame) -> DataFrame:
    return risks.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in risks.columns})
