"""Habitat profiles of places from what was measured in the rings around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp

# Weights of rings and of standing water, scales, and what each source adds to the confidence.
RINGS = {"within250m": 0.6, "from250mTo1km": 0.3, "from1kmTo3km": 0.1}
STAGNANT = {"marsh": 0.4, "otherWetland": 0.2, "seasonalWater": 0.15, "smallWaterDensity": 0.15, "slowRiver": 0.1}
SMALL_WATER_SCALE, LAKE_M, RIVER_M = 5.0, 250.0, 500.0
CONFIDENCE = {"cover": 0.25, "water": 0.15, "terrain": 0.15, "climate": 0.10, "wetlands": 0.15, "hydrography": 0.05}
CLASS_NAMES = {
    10: "tree cover", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built-up", 60: "bare or sparse vegetation", 70: "snow or ice",
    80: "permanent water", 90: "herbaceous wetland", 95: "mangrove", 100: "moss or lichen",
}


def _weighted(ring: Column) -> Column:
    return sum((ring[name] * w for name, w in RINGS.items()), F.lit(0.0))


def derive(df: DataFrame) -> DataFrame:
    """Add smallWaterBodyDensity, vegetationCoverage, drainagePotential, stagnantWaterPotential, floodplainExposure,
    the three proximities and profileConfidence.

    Columns: marsh, wetland, seasonal (structs of shares by ring), vegetation_near and vegetation_middle (shares),
    small_waters, slope, lake_m, fast_m, slow_m (metres), and has (a map of source to whether it was used).
    """
    c = F.col
    near = lambda metres, scale: F.exp(-c(metres) / scale)
    small, slow = 1 - F.exp(-c("small_waters") / SMALL_WATER_SCALE), near("slow_m", RIVER_M)
    vegetation = 0.7 * c("vegetation_near") + 0.3 * c("vegetation_middle")
    drained = 0.2 + F.least(c("slope") / 15, F.lit(1.0)) * 0.6 + (1 - vegetation) * 0.2 - F.least(F.lit(1.0), c("wetland")["within250m"] * 4) * 0.3
    standing = {"marsh": _weighted(c("marsh")), "otherWetland": _weighted(c("wetland")), "seasonalWater": _weighted(c("seasonal")), "smallWaterDensity": small, "slowRiver": slow}
    sure = sum((F.when(F.coalesce(F.try_element_at("has", F.lit(source)), F.lit(False)), w).otherwise(0.0) for source, w in CONFIDENCE.items()), F.lit(0.0))
    wet = standing["marsh"] + standing["otherWetland"] + standing["seasonalWater"] + near("lake_m", LAKE_M)
    return (
        df.withColumn("smallWaterBodyDensity", small).withColumn("vegetationCoverage", vegetation).withColumn("drainagePotential", clamp(drained))
        .withColumn("stagnantWaterPotential", clamp(sum((standing[k] * w for k, w in STAGNANT.items()), F.lit(0.0))))
        .withColumn("floodplainExposure", clamp((1 - c("drainagePotential")) * wet / 4))
        .withColumn("lakeShorelineProximity", near("lake_m", LAKE_M)).withColumn("fastRiverProximity", near("fast_m", RIVER_M)).withColumn("slowRiverProximity", slow)
        .withColumn("profileConfidence", clamp(sure, 0.0, 0.9))
    )


def land_cover(pixels: DataFrame, key: str, code: str) -> DataFrame:
    """The names of the two most frequent classes of each place, the higher code first if equal; 0 is no class."""
    counted = pixels.where(F.col(code) > 0).groupBy(key, code).agg(F.count("*").alias("n"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.desc(code)))).where("r <= 2")
    names = F.create_map(*(F.lit(x) for pair in CLASS_NAMES.items() for x in pair))
    name = F.coalesce(F.try_element_at(names, F.col(code).cast("int")), F.concat(F.lit("class "), F.col(code).cast("string")))
    both = F.array_sort(F.collect_list(F.struct("r", name.alias("name"))))
    return first.groupBy(key).agg(F.array_join(F.transform(both, lambda x: x["name"]), " / ").alias("landCoverType"))
