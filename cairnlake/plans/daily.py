"""The daily index: habitat and weather suitability, score, level, confidence and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import strongest
from ..functions.numeric import band, clamp, gaussian, scale, weighted_index

# Weights and parameters of the daily and monthly models.
RINGS = {"within250m": 0.58, "from250mTo1km": 0.29, "from1kmTo5km": 0.13}
COMPONENTS = {"habitat": 0.44, "weather": 0.56}
HABITAT = {
    "wetlands": 0.16, "marshes": 0.18, "seasonalWater": 0.13, "smallWaterBodies": 0.12, "stagnantWater": 0.13, "lakeShoreline": 0.04,
    "largeOpenWater": 0.01, "fastRiver": 0.01, "slowRiver": 0.03, "forestVegetation": 0.08, "drainage": 0.04, "rainfallClimate": 0.04, "landCover": 0.03,
}
WEATHER = {"temperature": 0.19, "overnightLow": 0.11, "humidity": 0.13, "dewPoint": 0.09, "rainfallLag": 0.18, "soilMoisture": 0.12, "season": 0.1, "evening": 0.08}
LEVELS = ((0.3, "Low"), (0.55, "Moderate"), (0.75, "High"))
MONTHLY = {"habitat": 0.5, "season": 0.35, "rainfallClimate": 0.15}
COVERS = (("wetland|marsh|swamp", 1.0), ("forest|wood|shrub", 0.72), ("grass|agricultur|cropland", 0.46), ("urban|developed|built", 0.18), ("barren|rock|snow|ice", 0.05))

# What the explanations of a day and of a month say.
DAY_TEXTS = {
    "wet": "Nearby wetlands, marshes or seasonal water increase breeding habitat.",
    "open_water": "Large open water has only a small influence without sheltered wet habitat.",
    "forest": "Forest and dense vegetation provide sheltered resting habitat.",
    "rainfall": "Rain over the past one to two weeks increases later breeding potential.",
    "humid": "Humid, high-dewpoint conditions support mosquito activity.",
    "wind": "Strong wind suppresses short-term flying activity.",
    "cool_night": "A cool overnight low suppresses tonight's activity.",
    "rain": "Active rain can temporarily reduce flying activity.",
    "mixed": "Habitat and weather signals are mixed for this period.",
}
MONTH_TEXTS = {
    "wet": "Wetlands, marshes or seasonal water raise the campground's monthly baseline.",
    "forest": "Forest and vegetation provide sheltered mosquito habitat.",
    "cool": "Cool seasonal temperatures strongly limit mosquito activity.",
    "warmer": "Seasonal guidance is warmer than the long-term model climate.",
    "cooler": "Seasonal guidance is cooler than the long-term model climate.",
    "wetter": "Seasonal guidance is wetter than the long-term model climate.",
    "drier": "Seasonal guidance is drier than the long-term model climate.",
    "typical": "The habitat baseline and seasonal guidance are close to typical for this month.",
}


def ring_score(rings: Column, weights: dict[str, float] = RINGS) -> Column:
    return clamp(sum((rings[k] * w for k, w in weights.items()), F.lit(0.0)))


def cover_score(kind: Column, table=COVERS, otherwise: float = 0.35) -> Column:
    out = F.lit(otherwise)
    for pattern, value in reversed(table):
        out = F.when(F.lower(kind).rlike(pattern), value).otherwise(out)
    return out


def habitat_factors() -> dict[str, Column]:
    """Factors from the columns of a habitat profile."""
    c = F.col
    return {
        "wetlands": ring_score(c("wetlandCoverage")), "marshes": ring_score(c("marshCoverage")), "seasonalWater": ring_score(c("seasonalWaterCoverage")),
        "smallWaterBodies": clamp(c("smallWaterBodyDensity")), "stagnantWater": clamp(c("stagnantWaterPotential")),
        "lakeShoreline": clamp(c("lakeShorelineProximity")), "largeOpenWater": clamp(c("largeOpenWaterCoverage")),
        "fastRiver": clamp(c("fastRiverProximity")), "slowRiver": clamp(c("slowRiverProximity")),
        "forestVegetation": clamp(ring_score(c("forestCoverage")) * 0.7 + c("vegetationCoverage") * 0.3),
        "drainage": 1 - clamp(c("drainagePotential")), "rainfallClimate": scale(c("warmSeasonRainfallMm"), 80, 650), "landCover": cover_score(c("landCoverType")),
    }


def weather_factors() -> dict[str, Column]:
    c = F.col
    t = c("temperatureMeanC")
    return {
        "temperature": F.when(t <= 5, 0.0).otherwise(gaussian(t, 25, 9)), "overnightLow": scale(c("overnightLowC"), 5, 18),
        "humidity": scale(c("relativeHumidityMean"), 38, 90), "dewPoint": scale(c("dewPointMeanC"), 4, 20),
        "rainfallLag": clamp((c("precipitation3dMm") * 0.18 + c("precipitation7dMm") * 0.48 + c("precipitation14dMm") * 0.34) / 45),
        "soilMoisture": scale(c("soilMoisture"), 0.07, 0.36), "season": clamp(c("seasonality")), "evening": clamp(c("eveningActivity")),
    }


def level(score: Column) -> Column:
    return band(score, LEVELS, "Very high", inclusive=False)


def score_daily(df: DataFrame) -> DataFrame:
    """Add habitat, weather, score, level, confidence and factors to rows with a profile and a day's weather."""
    h, w = habitat_factors(), weather_factors()
    wind = 1 - scale(F.col("windSpeedKmh"), 12, 32) * 0.7
    rain = 1 - scale(F.col("activePrecipitationMm"), 0, 4) * 0.3
    out = df.withColumn("habitat", weighted_index(h, HABITAT)).withColumn("weather", clamp(weighted_index(w, WEATHER) * wind * rain))
    wet = F.greatest(h["wetlands"], h["marshes"], h["seasonalWater"])
    reasons = [
        (wet > 0.55, wet, DAY_TEXTS["wet"]),
        ((h["largeOpenWater"] > 0.55) & (wet < h["largeOpenWater"]), F.lit(0.25), DAY_TEXTS["open_water"]),
        (h["forestVegetation"] > 0.6, h["forestVegetation"] * 0.65, DAY_TEXTS["forest"]),
        (w["rainfallLag"] > 0.55, w["rainfallLag"], DAY_TEXTS["rainfall"]),
        (w["humidity"] > 0.65, w["humidity"] * 0.8, DAY_TEXTS["humid"]),
        (wind < 0.72, 1.5 - wind, DAY_TEXTS["wind"]),
        (F.col("overnightLowC") < 8, F.lit(0.8), DAY_TEXTS["cool_night"]),
        (rain < 0.85, F.lit(0.62), DAY_TEXTS["rain"]),
    ]
    sure = clamp((F.col("profileConfidence") * 0.65 + 0.35) * (1 - F.least(F.col("dayOffset"), F.lit(7)) * 0.045))
    scored = out.withColumn("score", clamp(F.col("habitat") * COMPONENTS["habitat"] + F.col("weather") * COMPONENTS["weather"]))
    return scored.withColumn("level", level(F.col("score"))).withColumn("confidence", sure).withColumn("factors", strongest(reasons, 4, DAY_TEXTS["mixed"]))


def score_monthly(df: DataFrame) -> DataFrame:
    """Monthly outlook from a profile and a month's climate: score, level, confidence, factors."""
    h = habitat_factors()
    c = F.col
    season = clamp(c("seasonality"))
    base = weighted_index(h, HABITAT) * MONTHLY["habitat"] + season * MONTHLY["season"] + h["rainfallClimate"] * MONTHLY["rainfallClimate"]
    t, p = c("temperatureAnomalyC"), c("precipitationAnomalyMm")
    score = clamp((base + t * 0.035 * season + F.tanh(p / 45) * 0.12) * scale(c("temperatureMeanC"), 4, 14))
    cool = c("temperatureMeanC") < 10
    wet = F.greatest(h["wetlands"], h["marshes"], h["seasonalWater"])
    reasons = [
        (wet > 0.5, wet, MONTH_TEXTS["wet"]),
        (h["forestVegetation"] > 0.6, h["forestVegetation"] * 0.7, MONTH_TEXTS["forest"]),
        (cool, F.lit(0.9), MONTH_TEXTS["cool"]),
        (~cool & (t >= 0.75), F.least(F.lit(0.85), 0.45 + t / 8), MONTH_TEXTS["warmer"]),
        (~cool & (t <= -0.75), F.least(F.lit(0.85), 0.45 - t / 8), MONTH_TEXTS["cooler"]),
        (p >= 8, F.least(F.lit(0.85), 0.45 + p / 100), MONTH_TEXTS["wetter"]),
        (p <= -8, F.least(F.lit(0.85), 0.45 - p / 100), MONTH_TEXTS["drier"]),
    ]
    sure = clamp((c("profileConfidence") * 0.7 + 0.3) * 0.78 * (1 - F.least(c("monthOffset"), F.lit(6)) * 0.055))
    return df.withColumn("score", score).withColumn("level", level(F.col("score"))).withColumn("confidence", sure).withColumn("factors", strongest(reasons, 4, MONTH_TEXTS["typical"]))
