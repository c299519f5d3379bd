"""The evidence index: persistent water, breeding, population, activity, reports, and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import count_if, from_last, last_n, mean_or, total
from ..functions.calendar import hours_between
from ..functions.numeric import band, clamp, geometric_mean, scale, weighted_index
from ..operators import stats
from .daily import cover_score

# Weights and parameters of the evidence model.
RINGS = {"within250m": 0.58, "from250mTo1km": 0.29, "from1kmTo3km": 0.13}
HABITAT = {
    "wetlands": 0.15, "marshes": 0.18, "seasonalWater": 0.14, "smallWaterBodies": 0.11, "stagnantWater": 0.13, "shorelineEdge": 0.07, "slowRiver": 0.035,
    "fastRiver": 0.005, "forestVegetation": 0.055, "poorDrainage": 0.035, "landCover": 0.025, "floodplain": 0.025, "largeOpenWater": 0.005,
}
COVERS = (("wetland|marsh|swamp", 1.0), ("forest|wood|shrub", 0.7), ("grass|agricultur|cropland", 0.42), ("urban|developed|built", 0.16), ("barren|rock|snow|ice", 0.04))
LEVELS = ((15, 1), (35, 2), (55, 3), (75, 4), (100, 5))
LABELS = {1: "None or minimal", 2: "Light", 3: "Moderate", 4: "Heavy", 5: "Severe"}
RECENCY = ((1, 1.0), (3, 0.85), (7, 0.6), (14, 0.35), (30, 0.15))
RECENT_MOST, HISTORY_MOST, ENVIRONMENT_LEAST = (0.5, 0.35, 0.2), 0.25, (0.25, 0.4, 0.55)
ANONYMOUS, TIME_UNKNOWN = 0.7, 0.85


def _ring(column: str) -> Column:
    """The outer ring goes to 3 km, or to 5 km in older profiles."""
    r = F.col(column)
    return clamp(r["within250m"] * RINGS["within250m"] + r["from250mTo1km"] * RINGS["from250mTo1km"] + F.coalesce(r["from1kmTo3km"], r["from1kmTo5km"]) * RINGS["from1kmTo3km"])


def habitat() -> Column:
    c = F.col
    factors = {
        "wetlands": _ring("wetlandCoverage"), "marshes": _ring("marshCoverage"), "seasonalWater": _ring("seasonalWaterCoverage"),
        "smallWaterBodies": clamp(c("smallWaterBodyDensity")), "stagnantWater": clamp(c("stagnantWaterPotential")),
        "shorelineEdge": F.greatest(clamp(c("lakeShorelineProximity")) * 0.55, clamp(F.coalesce(c("shorelineWaterEdgeLengthKm"), F.lit(0.0)) / 8)),
        "slowRiver": clamp(c("slowRiverProximity")), "fastRiver": clamp(c("fastRiverProximity")) * 0.25,
        "forestVegetation": clamp(_ring("forestCoverage") * 0.65 + c("vegetationCoverage") * 0.35), "poorDrainage": 1 - clamp(c("drainagePotential")),
        "landCover": cover_score(c("landCoverType"), COVERS, 0.32), "floodplain": clamp(F.coalesce(c("floodplainExposure"), F.lit(0.0))),
        "largeOpenWater": clamp(c("largeOpenWaterCoverage")) * 0.12,
    }
    return weighted_index(factors, HABITAT)


#: Days of history that the functions below look at, at most; beside the snow depth of the first day of all.
LOOK_BACK = 67


def water_balance(history: Column, wet: Column, drainage: Column, slope: Column, fast_river: Column, first_snow: Column | None = None) -> Column:
    """Water after the last 60 days: rain and snowmelt in, evaporation and drainage out, clamped each day.

    The snow depth before the first of the 60 days is that of the whole history's first day: first_snow, if the array
    holds only the last days of it.
    """
    capacity = clamp(F.lit(0.35) + wet * 0.65)

    def step(state: Column, day: Column) -> Column:
        melt = F.when(day["temperatureMeanC"] > 0, F.greatest(F.lit(0.0), state["snow"] - day["snowDepthM"]) * 1000).otherwise(0.0)
        loss = (F.lit(0.01) + day["evapotranspirationMm"] * 0.015 + drainage * 0.025 + slope * 0.001) * (1 - wet * 0.55)
        rain = day["precipitationMm"]
        flushed = F.when(rain >= 55, 0.08 * (0.5 + fast_river * 0.5)).otherwise(0.0)
        water = state["water"] + rain * 0.025 + melt * 0.03 - loss - flushed
        return F.struct(F.greatest(F.lit(0.0), F.least(capacity, water)).cast("double").alias("water"), day["snowDepthM"].cast("double").alias("snow"))

    start = F.struct(F.least(capacity, wet * 0.35).cast("double").alias("water"), F.coalesce(F.get(history, 0)["snowDepthM"] if first_snow is None else first_snow, F.lit(0.0)).cast("double").alias("snow"))
    return F.aggregate(last_n(history, 60), start, step, lambda s: s["water"])


def _rain(history: Column, start: int, end: int) -> Column:
    days = from_last(last_n(history, 30), start, end)
    return total(F.transform(days, lambda d: F.greatest(F.lit(0.0), d["precipitationMm"])))


def breeding(history: Column, water: Column) -> Column:
    recent = last_n(history, 30)
    rainy = count_if(recent, lambda d: d["precipitationMm"] >= 1) / F.lit(30.0)
    soil = scale(mean_or(F.transform(last_n(recent, 7), lambda d: d["soilMoisture"])), 0.07, 0.36)
    lag = clamp((_rain(history, 0, 3) * 0.08 + _rain(history, 3, 8) * 0.22 + _rain(history, 8, 15) * 0.46 + _rain(history, 15, 30) * 0.24) / 35)
    return clamp(water * 0.55 + rainy * 0.15 + soil * 0.2 + lag * 0.1)


def population(history: Column, sunrise: Column, sunset: Column) -> Column:
    recent = last_n(history, 30)

    def degree_days(d: Column) -> Column:
        grown = clamp((d["temperatureMeanC"] - 10) / 15)
        heat = F.when(d["temperatureMaxC"] <= 35, 1.0).otherwise(clamp(1 - (d["temperatureMaxC"] - 35) / 10))
        return grown * heat * F.greatest(F.lit(0.0), d["temperatureMeanC"] - 10)

    snow = lambda back: F.when(F.size(recent) >= back, F.element_at(recent, -back)["snowDepthM"]).otherwise(0.0)
    grown = clamp(total(F.transform(recent, degree_days)) / 180)
    survival = F.exp(
        -0.38 * count_if(recent, lambda d: d["temperatureMinC"] <= 0) - 0.035 * count_if(recent, lambda d: d["temperatureMinC"] < 6) - 0.05 * count_if(recent, lambda d: d["temperatureMaxC"] > 35)
    )
    season = scale(hours_between(sunrise, sunset), 8, 15)
    return clamp(grown * survival * (0.68 + season * 0.32) + clamp((snow(8) - snow(1)) * 20) * 0.12 * season)


def hourly_activity(hour: Column) -> Column:
    t = hour["temperatureC"]
    warm = F.when(t <= 24, scale(t, 5, 24)).otherwise(1 - scale(t, 24, 38))
    wind = (1 - scale(hour["windSpeedKmh"], 8, 25) * 0.9) * (1 - scale(hour["windGustKmh"], 20, 45) * 0.75)
    value = warm * scale(hour["relativeHumidity"], 35, 85) * wind * (1 - scale(hour["precipitationMm"], 0.5, 4) * 0.9) * F.when(hour["isDay"], 0.65).otherwise(1.0)
    return F.when(t <= 5, 0.0).otherwise(clamp(value))


def evening_activity(hours: Column) -> Column:
    """Mean activity of the hours 17 to 23 by the clock, or of all hours if there are none."""
    evening = F.filter(hours, lambda h: F.substring(h["time"], 12, 2).cast("int").between(17, 23))
    return mean_or(F.transform(F.when(F.size(evening) > 0, evening).otherwise(hours), hourly_activity))


def peak_activity(hours: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(hours, hourly_activity)), F.lit(0.0))


def risk_level(risk: Column) -> Column:
    return band(risk, LEVELS, 5)


def score_environment(df: DataFrame) -> DataFrame:
    """Add the environmental parts and the risk to rows with a profile, history, hours, sunrise and sunset."""
    c = F.col
    wet = F.greatest(_ring("wetlandCoverage"), _ring("marshCoverage"), _ring("seasonalWaterCoverage"), c("stagnantWaterPotential"))
    out = df.withColumn("habitat", habitat()).withColumn("wet", wet)
    out = out.withColumn("water", water_balance(c("history"), c("wet"), c("drainagePotential"), c("slopeDegrees"), c("fastRiverProximity"), c("first_snow") if "first_snow" in out.columns else None))
    out = out.withColumn("breeding", breeding(c("history"), c("water"))).withColumn("population", population(c("history"), c("sunrise"), c("sunset")))
    out = out.withColumn("evening", evening_activity(c("hourly"))).withColumn("peak", peak_activity(c("hourly")))
    risk = clamp(geometric_mean(c("habitat"), c("breeding"), c("population"), c("evening")) * 100, 0.0, 100.0)
    return out.withColumn("environmental", risk).withColumn("environmental_level", risk_level(c("environmental")))


def _valid(as_of: str) -> Column:
    c = F.col
    return (c("status") == "published") & c("deleted_at").isNull() & ~F.coalesce(c("duplicate"), F.lit(False)) & (c("submitted_at") <= F.lit(as_of).cast("timestamp")) & c("rating").between(1, 5)


def _rating() -> Column:
    return clamp((F.col("rating") - 1) * 25.0, 0.0, 100.0)


def _signal(rows: DataFrame, key: str, confidence: Column, *more: Column) -> DataFrame:
    """Weighted median, counts, agreement and confidence of weighted ratings by key."""
    sums = rows.groupBy(key).agg(F.count("*").alias("reports"), stats.effective_size(F.col("weight")).alias("ess"), *more)
    median = stats.weighted_median(rows, [key], "value", "weight", "signal")
    agreed = stats.agreement(rows, [key], "value", "weight")
    return sums.join(median, key).join(agreed, key).withColumn("confidence", confidence)


def recent_reports(reports: DataFrame, key: str, target: str, as_of: str) -> DataFrame:
    """Reports of the 30 days before the target, weighted by age, reporter and whether the time is known."""
    age = (F.unix_micros(F.lit(target).cast("timestamp")) - F.unix_micros("observed_at")) / 86_400e6
    weight = band(F.col("age"), RECENCY) * F.when(F.col("verified"), 1.0).otherwise(ANONYMOUS) * F.when(F.col("time_known"), 1.0).otherwise(TIME_UNKNOWN)
    return reports.where(_valid(as_of)).withColumn("age", age).where("age >= 0 AND age <= 30").withColumn("weight", weight).withColumn("value", _rating())


def recent_signal(reports: DataFrame, key: str, target: str, as_of: str) -> DataFrame:
    rows = recent_reports(reports, key, target, as_of)
    quality = (F.sum(F.col("weight") * F.when(F.col("verified"), 1.0).otherwise(ANONYMOUS)) / F.sum("weight")).alias("quality")
    sure = clamp((1 - F.exp(-F.col("ess") / 3)) * F.col("agreement") * F.col("quality") * TIME_UNKNOWN)
    return _signal(rows, key, sure, quality)


def historical_signal(reports: DataFrame, key: str, id_col: str, target: str, as_of: str) -> DataFrame:
    """Reports of earlier years within 21 days of the season, without those that count as recent."""
    day = F.lit(target).cast("date")
    gap = F.abs(F.dayofyear("observed_at") - F.dayofyear(day))
    rows = (
        reports.where(_valid(as_of)).join(recent_reports(reports, key, target, as_of).select(id_col), id_col, "left_anti")
        .withColumn("years", F.year(day) - F.year("observed_at")).withColumn("gap", F.least(gap, 366 - gap)).where("years >= 1 AND gap <= 21")
        .withColumn("weight", F.pow(F.lit(0.85), F.col("years")) * (1 - F.col("gap") / 22) * F.when(F.col("verified"), 1.0).otherwise(ANONYMOUS))
        .withColumn("value", _rating())
    )
    enough = (F.col("reports") >= 3) & (F.col("n_years") >= 2)
    sure = F.when(enough, clamp((1 - F.exp(-F.col("ess") / 10)) * (1 - F.exp(-F.col("n_years") / 2)) * F.col("agreement"))).otherwise(0.0)
    return _signal(rows, key, sure, F.count_distinct(F.year("observed_at")).alias("n_years"))


def blend(df: DataFrame) -> DataFrame:
    """Blend environmental risk with signals: columns environmental, recent_signal, recent_confidence,
    historical_signal, historical_confidence, day_offset; adds weights and risk."""
    c = F.col
    pick = lambda values: F.when(c("day_offset") <= 1, values[0]).when(c("day_offset") <= 3, values[1]).otherwise(values[2])
    most = 1 - pick(ENVIRONMENT_LEAST)
    out = df.withColumn("__r", pick(RECENT_MOST) * F.coalesce("recent_confidence", F.lit(0.0))).withColumn("__h", HISTORY_MOST * F.coalesce("historical_confidence", F.lit(0.0)))
    cut = F.when(c("__r") + c("__h") > most, most / (c("__r") + c("__h"))).otherwise(1.0)
    out = out.withColumn("recent_weight", c("__r") * cut).withColumn("historical_weight", c("__h") * cut).drop("__r", "__h")
    out = out.withColumn("environmental_weight", 1 - c("recent_weight") - c("historical_weight"))
    risk = (
        c("environmental") * c("environmental_weight") + F.coalesce("recent_signal", "environmental") * c("recent_weight")
        + F.coalesce("historical_signal", "environmental") * c("historical_weight")
    )
    return out.withColumn("risk", clamp(risk, 0.0, 100.0)).withColumn("risk_level", risk_level(c("risk")))


def final_confidence(df: DataFrame) -> DataFrame:
    """Confidence from weather and habitat completeness and the agreement of the evidence, its band and reasons."""
    c = F.col
    parts = [("environmental", "environmental_weight"), ("recent_signal", "recent_weight"), ("historical_signal", "historical_weight")]
    w = lambda v, k: F.when(c(v).isNotNull() & (c(k) > 0), c(k)).otherwise(0.0)
    weight = sum((w(v, k) for v, k in parts), F.lit(0.0))
    mean = sum((w(v, k) * F.coalesce(v, F.lit(0.0)) for v, k in parts), F.lit(0.0)) / weight
    out = df.withColumn("__mean", mean)
    var = sum((w(v, k) * F.pow(F.coalesce(v, F.lit(0.0)) - c("__mean"), 2) for v, k in parts), F.lit(0.0)) / weight
    agreed = F.when(weight > 0, clamp(1 - F.sqrt(var) / 50)).otherwise(0.0)
    sure = clamp((c("completeness") * 0.35 + clamp(c("habitat_completeness")) * 0.3 + agreed * 0.35) * (1 - F.least(c("day_offset"), F.lit(7)) * 0.045))
    n = F.coalesce("recent_reports", F.lit(0))
    up = c("recent_signal") > c("environmental")
    plural = F.when(n == 1, "").otherwise("s")
    reasons = F.array_compact(
        F.array(
            F.when(n == 0, "Based mainly on weather and habitat; no recent reports.")
            .when(c("recent_agreement") < 0.65, "Recent reports are inconsistent.")
            .otherwise(F.concat(F.lit("Adjusted "), F.when(up, "upward").otherwise("downward"), F.lit(" using "), n.cast("string"), F.lit(" consistent recent campground report"), plural, F.lit("."))),
            F.when(c("historical_confidence") > 0, "Historical seasonal reports support the campground outlook."),
            F.when(c("habitat_completeness") < 0.6, "Limited habitat information is available for this campground."),
            F.when(F.abs(c("recent_signal") - c("environmental")) >= 15, F.concat(F.lit("Recent reports indicate "), F.when(up, "higher").otherwise("lower"), F.lit(" activity than the weather estimate."))),
        )
    )
    out = out.withColumn("confidence", sure).withColumn("confidence_reasons", F.slice(reasons, 1, 5)).drop("__mean")
    return out.withColumn("confidence_band", F.when(c("confidence") >= 0.72, "high").when(c("confidence") >= 0.45, "medium").otherwise("low"))
