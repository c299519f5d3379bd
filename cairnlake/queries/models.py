"""Scoring models over profiles made from parts, series from events, and reports from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..operators.jobs import spread
from ..plans import daily, evidence, features, scheduling
from ..sources.feeds import table
from .registry import query

# A profile for each part: shares from its size (1 to 50) and price.
_S, _P = "(p_size / 50.0::DOUBLE)", "((p_retailprice - 900) / 1201)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("p_size") / F.lit(50.0), (F.col("p_retailprice") - 900) / 1201
    ring = F.struct(s.alias("within250m"), p.alias("from250mTo1km"), (s * p).alias("from1kmTo5km"), (s * p).alias("from1kmTo3km"))
    names = ("wetlandCoverage", "marshCoverage", "seasonalWaterCoverage", "forestCoverage")
    some = ("smallWaterBodyDensity", "stagnantWaterPotential", "lakeShorelineProximity", "slowRiverProximity", "vegetationCoverage", "floodplainExposure")
    other = ("largeOpenWaterCoverage", "fastRiverProximity", "drainagePotential", "profileConfidence")
    return table(spark, sf_dir, "part").select(
        "p_partkey", *(ring.alias(n) for n in names), *(s.alias(n) for n in some), *(p.alias(n) for n in other), (s * 800).alias("warmSeasonRainfallMm"), (p * 10).alias("slopeDegrees"),
        (s * 6).alias("shorelineWaterEdgeLengthKm"), F.when(F.col("p_size") % 2 == 0, "Mixed forest").otherwise("Cropland").alias("landCoverType"),
    )


_CLAMP = "greatest(0, least(1, {x}))"
_RING = _CLAMP.format(x=f"{_S} * 0.58 + {_P} * 0.29 + {_S} * {_P} * 0.13")
_HABITAT = _CLAMP.format(
    x=f"({_RING} * (0.16 + 0.18 + 0.13) + {_CLAMP.format(x=_S)} * (0.12 + 0.13 + 0.04 + 0.03) + {_CLAMP.format(x=_P)} * (0.01 + 0.01) + {_CLAMP.format(x=f'{_RING} * 0.7 + {_S} * 0.3')} * 0.08"
    f" + (1 - {_CLAMP.format(x=_P)}) * 0.04 + {_CLAMP.format(x=f'({_S} * 800 - 80) / 570')} * 0.04 + (CASE WHEN p_size % 2 = 0 THEN 0.72 ELSE 0.46 END) * 0.03) / 1.0"
)
_T, _HUM, _RAIN, _WIND = "(p_size * 0.6)", "(30 + p_size * 1.2)", "(p_size * 0.8)", "(p_size * 0.7)"
_WEATHER = _CLAMP.format(
    x=f"((CASE WHEN {_T} <= 5 THEN 0 ELSE exp(-0.5 * (({_T} - 25) / 9) ** 2) END) * 0.19 + {_CLAMP.format(x=f'({_T} - 6 - 5) / 13.0')} * 0.11 + {_CLAMP.format(x=f'({_HUM} - 38) / 52')} * 0.13"
    f" + {_CLAMP.format(x=f'({_T} - 4 - 4) / 16.0')} * 0.09 + {_CLAMP.format(x=f'({_RAIN} * 0.18 + {_RAIN} * 2 * 0.48 + {_RAIN} * 4 * 0.34) / 45')} * 0.18 + {_CLAMP.format(x='(p_size / 150.0::DOUBLE - 0.07) / 0.29')} * 0.12"
    f" + {_CLAMP.format(x=_S)} * 0.1 + {_CLAMP.format(x=_S)} * 0.08) * (1 - {_CLAMP.format(x=f'({_WIND} - 12) / 20')} * 0.7) * (1 - {_CLAMP.format(x='(p_size % 6) / 4.0::DOUBLE')} * 0.3)"
)


def days(df: DataFrame) -> DataFrame:
    n = F.col("size")
    t = n * 0.6
    return df.select(
        "*", t.alias("temperatureMeanC"), (t - 6).alias("overnightLowC"), (30 + n * 1.2).alias("relativeHumidityMean"), (t - 4).alias("dewPointMeanC"), (n * 0.8).alias("precipitation3dMm"),
        (n * 1.6).alias("precipitation7dMm"), (n * 3.2).alias("precipitation14dMm"), (n / F.lit(150.0)).alias("soilMoisture"), (n / F.lit(50.0)).alias("seasonality"), (n / F.lit(50.0)).alias("eveningActivity"),
        (n * 0.7).alias("windSpeedKmh"), (n % 6).cast("double").alias("activePrecipitationMm"), (n % 9).cast("int").alias("dayOffset"),
    )


@query(f"""
WITH x AS (SELECT p_partkey, p_size, {_P} AS p, {_HABITAT} AS habitat, {_WEATHER} AS weather FROM part), s AS (SELECT *, {_CLAMP.format(x='habitat * 0.44 + weather * 0.56')} AS score FROM x)
SELECT p_partkey, round(habitat, 9) AS habitat, round(weather, 9) AS weather, round(score, 9) AS score, CASE WHEN score < 0.3 THEN 'Low' WHEN score < 0.55 THEN 'Moderate' WHEN score < 0.75 THEN 'High' ELSE 'Very high' END AS level,
 round({_CLAMP.format(x='(p * 0.65 + 0.35) * (1 - least(p_size % 9, 7) * 0.045)')}, 9) AS confidence FROM s
""")
def daily_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size")), "p_partkey")
    out = daily.score_daily(days(rows))
    return out.select("p_partkey", *(F.round(c, 9).alias(c) for c in ("habitat", "weather", "score", "confidence")), "level")


@query(f"""
WITH x AS (SELECT p_partkey, p_size, {_P} AS p, {_HABITAT} * 0.5 + {_CLAMP.format(x=_S)} * 0.35 + {_CLAMP.format(x=f'({_S} * 800 - 80) / 570')} * 0.15 AS base FROM part)
SELECT p_partkey, round({_CLAMP.format(x=f"(base + (p_size % 5 - 2) * 0.035 * least(1, p_size / 50.0::DOUBLE) + tanh((p_size % 60 - 30) / 45.0::DOUBLE) * 0.12) * {_CLAMP.format(x='(p_size * 0.6 - 4) / 10')}")}, 9) AS score,
 round({_CLAMP.format(x='(p * 0.7 + 0.3) * 0.78 * (1 - least(p_size % 8, 6) * 0.055)')}, 9) AS confidence FROM x
""")
def monthly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("size")
    rows = profiles(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size")), "p_partkey")
    rows = rows.select("*", (n / F.lit(50.0)).alias("seasonality"), (n % 5 - 2).cast("double").alias("temperatureAnomalyC"), (n % 60 - 30).cast("double").alias("precipitationAnomalyMm"), (n * 0.6).alias("temperatureMeanC"), (n % 8).cast("int").alias("monthOffset"))
    return daily.score_monthly(rows).select("p_partkey", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence"))


_EVENT_DAYS = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value) / 10, 6) AS rain, round(avg(value) / 4, 6) AS temp FROM events GROUP BY 1, 2)"


def weather_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's weather for each user from events."""
    per = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value") / 10, 6).alias("rain"), F.round(F.avg("value") / 4, 6).alias("temp"))
    return per.select(
        "user_id", "day", F.col("rain").alias("precipitationMm"), F.col("temp").alias("temperatureMeanC"), (F.col("temp") - 5).alias("temperatureMinC"), (F.col("temp") + 6).alias("temperatureMaxC"),
        (F.col("temp") / 5).alias("evapotranspirationMm"), (F.col("rain") / 100).alias("soilMoisture"), F.lit(0.0).alias("snowDepthM"),
    )


_WEATHER_COLUMNS = ("precipitationMm", "temperatureMeanC", "temperatureMinC", "temperatureMaxC", "evapotranspirationMm", "soilMoisture", "snowDepthM")


def weather_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gathered(weather_days(spark, sf_dir), ["user_id"], ["day"], _WEATHER_COLUMNS, last=evidence.LOOK_BACK, first={"snowDepthM": "first_snow"})


@query(f"""
WITH {_EVENT_DAYS}, l AS (SELECT user_id, list(rain * 0.025 - (0.01 + temp / 5 * 0.015 + 0.3 * 0.025 + 2 * 0.001) * (1 - 0.5 * 0.55) - CASE WHEN rain >= 55 THEN 0.08 * 0.6 ELSE 0 END ORDER BY day) AS steps FROM d GROUP BY 1)
SELECT user_id, round(list_reduce(list_slice(steps, greatest(1, len(steps) - 59), len(steps)), lambda a, x: greatest(0.0::DOUBLE, least(0.35 + 0.5 * 0.65, a + x)), (0.5 * 0.35)::DOUBLE), 6) AS water FROM l
""")
def water_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = weather_history(spark, sf_dir)
    water = evidence.water_balance(F.col("history"), F.lit(0.5), F.lit(0.3), F.lit(2.0), F.lit(0.2), F.col("first_snow"))
    return history.select("user_id", F.round(water, 6).alias("water"))


@query(f"""
WITH {_EVENT_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d),
s AS (SELECT user_id, coalesce(sum(rain) FILTER (WHERE k <= 3), 0) * 0.08 + coalesce(sum(rain) FILTER (WHERE k BETWEEN 4 AND 8), 0) * 0.22 + coalesce(sum(rain) FILTER (WHERE k BETWEEN 9 AND 15), 0) * 0.46 + coalesce(sum(rain) FILTER (WHERE k BETWEEN 16 AND 30), 0) * 0.24 AS lag,
 count(*) FILTER (WHERE k <= 30 AND rain >= 1) / 30.0::DOUBLE AS often, avg(rain / 100) FILTER (WHERE k <= 7) AS soil FROM r GROUP BY 1)
SELECT user_id, round({_CLAMP.format(x=f"0.4 * 0.55 + often * 0.15 + {_CLAMP.format(x='(soil - 0.07) / 0.29')} * 0.2 + {_CLAMP.format(x='lag / 35')} * 0.1")}, 6) AS breeding FROM s
""")
def breeding_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = weather_history(spark, sf_dir)
    return history.select("user_id", F.round(evidence.breeding(F.col("history"), F.lit(0.4)), 6).alias("breeding"))


@query(f"""
WITH {_EVENT_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d),
s AS (SELECT user_id, sum({_CLAMP.format(x='(temp - 10) / 15')} * CASE WHEN temp + 6 <= 35 THEN 1 ELSE {_CLAMP.format(x='1 - (temp + 6 - 35) / 10')} END * greatest(0, temp - 10)) AS dd,
 count(*) FILTER (WHERE temp - 5 <= 0) AS frozen, count(*) FILTER (WHERE temp - 5 < 6) AS cold, count(*) FILTER (WHERE temp + 6 > 35) AS hot FROM r WHERE k <= 30 GROUP BY 1)
SELECT user_id, round({_CLAMP.format(x=f"{_CLAMP.format(x='dd / 180')} * exp(-0.38 * frozen - 0.035 * cold - 0.05 * hot) * (0.68 + (6.0::DOUBLE / 7) * 0.32)")}, 6) AS population FROM s
""")
def population_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = weather_history(spark, sf_dir)
    up, down = F.lit("2024-06-01 05:00:00").cast("timestamp"), F.lit("2024-06-01 19:00:00").cast("timestamp")
    return history.select("user_id", F.round(evidence.population(F.col("history"), up, down), 6).alias("population"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 5 AS rating, o_orderdate AS at, o_orderkey % 3 = 0 AS verified, (epoch(TIMESTAMP '2001-08-01 20:00:00') - epoch(o_orderdate)) / 86400.0 AS age FROM orders WHERE o_orderstatus <> 'P'),
w AS (SELECT o_custkey, (rating - 1) * 25.0::DOUBLE AS v, (CASE WHEN age <= 1 THEN 1 WHEN age <= 3 THEN 0.85 WHEN age <= 7 THEN 0.6 WHEN age <= 14 THEN 0.35 ELSE 0.15 END * CASE WHEN verified THEN 1 ELSE 0.7 END * 0.85)::DOUBLE AS w, CASE WHEN verified THEN 1.0::DOUBLE ELSE 0.7 END AS q FROM r WHERE age >= 0 AND age <= 30),
m AS (SELECT o_custkey, sum(v * w) / sum(w) AS mean FROM w GROUP BY 1), c AS (SELECT o_custkey, v, sum(w) OVER (PARTITION BY o_custkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY o_custkey) AS total FROM w),
s AS (SELECT o_custkey, min(v) AS signal FROM c WHERE run >= total / 2 GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS reports, sum(w) ** 2 / sum(w * w) AS ess, greatest(0, least(1, 1 - sqrt(sum(w * (v - mean) ** 2) / sum(w)) / 50)) AS agreement, sum(w * q) / sum(w) AS quality FROM w JOIN m USING (o_custkey) GROUP BY 1)
SELECT o_custkey, reports, signal, round(agreement, 6) AS agreement, round(greatest(0, least(1, (1 - exp(-ess / 3)) * agreement * quality * 0.85)), 6) AS confidence FROM a JOIN s USING (o_custkey)
""")
def recent_report_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.recent_signal(reports(spark, sf_dir), "o_custkey", "2001-08-01 20:00:00", "2001-08-01 20:00:00")
    return out.select("o_custkey", "reports", "signal", F.round("agreement", 6).alias("agreement"), F.round("confidence", 6).alias("confidence"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        "o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 5).alias("rating"), at.alias("observed_at"), at.alias("submitted_at"), (F.col("o_orderkey") % 3 == 0).alias("verified"),
        F.when(F.col("o_orderstatus") == "P", "removed").otherwise("published").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(False).alias("duplicate"), F.lit(False).alias("time_known"),
    )


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, (o_orderkey % 5) * 25.0::DOUBLE AS v, o_orderkey % 3 = 0 AS verified, o_orderdate AS at, 2001 - year(o_orderdate) AS years, least(abs(dayofyear(o_orderdate) - 213), 366 - abs(dayofyear(o_orderdate) - 213)) AS gap FROM orders WHERE o_orderstatus <> 'P'),
w AS (SELECT *, (0.85 ** years * (1 - gap / 22.0::DOUBLE) * CASE WHEN verified THEN 1 ELSE 0.7 END)::DOUBLE AS w FROM r WHERE years >= 1 AND gap <= 21),
c AS (SELECT o_custkey, v, sum(w) OVER (PARTITION BY o_custkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY o_custkey) AS total FROM w), s AS (SELECT o_custkey, min(v) AS signal FROM c WHERE run >= total / 2 GROUP BY 1)
SELECT o_custkey, count(*) AS reports, count(DISTINCT years) AS n_years, any_value(signal) AS signal, round(sum(w) ** 2 / sum(w * w), 6) AS ess FROM w JOIN s USING (o_custkey) GROUP BY 1
""")
def historical_report_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.historical_signal(reports(spark, sf_dir), "o_custkey", "o_orderkey", "2001-08-01 20:00:00", "2001-08-01 20:00:00")
    return out.select("o_custkey", "reports", "n_years", "signal", F.round("ess", 6).alias("ess"))


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS env, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 1000 END AS rs, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 ELSE 0 END AS rc, l_discount * 900 AS hs, l_tax * 12 AS hc, CAST(l_quantity AS BIGINT) % 8 AS d FROM lineitem),
w AS (SELECT *, CASE WHEN d <= 1 THEN 0.5 WHEN d <= 3 THEN 0.35 ELSE 0.2 END::DOUBLE * rc AS a, 0.25::DOUBLE * hc AS b, 1 - CASE WHEN d <= 1 THEN 0.25 WHEN d <= 3 THEN 0.4 ELSE 0.55 END::DOUBLE AS most FROM x),
v AS (SELECT *, a * CASE WHEN a + b > most THEN most / (a + b) ELSE 1 END AS rw, b * CASE WHEN a + b > most THEN most / (a + b) ELSE 1 END AS hw FROM w)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(100, env * (1 - rw - hw) + coalesce(rs, env) * rw + hs * hw)), 6) AS risk FROM v
""")
def score_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    even = c("l_linenumber") % 2 == 0
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_quantity") * 2).alias("environmental"), F.when(even, c("l_tax") * 1000).alias("recent_signal"), F.when(even, c("l_discount") * 10).otherwise(0.0).alias("recent_confidence"),
        (c("l_discount") * 900).alias("historical_signal"), (c("l_tax") * 12).alias("historical_confidence"), (c("l_quantity").cast("long") % 8).alias("day_offset"),
    )
    return evidence.blend(rows).select("l_orderkey", "l_linenumber", F.round("risk", 6).alias("risk"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS saves, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-01') AS recent, CAST(max(o_totalprice) / 5000 AS BIGINT) AS sites FROM orders GROUP BY 1),
e AS (SELECT user_id, count(*) AS views FROM events GROUP BY 1),
x AS (SELECT c_custkey, c_acctbal > -900 AS active, c_custkey % 11 <> 0 AS profile, coalesce(sites, 0) >= 50 AS a, coalesce(recent, 0) > 0 AS b, coalesce(saves, 0) >= 3 AS c, coalesce(views, 0) >= 10 AS d, c_custkey % 13 = 0 AS r
 FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey)
SELECT c_custkey, CASE WHEN NOT active OR NOT profile THEN 'paused' WHEN a OR b OR c OR d OR r THEN 'daily' ELSE 'weekly' END AS cadence,
 CAST(CASE WHEN NOT active OR NOT profile THEN 0 WHEN a OR b OR c OR d OR r THEN a::INT * 30 + b::INT * 30 + c::INT * 20 + d::INT * 15 + r::INT * 25 ELSE 1 END AS BIGINT) AS priority_score FROM x
""")
def cadence_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.count_if(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("saves"), recent.alias("recent"), F.round(F.max("o_totalprice") / 5000).cast("long").alias("sites"))
    views = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("views"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").join(views, "c_custkey", "left").select(
        "c_custkey", (F.col("c_acctbal") > -900).alias("active"), F.lit("open").alias("operating_status"), (F.col("c_custkey") % 11 != 0).alias("has_profile"), "sites", (F.col("recent") > 0).alias("recent_report"), "saves", "views",
        (F.col("c_custkey") % 13 == 0).alias("requested"), F.lit(None).cast("string").alias("manual_override"),
    )
    return scheduling.decide_cadence(rows).select("c_custkey", "cadence", F.col("priority_score").cast("long").alias("priority_score"))


_RING3 = _CLAMP.format(x=f"s * {evidence.RINGS['within250m']} + p * {evidence.RINGS['from250mTo1km']} + s * p * {evidence.RINGS['from1kmTo3km']}")
_W = evidence.HABITAT
_SITE = f"""
x AS (SELECT p_partkey, p_size, {_S} AS s, {_P} AS p FROM part), y AS (SELECT *, {_RING3} AS ring FROM x),
z AS (SELECT *, greatest(ring, s) AS wet, {_CLAMP.format(x=f"""(ring * {_W['wetlands'] + _W['marshes'] + _W['seasonalWater']} + {_CLAMP.format(x='s')} * {_W['smallWaterBodies'] + _W['stagnantWater'] + _W['slowRiver'] + _W['floodplain']}
  + greatest({_CLAMP.format(x='s')} * 0.55, {_CLAMP.format(x='s * 6 / 8')}) * {_W['shorelineEdge']} + {_CLAMP.format(x='p')} * {0.25 * _W['fastRiver'] + 0.12 * _W['largeOpenWater']} + {_CLAMP.format(x='ring * 0.65 + s * 0.35')} * {_W['forestVegetation']}
  + (1 - {_CLAMP.format(x='p')}) * {_W['poorDrainage']} + CASE WHEN p_size % 2 = 0 THEN 0.7 ELSE 0.42 END * {_W['landCover']}) / {sum(_W.values())}""")} AS habitat FROM y)"""
_HOUR = "(12 + h * 0.5 - 5) / 19 * 0.7 * CASE WHEN h BETWEEN 5 AND 19 THEN 0.65 ELSE 1 END"


@query(f"""
WITH {_EVENT_DAYS}, {_SITE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d),
l AS (SELECT user_id, list({{'rain': rain, 'temp': temp}} ORDER BY day) AS days, coalesce(sum(rain) FILTER (WHERE k <= 3), 0) * 0.08 + coalesce(sum(rain) FILTER (WHERE k BETWEEN 4 AND 8), 0) * 0.22
  + coalesce(sum(rain) FILTER (WHERE k BETWEEN 9 AND 15), 0) * 0.46 + coalesce(sum(rain) FILTER (WHERE k BETWEEN 16 AND 30), 0) * 0.24 AS lag, count(*) FILTER (WHERE k <= 30 AND rain >= 1) / 30.0::DOUBLE AS often, avg(rain / 100) FILTER (WHERE k <= 7) AS soil,
  sum({_CLAMP.format(x='(temp - 10) / 15')} * CASE WHEN temp + 6 <= 35 THEN 1 ELSE {_CLAMP.format(x='1 - (temp + 6 - 35) / 10')} END * greatest(0, temp - 10)) FILTER (WHERE k <= 30) AS dd,
  count(*) FILTER (WHERE k <= 30 AND temp - 5 <= 0) AS frozen, count(*) FILTER (WHERE k <= 30 AND temp - 5 < 6) AS cold, count(*) FILTER (WHERE k <= 30 AND temp + 6 > 35) AS hot FROM r WHERE k <= 60 GROUP BY 1),
j AS (SELECT z.*, l.*, least({_CLAMP.format(x='0.35 + wet * 0.65')}, wet * 0.35) AS start FROM z LEFT JOIN l ON user_id = p_partkey % ((SELECT max(user_id) FROM events) + 1)),
w AS (SELECT *, CASE WHEN days IS NULL THEN start ELSE list_reduce(list_transform(days, lambda e: e.rain * 0.025 - (0.01 + e.temp / 5 * 0.015 + p * 0.025 + p * 10 * 0.001) * (1 - wet * 0.55) - CASE WHEN e.rain >= 55 THEN 0.08 * (0.5 + p * 0.5) ELSE 0 END),
  lambda a, e: greatest(0.0::DOUBLE, least({_CLAMP.format(x='0.35 + wet * 0.65')}, a + e)), start) END AS water FROM j),
b AS (SELECT *, {_CLAMP.format(x=f"water * 0.55 + coalesce(often, 0) * 0.15 + {_CLAMP.format(x='(coalesce(soil, 0) - 0.07) / 0.29')} * 0.2 + {_CLAMP.format(x='coalesce(lag, 0) / 35')} * 0.1")} AS breeding,
  {_CLAMP.format(x=f"{_CLAMP.format(x='coalesce(dd, 0) / 180')} * exp(-0.38 * coalesce(frozen, 0) - 0.035 * coalesce(cold, 0) - 0.05 * coalesce(hot, 0))")} AS population,
  (SELECT avg({_HOUR}) FROM range(17, 24) t(h)) AS evening, (SELECT max({_HOUR}) FROM range(0, 24) t(h)) AS peak FROM w),
e AS (SELECT *, greatest(0, least(100, (habitat * breeding * population * evening) ** 0.25 * 100)) AS environmental FROM b)
SELECT p_partkey, round(habitat, 6) AS habitat, round(water, 6) AS water, round(breeding, 6) AS breeding, round(population, 6) AS population, round(evening, 6) AS evening, round(peak, 6) AS peak, round(environmental, 6) AS environmental,
 CASE WHEN environmental <= 15 THEN 1 WHEN environmental <= 35 THEN 2 WHEN environmental <= 55 THEN 3 WHEN environmental <= 75 THEN 4 ELSE 5 END AS environmental_level FROM e
""")
def environmental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evidence index for each part as a site with one user's weather."""
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.struct(
        F.format_string("2024-06-01T%02d:00", h).alias("time"), (12 + h * 0.5).alias("temperatureC"), F.lit(70.0).alias("relativeHumidity"), F.lit(0.0).alias("precipitationMm"),
        F.lit(5.0).alias("windSpeedKmh"), F.lit(10.0).alias("windGustKmh"), h.between(5, 19).alias("isDay")))
    history = weather_history(spark, sf_dir)
    users = history.agg(F.max("user_id").alias("users"))
    sites = spread(profiles(spark, sf_dir).crossJoin(F.broadcast(users)).withColumn("user_id", F.col("p_partkey") % (F.col("users") + 1)), "user_id").join(spread(history, "user_id"), "user_id", "left")
    rows = sites.withColumn("history", F.coalesce("history", F.filter(F.array(*[F.lit(None).cast(history.schema["history"].dataType.elementType)]), lambda x: F.lit(False)))).withColumn("hourly", hours)
    rows = rows.withColumn("sunrise", F.lit("2024-06-01 05:00:00").cast("timestamp")).withColumn("sunset", F.lit("2024-06-01 20:00:00").cast("timestamp"))
    return evidence.score_environment(rows).select("p_partkey", *(F.round(c, 6).alias(c) for c in ("habitat", "water", "breeding", "population", "evening", "peak", "environmental")), "environmental_level")


_BLENDED = """
x AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS env, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 1000 END AS rs, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 ELSE 0 END AS rc, l_discount * 900 AS hs, l_tax * 12 AS hc, CAST(l_quantity AS BIGINT) % 8 AS d,
 l_linenumber % 4 AS n, l_tax * 10 AS agreed, l_discount * 11 AS sites FROM lineitem),
w AS (SELECT *, CASE WHEN d <= 1 THEN 0.5 WHEN d <= 3 THEN 0.35 ELSE 0.2 END::DOUBLE * rc AS a, 0.25::DOUBLE * hc AS b, 1 - CASE WHEN d <= 1 THEN 0.25 WHEN d <= 3 THEN 0.4 ELSE 0.55 END::DOUBLE AS most FROM x),
v AS (SELECT *, a * CASE WHEN a + b > most THEN most / (a + b) ELSE 1 END AS rw, b * CASE WHEN a + b > most THEN most / (a + b) ELSE 1 END AS hw FROM w)"""


@query(f"""
WITH {_BLENDED}, k AS (SELECT *, 1 - rw - hw AS ew, CASE WHEN rs IS NOT NULL AND rw > 0 THEN rw ELSE 0 END AS ww, CASE WHEN hw > 0 THEN hw ELSE 0 END AS yw FROM v),
m AS (SELECT *, (env * ew + coalesce(rs, 0) * ww + hs * yw) / (ew + ww + yw) AS mean FROM k), q AS (SELECT *, (ew * (env - mean) ** 2 + ww * (coalesce(rs, 0) - mean) ** 2 + yw * (hs - mean) ** 2) / (ew + ww + yw) AS var FROM m),
c AS (SELECT *, greatest(0, least(1, (hc * 0.35 + greatest(0, least(1, sites)) * 0.3 + greatest(0, least(1, 1 - sqrt(var) / 50)) * 0.35) * (1 - least(d, 7) * 0.045))) AS sure FROM q)
SELECT l_orderkey, l_linenumber, round(sure, 6) AS confidence, CASE WHEN sure >= 0.72 THEN 'high' WHEN sure >= 0.45 THEN 'medium' ELSE 'low' END AS confidence_band,
 array_to_string(list_filter([CASE WHEN n = 0 THEN 'Based mainly on weather and habitat; no recent reports.' WHEN agreed < 0.65 THEN 'Recent reports are inconsistent.'
  ELSE 'Adjusted ' || CASE WHEN rs > env THEN 'upward' ELSE 'downward' END || ' using ' || n || ' consistent recent campground report' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.' END,
  CASE WHEN hc > 0 THEN 'Historical seasonal reports support the campground outlook.' END, CASE WHEN sites < 0.6 THEN 'Limited habitat information is available for this campground.' END,
  CASE WHEN abs(rs - env) >= 15 THEN 'Recent reports indicate ' || CASE WHEN rs > env THEN 'higher' ELSE 'lower' END || ' activity than the weather estimate.' END], lambda r: r IS NOT NULL), ' ') AS reasons FROM c
""")
def final_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, its band and its reasons for blended rows."""
    c = F.col
    even = c("l_linenumber") % 2 == 0
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_quantity") * 2).alias("environmental"), F.when(even, c("l_tax") * 1000).alias("recent_signal"), F.when(even, c("l_discount") * 10).otherwise(0.0).alias("recent_confidence"),
        (c("l_discount") * 900).alias("historical_signal"), (c("l_tax") * 12).alias("historical_confidence"), (c("l_quantity").cast("long") % 8).alias("day_offset"), (c("l_tax") * 12).alias("completeness"),
        (c("l_discount") * 11).alias("habitat_completeness"), (c("l_linenumber") % 4).alias("recent_reports"), (c("l_tax") * 10).alias("recent_agreement"),
    )
    out = evidence.final_confidence(evidence.blend(rows))
    return out.select("l_orderkey", "l_linenumber", F.round("confidence", 6).alias("confidence"), "confidence_band", F.array_join("confidence_reasons", " ").alias("reasons"))


_HOURS = "h AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, value AS t, CASE WHEN event_id % 5 > 0 THEN value / 2 END AS u, CASE WHEN event_id % 7 > 0 THEN value / 10 END AS rain FROM events)"
_DAYS = "d AS (SELECT user_id, day, avg(t) AS t, min(t) AS low, max(t) AS high, avg(u) AS u, coalesce(sum(rain), 0) AS rain, avg(u) FILTER (WHERE hour BETWEEN 18 AND 23) AS evening, count(DISTINCT hour) AS available FROM h GROUP BY 1, 2)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("value").alias("temperature"), F.when(e % 5 > 0, F.col("value") / 2).alias("humidity"), F.when(e % 7 > 0, F.col("value") / 10).alias("rain"))


@query(f"""
WITH {_HOURS}, {_DAYS}, w AS (SELECT *, {", ".join(f"coalesce(sum(rain) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 0) AS sum_{k}" for k in (1, 3, 7, 14))} FROM d),
a AS (SELECT * FROM w WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-24')
SELECT user_id, day, round(t, 6) AS temperature, round(low, 6) AS low, round(u, 6) AS humidity, round(evening, 6) AS evening, {", ".join(f"round(sum_{k}, 6) AS sum_{k}" for k in (1, 3, 7, 14))},
 round(sum(available) OVER f / CAST(24 * count(*) OVER f AS DOUBLE), 6) AS completeness FROM a WINDOW f AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)
""")
def weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen days of features from hourly values, with completeness that runs through the days."""
    rows = features.daily_rows(features.by_day(hourly(spark, sf_dir), "user_id", "at"), "user_id", "2024-01-10")
    return rows.select("user_id", "day", *(F.round(c, 6).alias(c) for c in ("temperature", "low", "humidity", "evening", "sum_1", "sum_3", "sum_7", "sum_14", "completeness")))


@query(f"""
WITH {_HOURS}, {_DAYS}, w AS (SELECT *, coalesce(sum(rain) OVER p, 0) AS past_rain, count(*) OVER p AS past_days, min(day) OVER p AS first_day FROM d WINDOW p AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS day_offset FROM w WHERE day >= DATE '2024-01-20')
SELECT user_id, day, CAST(day_offset AS BIGINT) AS day_offset, past_days, first_day, round(past_rain, 6) AS past_rain FROM a WHERE day_offset < 8
""")
def evidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight days, each with up to sixty days before it."""
    rows = features.evidence_rows(features.by_day(hourly(spark, sf_dir), "user_id", "at"), "user_id", "2024-01-20")
    rain = F.aggregate("history", F.lit(0.0), lambda a, d: a + d["rain"])
    return rows.select("user_id", "day", F.col("day_offset").cast("long").alias("day_offset"), F.size("history").cast("long").alias("past_days"), F.get("history", F.lit(0))["day"].alias("first_day"), F.round(rain, 6).alias("past_rain"))
