"""Habitat profiles from rings, land cover, and small forms of numbers, dates and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, jsonx, numeric, text
from ..plans import habitat
from ..sources.feeds import table
from .registry import query

_RINGS = "(s * 0.6 + p * 0.3 + s * p * 0.1)"


@query(f"""
WITH x AS (SELECT p_partkey, p_size, p_size / 50.0::DOUBLE AS s, greatest(0, (p_retailprice - 900) / 1201) AS p FROM part),
v AS (SELECT *, 0.7 * p + 0.3 * s AS vegetation, 1 - exp(-(p_size % 7) / 5.0::DOUBLE) AS small, exp(-p_size * 20 / 500.0::DOUBLE) AS slow, {_RINGS} / 4 AS marsh, {_RINGS} / 8 AS wetland, {_RINGS} / 2 AS seasonal FROM x),
d AS (SELECT *, greatest(0, least(1, 0.2 + least(p_size / 2.0::DOUBLE / 15, 1) * 0.6 + (1 - vegetation) * 0.2 - least(1, s / 8 * 4) * 0.3)) AS drainage FROM v)
SELECT p_partkey, round(small, 9) AS small, round(vegetation, 9) AS vegetation, round(drainage, 9) AS drainage, round(greatest(0, least(1, marsh * 0.4 + wetland * 0.2 + seasonal * 0.15 + small * 0.15 + slow * 0.1)), 9) AS stagnant,
 round(greatest(0, least(1, (1 - drainage) * (marsh + wetland + seasonal + exp(-p_size * 10 / 250.0::DOUBLE)) / 4)), 9) AS flood,
 round(0.25 + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.15 + 0.05 ELSE 0 END, 9)::DOUBLE AS confidence FROM d
""")
def habitat_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived values of profiles whose measured ones come from parts."""
    n, s = F.col("p_size"), F.col("p_size") / F.lit(50.0)
    p = F.greatest(F.lit(0.0), (F.col("p_retailprice") - 900) / 1201)
    ring = lambda by: F.struct((s / by).alias("within250m"), (p / by).alias("from250mTo1km"), (s * p / by).alias("from1kmTo3km"))
    has = F.create_map(F.lit("cover"), F.lit(True), F.lit("water"), n % 2 == 0, F.lit("terrain"), n % 3 == 0, F.lit("wetlands"), n % 5 == 0, F.lit("hydrography"), n % 5 == 0)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", ring(4).alias("marsh"), ring(8).alias("wetland"), ring(2).alias("seasonal"), p.alias("vegetation_near"), s.alias("vegetation_middle"), (n % 7).alias("small_waters"), (n / 2).alias("slope"),
        (n * 10).alias("lake_m"), (n * 30).alias("fast_m"), (n * 20).alias("slow_m"), has.alias("has"),
    )
    names = {"small": "smallWaterBodyDensity", "vegetation": "vegetationCoverage", "drainage": "drainagePotential", "stagnant": "stagnantWaterPotential", "flood": "floodplainExposure", "confidence": "profileConfidence"}
    return habitat.derive(rows).select("p_partkey", *(F.round(c, 9).alias(name) for name, c in names.items()))


_NAMES = " ".join(f"WHEN {code} THEN '{name}'" for code, name in habitat.CLASS_NAMES.items())


@query(f"""
WITH c AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) % 12 * 10 AS code FROM lineitem), n AS (SELECT l_orderkey, code, count(*) AS n FROM c WHERE code > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, code DESC) AS r FROM n)
SELECT l_orderkey, string_agg(CASE code {_NAMES} ELSE 'class ' || code END, ' / ' ORDER BY r) AS "landCoverType" FROM r WHERE r <= 2 GROUP BY 1
""")
def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most frequent classes around each place."""
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("long") % 12 * 10).alias("code"))
    return habitat.land_cover(pixels, "l_orderkey", "code")


_DATES = "['2024-02-29', '2023-02-29', '2024-13-01', 'soon', '2024-1-1', '1999-12-31']"


@query(rf"""
WITH x AS (SELECT p_partkey AS k, CAST(p_partkey AS DOUBLE) / 8 AS x, p_partkey * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END AS n, {_DATES}[p_partkey % 6 + 1] AS d FROM part)
SELECT k, floor(x / 0.75 + 0.5) * 0.75 AS up, round_even(x / 0.5, 0) * 0.5 AS even, CASE WHEN n >= 1000000 THEN format('{{:.1f}}', n / 1000000::DOUBLE) || 'm' WHEN n >= 1000 THEN format('{{:.1f}}', n / 1000::DOUBLE) || 'k' ELSE CAST(n AS VARCHAR) END AS label,
 CAST(('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 8))::BIGINT % 5 AS BIGINT) AS variant, CAST(('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 8))::BIGINT % 10080 AS BIGINT) AS minute,
 CASE WHEN regexp_matches(d, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN TRY_CAST(d AS DATE) END AS day, CAST(CASE WHEN regexp_matches(d, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN TRY_CAST(d AS DATE) END AS TIMESTAMP) + INTERVAL 12 HOUR AS noon,
 'A' || k % 10 || '00FF-' || 'FF' || k % 7 || 'A00' AS colours FROM x
""")
def small_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapped numbers, labels, stable variants and minutes, checked dates and colour keys."""
    k = F.col("p_partkey")
    n = k * F.when(k % 3 == 0, 1).when(k % 3 == 1, 100).otherwise(10_000)
    said = F.element_at(F.array(*map(F.lit, ("2024-02-29", "2023-02-29", "2024-13-01", "soon", "2024-1-1", "1999-12-31"))), (k % 6 + 1).cast("int"))
    day = calendar.valid_date(said)
    colours = text.colour_key(F.concat(F.lit("#a"), (k % 10).cast("string"), F.lit("00ff")), F.concat(F.lit("ff"), (k % 7).cast("string"), F.lit("a00")))
    return table(spark, sf_dir, "part").select(
        k.alias("k"), numeric.snap_half_up(k / 8, 0.75).alias("up"), numeric.snap_half_even(k / 8, 0.5).alias("even"), numeric.compact_number(n).alias("label"), text.variant(k, 5).alias("variant"),
        calendar.stagger_minutes(k).alias("minute"), day.alias("day"), calendar.noon(day).cast("timestamp_ntz").alias("noon"), colours.alias("colours"),
    )


@query("""
SELECT p_partkey, p_brand || ',' || lower(p_type) AS amenities, CASE WHEN p_size % 3 = 0 THEN 'name=' || p_name ELSE 'name=' || p_name || ';size=' || p_size END AS kept,
 array_to_string(list_filter([CASE WHEN p_size > 10 THEN 'water' END, CASE WHEN p_size > 20 THEN 'fire' END, CASE WHEN p_size > 30 THEN 'showers' END, CASE WHEN p_size > 40 THEN 'store' END], lambda x: x IS NOT NULL)[1:3], ',') AS products FROM part
""")
def payload_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and wanted keys of JSON payloads, and the first three that fit."""
    n = F.col("p_size")
    payload = F.to_json(F.struct(F.array("p_brand", F.lower("p_type")).alias("amenities"), F.col("p_name").alias("name"), F.when(n % 3 == 0, "").otherwise(n.cast("string")).alias("size"), F.lit("x").alias("other")))
    kept = jsonx.keep_keys(jsonx.entries(F.col("payload")), "name", "size", "none")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    fits = F.array_compact(F.array(F.when(n > 10, "water"), F.when(n > 20, "fire"), F.when(n > 30, "showers"), F.when(n > 40, "store")))
    rows = table(spark, sf_dir, "part").select("p_partkey", payload.alias("payload"), F.slice(fits, 1, 3).alias("products"))
    return rows.select("p_partkey", F.array_join(jsonx.strings(F.col("payload"), "$.amenities"), ",").alias("amenities"), listed.alias("kept"), F.array_join("products", ",").alias("products"))
