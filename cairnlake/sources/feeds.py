"""Readers.  Feeds that come over HTTP are landed as files first, one page to a file; these read what landed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import valid_point
from ..operators import spatial
from ..operators.rules import problems


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geojson_lines(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """GeoJSON text sequences: one feature to a line, perhaps after a record separator."""
    schema = f"type string, id string, geometry struct<type:string,coordinates:string>, properties {properties}"
    text = spark.read.text(path).select(F.regexp_replace("value", "^\\x1e", "").alias("line")).where("line <> ''")
    return text.select(F.from_json("line", schema).alias("f"), F.col("line")).select("f.*", F.expr("f IS NULL OR f.type IS NULL").alias("rejected"))


def json_document(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """A feed that is one JSON document with its records in one array."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(rows).alias("r")).select("r.*")


def csv_upload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and errors of an uploaded table of places, each with its row number in the file (from 2).

    The header may name region, province or state, and postalCode or postal_code; quotes in cells are doubled.  An upload is one small file,
    read as one partition, so that running numbers are the file's.
    """
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE").coalesce(1)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    get = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in raw.columns), F.lit(None).cast("string"))
    lat, lon = get("latitude").try_cast("double"), get("longitude").try_cast("double")
    rows = raw.select(
        (F.monotonically_increasing_id() + 2).alias("row_number"), get("name").alias("name"), get("slug").alias("slug"), get("address").alias("address"), get("city").alias("city"),
        get("region", "province", "state").alias("region"), get("country").alias("country"), get("postalCode", "postal_code").alias("postal_code"), lat.alias("lat"), lon.alias("lon"),
    )
    checked = rows.withColumn(
        "errors",
        problems(
            (F.length("name").between(2, 160), "name: 2 to 160 characters"),
            (F.col("slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "slug: lower-case letters, digits and hyphens"),
            (F.length("city") >= 1, "city: required"), (F.length("region") >= 1, "region: required"), (F.length("country") == 2, "country: two letters"),
            (valid_point(F.col("lon"), F.col("lat")), "coordinates: out of range"),
        ),
    )
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0).select("row_number", F.array_join("errors", "; ").alias("message"))


def gazetteer(spark: SparkSession, path: str, columns: list[str], countries: list[str] | None = None, least_population: int = 0) -> DataFrame:
    """A tab-separated gazetteer without header."""
    df = spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in columns), quote="")
    df = df.select(*(F.col(c).try_cast("double").alias(c) if c in ("latitude", "longitude") else F.col(c).try_cast("long").alias(c) if c == "population" else F.col(c) for c in columns))
    if countries:
        df = df.where(F.col("country").isin(*countries))
    return df.where(F.coalesce("population", F.lit(0)) >= least_population) if "population" in columns else df


def places_release(spark: SparkSession, path: str, categories: list[str], countries: list[str], regions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A release of places with nested columns: categories, names, addresses, confidence, bbox, websites.

    Plain predicates and the nested columns that are used reach the Parquet scan; those over arrays don't.
    """
    df = spark.read.parquet(path)
    at_home = F.filter("addresses", lambda a: a["country"].isin(*countries))
    fits = F.col("categories.primary").isin(*categories) | F.arrays_overlap(F.coalesce("categories.alternate", F.array().cast("array<string>")), F.array(*map(F.lit, categories)))
    df = df.where(fits & F.exists("addresses", lambda a: a["country"].isin(*countries)))
    if regions:
        df = df.where(F.exists("addresses", lambda a: a["region"].isin(*regions)))
    first = F.try_element_at(at_home, F.lit(1))
    df = df.select(
        "id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("primary_category"), F.col("categories.alternate").alias("alternate_categories"), "confidence",
        F.try_element_at("websites", F.lit(1)).alias("website"), first["country"].alias("country"), first["region"].alias("region"), first["locality"].alias("locality"), first["freeform"].alias("address"),
        F.col("bbox.xmin").alias("lon"), F.col("bbox.ymin").alias("lat"),
    )
    return df if limit is None else df.limit(limit)


def latest_release(catalog_json: str, override: str | None = None) -> str:
    """The newest release that a small catalog document names."""
    return override or sorted(json.loads(catalog_json)["releases"])[-1]


def weather_payloads(spark: SparkSession, path: str, daily: list[str], hourly: list[str]) -> tuple[DataFrame, DataFrame]:
    """Landed weather responses, one JSON document to a line, as daily and hourly rows."""
    arrays = lambda names: ", ".join(["time: array<string>", *(f"{n}: array<double>" for n in names)])
    df = spark.read.schema(f"entity string, daily struct<{arrays(daily)}>, hourly struct<{arrays(hourly)}>, elevation double").json(path)
    long = lambda part, names: df.select("entity", F.inline(F.arrays_zip(*(F.col(f"{part}.{n}").alias(n) for n in ("time", *names)))))
    return long("daily", daily), long("hourly", hourly)


# The monthly values of a seasonal feed, by their names in the result.
SEASONAL = {"temperature_2m_mean": "temperature", "temperature_2m_anomaly": "temperature_anomaly", "precipitation_mean": "precipitation", "precipitation_anomaly": "precipitation_anomaly"}


def seasonal_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(months, rejected) of landed seasonal responses, one JSON document to a line: a row for each entity and month ahead.

    A month must have all its values, and an entity a month; others are rejected with the reason.
    """
    arrays = ", ".join(["time: array<string>", *(f"{n}: array<double>" for n in SEASONAL)])
    df = spark.read.schema(f"entity string, elevation double, monthly struct<{arrays}>").json(path)
    at = lambda c: F.get(F.col(f"monthly.{c}"), F.col("month_offset"))
    months = df.select("entity", "elevation", "monthly", F.posexplode("monthly.time").alias("month_offset", "target_month"))
    told = months.select("entity", "elevation", "target_month", "month_offset", *(at(c).alias(name) for c, name in SEASONAL.items()))
    missing = F.array_compact(F.array(*(F.when(F.col(name).isNull(), F.lit(c)) for c, name in SEASONAL.items())))
    none = df.where(F.coalesce(F.size("monthly.time"), F.lit(0)) <= 0).select("entity", F.lit(None).cast("string").alias("target_month"), F.lit("no months").alias("reason"))
    lacking = told.where(F.size(missing) > 0).select("entity", "target_month", F.concat(F.lit("missing "), F.array_join(missing, ", ")).alias("reason"))
    return told.where(F.size(missing) == 0), none.unionByName(lacking)


# The months of a climatology and their days, and its grid in degrees of latitude and longitude.
MONTH_DAYS = {"JAN": 31, "FEB": 28, "MAR": 31, "APR": 30, "MAY": 31, "JUN": 30, "JUL": 31, "AUG": 31, "SEP": 30, "OCT": 31, "NOV": 30, "DEC": 31}
WARM = ("MAY", "JUN", "JUL", "AUG", "SEP")
GRID = (0.5, 0.625)


def grid_point(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of the climatology's grid point that a place is snapped to."""
    return F.bround(lat / GRID[0]).cast("long"), F.bround(lon / GRID[1]).cast("long")


def climate_normals(entities: DataFrame, points: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key, grid_lat, grid_lon, annual_mm and warm_mm of each entity, from points (lat, lon and a map of millimetres a day by month).

    Entities that share a grid point share its row; one without a point or with a month missing has nulls.
    """
    gy, gx = grid_point(F.col("lat"), F.col("lon"))
    total = lambda names: sum((F.try_element_at("daily", F.lit(m)) * MONTH_DAYS[m] for m in names), F.lit(0.0))
    known = points.select(gy.alias("gy"), gx.alias("gx"), "daily").dropDuplicates(["gy", "gx"]).select("gy", "gx", total(MONTH_DAYS).alias("annual_mm"), total(WARM).alias("warm_mm"))
    ey, ex = grid_point(F.col(lat), F.col(lon))
    placed = entities.select(key, ey.alias("gy"), ex.alias("gx"))
    return placed.join(known, ["gy", "gx"], "left").select(key, (F.col("gy") * GRID[0]).alias("grid_lat"), (F.col("gx") * GRID[1]).alias("grid_lon"), "annual_mm", "warm_mm")


def paged_json(spark: SparkSession, manifest: str, rows: str, columns: list[str]) -> DataFrame:
    """The rows of the landed pages of a paged API that a manifest {"pages": [paths]} lists, by Spark's own readers.

    rows: where a page has its list, such as ``data.rows``.  Values come as text, nested ones as JSON; missing ones are
    null.  Only the manifest's paths come to the driver, to be read like any list of files.
    """
    listed = spark.read.schema("pages array<string>").json(manifest, multiLine=True)
    paths = [r.p for r in listed.select(F.explode("pages").alias("p")).collect()]
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    body = spark.read.text(paths, wholetext=True)
    each = body.select(F.explode(F.from_json(F.get_json_object("value", f"$.{rows}" if rows else "$"), "array<string>")).alias("row"))
    return each.select(*(F.get_json_object("row", f"$.{c}").alias(c) for c in columns))


def paged_with_counts(spark: SparkSession, path: str, rows: str, count: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, pages): the rows of a folder of landed pages, and for each file its number of rows and the page count it states."""
    body = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    found = body.select("file", F.get_json_object("value", f"$.{count}").cast("int").alias("page_count"), F.from_json(F.get_json_object("value", f"$.{rows}"), "array<string>").alias("rows"))
    each = found.select("file", F.explode("rows").alias("row")).select("file", *(F.get_json_object("row", f"$.{c}").alias(c) for c in columns))
    return each, found.select("file", "page_count", F.coalesce(F.size("rows"), F.lit(0)).alias("n"))


def bulk(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bulk file in place of an API: JSON by its ending, else CSV with a header; blank lines and byte-order marks go."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))
    df = spark.read.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.lstrip("\ufeff").strip().lower(): c for c in df.columns}
    wanted = spark.createDataFrame([], schema).schema
    return df.select(*(F.col(f"`{names[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) if f.name.lower() in names else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def near_gaps(found: DataFrame, gaps: DataFrame, metres: float) -> DataFrame:
    """Rows that radius queries around gaps gave, each once, with the nearest gap within the radius; others go."""
    once = found.dropDuplicates(["id"])
    pairs = spatial.nearest_in_radius(once, gaps.select(F.col("gap_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), "id", "gap_id", metres, 1)
    return pairs.select(*once.columns, "gap_id", "distance_m")


def archive_days(daily: DataFrame, hourly: DataFrame, columns: dict[str, str], means: dict[str, str]) -> DataFrame:
    """One row for each entity and day from landed daily rows and the means of its hours; what is missing counts as 0.

    columns, means: name in the result by name in the daily and in the hourly rows; both have entity and time.
    """
    by_day = hourly.groupBy("entity", F.to_date(F.substring("time", 1, 10)).alias("day")).agg(*(F.avg(c).alias(name) for c, name in means.items()))
    days = daily.select("entity", F.to_date("time").alias("day"), *(F.col(c).alias(name) for c, name in columns.items()))
    names = [*columns.values(), *means.values()]
    return days.join(by_day, ["entity", "day"], "left").select("entity", "day", *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names))


def load_profiles(rows: DataFrame, known: DataFrame, active: DataFrame, values: list[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, rejected) after a batch of profiles by slug: rows with a value that isn't a finite number or with an
    unknown slug are rejected, the others become the active version of their entity (known: slug, id)."""
    finite = F.forall(F.array(*(F.col(v).cast("double") for v in values)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = rows.join(known, "slug", "left").withColumn("reason", F.when(F.col("id").isNull(), "unknown_slug").when(~F.coalesce(finite, F.lit(False)), "not_finite"))
    fresh = told.where("reason IS NULL").select("id", F.lit(version).alias("version"), *values, F.lit(True).alias("active"))
    old = active.join(fresh.select("id", "version"), ["id", "version"], "left_anti").join(fresh.select("id", F.lit(False).alias("__off")), "id", "left")
    old = old.withColumn("active", F.coalesce("__off", "active")).select(*fresh.columns)
    return old.unionByName(fresh), told.where("reason IS NOT NULL").select("slug", "reason")
