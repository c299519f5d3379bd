"""Sinks.  Spark's committer makes each of them appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..operators.jobs import checkpoint


def quoted_csv(df: DataFrame, path: str) -> None:
    """Every cell in quotes, quotes doubled, lines ended by CR LF."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="", nullValue="")


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def counted(df: DataFrame, path: str, **tests: Column) -> dict[str, int]:
    """Write a table and count its rows, and those for which each test holds, in the same pass; the counts.

    A test that is null for a row doesn't hold.  Counts are of the run that wrote; retried tasks don't count twice.
    """
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in tests.items()))
    watched.write.mode("overwrite").parquet(path)
    return dict(seen.get)


def features(df: DataFrame, lon: str, lat: str, *properties: str) -> Column:
    """A GeoJSON feature as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))


def geojson(df: DataFrame, path: str, lon: str, lat: str, *properties: str) -> None:
    """Features line by line, which readers of GeoJSON sequences take; a collection would be one task's file."""
    df.select(features(df, lon, lat, *properties).alias("value")).write.mode("overwrite").text(path)


def sitemap(df: DataFrame, url: str, changed: str) -> DataFrame:
    """One <url> element to a row."""
    day = F.date_format(changed, "yyyy-MM-dd")
    return df.select(F.concat(F.lit("<url><loc>"), xml_escape(F.col(url)), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>")).alias("value"))


def wrapped(df: DataFrame, path: str, before: str, after: str, between: str = "") -> None:
    """One document of the column ``value``: opening, elements in order, close, as a folder of part files whose
    concatenation is the document; each task writes its own part, and nothing is gathered."""
    spark = df.sparkSession
    stored = checkpoint(df.select("value").withColumn("__at", F.monotonically_increasing_id()))
    first = stored.agg(F.min("__at")).first()[0]
    body = stored.sort("__at").select(F.when(F.col("__at") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(between), "value")).alias("value"))
    edge = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    edge(before).union(body).union(edge(after)).write.mode("overwrite").text(path)


def feature_collection(df: DataFrame, path: str, lon: str, lat: str, *properties: str) -> None:
    """A GeoJSON FeatureCollection, in parts."""
    wrapped(df.select(features(df, lon, lat, *properties).alias("value")), path, '{"type":"FeatureCollection","features":[', "]}", ",")


def sitemap_document(df: DataFrame, path: str, url: str, changed: str) -> None:
    """A sitemap with its envelope, in parts."""
    wrapped(sitemap(df, url, changed), path, '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>")
