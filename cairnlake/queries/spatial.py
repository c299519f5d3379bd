"""Points: boxes, radius and nearest joins, clusters, suppression, zones.

Customers and suppliers get coordinates from their keys.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import keys, raster, spatial
from ..sources.feeds import table
from .registry import query

_LAT, _LON = "14 + CAST({k} * 7919 % 7000 AS DOUBLE) / 100", "-180 + CAST({k} * 104729 % 12800 AS DOUBLE) / 100"


def _sql(name: str, key: str, alias: str, prefix: str = "") -> str:
    return f"{alias} AS (SELECT {key} AS {prefix}id, {_LAT.format(k=key)} AS {prefix}lat, {_LON.format(k=key)} AS {prefix}lon FROM {name})"


_DISTANCE = (
    "2 * 6371008.8 * atan2(sqrt(sin(radians(r_lat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(r_lat)) * sin(radians(r_lon - lon) / 2) ** 2), "
    "sqrt(1 - (sin(radians(r_lat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(r_lat)) * sin(radians(r_lon - lon) / 2) ** 2)))"
)
_BOTH = f"WITH {_sql('customer', 'c_custkey', 'c')}, {_sql('supplier', 's_suppkey', 's', 'r_')}, d AS (SELECT c.id, r_id, {_DISTANCE} AS m FROM c CROSS JOIN s)"


def points(spark: SparkSession, sf_dir: str, name: str, key: str, prefix: str = "") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias(f"{prefix}id"), F.expr(_LAT.format(k=key)).alias(f"{prefix}lat"), F.expr(_LON.format(k=key)).alias(f"{prefix}lon"))


@query(f"WITH {_sql('customer', 'c_custkey', 'c')} SELECT id, lat, lon FROM c WHERE lon BETWEEN -140 AND -90 AND lat BETWEEN 20 AND 60 AND NOT (lat = 0 AND lon = 0)")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir, "customer", "c_custkey")
    return df.where(geo.in_box(F.col("lon"), F.col("lat"), -140, 20, -90, 60) & geo.valid_point(F.col("lon"), F.col("lat")))


@query(f"{_BOTH} SELECT id, r_id, round(m, 2) AS distance_m FROM d WHERE m <= 150000")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.radius_join(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey", "r_"), 150_000)
    return pairs.select("id", "r_id", F.round("distance_m", 2).alias("distance_m"))


@query(f"{_BOTH} SELECT id, r_id, CAST(k AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, r_id) AS k FROM d WHERE m <= 600000) WHERE k <= 3")
def nearest_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.nearest_in_radius(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey", "r_"), "id", "r_id", 600_000, 3)
    return found.select("id", "r_id", F.col("rank").cast("long").alias("rank"))


@query(f"{_BOTH} SELECT id, r_id, round(m, 2) AS distance_m FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, r_id) = 1")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supplier of each customer, whatever the distance."""
    found = spatial.nearest(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey", "r_"), "id", "r_id", 300_000)
    return found.select("id", "r_id", F.round("distance_m", 2).alias("distance_m"))


@query(f"""
WITH {_sql('customer', 'c_custkey', 'c')}, g AS (SELECT *, CAST(floor((lon + 180) / 1.40625) AS BIGINT) AS cx, CAST(floor((lat + 90) / 1.40625) AS BIGINT) AS cy FROM c), n AS (SELECT cx, cy, count(*) AS n, avg(lat) AS a, avg(lon) AS o FROM g GROUP BY 1, 2)
SELECT 'cluster' AS kind, NULL::BIGINT AS id, cx, cy, n, round(a, 6) AS lat, round(o, 6) AS lon FROM n WHERE n >= 4 UNION ALL SELECT 'point', id, cx, cy, 1, round(lat, 6), round(lon, 6) FROM g JOIN n USING (cx, cy) WHERE n < 4
""")
def grid_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of zoom 5: from four points on one cluster, below that the points."""
    out = spatial.grid_clusters(points(spark, sf_dir, "customer", "c_custkey"), "id", geo.cluster_degrees(5))
    return out.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(f"""
WITH {_sql('customer', 'c_custkey', 'c')}, g AS (SELECT *, CAST(floor(lon / 8 / 0.5) AS BIGINT) AS cx, CAST(floor(lat / 8 / 0.5) AS BIGINT) AS cy FROM c)
SELECT cx, cy, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, array_to_string(list_slice(list(CAST(id AS VARCHAR) ORDER BY id), 1, 5), ',') AS top FROM g GROUP BY 1, 2 HAVING count(*) >= 3
""")
def half_degree_cells_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir, "customer", "c_custkey").select("*", geo.cell(F.col("lon") / 8, 0.5).alias("cx"), geo.cell(F.col("lat") / 8, 0.5).alias("cy"))
    cells = df.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon")).where("n >= 3")
    # A group limit keeps five rows of each cell and task before the shuffle, so no cell is ever gathered.
    first = keys.top_n_per_key(df.select("cx", "cy", "id"), ["cx", "cy"], [F.asc("id")], 5)
    top = first.groupBy("cx", "cy").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("top"))
    return cells.join(top, ["cx", "cy"])


_TO_KEPT = re.sub(r"\b(r_)?(lat|lon)\b", lambda m: f"o.{m[2]}" if m[1] else f"e.{m[2]}", _DISTANCE)


@query(f"""
WITH RECURSIVE {_sql('customer', 'c_custkey', 'c')}, o AS (SELECT id, lat, lon, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, id) AS k FROM c JOIN customer ON c_custkey = id),
r AS (SELECT g, k, [{{'id': id, 'lat': lat, 'lon': lon}}] AS kept FROM o WHERE k = 1
 UNION ALL SELECT o.g, o.k, CASE WHEN len(list_filter(kept, lambda e: {_TO_KEPT} <= 900000)) = 0 THEN list_append(kept, {{'id': o.id, 'lat': o.lat, 'lon': o.lon}}) ELSE kept END FROM r JOIN o ON o.g = r.g AND o.k = r.k + 1),
f AS (SELECT unnest(kept) AS e FROM (SELECT kept FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1))
SELECT e.id AS id FROM f
""")
def greedy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance, kept if no kept one of their nation is within 900 km."""
    df = points(spark, sf_dir, "customer", "c_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal"), "id")
    return spatial.suppress(df, "c_nationkey", "c_acctbal", "id", 900_000).select("id")


@query("""
WITH p AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE len(embedding) = 64),
z AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, sqrt((i % 8 - 3.5) ** 2 + (i // 8 - 3.5) ** 2) AS d FROM p)
SELECT label, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE d < 2), 6) AS positive_inner, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE d >= 2 AND d < 4), 6) AS positive_middle,
round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE d >= 4 AND d < 9), 6) AS positive_outer, round(median(v), 6) AS middle FROM z GROUP BY 1
""")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 by 8 rasters: shares by ring around the middle, and the median."""
    pixels = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    d = F.sqrt(F.pow(F.col("i") % 8 - 3.5, 2) + F.pow(F.floor(F.col("i") / 8) - 3.5, 2))
    rings = spatial.ring_fractions(pixels.withColumn("d", d).withColumn("positive", F.col("v") > 0), ["label"], "d", ["positive"], [("inner", 0, 2), ("middle", 2, 4), ("outer", 4, 9)])
    middle = pixels.groupBy("label").agg(F.round(F.median("v"), 6).alias("middle"))
    return rings.select("label", *(F.round(c, 6).alias(c) for c in ("positive_inner", "positive_middle", "positive_outer"))).join(middle, "label")


_HORN = {(-1, -1): "a", (-1, 0): "b", (-1, 1): "c", (0, -1): "d", (0, 1): "f", (1, -1): "g", (1, 0): "h", (1, 1): "i"}
_NEIGHBOURS = ", ".join(f"max(CASE WHEN dy = {y} AND dx = {x} THEN coalesce(n.v, o.v) END) AS {c}" for (y, x), c in _HORN.items())


@query(f"""
WITH p AS (SELECT vec_id // 10 AS ty, vec_id % 10 AS tx, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE len(embedding) = 64),
c AS MATERIALIZED (SELECT ty, tx, ty * 8 + i // 8 AS gy, tx * 8 + i % 8 AS gx, i, v FROM p),
k AS (SELECT c.*, dy, dx FROM c, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE dy <> 0 OR dx <> 0),
w AS (SELECT k.gy, k.gx, k.i, k.v, {_NEIGHBOURS} FROM k LEFT JOIN c n ON n.gy = k.gy + dy AND n.gx = k.gx + dx
      JOIN c o ON o.gy = greatest(least(k.gy + dy, k.ty * 8 + 7), k.ty * 8) AND o.gx = greatest(least(k.gx + dx, k.tx * 8 + 7), k.tx * 8) GROUP BY 1, 2, 3, 4),
s AS (SELECT i, v, degrees(atan(sqrt((((c + 2 * f + i_) - (a + 2 * d + g)) / 8) ** 2 + (((g + 2 * h + i_) - (a + 2 * b + c)) / 8) ** 2))) AS slope FROM (SELECT * RENAME (i_1 AS i_) FROM w)),
r AS (SELECT *, sqrt((i % 8 - 3.5) ** 2 + (i // 8 - 3.5) ** 2) AS away FROM s)
SELECT CASE WHEN away < 2 THEN 'inner' WHEN away < 4 THEN 'middle' ELSE 'outer' END AS ring, count(*) AS cells, round(median(slope), 6) AS slope, round(median(v), 6) AS elevation FROM r GROUP BY 1
""".replace(" AS i FROM k LEFT", " AS i_1 FROM k LEFT"))
def slope_by_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 by 8 tiles of one grid: median slope and elevation by ring around the middles of the tiles."""
    tiles = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select(F.floor(F.col("vec_id") / 10).alias("ty"), (F.col("vec_id") % 10).alias("tx"), F.col("embedding").alias("values"))
    cells = raster.slopes(tiles, [], 8, 1.0)
    away = F.sqrt(F.pow(F.col("gx") % 8 - 3.5, 2) + F.pow(F.col("gy") % 8 - 3.5, 2))
    ring = F.when(away < 2, "inner").when(away < 4, "middle").otherwise("outer")
    return cells.groupBy(ring.alias("ring")).agg(F.count("*").alias("cells"), F.round(F.median("slope"), 6).alias("slope"), F.round(F.median("elevation"), 6).alias("elevation"))


_STAR = "list_transform(range(0, 5 + p_partkey % 4), lambda j: [(3 + (p_partkey * 7 + j * 13) % 5) * cos(2 * pi() * j / (5 + p_partkey % 4)), (3 + (p_partkey * 7 + j * 13) % 5) * sin(2 * pi() * j / (5 + p_partkey % 4))])"


@query(f"""
WITH p AS (SELECT p_partkey, {_STAR} AS star FROM part),
r AS (SELECT p_partkey, star AS ring FROM p UNION ALL SELECT p_partkey, [[-0.8, -0.8], [0.8, -0.8], [0.8, 0.8], [-0.8, 0.8]] FROM p WHERE p_partkey % 3 = 0),
e AS (SELECT p_partkey, ring[j][1] AS x1, ring[j][2] AS y1, ring[j % len(ring) + 1][1] AS x2, ring[j % len(ring) + 1][2] AS y2 FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS j FROM r)),
g AS (SELECT row, col, (row + 0.5) * 0.5 AS y, (col + 0.5) * 0.5 AS x FROM (SELECT unnest(range(-16, 16)) AS row), (SELECT unnest(range(-16, 16)) AS col)),
m AS MATERIALIZED (SELECT p_partkey, row, col FROM e JOIN g ON (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) <= x GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
o AS (SELECT m.p_partkey, count(*) AS open FROM m CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS d(dy, dx) ANTI JOIN m n ON n.p_partkey = m.p_partkey AND n.row = m.row + dy AND n.col = m.col + dx GROUP BY 1)
SELECT p_partkey, count(*) AS cells, count(*) * 0.25::DOUBLE AS area, any_value(open) * 0.5::DOUBLE AS shore FROM m JOIN o USING (p_partkey) GROUP BY 1
""")
def shape_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars from keys of parts, some with a hole: area and length of shore of their cells."""
    k = F.col("p_partkey")
    n = 5 + k % 4
    radius = lambda j: 3 + (k * 7 + j * 13) % 5
    star = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.array(radius(j) * F.cos(2 * math.pi * j / n), radius(j) * F.sin(2 * math.pi * j / n)))
    hole = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((-0.8, -0.8), (0.8, -0.8), (0.8, 0.8), (-0.8, 0.8))))
    shapes = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.array(star, hole)).otherwise(F.array(star)).alias("rings"))
    return raster.areas(raster.spans(shapes, "p_partkey", "rings", 0.5), "p_partkey", 0.5)


_ARC = "sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS sn, s1 * s2 + c1 * c2 * cos(lam) AS cs"
_AZIMUTH = "CASE WHEN sn = 0 THEN 0 ELSE c1 * c2 * sin(lam) / sn END AS az, atan2(sn, cs) AS arc"
_MIDDLE = "CASE WHEN az * az >= 1 THEN 0 ELSE cs - 2 * s1 * s2 / (1 - az * az) END AS md, 1 - az * az AS rest"
_F, _MINOR = repr(geo.FLATTENING), repr(geo.AXIS_M * (1 - geo.FLATTENING))
_SQUARED = f"rest * {(geo.AXIS_M**2 - (geo.AXIS_M * (1 - geo.FLATTENING)) ** 2) / (geo.AXIS_M * (1 - geo.FLATTENING)) ** 2!r}"


def _arcs(source: str) -> str:
    """Each row of a source with the angles of its great circle on the auxiliary sphere."""
    return f"(SELECT *, {_MIDDLE} FROM (SELECT *, {_AZIMUTH} FROM (SELECT *, {_ARC} FROM {source})))"


@query(f"""
WITH RECURSIVE {_sql('customer', 'c_custkey', 'c')}, {_sql('supplier', 's_suppkey', 's', 'r_')},
near AS (SELECT c.id, r_id, radians(r_lon - lon) AS turn, atan((1 - {_F}) * tan(radians(lat))) AS u1, atan((1 - {_F}) * tan(radians(r_lat))) AS u2 FROM c CROSS JOIN s WHERE {_DISTANCE} <= 152000),
e AS (SELECT id, r_id, turn, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM near),
w AS (SELECT id, r_id, turn, s1, c1, s2, c2, turn AS lam, 0 AS k FROM e UNION ALL
 SELECT id, r_id, turn, s1, c1, s2, c2, turn + (1 - f) * {_F} * az * (arc + f * sn * (md + f * cs * (2 * md * md - 1))), k + 1 FROM (SELECT *, {_F} / 16 * rest * (4 + {_F} * (4 - 3 * rest)) AS f FROM {_arcs('w')}) WHERE k < 12),
p AS (SELECT id, r_id, sn, cs, md, arc, {_SQUARED} AS q FROM {_arcs('w')} WHERE k = 12),
l AS (SELECT *, 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768)) AS a, q / 1024 * (256 + q * (q * (74 - 47 * q) - 128)) AS b FROM p),
m AS (SELECT id, r_id, {_MINOR} * a * (arc - b * sn * (md + b / 4 * (cs * (2 * md * md - 1) - b / 6 * md * (4 * sn * sn - 3) * (4 * md * md - 3)))) AS m FROM l)
SELECT id, r_id, round(m, 2) AS distance_m FROM m WHERE m <= 150000
""")
def radius_join_ellipsoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers within 150 km on the ellipsoid."""
    pairs = spatial.radius_join(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey", "r_"), 150_000, ellipsoid=True)
    return pairs.select("id", "r_id", F.round("distance_m", 2).alias("distance_m"))
