"""Blocking, pair scores, components and survivors over customers as places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entity, graph
from ..plans import resolve
from ..sources.feeds import table
from .registry import query
from .spatial import _DISTANCE, _sql, points

_CELLS = f"WITH {_sql('customer', 'c_custkey', 'c')}, x AS (SELECT id AS r_id, lat AS r_lat, lon AS r_lon FROM c), near AS (SELECT id AS left_id, r_id AS right_id, {_DISTANCE} AS m FROM c JOIN x ON id < r_id WHERE abs(lat - r_lat) < 0.6)"


@query(f"{_CELLS} SELECT left_id, right_id, round(m, 2) AS distance_m FROM near WHERE m <= 50000")
def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within 50 km, by grid cells."""
    return entity.nearby_pairs(points(spark, sf_dir, "customer", "c_custkey"), "id", 50_000).withColumn("distance_m", F.round("distance_m", 2))


@query("""
WITH b AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_size AS v FROM part), s AS (SELECT v FROM b GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM b a JOIN b ON a.v = b.v AND a.p_partkey < b.p_partkey JOIN s ON s.v = a.v
""")
def identity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share an identity, from buckets of 2 to 50."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("v"))
    return entity.identity_pairs(part, "p_partkey", ["v"])


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records with duplicates: every fifth one also stands beside itself under a new id."""
    c = table(spark, sf_dir, "customer").join(points(spark, sf_dir, "customer", "c_custkey"), F.col("id") == F.col("c_custkey"))
    rows = c.select(
        "id", F.concat(F.lit("Pine Lake Site "), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("https://www.example.org/p/"), F.col("c_custkey").cast("string"), F.lit("?utm_source=x")).alias("website"),
        F.lit(None).cast("string").alias("phone"), F.concat(F.col("c_custkey").cast("string"), F.lit(" Long Road")).alias("address"), F.lit("Town").alias("city"), F.lit("WA").alias("region"), F.lit("US").alias("country"),
        "lat", "lon", F.lit("unverified").alias("verification"), (F.col("c_custkey") % 100).cast("int").alias("priority"), F.lit(1).alias("sources"), F.lit(0).alias("reports"),
    )
    again = rows.where("id % 5 = 0").withColumn("id", F.col("id") + 1_000_000_000).withColumn("lat", F.col("lat") + 0.0002).withColumn("priority", F.lit(99))
    return rows.unionByName(again)


@query("""
WITH p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 0)
SELECT id AS left_id, id + 1000000000 AS right_id, CAST(1.0 AS DOUBLE) AS score, 'automatic' AS recommendation FROM p
""")
def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored duplicate pairs; planted copies differ in their numbers from all other records."""
    scored = resolve.duplicate_pairs(resolve.prepared(places(spark, sf_dir)))
    return scored.select("left_id", "right_id", F.round("score", 6).alias("score"), "recommendation")


@query("""
SELECT id AS node, id % 1000000000 AS component, id % 1000000000 + CASE WHEN id % 1000000000 % 100 = 99 THEN 0 ELSE 1000000000 END AS survivor
FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000000 FROM customer WHERE c_custkey % 5 = 0)
""")
def survivor_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = resolve.prepared(places(spark, sf_dir))
    return resolve.merge_plan(records, resolve.duplicate_pairs(records))


_EDGES = "e AS (SELECT o_custkey AS a, xor(o_custkey, 1::BIGINT << CAST(o_orderkey % 5 AS INT)) AS b FROM orders GROUP BY 1, 2)"


@query(f"""
WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS seen FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen)
SELECT node, min(seen) AS component FROM w GROUP BY 1
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a graph with an edge for each order, to the customer whose key differs in one bit."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.expr("o_custkey ^ shiftleft(1L, CAST(o_orderkey % 5 AS INT))").alias("b")).distinct()
    return graph.connected_components(edges, "a", "b")


@query("""
WITH p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 0)
SELECT count(*) AS pairs, 2 * count(*) AS nodes, count(*) AS clusters, CAST(0 AS BIGINT) AS over_two, CAST(2 AS BIGINT) AS largest FROM p
""")
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_statistics(resolve.duplicate_pairs(resolve.prepared(places(spark, sf_dir))), "left_id", "right_id")


@query("""
SELECT c_custkey + 2000000000 AS i_id, c_custkey AS c_id, 'automatic' AS decision FROM customer WHERE c_custkey % 7 = 0
""")
def match_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming records beside their canonical ones, each matched to its own."""
    rows = places(spark, sf_dir).where("id < 1000000000").withColumn("operator", F.lit(None).cast("string")).withColumn("parent", F.lit(None).cast("string"))
    rows = rows.select("id", "name", "website", "phone", "address", "region", "country", "lat", "lon", "operator", "parent")
    incoming = rows.where("id % 7 = 0").withColumn("id", F.col("id") + 2_000_000_000).withColumn("lat", F.col("lat") + 0.0001)
    return resolve.match_incoming(incoming, rows, 5_000).select("i_id", "c_id", "decision")
