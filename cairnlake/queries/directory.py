"""Listings: chosen orders, nearby places, first few, parents, uploads, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, geo, numeric, text
from ..operators import keys, rules, spatial
from ..plans import serving
from ..sources.feeds import table
from .registry import query
from .spatial import _BOTH, _DISTANCE, _sql, points

_ORDERS = {"name": "p_name", "cheap": "p_retailprice", "dear": "p_retailprice DESC", "large": "p_size DESC", "brand": "p_brand DESC, p_size"}


@query(" UNION ALL ".join(f"(SELECT '{choice}' AS chosen, p_partkey FROM part ORDER BY {order}, p_name, p_partkey LIMIT 20)" for choice, order in _ORDERS.items()))
def chosen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a listing in each of the orders that a parameter may name."""
    part, out = table(spark, sf_dir, "part"), None
    orders = {"name": [F.asc("p_name")], "cheap": [F.asc("p_retailprice")], "dear": [F.desc("p_retailprice")], "large": [F.desc("p_size")], "brand": [F.desc("p_brand"), F.asc("p_size")]}
    for choice in orders:
        page = part.orderBy(*keys.sorted_by(choice, orders, [F.asc("p_name"), F.asc("p_partkey")])).limit(20).select(F.lit(choice).alias("chosen"), "p_partkey")
        out = page if out is None else out.unionByName(page)
    return out


_HERE = _DISTANCE.replace("r_lat", "45.0").replace("r_lon", "-120.0")


@query(f"""
WITH {_sql('customer', 'c_custkey', 'c')} SELECT id, round({_HERE} / 1000, 3) AS km FROM c ORDER BY (lat - 45.0) ** 2 + ((lon + 120.0) * cos(radians(45.0))) ** 2, id LIMIT 25
""")
def nearest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places sorted by flat distance from a point, shown with their great-circle distance."""
    here = (F.lit(45.0), F.lit(-120.0))
    order = geo.planar_square(F.col("lat"), F.col("lon"), *here)
    first = points(spark, sf_dir, "customer", "c_custkey").orderBy(order, "id").limit(25)
    return first.select("id", F.round(geo.haversine(F.col("lat"), F.col("lon"), *here) / 1000, 3).alias("km"))


@query("""
SELECT p_partkey, array_to_string(list_slice(list_distinct_in_order, 1, 5), ',') AS facilities FROM (SELECT p_partkey, list_filter(v, lambda x, i: x IS NOT NULL AND list_position(v, x) = i) AS list_distinct_in_order FROM
 (SELECT p_partkey, [CASE WHEN p_size % 2 = 0 THEN 'water' END, p_brand, CASE WHEN p_size % 3 = 0 THEN 'water' ELSE 'fire' END, lower(p_type), p_brand, CASE WHEN p_size > 25 THEN 'showers' END, CASE WHEN p_size > 10 THEN 'tables' END] AS v FROM part))
""")
def first_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different facilities of each part."""
    n = F.col("p_size")
    listed = F.array(F.when(n % 2 == 0, "water"), F.col("p_brand"), F.when(n % 3 == 0, "water").otherwise("fire"), F.lower("p_type"), F.col("p_brand"), F.when(n > 25, "showers"), F.when(n > 10, "tables"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(arrays.first_distinct(listed, 5), ",").alias("facilities"))


@query("""
SELECT * FROM (SELECT 'filtered' AS list, c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'segment_first', c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment = 'MACHINERY' DESC, c_acctbal DESC, c_custkey LIMIT 400)
""")
def population_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest few of a filtered list, and a list that puts one kind before all others."""
    c = table(spark, sf_dir, "customer")
    few = c.where((F.col("c_mktsegment") == "BUILDING") & F.col("c_name").ilike("%1%")).orderBy(F.desc("c_acctbal"), "c_custkey").limit(8)
    kind = c.orderBy((F.col("c_mktsegment") == "MACHINERY").cast("int").desc(), F.desc("c_acctbal"), "c_custkey").limit(400)
    return few.select(F.lit("filtered").alias("list"), "c_custkey", "c_acctbal").unionByName(kind.select(F.lit("segment_first").alias("list"), "c_custkey", "c_acctbal"))


@query("SELECT p.p_partkey, u.p_name AS parent_name FROM part p LEFT JOIN part u ON u.p_partkey = p.p_partkey // 10")
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's parent in the same table."""
    part = table(spark, sf_dir, "part").withColumn("parent", F.expr("p_partkey div 10"))
    return keys.parents(part, "p_partkey", "parent", "p_name", "parent_name").select("p_partkey", "parent_name")


@query("""
SELECT c_nationkey, c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey
""")
def join_by_natural_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts find the rows that were written before them by ids made from the natural key, without reading ids back."""
    written = table(spark, sf_dir, "customer").withColumn("name", F.col("c_custkey")).select(keys.natural_id("name").alias("id"), "c_nationkey", "c_custkey")
    facts = table(spark, sf_dir, "orders").withColumn("name", F.col("o_custkey")).select(keys.natural_id("name").alias("id"), "o_orderkey", "o_totalprice")
    return facts.join(written, "id").drop("id")


_SHIFTED = "u AS (SELECT id AS row_number, CASE WHEN id % 5 = 0 THEN 'CUSTOMER#' || (id + 1) ELSE 'row ' || id END AS name, lat + CASE WHEN id % 3 = 0 THEN 0.002 ELSE 1.001 END AS lat, lon FROM c WHERE id % 2 = 0)"


@query(f"""
WITH {_sql('customer', 'c_custkey', 'c')}, {_SHIFTED}, o AS (SELECT id AS existing_id, 'Customer#' || id AS name, lat AS r_lat, lon AS r_lon FROM c),
m AS (SELECT row_number, min(existing_id) AS duplicate_of FROM u JOIN o ON lower(u.name) = lower(o.name) OR (abs(lat - r_lat) < 0.01 AND {_DISTANCE} <= 350) GROUP BY 1)
SELECT row_number, duplicate_of FROM u LEFT JOIN m USING (row_number)
""")
def upload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded rows beside the first existing place of the same name or within 350 m."""
    c = points(spark, sf_dir, "customer", "c_custkey")
    renamed = F.when(F.col("id") % 5 == 0, F.concat(F.lit("CUSTOMER#"), (F.col("id") + 1).cast("string"))).otherwise(F.concat(F.lit("row "), F.col("id").cast("string")))
    rows = c.where("id % 2 = 0").select(F.col("id").alias("row_number"), renamed.alias("name"), (F.col("lat") + F.when(F.col("id") % 3 == 0, 0.002).otherwise(1.001)).alias("lat"), "lon")
    old = c.select("id", F.concat(F.lit("Customer#"), F.col("id").cast("string")).alias("name"), "lat", "lon")
    return serving.upload_duplicates(rows, old).select("row_number", "duplicate_of")


@query(f"""
WITH {_sql('customer', 'c_custkey', 'c')}, n AS (SELECT id, lat, lon, n_name FROM c JOIN customer ON c_custkey = id JOIN nation ON n_nationkey = c_nationkey)
SELECT n_name, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM n WHERE n_name ILIKE '%1%' GROUP BY 1 ORDER BY CASE WHEN n_name ILIKE '1%' THEN 0 ELSE 1 END, count(*) DESC, n_name LIMIT 8
""")
def centroid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a name that no gazetteer has lies: the mean of the places that carry it."""
    named = points(spark, sf_dir, "customer", "c_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey")), "id")
    named = named.join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), "n_nationkey")
    return keys.centroids(named, "n_name", "1").select("n_name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query("""
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'C' || p_size % 9 END AS code, CAST(p_size AS DOUBLE) / 7 AS lat, CAST(p_partkey % 13 AS DOUBLE) / 3 AS lon FROM part)
SELECT coalesce(code, CAST(CAST(floor(lat + 0.5) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lon + 0.5) AS BIGINT) AS VARCHAR)) || '/' || p_brand AS place, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS members, min(p_partkey) AS first FROM p GROUP BY 1
""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as one place each by code, or by grid cell where they have none, and name: their mean and number."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("C"), (F.col("p_size") % 9).cast("string"))).alias("code"), (F.col("p_size") / 7).alias("lat"), (F.col("p_partkey") % 13 / 3).alias("lon"))
    return spatial.consolidate(p, "p_partkey", "code", "p_brand").select("place", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "members", "first")


@query("""
WITH c AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, greatest(a, b, d) AS overlapping, CASE WHEN a IS NULL AND d IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(d, 0) END AS apart FROM c
""")
def overlapping_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that overlap give their largest, measures that don't their sum."""
    at = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("d"))
    return c.select("l_orderkey", numeric.largest(F.col("a"), F.col("b"), F.col("d")).alias("overlapping"), numeric.sum_of_known(F.col("a"), F.col("d")).alias("apart"))


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR c_acctbal > 8000 OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS indexable FROM customer
""")
def indexable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with any evidence: facts of one kind or another, or a property of their own."""
    c = keys.with_flag(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "ordered")
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return keys.with_flag(c, bought, "c_custkey", "bought").select("c_custkey", (F.col("ordered") | F.col("bought") | (F.col("c_acctbal") > 8000)).alias("indexable"))


@query(f"{_BOTH}, n AS (SELECT d.*, c_nationkey, s_nationkey FROM d JOIN customer ON c_custkey = id JOIN supplier ON s_suppkey = r_id) SELECT id, r_id, round(m, 2) AS distance_m FROM n WHERE c_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, r_id) = 1")
def nearest_in_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supplier of each customer in its own nation."""
    c = points(spark, sf_dir, "customer", "c_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("country")), "id")
    s = points(spark, sf_dir, "supplier", "s_suppkey", "r_").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r_id"), F.col("s_nationkey").alias("country")), "r_id")
    found = spatial.nearest(c, s, "id", "r_id", 300_000, same=("country",))
    return found.select("id", "r_id", F.round("distance_m", 2).alias("distance_m"))


@query(f"""{_BOTH} SELECT id, r_id, round((CAST(r_id % 11 AS DOUBLE) / 10) * greatest(0.5, 1 - m / 1000000), 6) AS completeness FROM d WHERE m <= 500000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, r_id) = 1""")
def cached_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cached weather within 500 km, less complete the farther it is."""
    cached = points(spark, sf_dir, "supplier", "s_suppkey", "r_").withColumn("completeness", F.col("r_id") % 11 / 10)
    found = serving.weather_fallback(points(spark, sf_dir, "customer", "c_custkey"), cached)
    return found.select("id", "r_id", F.round("completeness", 6).alias("completeness"))


_CHECKS = {
    "name must have 2 to 20 characters": "length(name) BETWEEN 2 AND 20", "slug may have lower-case letters, digits and hyphens": "regexp_like(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')", "kind must be known": "kind IN ('tent', 'rv')",
    "latitude must lie within -90 and 90": "lat BETWEEN -90 AND 90", "website must be a URL": "website IS NULL OR regexp_like(website, '^https?://[^ ]+$')", "visited must not be before 2000": "visited >= DATE '2000-01-01'",
    "visited must not be after today": "visited <= DATE '2024-06-01'",
}
_ROWS = {
    "name": "CASE WHEN p_size % 7 = 0 THEN 'x' ELSE p_name END", "slug": "CASE WHEN p_size % 5 = 0 THEN 'Bad Slug' ELSE 'part-' || p_partkey END", "kind": "CASE p_size % 4 WHEN 0 THEN 'tent' WHEN 1 THEN 'rv' WHEN 2 THEN NULL ELSE 'other' END",
    "lat": "CAST(p_partkey % 200 - 100 AS DOUBLE)", "website": "CASE p_size % 3 WHEN 0 THEN 'ftp://x' WHEN 1 THEN 'https://x.example' END", "visited": "DATE '1999-12-01' + CAST(p_partkey % 900 * 11 AS INT)",
}


@query(f"""
WITH r AS (SELECT p_partkey, {", ".join(f"{e} AS {c}" for c, e in _ROWS.items())} FROM part),
p AS (SELECT p_partkey, list_filter([{", ".join(f"CASE WHEN NOT coalesce({test.replace('regexp_like', 'regexp_matches')}, false) THEN '{message}' END" for message, test in _CHECKS.items())}], lambda m: m IS NOT NULL) AS m FROM r)
SELECT p_partkey, len(m) > 0 AS rejected, array_to_string(m, '; ') AS reason FROM p
""")
def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with everything that is wrong with them; a rejected one is a row too."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(e).alias(c) for c, e in _ROWS.items()))
    wrong = rules.problems(*((F.expr(test), message) for message, test in _CHECKS.items()))
    return rows.select("p_partkey", wrong.alias("m")).select("p_partkey", (F.size("m") > 0).alias("rejected"), F.array_join("m", "; ").alias("reason"))


@query("""
WITH a AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size END AS was, CASE WHEN p_size % 3 > 0 THEN p_size - p_size % 2 END AS now FROM part)
SELECT p_partkey, was IS DISTINCT FROM now AS differs FROM a
""")
def changed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that differ, where null is a value too."""
    n = F.col("p_size")
    a = table(spark, sf_dir, "part").select("p_partkey", F.when(n % 5 > 0, n).alias("was"), F.when(n % 3 > 0, n - n % 2).alias("now"))
    return a.select("p_partkey", (~F.col("was").eqNullSafe(F.col("now"))).alias("differs"))


_GRAMS = "list_distinct(flatten(list_transform(string_split(lower({n}), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""
WITH {_sql('customer', 'c_custkey', 'c')}, a AS (SELECT id, lat, lon, 'pine lake ' || id % 7 AS name FROM c), b AS (SELECT id AS r_id, lat + 0.001 AS r_lat, lon AS r_lon, CASE WHEN id % 3 = 0 THEN 'pine lake ' || id % 5 ELSE 'cedar grove' END AS r_name FROM c WHERE id % 2 = 0),
d AS (SELECT a.id, {_GRAMS.format(n='name')} AS s, {_GRAMS.format(n='r_name')} AS t FROM a JOIN b ON abs(lat - r_lat) < 0.01 AND {_DISTANCE} <= 500)
SELECT id, id IN (SELECT id FROM d WHERE len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t)))::DOUBLE >= 0.75) AS taken FROM a
""")
def near_and_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a place within 500 m has nearly the same name."""
    c = points(spark, sf_dir, "customer", "c_custkey")
    a = c.withColumn("name", F.concat(F.lit("pine lake "), (F.col("id") % 7).cast("string")))
    other = F.when(F.col("id") % 3 == 0, F.concat(F.lit("pine lake "), (F.col("id") % 5).cast("string"))).otherwise("cedar grove")
    b = c.where("id % 2 = 0").select(F.col("id").alias("r_id"), (F.col("lat") + 0.001).alias("r_lat"), F.col("lon").alias("r_lon"), other.alias("r_name"))
    alike = text.set_similarity(text.trigrams(F.col("name")), text.trigrams(F.col("r_name"))) >= 0.75
    return keys.with_flag(a, spatial.radius_join(a, b, 500).where(alike).select("id"), "id", "taken").select("id", "taken")


@query(f"""
WITH {_sql('customer', 'c_custkey', 'c')}, e AS (SELECT c_nationkey, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM c JOIN customer ON c_custkey = id GROUP BY 1)
SELECT c_nationkey, west - 0.5 AS west, south - 0.5 AS south, east + 0.5 AS east, north + 0.5 AS north, round((west + east) / 2, 6) AS x, round((south + north) / 2, 6) AS y FROM e
""")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each nation's places, half a degree wider, and its middle."""
    c = points(spark, sf_dir, "customer", "c_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
    boxes = spatial.envelopes(c, ["c_nationkey"], 0.5)
    return boxes.select("c_nationkey", "west", "south", "east", "north", F.round((F.col("west") + F.col("east")) / 2, 6).alias("x"), F.round((F.col("south") + F.col("north")) / 2, 6).alias("y"))


@query("""
SELECT c_custkey, 'a' || c_custkey || '@example.org' || CASE WHEN c_custkey % 2 = 0 THEN ' b.c@mail.example.net' ELSE '' END AS emails, CASE WHEN c_custkey % 3 = 0 THEN 'https://x.example/' || c_custkey ELSE '' END AS urls FROM customer
""")
def payload_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and links anywhere in nested payloads."""
    k = F.col("c_custkey").cast("string")
    deep = F.array(F.struct(F.concat(F.lit("write to B.C@Mail.example.net, "), k).alias("note")))
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("A"), k, F.lit("@Example.org")).alias("mail")).alias("owner"), F.when(F.col("c_custkey") % 2 == 0, deep).alias("notes"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("see https://x.example/"), k, F.lit(")."))).alias("link")))
    found = table(spark, sf_dir, "customer").select("c_custkey", payload.alias("p"))
    return found.select("c_custkey", F.array_join(text.emails(F.col("p")), " ").alias("emails"), F.array_join(text.urls(F.col("p")), " ").alias("urls"))
