"""Feeds that are landed and read again, tables that are written by upserts, and runs over what has come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, jsonx, text, variants
from ..operators import keys
from ..operators.jobs import scratch
from ..sources import feeds, paged, sinks, versioned
from ..sources.feeds import table
from ..streaming import policies, runs
from .registry import query


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_size < 40 AND p_brand = 'Brand#13'")
def paged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts landed as a feed of pages and read from it with predicates that the source applies."""
    folder = scratch(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), "p_brand")
    paged.land(part, folder, [F.asc("p_partkey")], 100)
    found = paged.pages(spark, folder, "p_partkey long, p_name string, p_size int, p_brand string", 100)
    return found.where("p_size >= 10 AND p_size < 40 AND p_brand = 'Brand#13'").select("p_partkey", "p_name", "p_size")


@query("""
SELECT (s_suppkey - 1) // 40 AS page, count(*) AS n, (SELECT count(*) FROM supplier) AS stated, true AS fits FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS s_suppkey FROM supplier) GROUP BY 1
""")
def paged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers landed as pages, with what each holds against what it states."""
    folder = scratch(spark)
    paged.land(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), folder, [F.asc("s_suppkey")], 40)
    return paged.page_counts(spark, folder, 40)


@query("""
SELECT c_custkey AS id, c_name AS name, CAST(n AS BIGINT) AS n, NULL::BIGINT AS n_before FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def upserted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to a versioned table and then their numbers of orders; both versions read side by side."""
    made = versioned.VersionedTable(spark, scratch(spark), "id long, name string, n long", ["id"], 16)
    policies = {"name": "keep_if_null", "n": "overwrite"}
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("n"))
    before = made.upsert(customers, policies)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.lit(None).cast("string").alias("name"), F.count("*").alias("n"))
    after = made.upsert(orders.select("id", "name", "n"), policies)
    return made.read(after).join(made.read(before).select("id", F.col("n").alias("n_before")), "id")


@query("""
SELECT p_partkey AS id, p_name AS name, (SELECT count(*) FROM part) AS inserted, 0::BIGINT AS updated FROM part
""")
def imported_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts imported in steps by name, each committed with its position and counters."""
    made = versioned.VersionedTable(spark, scratch(spark), "id long, name string", ["id"], 8)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    numbered = keys.numbered(part, [F.asc("name"), F.asc("id")])
    step = max(1, -(-part.count() // 3))
    counters = versioned.import_rows(numbered, made, {"name": "overwrite"}, "parts", step)
    return made.read().select("id", "name", F.lit(counters["inserted"]).cast("long").alias("inserted"), F.lit(counters["updated"]).cast("long").alias("updated"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def triggered_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, by a run that works off what a stream's source has and publishes each batch once."""
    home = scratch(spark)
    path = f"{sf_dir}/events.parquet"
    made = versioned.VersionedTable(spark, f"{home}/table", "user_id long, event_id long, ts timestamp, event_type string", ["user_id"], 16)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
        known = rows.unionByName(made.read())
        latest = keys.latest_per_key(known, ["user_id"], [F.desc("ts"), F.desc("event_id")])
        made.upsert(latest, {c: "overwrite" for c in ("event_id", "ts", "event_type")}, name="latest", number=batch_id)

    runs.run_due(stream, publish, f"{home}/checkpoint", runs.Lease(spark, f"{home}/lease"), "run")
    return made.read().select("user_id", "ts", "event_type")


@query("""
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 7 NOT IN (1, 2, 3, 4) THEN k END AS k, CASE WHEN event_id % 7 <> 1 THEN CAST(k AS DOUBLE) / 4 END AS x, CASE event_id % 7 WHEN 1 THEN NULL WHEN 2 THEN 'missing' WHEN 3 THEN 'null' WHEN 4 THEN 'string' ELSE 'number' END AS kind,
 CASE WHEN event_id % 7 = 4 THEN 'k' WHEN event_id % 7 = 1 THEN NULL ELSE '' END AS wrong FROM e
""")
def typed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of payloads as variants: right, missing, null, of a wrong type, and of what isn't JSON."""
    k, which = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    deep = F.concat(F.lit('"deep": {"x": '), (k.cast("double") / 4).cast("string"), F.lit("}}"))
    member = F.when(which == 2, "").when(which == 3, '"k": null, ').when(which == 4, F.concat(F.lit('"k": "'), k, F.lit('", '))).otherwise(F.concat(F.lit('"k": '), k, F.lit(", ")))
    payload = F.when(which == 1, '{"k": ').otherwise(F.concat(F.lit("{"), member, deep))
    v = variants.parsed(F.col("payload"))
    columns, wrong = variants.members(F.col("v"), {"k": ("$.k", "long"), "x": ("$.deep.x", "double")})
    rows = table(spark, sf_dir, "events").select("event_id", payload.alias("payload")).select("event_id", v.alias("v"))
    return rows.select("event_id", *(c.alias(name) for name, c in columns.items()), variants.kind(F.col("v"), "$.k").alias("kind"), F.when(F.col("v").isNotNull(), F.array_join(wrong, ",")).alias("wrong"))


@query("""
WITH m AS (SELECT s_suppkey AS s, m, s_suppkey % 11 = 3 AND m = 2 AS lacks FROM supplier, (SELECT unnest(range(0, 7)) AS m) WHERE s_suppkey % 13 <> 5)
SELECT CAST(s AS VARCHAR) AS entity, '2026-' || lpad(CAST(m + 1 AS VARCHAR), 2, '0') AS target_month, CASE WHEN NOT lacks THEN CAST(m AS INT) END AS month_offset, CASE WHEN NOT lacks THEN CAST(s % 30 + m AS DOUBLE) END AS temperature,
 CASE WHEN NOT lacks THEN CAST(s % 7 AS DOUBLE) * 2 END AS precipitation, CASE WHEN lacks THEN 'missing precipitation_mean' END AS reason FROM m
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, NULL, 'no months' FROM supplier WHERE s_suppkey % 13 = 5
""")
def seasonal_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal responses landed for suppliers and read again; months with a value missing and entities without months are rejected."""
    folder = scratch(spark)
    s = F.col("s_suppkey")
    months = F.sequence(F.lit(0), F.lit(6))
    value = lambda f: F.transform(months, f)
    monthly = F.struct(
        F.when(s % 13 != 5, value(lambda m: F.format_string("2026-%02d", m + 1))).alias("time"), value(lambda m: (s % 30 + m).cast("double")).alias("temperature_2m_mean"), value(lambda m: F.lit(0.5)).alias("temperature_2m_anomaly"),
        value(lambda m: F.when((s % 11 != 3) | (m != 2), (s % 7) * 2.0)).alias("precipitation_mean"), value(lambda m: F.lit(-1.0)).alias("precipitation_anomaly"),
    )
    sinks.json_export(table(spark, sf_dir, "supplier").select(s.cast("string").alias("entity"), F.lit(10.0).alias("elevation"), monthly.alias("monthly")), folder)
    good, rejected = feeds.seasonal_payloads(spark, folder)
    return good.select("entity", "target_month", "month_offset", "temperature", "precipitation", F.lit(None).cast("string").alias("reason")).unionByName(rejected, allowMissingColumns=True)


_DAYS = ", ".join(f"({i}, {d}, {str(m in feeds.WARM).lower()})" for i, (m, d) in enumerate(feeds.MONTH_DAYS.items()))


@query(f"""
WITH c AS (SELECT c_custkey, round_even((14 + CAST(c_custkey * 7919 % 7000 AS DOUBLE) / 100) / 0.5, 0) AS gy, round_even((-180 + CAST(c_custkey * 104729 % 12800 AS DOUBLE) / 100) / 0.625, 0) AS gx FROM customer),
s AS (SELECT DISTINCT gy, gx, CAST(abs(CAST(gy * 3 + gx AS BIGINT)) % 9 AS DOUBLE) AS v FROM c WHERE CAST(abs(gy + gx) AS BIGINT) % 10 <> 0),
t AS (SELECT gy, gx, sum((v + i) * d) AS annual, sum((v + i) * d) FILTER (WHERE warm) AS warm FROM s, (VALUES {_DAYS}) AS m(i, d, warm) GROUP BY 1, 2)
SELECT c_custkey, c.gy * 0.5::DOUBLE AS grid_lat, c.gx * 0.625::DOUBLE AS grid_lon, round(annual, 6) AS annual_mm, round(warm, 6) AS warm_mm FROM c LEFT JOIN t ON t.gy = c.gy AND t.gx = c.gx
""")
def climate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain of a year and of the warm months at the grid point of each customer."""
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(k, (14 + (k * 7919 % 7000).cast("double") / 100).alias("lat"), (-180 + (k * 104729 % 12800).cast("double") / 100).alias("lon"))
    gy, gx = feeds.grid_point(F.col("lat"), F.col("lon"))
    cells = at.select(gy.alias("gy"), gx.alias("gx")).distinct().where(F.abs(F.col("gy") + F.col("gx")) % 10 != 0)
    v = (F.abs(F.col("gy") * 3 + F.col("gx")) % 9).cast("double")
    daily = F.create_map(*(c for i, m in enumerate(feeds.MONTH_DAYS) for c in (F.lit(m), v + i)))
    points = cells.select((F.col("gy") * feeds.GRID[0]).alias("lat"), (F.col("gx") * feeds.GRID[1]).alias("lon"), daily.alias("daily"))
    return feeds.climate_normals(at, points, "c_custkey").select("c_custkey", "grid_lat", "grid_lon", F.round("annual_mm", 6).alias("annual_mm"), F.round("warm_mm", 6).alias("warm_mm"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) / 4 AS lon, false AS rejected FROM supplier")
def features_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as GeoJSON features and read as a text sequence."""
    folder = scratch(spark)
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(s.cast("string").alias("id"), F.col("s_name").alias("name"), (s % 90).cast("double").alias("lat"), ((s % 180).cast("double") / 4).alias("lon"))
    sinks.geojson(rows, folder, "lon", "lat", "id", "name")
    at = F.from_json("geometry.coordinates", "array<double>")
    return feeds.geojson_lines(spark, folder).select(F.col("properties")["id"].alias("id"), F.col("properties")["name"].alias("name"), at[1].alias("lat"), at[0].alias("lon"), "rejected")


_UPLOAD = "SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE c_name || ', \"the\" ' || c_custkey END AS name, 'place-' || c_custkey AS slug, CAST(c_custkey % 200 - 100 AS DOUBLE) AS lat, CAST(c_custkey % 300 - 140 AS DOUBLE) AS lon FROM customer"


@query(f"""
SELECT slug, name, lat, lon FROM ({_UPLOAD.replace(chr(92), '')}) WHERE length(name) >= 2 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)
""")
def uploaded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as quoted CSV with other names for columns, and the valid rows of the upload."""
    folder = scratch(spark)
    k = F.col("c_custkey")
    name = F.when(k % 17 == 0, "x").otherwise(F.concat("c_name", F.lit(', "the" '), k.cast("string")))
    rows = table(spark, sf_dir, "customer").select(
        name.alias("name"), F.concat(F.lit("place-"), k.cast("string")).alias("slug"), F.lit(None).cast("string").alias("address"), F.lit("Hope").alias("city"), F.lit("BC").alias("province"), F.lit("CA").alias("country"),
        F.lit("V0X").alias("postal_code"), (k % 200 - 100).cast("double").alias("latitude"), (k % 300 - 140).cast("double").alias("longitude"),
    )
    sinks.quoted_csv(rows, folder)
    valid, _ = feeds.csv_upload(spark, folder)
    return valid.select("slug", "name", "lat", "lon")


@query("""
SELECT 'p' || p_partkey AS id, p_name AS name, 'campground' AS primary_category, CAST(p_size AS DOUBLE) / 50 AS confidence, 'http://x.test/' || p_partkey AS website, CASE WHEN p_partkey % 4 = 1 THEN 'US' ELSE 'CA' END AS country, CAST(p_size AS DOUBLE) AS lat
FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 2
UNION ALL SELECT 'p' || p_partkey, p_name, 'park', CAST(p_size AS DOUBLE) / 50, 'http://x.test/' || p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'US' ELSE 'CA' END, CAST(p_size AS DOUBLE) FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 6 = 0 AND p_partkey % 4 <> 2
""")
def released_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a release of places with nested columns: those of a category, or with it as an alternative, in some countries."""
    folder = scratch(spark)
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    address = lambda country: F.struct(F.lit(country).alias("country"), F.lit("BC").alias("region"), F.lit("Hope").alias("locality"), F.lit("1 Road").alias("freeform"))
    foreign = F.array(address("FR"))
    home = F.when(k % 4 == 1, F.concat(foreign, F.array(address("US")))).when(k % 4 == 2, foreign).otherwise(F.array(address("CA")))
    alternate = F.when(k % 6 == 0, F.array(F.lit("campground"))).otherwise(F.lit(None).cast("array<string>"))
    table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.struct(F.col("p_name").alias("primary")).alias("names"),
        F.struct(F.when(k % 3 == 0, "park").otherwise("campground").alias("primary"), alternate.alias("alternate")).alias("categories"), (size / 50).alias("confidence"),
        F.array(F.concat(F.lit("http://x.test/"), k.cast("string"))).alias("websites"), home.alias("addresses"), F.struct(F.lit(1.0).alias("xmin"), size.alias("ymin")).alias("bbox"),
    ).write.parquet(folder)
    found = feeds.places_release(spark, folder, ["campground"], ["US", "CA"])
    return found.select("id", "name", "primary_category", "confidence", "website", "country", "lat")


@query("""
WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name, CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS city, 'b' AS phone FROM part)
SELECT p_partkey, CASE WHEN name = city THEN name ELSE 'b' END AS usual,
 CASE WHEN name = city AND name = 'b' THEN '' WHEN name = city THEN 'phone=b' ELSE concat_ws(';', CASE WHEN city <> 'b' THEN 'city=' || city END, CASE WHEN name <> 'b' THEN 'name=' || name END) END AS exceptions FROM p WHERE name = city OR city = 'b' OR name = 'b'
""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of fields as the usual one and the exceptions, where two of three fields agree."""
    name = F.element_at(F.array(*map(F.lit, "abc")), (F.col("p_size") % 3 + 1).cast("int"))
    city = F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b")
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), city.alias("city")).where("name = city OR city = 'b' OR name = 'b'")
    packed = rows.select("p_partkey", jsonx.compact_provenance(F.create_map(F.lit("name"), F.col("name"), F.lit("city"), F.col("city"), F.lit("phone"), F.lit("b"))).alias("m"))
    odd = F.array_sort(F.transform(F.map_entries(F.map_filter("m", lambda k, _: k != "_")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return packed.select("p_partkey", F.col("m")["_"].alias("usual"), F.array_join(odd, ";").alias("exceptions"))


@query("""
SELECT p_partkey, p_size, (SELECT count(*) FROM part) AS rows, (SELECT count(*) FROM part WHERE p_size > 25) AS large, (SELECT count(*) FROM part WHERE CASE WHEN p_size % 5 <> 0 THEN p_size < 10 END) AS small FROM part
""")
def counted_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written and counted in one pass, and read back beside the counts."""
    folder = scratch(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    counts = sinks.counted(part, folder, large=F.col("p_size") > 25, small=F.when(F.col("p_size") % 5 != 0, F.col("p_size") < 10))
    return spark.read.parquet(folder).select("p_partkey", "p_size", *(F.lit(counts[c]).cast("long").alias(c) for c in ("rows", "large", "small")))


_KEY = b"not a secret"
_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in _KEY.ljust(64, bytes(1))) for pad in (0x36, 0x5C))


@query(f"""
SELECT s_suppkey, rtrim(replace(replace(base64(unhex(sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(s_name)))))), '+', '-'), '/', '_'), '=') AS signed FROM supplier
""")
def signed_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as keyed identifiers."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.hmac_sha256(_KEY)(F.col("s_name")).alias("signed"))


@query("""
WITH f AS (SELECT p_partkey, [x.t FOR x IN list_sort(list_filter([
 {'s': -CAST(p_size AS DOUBLE), 'i': 0, 't': CASE WHEN p_size > 10 THEN 'size' END}, {'s': -CAST(p_partkey % 40 AS DOUBLE), 'i': 1, 't': CASE WHEN p_partkey % 2 = 0 THEN 'key' END}, {'s': -20.0::DOUBLE, 'i': 2, 't': CASE WHEN p_brand < 'Brand#3' THEN 'brand' END},
 {'s': -CAST(p_size % 7 AS DOUBLE), 'i': 3, 't': CASE WHEN p_size % 7 > 3 THEN 'week' END}], lambda x: x.t IS NOT NULL))][1:2] AS t FROM part)
SELECT p_partkey, CASE WHEN len(t) = 0 THEN 'nothing special' ELSE array_to_string(t, ', ') END AS factors FROM f
""")
def strongest_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two strongest explanations of each part, ties in their given order."""
    size, key = F.col("p_size"), F.col("p_partkey")
    parts = [(size > 10, size, "size"), (key % 2 == 0, key % 40, "key"), (F.col("p_brand") < "Brand#3", F.lit(20), "brand"), (size % 7 > 3, size % 7, "week")]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(arrays.strongest(parts, 2, "nothing special"), ", ").alias("factors"))


@query("SELECT 'place ' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'CA' ELSE 'US' END AS country, CAST(c_custkey * 10 AS BIGINT) AS population, CAST(c_custkey % 80 AS DOUBLE) / 4 AS latitude FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey * 10 >= 300")
def gazetteer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of a gazetteer without header: places of some countries with enough people."""
    folder = scratch(spark)
    k = F.col("c_custkey")
    country = F.when(k % 4 == 1, "MX").when(k % 3 == 0, "CA").otherwise("US")
    line = F.concat_ws("\t", F.concat(F.lit("place "), k.cast("string")), country, (k * 10).cast("string"), ((k % 80).cast("double") / 4).cast("string"), F.lit('1"'))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(folder)
    return feeds.gazetteer(spark, folder, ["name", "country", "population", "latitude", "longitude"], ["CA", "US"], 300).select("name", "country", "population", "latitude")


@query("SELECT 'https://x.test/' || p_partkey || '?a=1&b' AS url, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INTEGER)) AS DATE) AS changed, true AS whole FROM part")
def sitemap_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of parts written as a sitemap and read from it, with whether the document is opened and closed once."""
    folder = scratch(spark)
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string"), F.lit("?a=1&b")).alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("changed"))
    sinks.sitemap_document(pages, folder, "url", "changed")
    lines = spark.read.text(folder)
    edges = lines.agg((F.count_if(F.col("value").contains("<urlset")) + 10 * F.count_if(F.col("value") == "</urlset>")).alias("edges"))
    found = lines.where("value LIKE '<url>%'").select(
        F.replace(F.regexp_extract("value", "<loc>(.*)</loc>", 1), F.lit("&amp;"), F.lit("&")).alias("url"), F.regexp_extract("value", "<lastmod>(.*)</lastmod>", 1).cast("date").alias("changed")
    )
    return found.crossJoin(F.broadcast(edges)).select("url", "changed", (F.col("edges") == 11).alias("whole"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS note FROM supplier")
def bulk_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as a CSV file with other names and read as a bulk file by a schema, what it lacks null."""
    folder = f"{scratch(spark)}.csv"
    table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias(" Balance"), F.col("s_name").alias("NAME"), F.col("s_suppkey").alias("Id")).write.csv(folder, header=True)
    return feeds.bulk(spark, folder, "id long, name string, balance double, note string")


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2), h AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS mean FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT CAST(d.user_id AS VARCHAR) AS entity, d.day, round(CASE WHEN d.user_id % 3 = 0 THEN 0 ELSE total END, 6) AS rain, round(coalesce(mean, 0), 6) AS humidity FROM d LEFT JOIN h ON h.user_id = d.user_id AND h.day = d.day
""")
def archive_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a landed archive, read from its payloads, with the means of their hours; what is missing counts as 0."""
    folder = scratch(spark)
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    days = events.where("event_id % 5 <> 0").groupBy("user_id", F.date_format("at", "yyyy-MM-dd").alias("time")).agg(F.sum("value").alias("v"))
    daily = days.groupBy("user_id").agg(F.collect_list(F.struct("time", F.when(F.col("user_id") % 3 != 0, F.col("v")).alias("rain"))).alias("d"))
    hours = events.where("event_type = 'view'").groupBy("user_id").agg(F.collect_list(F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm").alias("time"), F.col("value").alias("humid"))).alias("h"))
    body = daily.join(hours, "user_id", "left").select(
        F.col("user_id").cast("string").alias("entity"), F.struct(F.col("d.time").alias("time"), F.col("d.rain").alias("rain")).alias("daily"), F.struct(F.col("h.time").alias("time"), F.col("h.humid").alias("humid")).alias("hourly")
    )
    sinks.json_export(body, folder)
    read_days, read_hours = feeds.weather_payloads(spark, folder, ["rain"], ["humid"])
    filled = feeds.archive_days(read_days, read_hours, {"rain": "rain"}, {"humid": "humidity"})
    return filled.select("entity", "day", F.round("rain", 6).alias("rain"), F.round("humidity", 6).alias("humidity"))


@query("""
WITH r AS (SELECT p_partkey, p_partkey % 500 AS slug, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS wet FROM part WHERE p_partkey BETWEEN 1 AND 450),
k AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 9 <> 0), g AS (SELECT p_partkey AS id, wet FROM r WHERE wet IS NOT NULL AND p_partkey IN (SELECT id FROM k))
SELECT id, 'v2' AS version, wet, true AS active FROM g UNION ALL SELECT p_partkey, 'v1', 1.0::DOUBLE, p_partkey NOT IN (SELECT id FROM g) FROM part WHERE p_partkey % 2 = 0
""")
def loaded_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of profiles by slug over active ones: good rows become the active version of their entity."""
    part = table(spark, sf_dir, "part")
    slug = F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    rows = part.where("p_partkey BETWEEN 1 AND 450").select(slug.alias("slug"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).otherwise(float("nan")).alias("wet"))
    known = part.where("p_partkey % 9 <> 0").select(slug.alias("slug"), F.col("p_partkey").alias("id"))
    active = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("v1").alias("version"), F.lit(1.0).alias("wet"), F.lit(True).alias("active"))
    return feeds.load_profiles(rows, known, active, ["wet"], "v2")[0]


@query("SELECT user_id, count(*) AS n, max(ts) AS newest, round(sum(value), 2) AS total FROM events GROUP BY 1")
def refreshed_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of users after four batches, the second of which came twice; each batch computes the touched buckets anew."""
    home = scratch(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rollup = lambda facts: facts.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("newest"), F.sum("value").alias("total"))
    run = policies.refresh_rollups(f"{home}/rollups", f"{home}/facts", "user_id", rollup, 8)
    for batch in (0, 1, 1, 2, 3):
        run(events.where(F.col("event_id") % 4 == batch), batch)
    return spark.read.parquet(f"{home}/rollups").select("user_id", "n", "newest", F.round("total", 2).alias("total"))
