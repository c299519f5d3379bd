"""Keys, joins, aggregates, sets, pages and merges over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.calendar import on_day
from ..operators import keys, merge, stats
from ..sources.feeds import table
from .registry import query

AS_OF = "2001-08-01"


@query("""
WITH r AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - 30) AS recent_avg,
  count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - 30) AS recent_count, avg(o_totalprice) AS all_avg, count(*) AS all_count
  FROM orders WHERE o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY 1),
b AS (SELECT o_custkey, o_orderkey AS best_order, o_orderpriority AS best_priority FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey) AS k FROM orders) WHERE k = 1),
j AS (SELECT c_custkey, c_name, round(recent_avg, 4) AS recent_avg, coalesce(recent_count, 0) AS recent_count, round(all_avg, 4) AS all_avg,
  coalesce(all_count, 0) AS all_count, best_order, best_priority,
  CASE WHEN all_avg IS NULL THEN 'none' WHEN all_avg < 100000 THEN 'low' WHEN all_avg < 200000 THEN 'moderate' WHEN all_avg < 300000 THEN 'high' ELSE 'severe' END AS band,
  count(*) OVER () AS total
  FROM customer LEFT JOIN r ON c_custkey = r.o_custkey LEFT JOIN b ON c_custkey = b.o_custkey WHERE c_acctbal > 0)
SELECT * FROM j ORDER BY all_avg DESC NULLS LAST, c_custkey LIMIT 24
""")
def directory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory page: entities with recent and all-time averages, their best related row, a band, and the total."""
    orders = table(spark, sf_dir, "orders")
    rollup = stats.recent_and_all(orders, "o_custkey", "o_totalprice", "o_orderdate", AS_OF)
    best = orders.groupBy("o_custkey").agg(keys.best_value(F.struct("o_orderkey", "o_orderpriority"), F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")).alias("b"))
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    band = F.coalesce(numeric.band(F.col("all_avg"), ((1e5, "low"), (2e5, "moderate"), (3e5, "high")), "severe", inclusive=False), F.lit("none"))
    joined = customers.join(rollup.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(best.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    top = keys.page(joined, [F.desc_nulls_last("all_avg"), F.asc("c_custkey")], 1, 24)
    shown = top.select(
        "c_custkey", "c_name", F.round("recent_avg", 4).alias("recent_avg"), F.coalesce("recent_count", F.lit(0)).alias("recent_count"), F.round("all_avg", 4).alias("all_avg"),
        F.coalesce("all_count", F.lit(0)).alias("all_count"), F.col("b.o_orderkey").alias("best_order"), F.col("b.o_orderpriority").alias("best_priority"),
        F.when(F.col("all_avg").isNull(), "none").otherwise(band).alias("band"),
    )
    # The total is counted apart and combines before its shuffle, so a page past the end still knows it.
    return shown.crossJoin(F.broadcast(customers.agg(F.count("*").alias("total"))))


@query("""
SELECT p_partkey, p_name, CASE WHEN p_name ILIKE 'Part 1%' THEN 0 ELSE 1 END AS prefix_rank FROM part
WHERE p_size BETWEEN 5 AND 40 AND concat_ws(' ', p_name, p_type) ILIKE '%a%' AND p_brand <> 'Brand#11'
""")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that are in the plan only if their parameter is given; substring search and prefix rank."""
    part = table(spark, sf_dir, "part")
    brand, kind, search = None, "all", "a"
    out = keys.optional(
        part.where(F.col("p_size").between(5, 40) & (F.col("p_brand") != "Brand#11")),
        (brand, F.col("p_brand") == brand), (kind, F.col("p_type") == kind), (search, F.concat_ws(" ", "p_name", "p_type").ilike(f"%{search}%")),
    )
    return out.select("p_partkey", "p_name", F.when(F.col("p_name").ilike("Part 1%"), 0).otherwise(1).alias("prefix_rank"))


@query("""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""
SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(k AS BIGINT) AS k FROM
(SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS k FROM orders) WHERE k <= 100
""")
def top_n_per_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = keys.top_n_per_key(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 100, "k")
    return top.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("k").cast("long").alias("k"))


@query("""
SELECT p_brand, p_type, p_size, p_partkey FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM part) WHERE n = 1
""")
def unique_match_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.unique_match(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"]).select("p_brand", "p_type", "p_size", "p_partkey")


@query("""
SELECT c_custkey, b.o_orderkey AS best_order, b.o_totalprice AS best_price FROM customer LEFT JOIN
(SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey) = 1) b
ON o_custkey = c_custkey
""")
def lateral_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = keys.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc_nulls_last("o_orderpriority"), F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")])
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("best_order"), F.col("o_totalprice").alias("best_price"))


@query("""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
 round(coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0), 2) AS spent, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer
""")
def scalar_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("last_order"))
    return table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"), "last_order")


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_done, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has_large FROM customer
""")
def exists_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = keys.with_flag(table(spark, sf_dir, "customer").select("c_custkey"), orders.where("o_orderstatus = 'F'"), "c_custkey", "has_done")
    return keys.with_flag(out, orders.where("o_totalprice > 400000"), "c_custkey", "has_large")


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
""")
def semi_anti_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = keys.bad_without_good(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "customer").join(bad, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
WITH a AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, a.m AS best_done, b.m AS best_open, coalesce(a.m, b.m) AS best FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
""")
def full_outer_best_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda status, name: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_totalprice").alias(name))
    return best("F", "best_done").join(best("O", "best_open"), "custkey", "full").select("custkey", "best_done", "best_open", F.coalesce("best_done", "best_open").alias("best"))


@query("""
SELECT c_custkey, s_suppkey, cn.n_name AS customer_nation, sn.n_name AS supplier_nation, r_name FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN supplier ON s_suppkey = c_custkey % 10 JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey
""")
def role_playing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows by definition
    c, s = nation.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("customer_nation"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supplier_nation"))
    out = table(spark, sf_dir, "customer").join(c, F.col("c_nationkey") == F.col("ck")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey") % 10).join(s, F.col("s_nationkey") == F.col("sk"))
    return out.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "s_suppkey", "customer_nation", "supplier_nation", "r_name")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'F')
""")
def tombstone_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    stones = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(stones, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')
""")
def pending_minus_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return keys.minus_keys(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey"), done, ["o_orderkey"])


@query("""
WITH g AS (SELECT l_suppkey, l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT l_suppkey FROM g GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)
""")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.complete_in_all(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", 5)


@query("""
SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent_avg,
count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1 HAVING count(*) >= 10
""")
def filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.round(F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), 4).alias("urgent_avg"),
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"),
    )
    return out.where("n >= 10")


@query("""
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS broken,
(SELECT round(sum(l_quantity), 2) FROM lineitem) AS quantity
""")
def global_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, agg, where="true": table(spark, sf_dir, name).where(where).agg(agg)
    out = one("orders", F.count("*").alias("orders")).crossJoin(one("customer", F.count("*").alias("customers"))).crossJoin(one("events", F.count("*").alias("events")))
    return out.crossJoin(one("orders", F.count("*").alias("broken"), "o_totalprice < 0")).crossJoin(one("lineitem", F.round(F.sum("l_quantity"), 2).alias("quantity")))


@query("""
SELECT r_name, n_name, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS positive, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def coverage_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.rollup("r_name", "n_name").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_distinct("c_mktsegment").alias("segments"))


@query("""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS all_keys, array_to_string(list_slice(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, o_orderkey), 1, 5), ',') AS first_five,
arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key FROM orders GROUP BY 1
""")
def ordered_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(ordered.alias("a"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"))
    return out.select("o_custkey", F.array_join("a", ",").alias("all_keys"), F.array_join(F.slice("a", 1, 5), ",").alias("first_five"), "first_key")


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities, coalesce(array_to_string(list_sort(list(DISTINCT o_orderstatus) FILTER (WHERE o_totalprice > 300000)), ','), '') AS large_states FROM orders GROUP BY 1
""")
def distinct_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.sort_array(F.collect_set(F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("listagg(DISTINCT o_orderpriority, ', ') WITHIN GROUP (ORDER BY o_orderpriority)").alias("priorities"), F.array_join(states, ",").alias("large_states"))


@query("""
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) FILTER (WHERE json_extract(props, '$.k') IS NOT NULL) AS with_k, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_max FROM events GROUP BY 1
""")
def json_object_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as objects, gathered into one object by key and read back."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("with_k"), F.max(k).alias("k_max"))
    packed = per.select(F.to_json(F.map_from_arrays(F.array("event_type"), F.array(F.struct("k_sum", "with_k", "k_max")))).alias("j"))
    back = packed.select(F.explode(F.from_json("j", "map<string,struct<k_sum:bigint,with_k:bigint,k_max:bigint>>")).alias("event_type", "v"))
    return back.select("event_type", "v.*")


@query("""
SELECT user_id, round(avg(value) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 7), 6) AS recent_avg, count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 7) AS recent_count, round(avg(value), 6) AS all_avg,
count(*) AS all_count, max(CAST(ts AS DATE)) AS latest_day FROM events WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY 1
""")
def recent_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.recent_and_all(table(spark, sf_dir, "events"), "user_id", "value", "ts", "2024-01-31", 7)
    return out.withColumn("recent_avg", F.round("recent_avg", 6)).withColumn("all_avg", F.round("all_avg", 6))


@query("SELECT CAST(floor(value / 20) AS BIGINT) AS rating, count(*) AS n FROM events GROUP BY 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 20).cast("long").alias("rating")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS a, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS b, l_shipmode FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem))
SELECT l_shipmode AS flag, count(*) AS n, round(avg(abs(a - b)), 4) AS mean_delta, round(max(abs(a - b)), 4) AS max_delta FROM m GROUP BY 1
""")
def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' outputs joined on both key columns, and how far they are apart."""
    lines = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    on = ["l_orderkey", "l_linenumber"]
    one = lines.groupBy(*on).agg(F.max(net).alias("a"))
    two = lines.groupBy(*on).agg(F.max(net * (1 + F.col("l_tax"))).alias("b"), F.max("l_returnflag").alias("flag"), F.count("*").alias("k"))
    delta = F.abs(F.col("a") - F.col("b"))
    single = one.join(two, on).where("k = 1").groupBy("flag").agg(F.count("*").alias("n"), F.sum(delta).alias("s"), F.max(delta).alias("m"))
    # Keys that repeat have no single partner; they are compared row by row.
    many = lines.join(two.where("k > 1").select(*on), on, "left_semi").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum(F.abs(net * F.col("l_tax"))).alias("s"), F.max(F.abs(net * F.col("l_tax"))).alias("m"))
    return single.unionByName(many).groupBy("flag").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_delta"), F.round(F.max("m"), 4).alias("max_delta"))


@query("""
SELECT l_suppkey, round(sum(l_quantity) ** 2 / sum(l_quantity * l_quantity), 6) AS ess FROM lineitem GROUP BY 1
""")
def ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(stats.effective_size(F.col("l_quantity")), 6).alias("ess"))


@query("""
WITH w AS (SELECT l_suppkey, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS run, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey, min(l_extendedprice) AS weighted_median FROM w WHERE run >= total / 2 GROUP BY 1
""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("""
WITH m AS (SELECT l_suppkey, sum(l_discount * 100 * l_quantity) / sum(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(greatest(0, least(1, 1 - sqrt(sum(l_quantity * (l_discount * 100 - m) ** 2) / sum(l_quantity)) / 50)), 6) AS agreement FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1
""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_discount") * 100)
    return stats.agreement(lines, ["l_suppkey"], "v", "l_quantity").withColumn("agreement", F.round("agreement", 6))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 25 THEN 'medium' WHEN l_quantity <= 40 THEN 'large' ELSE 'bulk' END AS band FROM lineitem
""")
def band_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.band(F.col("l_quantity"), ((10, "small"), (25, "medium"), (40, "large")), "bulk").alias("band"))


@query("""
SELECT p_partkey, round(greatest(0, least(1, (0.5 * greatest(0, least(1, (p_size - 1) / 49.0::DOUBLE)) + 0.3 * greatest(0, least(1, (p_retailprice - 900) / 1100)) + 0.2 * exp(-0.5 * ((p_size - 25) / 9.0::DOUBLE) ** 2)) / 1.0)), 6) AS index FROM part
""")
def weighted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    factors = {"size": numeric.scale(c("p_size"), 1, 50), "price": numeric.scale(c("p_retailprice"), 900, 2000), "middle": numeric.gaussian(c("p_size"), 25, 9)}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numeric.weighted_index(factors, {"size": 0.5, "price": 0.3, "middle": 0.2}), 6).alias("index"))


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 4 < 2)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
 CASE WHEN n.o_orderkey IS NULL OR (o.o_orderkey IS NOT NULL AND o.o_orderstatus = 'F') THEN o.o_totalprice ELSE coalesce(n.o_totalprice, o.o_totalprice) END AS o_totalprice,
 CASE WHEN n.o_orderkey IS NULL OR (o.o_orderkey IS NOT NULL AND o.o_orderstatus = 'F') THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey
""")
def upsert_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-if-null and overwrite columns; rows of one status are reviewed and don't change."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = orders.where("o_orderkey % 2 = 0")
    new = orders.where("o_orderkey % 4 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return merge.upsert(old, new, ["o_orderkey"], {"o_totalprice": "keep_if_null", "o_orderstatus": "overwrite"}, F.col("old_o_orderstatus") == "F")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 4 <> 0)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'missing' WHEN o.p = n.p THEN 'unchanged' ELSE 'updated' END AS state FROM o FULL JOIN n ON o.k = n.k) GROUP BY 1
""")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = orders.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return merge.changes(orders.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], ["o_totalprice"]).groupBy("state").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 3 + 1 END AS missing, CASE WHEN o_orderkey % 4 = 0 THEN false ELSE o_orderkey % 3 + 1 >= 2 END AS needs_review FROM orders
""")
def missing_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("missing"))
    return merge.missing_counter(orders, orders.where("o_orderkey % 4 = 0"), "o_orderkey", "missing")


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'obsolete' WHEN o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'expired-incomplete' WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY 1
""")
def retention_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate")
    rules = [
        (F.col("o_orderpriority") == "5-LOW", "obsolete"),
        ((F.col("o_orderstatus") != "F") & (date < F.lit("1997-01-01").cast("timestamp_ntz")), "expired-incomplete"),
        ((F.col("o_orderstatus") == "F") & (date < F.lit("1996-01-01").cast("timestamp_ntz")), "expired"),
    ]
    return merge.retention(table(spark, sf_dir, "orders"), rules).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND s_name <> 'Unknown' AND (c_name = '' OR s_suppkey % 3 * 40 >= c_custkey % 100) THEN s_name ELSE c_name END AS name,
 CASE WHEN s_suppkey % 3 * 40 >= c_custkey % 100 THEN s_acctbal ELSE c_acctbal END AS balance FROM customer JOIN supplier ON s_suppkey = c_custkey % 10
""")
def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a second source by priority, unless locked."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("old_name"), F.col("c_acctbal").alias("old_balance"), F.create_map(F.lit("_"), (F.col("c_custkey") % 100).cast("int")).alias("priorities"), F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("name"))).alias("locks"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("new_name"), F.col("s_acctbal").alias("new_balance"), (F.col("s_suppkey") % 3 * 40).cast("int").alias("new_priority"))
    return merge.field_merge(c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 10), ["name", "balance"]).select("c_custkey", "name", "balance")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 24 OFFSET 48")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.page(table(spark, sf_dir, "orders"), [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 3, 24).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.after(table(spark, sf_dir, "orders"), "o_orderkey", 100, 50).select("o_orderkey", "o_custkey")


@query("""
SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL
SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
""")
def union_dependency_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    return merge.dependents({"customer": (table(spark, sf_dir, "customer"), "c_nationkey"), "supplier": (table(spark, sf_dir, "supplier"), "s_nationkey")}, doomed, "n_nationkey")


@query("SELECT o_custkey AS id FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id")).union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-05-05' AND o_orderdate < TIMESTAMP '1996-05-06'")
def one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1996-05-05").cast("date")
    return table(spark, sf_dir, "orders").where(on_day(F.col("o_orderdate"), day)).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_custkey / 6 ELSE c_custkey END::BIGINT AS kept FROM customer
""")
def remap_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("kept"))
    mapping = customers.where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("was"), F.expr("c_custkey div 6").alias("now"))
    return merge.remap(customers, "kept", mapping, "was", "now").select("c_custkey", "kept")


@query("""
SELECT o_orderkey, o_custkey, k > 1 AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, again = keys.keep_first(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    cols = lambda df, flag: df.select("o_orderkey", "o_custkey", F.lit(flag).alias("repeated"))
    return cols(first, False).unionByName(cols(again, True))


@query("""
SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best, round(100.0::DOUBLE * max(o_totalprice) / max(max(o_totalprice)) OVER (), 4) AS share FROM orders GROUP BY 1
""")
def share_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    top = table(spark, sf_dir, "orders").agg(F.max("o_totalprice").alias("top"))
    return per.crossJoin(F.broadcast(top)).select("o_custkey", "n", "best", F.round(F.lit(100.0) * F.col("best") / F.col("top"), 4).alias("share"))


@query("""
SELECT o_orderkey, o_totalprice, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey) AS best_done FROM orders
""")
def conditional_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).over(w).alias("best_done"))


@query("""
SELECT o_custkey, CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) <> 0 THEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) ELSE nullif(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 0) END::BIGINT AS first_nonzero FROM orders GROUP BY 1
""")
def fallback_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(numeric.first_nonzero(n("F"), n("O")).alias("first_nonzero"))


@query("""
SELECT p_brand, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_retailprice DESC, p_partkey) FILTER (WHERE k <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) GROUP BY 1
""")
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    best = keys.top_n_per_key(part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3, "k")
    top = best.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("k", F.col("p_partkey").cast("string").alias("name")))).alias("top"))
    return part.groupBy("p_brand").agg(F.count("*").alias("n")).join(top, "p_brand").select("p_brand", "n", F.array_join("top.name", ",").alias("top"))
