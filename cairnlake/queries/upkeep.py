"""Maintenance: versions, moderation, leases, audits, counters, ledgers, late facts and text functions' round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import keys, merge, stats
from ..plans import scheduling, serving
from ..sources.feeds import table
from ..streaming import policies
from .registry import query


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS active FROM orders")
def active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One active version for each key: the newest."""
    return merge.flip_active(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey", "active")


_ROLLUP = "count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS latest"


@query(f"SELECT o_custkey, {_ROLLUP} FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1")
def moderated_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups after every sixth fact was taken out: only its owners' are computed again."""
    rollup = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("latest"))
    facts = table(spark, sf_dir, "orders").withColumn("removed", F.lit(False))
    _, rollups = merge.moderate(facts, facts.where("o_orderkey % 6 = 0").select("o_orderkey"), "o_orderkey", "o_custkey", rollup, rollup(facts))
    return rollups


@query("""
WITH old AS (SELECT c_custkey, 'old ' || c_custkey AS theme FROM customer WHERE c_custkey % 2 = 0), fresh AS (SELECT o_custkey AS c_custkey, min(o_orderstatus) AS theme FROM orders GROUP BY 1)
SELECT c_custkey, fresh.theme FROM old FULL JOIN fresh USING (c_custkey)
""")
def refreshed_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all keys after a refresh: stale ones are blank."""
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("old "), F.col("c_custkey").cast("string")).alias("theme"))
    fresh = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("theme"))
    return merge.refresh_slots(old, fresh, "c_custkey", "theme")


_AS_OF = "2024-01-15 12:00:00"


@query("""
WITH l AS (SELECT c_custkey, TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 1 MINUTE * (c_custkey % 60 - 30) AS expires_at FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, CASE WHEN a.c_custkey IS NOT NULL THEN greatest(coalesce(expires_at, TIMESTAMP '2024-01-15 12:15:00'), TIMESTAMP '2024-01-15 12:15:00') ELSE expires_at END AS expires_at FROM l FULL JOIN a USING (c_custkey)
""")
def lease_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of a quarter of an hour for requested keys, longer ones kept."""
    shift = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("c_custkey") % 60 - 30).cast("int"))
    leases = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", (F.lit(_AS_OF).cast("timestamp") + shift).alias("expires_at"))
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.extend_leases(leases, asked, "c_custkey", _AS_OF, 15).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("""
WITH c AS (SELECT c_custkey, TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 1 MINUTE * (c_custkey % 7 - 4) AS e, CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 1 MINUTE * (c_custkey % 5 - 3) END AS l,
 CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 MINUTE * (c_custkey % 4) END AS f FROM customer)
SELECT c_custkey, CASE WHEN e > TIMESTAMP '2024-01-15 12:00:00' THEN 'fresh' WHEN l > TIMESTAMP '2024-01-15 12:00:00' THEN 'leased' WHEN f > TIMESTAMP '2024-01-15 11:58:00' THEN 'backing_off' ELSE 'due' END AS state FROM c
""")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached rows by expiry, refresh lease and last error."""
    minutes = lambda n: F.lit(_AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", minutes(k % 7 - 4).alias("expires_at"), F.when(k % 5 > 0, minutes(k % 5 - 3)).alias("lease_until"), F.when(k % 3 == 0, minutes(-(k % 4))).alias("failed_at"))
    return policies.cache_state(rows, _AS_OF).select("c_custkey", "state")


@query("""
WITH f AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) - CAST(event_id % 90 - 2 AS INT) AS observed FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE observed >= DATE '2024-01-15' - 30) AS recent FROM f WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND observed >= DATE '2000-01-01' AND observed <= CAST(ts AS DATE) GROUP BY 1
""")
def late_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by the day they were observed, as far as they had arrived; those from after their arrival aren't legal."""
    facts = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_sub(F.col("ts").cast("date"), (F.col("event_id") % 90 - 2).cast("int")).alias("observed"))
    seen = policies.by_observation(facts, "observed", "ts", _AS_OF)
    return seen.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("recent").alias("recent"))


@query("""
WITH p AS (SELECT p_partkey AS node, p_partkey - p_partkey % 4 AS survivor, 'part-' || p_partkey AS slug FROM part)
SELECT 'alias' AS kind, slug AS name, survivor, NULL::BIGINT AS merged FROM p WHERE node <> survivor UNION ALL SELECT 'audit', CAST(min(node) AS VARCHAR), survivor, count(*) FROM p WHERE node <> survivor GROUP BY survivor
""")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases and audit rows of a merge plan."""
    part = table(spark, sf_dir, "part")
    plan = part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("survivor"))
    aliases, audit = merge.merge_audit(plan, part.withColumn("slug", F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))), "p_partkey", "slug")
    one = aliases.select(F.lit("alias").alias("kind"), F.col("slug").alias("name"), "survivor", F.lit(None).cast("long").alias("merged"))
    return one.unionByName(audit.select(F.lit("audit").alias("kind"), F.col("first_merged").cast("string").alias("name"), "survivor", "merged"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey OFFSET 120")
def resumed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of an ordered input behind a checkpoint of 120 items."""
    return keys.resume(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.asc("c_name"), F.asc("c_custkey")], 120)


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT o_custkey, coalesce(o.n, 0) + coalesce(m.n, 0) AS n FROM o FULL JOIN m USING (o_custkey)
""")
def incremented_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after a batch of events."""
    o = table(spark, sf_dir, "orders")
    return merge.increment(o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("n")), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "n")


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, l_linenumber, -CAST(l_quantity AS DOUBLE) FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1
""")
def replaced_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order's rows replaced by new ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    return merge.replace_slice(rows, rows.where("l_orderkey % 5 = 0 AND l_linenumber = 1").withColumn("q", -F.col("q")), ["l_orderkey"])


@query("SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) c ON c_custkey = o_custkey")
def anonymised_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of removed owners without the reference."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return merge.anonymise(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND f.ts >= TIMESTAMP '2024-01-20 00:00:00') AND ts >= TIMESTAMP '2024-01-02 00:00:00'")
def stale_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after a deletion by another table's keys and by age."""
    e = table(spark, sf_dir, "events")
    return merge.delete_matching(e.where(F.col("ts") >= F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")), e.where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")), ["user_id", "event_type"]).select("event_id")


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'published' ELSE 'running' END AS status, o_orderdate AS updated_at FROM orders)
SELECT o_orderkey AS run_id, CASE WHEN status = 'running' AND updated_at < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 5 MINUTE THEN 'partial' WHEN o_orderkey = 7 AND status <> 'published' THEN 'failed' ELSE status END AS status,
 CASE WHEN status = 'running' AND updated_at < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 5 MINUTE THEN 'interrupted' ELSE '' END AS errors FROM r
""")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that stopped without a word become partial; a published one never changes."""
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("running").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.array().cast("array<string>").alias("errors"))
    closed = serving.close_runs(runs, "1997-01-01 00:00:00")
    late = F.col("status") == "partial"
    done = serving.finish_run(closed.where(~late), 7, "failed").unionByName(closed.where(late))
    return done.select("run_id", "status", F.array_join("errors", ",").alias("errors"))


@query("""
WITH q AS (SELECT p_partkey AS id, p_size AS quality FROM part), d AS (SELECT p_partkey AS l, p_partkey + 1 AS r FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT l, r FROM d UNION ALL SELECT r, l FROM d)
SELECT id FROM q WHERE NOT EXISTS (SELECT 1 FROM b JOIN q x ON x.id = b.r WHERE b.l = q.id AND (x.quality > q.quality OR (x.quality = q.quality AND x.id < q.id)))
""")
def held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no better duplicate beats."""
    part = table(spark, sf_dir, "part")
    pairs = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("left_id"), (F.col("p_partkey") + 1).alias("right_id"))
    return serving.hold_back(part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("quality")), pairs).select("id")


@query("""
WITH p AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' ELSE 'MX' END AS country, CASE WHEN p_size % 10 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) END AS lat, CASE WHEN p_size % 10 = 0 THEN 0 ELSE CAST(p_partkey % 200 - 100 AS DOUBLE) END AS lon,
 CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS reports, p_partkey % 5 = 0 AS locked, CASE WHEN p_partkey % 2 = 0 THEN 'Unknown' ELSE 'Town' END AS city FROM part)
SELECT id, NOT (lat = 0 AND lon = 0 AND reports = 0) AS active, CASE WHEN country IN ('US', 'CA') AND lon > 0 THEN -lon ELSE lon END AS lon, CASE WHEN NOT locked AND city = 'Unknown' AND id % 3 = 0 THEN 'Ely' ELSE city END AS city FROM p
""")
def repaired_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost signs, places at (0, 0), and unknown towns."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(n % 3 == 0, "US").when(n % 3 == 1, "CA").otherwise("MX").alias("country"), F.when(n % 10 == 0, 0.0).otherwise(n.cast("double")).alias("lat"),
        F.when(n % 10 == 0, 0.0).otherwise((k % 200 - 100).cast("double")).alias("lon"), F.when(k % 4 == 0, 1).otherwise(0).alias("reports"), F.when(k % 5 == 0, F.array(F.lit("city"))).alias("locks"),
        F.when(k % 2 == 0, "Unknown").otherwise("Town").alias("city"), F.lit(True).alias("active"),
    )
    best = p.where("id % 3 = 0").select("id", F.lit("Near Ely").alias("city"))
    return serving.repair_places(p, best).select("id", "active", "lon", "city")


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'edited' ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'town' ELSE p_brand END AS city,
 CASE WHEN p_partkey % 15 = 0 THEN 'city,kind,name' WHEN p_partkey % 3 = 0 THEN 'kind,name' WHEN p_partkey % 5 = 0 THEN 'city,kind' ELSE 'kind' END AS locks,
 CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 10 END AS name_priority FROM part
""")
def manual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that an editor gave are replaced and locked."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("city"), F.array(F.lit("kind")).alias("locks"), F.create_map(F.lit("name"), F.lit(10)).alias("priorities"))
    edits = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "edited").alias("name"), F.when(F.col("p_partkey") % 5 == 0, "town").alias("city"))
    out = serving.manual_edit(rows, edits, ["name", "city"])
    return out.select("id", "name", "city", F.array_join("locks", ",").alias("locks"), F.try_element_at("priorities", F.lit("name")).alias("name_priority"))


@query("""
WITH m AS (SELECT c_custkey, 10 + c_custkey % 60 + CAST(c_custkey % 10 AS DOUBLE) / 10 AS lat, -100 + CAST(c_custkey % 7 AS DOUBLE) / 4 AS lon, c_custkey % 9 = 0 AS exact FROM customer),
t AS (SELECT c_custkey, exact, CASE WHEN exact THEN lat ELSE floor(lat / 0.75 + 0.5) * 0.75 END AS y, CASE WHEN exact THEN lon ELSE floor(lon / 0.75 + 0.5) * 0.75 END AS x FROM m), w AS (SELECT y, x, exact, CASE WHEN exact THEN c_custkey END AS own, count(*) AS members FROM t GROUP BY ALL)
SELECT c_custkey, round(y, 6) AS y, round(x, 6) AS x, members, CAST(CASE WHEN exact THEN 0.8 ELSE 0.72 END AS DOUBLE) AS completeness FROM t JOIN w USING (y, x, exact) WHERE own IS NULL OR own = c_custkey
""")
def shared_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weather target for the members of a regional cell, and each member's completeness."""
    k = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select("c_custkey", (10 + k % 60 + k % 10 / 10).alias("lat"), (-100 + k % 7 / 4).alias("lon"))
    targets, members = scheduling.weather_targets(places, "c_custkey", k % 9 == 0)
    weather = targets.select("target", "members", F.lit(0.8).alias("completeness"))
    return scheduling.fan_out(weather, members).select("c_custkey", F.round("t_lat", 6).alias("y"), F.round("t_lon", 6).alias("x"), "members", F.round("completeness", 6).alias("completeness"))


@query("""
WITH d AS (SELECT p_partkey AS entity, CASE p_partkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'paused' END AS cadence, p_size AS priority_score, TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 1 HOUR * (p_partkey % 50 - 25) AS next_refresh FROM part)
SELECT entity FROM d WHERE cadence <> 'paused' AND next_refresh <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY CASE WHEN cadence = 'daily' THEN 0 ELSE 1 END, priority_score DESC, next_refresh, entity LIMIT 100
""")
def due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of what is due."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("entity"), F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("paused").alias("cadence"), F.col("p_size").alias("priority_score"),
        (F.lit(_AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 50 - 25).cast("int"))).alias("next_refresh"),
    )
    return scheduling.due(rows, _AS_OF, 100).select("entity")


@query("SELECT CASE WHEN o_orderstatus IS NULL THEN 'none' ELSE o_orderstatus END AS reason, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by reason."""
    return stats.reasons(table(spark, sf_dir, "orders"), "o_orderstatus", large=F.col("o_totalprice") > 200_000)


_TEXTS = "['- Pine Lake: ', '• Call (555) 123-4567 Camp', 'Ünïcode & Sons', 'Near Ely', 'NEAR  Elm <b>', 'A \"quoted\" name,', 'plain']"


@query(rf"""
WITH t AS (SELECT p_partkey, {_TEXTS}[p_partkey % 7 + 1] AS t FROM part)
SELECT p_partkey, ['Pine Lake', 'Call Camp', 'Ünïcode & Sons', 'Near Ely', 'NEAR Elm <b>', 'A "quoted" name', 'plain'][p_partkey % 7 + 1] AS shown, trim(regexp_replace(replace(strip_accents(lower(t)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS plain,
 regexp_replace(t, '(?i)^near\s+', '') AS place, '"' || replace(t, '"', '""') || '"' AS cell, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM t
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are shown, compared and written."""
    said = F.element_at(F.array(*map(F.lit, ("- Pine Lake: ", "• Call (555) 123-4567 Camp", "Ünïcode & Sons", "Near Ely", "NEAR  Elm <b>", 'A "quoted" name,', "plain"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    t = table(spark, sf_dir, "part").select("p_partkey", said.alias("t"))
    return t.select(
        "p_partkey", text.display_name(F.col("t")).alias("shown"), text.normal_name(F.col("t")).alias("plain"), text.without_near(F.col("t")).alias("place"), text.csv_cell(F.col("t")).alias("cell"), text.xml_escape(F.col("t")).alias("xml")
    )
