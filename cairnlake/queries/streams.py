"""Arrival-time policies over events, as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.feeds import table
from ..streaming import admission, policies
from .registry import query


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_type, event_id, ts, k, ts AS last, true AS ok FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.event_type, e.event_id, e.ts, e.k, CASE WHEN e.ts - r.last > INTERVAL 24 HOUR THEN e.ts ELSE r.last END, e.ts - r.last > INTERVAL 24 HOUR FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
SELECT user_id, event_type, event_id FROM r WHERE ok
""")
def dedup_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events more than 24 hours after the last accepted one of their user and type."""
    return policies.accepted_batch(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS before FROM events
""")
def rate_limit_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.rate_counts(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "before")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.daily_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")


_REPORTS = """r AS (SELECT event_id, ts, event_type AS place, CASE WHEN user_id % 2 = 0 THEN user_id END AS account,
 CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS token, user_id % 60 AS ip, CAST(json_extract(props, '$.k') AS BIGINT) AS email FROM events)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports on a place by an account or a token, if there is one, and an address."""
    k = F.get_json_object("props", "$.k").cast("long")
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("place"), F.when(user % 2 == 0, user).alias("account"), F.when(k % 3 == 0, k).alias("token"),
        (user % 60).alias("ip"), k.alias("email"),
    )


@query(f"""
WITH RECURSIVE {_REPORTS}, e AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY ts, event_id) AS k FROM r),
w AS (SELECT place, 1 AS k, event_id, true AS ok, [{{'ts': ts, 'account': account, 'token': token, 'ip': ip}}] AS seen FROM e WHERE k = 1 UNION ALL
 SELECT place, k, event_id, ok, CASE WHEN ok THEN list_append(seen, now) ELSE seen END FROM (
  SELECT e.place, e.k, e.event_id, {{'ts': e.ts, 'account': e.account, 'token': e.token, 'ip': e.ip}} AS now,
   len(list_filter(w.seen, lambda x: x.ts >= e.ts - INTERVAL 24 HOUR AND (x.account = e.account OR x.token = e.token OR x.ip = e.ip))) = 0 AS ok, list_filter(w.seen, lambda x: x.ts >= e.ts - INTERVAL 24 HOUR) AS seen
  FROM w JOIN e ON e.place = w.place AND e.k = w.k + 1))
SELECT event_id, place FROM w WHERE ok
""")
def dedup_any_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without those that share account, token or address with an accepted one of the same place in the 24 hours before."""
    limits = admission.any_identity("place", ["account", "token", "ip"])
    return admission.admitted(reports(spark, sf_dir), limits, "ts", "event_id").select("event_id", "place")


@query(f"""
WITH RECURSIVE {_REPORTS}, e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM r),
w AS (SELECT 1 AS k, event_id, true AS ok, [{{'ts': ts, 'ip': ip, 'email': email}}] AS seen FROM e WHERE k = 1 UNION ALL
 SELECT k, event_id, ok, CASE WHEN ok THEN list_append(seen, now) ELSE seen END FROM (
  SELECT e.k, e.event_id, {{'ts': e.ts, 'ip': e.ip, 'email': e.email}} AS now, list_filter(w.seen, lambda x: x.ts >= e.ts - INTERVAL 24 HOUR) AS seen,
   len(list_filter(w.seen, lambda x: x.ip = e.ip AND x.ts >= e.ts - INTERVAL 1 HOUR)) < 2 AND len(list_filter(w.seen, lambda x: x.ip = e.ip AND x.ts >= e.ts - INTERVAL 24 HOUR)) < 5
   AND len(list_filter(w.seen, lambda x: x.email = e.email AND x.ts >= e.ts - INTERVAL 24 HOUR)) < 3 AS ok
  FROM w JOIN e ON e.k = w.k + 1))
SELECT event_id FROM w WHERE ok
""")
def three_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages under two an hour and five a day from an address and three a day from an e-mail."""
    limits = [admission.Limit(("ip",), admission.HOUR, 2), admission.Limit(("ip",), admission.DAY, 5), admission.Limit(("email",), admission.DAY, 3)]
    return admission.admitted(reports(spark, sf_dir), limits, "ts", "event_id").select("event_id")
