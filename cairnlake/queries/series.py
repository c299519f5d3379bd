"""Ordered series by user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.calendar import seasonality
from ..operators import series
from ..sources.feeds import table
from .registry import query

_DAILY = "daily AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 6) AS v FROM events GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))


@query(f"""
WITH {_DAILY} SELECT user_id, day, {", ".join(f"round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0), 4) AS sum_{n}" for n in (1, 3, 7, 14))} FROM daily
""")
def trailing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.trailing_sums(daily(spark, sf_dir), ["user_id"], "day", "v", series.TRAILING)
    return out.select("user_id", "day", *(F.round(n, 4).alias(n) for n in series.TRAILING))


@query(f"""
WITH {_DAILY} SELECT user_id, day, round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 4) AS lag_0_2,
 {", ".join(f"round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {b} PRECEDING AND {a} PRECEDING), 0), 4) AS lag_{a}_{b}" for a, b in ((3, 7), (8, 14), (15, 29)))},
 round(avg(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS mean_7,
 round((count(*) FILTER (WHERE v >= 100) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) / 30.0::DOUBLE, 6) AS often FROM daily
""")
def lag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("day")
    out = series.trailing_sums(daily(spark, sf_dir), ["user_id"], "day", "v", series.LAG_BUCKETS)
    often = F.count(F.when(F.col("v") >= 100, 1)).over(w.rowsBetween(-29, 0)) / F.lit(30.0)
    return out.select("user_id", "day", *(F.round(n, 4).alias(n) for n in series.LAG_BUCKETS), F.round(F.avg("v").over(w.rowsBetween(-6, 0)), 4).alias("mean_7"), F.round(often, 6).alias("often"))


@query(f"""
WITH {_DAILY} SELECT user_id, day, round(v - lag(v) OVER (PARTITION BY user_id ORDER BY day), 4) AS change, round(v - lag(v, 7) OVER (PARTITION BY user_id ORDER BY day), 4) AS change_7 FROM daily
""")
def lag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.lag_difference(daily(spark, sf_dir), ["user_id"], "day", "v", "change")
    out = series.lag_difference(out, ["user_id"], "day", "v", "change_7", 7)
    return out.select("user_id", "day", F.round("change", 4).alias("change"), F.round("change_7", 4).alias("change_7"))


@query("""
WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2),
f AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN count(*) > 1 THEN NULL ELSE round(sum(value), 4) END AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT coalesce(h.user_id, f.user_id) AS user_id, coalesce(h.day, f.day) AS day, CASE WHEN f.user_id IS NOT NULL THEN f.v ELSE h.v END AS v FROM h FULL JOIN f ON h.user_id = f.user_id AND h.day = f.day
""")
def merge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second series wins wherever it has a row, also with a null."""
    def part(kind: str) -> DataFrame:
        return table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"), F.count("*").alias("n"))

    forecast = part("view").withColumn("v", F.when(F.col("n") <= 1, F.col("v")))
    return series.merge_series(part("click").select("user_id", "day", "v"), forecast.select("user_id", "day", "v"), ["user_id", "day"], "v")


@query(f"""
WITH {_DAILY}, l AS (SELECT user_id, list(v ORDER BY day) AS vs FROM daily GROUP BY 1)
SELECT user_id, round(list_reduce(vs, lambda a, v: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + v * 0.002 - 0.1)), 0.2::DOUBLE), 6) AS level FROM l
""")
def recurrence_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level that each day fills and drains within bounds."""
    walked = arrays.clamped_walk(F.col("history"), F.lit(0.2), lambda a, x: a + x["v"] * 0.002 - 0.1, 0.0, 1.0)
    return series.gathered(daily(spark, sf_dir), ["user_id"], ["day"], ["v"]).select("user_id", F.round(walked, 6).alias("level"))


@query("""
WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2, 3)
SELECT user_id, day, round(coalesce(avg(v) FILTER (WHERE hour BETWEEN 17 AND 23), avg(v)), 6) AS evening, round(max(v), 6) AS peak FROM h GROUP BY 1, 2
""")
def hourly_band_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the evening hours by the clock, or of all hours if there are none, and the peak."""
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"))
    evening = F.avg(F.when(F.col("hour").between(17, 23), F.col("v")))
    return hours.groupBy("user_id", "day").agg(F.round(F.coalesce(evening, F.avg("v")), 6).alias("evening"), F.round(F.max("v"), 6).alias("peak"))


@query("""
WITH t AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS target FROM orders GROUP BY 1),
m AS (SELECT t.o_custkey, o_orderkey, o_totalprice, least(abs(dayofyear(target) - dayofyear(o_orderdate)), 366 - abs(dayofyear(target) - dayofyear(o_orderdate))) AS d, year(target) - year(o_orderdate) AS years
 FROM t JOIN orders o ON o.o_custkey = t.o_custkey WHERE year(o_orderdate) < year(target))
SELECT o_custkey, count(*) AS n, count(DISTINCT years) AS n_years, round(sum(o_totalprice * 0.85 ** years * (1 - d / 22.0::DOUBLE)) / sum(0.85 ** years * (1 - d / 22.0::DOUBLE)), 4) AS seasonal FROM m WHERE d <= 21 GROUP BY 1
""")
def seasonal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same season of earlier years, weighted by age and nearness."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    target = orders.groupBy("o_custkey").agg(F.max("day").alias("target"))
    found = series.season_matches(target, orders, "o_custkey", "target", "day", 21)
    years = F.year("target") - F.year("day")
    weight = F.pow(F.lit(0.85), years) * (1 - F.col("distance") / F.lit(22.0))
    return found.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct(years).alias("n_years"), F.round(F.sum(F.col("o_totalprice") * weight) / F.sum(weight), 4).alias("seasonal"))


@query("""
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_custkey, round(avg(0.5 + 0.5 * cos(2 * pi() * (dayofyear(day) - CASE WHEN o_custkey % 2 = 0 THEN 200 ELSE 18 END) / 365.25::DOUBLE)), 6) AS season FROM d GROUP BY 1
""")
def season_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    latitude = F.when(F.col("o_custkey") % 2 == 0, 45).otherwise(-45)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg(seasonality(F.col("o_orderdate").cast("date"), latitude)), 6).alias("season"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE value > 20) AS a, count(*) AS e FROM events GROUP BY 1, 2)
SELECT user_id, day, round(CAST(sum(a) OVER w AS DOUBLE) / CAST(sum(e) OVER w AS DOUBLE), 6) AS completeness FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)
""")
def running_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count_if(F.col("value") > 20).alias("a"), F.count("*").alias("e"))
    return series.running_share(per, ["user_id"], "day", F.col("a"), F.col("e")).select("user_id", "day", F.round("completeness", 6).alias("completeness"))


@query(f"""
WITH {_DAILY} SELECT user_id, day, v FROM daily
""")
def columnar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to parallel arrays, as providers send them, and back."""
    gathered = series.gathered(daily(spark, sf_dir), ["user_id"], ["day"], ["v"])
    columnar = gathered.select("user_id", F.col("history.day").alias("days"), F.col("history.v").alias("v"))
    return series.columnar_to_rows(columnar, ["user_id"], "days", ["v"]).select("user_id", F.col("time").alias("day"), "v")
