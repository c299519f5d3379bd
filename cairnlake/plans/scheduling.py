"""Which entities are refreshed how often, and which are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import codes
from ..functions.calendar import stagger_minutes

# Thresholds and points of the cadence rules.
SITES, SAVES, VIEWS = 50, 3, 10
POINTS = {"notable-capacity": 30, "recent-report": 30, "frequently-saved": 20, "frequently-viewed": 15, "recently-requested": 25}


def decide_cadence(df: DataFrame) -> DataFrame:
    """Add cadence, priority_score and reason_codes.

    Columns: active, operating_status, has_profile, sites, recent_report, saves, views, requested, manual_override.
    """
    c = F.col
    signals = {
        "notable-capacity": F.coalesce("sites", F.lit(0)) >= SITES, "recent-report": c("recent_report"), "frequently-saved": c("saves") >= SAVES,
        "frequently-viewed": c("views") >= VIEWS, "recently-requested": c("requested"),
    }
    signals = {k: F.coalesce(v, F.lit(False)) for k, v in signals.items()}
    found = codes(*((test, code) for code, test in signals.items()))
    points = sum((F.when(test, POINTS[code]).otherwise(0) for code, test in signals.items()), F.lit(0))
    stopped = ~F.coalesce("active", F.lit(False)) | F.coalesce(c("operating_status").isin("closed", "review"), F.lit(False))
    bare = ~F.coalesce("has_profile", F.lit(False))
    manual = c("manual_override")

    def pick(a: Column, b: Column, m: Column, d: Column) -> Column:
        return F.when(stopped, a).when(bare, b).when(manual.isNotNull(), m).otherwise(d)

    some = F.size(found) > 0
    one = lambda code: F.array(F.lit(code))
    return (
        df.withColumn("cadence", pick(F.lit("paused"), F.lit("paused"), manual, F.when(some, "daily").otherwise("weekly")))
        .withColumn("priority_score", pick(F.lit(0), F.lit(0), F.when(manual == "daily", 100).otherwise(1), F.when(some, points).otherwise(1)))
        .withColumn("reason_codes", pick(one("not-operating"), one("habitat-profile-required"), one("manual-override"), F.when(some, found).otherwise(one("established-low-interest"))))
    )


def next_refresh(df: DataFrame, key: str, as_of: str) -> DataFrame:
    """Next day at the same hour for daily ones; a fixed minute of the week for weekly ones; null when paused."""
    now = F.lit(as_of).cast("timestamp")
    week = F.date_trunc("week", now)
    minute = week + F.make_dt_interval(F.lit(0), F.lit(0), stagger_minutes(F.col(key)).cast("int"))
    weekly = F.when(minute > now, minute).otherwise(minute + F.expr("INTERVAL 7 DAYS"))
    return df.withColumn("next_refresh", F.when(F.col("cadence") == "daily", now + F.expr("INTERVAL 1 DAY")).when(F.col("cadence") == "weekly", weekly))


def due(df: DataFrame, as_of: str, limit: int = 5000) -> DataFrame:
    """The due queue: daily before weekly, by priority, the oldest first."""
    rank = F.when(F.col("cadence") == "daily", 0).otherwise(1)
    ready = df.where((F.col("cadence") != "paused") & (F.col("next_refresh") <= F.lit(as_of).cast("timestamp")))
    return ready.orderBy(rank, F.desc_nulls_last("priority_score"), F.asc_nulls_last("next_refresh"), "entity").limit(max(1, min(25_000, limit)))


def weather_targets(df: DataFrame, key: str, exact: Column, step: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(targets, members): entities that need their own place, and one target per regional cell for the others."""
    snap = lambda c: F.floor(F.col(c) / step + 0.5) * step
    t_lat, t_lon = F.when(exact, F.col("lat")).otherwise(snap("lat")), F.when(exact, F.col("lon")).otherwise(snap("lon"))
    name = F.when(exact, F.concat(F.lit("e:"), F.col(key).cast("string"))).otherwise(F.concat_ws(":", F.lit("r"), t_lat.cast("string"), t_lon.cast("string")))
    members = df.select(key, name.alias("target"), t_lat.alias("t_lat"), t_lon.alias("t_lon"), (~exact).alias("regional"))
    return members.groupBy("target", "t_lat", "t_lon", "regional").agg(F.count("*").alias("members")), members


def fan_out(weather: DataFrame, members: DataFrame) -> DataFrame:
    """Give each member its target's weather; a regional target counts as a little less complete."""
    less = F.when(F.col("regional"), F.col("completeness") * 0.9).otherwise(F.col("completeness"))
    return members.join(weather, "target").withColumn("completeness", less)
