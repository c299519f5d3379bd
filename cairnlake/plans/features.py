"""Features of days from hourly weather, as the daily and the evidence index want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import series

#: Days that are looked ahead, hours of the evening, and what counts as a complete day.
DAYS_DAILY, DAYS_EVIDENCE, EVENING, HOURS = 15, 8, (18, 23), 24


def by_day(hours: DataFrame, entity: str, at: str) -> DataFrame:
    """One row for each entity and day from hourly rows with temperature, humidity and rain.

    Means skip nulls, sums count them as nothing; ``evening`` is the mean humidity of the evening hours; ``available``
    counts the hours that have a temperature.
    """
    day, hour = F.col(at).cast("date"), F.hour(at)
    return hours.groupBy(entity, day.alias("day")).agg(
        F.avg("temperature").alias("temperature"), F.min("temperature").alias("low"), F.max("temperature").alias("high"), F.avg("humidity").alias("humidity"),
        F.coalesce(F.sum("rain"), F.lit(0.0)).alias("rain"), F.avg(F.when(hour.between(*EVENING), F.col("humidity"))).alias("evening"),
        F.count_distinct(F.when(F.col("temperature").isNotNull(), hour)).alias("available"),
    )


def daily_rows(days: DataFrame, entity: str, start: str) -> DataFrame:
    """Rows for the days from ``start`` on: rain of the 1, 3, 7 and 14 rows before, and completeness, which is counted
    from the first day on and so runs through all of them."""
    trailing = series.trailing_sums(days, [entity], "day", "rain", series.TRAILING)
    ahead = trailing.where(F.datediff("day", F.lit(start).cast("date")).between(0, DAYS_DAILY - 1))
    return series.running_share(ahead, [entity], "day", F.col("available"), F.lit(HOURS))


def evidence_rows(days: DataFrame, entity: str, start: str, history: int = 60) -> DataFrame:
    """Rows for the days from ``start`` on, each with the days before it, oldest first."""
    columns = ["rain", "temperature", "low", "high"]
    past = series.history(days, [entity], "day", columns, history)
    offset = F.row_number().over(Window.partitionBy(entity).orderBy("day")) - 1
    ahead = past.where(F.col("day") >= F.lit(start).cast("date")).withColumn("day_offset", offset)
    return ahead.where(F.col("day_offset") < DAYS_EVIDENCE)
