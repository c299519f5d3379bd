"""Ordered series: trailing windows, merged sources, recurrences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import top_n_per_key


def trailing_sums(df: DataFrame, keys: Sequence[str], order: str, value: str, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Sums over frames of rows relative to the current one, 0 where a frame is empty."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *(F.coalesce(F.sum(value).over(w.rowsBetween(a, b)), F.lit(0.0)).alias(name) for name, (a, b) in spans.items()))


#: Rain of the last days, without the current one, and in lag buckets counted back from the current one.
TRAILING = {"sum_1": (-1, -1), "sum_3": (-3, -1), "sum_7": (-7, -1), "sum_14": (-14, -1)}
LAG_BUCKETS = {"lag_0_2": (-2, 0), "lag_3_7": (-7, -3), "lag_8_14": (-14, -8), "lag_15_29": (-29, -15)}


def lag_difference(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, n: int = 1) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value, n).over(Window.partitionBy(*keys).orderBy(order)))


def merge_series(history: DataFrame, forecast: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All times of both series.  Where the forecast has a row it wins, even if its value is null."""
    f = forecast.select(*keys, F.col(value).alias("__f"), F.lit(True).alias("__has"))
    joined = history.select(*keys, F.col(value).alias("__h")).join(f, list(keys), "full")
    return joined.select(*keys, F.when(F.col("__has"), F.col("__f")).otherwise(F.col("__h")).alias(value))


def columnar_to_rows(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """A struct of parallel arrays, one of them the time, as one row for each time."""
    return df.select(*keys, F.inline(F.arrays_zip(F.col(time).alias("time"), *(F.col(c).alias(c) for c in columns))))


def history(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], n: int, name: str = "history") -> DataFrame:
    """The n rows before each row, oldest first, as an array of structs."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn(name, F.collect_list(F.struct(order, *columns)).over(w))


def gathered(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str = "history", last: int | None = None, first: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of each key in order, as an array; last: only so many of the latest, as what reads the array looks back no further.

    With last, Spark drops the older ones before the shuffle (a group limit), so a key with a long history is no burden.
    Without it an array has all rows of its key, which is for series with a row a day.
    first: columns of the whole history's first row to keep beside the array, by their new names.
    """
    if first:
        at = F.struct(*order)
        begun = df.groupBy(*keys).agg(*(F.min_by(F.struct(c), at)[c].alias(new) for c, new in first.items()))
        return gathered(df, keys, order, columns, name, last).join(begun, list(keys))
    if last is not None:
        df = top_n_per_key(df, keys, [F.desc_nulls_last(c) for c in order], last).drop("__rank")
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias(name))


def running_share(df: DataFrame, keys: Sequence[str], order: str, available: Column, expected: Column, name: str = "completeness") -> DataFrame:
    """Share of expected values that were there, counted from the first row on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.sum(available).over(w) / F.nullif(F.sum(expected).over(w), F.lit(0)), F.lit(0.0)))


def season_matches(target: DataFrame, past: DataFrame, key: str, day: str, past_day: str, window: int = 21) -> DataFrame:
    """Past rows of the same key, of earlier years, within so many days of the target's day of the year.

    The year is cut into slots as wide as the window, the last one shorter.  A target looks into all that its
    window touches, so the join is on equal keys and slots, also around the turn of the year.
    """
    slot = lambda day0: F.floor(day0 / window).cast("int")
    shortest = 366 - (-(-366 // window) - 1) * window
    steps = [*range(-window, window, min(shortest, window)), window]
    near = F.array_distinct(F.array(*(slot(F.pmod(F.dayofyear(day) - 1 + d, F.lit(366))) for d in steps)))
    left = target.withColumn("__slot", F.explode(near))
    right = past.withColumn("__slot", slot(F.dayofyear(past_day) - 1))
    gap = F.abs(F.dayofyear(day) - F.dayofyear(past_day))
    joined = left.join(right, [key, "__slot"]).withColumn("distance", F.least(gap, F.lit(366) - gap))
    return joined.where((F.col("distance") <= window) & (F.year(day) > F.year(past_day))).drop("__slot")
