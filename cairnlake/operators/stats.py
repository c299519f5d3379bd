"""Weighted statistics and rollups as of a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import ascii_words


def effective_size(weight: Column) -> Column:
    """Aggregate: (sum of weights) squared over the sum of squared weights; 0 without weight."""
    squares = F.sum(weight * weight)
    return F.when(squares > 0, F.pow(F.sum(weight), 2) / squares).otherwise(0.0)


def agreement(df: DataFrame, keys: Sequence[str], value: str, weight: str, spread: float = 50.0, name: str = "agreement") -> DataFrame:
    """1 minus the weighted standard deviation over ``spread``, within 0..1.  Two passes, so that it is stable."""
    mean = df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("__mean"))
    off = df.join(mean, list(keys)).groupBy(*keys).agg((F.sum(F.col(weight) * F.pow(F.col(value) - F.col("__mean"), 2)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("__var"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt("__var") / spread))
    return off.select(*keys, F.coalesce(score, F.lit(0.0)).alias(name))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "weighted_median") -> DataFrame:
    """The lowest value at which the running weight reaches half of all weight.

    Weights of equal values are summed first, so the window sorts distinct values, not rows.
    """
    by_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    running = by_value.withColumn("__run", F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__w").over(w))
    return running.where(F.col("__run") >= F.col("__all") / 2).groupBy(*keys).agg(F.min(value).alias(name))


def recent_and_all(df: DataFrame, key: str, value: str, ts: str, as_of: str, days: int = 30) -> DataFrame:
    """Average and count over the last days and over all time, and the latest date; the boundary day counts."""
    now = F.lit(as_of).cast("timestamp")
    recent = F.col(ts).cast("date") >= F.date_sub(now.cast("date"), days)
    return df.where(F.col(ts) <= now).groupBy(key).agg(
        F.avg(F.when(recent, F.col(value))).alias("recent_avg"),
        F.count(F.when(recent, F.lit(1))).alias("recent_count"),
        F.avg(value).alias("all_avg"),
        F.count("*").alias("all_count"),
        F.max(F.col(ts).cast("date")).alias("latest_day"),
    )


def theme_summary(df: DataFrame, key: str, text: str, ts: str, themes: Sequence[tuple[str, str]], share: float = 0.25, top: int = 3) -> DataFrame:
    """Themes (phrase, pattern) that at least two texts and a quarter of a key's texts have; the top ones, in order.

    One flag per theme is summed, so that nothing but a row per key and theme is shuffled.
    """
    flags = F.array(*(F.col(text).rlike(ascii_words(p)) for _, p in themes))
    # As rows of a generator, so that each pattern runs once and not in each of its two aggregates.
    held = df.where(F.trim(F.col(text)) != "").select(key, F.col(ts).alias("__ts"), F.explode(F.array(flags)).alias("__f"))
    counted = held.groupBy(key).agg(
        F.count("*").alias("__n"),
        *(F.count_if(F.get("__f", F.lit(i))).alias(f"__c{i}") for i in range(len(themes))),
        *(F.max(F.when(F.get("__f", F.lit(i)), F.col("__ts"))).alias(f"__t{i}") for i in range(len(themes))),
    )
    rows = F.array(*(F.struct(F.lit(phrase).alias("phrase"), F.col(f"__c{i}").alias("count"), F.col(f"__t{i}").alias("newest"), F.lit(i).alias("place")) for i, (phrase, _) in enumerate(themes)))
    least = F.greatest(F.lit(2), F.ceil(F.col("__n") * share))
    kept = counted.select(key, "__n", F.explode(rows).alias("x")).where((F.col("x.count") >= least) & (F.col("__n") >= 2)).select(key, "x.*")
    w = Window.partitionBy(key).orderBy(F.desc("count"), F.desc_nulls_last("newest"), "place")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def reasons(df: DataFrame, reason: str, **also: Column) -> DataFrame:
    """Rows by reason, and how many of them each further test holds for; rows without a reason count as ``none``."""
    return df.groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), *(F.count_if(test).alias(name) for name, test in also.items()))
