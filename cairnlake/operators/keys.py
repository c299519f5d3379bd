"""The best rows of each key, pages, and tests over groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import checkpoint


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order.

    The order should end in something unique and name where nulls go.  Spark keeps only the first row of each
    key and task before the shuffle (a group limit), so a key with very many rows is no burden.
    """
    return top_n_per_key(df, keys, order, 1).drop("__rank")


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "__rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def best_value(value: str | Column, *order: Column) -> Column:
    """Aggregate: the value of the row that is first in this order; order columns sort ascending, nulls last.

    Unlike a window it combines before the shuffle and needs no sort.
    """
    keys = [F.struct(F.isnull(o).alias("n"), o.alias("v")) for o in order]
    return F.min_by(value, F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))


def unique_match(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that have exactly one row, by counts that combine before the shuffle."""
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*df.columns)).alias("__row"))
    return one.where("__n = 1").select("__row.*")


def complete_in_all(df: DataFrame, entity: str, group: str, least_rows: int) -> DataFrame:
    """Relational division: entities with at least so many rows in every group that occurs."""
    enough = df.groupBy(entity, group).agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    wanted = df.agg(F.count_distinct(group).alias("wanted"))
    got = enough.groupBy(entity).agg(F.count("*").alias("got"))
    return got.crossJoin(F.broadcast(wanted)).where("got = wanted").select(entity)


def bad_without_good(df: DataFrame, key: str, bad: Column, good: Column) -> DataFrame:
    """Keys with some bad row and no good one, in one aggregate instead of a semi and an anti join."""
    return df.groupBy(key).agg(F.bool_or(bad).alias("b"), F.bool_or(good).alias("g")).where("b AND NOT g").select(key)


def with_flag(df: DataFrame, other: DataFrame, on: str, flag: str) -> DataFrame:
    """Whether the other table has the key."""
    keys = other.select(on).where(F.col(on).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def optional(df: DataFrame, *conditions: tuple[object, Column]) -> DataFrame:
    """Apply those conditions whose parameter is given; the others aren't in the plan at all."""
    for value, test in conditions:
        if value is not None and value != "all":
            df = df.where(test)
    return df


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page, 1-based; only the rows up to its end are kept while sorting."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def after(df: DataFrame, key: str, cursor: object, size: int) -> DataFrame:
    """Keyset page: the next rows after a key."""
    return (df if cursor is None else df.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(size)


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """The number of all rows beside each, from a separate count that combines before the shuffle."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """First rows of their keys, and the repeats."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


def minus_keys(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose keys the other table doesn't have."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def sorted_by(choice: str, orders: Mapping[str, Sequence[Column]], tie: Sequence[Column]) -> list[Column]:
    """The order that a parameter names, or else the first one, ended by the tie-break; only its columns are in the plan."""
    return [*orders.get(choice, next(iter(orders.values()))), *tie]


def natural_id(*columns: str) -> Column:
    """An id from a row's natural key, so that rows written apart find each other without reading ids back."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def parents(df: DataFrame, key: str, parent: str, column: str, name: str) -> DataFrame:
    """A column of each row's parent in the same table; null without one."""
    above = df.select(F.col(key).alias("__parent"), F.col(column).alias(name))
    return df.join(above, F.col(parent) == F.col("__parent"), "left").drop("__parent")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Rows with their number in an order, from 0, without bringing them together.

    Rows are dealt by ranges of the order, and what the ranges before a partition hold is added to a row's number in its
    own.  The dealt rows are stored, as the sampled bounds of ranges may differ when a plan runs again.  The order must
    end in something unique.
    """
    dealt = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = dealt.withColumn("__part", F.shiftrightunsigned("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND((1 << 33) - 1))
    # A row for each partition, so what is broadcast and the window over it are bounded by the cluster, not the data.
    totals = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = totals.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__at", "__part", "__in", "__before")


def resume(df: DataFrame, order: Sequence[Column], done: int) -> DataFrame:
    """What is left of an ordered input after so many items, when a run replays it from a checkpoint; in as many partitions as it takes."""
    return numbered(df, order, "__row").where(F.col("__row") >= done).drop("__row")


def centroids(df: DataFrame, name: str, typed: str, n: int = 8, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Mean place and number of rows of each name that contains what was typed: names that begin with it first, then by number."""
    found = df.where(F.col(name).ilike(f"%{typed}%")).groupBy(name).agg(F.avg(lat).alias(lat), F.avg(lon).alias(lon), F.count("*").alias("n"))
    return found.orderBy(F.when(F.col(name).ilike(f"{typed}%"), 0).otherwise(1), F.desc("n"), name).limit(n)
