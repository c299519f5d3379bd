"""Helpers for jobs that have to survive lost executors and very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators.jobs import checkpoint, small_batches


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than one row in so many is salted; so there are fewer of these keys than that.
HOT_SHARE = 1000


def join_unique(rows: DataFrame, one: DataFrame, key: str, counts: str, spread: str, how: str = "inner", store: bool = False) -> DataFrame:
    """Join rows with a table that has one row for each key, where a few keys may have a large part of the rows.

    ``counts`` is a column of ``one`` with the number of rows that its key has.  Keys with more than a
    thousandth of all counted rows number under a thousand, whatever the input's size: these names are
    broadcast, their rows are dealt over salts by the column ``spread``, and their row of ``one`` is repeated
    for each salt.  ``one`` is read three times; store: from a checkpoint, which keeps plans small, and with the
    sum of all counts as a number.
    """
    salts = partitions(rows.sparkSession)
    if store:
        one = checkpoint(one)
        total = one.agg(F.sum(counts)).first()[0] or 0
        marked = one.withColumn("__hot", F.col(counts) * HOT_SHARE > F.lit(total))
    else:
        total = one.agg(F.sum(counts).alias("__total"))
        marked = one.crossJoin(F.broadcast(total)).withColumn("__hot", F.col(counts) * HOT_SHARE > F.col("__total")).drop("__total")
    hot = marked.where("__hot").select(F.col(key).alias("__key"))
    salted = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left")
        .withColumn("__salt", F.when(F.col("__key").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)))
        .drop("__key")
    )
    repeated = marked.withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    ).drop("__hot")
    return salted.withColumn("__salt", F.col("__salt").cast("long")).join(repeated, [key, "__salt"], how).drop("__salt")
