"""Duplicate windows and rate counts over a table of reports, counters and rollups over a stream.

Duplicates by any of several identities, and several limits at once, as a table and as a stream, are in admission.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def accepted_batch(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], seconds: int = DAY) -> DataFrame:
    """Events that come more than ``seconds`` after the last accepted one of their key: the columns keys and order.

    Each acceptance restarts the window, so the events of a key are told one after the other.  They are dealt by
    key, sorted, and walked as a stream that carries nothing but the key and its last accepted time, so a key with
    very many events takes time but no memory.
    """
    rows = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"), *order).where("__us IS NOT NULL")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "__us", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            accepted = []
            for key, at in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("__us").to_pylist(), strict=True):
                fresh = key != now or at - last > seconds * 1_000_000
                if fresh:
                    now, last = key, at
                accepted.append(fresh)
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema).drop("__us")


def rate_counts(df: DataFrame, key: str, ts: str, seconds: int, name: str = "before") -> DataFrame:
    """Events of the same key in the seconds before each event (not the event's own instant).

    Time is cut into slots of that length and each event also stands in the slot behind its own, so that a key with
    very many events is as many tasks as it has slots.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(us / (seconds * 1_000_000))
    dealt = df.withColumn("__own", own).withColumn("__slot", F.explode(F.when(F.col("__own").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(own, own + 1))))
    w = Window.partitionBy(key, "__slot").orderBy(us).rangeBetween(-seconds * 1_000_000, -1)
    return dealt.withColumn(name, F.count("*").over(w)).where(F.col("__slot").eqNullSafe(F.col("__own"))).drop("__own", "__slot")


def within_limits(df: DataFrame, limits: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """Keep events under all limits (key, ts, seconds, most)."""
    for i, (key, ts, seconds, most) in enumerate(limits):
        df = rate_counts(df, key, ts, seconds, f"__n{i}")
    return df.where(F.forall(F.array(*(F.col(f"__n{i}") < most for i, (*_, most) in enumerate(limits))), lambda ok: ok)).drop(*(f"__n{i}" for i in range(len(limits))))


def daily_counts(df: DataFrame, key: str, ts: str, late: str | None = None) -> DataFrame:
    """Events by key and day; a stream gets a watermark, so that old days can be dropped from state."""
    if df.isStreaming:
        df = df.withWatermark(ts, late or "1 day")
    return df.groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("date").alias("day"), "n")


def refresh_rollups(rollups_path: str, facts_path: str, key: str, rollup: Callable[[DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: compute the rollups of the key buckets that a micro-batch touches again.

    Facts and rollups are Parquet tables partitioned by ``bucket``, a hash of the key.  Only the touched buckets' facts
    are read and only their rollups written, so a batch costs what it touches.  A batch replaces what it wrote before,
    so a failed one can run again.  The bucket numbers that come to the driver are ``buckets`` at most.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{facts_path}/batch={batch_id}")
        new = spark.read.option("basePath", facts_path).parquet(f"{facts_path}/batch={batch_id}")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if touched:
            facts = spark.read.parquet(facts_path).where(F.col("bucket").isin(touched)).drop("bucket", "batch")
            fresh = rollup(facts).withColumn("bucket", bucket)
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(rollups_path)

    return run


def cache_state(df: DataFrame, as_of: str) -> DataFrame:
    """Add state to cached rows (expires_at, lease_until, failed_at): fresh; leased, while one refresh is under way;
    backing_off for two minutes after an error; due otherwise."""
    now = F.lit(as_of).cast("timestamp")
    holds = lambda c: F.coalesce(F.col(c) > now, F.lit(False))
    failed = F.coalesce(F.col("failed_at") > now - F.expr("INTERVAL 2 MINUTES"), F.lit(False))
    return df.withColumn("state", F.when(holds("expires_at"), "fresh").when(holds("lease_until"), "leased").when(failed, "backing_off").otherwise("due"))


def by_observation(df: DataFrame, observed: str, submitted: str, as_of: str, earliest: str = "2000-01-01", days: int = 30) -> DataFrame:
    """Facts that had arrived by a point in time, with whether they are recent; late ones are old by their observation, not lost.

    What was observed before ``earliest`` or after its own arrival's day isn't legal.
    """
    now = F.lit(as_of).cast("timestamp")
    legal = (F.col(observed) >= F.lit(earliest).cast("date")) & (F.col(observed) <= F.col(submitted).cast("date"))
    return df.where((F.col(submitted) <= now) & legal).withColumn("recent", F.col(observed) >= F.date_sub(now.cast("date"), days))
