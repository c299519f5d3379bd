"""Sharding: contiguous shards of nearly equal bytes, from global prefix sums of per-partition totals.

Texts never move: only each document's size and checksums are sorted, by a range partitioning over the order
columns.  Each partition's total gives its place in the whole, a running sum inside the partition gives each
document's, and the shards are cut at equal targets.  Documents with equal texts are neighbours in the order.
A group of equal texts up to ``WHOLE`` of a shard is kept whole, where its middle byte falls, so that a cut moves by
half of that at most and all shards are near equal; a larger group is cut like anything else, since it may be larger
than a shard.

Nulls and edge cases: a null text has no bytes and the checksum 0, but still the overhead; an empty text is in
the same group as null; null doc_ids come first; repeated rows are separate documents; no rows give no rows;
fewer documents than shards leave shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpoint, read

SHARDS = 24
#: Bytes that a document takes besides its text.
OVERHEAD = 8
#: Groups up to this part of a shard's target are kept whole.
WHOLE = 1 / 50


def shard(documents: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, whole: float = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    ).withColumn("doc_key", F.xxhash64("doc_id"))
    order = ["text_key", "text_crc32", "size", "doc_key", "doc_id"]
    # Range bounds are drawn by sampling, and may differ if the plan runs again, so what they gave is stored.
    # doc_key spreads even a text that has a third of all rows over many partitions.
    placed = checkpoint(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # One row for each partition, so the window over them has a bounded number of rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = (
        placed.join(F.broadcast(starts), "part")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
    )
    # A group's first byte: within its partition by a window; a group that began in an earlier partition is
    # found by the few groups at partitions' edges.
    group = ["text_key", "text_crc32", "size"]
    spans = placed.groupBy("part").agg(F.min(F.struct(*group)).alias("first"), F.max(F.struct(*group)).alias("last"))
    edges = spans.select(F.explode(F.array("first", "last")).alias("g")).select("g.*").distinct()
    edge_starts = (
        running.join(F.broadcast(edges), group).groupBy(*group)
        .agg(F.min("start").alias("edge_start"), F.sum("size").alias("edge_bytes"))
    )
    here = Window.partitionBy("part", *group)
    target = F.greatest(F.col("all_bytes") / F.lit(shards), F.lit(1.0))
    cut = (
        running.withColumn("group_start", F.min("start").over(here))
        .withColumn("group_bytes", F.sum("size").over(here))
        .join(F.broadcast(edge_starts), group, "left")
        .withColumn("group_start", F.coalesce("edge_start", "group_start"))
        .withColumn("group_bytes", F.coalesce("edge_bytes", "group_bytes"))
        .withColumn("at", F.when(F.col("group_bytes") <= target * F.lit(whole), F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start")))
        .withColumn("shard", F.least(F.floor(F.col("at") / target), F.lit(shards - 1)).cast("int"))
    )
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
