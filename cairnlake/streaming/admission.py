"""Admission of events under limits on the identities that they share: duplicates on any identity, rate limits on several.

A limit says how many accepted events with the same values of some columns there may be within some seconds.  An event is
accepted if all limits leave room, and only accepted events count.  So whether an event is accepted depends on earlier ones
by any chain of shared identities, and the events of a chain have to be told one after the other; but only of a chain:

1. Time is cut into slots as long as the longest limit.  An identity's slots that follow each other without a gap are an
   island: events of different islands are too far apart to matter to each other.
2. Events tie the islands of their identities; the connected components of these ties are the chains.  What is tied are
   islands, of which an identity that has a third of all events has few, not events.
3. Events are sorted by chain and time in ranges, so that a long chain is many tasks, and packed into compressed blocks of a
   batch.  The blocks of a chain are dealt to one task, which walks them in order and keeps nothing but the times that its
   limits still count.  What that task sorts are blocks, a row for some thousand events.

On a stream, each micro-batch is admitted beside the accepted events of the longest limit before it, which are kept in a table.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.jobs import checkpoint

HOUR, DAY = 3600, 86_400


@dataclass(frozen=True)
class Limit:
    """At most so many accepted events with equal columns in any span of so many seconds, both ends included.

    An event with a null in one of the columns isn't limited by them.
    """

    columns: tuple[str, ...]
    seconds: int
    most: int


def any_identity(entity: str, identities: Sequence[str], seconds: int = DAY) -> list[Limit]:
    """One accepted event of an entity with any of the same identities in so many seconds."""
    return [Limit((entity, i), seconds, 1) for i in identities]


def _value(columns: tuple[str, ...], at: int) -> Column:
    """The columns as one name, null if one of them is."""
    part = lambda c: F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))
    return F.concat(F.lit(f"{at}|"), *(part(c) for c in columns))


def _chains(named: DataFrame, kinds: int, seconds: int) -> DataFrame:
    """Rows with their chain, a name; events without any identity are left out."""
    slotted = named.where(F.size(F.array_compact("__names")) > 0).withColumn("__slot", F.floor(F.col("__us") / (seconds * 1_000_000)))
    occupied = slotted.select(F.explode(F.array_compact("__names")).alias("name"), F.col("__slot").alias("slot")).distinct()
    gap = F.col("slot") - F.lag("slot").over(Window.partitionBy("name").orderBy("slot"))
    begins = F.when(F.coalesce(gap > 1, F.lit(True)), F.col("slot"))
    island = F.last(begins, ignorenulls=True).over(Window.partitionBy("name").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    islands = checkpoint(occupied.select("name", "slot", F.concat_ws("@", island.cast("string"), "name").alias("node")))
    if kinds == 1:
        first = F.element_at(F.array_compact("__names"), 1)
        return slotted.withColumn("name", first).join(islands.withColumnRenamed("slot", "__slot"), ["name", "__slot"]).withColumnRenamed("node", "__chain").drop("name", "__slot")
    # Ties between the names of an event, each once for a slot; the first name that isn't null stands for the event.
    both = slotted.select(F.array_compact("__names").alias("names"), F.col("__slot").alias("slot")).distinct()
    ties = both.select(F.col("names")[0].alias("one"), F.explode("names").alias("name"), "slot").distinct()
    nodes = ties.join(islands, ["name", "slot"]).select("one", "slot", F.col("node").alias("b"))
    pairs = nodes.join(islands.select(F.col("name").alias("one"), "slot", F.col("node").alias("a")), ["one", "slot"]).select("a", "b").distinct()
    tied = connected_components(checkpoint(pairs), "a", "b")
    of = islands.join(tied, "node", "left").select(F.col("name").alias("__one"), F.col("slot").alias("__slot"), F.coalesce("component", "node").alias("__chain"))
    return slotted.withColumn("__one", F.element_at(F.array_compact("__names"), 1)).join(of, ["__one", "__slot"]).drop("__one", "__slot")


def _walk(limits: Sequence[tuple[int, int, int]]) -> Callable:
    """limits: number of the name, microseconds, most."""
    longest = max(us for _, us, _ in limits)
    counted = {at for at, _, _ in limits}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, times, until = None, defaultdict(deque), 0
        for batch in batches:
            accepted = []
            for c, at, names, seed in zip(*(batch.column(x).to_pylist() for x in ("__chain", "__us", "__names", "__seed")), strict=True):
                if c != chain:
                    chain, until = c, at + longest
                    times.clear()
                elif at > until:  # names whose last time no limit counts any more
                    for name in [n for n, seen in times.items() if seen[-1] < at - longest]:
                        del times[name]
                    until = at + longest
                fits = seed or all(
                    names[k] is None or names[k] not in times or sum(t >= at - us for t in times[names[k]]) < most for k, us, most in limits
                )
                if fits:
                    for name in (names[k] for k in counted if names[k] is not None):
                        seen = times[name]
                        seen.append(at)
                        while seen[0] < at - longest:
                            seen.popleft()
                accepted.append(fits and not seed)
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return run


#: What the walk needs of an event.
_WALKED = ["row", "__seed", "__us", "__names", "__chain"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events as blocks, each of one bucket, numbered in their order."""
    at = TaskContext.get().partitionId() << 32
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        bucket = batch.column("__bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            piece = batch.select(_WALKED).slice(lo, hi - lo)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, piece.schema, options=options) as writer:
                writer.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[lo : lo + 1]), pa.array([at]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["__bucket", "__at", "__block"])
            at += 1


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of blocks, a block at a time."""
    for batch in batches:
        for block in batch.column("__block"):
            yield from pa.ipc.open_stream(block.as_buffer())


def _blocks(chained: DataFrame, event_id: str, buckets: int) -> DataFrame:
    """Events in blocks that are in order within their bucket, which has whole chains.  Stored, as ranges are sampled."""
    order = [F.col("__bucket"), F.col("__chain"), F.col("__us"), F.desc("__seed"), F.col(f"row.{event_id}")]
    ranged = chained.select(*_WALKED).withColumn("__bucket", F.pmod(F.xxhash64("__chain"), F.lit(buckets))).repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpoint(ranged.mapInArrow(_packed, "__bucket long, __at long, __block binary"))


def admitted(events: DataFrame, limits: Sequence[Limit], ts: str, event_id: str, before: DataFrame | None = None) -> DataFrame:
    """The accepted events, in order of time and, for equal ones, of event_id, which must be unique.

    before: events accepted earlier, with the same columns, which count but aren't returned.  Events without a time are left
    out; so are none without identities, which no limit holds back.
    """
    if not limits:
        return events
    kinds = sorted({limit.columns for limit in limits})
    names = F.array(*(_value(columns, i) for i, columns in enumerate(kinds)))
    longest = max(limit.seconds for limit in limits)
    given = F.struct(*events.columns)
    rows = events.select(given.alias("row"), *(F.col(c) for c in dict.fromkeys(c for k in kinds for c in k)), F.col(ts).alias("__ts"), F.lit(False).alias("__seed"))
    if before is not None:
        rows = rows.unionByName(before.select(F.struct(*events.columns).alias("row"), *(F.col(c) for c in dict.fromkeys(c for k in kinds for c in k)), F.col(ts).alias("__ts"), F.lit(True).alias("__seed")))
    named = rows.select("row", "__seed", F.unix_micros(F.col("__ts").cast("timestamp")).alias("__us"), names.alias("__names")).where("__us IS NOT NULL")
    chained = _chains(named, len(kinds), longest)
    buckets = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _blocks(chained, event_id, buckets).repartition(buckets, "__bucket").sortWithinPartitions("__bucket", "__at")
    walk = _walk([(kinds.index(limit.columns), limit.seconds * 1_000_000, limit.most) for limit in limits])
    walked = dealt.mapInArrow(lambda batches: (b.select(["row"]) for b in walk(_events(batches))), chained.select("row").schema)
    free = named.where((F.size(F.array_compact("__names")) == 0) & ~F.col("__seed"))
    return walked.select("row").unionByName(free.select("row")).select(*(F.col("row")[c].alias(c) for c in events.columns))


def admit_into(path: str, limits: Sequence[Limit], ts: str, event_id: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the accepted events of a stream in a Parquet table by day and batch.

    Only the days that the longest limit reaches back to are read, so a batch costs what it and they hold.  A batch replaces
    what it wrote before and doesn't count it, so one that failed can run again.  An event that comes after later ones of
    its identities is told by those accepted before its own time.
    """
    longest = max(limit.seconds for limit in limits)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = checkpoint(batch)
        span = batch.agg(F.min(ts).cast("timestamp").alias("low"), F.max(ts).cast("timestamp").alias("high")).select(
            F.to_date(F.col("low") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(longest))).alias("low"), F.to_date("high").alias("high")
        ).first()
        if span.low is None:
            return
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema) + ", batch long, day date"
        kept = f"{path}/accepted"
        spark.createDataFrame([], schema).write.mode("append").partitionBy("day", "batch").parquet(kept)  # so that the first batch finds a table
        before = spark.read.schema(schema).parquet(kept).where((F.col("day") >= F.lit(span.low)) & (F.col("day") <= F.lit(span.high)) & (F.col("batch") < batch_id))
        new = admitted(batch, limits, ts, event_id, before.select(*batch.columns))
        placed = checkpoint(new.withColumn("batch", F.lit(batch_id).cast("long")).withColumn("day", F.to_date(ts)))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(kept)

    return run


def accepted(spark, path: str, schema: str) -> DataFrame:
    """What admit_into() has accepted so far."""
    return spark.read.schema(f"{schema}, batch long, day date").parquet(f"{path}/accepted").drop("batch", "day")
