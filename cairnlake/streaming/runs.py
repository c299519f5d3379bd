"""Triggered runs: what a source has is worked off in micro-batches, by one run at a time, and published so that it can repeat."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.versioned import AlreadyCommitted, Log


class Lease:
    """Who may run until when: the last record of a log.  Taking, renewing and ending it each create the next record."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 600, clock: Callable[[], float] = time.time) -> None:
        self.log, self.seconds, self.clock = Log(spark, path), seconds, clock

    def take(self, owner: str) -> bool:
        """Take or renew the lease, unless another owner has it."""
        number, held = self.log.last()
        if held and held["owner"] != owner and held["until"] > self.clock():
            return False
        try:
            self.log.append(number + 1, {"owner": owner, "until": self.clock() + self.seconds})
        except AlreadyCommitted:  # another one was quicker
            return False
        return True

    def end(self, owner: str) -> None:
        number, held = self.log.last()
        if held.get("owner") == owner:
            with contextlib.suppress(AlreadyCommitted):  # another one has it by now
                self.log.append(number + 1, {"owner": owner, "until": self.clock()})


class LeaseLost(RuntimeError):
    """Another run has taken over."""


def run_due(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint_path: str, lease: Lease, owner: str) -> bool:
    """Work off what the stream's source has now; False if another run is under way.

    publish is a foreachBatch function that does a batch's work once, however often it runs, such as VersionedTable.sink().
    Before each batch the lease is renewed; a run that has lost it stops, and its checkpoint lets the next run go on there.
    """
    if not lease.take(owner):
        return False

    def held(batch: DataFrame, batch_id: int) -> None:
        if not lease.take(owner):
            raise LeaseLost(owner)
        publish(batch, batch_id)

    query = stream.writeStream.foreachBatch(held).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        lease.end(owner)
    return True
