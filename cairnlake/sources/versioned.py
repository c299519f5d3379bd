"""A keyed table that is written by upserts and read at whole versions.

Rows lie in buckets by a hash of their key.  An upsert reads and writes only the buckets that it touches, into a folder of
its own, and then commits a manifest that names the folder of each bucket.  A manifest is created once and never replaced, so
of two writers one fails and a reader sees one version or the next, nothing between.  A writer that dies before its manifest
leaves a folder that no one reads.  Counters and the position in an import are in the manifest too, so they move with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.jobs import checkpoint


class AlreadyCommitted(RuntimeError):
    """Another writer has created the record first."""


class Log:
    """Numbered JSON records in a folder, each created once, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._replace_nothing = spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        self._conf, self.path = spark._jsc.hadoopConfiguration(), path
        self._folder = self._hadoop.Path(path)
        self._files = self._folder.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(self._folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict:
        stream = self._files.open(self._hadoop.Path(self._folder, f"{number:020}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The number and the record of the last one; 0 and an empty one before the first."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def append(self, number: int, record: Mapping) -> None:
        """Create a record whole: written aside first, then renamed, which fails if it is there already."""
        self._files.mkdirs(self._folder)
        aside = self._hadoop.Path(self._folder, f".{uuid.uuid4().hex}.tmp")
        stream = self._files.create(aside, False)
        try:
            stream.write(json.dumps(record, sort_keys=True).encode())
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        try:
            context.rename(self._files.makeQualified(aside), self._files.makeQualified(self._hadoop.Path(self._folder, f"{number:020}.json")), self._replace_nothing)
        except Py4JJavaError as e:
            self._files.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise AlreadyCommitted(f"record {number} of {self.path}") from e
            raise


class VersionedTable:
    """schema: as text, with the key columns; buckets can't be changed later."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.log = Log(spark, f"{path}/versions")

    def version(self) -> int:
        return self.log.last()[0]

    def manifest(self, version: int | None = None) -> dict:
        return self.log.last()[1] if version is None else self.log.read(version) if version else {}

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, or of the last one; only: of some buckets.  The paths are as many as buckets at most."""
        folders = self.manifest(version).get("buckets", {})
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in folders.items() if only is None or int(b) in only]
        return (self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)).select(*self.columns)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(
        self, new: DataFrame, policies: Mapping[str, str], locked: Column | None = None, name: str | None = None, number: int = 0,
        position: int | None = None, before_commit: Callable[[], None] | None = None,
    ) -> int:
        """The version after this upsert, with policies as for merge.upsert().

        name, number: of the writer and its step; a step that is committed already isn't done again.  position: how far the
        writer is in its input.  Keys must be unique in the new rows.
        """
        base, manifest = self.log.last()
        if name is not None and manifest.get("steps", {}).get(name, -1) >= number:
            return base
        rows = checkpoint(new.select(*self.columns).withColumn("bucket", self._bucket()))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*self.keys)).alias("keys")).collect()  # a row a bucket
        if any(r.n != r["keys"] for r in sizes):
            raise ValueError("keys repeat in the new rows")
        touched, fresh = [r.bucket for r in sizes], rows.drop("bucket")
        old = self.read(base, touched) if base else self.spark.createDataFrame([], self.schema)
        counts = {r.state: r.n for r in merge.changes(old, fresh, self.keys, list(policies)).groupBy("state").agg(F.count("*").alias("n")).collect()}
        folder = uuid.uuid4().hex
        merged = merge.upsert(old, fresh, self.keys, policies, locked).select(*self.columns).withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        if before_commit:
            before_commit()
        record = dict(manifest)
        record["buckets"] = manifest.get("buckets", {}) | {str(b): folder for b in touched}
        if name is not None:
            record["steps"] = manifest.get("steps", {}) | {name: number}
            counters = manifest.get("counters", {}).get(name, {})
            added = {s: counters.get(s, 0) + counts.get(s, 0) for s in ("inserted", "updated", "unchanged")}
            record["counters"] = manifest.get("counters", {}) | {name: added}
        if position is not None:
            record["positions"] = manifest.get("positions", {}) | {name or "": position}
        self.log.append(base + 1, record)
        return base + 1

    def sink(self, policies: Mapping[str, str], name: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that upserts each micro-batch once, however often it runs."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, policies, name=name, number=batch_id)

        return run


def import_rows(rows: DataFrame, table: VersionedTable, policies: Mapping[str, str], name: str, step: int, number: str = "row_number", before_commit: Callable[[], None] | None = None) -> dict:
    """Upsert numbered rows step by step from where the last committed one ended; the counters so far.

    A run that dies in a step leaves position, counters and rows as they were before it.
    """
    numbered = checkpoint(rows)
    total = numbered.agg(F.max(number)).first()[0]
    while True:
        manifest = table.manifest()
        at = manifest.get("positions", {}).get(name, 0)
        if total is None or at > total:
            return manifest.get("counters", {}).get(name, {"inserted": 0, "updated": 0, "unchanged": 0})
        part = numbered.where((F.col(number) >= at) & (F.col(number) < at + step))
        table.upsert(part, policies, name=name, number=at + step, position=at + step, before_commit=before_commit)
