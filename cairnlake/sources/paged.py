"""Paged feeds as a data source of their own: a partition for some neighbouring pages, filters that the source applies, a plan without listing.

A page is a JSON document in its own folder ``page=<number>`` (from 0), with its rows in a list and perhaps the total of all
pages.  Where the total is stated, it says how many pages there are.  Where it isn't, a page with fewer rows than the limit is
the last one; it is looked for by doubling and halving, so that planning reads few pages and never lists the folder.

    pages(spark, folder, "id long, name string", limit=50).where("id > 7")
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import jobs, keys

#: Python data sources are asked for filters only with this setting.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_TESTS = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


#: Partitions at most: more pages than that are read several to a task, a page at a time.
PARTITIONS = 256


@dataclass
class Pages(ds.InputPartition):
    first: int
    end: int


def _partitions(n: int) -> list[Pages]:
    """So many pages in runs of equal length."""
    step = max(1, -(-n // PARTITIONS))
    return [Pages(i, min(i + step, n)) for i in range(0, n, step)]


def _at(document: object, path: str) -> object:
    for name in filter(None, path.split(".")):
        document = document.get(name) if isinstance(document, dict) else None
    return document


class PagedReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"].rstrip("/")
        self.rows, self.total, self.limit = options.get("rows", "data.rows"), options.get("total", "data.total"), int(options.get("limit", "50"))
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Comparisons of a top column with a value, and IN, are applied by the source; the rest stays with Spark."""
        names = {f.name for f in self.schema}
        for f in filters:
            if isinstance(f, (*_TESTS, ds.In, ds.IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.tests.append((type(f), f.attribute[0], None if isinstance(f, ds.IsNotNull) else f.value))
            else:
                yield f

    def _document(self, number: int) -> object:
        """A page; None behind the last one."""
        store, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        files = [f for f in store.get_file_info(fs.FileSelector(f"{folder}/page={number}", allow_not_found=True)) if not f.base_name.startswith((".", "_"))]
        if not files:
            return None
        with store.open_input_stream(files[0].path) as stream:
            return json.loads(stream.read().decode())

    def _full(self, number: int) -> bool:
        document = self._document(number)
        return document is not None and len(_at(document, self.rows) or []) >= self.limit

    def partitions(self) -> list[Pages]:
        first = self._document(0)
        if first is None:
            return [Pages(0, 0)]  # no page and so no rows, but Spark wants a partition
        total = _at(first, self.total)
        if total is not None:
            return _partitions(max(1, -(-int(total) // self.limit)))
        low, high = -1, 0  # a page known to be full, and one that isn't
        while self._full(high):
            low, high = high, max(1, 2 * high)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._full(middle) else (low, middle)
        return _partitions(high + 1)

    def _fits(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            own = row.get(name)
            if own is None or kind is ds.In and own not in value or kind in _TESTS and not _TESTS[kind](own, value):
                return False
        return True

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        if partition.first == partition.end:
            yield pa.RecordBatch.from_pylist([], arrow)
        for number in range(partition.first, partition.end):
            given = _at(self._document(number), self.rows) or []
            if len(given) > self.limit:
                raise ValueError(f"page {number} has {len(given)} rows, over the limit of {self.limit}")
            rows = [{f.name: _typed(row.get(f.name), f.dataType) for f in self.schema} for row in given if isinstance(row, dict)]
            kept = [row for row in rows if self._fits(row)]
            yield pa.RecordBatch.from_pylist(kept, arrow)


def _typed(value: object, kind: T.DataType) -> object:
    """A value of a JSON document as a column's; what doesn't fit is null, and nested values are text for a text column."""
    try:
        if value is None:
            return None
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, T.IntegralType):
            return int(value) if not isinstance(value, bool) and float(value) == int(value) else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    raise TypeError(f"pages have no columns of type {kind.simpleString()}")


class Paged(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def pages(spark: SparkSession, path: str, schema: str, limit: int = 50, rows: str = "data.rows", total: str = "data.total") -> DataFrame:
    """The rows of the landed pages of a feed.  Turns on Spark's setting PUSHDOWN, so that filters reach the source."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Paged)
    return spark.read.format("paged").schema(schema).options(path=path, limit=limit, rows=rows, total=total).load()


def land(df: DataFrame, path: str, order: list, limit: int = 50, stated: bool = True) -> None:
    """Write a table as pages of a feed, with its total or without, to a new folder.

    A page is a file, so tasks are dealt by pages, not by their few bytes, and commit their own files: the driver would
    move them one after the other.  What a job that fails has written stays, without the mark of success.
    """
    numbered = keys.numbered(df, order, "__row")
    total = numbered.agg(F.count("*").alias("total"))
    page = jobs.spread(numbered.withColumn("page", F.floor(F.col("__row") / limit)), "page").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("__row", F.struct(*df.columns).alias("row")))).alias("rows"))
    data = F.struct(F.col("rows.row").alias("rows"), *([F.col("total")] if stated else []))
    page.crossJoin(F.broadcast(total)).select("page", F.to_json(F.struct(data.alias("data"))).alias("value")).write.partitionBy("page").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def page_counts(spark: SparkSession, path: str, limit: int = 50, rows: str = "data.rows", total: str = "data.total") -> DataFrame:
    """page, n, stated and whether it fits: all pages but the last are full, and the stated total is that of their rows."""
    body = spark.read.text(path, wholetext=True).select(F.col("page").cast("long").alias("page"), F.size(F.from_json(F.get_json_object("value", f"$.{rows}"), "array<string>")).cast("long").alias("n"), F.get_json_object("value", f"$.{total}").cast("long").alias("stated"))
    whole = body.agg(F.max("page").alias("last"), F.sum("n").alias("found"))
    full = F.when(F.col("page") < F.col("last"), F.col("n") == limit).otherwise(F.col("n") <= limit)
    return body.crossJoin(F.broadcast(whole)).select("page", "n", "stated", (full & (F.col("stated").isNull() | (F.col("stated") == F.col("found")))).alias("fits"))
