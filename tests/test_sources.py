"""Paged feeds as a data source, versioned tables, imports that resume, and triggered runs, with writers that die."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import keys
from cairnlake.sources import feeds, paged, versioned
from cairnlake.streaming import runs

SCHEMA = "id long, name string, size int"
POLICIES = {"name": "keep_if_null", "size": "overwrite"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "stated"), [(0, True), (1, False), (20, True), (20, False), (21, True), (57, False), (40, False)])
def test_pages(spark, tmp_path, n, stated):
    df = spark.range(n).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("name"), (F.col("id") % 5).cast("int").alias("size"))
    paged.land(df, str(tmp_path / "p"), [F.asc("id")], 10, stated)
    got = paged.pages(spark, str(tmp_path / "p"), SCHEMA, 10)
    assert rows(got) == rows(df)
    assert got.rdd.getNumPartitions() in (max(1, -(-n // 10)), max(1, -(-n // 10)) + (n % 10 == 0 and not stated))
    assert rows(got.where("size > 2 AND name IN ('n1', 'n3') AND upper(name) <> 'N3'")) == rows(df.where("size > 2 AND name IN ('n1', 'n3') AND upper(name) <> 'N3'"))


def test_pushed_filters_and_odd_pages(spark, tmp_path):
    for i, body in enumerate([{"data": {"rows": [{"id": 1, "name": {"a": 1}, "size": "x"}, {"id": "2", "size": 3, "more": 1}]}}, {"data": {"rows": [{"id": 2.0, "name": None}, 7]}}, {"data": {}}]):
        os.makedirs(tmp_path / f"page={i}")
        (tmp_path / f"page={i}" / "x.json").write_text(json.dumps(body))
    df = paged.pages(spark, str(tmp_path), SCHEMA, 2)
    assert rows(df) == [(1, '{"a": 1}', None), (2, None, 3), (2, None, None)]
    reader = paged.PagedReader(df.schema, {"path": str(tmp_path), "limit": "2"})
    left = list(reader.pushFilters([paged.ds.EqualTo(("size",), 3), paged.ds.StringContains(("name",), "a"), paged.ds.GreaterThan(("nested", "x"), 1)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "GreaterThan"] and [r.num_rows for p in reader.partitions() for r in reader.read(p)] == [1, 0, 0]
    with pytest.raises(Exception, match="over the limit"):
        paged.pages(spark, str(tmp_path), SCHEMA, 1).collect()


def test_page_counts(spark, tmp_path):
    for i, (n, total) in enumerate([(3, 7), (2, 7), (2, 7)]):
        os.makedirs(tmp_path / f"page={i}")
        (tmp_path / f"page={i}" / "x.json").write_text(json.dumps({"data": {"rows": [{}] * n, "total": total}}))
    got = {r.page: (r.n, r.stated, r.fits) for r in paged.page_counts(spark, str(tmp_path), 3).collect()}
    assert got == {0: (3, 7, True), 1: (2, 7, False), 2: (2, 7, True)}


def test_latest_release():
    assert feeds.latest_release('{"releases": ["2024-01-05.0", "2024-11-02.1", "2023-12-31.0"]}') == "2024-11-02.1"
    assert feeds.latest_release("", "mine") == "mine"


def test_versions_of_a_table(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 8)
    assert table.version() == 0 and table.read().count() == 0
    first = spark.createDataFrame([(i, f"a{i}", i) for i in range(40)], SCHEMA)
    assert table.upsert(first, POLICIES, name="w", number=1) == 1
    second = spark.createDataFrame([(3, None, 300), (100, "new", 1)], SCHEMA)
    before = table.manifest()["buckets"]
    assert table.upsert(second, POLICIES, name="w", number=2) == 2
    after = table.manifest()["buckets"]
    assert sum(before.get(b) != f for b, f in after.items()) <= 2  # only touched buckets are written
    assert rows(table.read(1)) == rows(first)
    assert rows(table.read()) == rows(first.where("id <> 3").union(spark.createDataFrame([(3, "a3", 300), (100, "new", 1)], SCHEMA)))
    assert table.upsert(second, POLICIES, name="w", number=2) == 2  # a step that ran already
    assert table.manifest()["counters"] == {"w": {"inserted": 41, "updated": 1, "unchanged": 0}}

    def die():
        raise RuntimeError("dies before the commit")

    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(3, "x", 1)], SCHEMA), POLICIES, name="w", number=3, before_commit=die)
    assert table.version() == 2 and table.read().where("id = 3").first().size == 300
    other = versioned.VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 8)
    with pytest.raises(versioned.AlreadyCommitted):  # another writer is quicker
        table.upsert(second, POLICIES, before_commit=lambda: other.upsert(first, POLICIES))
    assert table.version() == 3 and rows(table.read(2)) != rows(table.read())
    with pytest.raises(ValueError, match="keys repeat"):
        table.upsert(second.union(second), POLICIES)
    assert table.upsert(second.limit(0), POLICIES) == 4 and rows(table.read()) == rows(table.read(3))


def test_import_resumes_where_it_died(spark, tmp_path):
    source = spark.range(95).select(F.col("id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(1).alias("size"))
    numbered = keys.numbered(source, [F.asc("name")])
    assert sorted(r.row_number for r in numbered.collect()) == list(range(95))
    assert [r.id for r in numbered.orderBy("row_number").collect()] == [r.id for r in source.orderBy("name").collect()]
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4)
    calls = []

    def die():
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("dies in the third step")

    with pytest.raises(RuntimeError):
        versioned.import_rows(numbered, table, POLICIES, "feed", 20, before_commit=die)
    state = table.manifest()
    assert state["positions"] == {"feed": 40} and state["counters"]["feed"]["inserted"] == 40 == table.read().count()
    assert versioned.import_rows(numbered, table, POLICIES, "feed", 20) == {"inserted": 95, "updated": 0, "unchanged": 0}
    assert rows(table.read()) == rows(source)
    assert versioned.import_rows(numbered, table, POLICIES, "feed", 20)["inserted"] == 95 and table.version() == 5
    assert versioned.import_rows(numbered.limit(0), table, POLICIES, "none", 20) == {"inserted": 0, "updated": 0, "unchanged": 0}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rest = keys.resume(source, [F.asc("id")], 30)
    assert sorted(r.id for r in rest.collect()) == list(range(30, 95)) and rest.rdd.getNumPartitions() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lease(spark, tmp_path):
    now = [100.0]
    lease = runs.Lease(spark, str(tmp_path / "l"), 10, lambda: now[0])
    assert lease.take("a") and lease.take("a") and not lease.take("b")
    now[0] = 111
    assert lease.take("b") and not lease.take("a")
    lease.end("a")
    assert not lease.take("a")
    lease.end("b")
    assert lease.take("a")


def test_a_run_that_dies_goes_on(spark, tmp_path):
    """Three files, a micro-batch each; the second one's publication dies behind its data, before its manifest."""
    for i in range(3):
        spark.createDataFrame([(k, f"f{i}", i) for k in range(i * 10, i * 10 + 15)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4)
    lease = runs.Lease(spark, str(tmp_path / "lease"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    done = []

    def dies(batch, batch_id):
        if batch_id == 1 and not done:
            done.append(1)
            table.upsert(batch, POLICIES, name="s", number=batch_id, before_commit=lambda: 1 / 0)
        table.sink(POLICIES, "s")(batch, batch_id)

    with pytest.raises(Exception, match="division by zero"):
        runs.run_due(stream(), dies, str(tmp_path / "c"), lease, "first")
    assert table.version() == 1
    assert lease.take("other") and not runs.run_due(stream(), dies, str(tmp_path / "c"), lease, "second")
    lease.end("other")
    assert runs.run_due(stream(), dies, str(tmp_path / "c"), lease, "second")
    got = {r.id: r.name for r in table.read().collect()}
    assert set(got) == set(range(35)) and table.version() == 3
    assert table.manifest()["counters"]["s"] == {"inserted": 35, "updated": 10, "unchanged": 0}
    assert runs.run_due(stream(), dies, str(tmp_path / "c"), lease, "third") and table.version() == 3
