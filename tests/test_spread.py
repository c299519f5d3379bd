"""Queries whose rows take long to work on are dealt by rows, not by their few bytes."""

import json

import pytest

from cairnlake.plans import resolve
from cairnlake.queries import QUERIES, entities
from cairnlake.sources import paged


SF = "/root/testdata/sf0.001"


def tasks(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["localities", "environmental_index"])
def test_small_tables_are_many_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == tasks(spark) > 1


def test_pages_are_read_several_to_a_task(spark, tmp_path):
    folder = tmp_path / "page=0"
    folder.mkdir()
    (folder / "x").write_text(json.dumps({"data": {"rows": [], "total": 72_000 * 100 - 3}}))
    df = paged.pages(spark, str(tmp_path), "id long", 100)
    runs = paged.PagedReader(df.schema, {"path": str(tmp_path), "limit": "100"}).partitions()
    assert len(runs) <= paged.PARTITIONS
    assert [n for run in runs for n in range(run.first, run.end)] == list(range(72_000))


def test_pages_are_written_by_many_tasks(spark, tmp_path):
    """Each task names the files that it writes, and commits them itself."""
    df = spark.range(400).repartition(1)
    paged.land(df, str(tmp_path / "p"), [df["id"].asc()], 5)
    wrote = {f.name.split("-")[1] for f in (tmp_path / "p").rglob("part-*")}
    assert len(wrote) == tasks(spark)
    got = paged.pages(spark, str(tmp_path / "p"), "id long", 5)
    assert sorted(r.id for r in got.collect()) == list(range(400))


def test_records_are_prepared_once_and_in_many_tasks(spark):
    """Words and tokens of names are columns of the records, and no pair makes them again."""
    records = resolve.prepared(entities.places(spark, SF))
    assert records.rdd.getNumPartitions() == tasks(spark)
    scored = resolve.duplicate_pairs(records)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and {"words", "tokens"} <= set(records.columns)
    without = resolve.duplicate_pairs(records.drop("words", "tokens"))
    cols = ["left_id", "right_id", "score", "recommendation"]
    assert sorted(map(tuple, scored.select(cols).collect())) == sorted(map(tuple, without.select(cols).collect()))
