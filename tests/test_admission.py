"""Admission of events under limits, against telling them one by one; as a table and as a stream."""

import datetime as dt

import numpy as np
import pytest

from cairnlake.streaming import admission
from cairnlake.streaming.admission import DAY, HOUR, Limit

SCHEMA = "event_id long, ts timestamp, place string, account string, token long, ip string"
START = dt.datetime(2024, 1, 1)


def brute(rows, limits):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    taken, out = [], []
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        row = dict(zip(names, r, strict=True))

        def full(limit, row=row):
            own = [row[c] for c in limit.columns]
            if None in own:
                return False
            same = [t for t in taken if [t[c] for c in limit.columns] == own and (row["ts"] - t["ts"]).total_seconds() <= limit.seconds]
            return len(same) >= limit.most

        if not any(full(limit) for limit in limits):
            taken.append(row)
            out.append(r[0])
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(700):
        at = START + dt.timedelta(seconds=int(rng.integers(0, 12 * DAY) // 1800 * 1800))
        pick = lambda n, share: str(rng.integers(n)) if rng.random() < share else None
        token = pick(40, 0.4)
        out.append((i, at, pick(3, 0.97), pick(25, 0.5), None if token is None else int(token), "hot" if i % 3 == 0 else pick(30, 0.9)))
    out += [(1000, START, "p", None, None, None), (1001, START, "p", None, None, None), (1002, None, "p", "a", 1, "x"), (1003, START, "1", "2|3", None, None), (1004, START, "1", "2", 3, None)]
    return out


LIMITS = {
    "any": admission.any_identity("place", ["account", "token", "ip"]),
    "rates": [Limit(("ip",), HOUR, 2), Limit(("ip",), DAY, 5), Limit(("account",), DAY, 3)],
    "one": [Limit(("ip",), DAY, 2)],
}


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_against_brute_force(spark, rows, name):
    df = spark.createDataFrame(rows, SCHEMA)
    got = admission.admitted(df, LIMITS[name], "ts", "event_id")
    assert got.columns == df.columns
    assert sorted(r.event_id for r in got.collect()) == brute(rows, LIMITS[name])
    assert admission.admitted(df.limit(0), LIMITS[name], "ts", "event_id").count() == 0


def test_both_ends_count(spark):
    at = [START, START + dt.timedelta(days=1), START + dt.timedelta(days=1, microseconds=1), START + dt.timedelta(days=3)]
    df = spark.createDataFrame([(i, t, "p", "a", None, None) for i, t in enumerate(at)], SCHEMA)
    assert sorted(r.event_id for r in admission.admitted(df, LIMITS["any"], "ts", "event_id").collect()) == [0, 2, 3]


@pytest.mark.parametrize("name", ["any", "rates"])
def test_stream_is_the_batch(spark, rows, name, tmp_path):
    """A file a micro-batch, in order of time; a batch that runs again changes nothing."""
    timed = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    edges = [i for i in range(1, len(timed)) if timed[i][1] != timed[i - 1][1]]
    cuts = [0, *edges[len(edges) // 3 :: len(edges) // 3][:2], len(timed)]
    parts = [spark.createDataFrame(timed[a:b], SCHEMA) for a, b in zip(cuts, cuts[1:], strict=False)]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    run = admission.admit_into(str(tmp_path / "state"), LIMITS[name], "ts", "event_id")
    for i in range(len(parts)):  # each folder is a source's next file
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / f"{i}"))
        query = stream.writeStream.foreachBatch(lambda df, _, i=i: run(df, i)).option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        query.awaitTermination()
    told = lambda: sorted(r.event_id for r in admission.accepted(spark, str(tmp_path / "state"), SCHEMA).collect())
    want = brute(rows, LIMITS[name])
    assert told() == want
    run(parts[1], 1)
    assert told() == want
    run(parts[0].limit(0), 9)
    assert told() == want


def test_a_hot_identity_is_cut_where_nothing_reaches(spark):
    """Chains of one address end at gaps longer than the longest limit, so they are several groups."""
    df = spark.createDataFrame([(i, START + dt.timedelta(days=3 * (i // 5), hours=i % 5), "p", None, None, "hot") for i in range(60)], SCHEMA)
    names = admission.F.array(admission._value(("ip",), 0))
    named = df.select("event_id", admission.F.unix_micros("ts").alias("__us"), names.alias("__names"))
    assert admission._chains(named, 1, DAY).select("__chain").distinct().count() == 12


def test_a_long_chain_is_dealt_as_blocks(spark):
    """The task that walks a chain gets a row for each batch of its events, in order; ties of time go by event_id."""
    df = spark.createDataFrame([(i, START + dt.timedelta(minutes=i // 3), "p", None, None, "hot") for i in range(30_000)], SCHEMA)
    rows = df.select(admission.F.struct("*").alias("row"), admission.F.unix_micros("ts").alias("__us"), admission.F.array("ip").alias("__names"), admission.F.lit(False).alias("__seed"), admission.F.lit("c").alias("__chain"))
    blocks = admission._blocks(rows.repartition(5), "event_id", 4)
    assert blocks.count() <= 20 and blocks.select("__bucket").distinct().count() == 1
    table = blocks.coalesce(1).sortWithinPartitions("__at").toArrow()
    events = [x for batch in admission._events(iter(table.to_batches())) for x in batch.column("row").to_pylist()]
    assert [x["event_id"] for x in events] == list(range(30_000))
    assert admission.admitted(df, LIMITS["one"], "ts", "event_id").count() == len(brute_one(range(30_000)))


def brute_one(ids):
    taken = []
    for i in ids:
        if sum(60 * (i // 3 - t // 3) <= DAY for t in taken[-2:]) < 2:
            taken.append(i)
    return taken
