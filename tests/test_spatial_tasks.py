"""Pairs of points, scan lines and matches on crowded tables: how the work is dealt, and the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.functions import geo
from cairnlake.operators import entity, raster, spatial


def points(spark, n, key, prefix="", spread=1.0):
    rng = np.random.default_rng(n)
    rows = [(int(i), float(rng.random() * spread + 40), float(rng.random() * spread - 100)) for i in range(n)]
    return spark.createDataFrame(rows, f"{key} long, {prefix}lat double, {prefix}lon double")


@pytest.fixture
def stored(monkeypatch):
    """Numbers of rows of everything that the spatial operators store."""
    counts = []
    real = spatial.checkpoint

    def counted(df):
        out = real(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(spatial, "checkpoint", counted)
    return counts


def test_radius_join_broadcasts_nothing_and_deals_by_pairs(spark, monkeypatch, capsys):
    a, b = points(spark, 400, "id"), points(spark, 401, "r_id", "r_")
    monkeypatch.setattr(spatial, "TASK_PAIRS", 1000, raising=False)
    found = spatial.radius_join(a, b, 30_000)
    found.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert found.rdd.getNumPartitions() > 20
    want = a.crossJoin(b).where(geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 30_000).count()
    assert found.count() == want


def test_nearest_in_radius_tries_short_distances(spark, stored, monkeypatch):
    monkeypatch.setattr(spatial, "PIECE_PAIRS", 1 << 8)
    a, b = points(spark, 300, "id", spread=4.0), points(spark, 900, "r_id", "r_", 1.5)
    tried = []
    real = geo.haversine
    pairs = a.crossJoin(b).withColumn("m", real(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).where("m <= 300000").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r.m, r.r_id)):
        want.setdefault(r.id, []).append(r.r_id)
    if hasattr(spatial, "_paired"):
        inner = spatial._paired
        monkeypatch.setattr(spatial, "_paired", lambda left, right, metres, *a, **k: (tried.append(metres), inner(left, right, metres, *a, **k))[1])
    got = {}
    for r in sorted(spatial.nearest_in_radius(a, b, "id", "r_id", 300_000, 2).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.r_id)
    assert got == {k: v[:2] for k, v in want.items()}
    assert len(tried) > 1 and tried[-1] == 300_000


def test_suppress_stores_no_pairs_of_a_crowd(spark, stored, monkeypatch):
    monkeypatch.setattr(spatial, "PIECE_PAIRS", 1 << 30)
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 2), float(rng.integers(0, 40)), float(40 + rng.random() * 3), float(-100 + rng.random() * 3)) for i in range(1500)] + [(9000, None, 1.0, 41.0, -99.0), (9001, 1, None, 41.0, -99.0), (9002, 1, 50.0, None, -99.0)]
    df = spark.createDataFrame(rows, "id long, g int, rank double, lat double, lon double")
    got = {r.id for r in spatial.suppress(df, "g", "rank", "id", 120_000).collect()}
    kept = []
    far = lambda p, q: 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.sin(np.radians(q[3] - p[3]) / 2) ** 2 + np.cos(np.radians(p[3])) * np.cos(np.radians(q[3])) * np.sin(np.radians(q[4] - p[4]) / 2) ** 2)) > 120_000
    for p in sorted((r for r in rows if r[0] < 9000), key=lambda r: (-r[2], r[0])):
        if all(far(p, q) for q in kept if q[1] == p[1]):
            kept.append(p)
    assert got == {p[0] for p in kept} | {9000, 9001, 9002}
    assert max(stored) < 1 << 16  # pairs of neighbours are some 200,000


def test_geodesic_runs_over_batches(spark):
    b = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (10.0, 20.0, 10.0, 20.0), (None, 0.0, 1.0, 1.0), (0.0, -179.9, 0.0, 179.9)], "a double, b double, c double, d double")
    plan = b.select(geo.geodesic(*(F.col(c) for c in "abcd")).alias("m"))
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    assert [None if r.m is None else round(r.m, 2) for r in plan.collect()] == [None, 0.0, None, 22263.9]


def test_scan_lines_of_a_batch_are_those_of_each_shape(spark, monkeypatch):
    rng = np.random.default_rng(5)
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    shapes = [(0, [square, [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]]), (1, None), (2, [[[0.0, 0.0]]]), (3, [square, square])]
    shapes += [(i, [(rng.random((7, 2)) * 9 - 4).tolist()]) for i in range(4, 40)]
    df = spark.createDataFrame(shapes, "k long, rings array<array<array<double>>>")
    want = set()
    for k, value in shapes:
        rings = raster._rings(value)
        for row in range(-12, 12):
            xs = raster.crossings(rings, (row + 0.5) * 0.5)
            want |= {(k, row, col) for col in range(-12, 12) if np.count_nonzero(xs <= (col + 0.5) * 0.5) % 2}
    for scanned in (1 << 18, 16):
        monkeypatch.setattr(raster, "SCANNED", scanned, raising=False)
        found = raster.spans(df, "k", "rings", 0.5)
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = found.collect()
        assert {(r.k, r.row, c) for r in rows for c in range(r.low, r.high + 1)} == want
        assert len({(r.k, r.row, r.low) for r in rows} & {(r.k, r.row, r.high + 1) for r in rows}) == 0
    assert hasattr(raster, "SPANS")


def test_equal_scores_go_to_the_nearest_then_to_the_most_evidence(spark):
    rows = [(1, 10, 1.0, 1.1, 5.0), (1, 11, 1.0, 1.6, 5.0), (1, 12, 1.0, 1.7, 9.0), (2, 10, 0.5, 0.5, 1.0)]
    got = entity.best_matches(spark.createDataFrame(rows, "i long, c long, score double, evidence double, distance_m double"), "i", "c").collect()
    assert {(r.i, r.c) for r in got} == {(1, 11), (2, 10)}


def test_match_points_are_added_one_after_the_other(spark):
    def record(side, **more):
        one = {"name": "Pine Lake", "website": None, "phone": None, "address": None, "operator": None, "parent": None, "region": "wa", "country": "US"} | more
        return {f"{side}_{k}": v for k, v in one.items()}

    for given in (i / 20 for i in range(21)):
        for metres in (i * 130.0 for i in range(47)):
            want = given * 0.45 + max(0.0, 1 - metres / 5000) * 0.25 + 0.5 + 0.15 + 0.08 - 0.25
            if abs(want - 0.9) < 1e-9:
                break
        else:
            continue
        break
    row = record("i", name="Aa", website="https://a.example/x", address="1 Long Road", operator="Parks", region="wa") | record("c", name="Bb", website="https://a.example/y", address="1, long road", operator="parks", region="or")
    schema = ", ".join(f"{k} string" for k in row) + ", name_similarity double, distance_m double"
    rows = [(*row.values(), g / 20, m * 130.0) for g in range(21) for m in range(47)]
    for r in entity.score_match(spark.createDataFrame(rows, schema)).collect():
        exact = r.name_similarity * 0.45 + max(0.0, 1 - r.distance_m / 5000) * 0.25 + 0.5 + 0.15 + 0.08 - 0.25
        assert r.score == max(0.0, min(1.0, exact))
