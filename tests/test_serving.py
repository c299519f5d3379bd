"""Serving and maintenance queries on small cases."""

from pyspark.sql import functions as F

from cairnlake.plans import serving


def test_uploads_and_fallback(spark):
    old = spark.createDataFrame([(1, "Bear Lake", 45.0, -120.0), (2, "Pine", 46.0, -121.0)], "id long, name string, lat double, lon double")
    rows = spark.createDataFrame([(2, "bear lake", 10.0, 10.0), (3, "Other", 46.001, -121.0), (4, "None", 0.5, 0.5)], "row_number int, name string, lat double, lon double")
    assert {r.row_number: r.duplicate_of for r in serving.upload_duplicates(rows, old).collect()} == {2: 1, 3: 2, 4: None}
    cached = spark.createDataFrame([(9, 45.0, -121.0, 0.9)], "r_id long, r_lat double, r_lon double, completeness double")
    got = serving.weather_fallback(old.select("id", "lat", "lon"), cached).collect()
    assert {r.id for r in got} == {1, 2} and all(0.45 <= r.completeness < 0.9 for r in got)


def test_maintenance(spark):
    c = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "id long, quality int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "left_id long, right_id long")
    assert sorted(r.id for r in serving.hold_back(c, pairs).collect()) == [2, 4]
    df = spark.createDataFrame([(1, "US", 45.0, 120.0, "Unknown", None, True, 0), (2, "US", 0.0, 0.0, "X", None, True, 0), (3, "US", 45.0, -120.0, "Unknown", ["city"], True, 0)], "id long, country string, lat double, lon double, city string, locks array<string>, active boolean, reports int")
    best = spark.createDataFrame([(1, "near Bend"), (3, "Y")], "id long, city string")
    got = {r.id: (r.lon, r.city, r.active) for r in serving.repair_places(df, best).collect()}
    assert got == {1: (-120.0, "Bend", True), 2: (0.0, "X", False), 3: (-120.0, "Unknown", True)}
    runs = spark.createDataFrame([("a", "running", "2024-01-01 00:00:00", []), ("b", "published", "2024-01-01 00:00:00", [])], "run_id string, status string, t string, errors array<string>").withColumn("updated_at", F.to_timestamp("t"))
    closed = {r.run_id: (r.status, r.errors) for r in serving.close_runs(runs, "2024-01-01 00:06:00").collect()}
    assert closed == {"a": ("partial", ["interrupted"]), "b": ("published", [])}
    assert {r.run_id: r.status for r in serving.finish_run(runs, "b", "failed").collect()}["b"] == "published"
    places = spark.createDataFrame([(1, "A", ["x"], {"_": 10})], "id long, name string, locks array<string>, priorities map<string,int>")
    edited = serving.manual_edit(places, spark.createDataFrame([(1, "B")], "id long, name string"), ["name"]).first()
    assert (edited.name, edited.locks, edited.priorities) == ("B", ["name", "x"], {"_": 10, "name": 100})


def test_suggestions_and_map(spark):
    df = spark.createDataFrame([(1, "Lake", 1.0, 1.0), (2, "Big Lake", 1.0, 1.0), (3, "Lakeside", 1.0, 1.0), (4, "Hill", 1.0, 1.0)], "id long, name string, lat double, lon double")
    assert [r.name for r in serving.suggestions(df, "id", "name", "lake").collect()] == ["Lake", "Lakeside", "Big Lake"]
    assert [r.kind for r in serving.map_features(df, "id", 5).collect()] == ["cluster"]
    assert serving.map_features(df, "id", 12, (0, 0, 2, 2)).count() == 4 and serving.map_features(df, "id", 12).count() == 0
