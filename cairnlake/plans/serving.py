"""Serving and maintenance queries: map features, suggestions, upload duplicates, fallbacks, repairs, run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import keys, merge, spatial


def map_features(df: DataFrame, key: str, zoom: float, box: tuple[float, float, float, float] | None = None, search: str | None = None, name: str = "name") -> DataFrame:
    """Clusters and points at low zoom without a search; else up to 250 or 100 rows of the box, or none without both."""
    if zoom <= 8 and not search:
        return spatial.grid_clusters(df, key, geo.cluster_degrees(zoom)).orderBy(F.desc("n"), "cx", "cy", key).limit(5000)
    if box is None and not search:
        return df.limit(0)
    df = keys.optional(df, (search, F.col(name).ilike(f"%{search}%")))
    if box is not None:
        df = df.where(geo.in_box(F.col("lon"), F.col("lat"), *box))
    return df.orderBy(name, key).limit(100 if search else 250)


def suggestions(df: DataFrame, key: str, name: str, typed: str, n: int = 8) -> DataFrame:
    """Names that contain what was typed: those that begin with it first, then the most alike."""
    alike = text.set_similarity(text.trigrams(F.col(name)), text.trigrams(F.lit(typed)))
    starts = F.when(F.col(name).ilike(f"{typed}%"), 0).otherwise(1)
    return df.where(F.col(name).ilike(f"%{typed}%")).select(key, name, starts.alias("starts"), F.round(alike, 6).alias("similarity")).orderBy("starts", F.desc("similarity"), name, key).limit(n)


def upload_duplicates(rows: DataFrame, existing: DataFrame, metres: float = 350.0) -> DataFrame:
    """The first existing entity, by id, with the same name or within the distance, of each uploaded row.

    Two joins on keys, by name and by cell, instead of one join on either condition.
    """
    old = existing.select(F.col("id").alias("existing_id"), F.lower("name").alias("low"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    named = rows.select("row_number", F.lower("name").alias("low")).join(old, "low").select("row_number", "existing_id")
    near = spatial.radius_join(rows.select("row_number", "lat", "lon"), old, metres).select("row_number", "existing_id")
    first = named.unionByName(near).groupBy("row_number").agg(F.min("existing_id").alias("duplicate_of"))
    return rows.join(first, "row_number", "left")


def weather_fallback(entities: DataFrame, cached: DataFrame, metres: float = 500_000.0) -> DataFrame:
    """The nearest cached weather of each entity within the distance; completeness falls with it, to a half at most."""
    found = spatial.nearest_in_radius(entities, cached, "id", "r_id", metres, 1)
    less = F.greatest(F.lit(0.5), 1 - F.col("distance_m") / 1_000_000)
    return found.withColumn("completeness", F.col("completeness") * less).drop("rank")


def hold_back(candidates: DataFrame, duplicates: DataFrame, quality: str = "quality") -> DataFrame:
    """Candidates for publication without those that a better record of a duplicate pair (left_id, right_id) beats."""
    q = candidates.select("id", quality)
    pairs = duplicates.select("left_id", "right_id").unionByName(duplicates.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    rivals = pairs.join(q.select(F.col("id").alias("left_id"), F.col(quality).alias("ql")), "left_id").join(q.select(F.col("id").alias("right_id"), F.col(quality).alias("qr")), "right_id")
    beaten = rivals.where((F.col("qr") > F.col("ql")) | ((F.col("qr") == F.col("ql")) & (F.col("right_id") < F.col("left_id")))).select(F.col("left_id").alias("id"))
    return merge.delete_matching(candidates, beaten, ["id"])


def repair_places(df: DataFrame, best: DataFrame) -> DataFrame:
    """Turn longitudes of American rows that lost their sign, take (0, 0) rows without reports out of use, and fill
    an unknown city from the best source (id, city) unless it is locked."""
    lon = F.when(F.col("country").isin("US", "CA") & (F.col("lon") > 0), -F.col("lon")).otherwise(F.col("lon"))
    nowhere = (F.col("lat") == 0) & (F.col("lon") == 0) & (F.coalesce("reports", F.lit(0)) == 0)
    open_field = ~F.coalesce(F.array_contains("locks", "city"), F.lit(False)) & ~merge.usable(F.col("city"))
    out = df.join(best.select("id", F.col("city").alias("__city")), "id", "left")
    out = out.withColumn("active", F.col("active") & ~nowhere).withColumn("lon", lon)
    return out.withColumn("city", F.when(open_field & F.col("__city").isNotNull(), F.regexp_replace("__city", r"(?i)^near\s+", "")).otherwise(F.col("city"))).drop("__city")


def close_runs(runs: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Runs that still say ``running`` so long after their last sign become ``partial``, with a note; others stay.

    A published run never changes.
    """
    stale = (F.col("status") == "running") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return runs.withColumn("errors", F.when(stale, F.array_append("errors", F.lit("interrupted"))).otherwise(F.col("errors"))).withColumn("status", F.when(stale, "partial").otherwise(F.col("status")))


def finish_run(runs: DataFrame, run_id: str, status: str) -> DataFrame:
    return runs.withColumn("status", F.when((F.col("run_id") == run_id) & (F.col("status") != "published"), status).otherwise(F.col("status")))


def manual_edit(df: DataFrame, edits: DataFrame, fields: list[str], priority: int = 100) -> DataFrame:
    """Replace the fields that an edit (id and nullable fields) gives, lock them, and note their new priority.

    A field's older priority goes; a null map is an empty one.
    """
    given = lambda f: F.col(f"__{f}").isNotNull()
    out = df.join(edits.select("id", *(F.col(f).alias(f"__{f}") for f in fields)), "id", "left")
    new = F.array_compact(F.array(*(F.when(given(f), F.lit(f)) for f in fields)))
    locks = F.array_sort(F.array_union(F.coalesce("locks", F.array().cast("array<string>")), new))
    others = F.map_filter(F.coalesce("priorities", F.create_map().cast("map<string,int>")), lambda k, _: ~F.array_contains(new, k))
    noted = F.map_concat(others, F.map_from_arrays(new, F.transform(new, lambda _: F.lit(priority))))
    out = out.withColumn("locks", locks).withColumn("priorities", noted)
    for f in fields:
        out = out.withColumn(f, F.when(given(f), F.col(f"__{f}")).otherwise(F.col(f)))
    return out.drop(*(f"__{f}" for f in fields))
