"""Resolution of duplicate records from blocking to survivors, and of incoming records against canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import entity, graph, spatial
from ..operators.jobs import checkpoint, spread

FIELDS = ("name", "website_id", "phone", "address_id", "region", "lat", "lon", "quality")


def prepared(df: DataFrame) -> DataFrame:
    """Normal forms of a table with id, name, website, phone, address, city, region, country, lat, lon, and
    verification, priority, sources, reports.  Stored, since pairs look at each record from several sides, and spread, since their texts and
    the cells around each record take longer than their bytes tell."""
    c = F.col
    return checkpoint(spread(df).select(
        "id", "name", entity.name_words(c("name")).alias("words"), text.name_tokens(c("name")).alias("tokens"), text.website_identity(c("website")).alias("website_id"), text.phone(c("phone")).alias("phone"),
        text.normal_address(c("address"), c("city"), c("region"), c("country")).alias("address_id"), "region", "country", "lat", "lon",
        entity.record_quality(c("verification"), c("priority"), c("sources"), c("reports"), c("website"), c("address")).alias("quality"),
    ))


def duplicate_pairs(records: DataFrame, metres: float = 2000.0) -> DataFrame:
    """Scored candidate pairs of prepared records of one country."""
    fields = [*FIELDS, *(f for f in ("words", "tokens") if f in records.columns)]
    near = entity.nearby_pairs(records, "id", metres).select("left_id", "right_id")
    pairs = near.unionByName(entity.identity_pairs(records, "id", ("website_id", "phone", "address_id"))).distinct()
    side = lambda s: records.select(F.col("id").alias(f"{'left' if s == 'l' else 'right'}_id"), F.col("country").alias(f"{s}_country"), *(F.col(f).alias(f"{s}_{f}") for f in fields))
    joined = pairs.join(side("l"), "left_id").join(side("r"), "right_id").where("l_country = r_country")
    return entity.score_pairs(joined, metres)


def merge_plan(records: DataFrame, scored: DataFrame) -> DataFrame:
    """node, component and survivor for records that automatic pairs tie together."""
    automatic = scored.where("recommendation = 'automatic'").select("left_id", "right_id")
    return graph.survivors(records, graph.connected_components(automatic, "left_id", "right_id"), "id", "quality")


def match_incoming(incoming: DataFrame, canonical: DataFrame, metres: float = 50_000.0, nearest: int = 25) -> DataFrame:
    """The best canonical record of each incoming one, with score and decision; unmatched ones are ``new``.

    Incoming records that nothing matches may be the same among themselves: pass them to duplicate_pairs().
    """
    left = incoming.select(*(F.col(c).alias(f"i_{c}") for c in incoming.columns))
    right = canonical.select(*(F.col(c).alias(f"c_{c}") for c in canonical.columns))
    near = spatial.nearest_in_radius(left, right, "i_id", "c_id", metres, nearest, lat="i_lat", lon="i_lon", right_lat="c_lat", right_lon="c_lon")
    similar = near.withColumn("name_similarity", text.set_similarity(text.trigrams(text.normal_name(F.col("i_name"))), text.trigrams(text.normal_name(F.col("c_name")))))
    best = entity.best_matches(entity.score_match(similar), "i_id", "c_id").select("i_id", "c_id", "score", "decision")
    return checkpoint(left.select("i_id").join(best, "i_id", "left").withColumn("decision", F.coalesce("decision", F.lit("new"))))
