"""Entity resolution: candidate pairs by blocking, pair scores, survivors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from . import spatial
from .jobs import checkpoint

# Fixed values of the pair rules.
MOST_IN_BUCKET = 50
AUTOMATIC, REVIEW = 0.90, 0.62
SHARED_DOMAINS = ("bcparks.ca", "koa.com", "nps.gov", "recreation.gov", "sitesandtrailsbc.ca")
QUALIFIERS = (
    "buoy", "cabin", "cabins", "corral", "day", "equestrian", "group", "horse", "loop", "marina", "mooring", "picnic", "ranger",
    "service", "shelter", "station", "stock", "visitor", "youth",
)
OPPOSITES = (("upper", "lower"), ("east", "west"), ("north", "south"))
# Of a pair: points of the name and of shared identities, of the distance up to so many metres, and of regions that differ.
PAIR_POINTS = {"name": 0.55, "website": 0.45, "address": 0.35, "phone": 0.3, "region": -0.25}
PAIR_METRES = ((75, 0.35), (350, 0.25), (1000, 0.14))
PAIR_NEAR = 0.08
# Of an incoming record and a canonical one: the same, the distance counting less up to 5 km.
MATCH_POINTS = {"name": 0.45, "distance": 0.25, "website": 0.5, "phone": 0.5, "address": 0.15, "close": 0.25, "operator": 0.08, "parent": 0.08, "region": -0.25}
SUBFACILITIES = ("cabin", "cabins", "campsite", "campsites", "group", "lot", "loop")


def identity_pairs(df: DataFrame, key: str, identities: Sequence[str], most: int = MOST_IN_BUCKET) -> DataFrame:
    """Pairs of keys (left_id < right_id) that share the value of an identity column.

    Values with more than ``most`` rows say nothing and are skipped by rule, which also bounds the pairs.
    """
    out = None
    for column in identities:
        rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).cast("string").alias("v"))
        sizes = rows.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("v")
        kept = rows.join(sizes, "v", "left_semi")
        pairs = kept.select(F.col("k").alias("left_id"), "v").join(kept.select(F.col("k").alias("right_id"), "v"), "v").where("left_id < right_id").drop("v")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def nearby_pairs(df: DataFrame, key: str, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of keys (left_id < right_id) within a distance, by grid cells."""
    a = df.select(F.col(key).alias("left_id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    b = df.select(F.col(key).alias("right_id"), F.col(lat).alias("r_lat"), F.col(lon).alias("r_lon"))
    return spatial.radius_join(a, b, metres).where("left_id < right_id").select("left_id", "right_id", "distance_m")


def name_words(name: Column) -> Column:
    """The different words of a name."""
    return F.array_distinct(F.filter(F.split(text.fold(name), "[^a-z0-9]+"), lambda w: w != ""))


def facility_conflict(left: Column, right: Column) -> Column:
    """Names that tell two facilities apart: qualifiers or numbers that only one has, or opposite directions."""
    return words_conflict(name_words(left), name_words(right))


def words_conflict(a: Column, b: Column) -> Column:
    """facility_conflict() of names by their words, which stand in it many times: where pairs are many, let them be columns."""
    only = lambda x, y, among: F.exists(F.array_except(x, y), lambda w: w.isin(*among))
    conflict = only(a, b, QUALIFIERS) | only(b, a, QUALIFIERS)
    for first, second in OPPOSITES:
        conflict = conflict | (F.array_contains(a, first) & F.array_contains(b, second)) | (F.array_contains(a, second) & F.array_contains(b, first))
    shared = F.exists(F.array_intersect(a, b), lambda w: w.isin(*SUBFACILITIES))
    specific = lambda x, y: F.exists(F.array_except(x, y), lambda w: ~w.isin(*QUALIFIERS, "camp", "campground", "campgrounds"))
    numbers = lambda x: F.filter(x, lambda w: w.rlike(r"^\d+$"))
    na, nb = numbers(a), numbers(b)
    differing = (F.size(na) > 0) & (F.size(nb) > 0) & ((F.size(F.array_except(na, nb)) > 0) | (F.size(F.array_except(nb, na)) > 0))
    return conflict | (shared & specific(a, b) & specific(b, a)) | differing


def record_quality(verification: Column, priority: Column, sources: Column, reports: Column, website: Column, address: Column) -> Column:
    rank = F.when(verification == "manually_verified", 300).when(verification == "owner_verified", 250).when(verification == "source_verified", 200).otherwise(0)
    named = address.isNotNull() & ~F.lower(address).isin(*text.PLACEHOLDER_ADDRESSES)
    return rank + priority * 3 + sources * 10 + reports * 5 + F.when(F.coalesce(website, F.lit("")) != "", 4).otherwise(0) + F.when(named, 2).otherwise(0)


def score_pairs(pairs: DataFrame, near_m: float = 2000.0) -> DataFrame:
    """Score pairs of rows with columns l_* and r_*: name, website_id, phone, address_id, region, lat, lon; perhaps words and
    tokens, the name's name_words() and name_tokens(), which are made for each pair where they are missing.

    Keeps admitted pairs with score, distance_m, name_similarity, recommendation (automatic or review).
    """
    c = F.col
    same = lambda name: F.coalesce(c(f"l_{name}") == c(f"r_{name}"), F.lit(False))
    web, phone, address = same("website_id"), same("phone"), same("address_id")
    distance = geo.haversine(c("l_lat"), c("l_lon"), c("r_lat"), c("r_lon"))
    words, tokens = (
        [c(f"{s}_{of}") if f"{s}_{of}" in pairs.columns else make(c(f"{s}_name")) for s in "lr"] for of, make in (("words", name_words), ("tokens", text.name_tokens))
    )
    base = pairs.where(~words_conflict(*words)).select(
        "*", distance.alias("distance_m"), text.token_similarity(*tokens).alias("name_similarity"),
        web.alias("website_match"), phone.alias("phone_match"), address.alias("address_match"),
    )
    s, d = c("name_similarity"), c("distance_m")
    admitted = ((d <= near_m) & (s >= 0.78)) | (c("website_match") & (s >= 0.5)) | (c("address_match") & (s >= 0.5)) | (c("phone_match") & (s >= 0.85))
    evidence = c("website_match").cast("int") + c("phone_match").cast("int") + c("address_match").cast("int")
    region = lambda side: F.lower(F.trim(F.coalesce(c(f"{side}_region"), F.lit(""))))
    compatible = region("l").isin("", "unknown") | region("r").isin("", "unknown") | (region("l") == region("r"))
    points = PAIR_POINTS
    closeness = F.when(d <= near_m, PAIR_NEAR).otherwise(0.0)
    for metres, value in reversed(PAIR_METRES):
        closeness = F.when(d <= metres, value).otherwise(closeness)
    shared = sum((F.when(c(f"{name}_match"), points[name]).otherwise(0.0) for name in ("website", "address", "phone")), F.lit(0.0))
    score = s * points["name"] + shared + closeness + F.when(~compatible & (evidence == 0), points["region"]).otherwise(0.0)
    scored = base.where(admitted).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).where(
        (F.col("score") >= 0.62) & ((F.col("score") >= 0.7) | (evidence > 0) | ((d <= 150) & (s >= 0.9)))
    )
    automatic = ((d <= 75) & (s >= 0.96)) | (c("website_match") & (s >= 0.8)) | (c("address_match") & (s >= 0.9)) | ((evidence >= 2) & (s >= 0.6))
    return scored.withColumn("recommendation", F.when(automatic, "automatic").otherwise("review"))


def score_match(pairs: DataFrame) -> DataFrame:
    """Score an incoming record (i_*) against a canonical one (c_*) at distance_m with a name similarity.

    evidence: the sum of points, of which the score is what lies within 0 and 1.
    """
    c = F.col
    same = lambda name: F.coalesce(F.lower(c(f"i_{name}")) == F.lower(c(f"c_{name}")), F.lit(False))
    domain = text.website_domain(c("i_website"))
    web = F.coalesce((domain == text.website_domain(c("c_website"))) & (~domain.isin(*SHARED_DOMAINS) | (text.website_identity(c("i_website")) == text.website_identity(c("c_website")))), F.lit(False))
    phone = F.coalesce(text.phone(c("i_phone")) == text.phone(c("c_phone")), F.lit(False))
    plain = lambda x: F.regexp_replace(F.lower(x), r"\W", "")
    address = F.coalesce((c("i_address") != "Address not provided") & (plain(c("i_address")) == plain(c("c_address"))), F.lit(False))
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    identity = text.token_similarity(text.name_tokens(c("i_name")), text.name_tokens(c("c_name")))
    name = F.greatest(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("name_similarity"))), identity)
    held = {
        "website": web, "phone": phone, "address": address, "close": (name >= 0.9) & (c("distance_m") <= 350), "operator": same("operator"), "parent": same("parent"),
        "region": ~(blank(c("i_region")) | blank(c("c_region")) | same("region")),
    }
    # Added one after the other: in another order, sums that are just a bound of the decision fall below it.
    evidence = name * MATCH_POINTS["name"] + F.greatest(F.lit(0.0), 1 - c("distance_m") / 5000) * MATCH_POINTS["distance"]
    for signal, test in held.items():
        evidence = evidence + F.when(test, MATCH_POINTS[signal]).otherwise(0.0)
    total = F.when(c("i_country") != c("c_country"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("evidence"))))
    return pairs.withColumn("evidence", evidence).withColumn("score", total).withColumn("decision", F.when(c("score") >= AUTOMATIC, "automatic").when(c("score") >= REVIEW, "review").otherwise("new"))


def best_matches(scored: DataFrame, incoming: str, canonical: str) -> DataFrame:
    """The highest score of each incoming record; of equal ones, the nearest, then the most evidence."""
    w = Window.partitionBy(incoming).orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("distance_m"), F.desc_nulls_last("evidence"), canonical)
    return scored.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def trigram_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str, least: float, block: str | None = None) -> DataFrame:
    """Pairs whose trigram sets have a Jaccard similarity of ``least`` or more, by prefix filtering.

    Sets are ordered by how rare their trigrams are.  Two sets that are so alike share one of the first
    n - ceil(least * n) + 1 trigrams of each, so only those are joined on; frequent ones are hardly among them.
    """
    def side(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
        cols = [F.col(key).alias(f"{name}_key"), text.trigrams(F.col(column)).alias(f"{name}_set")]
        return df.select(*cols, *([F.col(block).alias(f"{name}_block")] if block else [F.lit(0).alias(f"{name}_block")])).where(F.size(f"{name}_set") > 0)

    a, b = side(left, left_key, left_text, "a"), side(right, right_key, right_text, "b")
    grams = a.select(F.explode("a_set").alias("g")).unionByName(b.select(F.explode("b_set").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(f"{name}_key", f"{name}_block", F.size(f"{name}_set").alias("size"), F.explode(f"{name}_set").alias("g")).join(grams, "g")
        w = Window.partitionBy(f"{name}_key").orderBy("n", "g")
        return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select(f"{name}_key", f"{name}_block", "g")

    # Block and trigram together are the key, which also splits a frequent trigram.
    lefts, rights = prefix(a, "a").withColumnRenamed("a_block", "block"), prefix(b, "b").withColumnRenamed("b_block", "block")
    candidates = lefts.join(rights, ["block", "g"]).select("a_key", "b_key").distinct()
    scored = candidates.join(a, "a_key").join(b, "b_key").withColumn("similarity", text.set_similarity(F.col("a_set"), F.col("b_set")))
    return scored.where(F.col("similarity") >= least).select("a_key", "b_key", "similarity")


def _named(df: DataFrame, block: str, column: str) -> DataFrame:
    return df.where(F.col(block).isNotNull() & F.col(column).isNotNull()).select("*", F.struct(F.col(block).alias("block"), F.col(column).alias("name")).alias("__name"))


def _pairs_of_rows(named: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Pairs of keys (a < b) from ordered pairs of names (a_key, b_key), a name with itself among them."""
    # Names that many rows share make more pairs than their bytes tell: the pairs are counted, and tasks dealt by them.
    stored = checkpoint(pairs)
    sizes = named.groupBy("__name").agg(F.count("*").alias("n"))
    size = lambda x: sizes.select(F.col("__name").alias(f"{x}_key"), F.col("n").alias(f"n_{x}"))
    total = stored.join(size("a"), "a_key").join(size("b"), "b_key").agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0.0
    tasks = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / spatial.TASK_PAIRS))
    a, b = (named.select(F.col("__name").alias(f"{x}_key"), F.col(key).alias(x)) for x in "ab")
    lefts = stored.hint("merge").join(a, "a_key")
    # The right rows of a name meet all its left rows, which go to several tasks where one would have many.
    salts = min(16, max(1, math.ceil(tasks / 16)))
    lefts = lefts.withColumn("__salt", F.pmod(F.xxhash64("a"), F.lit(salts))).repartition(tasks, "b_key", "__salt")
    rights = b.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).repartition(tasks, "b_key", "__salt")
    return lefts.hint("merge").join(rights, ["b_key", "__salt"]).where("a < b").select("a", "b", "similarity")


def trigram_pairs_within(df: DataFrame, key: str, block: str, column: str, least: float) -> DataFrame:
    """(a, b, similarity) of all rows of a block whose texts are so alike; each two distinct texts are compared once."""
    named = _named(df, block, column)
    names = named.select("__name", "__name.block", "__name.name").distinct()
    return _pairs_of_rows(named, key, trigram_pairs(names, names, "__name", "__name", "name", "name", least, "block"))


def token_pairs_within(df: DataFrame, key: str, block: str, column: str, least: float) -> DataFrame:
    """(a, b, similarity) of all rows of a block whose names have a token similarity of ``least`` or more.

    The similarity is at most the overlap's share of the smaller set.  So with tokens from rare to frequent, one
    of the first n - ceil(least * n) + 1 tokens of the smaller set is in the other, and only those are joined on.
    """
    named = _named(df, block, column)
    sets = named.select("__name", "__name.block", text.name_tokens(F.col("__name.name")).alias("t")).distinct().where(F.size("t") > 0)
    tokens = sets.select("__name", "block", F.size("t").alias("n"), F.explode("t").alias("g"))
    ranked = tokens.join(tokens.groupBy("block", "g").agg(F.count("*").alias("c")), ["block", "g"])
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("__name").orderBy("c", "g")))
    first = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    small, large = first.select("block", "g", F.col("__name").alias("a_key"), F.col("n").alias("a_n")), tokens.select("block", "g", F.col("__name").alias("b_key"), F.col("n").alias("b_n"))
    found = small.join(large, ["block", "g"]).where("a_n <= b_n").select("a_key", "b_key")
    both = found.unionByName(found.select(F.col("b_key").alias("a_key"), F.col("a_key").alias("b_key"))).distinct()
    a, b = sets.select(F.col("__name").alias("a_key"), F.col("t").alias("s")), sets.select(F.col("__name").alias("b_key"), "t")
    scored = both.join(a, "a_key").join(b, "b_key").select("a_key", "b_key", text.token_similarity(F.col("s"), F.col("t")).alias("similarity"))
    return _pairs_of_rows(named, key, scored.where(F.col("similarity") >= least))
