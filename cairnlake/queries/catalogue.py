"""Rule lists over names: classification, retention, publication, removal, towns, and grades of pairs.

Each part gets a name and details picked from short lists by its key, so that every rule meets every detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import entity, rules
from ..operators.jobs import spread
from ..sources.feeds import table
from .registry import query

NAMES = (
    "Pine Campground", "Lake Ranger Station", "Ranger Station Campground", "Site 12", "Hill RV Park", "RV Tent Camp", "Backcountry Walk-in Camp", "Group Camping Area", "Event Centre",
    "Mobile Home Park", "RV Dealer", "", "KOA Holiday", "Church Camp", "Camping Store", "Cabin #4", "Camping Seattle", "Visitor Center Campground", "Boat Launch",
)
DESCRIPTIONS = ("camping area with tents", "rv park for rvs", "nothing here", "primitive sites")
SITES = ("https://koa.com/campgrounds/x", "https://a.example/rv-park", "https://b.example")

#: Columns of the picked table, as SQL that both engines read after ``pick`` and ``//`` are replaced.
_PICKED = {
    "name": "pick(NAMES, k)", "description": "pick(DESCRIPTIONS, k // 19)", "camp": "k % 3 = 0", "closed": "k % 11 = 0", "single": "k % 13 = 0", "activity": "k % 5 = 0", "tents": "k % 7 = 0",
    "confidence": "CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k % 41 AS DOUBLE) / 40 END", "website": "CASE WHEN k % 4 = 0 THEN NULL ELSE pick(SITES, k) END",
    "category": "CASE WHEN k % 6 = 0 THEN 'shop' ELSE 'campground' END", "status": "CASE WHEN k % 23 = 0 THEN 'permanently_closed' ELSE 'open' END",
    "kind": "CASE WHEN k % 10 = 0 THEN 'hotel' WHEN k % 10 < 6 THEN 'developed_campground' ELSE 'rv_park' END", "operator": "CASE WHEN k % 4 = 1 THEN 'Parks' END", "phone": "CASE WHEN k % 9 = 0 THEN '555' END",
    "address": "CASE WHEN k % 5 = 0 THEN 'Address not provided' WHEN k % 5 = 1 THEN '1 Road' ELSE '' END", "sites": "k % 3", "sources": "1 + k % 29 // 28", "city": "CASE WHEN k % 2 = 0 THEN 'Seattle' ELSE 'Unknown' END",
    "misses": "k % 5", "reports": "CASE WHEN k % 8 = 0 THEN 2 ELSE 0 END",
}
_LISTS = {"NAMES": NAMES, "DESCRIPTIONS": DESCRIPTIONS, "SITES": SITES}


def _sql(expression: str) -> str:
    for name, values in _LISTS.items():
        listed = "[" + ", ".join(f"'{v}'" for v in values) + "]"
        expression = expression.replace(f"pick({name}, k // 19)", f"{listed}[k // 19 % {len(values)} + 1]").replace(f"pick({name}, k)", f"{listed}[k % {len(values)} + 1]")
    return expression


def _column(expression: str) -> Column:
    for name, values in _LISTS.items():
        listed = "array(" + ", ".join(f"'{v}'" for v in values) + ")"
        for index in ("k // 19", "k"):
            expression = expression.replace(f"pick({name}, {index})", f"element_at({listed}, CAST({index} % {len(values)} + 1 AS INT))")
    return F.expr(expression.replace("//", "div"))


_BASE = "WITH k AS (SELECT p_partkey AS k FROM part), b AS (SELECT k, " + ", ".join(f"{_sql(e)} AS {c}" for c, e in _PICKED.items()) + " FROM k)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select("k", *(_column(e).alias(c) for c, e in _PICKED.items()))


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '" + pattern.replace("'", "''") + "')"


_WORDS = "(trim(name) || ' ' || description || ' ')"


@query(rf"""
{_BASE} SELECT k, CASE WHEN trim(name) = '' THEN 'reject:missing_name' WHEN closed THEN 'reject:permanently_closed'
 WHEN {_has('name', rules.NOT_A_CAMP)} AND NOT {_has('name', rules.CAMP_IDENTITY)} THEN 'reject:non_campground_recreation_feature'
 WHEN single OR {_has('name', rules.ONE_SITE)} THEN 'reject:individual_campsite_or_pitch'
 WHEN NOT (camp OR activity OR {_has(_WORDS, rules.CAMP_WORDS)}) THEN 'reject:no_campground_evidence'
 WHEN {_has(_WORDS, rules.RV_WORDS)} AND NOT (tents OR {_has(_WORDS, rules.TENT_WORDS)}) AND {_has(_WORDS, rules.RV_ONLY)} THEN 'reject:rv_only_facility'
 WHEN regexp_matches({_WORDS}, '(?i)\bbackcountry|primitive|walk[- ]?in\b') THEN 'accept:backcountry_campground' WHEN regexp_matches({_WORDS}, '(?i)\bgroup\b') THEN 'accept:group_campground'
 ELSE 'accept:developed_campground' END AS decision FROM b
""")
def camp_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    categories = F.when(c("camp"), F.array(F.lit("campground"))).otherwise(F.array(F.lit("shop")))
    return catalogue(spark, sf_dir).select("k", rules.camp_decision(c("name"), c("description"), categories, None, c("closed"), c("single"), c("activity"), c("tents")).alias("decision"))


@query(rf"""
{_BASE} SELECT k, CASE WHEN category <> 'campground' THEN 'alternate_category_only' WHEN confidence IS NULL OR confidence < 0.7 THEN 'low_source_confidence' WHEN {_has('name', rules.CONFERENCE)} THEN 'conference_or_retreat_centre'
 WHEN {_has('name', rules.RESIDENTIAL)} THEN 'residential_community' WHEN {_has('name', rules.FACILITY)} THEN 'non_campground_facility' WHEN {_has('name', rules.RETAIL)} THEN 'retail_or_service_business' END AS reason FROM b
""")
def place_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return catalogue(spark, sf_dir).select("k", rules.retention_reason(c("name"), c("category"), c("confidence")).alias("reason"))


@query(rf"""
{_BASE}, e AS (SELECT *, {_has('name', rules.PLACE_EXPLICIT)} AS explicit, coalesce(website, '') <> '' AS sited,
 coalesce(website, '') <> '' AND {_has('name', rules.PLACE_RV)} AND coalesce({_has('website', rules.PLACE_SITE)}, false) AS supported FROM b)
SELECT k, CASE WHEN category <> 'campground' THEN 'not_primary_campground' WHEN status = 'permanently_closed' THEN 'closed' WHEN {_has('name', rules.PLACE_EXCLUDED)} THEN 'excluded_name'
 WHEN NOT explicit AND NOT supported THEN 'insufficient_name_evidence' WHEN coalesce(confidence, 0) < CASE WHEN supported THEN 0.9 WHEN sited THEN 0.8 ELSE 0.95 END THEN 'insufficient_confidence'
 WHEN supported AND NOT explicit THEN 'eligible_web_supported_camping_facility' ELSE 'eligible_explicit_established_campground' END AS publication FROM e
""")
def publication_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return catalogue(spark, sf_dir).select("k", rules.place_publication(c("name"), c("confidence"), c("website"), c("category"), c("status")).alias("publication"))


@query(rf"""
{_BASE}, s AS (SELECT *, CAST(coalesce(operator, '') <> '' AS INT) + CAST(coalesce(website, '') <> '' AS INT) + CAST(coalesce(phone, '') <> '' AS INT) + CAST(address NOT IN ('', 'Address not provided') AS INT) + CAST(sites > 0 AS INT) AS signals FROM b)
SELECT k, CASE WHEN kind = 'hotel' THEN 'unsupported_type' WHEN {_has('name', rules.MAP_EXCLUDED)} THEN 'excluded_name'
 WHEN sources >= 2 OR signals >= 2 OR ({_has('name', rules.MAP_EXPLICIT)} AND signals >= 1) THEN 'established_campground_evidence' ELSE 'insufficient_evidence' END AS publication FROM s
""")
def publication_by_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    found = rules.map_publication(c("name"), c("kind"), c("operator"), c("website"), c("phone"), c("address"), c("sites"), c("sources"))
    return catalogue(spark, sf_dir).select("k", found.alias("publication"))


@query(rf"""
{_BASE}, n AS (SELECT *, {_has('name', rules.REMOVE_IDENTITY)} AS identity, address IN ('', 'Address not provided') AND website IS NULL AND phone IS NULL AS bare,
 regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '\b(campground|camping|camp site|campsite)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '^(camp|park)\s+', '') AS plain, lower(city) AS town FROM b),
r AS (SELECT *, CASE WHEN {_has('name', rules.REMOVE_SERVICE)} AND NOT identity THEN ['non_campground_service_facility', '0.99'] WHEN {_has('name', rules.REMOVE_VISITOR)} THEN ['non_campground_visitor_facility', '0.97']
 WHEN {_has('name', rules.REMOVE_FEATURE)} AND NOT identity THEN ['non_campground_recreation_feature', '0.94'] WHEN {_has('name', rules.REMOVE_ONE)} AND NOT identity THEN ['individual_accommodation_or_facility', '0.9']
 WHEN k % 4 < 2 AND bare AND {_has('name', '(?i)^camping' + chr(92) + 's+')} AND town <> 'unknown' AND (plain = town OR plain = 'camp ' || town) THEN ['unverified_generic_overture_location', '0.76'] END AS named,
 k % 4 = 1 AND misses >= 3 AS stale, reports > 0 AS used FROM n),
c AS (SELECT *, greatest(coalesce(CAST(named[2] AS DOUBLE), 0), CASE WHEN stale THEN 0.82 ELSE 0 END) AS sure FROM r WHERE named IS NOT NULL OR stale)
SELECT k, round(CASE WHEN used THEN greatest(0.5, sure - 0.15) ELSE sure END, 3) AS confidence,
 array_to_string(list_filter([named[1], CASE WHEN stale THEN 'missing_from_all_current_sources' END, CASE WHEN used THEN 'has_user_data' END], lambda x: x IS NOT NULL), ' ') AS codes FROM c
""")
def removal_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for removal: names, generic unverified places, and records that all their sources miss."""
    c = F.col
    one = F.struct(F.lit("overture-places").alias("source"), (c("k") % 4 != 1).alias("authoritative"), c("misses").alias("missing"))
    sources = F.when(c("k") % 4 < 2, F.array(one)).when(c("k") % 4 == 2, F.array(one, F.struct(F.lit("osm").alias("source"), F.lit(False).alias("authoritative"), F.lit(9).cast("long").alias("missing")))).otherwise(F.array().cast("array<struct<source:string,authoritative:boolean,missing:bigint>>"))
    confidence, listed = rules.removal(c("name"), c("city"), c("address"), c("website"), c("phone"), c("reports"), F.lit(0), sources)
    return catalogue(spark, sf_dir).select("k", confidence.alias("confidence"), F.array_join(listed, " ").alias("codes")).where("confidence IS NOT NULL")


_AREAS = " ".join(
    "WHEN " + " AND ".join(t for t in (s is not None and f"lat >= {s}", n is not None and f"lat < {n}", w is not None and f"lon > {w}", e is not None and f"lon < {e}") if t) + f" THEN '{area}'" for area, s, n, w, e in rules.AREAS
)


@query(f"""
SELECT p_partkey, CASE {_AREAS} ELSE 'Interior British Columbia' END AS area
FROM (SELECT p_partkey, 48 + CAST(p_partkey % 25 AS DOUBLE) / 2 AS lat, -138 + CAST(p_partkey // 25 % 50 AS DOUBLE) / 2 AS lon FROM part)
""")
def area_by_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "part").select("p_partkey", (48 + F.col("p_partkey") % 25 / 2).alias("lat"), (-138 + F.expr("p_partkey div 25 % 50") / 2).alias("lon"))
    return at.select("p_partkey", rules.coordinate_area(F.col("lat"), F.col("lon")).alias("area"))


_NOTES = ("The nearest towns and cities are {n} and Yale", "It lies 12.5 km northeast of {n} on a road", "Camp outside of {n}; bring water", "Closest community is the town of {n} community.", "near Highway",
          "<b>Okanagan Valley</b> &amp; more", "on Vancouver Island", "close to the Kootenay Rockies", "Nearest city is {p}", "quiet woods", "3 miles west of St. {n} (old)", "the Lower Mainland")
_WORD = "upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2)"


def _sql_place(found: str) -> str:
    """A place's name in SQL, from the same patterns."""
    name = f"replace(split_part(replace(regexp_replace({found}, '{rules.SAINT[0]}', '{rules.SAINT[1]}', 'g'), ';', '.'), '.', 1), 'St§', 'St. ')"
    for pattern in rules.NOT_NAME:
        name = f"regexp_replace({name}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"trim(regexp_replace({name}, '\\s+', ' ', 'g'))"


def _sql_bare(name: str) -> str:
    name = f"lower({name})"
    for pattern in rules.SITE_WORDS:
        name = f"regexp_replace({name}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace({name}, '[^a-z0-9]+', ' ', 'g'))"


def _sql_usable(name: str) -> str:
    return f"CASE WHEN {name} <> '' AND lower({name}) NOT IN ({', '.join(repr(r) for r in rules.ROADS)}) AND {_sql_bare(name)} <> {_sql_bare('name')} THEN {name} END"


def _sql_believed(area: str) -> str:
    tests = [t for t in (b is not None and f"{c} {o} {b}" for b, (c, o) in zip(rules.PLAUSIBLE.get(area, ()), (("lat", ">"), ("lat", "<"), ("lon", ">"), ("lon", "<")), strict=False)) if t]
    return " AND ".join(tests) or "true"


_quote = lambda p: p.replace("'", "''")
_NAMED = " ".join(f"WHEN regexp_matches(name || ' ' || notes, '(?i){_quote(p)}') THEN CASE WHEN {_sql_believed(a)} THEN '{a}' END" for a, p in rules.NAMED_AREAS)


@query(f"""
WITH p AS (SELECT p_partkey, p_name, 48 + CAST(p_partkey % 25 AS DOUBLE) / 2 AS lat, -138 + CAST(p_partkey // 25 % 50 AS DOUBLE) / 2 AS lon, {_WORD} AS word FROM part),
r AS (SELECT p_partkey, lat, lon, word || ' Provincial Park' AS name, replace(replace([{", ".join(f"'{n}'" for n in _NOTES)}][p_partkey % {len(_NOTES)} + 1], '{{n}}', word || ' Bay'), '{{p}}', word || ' Park') AS raw FROM p),
n AS (SELECT *, trim(regexp_replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS notes FROM r),
s AS (SELECT *, regexp_replace(notes, '{rules.SAINT[0]}', '{rules.SAINT[1]}', 'g') AS plain FROM n),
f AS (SELECT *, string_split_regex(regexp_extract(plain, '(?i){_quote(rules.NEAREST)}', 1), '(?i),|\\s+and\\s+|\\s+or\\s+')[1] AS a, regexp_extract(plain, '{_quote(rules.AT_DISTANCE)}', 1) AS b, regexp_extract(plain, '{_quote(rules.BESIDE)}', 1) AS c FROM s),
g AS (SELECT *, {_sql_place("a")} AS pa, {_sql_place("b")} AS pb, {_sql_place("c")} AS pc FROM f)
SELECT p_partkey, coalesce({_sql_usable("pa")}, {_sql_usable("pb")}, {_sql_usable("pc")}, CASE {_NAMED} END, CASE {_AREAS} ELSE 'Interior British Columbia' END) AS locality FROM g
""")
def localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as parks with notes: the locality by town, named area or point."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    first = F.split("p_name", " ")[0]
    word = F.concat(F.upper(F.substring(first, 1, 1)), F.expr("substr(split(p_name, ' ')[0], 2)"))
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("p_partkey") % len(_NOTES) + 1).cast("int"))
    notes = F.replace(F.replace(note, F.lit("{n}"), F.concat(word, F.lit(" Bay"))), F.lit("{p}"), F.concat(word, F.lit(" Park")))
    lat, lon = 48 + F.col("p_partkey") % 25 / 2, -138 + F.expr("p_partkey div 25 % 50") / 2
    return part.select("p_partkey", rules.locality(F.concat(word, F.lit(" Provincial Park")), notes, F.lit(None).cast("string"), lat, lon).alias("locality"))


_PAIR_NAMES = ("Pine Lake", "Pine Lake Campground", "Cedar Lake", "North Pine Lake", "South Pine Lake", "Cedar Grove Horse Camp", "Pine Grove 12", "Pine Lake 12", "Cedar Grove")
_LEFT, _RIGHT = (f"[{', '.join(repr(n) for n in _PAIR_NAMES)}][{i} % {len(_PAIR_NAMES)} + 1]" for i in ("k", f"(k // {len(_PAIR_NAMES)})"))
_TOKENS = "list_distinct(list_filter(string_split(lower({n}), ' '), lambda w: (length(w) > 1 OR regexp_matches(w, '^[0-9]+$')) AND w NOT IN ({f})))".replace("{f}", ", ".join(f"'{w}'" for w in text.NAME_FILLERS))


@query(f"""
WITH k AS (SELECT p_partkey AS k FROM part), p AS (SELECT k, {_LEFT} AS a, {_RIGHT} AS b, CAST(k % 37 AS DOUBLE) / 1000 AS off, k % 3 = 0 AS web, k % 5 = 0 AS phone, k % 7 = 0 AS address, k % 11 < 3 AS away FROM k),
t AS (SELECT *, string_split(lower(a), ' ') AS aw, string_split(lower(b), ' ') AS bw, {_TOKENS.replace('{n}', 'a')} AS s, {_TOKENS.replace('{n}', 'b')} AS t, off * 6371008.8 * pi() / 180 AS d FROM p),
c AS (SELECT * FROM t WHERE NOT (list_contains(aw, 'horse') <> list_contains(bw, 'horse')) AND NOT (list_contains(aw, 'north') AND list_contains(bw, 'south')) AND NOT (list_contains(aw, 'south') AND list_contains(bw, 'north'))),
n AS (SELECT *, len(list_intersect(s, t)) AS i, least(len(s), len(t)) AS m, len(s) + len(t) AS z FROM c),
q AS (SELECT *, CASE WHEN m = 0 OR i = 0 THEN 0 ELSE least(1, 0.85 * i / m + 0.15 * i / (z - i)) END AS sim, CAST(web AS INT) + CAST(phone AS INT) + CAST(address AS INT) AS e FROM n),
r AS (SELECT *, greatest(0, least(1, sim * 0.55 + CASE WHEN web THEN 0.45 ELSE 0 END + CASE WHEN address THEN 0.35 ELSE 0 END + CASE WHEN phone THEN 0.3 ELSE 0 END
  + CASE WHEN d <= 75 THEN 0.35 WHEN d <= 350 THEN 0.25 WHEN d <= 1000 THEN 0.14 WHEN d <= 2000 THEN 0.08 ELSE 0 END - CASE WHEN away AND e = 0 THEN 0.25 ELSE 0 END)) AS score
 FROM q WHERE (d <= 2000 AND sim >= 0.78) OR (web AND sim >= 0.5) OR (address AND sim >= 0.5) OR (phone AND sim >= 0.85))
SELECT k, round(score, 6) AS score, CASE WHEN (d <= 75 AND sim >= 0.96) OR (web AND sim >= 0.8) OR (address AND sim >= 0.9) OR (e >= 2 AND sim >= 0.6) THEN 'automatic' ELSE 'review' END AS recommendation
FROM r WHERE score >= 0.62 AND (score >= 0.7 OR e > 0 OR (d <= 150 AND sim >= 0.9))
""")
def pair_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of pairs with every mix of names, distances and shared identities, by the same rules as pair_score."""
    n = len(_PAIR_NAMES)
    name = lambda i: F.element_at(F.array(*map(F.lit, _PAIR_NAMES)), F.expr(f"CAST({i} % {n} + 1 AS INT)"))
    k = F.col("k")
    shared = lambda test, side: F.when(test, "same").otherwise(side)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(
        "k", name("k").alias("l_name"), name(f"(k div {n})").alias("r_name"), *(shared(k % 3 == 0, s).alias(f"{s}_website_id") for s in "lr"), *(shared(k % 5 == 0, s).alias(f"{s}_phone") for s in "lr"),
        *(shared(k % 7 == 0, s).alias(f"{s}_address_id") for s in "lr"), F.lit("WA").alias("l_region"), F.when(k % 11 < 3, "OR").otherwise("wa ").alias("r_region"),
        F.lit(0.0).alias("l_lat"), F.lit(10.0).alias("l_lon"), F.lit(0.0).alias("r_lat"), (10 + k % 37 / 1000).alias("r_lon"),
    )
    return entity.score_pairs(rows).select("k", F.round("score", 6).alias("score"), "recommendation")


@query(f"""
WITH k AS (SELECT p_partkey AS k FROM part), p AS (SELECT k, {_LEFT} AS a, {_RIGHT} AS b, k % 21 / 20.0::DOUBLE AS given, k % 47 * 130.0::DOUBLE AS d FROM k),
t AS (SELECT *, {_TOKENS.replace('{n}', 'a')} AS s, {_TOKENS.replace('{n}', 'b')} AS t FROM p), n AS (SELECT *, len(list_intersect(s, t)) AS i, least(len(s), len(t)) AS m, len(s) + len(t) AS z FROM t),
q AS (SELECT *, greatest(given, CASE WHEN m = 0 OR i = 0 THEN 0 ELSE least(1, 0.85 * i / m + 0.15 * i / (z - i)) END) AS name FROM n),
r AS (SELECT *, CASE WHEN k % 13 = 0 THEN 0 ELSE greatest(0, least(1, name * 0.45 + greatest(0, 1 - d / 5000) * 0.25 + CASE WHEN k % 4 IN (0, 2) THEN 0.5 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 0.5 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.15 ELSE 0 END
  + CASE WHEN name >= 0.9 AND d <= 350 THEN 0.25 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 0.08 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 0.08 ELSE 0 END - CASE WHEN k % 8 = 0 THEN 0.25 ELSE 0 END)) END AS score FROM q)
SELECT k, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'automatic' WHEN score >= 0.62 THEN 'review' ELSE 'new' END AS decision FROM r
""")
def match_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of incoming against canonical records with every mix of names, distances, sites, phones, addresses, regions and countries."""
    n = len(_PAIR_NAMES)
    name = lambda i: F.element_at(F.array(*map(F.lit, _PAIR_NAMES)), F.expr(f"CAST({i} % {n} + 1 AS INT)"))
    k = F.col("k")
    web = F.when(k % 4 == 0, "https://a.example/y").when(k % 4 == 1, "https://koa.com/two").when(k % 4 == 2, "http://koa.com/one/").otherwise("https://b.example")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(
        "k", name("k").alias("i_name"), name(f"(k div {n})").alias("c_name"), (k % 21 / F.lit(20.0)).alias("name_similarity"), (k % 47 * 130.0).alias("distance_m"), web.alias("c_website"),
        F.when(k % 4 == 0, "https://www.a.example/x").when(k % 4 == 3, "https://c.example").otherwise("https://www.koa.com/one").alias("i_website"), F.lit("(555) 123-4567").alias("i_phone"),
        F.when(k % 9 == 0, "1-555-123-4567").otherwise("555 000 0000").alias("c_phone"), F.when(k % 5 == 0, "1 Long Road").when(k % 5 == 1, "Address not provided").otherwise("2 Road").alias("i_address"),
        F.when(k % 5 == 1, "Address not provided").otherwise("1, long road").alias("c_address"), F.lit("Parks").alias("i_operator"), F.when(k % 6 == 0, "PARKS").alias("c_operator"), F.when(k % 7 == 0, "Forest").alias("i_parent"), F.lit("forest").alias("c_parent"),
        F.when(k % 8 == 1, "").otherwise("WA").alias("i_region"), F.when(k % 8 == 0, "OR").otherwise("wa").alias("c_region"), F.lit("US").alias("i_country"), F.when(k % 13 == 0, "CA").otherwise("US").alias("c_country"),
    )
    return entity.score_match(rows).select("k", F.round("score", 6).alias("score"), "decision")
