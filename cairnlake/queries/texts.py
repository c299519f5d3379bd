"""Names, urls, html and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import entity, rules, stats
from ..operators.jobs import checkpoint, small_batches
from ..plans import serving
from ..sources.feeds import table
from .registry import query


def _java_to_re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("""
WITH p AS (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: (length(w) > 1 OR regexp_matches(w, '^[0-9]+$')) AND w NOT IN ('a', 'and', 'at', 'by', 'camp', 'of', 'park', 'the', 'rv'))) AS t FROM part),
j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS n, len(b.t) AS m FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey),
s AS (SELECT a, b, CASE WHEN i = 0 THEN 0 ELSE least(1, 0.85 * i / least(n, m) + 0.15 * i / (n + m - i)) END AS similarity FROM j)
SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.78
""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of a brand whose names have a token similarity that may make a pair nearby."""
    pairs = entity.token_pairs_within(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_name", 0.78)
    return pairs.withColumn("similarity", F.round("similarity", 6))


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""
WITH p AS (SELECT p_partkey, p_brand, {_TRIGRAMS.format(c='p_name')} AS t FROM part),
j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS n, len(b.t) AS m FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT a, b, round(i / (n + m - i)::DOUBLE, 6) AS similarity FROM j WHERE i / (n + m - i)::DOUBLE >= 0.5
""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of a brand whose names share half of their trigrams."""
    pairs = entity.trigram_pairs_within(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_name", 0.5)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['h', 'p', 'q']) AS u FROM pages)
SELECT page_id, regexp_replace(lower(u.h), '^www\.', '') AS domain, regexp_replace(lower(u.h), '^www\.', '') || lower(regexp_replace(u.p, '/+$', '')) ||
 CASE WHEN len(list_filter(string_split(substr(u.q, 2), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) > 0
 THEN '?' || lower(array_to_string(list_sort(list_filter(string_split(substr(u.q, 2), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))), '&')) ELSE '' END AS identity FROM u
""")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.website_domain(F.col("url")).alias("domain"), text.website_identity(F.col("url")).alias("identity"))


@query(r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'), lambda x: lower(x)))), ' ') AS emails,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)https?://[^\s<>"'']+'), lambda x: regexp_replace(x, '[),.;\]}]+$', '')))), ' ') AS urls FROM documents WHERE text IS NOT NULL
""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(text.emails(F.col("text")), " ").alias("emails"), F.array_join(text.urls(F.col("text")), " ").alias("urls"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?i)&nbsp;|&#160;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&quot;', '"', 'g'), '&#39;', ''''), '\s+', ' ', 'g')) AS body FROM pages
""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


_THEMES = (("First", r"(?i)\b(the|die|la)\b"), ("Second", r"(?i)\b(of|und|et)\b"), ("Third", r"(?i)\b(in|ist|que)\b"), ("Fourth", r"(?i)\b(was|nicht|pour)\b"))


@query(f"""
WITH d AS (SELECT source, doc_id, text FROM documents WHERE trim(text) <> ''), n AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
m AS ({" UNION ALL ".join(f"SELECT source, '{p}' AS phrase, {i} AS place, count(*) AS c, max(doc_id) AS newest FROM d WHERE regexp_matches(text, '{r}') GROUP BY 1" for i, (p, r) in enumerate(_THEMES))})
SELECT source, phrase, c AS count, CAST(k AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, newest DESC, place) AS k FROM m JOIN n USING (source) WHERE n >= 2 AND c >= greatest(2, ceil(n * 0.25))) WHERE k <= 3
""")
def theme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.theme_summary(table(spark, sf_dir, "documents"), "source", "text", "doc_id", _THEMES)
    return out.select("source", "phrase", "count", F.col("rank").cast("long").alias("rank"))


_FULL_WIDTH, _ASCII = (x.replace("'", "''") for x in (rules._WIDE, rules._PLAIN))


@query(rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(translate(coalesce(text, ''), '{_FULL_WIDTH}', '{_ASCII}')), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, t, CAST(regexp_matches(t, '{_java_to_re2(rules.PITCH_VISIBILITY)}') AS INT) + CAST(regexp_matches(t, '{_java_to_re2(rules.PITCH_SERVICE)}') AS INT)
  + CAST({" + ".join(f"CAST(regexp_matches(t, '{chr(92)}b{a}{chr(92)}b') AS INT)" for a in rules.PITCH_ACRONYMS)} >= 2 AS INT) + CAST({" + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in rules.PITCH_PLATFORMS)} >= 3 AS INT) AS pitch FROM d)
SELECT doc_id, regexp_matches(t, '{_java_to_re2(rules.SPAM_URL)}') AS has_url, CAST(len(list_filter([{", ".join(f"'{p}'" for p in rules.SPAM_PHRASES)}], lambda p: contains(t, p))) AS BIGINT) AS phrases,
 CAST(CASE WHEN pitch >= 2 THEN pitch ELSE 0 END AS BIGINT) AS solicitation FROM s
""")
def spam_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.spam_reasons(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "r")
    count = lambda start: F.size(F.filter("r", lambda x: F.startswith(x, F.lit(start)))).cast("long")
    return found.select("doc_id", F.array_contains("r", "contains-url").alias("has_url"), count("restricted:").alias("phrases"), count("solicitation:").alias("solicitation"))


_MESSAGES = (
    "Our site is not showing in the search results", "We can provide SEO and AEO services", "We use Squarespace, Shopify and Wix here", "A quiet night by the lake",
    "Visit ｗｗｗ.example.com now", "Cheap traffic and guest post offers", "seo geo and wordpress godaddy wix", "casino bonus at my-site [dot] xyz", "Ends here. In all, nothing",
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two joined phrases for each part, so that every signal meets every other one."""
    said = F.array(*map(F.lit, _MESSAGES))
    pick = lambda k: F.element_at(said, (F.pmod(k, F.lit(len(_MESSAGES))) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" -- ", pick(F.col("p_partkey")), pick(F.floor(F.col("p_partkey") / len(_MESSAGES)))).alias("text"))


_SAID = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + "]"


@query(rf"""
WITH m AS (SELECT p_partkey, {_SAID}[p_partkey % {len(_MESSAGES)} + 1] || ' -- ' || {_SAID}[p_partkey // {len(_MESSAGES)} % {len(_MESSAGES)} + 1] AS text FROM part),
d AS (SELECT p_partkey, lower(translate(text, '{_FULL_WIDTH}', '{_ASCII}')) AS t FROM m),
f AS (SELECT p_partkey, regexp_matches(t, '{_java_to_re2(rules.SPAM_URL)}') AS u, [p FOR p IN [{", ".join(f"'{p}'" for p in rules.SPAM_PHRASES)}] IF contains(t, p)] AS p,
 regexp_matches(t, '{_java_to_re2(rules.PITCH_VISIBILITY)}') AS a, regexp_matches(t, '{_java_to_re2(rules.PITCH_SERVICE)}') AS b,
 {" + ".join(f"CAST(regexp_matches(t, '{chr(92)}b{a}{chr(92)}b') AS INT)" for a in rules.PITCH_ACRONYMS)} >= 2 AS c, {" + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in rules.PITCH_PLATFORMS)} >= 3 AS e FROM d)
SELECT p_partkey, array_to_string(list_concat(CASE WHEN u THEN ['contains-url'] ELSE [] END, list_transform(p, lambda x: 'restricted:' || x), CASE WHEN CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(e AS INT) < 2 THEN [] ELSE
 list_filter([CASE WHEN a THEN 'solicitation:search-visibility-pitch' END, CASE WHEN b THEN 'solicitation:optimization-service' END, CASE WHEN c THEN 'solicitation:optimization-acronyms' END,
 CASE WHEN e THEN 'solicitation:website-platform-list' END], lambda x: x IS NOT NULL) END), ' ') AS reasons FROM f
""")
def spam_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reason codes of short messages, with every combination of signals."""
    return rules.spam_reasons(messages(spark, sf_dir), "text", "r").select("p_partkey", F.array_join("r", " ").alias("reasons"))


@query()
def simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose fingerprint is within 16 bits of one of the 100 before them by the same role."""
    small_batches(spark)
    # Stored, as the filter and the sample for the ranges would each make the fingerprints again, in workers of their own.
    turns = checkpoint(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", rules.fingerprint("text").alias("f"))).where("f IS NOT NULL")
    near = rules.near_before(turns, "role", ["conv_id", "turn"], "f")
    return near.select("conv_id", "turn", "f")


@query(r"""
SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'), ' ', '-', 'g') AS slug, CASE WHEN length(regexp_replace(c_name, '\D', '', 'g')) >= 7 THEN right(regexp_replace(c_name, '\D', '', 'g'), 10) END AS phone FROM customer
""")
def slug_and_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"), text.phone(F.col("c_name")).alias("phone"))


@query("""
SELECT n_nationkey, n_name, CASE WHEN n_name ILIKE 'u%' THEN 0 ELSE 1 END AS starts FROM nation WHERE n_name ILIKE '%u%' ORDER BY starts, n_name LIMIT 8
""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a search text: those that begin with it first."""
    starts = F.when(F.col("n_name").ilike("u%"), 0).otherwise(1)
    return table(spark, sf_dir, "nation").where(F.col("n_name").ilike("%u%")).select("n_nationkey", "n_name", starts.alias("starts")).orderBy("starts", "n_name").limit(8)


@query(f"""
WITH p AS (SELECT p_partkey, p_name, {_TRIGRAMS.format(c='p_name')} AS t, {_TRIGRAMS.format(c="'an'")} AS q FROM part WHERE p_name ILIKE '%an%')
SELECT p_partkey, p_name, CASE WHEN p_name ILIKE 'an%' THEN 0 ELSE 1 END AS starts, round(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q)))::DOUBLE, 6) AS similarity FROM p ORDER BY starts, similarity DESC, p_name, p_partkey LIMIT 8
""")
def similar_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was typed: names that begin with it first, then the most alike."""
    return serving.suggestions(table(spark, sf_dir, "part"), "p_partkey", "p_name", "an")
