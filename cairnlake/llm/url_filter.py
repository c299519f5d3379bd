"""URL filters with redirect equivalence.

A page's own rule, if one fits, decides.  Otherwise the page gets what its aliases say: pages that are tied by
a canonical link or a client-side redirect, over any number of hops, are one group, found as connected
components.  If a page or alias of the group is allowed by a rule, that takes precedence over blocks; if one is
blocked, the rest of the group is blocked; a group that no rule fits is allowed.  A target that is no
page itself still counts as an alias, with its own rule.

Urls name one page if they agree in host, path and query after dot segments are taken out; groups are found over
these names themselves, not over hashes of them.

Nulls and edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null html has no links; relative targets are resolved against the page's url as RFC 3986 says, and targets
of schemes without ``://`` are none; repeated urls are aliases of each other; ties between rules can't occur, as a host and path have one rule (the last one given
counts); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators.graph import connected_components


from .shared import checkpoint, read

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules that are broadcast as a table, at most; more rules are joined by a shuffle on the host.
SMALL_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its segments . and .., and with / where it is empty."""
    def step(kept: Column, part: Column) -> Column:
        return F.when(part == ".", kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    clean = F.when(path.rlike(r"/\.\.?$"), F.when(F.endswith(clean, F.lit("/")), clean).otherwise(F.concat(clean, F.lit("/")))).otherwise(clean)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), clean).otherwise(F.when(path == "", "/").otherwise(path))


def node_of(url: Column) -> Column:
    """What tells two urls apart: host, path and query, but neither scheme nor fragment."""
    return F.concat(host_of(url), without_dots(path_of(url)), _query_of(url))


def _rule_table(spark: SparkSession, rules) -> DataFrame:
    last = {(h, p): v for v, h, p in rules}
    return spark.createDataFrame([(h, p, v) for (h, p), v in last.items()], "rule_host string, rule_path string, rule_verdict string")


def match(urls: DataFrame, rules, keep: list[str]) -> DataFrame:
    """Add rule and rule_verdict to rows with host and path; keep: columns to carry, the first one unique."""
    table = _rule_table(urls.sparkSession, rules)
    table = F.broadcast(table) if len(rules) <= SMALL_RULES else table
    labels = F.split("host", r"\.")
    # Every suffix of the host is looked up; a host has few labels.
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (
        urls.where("host <> ''").select("host", "path").distinct()
        .withColumn("rule_host", F.explode(suffixes))
        .join(table, "rule_host").where(F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.rule_verdict")
    )
    return urls.join(fits, ["host", "path"], "left").select(*keep, "host", "path", "rule", "rule_verdict")


def _local(url_host: str, rules) -> tuple[Column, Column]:
    """Rule and verdict by a chain of conditions, for a list of rules short enough to be an expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    last = {(h, p): v for v, h, p in rules}
    for (host, path), what in sorted(last.items(), key=lambda x: (len(x[0][0] + x[0][1]), len(x[0][0]), x[0])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


#: Up to so many rules become one expression, without a join.
FEW_RULES = 64


def with_rules(urls: DataFrame, rules, keep: list[str]) -> DataFrame:
    if len(rules) <= FEW_RULES:
        rule, verdict = _local("host", rules)
        return urls.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))
    return match(urls, rules, keep)


_ATTR = r"""[\s"'/]%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = "(?is)" + _ATTR % name
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and client-side redirect in the pages' html."""
    # One cheap pass picks the tags; only these are taken apart.
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"), F.lit(0))
    told = pages.where("url IS NOT NULL AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')").select("url", F.explode(tags).alias("tag"))
    rel, equiv = F.lower(_attribute(F.col("tag"), "rel")), F.lower(_attribute(F.col("tag"), "http-equiv"))
    moved = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    target = F.trim(F.replace(F.when(rel.rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href")).when(equiv == "refresh", moved), F.lit("&amp;"), F.lit("&")))
    found = told.select("url", target.alias("target")).where("target <> ''")
    scheme, host = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", _PARTS, 1)
    folder = F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1)
    target, own = F.col("target"), F.concat(scheme, F.lit("://"), host)
    full = (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.contains("://"), target))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(own, target))
        .when(F.startswith(target, F.lit("?")), F.concat(own, path_of(F.col("url")), target))
        .when(F.startswith(target, F.lit("#")), F.lit(None))
        .otherwise(F.concat(own, F.when(folder == "", "/").otherwise(folder), target))
    )
    return found.where("url LIKE '%://%'").select("url", full.alias("target")).where("target IS NOT NULL")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each page.

    redirects: more edges (url, target), such as a crawler's log of HTTP redirects; those without ``://`` on either side
    are left out, as such urls have no host.
    """
    url = F.col("url")
    judged = with_rules(pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")), rules, ["page_id", "url"])
    told = links(pages)
    if redirects is not None:
        told = told.unionByName(redirects.select("url", "target").where("url LIKE '%://%' AND target LIKE '%://%'"))
    told = checkpoint(told.distinct())
    if told.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    ends = told.select(F.col("url").alias("end")).unionByName(told.select(F.col("target").alias("end"))).distinct()
    key = lambda c: node_of(F.col(c))
    groups = checkpoint(connected_components(told.select(key("url").alias("a"), key("target").alias("b")), "a", "b"))
    # Only urls on some edge have aliases; a group's word is a minimum over its members: allow before block.
    known = with_rules(ends.select(key("end").alias("node"), host_of(F.col("end")).alias("host"), path_of(F.col("end")).alias("path")), rules, ["node"])
    word = known.join(groups, "node").where("rule_verdict IS NOT NULL").groupBy("component").agg(F.min("rule_verdict").alias("group_verdict"))
    said = groups.join(word, "component").select("node", "group_verdict")
    return (
        judged.withColumn("node", key("url"))
        .join(said, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "group_verdict", F.lit("allow")).alias("verdict"))
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
