"""Normal forms of names, addresses, phones, urls and free text, and their similarities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and marks that the rules name.
NAME_FILLERS = (
    "a", "and", "at", "by", "camp", "campground", "campgrounds", "camping", "campsite", "campsites", "cabin", "cabins",
    "family", "holiday", "koa", "of", "park", "resort", "rv", "the",
)
PLACEHOLDER_ADDRESSES = ("", "address not provided", "unknown", "not available")
STREET_WORDS = {"road": "rd", "street": "st", "avenue": "ave", "highway": "hwy", "route": "rte"}
CLICK_IDS = ("fbclid", "gclid", "msclkid")

# Accented Latin letters by their base letters, for the JVM-side fold; anything else needs fold_exact().
_ACCENTS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ",
    "l": "ĺļľ", "n": "ñńņň", "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_FROM = "".join(_ACCENTS.values())
_TO = "".join(k * len(v) for k, v in _ACCENTS.items())


def fold(text: Column) -> Column:
    """Lower case without accents, for Latin letters, precomposed or with combining marks."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), "[̀-ͯ]", "")


@F.pandas_udf(T.StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD) without combining marks, for any script; Arrow batches."""
    import unicodedata

    def one(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ").lower()

    return texts.map(one)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_name(text: Column) -> Column:
    x = F.replace(fold(text), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, r"\b(campground|camping|camp site|campsite)\b", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


_PHONE = r"(?i)(?:\+?1[\s.\-]?)?(?:\(\s*\d{3}\s*\)|\d{3})[\s.\-]*\d{3}[\s.\-]+\d{4}(?:\s*(?:x|ext\.?|extension)\s*\d+)?"


def display_name(text: Column) -> Column:
    """A name without leading bullets, embedded phone numbers and trailing punctuation."""
    x = F.regexp_replace(text, "^\\s*[-–—•]+\\s*", "")
    x = F.regexp_replace(F.regexp_replace(x, _PHONE, ""), r"\s*[:|,;\-]+\s*$", "")
    return F.trim(F.regexp_replace(x, r"\s{2,}", " "))


def slug(text: Column, default: str = "campground", width: int = 150) -> Column:
    x = F.left(F.regexp_replace(normal_name(text), r"\s+", "-"), F.lit(width))
    return F.when(x == "", default).otherwise(x)


def unique_slug(text: Column, *key: Column) -> Column:
    return F.concat(slug(text), F.lit("-"), F.left(F.sha1(F.concat_ws(":", *key)), F.lit(8)))


def name_tokens(text: Column, fillers: tuple[str, ...] = NAME_FILLERS) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.replace(fold(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) | w.rlike(r"^\d+$"))
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, fillers)))


def token_similarity(left: Column, right: Column) -> Column:
    """0.85 of the overlap's share of the smaller token set, and 0.15 of its share of the union."""
    both = F.size(F.array_intersect(left, right))
    small = F.least(F.size(left), F.size(right))
    score = 0.85 * both / F.greatest(small, F.lit(1)) + 0.15 * both / F.greatest(F.size(F.array_union(left, right)), F.lit(1))
    return F.when((small == 0) | (both == 0), 0.0).otherwise(F.least(F.lit(1.0), score))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words, each padded by two spaces before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    each = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(each))


def set_similarity(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def phone(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(10)))


def website_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def website_identity(url: Column) -> Column:
    """Host and path and the parameters that aren't tracking marks, in order; null if it is no url."""
    path = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(F.lower(p), F.lit("utm_")) & ~F.lower(F.split(p, "=")[0]).isin(*CLICK_IDS))
    kept = F.lower(F.array_join(F.array_sort(pairs), "&"))
    return F.concat(website_domain(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def normal_address(address: Column, *places: Column) -> Column:
    """Null for placeholders and for what is under eight characters."""
    x = fold(F.concat_ws(" ", address, *places))
    for word, short in STREET_WORDS.items():
        x = F.regexp_replace(x, rf"\b{word}\b", short)
    x = F.regexp_replace(x, "[^a-z0-9]+", "")
    return F.when(~F.lower(F.trim(address)).isin(*PLACEHOLDER_ADDRESSES) & (F.length(x) >= 8), x)


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"), F.lit(0)), F.lower)))


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?i)https?://[^\\s<>\"']+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[),.;\]}]+$", ""))))


def html_text(html: Column) -> Column:
    x = F.regexp_replace(html, "<[^>]*>", " ")
    for pattern, char in (("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'")):
        x = F.regexp_replace(x, pattern, char)
    return squeeze(x)


def xml_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def hmac_sha256(key: bytes):
    """A pandas UDF of keyed identifiers in url-safe base 64; plain hashes would be open to guessing."""

    @F.pandas_udf(T.StringType())
    def sign(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64
        import hashlib
        import hmac

        for batch in values:
            yield batch.map(lambda v: None if v is None else base64.urlsafe_b64encode(hmac.new(key, v.encode(), hashlib.sha256).digest()).rstrip(b"=").decode())

    return sign


def plain_ip(ip: Column) -> Column:
    """An address without the prefix of an IPv4 address mapped into IPv6."""
    return F.regexp_replace(F.lower(F.trim(ip)), "^::ffff:", "")


def variant(key: Column, n: int) -> Column:
    """One of n variants for each key, always the same one and evenly spread."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n))


def colour_key(inner: Column, outer: Column) -> Column:
    """A key of two colours, whatever their case and leading mark."""
    plain = lambda c: F.upper(F.regexp_replace(c, "^#", ""))
    return F.concat_ws("-", plain(inner), plain(outer))


def without_near(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^near\s+", "")
