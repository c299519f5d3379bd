"""License scans: ordered signature rules over words, gated by keywords, with overlapping detections resolved.

1. A document is looked at only if it has one of the rules' keywords, by one regular expression over the whole text.
2. Its text becomes lower-case words.  At each keyword, the rules that the keyword gates are tried on the REACH words
   before and behind it, so a text costs as much as it has keywords, however long it is.
3. A detection is suppressed if it lies inside another one, of the same place or longer, that has a higher priority, or
   the same and more words, or else comes earlier in the order.  Such a detection's keyword is at most 2 * REACH words
   away, so detections are compared with those of the neighbouring keywords only.  Detections of the base phrases are
   never suppressed.

All of it works on one row at a time with built-in functions: no shuffle, no join, and nothing that grows with the corpus.
The rules are a literal.

Nulls and edge cases: a null or empty text, and one of separators only, has no words and no labels (empty strings), null
first_word and last_word and the score 0; rows are judged by themselves, so null and repeated doc_ids need no care;
equal detections of one place by two rules of a label give that label once; no rows give no rows; extra columns are
carried by scan() as they are, but for columns of the names that it adds, which are replaced.
"""

from __future__ import annotations

import json
import string
from collections import defaultdict
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import REACH, Rule, rules
from .shared import read

#: Words are runs of ASCII letters and digits and of everything that isn't ASCII.
SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{SEPARATOR}]+"

#: The columns that scan() adds.
ADDED = ("n_words", "detections", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _gate(keywords: list[str]) -> str:
    """One pattern that finds any keyword as a whole word; words are tried by their first letters."""
    by_first = defaultdict(list)
    for k in sorted(keywords):
        by_first[k[0]].append(k[1:])
    heads = "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in by_first.items())
    return f"(?i)(?:^|[{SEPARATOR}])(?:{heads})(?:[{SEPARATOR}]|$)"


_RULE = "order INT, label STRING, priority INT, weight DOUBLE, base BOOLEAN, before STRING, after STRING"


def _literal(found: list[Rule]) -> Column:
    """The rules of each keyword, as one map; from JSON, so that it is a single constant of the plan."""
    by_word = defaultdict(list)
    for r in found:
        by_word[r.keyword].append({k: v for k, v in asdict(r).items() if k != "keyword"})
    return F.from_json(F.lit(json.dumps(by_word)), f"MAP<STRING, ARRAY<STRUCT<{_RULE.replace(' ', ': ').replace(',:', ',')}>>>")


def _words(text: Column) -> Column:
    """Splitting is many times quicker than to extract what isn't a separator."""
    return F.when(text.isNotNull(), F.array_remove(F.split(text, f"[{SEPARATOR}]+", -1), ""))


def _count(span: Column) -> Column:
    """Words in a piece of text that has a space on either side of each."""
    return F.length(span) - F.length(F.replace(span, F.lit(" "))) - 1


def _at(words: Column, place: Column, all_rules: Column) -> Column:
    """Detections around the keyword at a place, from 0."""
    before = F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(place - REACH, F.lit(0)) + 1, F.least(place, F.lit(REACH))), " "), F.lit(" "))
    after = F.concat(F.lit(" "), F.array_join(F.slice(words, place + 2, REACH), " "), F.lit(" "))
    around = F.array(F.struct(before.alias("before"), after.alias("after")))

    def tried(text: Column) -> Column:
        spans = F.transform(
            F.element_at(all_rules, F.get(words, place)),
            lambda r: F.struct(r.alias("rule"), F.regexp_substr(text["before"], r["before"]).alias("lead"), F.regexp_substr(text["after"], r["after"]).alias("rest")),
        )
        return F.transform(
            F.filter(spans, lambda s: s["lead"].isNotNull() & s["rest"].isNotNull()),
            lambda s: F.struct(
                (place - _count(s["lead"])).alias("start"), (place + 1 + _count(s["rest"])).alias("end"),
                s["rule"]["order"].alias("order"), s["rule"]["label"].alias("label"), s["rule"]["priority"].alias("priority"),
                s["rule"]["weight"].alias("weight"), s["rule"]["base"].alias("base"),
            ),
        )

    return F.flatten(F.transform(around, tried))


def _better(a: Column, b: Column) -> Column:
    """Whether detection a lies around detection b and comes before it."""
    rank = lambda d: F.struct(-d["priority"], d["start"] - d["end"], d["order"])
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"]) & (rank(a) < rank(b))


def _resolved(per_keyword: Column) -> Column:
    """What is left of each keyword's detections beside those of the keywords around it."""
    near = lambda i: F.slice(per_keyword, F.greatest(i - 2 * REACH, F.lit(0)) + 1, 4 * REACH + 1)
    kept = F.transform(
        per_keyword,
        lambda found, i: F.when(
            F.size(found) > 0,
            F.filter(found, lambda d: d["base"] | ~F.exists(near(i), lambda other: F.exists(other, lambda e: _better(e, d)))),
        ).otherwise(found),
    )
    return F.flatten(kept)


def _names(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(documents: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """The documents with n_words, detections, n_base, first_word, last_word, base_labels, labels and score.

    detections holds what wasn't suppressed: start and end in words (from 0, end excluded), order, label, priority, weight
    and base.  n_base, first_word and last_word are of the base phrases' places.  score is the greatest weight.
    """
    found = rules() if found is None else found
    keywords = sorted({r.keyword for r in found})
    others = [c for c in documents.columns if c not in ADDED]
    text = F.col("__row.text").cast("string")
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    n_words = F.when(text.isNull(), 0).otherwise(F.size(_words(text))).cast("long")
    looked = documents.select(F.struct(*others).alias("__row")).select("__row", n_words.alias("n_words"), F.when(text.rlike(_gate(keywords)), _words(lower)).alias("__words"))
    places = F.filter(F.transform("__words", lambda w, i: F.when(w.isin(keywords), i)), lambda i: i.isNotNull())
    anchored = looked.withColumn("__places", places)
    tried = anchored.withColumn("__tried", F.transform("__places", lambda i: _at(F.col("__words"), i, _literal(found))))
    none = F.filter(F.flatten("__tried"), lambda d: F.lit(False))
    kept = tried.withColumn("detections", F.coalesce(F.when(F.exists("__tried", lambda t: F.size(t) > 0), _resolved(F.col("__tried"))), none, F.expr(_EMPTY)))
    base = kept.withColumn("__base", F.filter("detections", lambda d: d["base"]))
    return base.select(
        *(F.col("__row")[c].alias(c) for c in others), "n_words", "detections", F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.col("__base.start")).cast("long").alias("first_word"), F.array_max(F.col("__base.start")).cast("long").alias("last_word"),
        _names(F.col("__base.label")).alias("base_labels"), _names(F.col("detections.label")).alias("labels"),
        F.coalesce(F.array_max(F.col("detections.weight")), F.lit(0.0)).alias("score"),
    )


_EMPTY = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, order: INT, label: STRING, priority: INT, weight: DOUBLE, base: BOOLEAN>>)"


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _values(found: list[Rule]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ",\n".join(f"({r.order}, {quoted(r.label)}, {r.priority}, {r.weight}, {quoted(r.keyword)}, {quoted(r.before)}, {quoted(r.after)}, {r.base})" for r in found)


ORACLE = f"""
WITH r(o, label, priority, weight, keyword, b, a, base) AS (VALUES {_values(rules())}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
p AS (SELECT k, w, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
t AS (SELECT k, word, i, ' ' || array_to_string(w[greatest(i - {REACH}, 0) + 1 : i], ' ') || ' ' AS ahead, ' ' || array_to_string(w[i + 2 : i + {REACH + 1}], ' ') || ' ' AS behind
      FROM p WHERE word IN (SELECT keyword FROM r)),
m AS (SELECT k, i, o, label, priority, weight, base, regexp_extract(ahead, b) AS lead, regexp_extract(behind, a) AS rest FROM t JOIN r ON word = keyword),
f AS (SELECT k, o, label, priority, weight, base, i + 1 - (length(lead) - length(replace(lead, ' ', ''))) AS s, i + length(rest) - length(replace(rest, ' ', '')) AS e
      FROM m WHERE lead <> '' AND rest <> ''),
u AS (SELECT * FROM f WHERE base OR NOT EXISTS (SELECT 1 FROM f g WHERE g.k = f.k AND g.s <= f.s AND g.e >= f.e AND
        (g.priority > f.priority OR (g.priority = f.priority AND (g.e - g.s > f.e - f.s OR (g.e - g.s = f.e - f.s AND g.o < f.o)))))),
x AS (SELECT k, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM u GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN x USING (k)
"""
