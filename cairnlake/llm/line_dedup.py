"""Line dedup: chunks of lines that the corpus has already, with boundaries that the lines themselves choose.

A rolling hash runs over the hashes of every ``least`` visible lines in a row.  Where its value occurs earlier in the corpus,
the lines belong to a repeated chunk; the chunk goes on as long as that holds, and its boundaries are where it ends, so an
inserted or deleted line only moves the boundaries beside it, and a passage of ``least`` lines between foreign ones is a chunk
of its own.  The bytes of the lines of such windows are compared by grouping on the lines themselves.  Of equal windows the
first by (doc_id, place in the document) stays; a line goes if any window over it isn't the first.

Values are counted with a combine before the shuffle, and their places looked up by a join that salts frequent ones, so a
passage that a third of all documents has is no burden.

Nulls and edge cases: a null text has no lines and stays null; an empty text is one empty line; lines without a visible
character belong to no window, and go only between two lines of a removed one; so a chunk of fewer than ``least`` visible lines
is never removed; a row is known by its doc_id and a digest of its text, so repeated rows are treated alike, and different texts
under one doc_id (or a null one) by themselves, in the order of their digests; a null doc_id comes before all others; windows
with a line whose hash some other line shares all stay; extra columns are carried through, whatever their names, but for the
four that the operator adds, which replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, join_unique, read

#: Visible lines in a row that the corpus must have already, at least, to be removed.
LEAST_LINES = 2


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _same_row(doc_id: str, digest: str) -> Column:
    """Whether a row of documents is the one of these columns."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (_digest(F.col("text")) == F.col(digest))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _visible(lines: Column) -> Column:
    """Line and its number, from 0, of the lines with a visible character."""
    return F.filter(F.transform(lines, lambda x, at: F.struct(x.alias("line"), at.alias("at"))), lambda x: x["line"].rlike("[^ \t\n\r]"))


def windows(documents: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """(doc_id, digest, i, key): for each window its number among the document's and the hashes of its lines."""
    hashed = documents.where("text IS NOT NULL").select("doc_id", _digest(F.col("text")).alias("digest"), F.transform(_visible(_lines(F.col("text"))), lambda x: F.xxhash64(x["line"])).alias("h"))
    rolled = F.transform(F.sequence(F.lit(1), F.size("h") - least + 1), lambda i: F.slice("h", i, least))
    return hashed.where(F.size("h") >= least).select("doc_id", "digest", F.posexplode(rolled).alias("i", "key"))


def repeated(documents: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """(doc_id, digest, gone): the numbers of the windows, from 0, that repeat an earlier one."""
    docs = documents.select("doc_id", "text")
    keys = windows(docs, least)
    place = F.struct("doc_id", "digest", "i")
    twice = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    found = join_unique(keys, twice, "key", "n", "doc_id", store=True)
    places = checkpoint(found.select("doc_id", "digest", "i", "key", (~place.eqNullSafe(F.col("first"))).alias("again")))
    # The bytes: lines of such windows meet in one group by hash and line, which is combined before the shuffle.
    held = places.groupBy(F.col("doc_id").alias("held_id"), F.col("digest").alias("held_digest")).agg(F.collect_set("i").alias("held"))
    both = docs.join(held.hint("shuffle_hash"), _same_row("held_id", "held_digest")).select(_visible(_lines(F.col("text"))).alias("v"), "held")
    covered = F.array_distinct(F.flatten(F.transform("held", lambda i: F.sequence(i, i + least - 1))))
    lines = both.select(F.explode(F.transform(covered, lambda j: F.get("v", j)["line"])).alias("line")).select(F.xxhash64("line").alias("h"), "line")
    shared = checkpoint(lines.groupBy("h", "line").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
    if not shared.isEmpty():
        unsure = places.select("key").distinct().select("key", F.explode("key").alias("h")).join(shared, "h").select("key").distinct()
        places = places.join(unsure, "key", "left_anti")
    return places.where("again").groupBy("doc_id", "digest").agg(F.collect_set("i").alias("gone"))


#: The columns that dedup_lines() adds.
COUNTS = ("n_lines", "n_chunks", "removed_chunks", "removed_lines")


def dedup_lines(documents: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """The documents, with the text that is left, and n_lines, n_chunks (runs of lines that stay or go), removed_chunks, removed_lines."""
    if least < 1:
        raise ValueError("windows have lines")
    removed = repeated(documents, least).select(F.col("doc_id").alias("removed_id"), F.col("digest").alias("removed_digest"), "gone")
    # The caller's columns travel as one, so that none can clash with the names used here.
    others = [c for c in documents.columns if c not in ("text", *COUNTS)]
    rows = documents.select("doc_id", "text", F.struct(*others).alias("row"))
    joined = rows.join(removed.hint("shuffle_hash"), _same_row("removed_id", "removed_digest"), "left").select("row", "text", _lines(F.col("text")).alias("lines"), "gone")
    some = F.col("gone").isNotNull()
    v = joined.withColumn("at", F.when(some, F.transform(_visible(F.col("lines")), lambda x: x["at"])))
    # From the first to the last line of each removed window, blank ones between included.
    out = F.array_distinct(F.flatten(F.transform("gone", lambda i: F.sequence(F.get("at", i), F.get("at", i + least - 1)))))
    cut = v.withColumn("out", F.array_sort(out))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    cut = cut.withColumn("left", F.when(some, left))
    runs = lambda c: F.size(F.filter(F.col(c), lambda x, k: (k == 0) | (F.get(F.col(c), k - 1) != x - 1)))
    text = F.when(some, F.array_join(F.transform("left", lambda j: F.get("lines", j)), "\n")).otherwise(F.col("text"))
    there = F.col("text").isNotNull()
    counts = (
        F.when(there, F.size("lines")).otherwise(0),
        F.when(some, runs("out") + runs("left")).otherwise(there.cast("int")),
        F.when(some, runs("out")).otherwise(0),
        F.when(some, F.size("out")).otherwise(0),
    )
    columns = (*(F.col("row")[c].alias(c) for c in others), text.alias("text"), *(n.cast("long").alias(c) for c, n in zip(COUNTS, counts, strict=True)))
    # As rows of a generator, so that a filter on the new text isn't pushed below it, where Catalyst would write
    # out the whole expression again.
    return cut.select(F.inline(F.array(F.struct(*columns))))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"))


ORACLE = f"""
WITH l AS (SELECT doc_id, x AS line, no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL)),
v AS (SELECT doc_id, no, line, lead(line, {LEAST_LINES - 1}) OVER w AS next, lead(no, {LEAST_LINES - 1}) OVER w AS upto FROM l WHERE regexp_matches(line, '[^ \\t\\n\\r]') WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
g AS (SELECT doc_id, no, upto FROM v WHERE next IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, next ORDER BY doc_id, no) > 1),
o AS (SELECT DISTINCT doc_id, unnest(range(no, upto + 1)) AS no FROM g),
m AS (SELECT l.doc_id, l.no, l.line, o.no IS NOT NULL AS gone FROM l LEFT JOIN o ON o.doc_id = l.doc_id AND o.no = l.no),
r AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY no) <> gone, true) AS new FROM m),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE new) AS n_chunks, count(*) FILTER (WHERE new AND gone) AS removed_chunks, count(*) FILTER (WHERE gone) AS removed_lines,
        coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks,
  CAST(coalesce(removed_chunks, 0) AS BIGINT) AS removed_chunks, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines,
  CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN s USING (doc_id)
"""
