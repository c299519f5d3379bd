"""Substring dedup: words that an earlier document already has in a window of 13 words.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as one packed string to the
minimiser's bucket, where sorting brings equal windows together, compared word by word, and tells the least doc_id
of each (see windows.py).  A word goes if a window over it also starts in a document with a smaller doc_id.

Nulls and edge cases: a null or empty text has no words; texts under 13 words lose nothing; a null doc_id counts
as smaller than all others; rows with the same doc_id don't take words from each other; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from . import windows as wn
from .shared import read

WIDTH, GRAM = 13, 4
#: Occurrences of a minimiser that its bucket takes, at most (see windows.py): as many strings as are sorted in one go, with
#: eight bytes to a word.
MOST = wn.GO_BYTES // (2 * 8 * WIDTH)


def word_symbols(buf: np.ndarray, off: np.ndarray):
    raw, off = ts.squeeze(buf, off)
    start, end, word_off = ts.words(raw, off)
    return raw, ts.hashes(raw, start, end), word_off, start, end


WORDS = wn.Kind(WIDTH, GRAM, word_symbols, MOST)


def least_by_window(buf: np.ndarray, off: np.ndarray, bucket: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string, the least doc_id that has it."""
    start, end, word_off = ts.words(buf, off)
    word, _ = ts.identify(buf, start, end)
    per = np.diff(word_off) - WIDTH + 1
    row = np.repeat(np.arange(len(per)), per)
    at = ts.ragged(word_off[:-1], per)
    if not len(at):
        return np.zeros(0, np.int64), np.r_[0, np.cumsum(per)]
    # Windows are sorted by fingerprint, and neighbours that agree are compared word by word; should two different
    # ones share a fingerprint, the windows are sorted by their words instead.
    key = ts.Prefix(ts.mix(word.astype(np.uint64))).spans(at, at + WIDTH)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    if any((word[at[order][1:] + k] != word[at[order][:-1] + k])[~new[1:]].any() for k in range(WIDTH)):
        columns = np.stack([word[at + k] for k in range(WIDTH)])
        order = np.lexsort(columns)
        new = np.r_[True, (columns[:, order[1:]] != columns[:, order[:-1]]).any(0)]
    new = np.flatnonzero(new)
    low = np.minimum.reduceat(least[row[order]], new)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(low, np.diff(np.r_[new, len(order)]))
    return out, np.r_[0, np.cumsum(per)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        owner, place, marks, mark_off = wn.places(batch.column("found"), ids)
        for lo, hi, buf, off in ts.scan(batch.column("text")):
            raw, sq_off = ts.squeeze(buf, off)
            start, end, word_off = ts.words(raw, sq_off)
            a, z = np.searchsorted(owner, [lo, hi])
            size = np.diff(mark_off[a : z + 1])
            doc = np.repeat(owner[a:z], size)
            hit = np.flatnonzero(marks[mark_off[a] : mark_off[z]] < ids[doc])
            first = (word_off[owner[a:z] - lo] + place[a:z]).repeat(size)[hit] + ts.ragged(np.zeros(z - a, np.int64), size)[hit]
            gone = np.bincount(first, minlength=len(start) + 1) - np.bincount(first + WIDTH, minlength=len(start) + 1)
            lost = np.cumsum(gone[: len(start)]) > 0
            removed = ts.per_document(lost, word_off)
            # Kept words with one space behind each; the last space of a text goes.
            flags = np.zeros(len(raw) + 1, np.int64)
            flags[start[lost]] = 1
            flags[end[lost]] -= 1
            keep = np.cumsum(flags[:-1]) == 0
            behind = end[lost][end[lost] < len(raw)]
            keep[behind[raw[behind] == 32]] = False
            text, text_off = raw[keep].tobytes(), np.r_[0, np.cumsum(keep)][sq_off].tolist()
            left = [text[s:e].rstrip(b" ") for s, e in zip(text_off[:-1], text_off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    wn.doc_ids(ids[lo:hi]), pa.array(np.diff(word_off)), pa.array(removed),
                    pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), pa.array(left, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept, the words that are left, joined by spaces."""
    docs, found = wn.occurrences(documents, WORDS, least_by_window, within=False)
    found = found.where(F.exists("marks", lambda m: m < F.col("id"))).groupBy("rid").agg(F.collect_set(F.struct("id", "start", "marks")).alias("found"))
    return docs.join(found.hint("shuffle_hash"), "rid", "left").select("id", "text", "found").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).drop("kept")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k : k + {WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS k FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(k, k + {WIDTH})) AS j FROM x JOIN m USING (s) WHERE least < doc_id) GROUP BY doc_id),
p AS (SELECT doc_id, len(w) AS n, len(coalesce(gone, [])) AS lost, list_filter(w, lambda v, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(lost AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM p
"""
