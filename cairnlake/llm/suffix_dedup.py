"""Suffix-array dedup: bytes under strings of 200 bytes that start at more than one place in the corpus.

Only suffixes that may repeat are sorted: windows whose minimiser occurs twice (see windows.py) meet in the
minimiser's bucket, where deep-shallow sorting (multikey quicksort, then blind tries) brings equal prefixes of
200 bytes together.

Nulls and edge cases: a null text is empty; texts under 200 bytes lose nothing; places in one document count,
overlapping ones too; repeated rows are separate documents, and so lose all that is long enough; a null doc_id
is carried through; extra columns are ignored; bytes that are left may end inside a character.
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
from .deep_shallow import classes
from .shared import read

WIDTH, GRAM = 200, 64
#: Occurrences of a minimiser that its bucket takes, at most (see windows.py): as many strings as are sorted in one go.
MOST = wn.GO_BYTES // (2 * WIDTH)


def byte_symbols(buf: np.ndarray, off: np.ndarray):
    at = np.arange(len(buf) + 1)
    return buf, buf, off, at[:-1], at[1:]


BYTES = wn.Kind(WIDTH, GRAM, byte_symbols, MOST)


def repeated_windows(buf: np.ndarray, off: np.ndarray, bucket: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string, the first and one past the last of each run of its windows that occur twice or more."""
    per = np.diff(off) - WIDTH + 1
    row = np.repeat(np.arange(len(per)), per)
    at = ts.ragged(off[:-1], per)
    _, crowd = np.unique(bucket, return_inverse=True)
    alone = (np.bincount(crowd)[crowd] == 1) & (n > 1)
    sort = np.flatnonzero(~alone[row])
    twice = alone[row]
    if len(sort):
        kind = classes(buf, at[sort], bucket[row[sort]], WIDTH)
        twice[sort] = np.bincount(kind, n[row[sort]], len(sort))[kind] > 1.5
    ends = np.r_[0, np.cumsum(per)]
    edge = np.zeros(len(twice) + 1, bool)
    edge[ends[:-1]] = True
    begins = np.flatnonzero(twice & np.r_[True, ~twice[:-1] | edge[1:-1]]) if len(twice) else np.zeros(0, np.int64)
    stops = np.flatnonzero(twice & np.r_[~twice[1:] | edge[1:-1], True]) if len(twice) else begins
    owner = row[begins]
    flat = np.stack([begins - ends[owner], stops + 1 - ends[owner]], 1).ravel()
    return flat, 2 * np.searchsorted(begins, ends)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        owner, place, marks, mark_off = wn.places(batch.column("found"), ids)
        for lo, hi, buf, off in ts.scan(batch.column("text")):
            a, z = np.searchsorted(owner, [lo, hi])
            base = (off[owner[a:z] - lo] + place[a:z]).repeat(np.diff(mark_off[a : z + 1]))
            ends = (base + marks[mark_off[a] : mark_off[z]]).reshape(-1, 2)
            gone = np.bincount(ends[:, 0], minlength=len(buf) + 1) - np.bincount(ends[:, 1] + WIDTH - 1, minlength=len(buf) + 1)
            lost = np.cumsum(gone[: len(buf)]) > 0
            removed = ts.per_document(lost, off)
            edge = np.zeros(len(buf) + 1, bool)
            edge[off] = True
            begins = np.flatnonzero(lost & np.r_[True, ~lost[:-1] | edge[1:-1]]) if len(buf) else np.zeros(0, np.int64)
            stops = np.flatnonzero(lost & np.r_[~lost[1:] | edge[1:-1], True]) + 1 if len(buf) else begins
            per = np.searchsorted(begins, off)
            flat = np.stack([begins, stops], 1) - np.repeat(off[:-1], np.diff(per))[:, None]
            text, text_off = buf[~lost].tobytes(), np.r_[0, np.cumsum(~lost)][off].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    wn.doc_ids(ids[lo:hi]), pa.array(np.diff(off)), pa.array(removed), pa.array(np.diff(per)),
                    pa.array([hashlib.sha256(text[s:e]).hexdigest() for s, e in zip(text_off[:-1], text_off[1:], strict=True)], pa.string()),
                    ts.lists(flat.ravel(), 2 * per, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )


def find_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans: starts and ends of the removed runs in turn."""
    docs, found = wn.occurrences(documents, BYTES, repeated_windows, within=True)
    found = found.groupBy("rid").agg(F.collect_set(F.struct("id", "start", "marks")).alias("found"))
    return docs.join(found.hint("shuffle_hash"), "rid", "left").select("id", "text", "found").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    )


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(read(spark, sf_dir, "documents")).drop("spans")
