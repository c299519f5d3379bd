"""Quality rules: document statistics, hard rules over them, and gradient-boosted trees for the rest.

The statistics are computed for every whole text in one vectorised pass without a shuffle.  The trees are
fitted on a bounded sample of labelled documents (``SAMPLE`` rows, the smallest hashes of doc_id, so the same
at every run), flattened into node arrays and applied in the same pass.

Nulls and edge cases: a null text has no words and fails the base rules; documents with null doc_id are kept as
rows; repeated rows get equal verdicts; labels with null quality, null doc_id or without a document are left
out; a labelled doc_id over several texts is fitted on one of them; without labels of both kinds every document that
passes the base rules is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .boosting import Trees, fit
from .shared import read, small_batches

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
#: A document is kept if the trees give it this probability of good quality or more.
THRESHOLD = 0.5
#: Words in a document and per cent of words in repeated windows, beyond which the base rules reject it.
LEAST_WORDS, MOST_REPEATED = 50, 50

FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "upper_share",
    "punct_share", "distinct_share", "line_words", "mark_end_share", "high_share",
)
#: The score may only fall as these rise.
MONOTONE = {FEATURES.index(f): -1 for f in ("symbol_share", "dup_line_share", "repeat_share")}

_SYMBOL, _DIGIT, _UPPER, _PUNCT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_PUNCT[list(b".,;:!?'\"()-")] = True


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The statistics of some documents, and the features of the trees."""
    docs = len(off) - 1
    start, end, word_off = ts.words(buf, off)
    n_words = np.diff(word_off)
    lead = (buf & 0xC0) != 0x80
    solid = ~ts.SPACE[buf]
    doc_of = np.repeat(np.arange(docs), n_words)

    newline = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([off[:-1], newline + 1]))
    line_end = np.sort(np.concatenate([newline, off[1:]]))
    held = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[held], line_end[held]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    key, _ = ts.identify(buf, line_start, line_end)
    order = np.lexsort((key, line_doc))
    again = (key[order][1:] == key[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    n_dup = np.bincount(line_doc[order][1:][again], minlength=docs)

    # Numbers of each document's own words, so that windows of them never agree across documents.
    number, _ = ts.identify(buf, start, end)
    _, first, word = np.unique(doc_of << 40 | number, return_index=True, return_inverse=True)
    distinct = np.zeros(len(word), bool)
    distinct[first] = True
    covered = np.zeros(len(word) + 3, bool)
    if len(word) >= 3:
        at = np.flatnonzero(doc_of[2:] == doc_of[:-2])
        twice = at[_repeated(ts.sequences(word, 3)[at])]
        for k in range(3):
            covered[twice + k] = True
    n_repeat = ts.per_document(covered[: len(word)], word_off)

    count = {
        "n_words": n_words,
        "word_chars": ts.per_document(lead & solid, off),
        "n_symbols": ts.per_document(_SYMBOL[buf], off),
        "n_dup_lines": n_dup.astype(np.int64),
        "n_repeat_words": n_repeat,
    }
    chars = np.maximum(ts.per_document(lead, off), 1)
    some = np.maximum(n_words, 1)
    lines = np.bincount(line_doc, minlength=docs)
    last = buf[end - 1] if len(end) else np.zeros(0, np.uint8)
    share = lambda flags: ts.per_document(flags[buf], off) / chars
    x = np.stack(
        [
            np.log1p(n_words), count["word_chars"] / some, count["n_symbols"] / chars, n_dup / np.maximum(lines, 1), n_repeat / some,
            share(_DIGIT), share(_UPPER), share(_PUNCT), ts.per_document(distinct, word_off) / some, n_words / np.maximum(lines, 1),
            ts.per_document(_SYMBOL[last], word_off) / some, ts.per_document(buf >= 0xC0, off) / chars,
        ],
        1,
    )
    return count, x


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs at least twice."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text, quality = batch.column("doc_id").cast(pa.int64()), batch.column("text"), batch.column("quality")
        for lo, hi, buf, off in ts.scan(text):
            count, x = statistics(buf, off)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(_base_failed(count)), pa.array(list(x), pa.list_(pa.float64())), quality.slice(lo, hi - lo)], ["doc_id", "failed", "x", "quality"]
            )


def _base_failed(count: dict[str, np.ndarray]) -> np.ndarray:
    return (count["n_words"] < LEAST_WORDS) | (100 * count["n_repeat_words"] > MOST_REPEATED * count["n_words"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit the trees on at most so many labelled documents that pass the base rules."""
    small_batches(documents.sparkSession)
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # The ids are at most `sample` rows, so broadcasting them is bounded whatever the corpus; a doc_id that stands
    # over several rows is fitted on one of them, so the rows that come to the driver are bounded too.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    seen = rows.mapInArrow(_features, "doc_id long, failed boolean, x array<double>, quality int").where("NOT failed")
    got = seen.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality")).orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y = got["quality"].to_numpy(float)
    if len(np.unique(y)) < 2:
        return _constant(1.0)
    return fit(x, y, MONOTONE)


def _constant(value: float) -> Trees:
    none = np.zeros(0, np.int32)
    return Trees(none, none.astype(float), none, none, none.astype(float), none, 0, 20.0 if value else -20.0)


def judge(documents: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics and verdict of every document: doc_id, the counts, base_failed, score and kept."""
    small_batches(documents.sparkSession)
    cut = documents.sparkSession.sparkContext.broadcast(model)  # a few thousand nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = cut.value
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            for lo, hi, buf, off in ts.scan(text):
                count, x = statistics(buf, off)
                failed = _base_failed(count)
                score = trees.probability(x)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *map(pa.array, count.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                    ["doc_id", *count, "base_failed", "score", "kept"],
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    )


def keep_good(documents: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that judge() keeps, with all their columns and without a shuffle."""
    small_batches(documents.sparkSession)
    cut = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, buf, off in ts.scan(batch.column(batch.schema.get_field_index("text"))):
                count, x = statistics(buf, off)
                keep[lo:hi] = ~_base_failed(count) & (cut.value.probability(x) >= threshold)
            yield batch.filter(pa.array(keep))
        ts.give_back()

    return documents.mapInArrow(run, documents.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return judge(documents, train(documents, read(spark, sf_dir, "labels")))
