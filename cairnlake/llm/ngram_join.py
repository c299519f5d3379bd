"""N-gram Jaccard join: pairs of documents whose sets of word n-grams are alike, by MinHash banding.

1. Every whole text becomes a set of hashed n-grams and, of that, band hashes.  Band and row counts are chosen for a
   target recall at the threshold.  Texts with the same words (by a SHA-256 of them) are one from here on, with a
   count of copies.
2. Band hashes are shuffled; a bucket with several texts ties each to its least one.  The connected components
   of these ties are the units in which candidates are looked for: each text's words travel once to its unit.
3. A large unit is cut into chunks, and every pair of chunks is a task of its own; a unit of very many chunks
   is replaced by its buckets, each of them cut in the same way.  Inside a task, texts that share a band are
   compared on their full sets of n-grams, which are told apart by their bytes, not by hashes.  A pair is counted
   where it first shares a band, so exactly once.
4. Only counts of links and a spanning star of each group leave a task, never the pairs.  Components of the
   stars are the classes.

Nulls and edge cases: a text without words (or null) is in no pair and a class of its own; one of fewer than n
words has all its words as its only n-gram; rows with null doc_id are texts like others, behind all with a doc_id (the
greatest long stands for it), and equal ones count as one document; a class of such rows only has the class_id null; rows that repeat a doc_id and text share that document's class and count as
one in it; different texts under one doc_id are each in the class of their own words, and two classes with the same
least doc_id have the same name, though they stay apart; extra columns are carried along by keep_one().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators.graph import connected_components

from . import textscan as ts
from .shared import checkpoint, join_unique, read, small_batches

WORDS = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold that the bands find, at least; nearer pairs are found more surely.
RECALL = 0.9999
MOST_HASHES = 128
#: Texts and n-grams in a chunk, about; a task holds two chunks.
CHUNK_TEXTS, CHUNK_GRAMS = 1024, 400_000
#: Units are compared together until there are so many texts or bytes.
GO, GO_BYTES = 2048, 4 << 20
#: Units of more chunks than this are compared bucket by bucket; None: as many as there are bands.
MOST_CHUNKS: int | None = None


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands for the recall are within so many hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no bands of {most} hashes reach recall {recall} at {threshold}")
    return best


def gram_sets(buf: np.ndarray, start: np.ndarray, end: np.ndarray, word_off: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of hashed n-grams of each document."""
    symbols = ts.Prefix(ts.hashes(buf, start, end))
    grams = symbols.grams(n)
    out = []
    for lo, hi in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        else:
            out.append(symbols.spans(np.array([lo]), np.array([hi])) if hi > lo else np.zeros(0, np.uint64))
    return out


def exact_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of each text, each once, and the texts' offsets in them; equal exactly where the words are.

    A text of fewer words has one n-gram, which no other text has, as no two texts have the same words.
    """
    start, end, word_off = ts.words(buf, off)
    grams = ts.sequences(ts.identify(buf, start, end)[0], n)
    per = np.maximum(np.diff(word_off) - n + 1, 0)
    short = np.flatnonzero(per == 0)
    row = np.concatenate([np.repeat(np.arange(len(per)), per), short])
    _, number = np.unique(grams[ts.ragged(word_off[:-1], per)], return_inverse=True)
    both = np.unique(row << 40 | np.concatenate([number, len(number) + np.arange(len(short))]))
    return both & (1 << 40) - 1, np.searchsorted(both >> 40, np.arange(len(per) + 1))


def _spans(start: np.ndarray, end: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each document's words, and the one behind them."""
    some = np.diff(word_off) > 0
    first, last = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
    first[some], last[some] = start[word_off[:-1][some]], end[word_off[1:][some] - 1]
    return first, last


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for lo, hi, buf, off in ts.scan(batch.column("text")):
                raw, raw_off = ts.squeeze(buf, off)
                start, end, word_off = ts.words(raw, raw_off)
                sets = gram_sets(raw, start, end, word_off, n)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                sig = np.zeros((len(sets), bands), np.uint64)
                plain = memoryview(np.ascontiguousarray(raw))
                digest = [hashlib.sha256(plain[s:e]).digest() for s, e in zip(*(x.tolist() for x in _spans(start, end, word_off)), strict=True)]
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    at = np.cumsum(size[some]) - size[some]
                    for b in range(bands):
                        key = np.zeros(len(some), np.uint64)
                        for r in range(rows):
                            key = ts.mix(key + np.minimum.reduceat(flat * factors[b * rows + r], at))
                        sig[some, b] = key
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array(size),
                        pa.array(digest, pa.binary()),
                        ts.lists(sig.view(np.int64).ravel(), np.arange(len(sets) + 1) * bands),
                    ],
                    ["doc_id", "text_key", "n_grams", "digest", "bands"],
                )

    return run


SHIPPED = ["unit", "band", "chunk", "node", "copies", "bands", "low", "high", "words"]


def _shipper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts, joined by spaces, once for each pair of chunks that they are in."""
    for whole in batches:
        keys = np.stack([whole.column(c).to_numpy() for c in ("unit", "band", "node")], 1)
        batch = whole.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))  # without rows that repeat a doc_id and text
        for lo, hi, buf, off in ts.scan(batch.column("text")):
            raw, raw_off = ts.squeeze(buf, off)
            first, last = _spans(*ts.words(raw, raw_off))
            k = batch.column("chunks").to_numpy()[lo:hi]
            row = np.repeat(np.arange(hi - lo), k)
            other = ts.ragged(np.zeros(hi - lo, np.int64), k)
            own = batch.column("chunk").to_numpy()[lo:hi][row]
            for part in np.array_split(np.arange(len(row)), max(1, int((last - first)[row].sum()) >> 22)):
                r = row[part]
                low, high = np.minimum(own[part], other[part]), np.maximum(own[part], other[part])
                columns = [*(batch.column(c).take(pa.array(lo + r)) for c in SHIPPED[:6]), pa.array(low), pa.array(high), ts.strings(raw, first[r], last[r] - first[r])]
                yield pa.RecordBatch.from_arrays(columns, SHIPPED)


def _pairs(band_keys: np.ndarray, unit: np.ndarray, only: np.ndarray, chunk: np.ndarray, cross: np.ndarray):
    """Pairs of rows that first share a band here; both in one chunk, or for a cross unit in both."""
    for b in range(band_keys.shape[1]):
        rows = np.flatnonzero((only < 0) | (only == b))
        order = rows[np.lexsort((band_keys[rows, b], unit[rows]))]
        u, k = unit[order], band_keys[order, b]
        step = 1
        at = np.arange(len(order) - 1)
        while len(at := at[at + step < len(order)]):
            at = at[(u[at] == u[at + step]) & (k[at] == k[at + step])]
            if not len(at):
                break
            i, j = order[at], order[at + step]
            keep = (chunk[i] != chunk[j]) == cross[i]
            i, j = i[keep], j[keep]
            if b and len(i):
                new = ~(band_keys[i, :b] == band_keys[j, :b]).any(1)
                i, j = i[new], j[new]
            if len(i):
                yield i, j
            step += 1


def _verifier(n: int, threshold: float):
    def compare(units: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(units).combine_chunks()
        col = {c: table[c].to_numpy() for c in ("unit", "band", "chunk", "node", "copies", "low", "high")}
        _, unit = np.unique(np.stack([col["unit"], col["low"], col["high"]]), axis=1, return_inverse=True)
        unit = unit.ravel()
        first = np.unique(np.stack([unit, col["node"]]), axis=1, return_index=True)[1]  # rows that repeat a doc_id and text
        table, unit, col = table.take(pa.array(first)), unit[first], {c: v[first] for c, v in col.items()}
        bands = _flat(table["bands"])[0].reshape(len(first), -1)
        ids, off = exact_sets(*ts.utf8(table["words"].combine_chunks().cast(pa.large_binary()).view(pa.large_string())), n)
        size = np.diff(off)
        found = [(i, j) for i, j in _pairs(bands, unit, col["band"], col["chunk"], col["low"] != col["high"])]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[near], j[near]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        flag = np.zeros(len(ids) + len(first) + 1, bool)
        shared = np.zeros(len(i), np.int64)
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(0, np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = ids[off[i[a]] : off[i[a] + 1]]
            flag[own] = True
            other = j[a:z]
            many = size[other]
            shared[a:z] = np.add.reduceat(flag[ids[ts.ragged(off[other], many)]].astype(np.int64), np.cumsum(many) - many)
            flag[own] = False
        good = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
        i, j = i[good], j[good]
        texts, docs = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for a, b in ((i, j), (j, i)):
            np.add.at(texts, a, 1)
            np.add.at(docs, a, col["copies"][b])
        root = col["node"].copy()
        while len(i):
            low = np.minimum(root[i], root[j])
            if (low == root[i]).all() and (low == root[j]).all():
                break
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        hit = np.flatnonzero(texts)
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (col["node"], root, texts, docs)], ["node", "root", "n_texts", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, size, last = 0, 0, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("unit", "low", "high")], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
            at = 0
            for edge in [*([0] if last is not None and len(keys) and tuple(keys[0]) != last else []), *edges, len(keys)]:
                # edge: where a new unit begins; whole units are compared when there are enough rows
                if edge > at:
                    held.append(batch.slice(at, edge - at))
                    rows, size = rows + edge - at, size + held[-1].nbytes
                if edge < len(keys) and (rows >= GO or size >= GO_BYTES):
                    yield compare(held)
                    held, rows, size = [], 0, 0
                at = edge
            if len(keys):
                last = tuple(keys[-1])
        if held:
            yield compare(held)
        ts.give_back()

    return run


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[off[0] : off[-1]], off - off[0]


#: Stands for a null doc_id, behind any other.
NO_ID = (1 << 63) - 1


def _own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _text_key() -> Column:
    """What tells the texts of one doc_id apart; never null."""
    return F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))


def join(documents: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links (other documents it is alike to), n_texts (other texts), n_copies (with its words)."""
    found = _classes(documents.select(_own_id().alias("doc_id"), "text"), n, threshold, recall)
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return found.select(real("doc_id"), real("class_id"), "n_links", "n_texts", "n_copies")


def _classes(documents: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """The columns of join(), the text_key of each row, and class_node: one for each class, null for a text without words.

    A node is a number given to each sequence of words, so that two never share one.
    """
    small_batches(documents.sparkSession)
    bands, rows = bands_for(threshold, recall)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key().alias("text_key")).where("doc_id IS NOT NULL")
    signed = checkpoint(docs.mapInArrow(_signer(n, bands, rows), "doc_id long, text_key string, n_grams long, digest binary, bands array<long>"))
    same = checkpoint(signed.where("n_grams > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count_distinct("doc_id").alias("copies"), F.count("*").alias("n_rows")).withColumn("node", F.monotonically_increasing_id()))
    texts = signed.join(same.select(F.col("least_id").alias("doc_id"), "digest", "copies", "node"), ["doc_id", "digest"]).select("node", "doc_id", "text_key", "n_grams", "copies", "bands").dropDuplicates(["node"])
    texts = checkpoint(texts)

    in_band = texts.select("node", F.posexplode("bands").alias("band", "hash")).select("node", "band", F.xxhash64("band", "hash").alias("bucket"))
    buckets = in_band.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    ties = join_unique(in_band, buckets, "bucket", "n", "node", store=True)
    units = checkpoint(connected_components(ties.where("node > least"), "node", "least"))

    members = texts.join(units, "node")
    chunk_count = F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n_grams") / CHUNK_GRAMS)).alias("chunks")
    sizes = members.groupBy("component").agg(chunk_count, F.count("*").alias("n"))
    placed = checkpoint(join_unique(members, sizes, "component", "n", "node", store=True))
    most = bands if MOST_CHUNKS is None else MOST_CHUNKS
    whole = placed.where(F.col("chunks") <= most).select("node", "doc_id", "text_key", "copies", "bands", F.col("component").alias("unit"), F.lit(-1).alias("band"), "chunks")
    # Units of more chunks than there are bands are cheaper bucket by bucket.
    if (placed.agg(F.max("chunks")).first()[0] or 0) > most:
        vast = placed.where(F.col("chunks") > most)
        in_bucket = vast.select("node", "doc_id", "text_key", "copies", "bands", "n_grams", F.posexplode("bands").alias("band", "hash")).withColumn("unit", F.xxhash64("band", "hash"))
        per_bucket = in_bucket.groupBy("unit").agg(chunk_count, F.count("*").alias("n")).where("n > 1")
        split = join_unique(in_bucket, per_bucket, "unit", "n", "node", store=True).select("node", "doc_id", "text_key", "copies", "bands", "unit", "band", "chunks")
        whole = whole.unionByName(split)
    tasks = whole.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))

    wanted = docs.join(tasks.hint("shuffle_hash"), ["doc_id", "text_key"])
    shipped = wanted.select(
        F.col("unit").cast("long"), F.col("band").cast("int"), F.col("chunk").cast("long"), F.col("chunks").cast("long"), "node", F.col("copies").cast("long"), "bands", "text"
    ).mapInArrow(_shipper, "unit long, band int, chunk long, node long, copies long, bands array<long>, low long, high long, words binary")
    dealt = shipped.repartition("unit", "low", "high").sortWithinPartitions("unit", "low", "high")
    found = checkpoint(dealt.mapInArrow(_verifier(n, threshold), "node long, root long, n_texts long, n_links long"))

    classes = connected_components(found, "node", "root")
    members = classes.join(same.select("node", "least_id"), "node")
    names = members.groupBy("component").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n"))
    named = join_unique(members, names, "component", "n", "node", store=True).select("node", "component", "class_id")
    counts = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("n_links"))
    info = same.join(counts, "node", "left").join(named, "node", "left").select(
        "digest", "copies", "n_rows", F.coalesce("component", "node").alias("class_node"), F.coalesce("class_id", "least_id").alias("class_id"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    worded = join_unique(signed.where("n_grams > 0").select("doc_id", "text_key", "digest"), info, "digest", "n_rows", "doc_id", store=True)
    out = worded.select("doc_id", "text_key", "class_node", "class_id", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "n_texts", F.col("copies").alias("n_copies"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = signed.where("n_grams = 0").select(
        "doc_id", "text_key", F.lit(None).cast("long").alias("class_node"), F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_texts"), one.alias("n_copies")
    )
    return out.unionByName(alone)


def keep_one(documents: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The text of each class with the least doc_id (and of its texts, digest), with all its columns.

    A row goes only if the class of its own text has another row that stays.
    """
    # Read three times below: stored, so that neither the work nor the plan is made three times.
    rows = checkpoint(_classes(documents.select(_own_id().alias("doc_id"), "text"), n, threshold, RECALL).select("doc_id", "text_key", "class_node"))
    least = rows.where("class_node IS NOT NULL").groupBy("class_node").agg(F.min(F.struct("doc_id", "text_key")).alias("kept")).select("kept.*")
    kept = least.unionByName(rows.where("class_node IS NULL").select("doc_id", "text_key").distinct()).toDF("kept_id", "kept_key")
    # The caller's columns travel as one, so that none can clash with the names used here.
    keyed = documents.select(F.struct(*documents.columns).alias("row"), _own_id().alias("own_id"), _text_key().alias("text_key"))
    one = keyed.join(kept.hint("shuffle_hash"), (F.col("own_id") == F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi").dropDuplicates(["own_id", "text_key"])
    return one.select(*(F.col("row")[c].alias(c) for c in documents.columns))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
