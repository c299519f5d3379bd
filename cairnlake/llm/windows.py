"""Windows of symbols that occur elsewhere in the corpus, counted bucket by bucket.

A text is a sequence of symbols (bytes or words).  The least fingerprint among the k-grams of a window is
its minimiser, so equal windows have equal minimisers wherever they stand.  Consecutive windows with the same
minimiser form a run, which travels as one packed string.

1. Minimisers are shuffled by value and counted in sorted order.  One that was seen once can't belong to a
   repeated window, so its runs never travel.  A value that many texts of one batch have is not shuffled by
   value but told on the spot, with one row that makes the value frequent wherever else it is counted; so no task
   gets all rows of a frequent value.
2. Runs with a repeated minimiser are packed and sent to its bucket, where an operator's own sorter marks
   windows, from their bytes.
3. Runs with a very frequent minimiser are cut further, by the greatest fingerprint of each window, and go to
   buckets of both values.  Equal strings are counted as one before and after the shuffle, so a bucket has one
   row for each different string; the same sorter marks them, and the marks are joined back to the places.

Fingerprints only choose buckets; which windows are equal is for the sorter, which compares bytes.  A row is known
by a hash of doc_id and text, and rows that repeat both are packed once, with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import checkpoint, small_batches

#: Stands for a null doc_id, and sorts before any other.
NO_ID = -(1 << 63)
#: Packed bytes that are sorted in one go, about.
GO_BYTES = 4 << 20

#: What a sorter gets: bytes of strings, their offsets, bucket, count and least doc_id of each; it returns a
#: flat array of marks and the strings' offsets in it.
Sorter = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """How texts become symbols, and how wide windows and k-grams are."""

    width: int
    gram: int
    #: bytes and offsets to: bytes to pack, symbols, documents' offsets in them, starts and ends of symbols.
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: Minimisers with more occurrences are very frequent.
    most: int


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, by minima from both ends of blocks."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def minimisers(kind: Kind, symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-grams' fingerprints, each window's least one, and whether a window lies in one document."""
    grams = ts.Prefix(symbols, 1).grams(kind.gram)
    least = sliding_min(grams, kind.width - kind.gram + 1)
    edge = np.zeros(len(least) + 1, np.int64)
    lo, hi = off[:-1], off[1:] - kind.width + 1
    some = hi > lo
    np.add.at(edge, lo[some], 1)
    np.add.at(edge, hi[some], -1)
    return grams, least, np.cumsum(edge[:-1]) > 0


def runs(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run; documents are at least one invalid window apart."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) - start + 1


#: A value that so many texts of one batch have is very frequent.
CROWD = 32
#: In place of n: the value is very frequent, so its rows needn't meet; and what says so to rows that do.
SPREAD, SUMMARY = 0, -1


def _values(kind: Kind, within: bool, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, minimiser, its number among the text's minimisers by value, and n, which counts places where places in
    one text count, and is 1 elsewhere."""
    _, symbols, sym_off, _, _ = kind.symbols(buf, off)
    grams, least, valid = minimisers(kind, symbols, sym_off)
    if within:
        # A k-gram is a minimiser if it equals the greatest of the minima of the windows around it.
        w = kind.width - kind.gram + 1
        held = np.zeros(len(least) + 2 * (w - 1), np.uint64)
        held[w - 1 : w - 1 + len(least)] = np.where(valid, least, np.uint64(0))
        at = np.flatnonzero(grams == ~sliding_min(~held, w)) if len(least) else np.zeros(0, np.int64)
        value = grams[at]
    else:
        at, _ = runs(least, valid)
        value = least[at]
    doc = np.searchsorted(sym_off, at, "right") - 1
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(value) else np.zeros(0, np.int64)
    n = np.minimum(np.diff(np.r_[new, len(value)]), 2) if within else np.ones(len(new), np.int64)
    doc, value = doc[new], value[new]
    return doc, value, np.arange(len(doc)) - np.searchsorted(doc, doc), n


SEEN = "place long, rid long, number int, n int"


def _count(kind: Kind, within: bool):
    """The minimisers of each row, and where to send them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            got = [(lo + doc, value, number, n) for lo, _, buf, off in ts.scan(batch.column("text")) for doc, value, number, n in [_values(kind, within, buf, off)]]
            if not got:
                continue
            doc, value, number, n = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(value, kind="stable")
            new = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]]) if len(value) else np.zeros(0, np.int64)
            size = np.diff(np.r_[new, len(value)])
            crowded = np.zeros(len(value), bool)
            crowded[order] = np.repeat(size >= CROWD, size)
            rows, many = rid[doc], value[order[new[size >= CROWD]]]
            place = np.where(crowded, ts.mix(value + rows.view(np.uint64)), value)
            none = np.zeros(len(many), np.int64)
            columns = (
                (np.concatenate([place, many]).view(np.int64), np.int64), (np.concatenate([rows, none]), np.int64), (np.concatenate([number, none]), np.int32),
                (np.concatenate([np.where(crowded, SPREAD, n), none + SUMMARY]), np.int32),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in columns], ["place", "rid", "number", "n"])

    return run


REPEATED = "rid long, code int"


def _repeated(most: int):
    """From rows sorted by place: those whose place has a sum of n over 1, with 2 * number, or one more if it is over ``most``.

    A place's rows are held back only until its sum is over ``most``, so memory is bounded for any value.
    """

    def told(rows: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        real = rows[:, 3] != SUMMARY
        code = 2 * rows[real, 2] + hot[real]
        return pa.RecordBatch.from_arrays([pa.array(rows[real, 1]), pa.array(code.astype(np.int32))], ["rid", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)  # the rows of the last place so far
        hot_place = None  # the last place, if its sum is over the bound already
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("place", "rid", "number", "n")], 1)
            spread = rows[:, 3] == SPREAD
            if spread.any():
                yield told(rows[spread], np.ones(int(spread.sum()), np.int64))
                rows = rows[~spread]
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            held = rows[:0]
            new = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            size = np.diff(np.r_[new, len(rows)])
            total = np.add.reduceat(np.where(rows[:, 3] == SUMMARY, most + 1, rows[:, 3]), new)
            if rows[0, 0] == hot_place:
                total[0] = most + 1
            last = rows[-1, 0]
            if total[-1] <= most:  # the last place may go on in the next batch
                held, rows, total, size = rows[new[-1] :], rows[: new[-1]], total[:-1], size[:-1]
                hot_place = None
            else:
                hot_place = last
            keep = np.repeat(total > 1, size)
            yield told(rows[keep], np.repeat((total > most).astype(np.int64), size)[keep])
        if len(held) and held[:, 3].sum() > 1:
            yield told(held, np.zeros(len(held), np.int64))

    return run


PIECES = "id long, rid long, start long, bucket long, copies long, packed binary"
#: Equal strings of one batch, or of as much of it as is gathered in one go, with the least id, the copies and the places of all.
GATHERED = "bucket long, packed binary, copies long, id long, rids array<long>, ids array<long>, starts array<long>"
PLACES = "rid long, id long, start long, marks array<long>"


def _once(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch with one row for each run of rows with the same id and text, and their numbers."""
    ids, rid, text = batch.column("id").to_numpy(), batch.column("rid").to_numpy(), batch.column("text")
    new = np.r_[True, (rid[1:] != rid[:-1]) | (ids[1:] != ids[:-1])] if len(rid) else np.zeros(0, bool)
    again = np.flatnonzero(~new)
    if len(again):
        new[again] = ~pc.equal(text.take(pa.array(again)), text.take(pa.array(again - 1))).to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array(new))
    return batch, np.diff(np.r_[np.flatnonzero(new), len(new)])


def _pack(kind: Kind, hot: bool):
    """Runs with a repeated minimiser that is very frequent, or isn't, as packed strings."""

    def pieces(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch, copies = _once(whole)
        ids, rid = batch.column("id").to_numpy(), batch.column("rid").to_numpy()
        codes, codes_off = flat(batch.column("wanted"))
        for lo, hi, buf, off in ts.scan(batch.column("text")):
            raw, symbols, sym_off, sym_start, sym_end = kind.symbols(buf, off)
            grams, least, valid = minimisers(kind, symbols, sym_off)
            start, length = runs(least, valid)
            doc = np.searchsorted(sym_off, start, "right") - 1
            # Each run's number among its text's minimisers by value, as _values() counts them.
            order = np.lexsort((least[start], doc))
            value, of = least[start][order], doc[order]
            new = np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])] if len(of) else np.zeros(0, bool)
            place = np.empty(len(start), np.int64)
            place[order] = np.cumsum(new) - 1
            told = np.zeros(int(new.sum()), np.int8)  # 1: repeated, 2: and very frequent
            mine = codes[codes_off[lo] : codes_off[hi]].astype(np.int64)
            slot = np.searchsorted(of[new], np.repeat(np.arange(hi - lo), np.diff(codes_off[lo : hi + 1]))) + mine // 2
            known = slot < len(told)  # others belong to a row whose hash happens to be the same
            told[slot[known]] = 1 + mine[known] % 2
            at = np.flatnonzero(told[place] == 1 + hot)
            bucket, start, length = least[start[at]], start[at], length[at]
            if hot:
                mask = np.zeros(len(least), bool)
                mask[ts.ragged(start, length)] = True
                most = ~sliding_min(~grams, kind.width - kind.gram + 1)
                both = ts.mix(least + ts.mix(most))
                start, length = runs(both, mask)
                bucket = both[start]
            doc = np.searchsorted(sym_off, start, "right") - 1
            first = sym_start[start]
            last = sym_end[start + length + kind.width - 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo + doc]), pa.array(rid[lo + doc]), pa.array(start - sym_off[doc]), pa.array(bucket.view(np.int64)), pa.array(copies[lo + doc]), ts.strings(raw, first, last - first)],
                ["id", "rid", "start", "bucket", "copies", "packed"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not hot:
                yield from pieces(batch)
                continue
            held, size = [], 0
            for part in pieces(batch):
                held.append(part)
                size += part.nbytes
                if size >= 2 * GO_BYTES:
                    yield _gather(held)
                    held, size = [], 0
            yield _gather(held)

    return run


def _gather(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Equal strings of a bucket as one row with all their places."""
    names = [c.split()[0] for c in GATHERED.split(", ")]
    if not sum(map(len, parts)):
        empty = [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)]
        return pa.RecordBatch.from_arrays(empty, names)
    table = pa.Table.from_batches(parts).combine_chunks()
    strings = table["packed"].combine_chunks().dictionary_encode()
    code, col = strings.indices.to_numpy(), {c: table[c].to_numpy() for c in ("bucket", "copies", "rid", "id", "start")}
    order = np.lexsort((code, col["bucket"]))
    col = {c: v[order] for c, v in col.items()}
    new = np.flatnonzero(np.r_[True, (col["bucket"][1:] != col["bucket"][:-1]) | (code[order][1:] != code[order][:-1])])
    ends = np.r_[new, len(order)]
    columns = [pa.array(col["bucket"][new]), strings.dictionary.take(pa.array(code[order][new])), pa.array(np.add.reduceat(col["copies"], new)), pa.array(np.minimum.reduceat(col["id"], new))]
    return pa.RecordBatch.from_arrays([*columns, *(ts.lists(col[c], ends) for c in ("rid", "id", "start"))], names)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each place."""
    for batch in batches:
        (rid, off), (ids, _), (start, _), (marks, at) = (flat(batch.column(c)) for c in ("rids", "ids", "starts", "marks"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(off))
        size = np.diff(at)[row]
        for part in np.array_split(np.arange(len(row)), max(1, int(size.sum()) >> 20)):
            r = row[part]
            values = marks[ts.ragged(at[r], size[part])]
            yield pa.RecordBatch.from_arrays([pa.array(rid[part]), pa.array(ids[part]), pa.array(start[part]), ts.lists(values, np.r_[0, np.cumsum(size[part])], pa.int64())], ["rid", "id", "start", "marks"])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists of longs, and the rows' offsets in them; a null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return ts.utf8(column.cast(pa.large_binary()).view(pa.large_string()))


def _sort_buckets(sorter: Sorter, carry: list[str]):
    """Marks of the strings in rows that are sorted by bucket, with the columns to carry along."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        # Equal strings of a bucket are one string with a count and a least doc_id.
        strings = table["packed"].combine_chunks().dictionary_encode()
        bucket, ids = table["bucket"].to_numpy(), table["id"].to_numpy()
        code = strings.indices.to_numpy()
        order = np.lexsort((ids, code, bucket))
        new = np.flatnonzero(np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (code[order][1:] != code[order][:-1])])
        n = np.add.reduceat(table["copies"].to_numpy()[order], new)
        buf, off = _binary(strings.dictionary.take(pa.array(code[order[new]])))
        marks, at = sorter(buf, off, bucket[order[new]], n, ids[order[new]])
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(order)]))
        size = np.diff(at)[which]
        some = np.flatnonzero(size)
        values = marks[ts.ragged(at[which[some]], size[some])]
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(pa.array(some)) for c in carry), ts.lists(values, np.r_[0, np.cumsum(size[some])], pa.int64())], [*carry, "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            if not len(bucket):
                continue
            cuts = (np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()
            if last is not None and bucket[0] != last:
                cuts.insert(0, 0)
            per_row = max(1, batch.nbytes // len(bucket))
            at = 0
            for cut in cuts:
                # Whole buckets are sorted together, as many as make up the wanted size.
                if size + (cut - at) * per_row >= GO_BYTES:
                    if cut > at:
                        held.append(batch.slice(at, cut - at))
                    yield work(held)
                    held, size, at = [], 0, cut
            held.append(batch.slice(at))
            size += (len(bucket) - at) * per_row
            last = bucket[-1]
        if held:
            yield work(held)

    return run


def occurrences(documents: DataFrame, kind: Kind, sorter: Sorter, within: bool) -> tuple[DataFrame, DataFrame]:
    """The documents as rows (id, rid, text), and (rid, id, start, marks) of each run of theirs with marks.

    Documents are read several times, and which values count as crowded depends on how rows lie together; so they
    should come from a stored table, whose rows lie the same way when a lost task is run again.
    within: whether places in one document count as repeated.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("id", "text").alias("rid"), "text")
    seen = docs.select("rid", "text").mapInArrow(_count(kind, within), SEEN)
    told = seen.repartition("place").sortWithinPartitions("place").mapInArrow(_repeated(kind.most), REPEATED)
    wanted = checkpoint(told.groupBy("rid").agg(F.collect_set("code").alias("wanted"), F.max(F.col("code") % 2).alias("hot"), F.min(F.col("code") % 2).alias("cold")))

    def pieces(hot: bool, schema: str) -> DataFrame:
        named = wanted.where("hot = 1" if hot else "cold = 0").select("rid", "wanted")
        rows = docs.join(named.hint("merge"), "rid").select("id", "rid", "text", "wanted").sortWithinPartitions("rid")
        return rows.mapInArrow(_pack(kind, hot), schema)

    by_bucket = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    cold = by_bucket(pieces(False, PIECES)).mapInArrow(_sort_buckets(sorter, ["rid", "id", "start"]), PLACES)
    if wanted.where("hot = 1").isEmpty():
        return docs, cold
    gathered = pieces(True, GATHERED)
    strings = gathered.groupBy("bucket", "packed").agg(F.sum("copies").alias("copies"), F.min("id").alias("id"))
    marks = by_bucket(strings).mapInArrow(_sort_buckets(sorter, ["bucket", "packed"]), "bucket long, packed binary, marks array<long>")
    # Adaptive execution splits the places of a string that very many texts have: both sides are plain shuffles.
    sid = F.sha2("packed", 256).alias("sid")
    found = gathered.select("rids", "ids", "starts", "bucket", sid).join(marks.select("bucket", sid, "marks").hint("merge"), ["bucket", "sid"])
    alone = cold.select(F.array("rid").alias("rids"), F.array("id").alias("ids"), F.array("start").alias("starts"), "marks")
    return docs, alone.unionByName(found.select("rids", "ids", "starts", "marks")).mapInArrow(_expand, PLACES)


def places(found: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists of (id, start, marks) as row, start, flat marks and their offsets, by row; an entry of
    another id, whose row's hash happens to be the same, is left out."""
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(found)
    row = np.repeat(np.arange(len(size)), size)
    own = np.flatnonzero(entries.field("id").to_numpy() == ids[row])
    entries = entries.take(pa.array(own))
    marks, off = flat(entries.field("marks"))
    return row[own], entries.field("start").to_numpy(), marks, off


def doc_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
