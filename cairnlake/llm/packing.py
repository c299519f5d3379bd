"""Best-fit packing: documents into sequences of a fixed length by the sum-of-squares rule.

Each document's ids end with a separator.  Only documents longer than a sequence are cut, into full pieces and
a rest.  Full pieces are sequences of their own; the others are dealt by hash to groups of a few thousand
pieces, and each group is packed apart, longest piece first: a piece goes where the sum of the squared
counts of open bins per residual gap becomes smallest.  What a group leaves in poorly filled bins is gathered
over ever fewer groups and packed again, so that the loss doesn't grow with the number of groups.

Within a group a piece opens a new bin only where no open bin has room for it; among the bins with room the rule
decides.

Nulls and edge cases: a null or empty text is one separator; repeated rows are packed as often as they occur
(equal doc_ids are fine); a null doc_id is carried through; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import checkpoint, read, small_batches

LENGTH = 2048
#: Pieces in a group, about; a group is packed by one task.
GROUP = 4096
#: Bins with more free places than this share of a sequence are packed again in the next round.
LOOSE = 1 / 128
#: Groups that are merged for the next round, and rounds.
MERGE, ROUNDS = 16, 3
#: Word parts that a Python worker remembers the ids of, at most, with their text (some 50 bytes each), and the bytes of those.
REMEMBER, REMEMBERED_BYTES = 1_500_000, 1 << 26

_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?*#$%&()")] = True
_LATIN = np.zeros(256, bool)
_LATIN[list(range(65, 91)) + list(range(97, 123))] = True
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 0x20


#: A text that comes out otherwise by parts, unless a tokenizer is of the kind that WordTokenizer looks up.
PROBE = "Plain Words, AND more (x*y)  of #One; n\u00e9.\u00c9t\u00e9! na\u00efve\n\tEnd. don't stop... A-b c_d &c? Yes: 100% sure$"


class WordTokenizer:
    """Ids of whole texts, most quickly by a tokenizer that lower-cases, never joins across white space, and splits letters from punctuation.

    Such a tokenizer gives a text the ids of its parts in order, if it is cut at white space and between a
    Latin letter and a common punctuation mark; so each different part is tokenized once and then looked up.
    Whether the given one is of that kind is seen by PROBE; any other one gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()
        buf = np.frombuffer(PROBE.encode(), np.uint8)
        off = np.array([0, len(buf)])
        self.by_parts = True
        self.by_parts = self.encode(buf, off)[0].tolist() == self._whole(buf, off)[0].tolist()
        self._forget()

    def _whole(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        got = self._tokenizer.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)
        ids = [np.array(g.ids, np.uint32) for g in got]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)

    def _forget(self) -> None:
        self._keys, self._rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and the rows that they name
        self._text = np.zeros(0, np.uint8)  # a row's part lies in _text, its ids in _pool
        self._at, self._length, self._begin, self._size = (np.zeros(0, np.int32) for _ in range(4))
        self._pool = np.zeros(0, np.uint32)

    def _remembered(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rows of different parts, after those not remembered yet have been tokenized."""
        keys, length = ts.hashes(buf, start, end), end - start
        place = np.searchsorted(self._keys, keys)
        met = np.flatnonzero(self._keys[np.minimum(place, len(self._keys) - 1)] == keys if len(self._keys) else np.zeros(len(keys), bool))
        row = np.full(len(keys), -1, np.int64)
        row[met] = self._rows[place[met]]
        # A hash is only a hint: the bytes decide.
        fits = self._length[row[met]] == length[met]
        met = met[fits]
        same = ts.same_bytes(np.concatenate([self._text, buf]), self._at[row[met]].astype(np.int64), len(self._text) + start[met], length[met])
        known = np.zeros(len(keys), bool)
        known[met[same]] = True
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            ids = [got.ids for got in self._tokenizer.encode_batch([raw[s:e].decode("utf-8", "replace") for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            free = new[row[new] < 0]  # a part whose hash another one has is tokenized anew each time
            row[new] = len(self._at) + np.arange(len(new))
            self._at = np.concatenate([self._at, (len(self._text) + np.cumsum(length[new]) - length[new]).astype(np.int32)])
            self._length = np.concatenate([self._length, length[new].astype(np.int32)])
            self._text = np.concatenate([self._text, buf[ts.ragged(start[new], length[new])]])
            self._begin = np.concatenate([self._begin, (len(self._pool) + np.cumsum(size) - size).astype(np.int32)])
            self._size = np.concatenate([self._size, size.astype(np.int32)])
            self._pool = np.concatenate([self._pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))])
            free = free[np.unique(keys[free], return_index=True)[1]]
            place = np.searchsorted(self._keys, keys[free])
            self._keys, self._rows = np.insert(self._keys, place, keys[free]), np.insert(self._rows, place, row[free].astype(np.int32))
        return row

    @staticmethod
    def parts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, word_off = ts.words(buf, off)
        if len(buf) < 2:
            return start, end, word_off
        stop, letter = _STOP[buf], _LATIN[buf]
        wide = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)  # the Latin-1 letters
        closes, opens = letter.copy(), letter.copy()
        closes[1:] |= wide
        opens[:-1] |= wide
        inside = np.zeros(len(buf) + 1, bool)
        inside[1:-1] = (closes[:-1] & stop[1:]) | (stop[:-1] & opens[1:])
        inside[off] = False
        cut = np.flatnonzero(inside)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        return start, end, np.searchsorted(start, off)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the documents' offsets in them."""
        if not self.by_parts:
            return self._whole(buf, off)
        start, end, part_off = self.parts(buf, off)
        if b"<|" not in buf.tobytes():  # special tokens are told apart by case
            buf = buf | _CAPITAL[buf]
        number, first = ts.identify(buf, start, end)
        if len(self._at) > REMEMBER or len(self._text) + len(buf) > REMEMBERED_BYTES:
            self._forget()
        row = self._remembered(buf, start[first], end[first])[number]
        size, begin = self._size[row].astype(np.int64), self._begin[row].astype(np.int64)
        ids = self._pool[ts.ragged(begin, size)]
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return ids, ends[part_off]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordTokenizer:
    """One for a Python worker, which keeps what it knows from task to task."""
    return WordTokenizer(path)


def pieces(documents: DataFrame, tokenizer: str, separator: int = 0, length: int = LENGTH) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for lo, _, buf, off in ts.scan(batch.column("text"), 2 << 20):
                ids, at = encoder.encode(buf, off)
                doc, piece, start, size, crc = [], [], [], [], []
                for i in range(len(off) - 1):
                    all_ids = np.append(ids[at[i] : at[i + 1]], np.uint32(separator)).astype("<u4")
                    for k, s in enumerate(range(0, len(all_ids), length)):
                        part = all_ids[s : s + length]
                        doc.append(lo + i), piece.append(k), start.append(s), size.append(len(part)), crc.append(zlib.crc32(part.data))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        ts.give_back()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(size: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bin of each piece, by the sum-of-squares rule over the pieces from the longest to the shortest.

    With N(g) open bins of gap g, putting a piece of size s into a bin of gap g changes the sum of squares by
    2 (N(g - s) - N(g) + 1), or by 1 - 2 N(g) if it fills the bin; a new bin leaves the gap length - s.
    """
    count = np.zeros(length + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    out = np.empty(len(size), np.int64)
    bins = 0
    for i in np.argsort(-size, kind="stable"):
        s = int(size[i])
        open_gaps = count[s:]
        held = np.flatnonzero(open_gaps)
        if len(held):
            change = 2 * (count[held] - open_gaps[held] + 1)
            if held[0] == 0:
                change[0] = 1 - 2 * open_gaps[0]
            gap = int(held[np.argmin(change)]) + s
            out[i] = b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b = length, bins
            out[i], bins = b, bins + 1
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(b)
    return out


def _packer(length: int, last: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(rows))  # a group has a few thousand rows
        size = table["length"].to_numpy()
        # The order, and with it the packing, depends on nothing but the group's rows.
        order = np.lexsort((table["piece"].to_numpy(), table["ids_crc32"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy()))
        bins = np.empty(len(size), np.int64)
        bins[order] = sum_of_squares(size[order], length)
        used = np.bincount(bins, size).astype(np.int64)
        by = np.lexsort((np.arange(len(size)), bins))
        offset = np.empty(len(size), np.int64)
        running = np.cumsum(size[by]) - size[by]
        firsts = np.r_[True, bins[by][1:] != bins[by][:-1]]
        offset[by] = running - np.maximum.accumulate(np.where(firsts, running, 0))
        done = np.full(len(size), True) if last else length - used[bins] <= length * LOOSE
        for name, values in (("bin", bins), ("offset", offset), ("done", done)):
            table = table.append_column(name, pa.array(values))
        yield from table.combine_chunks().to_batches()

    return run


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces; parts is read several times and dealt by row place, so it must be stored."""
    columns = parts.columns
    # Numbers: below 0 for full pieces; for bins, the round, the group and the bin in it side by side.
    full = parts.where(F.col("length") == length).select(*columns, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(F.col("length") < length)
    done = [full]
    groups = max(1, -(-rest.count() // group))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    for step in range(ROUNDS):
        last = step == ROUNDS - 1 or groups == 1
        # Stored rows keep their places, so a lost task deals as before; and repeated rows go to different groups.
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(step)), F.lit(groups)))
        packed = checkpoint(dealt.groupBy("group").applyInArrow(_packer(length, last), f"{kind}, group long, bin long, offset long, done boolean"))
        done.append(packed.where("done").select(*columns, (F.lit(step << 58) + F.col("group") * (1 << 26) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        rest = packed.where("NOT done").select(*columns)
        groups = max(1, groups // MERGE)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = checkpoint(pieces(read(spark, sf_dir, "documents"), tokenizer_path()))
    return pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
