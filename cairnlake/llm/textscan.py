"""Vectorised scans over a column of texts, shared by the operators that run numpy inside Spark tasks.

A batch of texts is looked at as one UTF-8 byte array plus the offsets of its documents.  Words are maximal
runs of bytes other than space and 0x09-0x0D, so they never cross a document.  Hashes only bring spans together:
``identify`` compares the bytes of spans whose hashes agree before it gives them one number.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Documents are scanned in groups of about this many bytes, which bounds a task's memory whatever the batch size.
SCAN_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown as longer inputs come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, x in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in BASES)


def give_back() -> None:
    """Return what is freed to the system: a Python worker lives on after its task, beside those of later jobs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Fingerprints of any span of a sequence of hashed symbols, by a polynomial; equal ones prove nothing."""

    def __init__(self, symbols: np.ndarray, which: int = 0) -> None:
        n = len(symbols)
        up, self._down = _POWERS[which].upto(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        terms = symbols.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[:n]
        np.cumsum(terms, out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def grams(self, k: int) -> np.ndarray:
        """Fingerprints of all runs of k symbols, by their starts."""
        n = len(self._sums) - k
        return mix((self._sums[k:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


#: Bytes in a block, and of the longest span that is hashed and compared block by block.
BLOCK, LONG = 8, 64


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as integers in the order of the bytes; the end is padded."""
    padded = np.zeros(len(buf) + BLOCK, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, ">u8", padded, 0, (1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(BLOCK + 1)], np.uint64)


def _blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as integers in whatever order of the bytes is quickest."""
    padded = np.zeros(len(buf) + BLOCK, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))


def _block(blocks: np.ndarray, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """The k-th block of spans of k blocks or more, without the bytes behind a span's end."""
    return blocks[start + BLOCK * k] & _MASKS[np.minimum(length - BLOCK * k, BLOCK)]


def _hashed(buf: np.ndarray, blocks: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first block of each span."""
    head = _block(blocks, start, length, 0)
    out = mix(mix(length.astype(np.uint64) + np.uint64(0x9FB21C651E98DF25)) ^ head)
    live, k = np.flatnonzero((length > BLOCK) & (length <= LONG)), 1
    while len(live):
        out[live] = mix(out[live] ^ _block(blocks, start[live], length[live], k))
        k += 1
        live = live[length[live] > BLOCK * k]
    raw = memoryview(np.ascontiguousarray(buf))
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + length[i]])
    return out, head


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return _hashed(buf, _blocks(buf), start, end - start)[0]


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of these lengths from a and from b on hold the same bytes."""
    blocks = _blocks(buf)
    out = _block(blocks, a, length, 0) == _block(blocks, b, length, 0)
    live, k = np.flatnonzero(out & (length > BLOCK) & (length <= LONG)), 1
    while len(live):
        out[live] = _block(blocks, a[live], length[live], k) == _block(blocks, b[live], length[live], k)
        k += 1
        live = live[out[live] & (length[live] > BLOCK * k)]
    raw = memoryview(np.ascontiguousarray(buf))
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = raw[a[i] : a[i] + length[i]] == raw[b[i] : b[i] + length[i]]
    return out


def identify(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each span, the same exactly where the bytes are, and the place of one span of each number.

    Spans are sorted by hash and neighbours with equal hashes compared byte by byte; should two different spans
    share a hash, all are told apart by their bytes instead.
    """
    out = np.empty(len(start), np.int64)
    if not len(start):
        return out, out
    length = end - start
    keys, head = _hashed(buf, _blocks(buf), start, length)
    order = np.argsort(keys)
    keys, head, length = keys[order], head[order], length[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    again = np.flatnonzero(~new)
    more = again[length[again] > BLOCK]
    first = start[order]
    if (
        (length[again] == length[again - 1]).all() and (head[again] == head[again - 1]).all()
        and same_bytes(buf, first[more - 1], first[more], length[more]).all()
    ):
        out[order] = np.cumsum(new) - 1
        return out, order[new]
    raw, known = buf.tobytes(), {}
    out[:] = [known.setdefault(raw[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    return out, np.unique(out, return_index=True)[1]


def sequences(numbers: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n numbers, by their starts; equal exactly where the runs are."""
    if len(numbers) < n:
        return np.zeros(0, np.int64)
    step = max(1, int(numbers.max()).bit_length())
    key, bits = numbers.astype(np.int64), step
    for k in range(1, n):
        if bits + step > 63:  # no room for one more: renumber what is there
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bits = max(1, int(key.max()).bit_length())
        key = key[:-1] << step | numbers[k : k + len(key) - 1]
        bits += step
    return key


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the documents' offsets in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, size: int = SCAN_BYTES):
    """Ranges of consecutive documents of about so many bytes; a longer document stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def scan(column: pa.Array, size: int = SCAN_BYTES):
    """(first document, one past the last, bytes, offsets) for groups of documents of a column."""
    buf, off = utf8(column)
    for lo, hi in groups(off, size):
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the offsets of the documents among the words."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[0] = after[-1] = True
    before[1:] |= ~solid[:-1]
    after[:-1] |= ~solid[1:]
    start = np.flatnonzero(solid & before)
    return start, np.flatnonzero(solid & after) + 1, np.searchsorted(start, off)


def squeeze(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space for each run of white space, and their offsets."""
    space = SPACE[buf]
    keep = ~space
    keep[1:] |= ~space[:-1]
    first = off[:-1][np.diff(off) > 0]
    keep[first] = ~space[first]
    out = np.where(space[keep], np.uint8(32), buf[keep])
    return out, np.r_[0, np.cumsum(keep)][off]


def per_document(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of an array over each document."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of many spans, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def strings(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Spans of bytes as an Arrow column of binary values."""
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=off[1:])
    data = np.ascontiguousarray(buf[ragged(start, length)])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data)])


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow column of lists over a flat array."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(off, np.int32)), pa.array(values, kind))
