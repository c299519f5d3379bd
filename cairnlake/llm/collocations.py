"""Phrase collocation mining: frequent phrases of two to four words, scored by their best cut, without those inside longer ones.

1. Texts are lower-cased and cut into pieces and words, chunk by chunk of about CHUNK_BYTES.  A chunk is a row from here
   on: the sequence of its items (words, with a break between pieces) as numbers, and its different items with their counts.
   So however frequent an item is, a chunk sends it once.
2. A chunk deals its items to groups by a hash of their key, the word with its language or a pair of names, and sends one
   compressed block to each group.  There the items of all chunks meet; those with enough occurrences get a global name:
   the least place (chunk and number) that has it.
3. Names go back to their chunks.  There the sequence of words, or of phrases of k words, becomes one of pairs of names that
   stand beside each other, which are phrases of k + 1 words: a phrase is only counted if both its parts are frequent.
   Steps 2 and 3 repeat up to the longest phrase.
4. A name's pair points at its parents, the phrase without its last and without its first word.  Joins along these pointers
   give the counts of both parts of every cut, and the most frequent longer phrase around each: one of one word more is
   enough, as no longer one is more frequent.

Nothing grows in a task but with a chunk: there are as many groups as it takes to give each GROUP_ITEMS items, and as a chunk
sends each different item once, no item makes its group large.
Products are made as decimals, so they are exact beyond 64 bits.

Nulls and edge cases: a null text is empty and a null lang is ``und``, as is the lang of that name; a word has any
characters but white space and separators, so it may be of any length and in any script; repeated rows count as often as
they stand there; null doc_ids don't matter, as none is read; equal scores and counts are ordered by phrase, in the order
of UTF-8 bytes; a lang without candidates has no rows; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import checkpoint, read, small_batches

#: Words of the longest phrases, occurrences of a candidate, and rows for each lang.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one has so many per cent of its occurrences.
INSIDE = 80
SCALE = 2_000_000
NO_LANG = "und"

#: Bytes of text in a chunk, about; a longer piece stands alone.
CHUNK_BYTES = 8 << 20
#: Items of a group of keys, at most about: they are counted in one task.
GROUP_ITEMS = 4 << 20
#: A place is made of a task's partition, its chunk there, and the number of an item in the chunk.
CHUNK_BITS, ITEM_BITS = 16, 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\v\f\r")] = True
_BREAK = _CUT.copy()
_BREAK[list(b" \t")] = True


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from -1 as one compressed value, with the bytes of equal weight side by side."""
    flat = np.concatenate([np.asarray(a, np.int64) for a in arrays]) + 1
    return np.array([len(flat), *map(len, arrays)], np.int64).tobytes() + pa.compress(flat.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(value: bytes, n: int) -> list[np.ndarray]:
    size, *lengths = np.frombuffer(value, np.int64, n + 1).tolist()
    planes = np.frombuffer(pa.decompress(value[8 * (n + 1) :], 8 * size, "zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel() - 1
    return np.split(flat, np.cumsum(lengths)[:-1])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in pieces that begin at these offsets and aren't empty."""
    solid = ~_BREAK[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[off[:-1]] = solid[off[:-1]]
    last[off[1:] - 1] = solid[off[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunks: their sequence of words, -1 between pieces, their words with counts and langs, and all words by lang."""
    chunk, end = (TaskContext.get().partitionId() << CHUNK_BITS), (TaskContext.get().partitionId() + 1 << CHUNK_BITS)
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        raw, off = ts.utf8(batch.column("text"))
        buf = _LOWER[raw]
        cuts = np.unique(np.concatenate([off, np.flatnonzero(_CUT[buf]) + 1]))
        for lo, hi in ts.groups(cuts, CHUNK_BYTES):
            piece_off = cuts[lo : hi + 1] - cuts[lo]
            text = buf[cuts[lo] : cuts[hi]]
            start, stop = words(text, piece_off)
            if not len(start):
                continue
            if chunk >= end:
                raise ValueError(f"a partition has over {1 << CHUNK_BITS} chunks")
            piece = np.searchsorted(piece_off, start, "right") - 1
            lang = code[np.searchsorted(off, cuts[lo:hi], "right") - 1][piece]
            number, _ = ts.identify(text, start, stop)
            _, one, item, n = np.unique(number * len(langs.dictionary) + lang, return_index=True, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which compress well.
            order = np.argsort(-n, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            place = np.arange(len(item)) + piece - piece[0]
            sequence = np.full(place[-1] + 1, -1, np.int64)
            sequence[place] = rank[item]
            one, n = one[order], n[order]
            spelled = text[ts.ragged(start[one], (stop - start)[one])].tobytes()
            per = np.bincount(lang, minlength=len(langs.dictionary))
            totals = pa.StructArray.from_arrays([langs.dictionary, pa.array(per)], ["lang", "n"])
            columns = [
                pa.array([chunk]), pa.array([_packed(_squeezed(sequence))]), pa.array([_packed((stop - start)[one], n, lang[one])]),
                pa.array([pa.compress(spelled, "zstd", asbytes=True)]), _listed(totals),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "sequence", "items", "spelled", "totals"])
            chunk += 1


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _squeezed(sequence: np.ndarray) -> np.ndarray:
    """One break for each run of breaks."""
    keep = sequence >= 0
    keep[1:] |= sequence[:-1] >= 0
    return sequence[keep]


def pairs(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of the numbers of pairs beside each other, and the first, the second and the count of each pair."""
    at = np.flatnonzero((sequence[:-1] >= 0) & (sequence[1:] >= 0))
    width = int(sequence.max(initial=0)) + 1
    key, number, n = np.unique(sequence[at] * width + sequence[at + 1], return_inverse=True, return_counts=True)
    out = np.full(len(sequence), -1, np.int64)
    out[at] = number
    return out, key // width, key % width, n


def named(sequence: np.ndarray, numbers: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of those items that have names, by the names' order, and the sorted names."""
    order = np.argsort(names)
    dense = np.full(max(int(sequence.max(initial=0)), int(numbers.max(initial=0))) + 2, -1, np.int64)  # the last one is for -1
    dense[numbers[order]] = np.arange(len(order))
    return _squeezed(dense[sequence]), names[order]


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first one from 0, as numbers from 0: 2 x or, if negative, -2 x - 1."""
    d = np.diff(values, prepend=0)
    return (d << 1) ^ (d >> 63)


def _walked(steps: np.ndarray) -> np.ndarray:
    """The values that have these steps."""
    return np.cumsum((steps >> 1) ^ -(steps & 1))


def dealt(first: np.ndarray, second: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which pairs of names go to their groups, and where each group begins and ends in it."""
    group = (ts.mix(ts.mix(first.astype(np.uint64)) + second.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    return np.argsort(group, kind="stable"), np.searchsorted(np.sort(group), np.arange(groups + 1))


def _longer(paired: bool, groups: int) -> Callable:
    """Chunks as sequences of the names of this length; paired: from sequences of the parts' names, dealt to so many groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if paired:
                    sequence, parts = _unpacked(batch.column("sequence")[i].as_py(), 2)
                    sequence, first, second, _ = pairs(sequence)
                    order, _ = dealt(parts[first], parts[second], groups)
                    number = np.empty(len(order) + 1, np.int64)
                    number[order], number[-1] = np.arange(len(order)), -1
                    sequence = number[sequence]
                else:
                    sequence = _unpacked(batch.column("sequence")[i].as_py(), 1)[0]
                found = [_unpacked(block, 2) for block in batch.column("blocks")[i].as_py()]
                made = named(sequence, np.concatenate([_walked(no) for no, _ in found]), np.concatenate([_walked(name) for _, name in found]))
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([_packed(*made)]), pa.array([len(made[0])])], ["chunk", "sequence", "places"])

    return run


#: Rows of a batch of items.
ROWS = 1 << 16


#: A block: its group and chunk, the packed numbers of its items, and for words their bytes and langs.
BLOCK = "group int, chunk long, items binary, spelled binary, langs array<string>"


def _block(group: int, chunk: int, items: bytes, spelled: bytes | None = None, langs: list | None = None) -> pa.RecordBatch:
    columns = [pa.array([group], pa.int32()), pa.array([chunk]), pa.array([items], pa.binary()), pa.array([spelled], pa.binary()), pa.array([langs], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["group", "chunk", "items", "spelled", "langs"])


def _dealt_pairs(groups: int) -> Callable:
    """A chunk's pairs in blocks: steps of the numbers that they have in this order and of their first names, second names, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, value in zip(batch.column("chunk").to_pylist(), batch.column("sequence").to_pylist(), strict=True):
                sequence, parts = _unpacked(value, 2)
                _, first, second, n = pairs(sequence)
                first, second = parts[first], parts[second]
                order, bound = dealt(first, second, groups)
                for group in np.flatnonzero(np.diff(bound)).tolist():
                    at = np.arange(bound[group], bound[group + 1])
                    some = order[at]
                    yield _block(group, chunk, _packed(_steps(at), _steps(first[some]), second[some], n[some]))

    return run


def _dealt_words(groups: int) -> Callable:
    """A chunk's words in blocks: steps of their numbers, lengths, counts and langs, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                length, n, lang = _unpacked(batch.column("items")[i].as_py(), 3)
                raw = np.frombuffer(pa.decompress(batch.column("spelled")[i].as_py(), int(length.sum()), "zstd", asbytes=True), np.uint8)
                langs, start = batch.column("totals")[i].values.field("lang").to_pylist(), np.cumsum(length) - length
                group = (ts.hashes(raw, start, start + length) % np.uint64(groups)).astype(np.int64)
                order, bound = np.argsort(group, kind="stable"), np.searchsorted(np.sort(group), np.arange(groups + 1))
                for g in np.flatnonzero(np.diff(bound)).tolist():
                    some = order[bound[g] : bound[g + 1]]
                    spelled = pa.compress(raw[ts.ragged(start[some], length[some])].tobytes(), "zstd", asbytes=True)
                    yield _block(g, batch.column("chunk")[i].as_py(), _packed(_steps(some), length[some], n[some], lang[some]), spelled, langs)

    return run


def _counted(k: int, least: int, back: bool) -> Callable:
    """The names of a group's frequent items, and back: for each chunk, steps of the numbers that have a name and of their names."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        blocks = [_unpacked(v.as_py(), 4) for v in table.column("items")]
        # In the order of chunks, so that the first of equal items has the least place.
        blocks = [(chunk[i], i, *blocks[i]) for i in np.argsort(chunk, kind="stable").tolist()]
        sizes = [len(b[2]) for b in blocks]
        no = np.concatenate([_walked(b[2]) for b in blocks])
        if k == 1:
            length, n, lang = (np.concatenate([b[j] for b in blocks]) for j in (3, 4, 5))
            spelled = b"".join(pa.decompress(table.column("spelled")[i].as_py(), int(own.sum()), "zstd", asbytes=True) for _, i, _, own, _, _ in blocks)
            raw, start = np.frombuffer(spelled, np.uint8), np.cumsum(length) - length
            known: dict[str, int] = {}
            codes = [np.array([known.setdefault(x, len(known)) for x in table.column("langs")[i].as_py()], np.int64) for _, i, *_ in blocks]
            lang = np.concatenate([own[b[5]] for own, b in zip(codes, blocks, strict=True)])
            key = ts.identify(raw, start, start + length)[0] * len(known) + lang
        else:
            first, second, n = np.concatenate([_walked(b[3]) for b in blocks]), *(np.concatenate([b[j] for b in blocks]) for j in (4, 5))
            two, at = np.unique(second, return_inverse=True)
            key = np.unique(first, return_inverse=True)[1] * len(two) + at
        place = np.repeat([b[0] for b in blocks], sizes) << ITEM_BITS | no
        order = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        f = np.add.reduceat(n[order], begin)
        kept, one = f >= least, order[begin]
        name = np.empty(len(key), np.int64)
        name[order] = np.repeat(np.where(kept, place[one], -1), np.diff(np.r_[begin, len(key)]))
        one, f = one[kept], f[kept]
        if k == 1:
            langs = pa.array(list(known), pa.string()).take(pa.array(lang[one]))
            own = [langs, ts.strings(raw, start[one], length[one]).cast(pa.string())]
        else:
            own = [pa.array(first[one]), pa.array(second[one])]
        struct = pa.StructArray.from_arrays([pa.array(place[one]), pa.array(f), *own], ["id", "f", *_name(k)])
        named_rows = [(None, None, struct.slice(lo, ROWS)) for lo in range(0, len(struct), ROWS)]
        sent = []
        if back:
            for (of, *_), lo, hi in zip(blocks, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
                got = lo + np.flatnonzero(name[lo:hi] >= 0)
                got = got[np.argsort(name[got])]
                if len(got):
                    sent.append((of, _packed(_steps(no[got]), _steps(name[got])), struct[:0]))
        rows = [*named_rows, *sent]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32()), pa.concat_arrays([struct[:0], *(r[2] for r in rows)]))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), lists], ["chunk", "block", "names"])

    return run


def _listed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            length, n, lang = _unpacked(batch.column("items")[i].as_py(), 3)
            raw = np.frombuffer(pa.decompress(batch.column("spelled")[i].as_py(), int(length.sum()), "zstd", asbytes=True), np.uint8)
            langs, start = batch.column("totals")[i].values.field("lang"), np.cumsum(length) - length
            for lo in range(0, len(n), ROWS):
                part = slice(lo, lo + ROWS)
                no = np.arange(lo, lo + len(n[part]))
                spelled = ts.strings(raw, start[part], length[part]).cast(pa.string())
                chunk = pa.array(np.full(len(no), batch.column("chunk")[i].as_py()))
                yield pa.RecordBatch.from_arrays([chunk, pa.array(no), langs.take(pa.array(lang[part])), spelled, pa.array(n[part])], ["chunk", "no", *_name(1), "n"])


def _exact(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(19,0)")


def _name(k: int) -> list[str]:
    return ["lang", "word"] if k == 1 else ["first", "second"]


def names(documents: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length the names: id, f, and lang and word or the ids first and second."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    stored = checkpoint(rows.mapInArrow(_chunks, "chunk long, sequence binary, items binary, spelled binary, totals array<struct<lang: string, n: long>>"))
    totals = stored.select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("n"))
    places = totals.agg(F.sum("n")).first()[0] or 0
    found = []
    for k in range(1, longest + 1):
        groups = max(1, math.ceil(places / GROUP_ITEMS))  # a number a length comes to the driver
        blocks = stored.select("chunk", "items", "spelled", "totals").mapInArrow(_dealt_words(groups), BLOCK) if k == 1 else stored.select("chunk", "sequence").mapInArrow(_dealt_pairs(groups), BLOCK)
        kinds = ", ".join(f"{c}: {'string' if k == 1 else 'long'}" for c in _name(k))
        counted = checkpoint(blocks.groupBy("group").applyInArrow(_counted(k, least, k < longest), f"chunk long, block binary, names array<struct<id: long, f: long, {kinds}>>"))
        found.append(counted.select(F.inline("names")))
        if k < longest:
            back = counted.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list("block").alias("blocks"))
            stored = checkpoint(stored.select("chunk", "sequence").join(back.hint("shuffle_hash"), "chunk").mapInArrow(_longer(k > 1, groups), "chunk long, sequence binary, places long"))
            places = stored.agg(F.sum("places")).first()[0] or 0
    return totals, found


def phrases(found: list[DataFrame]) -> list[DataFrame]:
    """For each length from 2: id, lang, phrase, a, cut, l, r, score, and inside, the count of the most frequent longer phrase around it.

    ``heads`` and ``tails`` are the counts of a phrase's first and last words, by how many they are.
    """
    one = found[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = []
    for k, level in enumerate(found[1:], 2):
        left = one.select(F.col("id").alias("first"), "lang", "phrase", "heads")
        right = one.select(F.col("id").alias("second"), "last", "tails")
        one = checkpoint(
            level.join(left, "first").join(right, "second").select(
                "id", "first", "second", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.col("f").alias("a"),
                F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
            )
        )

        def cut(j: int, k: int = k) -> Column:
            l, r = F.get("heads", F.lit(j - 1)), F.get("tails", F.lit(k - j - 1))
            score = F.call_function("div", _exact(SCALE) * _exact(F.col("a")), _exact(l) + _exact(r))
            return F.struct(score.alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r"))

        out.append(one.withColumn("best", F.array_min(F.array(*(cut(j) for j in range(1, k))))))
    whole = []
    for k, level in enumerate(out):
        rows = level.select("id", "lang", "phrase", "a", "best.*")
        if k + 1 < len(out):
            around = out[k + 1].select(F.explode(F.array("first", "second")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("inside"))
            rows = rows.join(around, "id", "left")
        else:
            rows = rows.withColumn("inside", F.lit(None).cast("long"))
        whole.append(rows)
    return whole


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut and length of each lang's best phrases."""
    if not 2 <= longest <= 16 or least < 1:
        raise ValueError("phrases have 2 to 16 words and occur")
    totals, found = names(documents, longest, least)
    parts = [p.withColumn("length", F.lit(k)) for k, p in enumerate(phrases(found), 2)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    alone = every.where(F.col("inside").isNull() | (_exact(F.col("inside")) * 100 < _exact(F.col("a")) * inside))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = alone.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut", "length")


def op11_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH p AS (SELECT lang, list_filter(string_split_regex(x, '[\\x20\\x09]+'), lambda y: y <> '') AS w FROM (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)),
g AS (SELECT lang, k, w[i : i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, array_to_string(w, ' ') AS g, any_value(k) AS k, any_value(w) AS w, count(*) AS f FROM g GROUP BY lang, array_to_string(w, ' ') HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, k, g, w, f AS a FROM f WHERE k > 1),
x AS MATERIALIZED (SELECT lang, g, a, j, array_to_string(w[1 : j], ' ') AS lg, array_to_string(w[j + 1 : k], ' ') AS rg FROM (SELECT lang, k, g, w, a, unnest(range(1, k)) AS j FROM c)),
t AS (SELECT x.lang, x.g, x.a, l.f AS l, r.f AS r, j, CAST(({SCALE} * CAST(x.a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.g = x.lg JOIN f AS r ON r.lang = x.lang AND r.g = x.rg),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[i : j], ' ') AS g, a FROM (SELECT lang, k, w, a, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT lang, k, w, a, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k),
m AS (SELECT lang, g, max(a) AS m FROM i GROUP BY lang, g),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
o AS (SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE m.m IS NULL OR 100 * m.m < {INSIDE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
QUALIFY rank <= {TOP}
"""
