"""Collocation mining against counting every phrase in Python."""

import re
from collections import Counter

import numpy as np
import pytest

from cairnlake.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, longest, least, top, inside):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    some = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in some.items():
        k = len(words)
        cuts = [(2_000_000 * a // (counts[(lang, *words[:j])] + counts[(lang, *words[j:])]), j) for j in range(1, k)]
        score, j = min(cuts)
        longer = [b for (other, *w), b in some.items() if other == lang and len(w) > k and any(w[i : i + k] == words for i in range(len(w) - k + 1))]
        if all(100 * b < inside * a for b in longer):
            out.append((lang, -score, -a, " ".join(words), counts[(lang, *words[:j])], counts[(lang, *words[j:])]))
    out.sort(key=lambda x: (x[0], x[1], x[2], x[3].encode()))
    seen = Counter()
    ranked = []
    for lang, score, a, phrase, l, r in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, -a, l, r, total[lang], -score))
    return ranked


def made(spark, rows, *parameters):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = collocations.collocations(docs.repartition(3), *parameters).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(tuple(r) for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = [(None, "en"), ("", "en"), (" \t ", None), ("Á b c D. á B c d, e", None), ("x", "de"), ("new york. New\tYork; new  york city\r\nnew york city hall", "en"), ("x" * 5000 + " y", "en"), ("a a a a a a a", "fr"),
           ("a a a a a a a", "fr"), ("same words here " * 40, "en"), ("und und und", "und"), ("q \U0001f600 q \U0001f600 q \U0001f600 q \U0001f600 ￿ q", "en")]
    for _ in range(150):
        n = int(rng.integers(1, 60))
        words = rng.zipf(1.4, n) % 40
        out.append((" ".join(f"W{w}" if rng.random() < 0.2 else f"w{w}" for w in words).replace("7", ","), ["en", "de", None][int(rng.integers(3))]))
    return out


@pytest.mark.parametrize("parameters", [(4, 5, 2000, 80), (2, 1, 10, 80), (3, 3, 25, 50), (5, 4, 2000, 100)])
def test_against_brute_force(spark, rows, parameters):
    want = sorted(brute(rows, *parameters))
    assert want and made(spark, rows, *parameters) == want


def test_chunks_of_any_size(spark, rows, monkeypatch):
    """Pieces of one text in many chunks, with the same result; workers take the size from the closure's module."""
    text = ". ".join(t for t, _ in rows if t)
    whole, split = collocations_chunks(text, 1 << 20, monkeypatch), collocations_chunks(text, 256, monkeypatch)
    count = lambda batches: sum((Counter(dict(zip(zip(b["lang"], b["word"], strict=True), b["n"], strict=True))) for b in batches), Counter())
    assert len(whole) == 1 and len(split) > 10 and count(whole) == count(split)


def collocations_chunks(text, size, monkeypatch):
    import pyarrow as pa

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(collocations, "CHUNK_BYTES", size)
    monkeypatch.setattr(collocations, "TaskContext", Task)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    return [b.to_pydict() for b in collocations._listed_words(collocations._chunks(iter([batch])))]


def test_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, put in as names."""
    big = 9_000_000_000_000_000
    words = spark.createDataFrame([(1, big + 7, "en", "a"), (2, big + 2, "en", "b")], "id long, f long, lang string, word string")
    two = spark.createDataFrame([(3, big, 1, 2)], "id long, f long, first long, second long")
    (row,) = collocations.phrases([words, two])[0].collect()
    assert (row.score, row.l, row.r, row.phrase) == (2_000_000 * big // (2 * big + 9), big + 7, big + 2, "a b")


def test_empty_and_extra(spark):
    docs = spark.createDataFrame([(1, "a b a b a b", "en", 5)], SCHEMA + ", n int")
    assert collocations.collocations(docs.limit(0)).count() == 0
    (row,) = [r for r in collocations.collocations(docs, 2, 3).collect()]
    assert (row.phrase, row.a, row.l, row.r, row.n, row.score) == ("a b", 3, 3, 3, 6, 1_000_000)
    with pytest.raises(ValueError):
        collocations.collocations(docs, 1)


@pytest.mark.parametrize("size", [7, 60])
def test_many_groups(spark, rows, monkeypatch, size):
    """Items dealt to hundreds of groups, of which each chunk fills some; the driver says how many there are."""
    monkeypatch.setattr(collocations, "GROUP_ITEMS", size)
    want = sorted(brute(rows, 4, 5, 2000, 80))
    assert want and made(spark, rows, 4, 5, 2000, 80) == want


def test_blocks_are_small():
    """What a chunk sends for a pair that occurs once: a few bytes and no row of its own."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sequence = np.minimum(rng.zipf(1.2, 400_000), 60_000).astype(np.int64) - 1
    ids = np.sort(rng.choice(1 << 30, 60_000, replace=False)).astype(np.int64)
    pairs = len(collocations.pairs(sequence)[3])
    batch = pa.RecordBatch.from_pydict({"chunk": [5], "sequence": [collocations._packed(sequence, ids)]})
    blocks = list(collocations._dealt_pairs(8)(iter([batch])))
    assert len(blocks) == 8 and sum(b.nbytes for b in blocks) < 6 * pairs
    got = [collocations._unpacked(b.column("items")[0].as_py(), 4) for b in blocks]
    assert sorted(collocations._walked(np.concatenate([g[0][:1] for g in got])[:1]).tolist()) == [0] and sum(len(g[0]) for g in got) == pairs
    assert sum(int(g[3].sum()) for g in got) == len(sequence) - 1
