"""Small cases and brute force for the operators of cairnlake.llm."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import (
    boosting, chat_format, decontaminate, deep_shallow, line_dedup, ngram_join, packing, quality_rules, sharding, substring_dedup, suffix_dedup,
    url_filter, windows,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, 3000, n))


def alike_sums(n):
    """Two different words that agree under any polynomial hash modulo 2**64."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    one = "".join("ac"[b] for b in bits[:n])
    return one, one.translate(str.maketrans("ac", "ca"))


@pytest.fixture(scope="module")
def docs(spark):
    """Exact and near copies, shared passages, empty, null, short and periodic texts, a repeated row, clashing columns."""
    base, passage = prose(1, 300), prose(2, 60)
    rows = [(1, base), (2, base), (3, base.replace(" w", " v", 2)), (4, prose(3, 200) + " " + passage), (5, passage + "\n" + prose(4, 100)), (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "one two"),
            (11, "ab" * 400), (12, "é" * 150 + " x"), (13, prose(5, 30)), (13, prose(5, 30)), (14, prose(6, 2500)), (15, "a\nb c\nd\n" * 4), (None, base[:500])]
    for k in range(40):  # a large group of near copies
        words = prose(7, 120).split()
        words[k * 3] = "changed"
        rows.append((100 + k, " ".join(words)))
    return spark.createDataFrame([(i, t, 1, "x", False) for i, t in rows], DOCS + ", bin int, unit string, hot boolean")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(spark):
    block = "\n".join(f"line {i} of a block" for i in range(40))
    rows = [(1, f"start\n{block}\nend"), (2, f"other\nmore\n{block}"), (3, None), (4, ""), (5, "x"), (6, block), (6, block), (None, "only"), (7, "\n\n\n\n"), (8, "x"), (9, f"a\n\n{block}\n \nb")]
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    told = lambda r: (r.text, r.n_chunks, r.removed_chunks, r.removed_lines)
    assert told(got[(1, 42)]) == (rows[0][1], 1, 0, 0) and told(got[(2, 42)]) == ("other\nmore", 2, 1, 40) and told(got[(6, 40)]) == ("", 1, 1, 40)
    assert told(got[(9, 44)]) == ("a\n\n \nb", 3, 1, 40)
    assert got[(3, 0)].text is None and got[(3, 0)].n_chunks == 0 and got[(4, 1)].text == "" and got[(5, 1)].text == got[(8, 1)].text == "x" and got[(7, 5)].removed_chunks == 0
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    kept = line_dedup.dedup_lines(spark.createDataFrame([(1, "a", 7, 8)], DOCS + ", key int, lines_of int"))
    assert kept.columns[:4] == ["doc_id", "key", "lines_of", "text"]
    names = ["lines", "h", "out", "gone", "removed_id", "removed_digest", "row", "n_lines", "digest", "left", "i", "at"]
    clash = spark.createDataFrame([(i, block, *range(len(names))) for i in (1, 2)], DOCS + "".join(f", {n} int" for n in names))
    rows = line_dedup.dedup_lines(clash).orderBy("doc_id").collect()
    assert [(r.n_lines, r.removed_lines) for r in rows] == [(40, 0), (40, 40)]
    assert all(r[n] == i for r in rows for i, n in enumerate(names) if n != "n_lines")
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(clash, 0)


def test_line_dedup_tells_rows_apart(spark):
    rows = [(1, "m\nn"), (2, "m\nuu"), (2, "pp\nqq"), (None, "a\nx"), (None, "b\nx"), (None, "c\nd"), (None, "c\nd")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), least=1).collect()
    texts = Counter((r.doc_id, r.text) for r in got)
    one, two = sorted(("a\nx", "b\nx"), key=lambda t: hashlib.md5(t.encode()).digest())
    assert texts == Counter([(1, "m\nn"), (2, "uu"), (2, "pp\nqq"), (None, one), (None, two[0]), (None, "c\nd"), (None, "c\nd")])
    assert sorted(r.removed_lines for r in got) == sorted(r.removed_chunks for r in got) == [0, 0, 0, 0, 0, 1, 1]


def brute_lines(rows, least):
    """Lines left of each text, by looking at every window of visible lines."""
    seen, out = set(), []
    for _, text in rows:
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\r")]
        gone = set()
        for k in range(len(at) - least + 1):
            window = tuple(lines[i] for i in at[k : k + least])
            if window in seen:
                gone |= set(range(at[k], at[k + least - 1] + 1))
            seen.add(window)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup_of_planted_passages(spark, least):
    """Passages of two lines and more between foreign lines, copies, runs of one line and blank lines among them."""
    rng = np.random.default_rng(12)
    line = lambda: " ".join(f"w{i}" for i in rng.integers(0, 50_000, 8))
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 4, 6, 8) for _ in range(5)]
    rows = []
    for i in range(120):
        body = [line() for _ in range(int(rng.integers(1, 6)))]
        body += passages[i % len(passages)] + [line() for _ in range(int(rng.integers(1, 6)))]
        if i % 4 == 0:
            body.insert(int(rng.integers(len(body))), "")
        rows.append((i, "\n".join(body)))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, "same\n" * 9), (301, "same"), (302, "x\n\nsame\nsame")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), least).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows, least)
    if least == 2:
        assert all(got[200 + i] == "" for i in range(10) if "" not in rows[i][1].split("\n"))
        kept = Counter(x for i, t in got.items() if 30 <= i < 120 for x in t.split("\n"))
        assert not any(kept[x] for p in passages for x in p if x)


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """Lines whose hashes agree but whose bytes don't keep all windows that they are in."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [(1, "aa\nbbb"), (2, "cc\nbbb"), (3, "dddd\neeeee"), (4, "dddd\neeeee")]
    df = spark.createDataFrame(rows, DOCS)
    gone = line_dedup.repeated(df).collect()
    monkeypatch.undo()
    assert [(r.doc_id, r.gone) for r in gone] == [(4, [0])]


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| |> \\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "assistant", None), (None, 0, "user", "x"), (3, 1, "user", "b"), (3, 0, "sys\ntem\\n", "a"), (3, 1, "user", "b"), (4, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        said = "".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))
        learnt = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and not got[3].valid
    whole = "".join(r.text for r in segments.where("conv_id = 1").orderBy("seq").collect())
    assert whole.count("<|im_start|>") == 2 and got[1].formatted_chars == len(whole)
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_template_marks_are_control_strings():
    with pytest.raises(ValueError):
        chat_format.Template(open="[INST]")


def brute_statistics(text):
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, texts):
    trees = quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judge(docs, trees).collect())
    want = Counter()
    for i, t in texts:
        b = brute_statistics(t)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want[(i, *b, failed, not failed)] += 1
    assert got == want
    assert quality_rules.judge(empty(spark), trees).count() == 0


def test_statistics_compare_bytes():
    import pyarrow as pa

    from cairnlake.llm import textscan as ts

    x, y = alike_sums(2048)
    texts = [f"{x}\n{y}", f"{x} a b {y} a b {x} a b", "", "a b c\na b c\n \n a b c", "\n\n", "ab " * 30_000, f"{x}\n{x}"]
    count, _ = quality_rules.statistics(*ts.utf8(pa.array(texts)))
    assert list(zip(*(v.tolist() for v in count.values()), strict=True)) == [brute_statistics(t) for t in texts]


@pytest.mark.parametrize("only", [0, 1])
def test_labels_of_one_kind_keep_all(spark, docs, only):
    labels = spark.createDataFrame([(i, only, 0) for i in (1, 2, 3, 4, 14)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()
    assert all(r.kept != r.base_failed for r in rows) and any(r.kept for r in rows)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + 0.1 * rng.standard_normal(3000) < 0.5).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], {0: -1})
    held_out = (trees.probability(x[2000:]) > 0.5) == (y[2000:] == 1)
    assert held_out.mean() > 0.85
    grid = np.repeat(rng.random((50, 3)), 30, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 30), 50)
    assert (np.diff(trees.margin(grid).reshape(50, 30), axis=1) <= 1e-12).all()


def test_held_out_accuracy(spark):
    good = [(i, prose(i, 100)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "***" for w in prose(i, 100).split())) for i in range(150)]
    df = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad if i % 2] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(df, quality_rules.train(df, labels)).where("doc_id % 2 = 0").collect()
    assert np.mean([r.kept == (r.doc_id < 1000) for r in rows]) > 0.95


def test_sharding(spark, docs, texts):
    for df, rows in ((docs, texts), (empty(spark), [])):
        got = sharding.shard(df, 5).collect()
        assert len(got) == len(rows)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        for shard, members in by.items():
            assert 0 <= shard < 5 and sorted(r.slot for r in members) == list(range(len(members)))
    even = spark.createDataFrame([(i, "x" * 92) for i in range(1000)], DOCS)  # one text in all rows
    sizes = [r["sum(size)"] for r in sharding.shard(even, 7).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 200


def shingles(text, n=5):
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_decontamination(spark, docs, texts):
    items = [(1, prose(2, 60)), (2, prose(2, 30)), (3, prose(99, 40)), (4, "one two"), (5, None), (6, prose(1, 300)), (7, prose(6, 2500)[3000:9000]), (8, prose(2, 60) + " " + prose(98, 10)), (None, prose(2, 60))]
    df = spark.createDataFrame(items, "item_id long, text string")
    held = defaultdict(set)
    for i, t in texts:
        held[i] |= shingles(t)
    want = set()
    for k, t in items:
        s = shingles(t or "")
        want |= {(i, k, len(s), len(s & h)) for i, h in held.items() if s and k and i is not None and len(s & h) >= 0.8 * len(s)}
    assert {tuple(r) for r in decontaminate.find(docs, df).collect()} == want and len(want) >= 8
    assert decontaminate.find(empty(spark), df).count() == 0 and decontaminate.find(docs, df.limit(0)).count() == 0


def test_deep_shallow_against_sets():
    rng = np.random.default_rng(1)
    for trial in range(8):
        base = rng.integers(97, 99 if trial % 2 else 123, 300).astype(np.uint8)
        parts = [base.copy() for _ in range(25)]
        for p in parts:
            p[rng.integers(0, 300, rng.integers(0, 3))] = 65
        buf = np.concatenate(parts)
        pos = np.concatenate([np.arange(o, o + 101) for o in range(0, len(buf), 300)])
        group = np.repeat(rng.integers(0, 3, 25), 101)
        kind = deep_shallow.classes(buf, pos, group, 200)
        by = defaultdict(set)
        for i, (p, g) in enumerate(zip(pos, group, strict=True)):
            by[(g, buf[p : p + 200].tobytes())].add(kind[i])
        assert all(len(s) == 1 for s in by.values()) and len(by) == len(set(kind))


@pytest.mark.parametrize("most", [2000, 1])
def test_suffix_dedup(spark, docs, texts, monkeypatch, most):
    """most = 1: no bucket, every repeated minimiser takes the way of the very frequent ones."""
    monkeypatch.setattr(suffix_dedup, "BYTES", windows.Kind(200, 64, suffix_dedup.byte_symbols, most))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.find_repeats(docs).collect())
    raw = [(i, t.encode()) for i, t in texts]
    seen = Counter(b[j : j + 200] for _, b in raw for j in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())] += 1
    assert got == want
    assert suffix_dedup.find_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "WORDS", windows.Kind(13, 4, substring_dedup.word_symbols, most))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs).collect())
    key = lambda i: -1 if i is None else i
    least = {}
    for i, t in texts:
        w = WORD.findall(t)
        for j in range(len(w) - 12):
            least[tuple(w[j : j + 13])] = min(key(i), least.get(tuple(w[j : j + 13]), 1 << 60))
    want = Counter()
    for i, t in texts:
        w = WORD.findall(t)
        gone = {k for j in range(len(w) - 12) if least[tuple(w[j : j + 13])] < key(i) for k in range(j, j + 13)}
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    assert got == want
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_repeated_streams_hold_little():
    """A value whose rows go over many batches, with a sum over the bound, is told as a whole."""
    import pyarrow as pa

    def batch(places, n=1):
        return pa.RecordBatch.from_arrays([pa.array(places), pa.array(places), pa.array(range(len(places)), pa.int32()), pa.array([n] * len(places), pa.int32())], ["place", "rid", "number", "n"])

    told = [batch([1, 2, 2, 3]), batch([3] * 4), batch([3] * 4), batch([3, 4, 5]), batch([5]), batch([6, 7]), batch([7], windows.SUMMARY), batch([7]), batch([8], windows.SPREAD)]
    got = pa.Table.from_batches(windows._repeated(5)(told)).to_pydict()
    assert Counter((r, c % 2) for r, c in zip(got["rid"], got["code"], strict=True)) == {(2, 0): 2, (3, 1): 10, (5, 0): 2, (7, 1): 2, (8, 1): 1}


def test_windows_are_compared_by_their_bytes(spark):
    x, y = alike_sums(2048)
    head = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {y}")], DOCS)
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(df).collect()} == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("crowd", [32, 10_000])
def test_repeated_rows_stay_linear(spark, monkeypatch, crowd):
    """Rows that repeat doc_id and text are packed once for a batch; as one group of r rows they would be r * r pieces."""
    monkeypatch.setattr(windows, "CROWD", crowd)
    text, other = prose(21, 250), prose(22, 250)
    df = spark.createDataFrame([(1, text)] * 3000 + [(2, other), (3, text)], DOCS)
    got = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.find_repeats(df).collect())
    assert got == {(1, len(text)): 3000, (2, 0): 1, (3, len(text)): 1}
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.dedup(df).collect())
    assert got == {(1, 0): 3000, (2, 0): 1, (3, 250): 1}


def test_very_long_texts(spark):
    """A text of 3 MB twice, but for one word, and a batch of more than 8 MB."""
    words = prose(50, 500_000).split()
    at = 250_000
    near = [*words[:at], "different", *words[at + 1 :]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), *((10 + i, prose(60 + i, 150_000)) for i in range(8))]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    assert {i: (r.n_words, r.n_removed) for i, r in got.items() if i < 10} == {1: (500_000, 0), 2: (500_000, 499_999)} and got[2].kept == "different"
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.find_repeats(df).collect()}
    assert got[1] == (len(rows[0][1]) - len(words[at]), 2) and got[2] == (len(rows[1][1]) - len("different"), 2) and got[10] == (0, 0)
    joined = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()}
    assert joined == {1: (1, 1), 2: (1, 1), **{10 + i: (10 + i, 0) for i in range(8)}}
    trees = quality_rules.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.n_words for r in quality_rules.judge(df, trees).collect()}[2] == 500_000
    item = spark.createDataFrame([(1, " ".join(near[at - 8 : at + 8])), (2, " ".join(words[:30]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(df, item).collect()} == {(2, 1), (1, 2), (2, 2)}
    lines = df.withColumn("text", F.regexp_replace("text", "((?:[^ ]+ ){10})", "$1\n"))
    left = {r.doc_id: r for r in line_dedup.dedup_lines(lines).collect()}
    assert left[1].removed_lines == 0 and left[2].removed_lines > 30_000
    assert {r.doc_id: r.size for r in sharding.shard(df, 5).collect()}[1] == len(rows[0][1]) + 8
    parts = packing.pack(packing.pieces(df, packing.tokenizer_path()))
    assert parts.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty() and parts.where("doc_id = 1").count() > 200
    chats = df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert {r.conv_id: r.n_turns for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}[1] == 1


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    parts = packing.pieces(docs, path, length=64).cache()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 64)):
            want[(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()))] += 1
    rows = packing.pack(parts, 64, 32).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for members in by.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= 1.05 * total / 64 + 2
    assert packing.pack(packing.pieces(empty(spark), path)).count() == 0


def test_packing_by_any_tokenizer(spark):
    """A tokenizer that tells cases apart and joins punctuation gets whole texts."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    text = "Some Words, SOME words  (and)\n\n more... n\u00e9!"
    rows = packing.pieces(spark.createDataFrame([(1, text), (2, None), (3, "x")], DOCS), path, length=1024).collect()
    tokenizer = Tokenizer.from_file(path)
    for i, t in ((1, text), (2, ""), (3, "x")):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert [(r.length, r.ids_crc32) for r in rows if r.doc_id == i] == [(len(ids), zlib.crc32(ids.tobytes()))]
    assert not packing.WordTokenizer(path).by_parts and packing.WordTokenizer(packing.tokenizer_path()).by_parts


def test_word_parts_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    from cairnlake.llm import textscan as ts

    path = packing.tokenizer_path()
    texts = ["It's Ok... don't; É!à.b <|endoftext|> <|ENDOFTEXT|> x", "a,b.c!?d ÀÉ.É ×. ÷.x é́.", "", "x….y 12.5% (a)b", "İ.I ß. naïve.Café:", *(" ".join(alike_sums(64)) for _ in range(2)), *alike_sums(2048)]
    import pyarrow as pa

    buf, off = ts.utf8(pa.array(texts))
    ids, at = packing.WordTokenizer(path).encode(buf, off)
    plain = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_url_filters(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    rows = [
        (1, "https://a.example.org/es/x", None), (2, "http://b.net/p", link.format("https://a.example.org/es/x")), (3, "http://c.net/q?z=1", '<meta http-equiv="refresh" content="0; url=http://b.net/p">'),
        (4, "http://d.org/ok", link.format("http://c.net/q?z=1")), (5, "http://e.net", link.format("/other")), (6, None, "x"), (7, "no scheme", None), (8, "HTTP://WWW.Example.COM/de/1?x#y", None),
        (9, "http://f.net/", link.format("http://g.com/de/")), (10, "http://x.example.org/en/12", ""), (11, "http://com/fr/", None), (12, "http://f.net/", None),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, node string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("org/", "allow")
    assert got[2][2:] == (None, "allow") and got[3][2:] == (None, "allow")  # an allowed alias takes precedence
    assert got[5] == ("e.net", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("www.example.com", "/de/1", "com/de/", "block")
    assert got[9][2:] == (None, "block") and got[12][2:] == (None, "block")
    assert got[10][2:] == ("example.org/en/1", "block") and got[11][2:] == ("com/fr/", "allow")
    many = [*url_filter.RULES, *(("block", f"n{i}.example", "/") for i in range(100))]
    assert {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, many).collect()} == got
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_targets(spark):
    from urllib.parse import urljoin

    base = ["http://h.net/a/p", "http://h.net", "http://h.net/a/b/?q=1", "http://h.net/a/b/c.html#top"]
    refs = ["?x=1", "../c", "../../../c", "./d", "e/../f", "/g/./h", "//k.net/x", "http://m.net/", "..", ".", "", "#z", "mailto:a@b", "../", "k?y=/../z"]
    pages = [(i, b, f'<link href="{r}" rel="nofollow Canonical">') for i, (b, r) in enumerate((b, r) for b in base for r in refs)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    plain = lambda u: u.split("#")[0].split("://", 1)[1]
    want = {}
    for b in base:
        for r in refs:
            if r and not r.startswith(("#", "mailto")):
                node = plain(urljoin(b + ("/" if b.count("/") == 2 else ""), r))
                want[(b, r)] = node if "/" in node else node + "/"
    rows = url_filter.links(df).select("url", url_filter.node_of(F.col("target")).alias("node")).collect()
    assert Counter((r.url, r.node) for r in rows) == Counter((b, n) for (b, _), n in want.items())


def test_url_groups_against_union_find(spark):
    """Chains, cycles, stars, targets that are no page, and groups with allowed and blocked members."""
    rng = np.random.default_rng(3)
    hosts = ["a.net", "b.net", "x.org", "www.example.org", "d.com"]
    paths = ["/p{}", "/es/{}", "/en/1{}", "/fr/{}", "/de/{}", "/q?i={}"]
    urls = [f"http://{hosts[rng.integers(5)]}{paths[rng.integers(6)].format(i)}" for i in range(400)]
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 40) for i in range(40)] + [(200, 201 + i) for i in range(50)]
    edges += [tuple(rng.integers(250, 400, 2).tolist()) for _ in range(60)]
    html = defaultdict(str)
    for a, b in edges:
        html[a] += f'<link rel=canonical href="{urls[b]}">' if (a + b) % 2 else f'<meta http-equiv="refresh" content="1;url={urls[b]}">'
    shown = [i for i in range(400) if i % 7]  # the others are only targets
    df = spark.createDataFrame([(i, urls[i], html[i] or None) for i in shown], "page_id long, url string, html string")
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in set(shown):
            parent[find(a)] = find(b)
    last = {(h, p): v for v, h, p in url_filter.RULES}

    def rule(url):
        host, path = url.split("://")[1].split("/", 1)
        path = "/" + path.split("?")[0]
        fits = [(len(h + p), h + p, v) for (h, p), v in last.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    said = defaultdict(set)
    for i in range(400):
        said[find(i)].add(rule(urls[i])[1])
    want = {}
    for i in shown:
        name, verdict = rule(urls[i])
        group = said[find(i)]
        want[i] = (name, verdict or ("allow" if "allow" in group else "block" if "block" in group else "allow"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == want and Counter(v for n, v in want.values() if n is None)["block"] >= 10


def brute_join(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall(t)
        sets[math.inf if i is None else i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    real = lambda i: None if i == math.inf else i
    return {real(i): (real(find(i)), links[i]) for i in sets}


@pytest.mark.parametrize(("texts_in_chunk", "most"), [(1024, None), (8, None), (8, 2)])
def test_ngram_join(spark, docs, texts, monkeypatch, texts_in_chunk, most):
    """Units as wholes, in chunks, and replaced by their buckets."""
    monkeypatch.setattr(ngram_join, "CHUNK_TEXTS", texts_in_chunk)
    monkeypatch.setattr(ngram_join, "MOST_CHUNKS", most)
    got = ngram_join.join(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_join(texts)
    assert len(got) == len(texts)


def test_keep_one(spark, docs, texts):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {c for c, _ in brute_join(texts).values()} - {None}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(classes)
    assert kept.where("doc_id IS NULL").count() == 1  # its text is a part of others, too short to be alike
    assert ngram_join.join(empty(spark)).count() == 0


def test_join_with_null_doc_ids(spark):
    """Texts without doc_id are linked like others, equal ones count as one, and a class of them alone has no id."""
    a, b = prose(41, 80), prose(42, 80)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(None, a), (7, a), (None, near(a)), (None, b), (None, b), (None, near(b)), (8, prose(43, 80)), (None, None)]
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_texts, r.n_copies) for r in ngram_join.join(spark.createDataFrame(rows, DOCS)).collect())
    want = [(None, 7, 2, 1, 2), (7, 7, 2, 1, 2), (None, 7, 2, 1, 1), (None, None, 1, 1, 1), (None, None, 1, 1, 1), (None, None, 1, 1, 1), (8, 8, 0, 0, 1), (None, None, 0, 0, 1)]
    assert got == Counter(want)


def test_redirects_without_scheme(spark):
    """An edge whose url or target has no host ties nothing together."""
    pages = [(1, None, None), (2, "no scheme", None), (3, "http://com/de/x", None), (4, "http://y.net/", None)]
    edges = [("no scheme", "http://com/de/x"), ("http://y.net/", "other"), ("", "http://com/de/x"), ("http://y.net/", "http://com/de/x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, redirects=spark.createDataFrame(edges, "url string, target string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block"}


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", prose(2, 60)), ("b", prose(3, 60))], "doc_id string, text string")
    items = spark.createDataFrame([("x", prose(2, 30)), ("y", prose(4, 30))], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.find(docs, items).collect()] == [("a", "x", 26, 26)]


def test_texts_under_one_doc_id(spark):
    """Each text is judged by its own set: unlike ones under one doc_id stay, and near copies of either are found."""
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 80)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, b), (1, b), (2, near(a)), (3, near(b)), (4, c), (5, c), (5, a), (6, ""), (6, " "), (7, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(df).collect())
    assert got == Counter([(1, 1, 2, 2), (1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 2, 1), (3, 1, 1, 1), (4, 4, 1, 2), (5, 4, 1, 2), (5, 1, 2, 2), (6, 6, 0, 1), (6, 6, 0, 1), (7, 7, 0, 1)])
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect())
    assert kept == Counter([(1, a), (1, b), (4, c), (6, ""), (6, " "), (7, None)])
    some = spark.createDataFrame([(None, a, 1), (None, near(a), 2), (None, b, 3), (3, near(b), 4), (None, None, 5)], DOCS + ", kept_id int")
    kept = ngram_join.keep_one(some)
    assert kept.columns == some.columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    assert rows == Counter([(None, min(a, near(a), key=lambda t: hashlib.md5(t.encode()).hexdigest())), (3, near(b)), (None, None)])


def test_sets_are_compared_by_their_bytes(spark):
    x, y = alike_sums(2048)
    head = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}"), (3, " ".join([x] * 6)), (4, " ".join([y] * 6)), (5, x), (6, y)], DOCS)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(df).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 0, 1), 4: (4, 0, 1), 5: (5, 0, 1), 6: (6, 0, 1)}  # 1 and 2 share 8 of 10


def test_bands():
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_quality_verdicts_of_documents_that_were_not_labelled(spark):
    """Fitted on seven tenths of the labels, the trees tell the rest."""
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 3
    told = quality_rules.judge(documents, quality_rules.train(documents, labels.where(~held))).where("NOT base_failed").join(labels.where(held), "doc_id")
    right = Counter((r.quality, r.kept) for r in told.select("quality", "kept").collect())
    assert sum(right.values()) > 50 and right[1, True] + right[0, False] >= 0.95 * sum(right.values())
    assert right[1, True] >= 0.95 * (right[1, True] + right[1, False])


def test_shards_of_uneven_texts(spark):
    """Sizes near equal with a group of a third of all rows, groups whole up to a fiftieth of a shard, large ones as neighbours."""
    rng = np.random.default_rng(6)
    rows = [(i, "hot " * 30) for i in range(700)] + [(1000 + i, prose(i, int(rng.integers(1, 200)))) for i in range(1300)]
    rows += [(5000 + 4 * i + k, prose(9000 + i, 8)) for i in range(60) for k in range(4)]
    out = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(5), 6).collect()
    bytes_of, shards, slots = Counter(), defaultdict(set), defaultdict(list)
    texts = dict(rows)
    for r in out:
        bytes_of[r.shard] += r.size
        shards[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    target = sum(bytes_of.values()) / 6
    assert len(bytes_of) == 6 and max(abs(b - target) for b in bytes_of.values()) < 0.05 * target
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    small = [t for t, n in Counter(texts.values()).items() if n > 1 and n * (len(t) + 8) <= target * sharding.WHOLE]
    assert len(small) >= 50 and all(len(shards[t]) == 1 for t in small)
    hot = sorted(shards["hot " * 30])
    assert hot == list(range(hot[0], hot[-1] + 1)) and len(hot) > 1
