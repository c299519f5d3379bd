"""Fill-in-the-middle: texts cut at unit boundaries into prefix, middle and suffix, and put in another order between sentinels.

One Aho-Corasick automaton finds the events of a text in a single scan: the ASCII characters at which the class of
characters changes (line feeds for lines, white space for words) and the sentinels.  The gaps between events hold no
boundary inside, so how many units they have follows by arithmetic, and a cut after k units is a lookup by rank among
the boundaries that the events give.  Nothing is made per character.

Where a document is cut, and its form, comes from a hash of its doc_id, so it is the same in every run and on every
executor.  The work is one pass over the rows without a shuffle.

Nulls and edge cases: a null text is an empty one; an empty text, and one that contains a sentinel, stays plain, with null
prefix_chars and middle_chars; a null doc_id is hashed as no digits; repeated rows and equal doc_ids are cut alike; no rows
give no rows; extra columns are carried along, but for columns of the names that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read, small_batches

#: The marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The ASCII characters at which units change; characters themselves are units without any.
CHANGES = {"lines": "\n", "words": " \t\n\v\f\r", "chars": ""}
#: Of a hundred documents so many are rearranged, and of a hundred rearranged ones so many have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = "7"

#: The columns that fill_in_middle() adds.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def _check(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may be found where none was put: none begins another, and their first characters are only first."""
    heads = {s[:1] for s in sentinels}
    if "" in heads or any(h in s[1:] for h in heads for s in sentinels) or any(a != b and a.startswith(b) for a in sentinels for b in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels need a first character that none of them has further on, and none may begin another")


def _automaton(unit: str, sentinels: tuple[str, str, str]) -> ahocorasick.Automaton:
    """Finds class-changing characters (0) and sentinels (from 1, with their length)."""
    found = ahocorasick.Automaton()
    for c in CHANGES[unit]:
        found.add_word(c, (0, 1))
    for k, s in enumerate(sentinels, 1):
        found.add_word(s, (k, len(s)))
    found.make_automaton()
    return found


def events(found: ahocorasick.Automaton, text: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Places of class-changing characters, and (sentinel, start, end) of the sentinels, in order."""
    changes, marks = [], []
    for last, (kind, length) in found.iter(text):
        if kind:
            marks.append((kind, last + 1 - length, last + 1))
        else:
            changes.append(last)
    return changes, marks


def boundaries(unit: str, changes: list[int], length: int) -> np.ndarray | None:
    """Places inside a text where one unit ends and another begins; None: every place."""
    if unit == "chars":
        return None
    at = np.array(changes, np.int64)
    if unit == "words":  # a word begins behind white space that has a gap behind it; white space at the start belongs to the first
        gap = np.diff(np.append(at, length)) > 1
        at = at[gap]
        lead = len(changes) and changes[0] == 0
        at = at[1:] if lead and len(at) else at
    return at[at < length - 1] + 1


def cut(text_length: int, inner: np.ndarray | None, k: int) -> int:
    """The place behind the first k units."""
    if inner is None:
        return k
    return 0 if k == 0 else int(inner[k - 1]) if k <= len(inner) else text_length


def _rearranged(unit: str, sentinels: tuple[str, str, str], rate: int, suffix_first: int) -> Callable:
    p, s, m = sentinels

    def one(text: str, found: ahocorasick.Automaton, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
        changes, marks = events(found, text)
        inner = boundaries(unit, changes, len(text))
        n = len(text) if inner is None else len(inner) + 1 if text else 0
        if not text or marks or h[2] % 100 >= rate:
            return n, "plain", None, None, text
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = cut(len(text), inner, a), cut(len(text), inner, b)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < suffix_first:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(unit, sentinels)
        for batch in batches:
            made = [one(t or "", found, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * len(ADDED)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", *ADDED])

    return run


def fill_in_middle(
    documents: DataFrame, unit: str = "lines", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """The documents with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    _check(sentinels)
    if unit not in CHANGES:
        raise ValueError(f"units are {', '.join(CHANGES)}")
    small_batches(documents.sparkSession)
    others = [c for c in documents.columns if c not in ADDED]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))
    # The text travels beside the other columns, so that it is in the batch once.
    row = F.struct(*(F.col(c) for c in others if c != "text"), F.lit(0).alias("__one"))
    rows = documents.select(F.col("text").cast("string").alias("text"), h.alias("h"), row.alias("row"))
    schema = T.StructType().add(rows.schema["row"]).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    made = rows.mapInArrow(_rearranged(unit, sentinels, rate, suffix_first), schema)
    return made.select(*(F.col("row")[c].alias(c) for c in others if c != "text"), *ADDED)


def _rebuilt(sentinels: tuple[str, str, str]) -> Callable:
    def one(output: str, form: str, found: ahocorasick.Automaton) -> str:
        if form == "plain":
            return output
        _, marks = events(found, output)
        order = [k for k, _, _ in marks]
        if order != ([1, 2, 3] if form == "psm" else [2, 1, 3]):
            raise ValueError(f"an output of the form {form} has sentinels {order}")
        (_, _, a), (_, b, c), (_, d, e) = marks
        first, second, middle = output[a:b], output[c:d], output[e:]
        return first + middle + second if form == "psm" else second + middle + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton("chars", sentinels)
        for batch in batches:
            texts = [one(o, f, found) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return run


def restored(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows with the text that each had, rebuilt from output and form."""
    _check(sentinels)
    small_batches(made.sparkSession)
    others = [c for c in made.columns if c not in ("text", "output")]
    rows = made.select("output", "form", F.struct(*others, F.lit(0).alias("__one")).alias("row"))
    back = rows.mapInArrow(_rebuilt(sentinels), T.StructType().add(rows.schema["row"]).add("text", "string"))
    return back.select(*(F.col("row")[c].alias(c) for c in others), "text")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(made.withColumn("output_sha256", F.sha2(F.encode("output", "UTF-8"), 256)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, l, CAST(len(l) AS BIGINT) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(l[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
        array_to_string(l[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
        array_to_string(l[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 : n], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
