"""Fill-in-the-middle against units cut by regular expressions, and round trips."""

import hashlib
import re

import pytest

from cairnlake.llm import fill_middle

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"\A[ \t\n\v\f\r]+\Z|\A[ \t\n\v\f\r]*[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", "chars": r"(?s:.)"}
TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one\ntwo\nthree", "one\ntwo\nthree\n", "é\U0001f600\nü x\n" * 30, "a <P> b\nc", "x<S>", "<M>", "< P>\n<P\n<", "a\n<", "  lead and trail  ", " \t\n", " a",
    "word " * 4000, "\r\nx\r\ny", "a\0b\n" * 3, "S>\nM>\nP>\n" * 5,
]


def brute(doc_id, text, unit, rate, suffix_first):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_against_brute_force(spark, unit):
    rows = [(k * 100 + i, t) for i, t in enumerate(TEXTS) for k in range(6)] + [(None, "a\nb c\n"), (3, "x"), (3, "x")]
    docs = spark.createDataFrame([(i, t, 7, "f") for i, t in rows], "doc_id long, text string, n int, row string")
    made = fill_middle.fill_in_middle(docs, unit, 80, 50)
    assert made.columns == ["doc_id", "row", *fill_middle.ADDED]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((i, *brute(i, t, unit, 80, 50)) for i, t in rows), key=str)
    back = sorted(((r.doc_id, r.text) for r in fill_middle.restored(made).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    assert fill_middle.restored(fill_middle.fill_in_middle(docs.limit(0), unit)).count() == 0


def test_own_sentinels(spark):
    docs = spark.createDataFrame([(i, "a|b\nc|fim\n<P>") for i in range(8)], "doc_id long, text string")
    marks = ("|pre>", "|suf>", "|mid>")
    made = fill_middle.fill_in_middle(docs, sentinels=marks)
    assert {r.form for r in made.collect()} <= {"psm", "spm"} and all(r.text == "a|b\nc|fim\n<P>" for r in fill_middle.restored(made, marks).collect())
    for bad in (("", "b", "c"), ("ab", "ab", "c"), ("a", "ab", "c"), ("aba", "c", "d"), ("ab", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, sentinels=bad)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, "pages")
