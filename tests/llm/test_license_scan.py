"""License scans against a brute-force scan with Python's regular expressions, and odd rows."""

import re

import pytest

from cairnlake.llm import license_scan
from cairnlake.llm.license_rules import BASE, NAMES, REACH, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text, found):
    """(n_words, n_base, first, last, base labels, labels, score) by trying every rule at every word."""
    words = WORD.findall((text or "").translate(LOWER))
    hits = []
    for i, w in enumerate(words):
        before = " " + " ".join(words[max(0, i - REACH) : i]) + " "
        after = " " + " ".join(words[i + 1 : i + 1 + REACH]) + " "
        for r in found:
            if r.keyword == w and (a := re.search(r.before, before)) and (b := re.search(r.after, after)):
                hits.append((i + 1 - a[0].count(" "), i + b[0].count(" "), r))
    rank = lambda h: (-h[2].priority, h[0] - h[1], h[2].order)
    kept = [h for h in hits if h[2].base or not any(g[0] <= h[0] and g[1] >= h[1] and rank(g) < rank(h) for g in hits)]
    base = [h for h in kept if h[2].base]
    names = lambda hs: ",".join(sorted({h[2].label for h in hs}))
    starts = [h[0] for h in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), names(base), names(kept), max((h[2].weight for h in kept), default=0.0)


TEXTS = [
    None, "", " \n.,", "plain words only", "CC BY", "cc by cc by cc-by", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "the mit license, or the MIT-0",
    "This work is licensed under the GNU General Public License, version 3.", "general public license general public license", "All rights reserved. ALL RIGHTS RESERVED!",
    "GNU Lesser General Public License v2.1 or the GNU Affero General Public License", "Released under the MIT License.", "éall rights reserved", "all rights\0reserved\U0001f600 x",
    "You may not use this file except in compliance with the License. Apache License, Version 2.0", "neither the name of the big company nor the names of its contributors may be used to endorse",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "copyright (c) 2001 2004, confidential and proprietary", "by cc", "cc", "reserved", "KMIT License",
    "word " * 3000 + "all rights reserved " + "word " * 3000, "all rights reserved mit license cc by " * 200,
]


def test_against_brute_force(spark):
    found = rules()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in docs.transform(license_scan.scan).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t, found), t


def test_every_rule_finds_its_wording(spark):
    """A sample of every pattern, the shortest that it allows, gives its label unless a base phrase or a better rule of the same words does."""

    def sample(pattern):
        p = pattern.strip("^$")
        while (q := re.sub(r"\((?:\?:)?[^()]*\)\?", "", p)) != p:
            p = q
        p = re.sub(r"\(\?:\[\^ \]\+ \)\{(\d),\d\}", lambda m: "some " * int(m[1]), p)
        while (q := re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)*\)", r"\1", p)) != p:
            p = q
        p = re.sub(r"\[\^ \]\+", "some", p).replace("[0-9]{2}", "19").replace("[sc]", "s")
        return re.sub(r"(?:\[(\w)[^\]]*\])", r"\1", re.sub(r".\?", "", p))

    found = rules()
    texts = [(sample(r.before) + r.keyword + sample(r.after)).strip() for r in found]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, r in enumerate(found):
        assert len(texts[i].split()) <= 2 * REACH and got[i].labels, (r, texts[i])
        hit = [h for h in brute(texts[i], [r])[5:6]]
        assert hit == [r.label], (r, texts[i])


def test_suppression_and_odd_rows(spark):
    text = "licensed under the GNU Lesser General Public License version 3"
    docs = spark.createDataFrame([(None, text, 1, "x"), (5, text, 2, "y"), (5, text, 2, "y"), (5, "nothing", 3, None)], "doc_id long, text string, labels int, n_words string")
    out = license_scan.scan(docs)
    assert out.columns == ["doc_id", "text", *license_scan.ADDED]
    rows = out.collect()
    assert len(rows) == 4
    for r in rows[:3]:
        assert (r.base_labels, r.labels, r.n_base, r.first_word) == ("gpl", "gpl,lgpl-3.0", 1, 5)
        assert [d.label for d in r.detections] == ["gpl", "lgpl-3.0"] or [d.label for d in r.detections] == ["lgpl-3.0", "gpl"]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_rules():
    found = rules()
    assert len(found) > 400 and [r.order for r in found] == list(range(len(found))) and len({n for n, _, _ in NAMES}) == len(NAMES)
    assert sum(r.base for r in found) == len(BASE)


@pytest.mark.parametrize("word", ["Redistribution", "x"])
def test_gate(word):
    gate = re.compile(license_scan._gate(["redistribution", "red"]).replace("(?i)", ""), re.I | re.A)
    assert bool(gate.search(f"é.{word}\n")) == (word != "x") and not gate.search("éred") and gate.search("red")
