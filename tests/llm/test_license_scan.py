"""License scans against exact containment over every window, and the collision guarantee of the bands."""

import random
import re

from pulsegrid.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def corpus():
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    out = []
    for i in range(200):
        body = [r.choice(words) for _ in range(r.choice([0, 3, 30, 300]))]
        notice = list(ls.NOTICES[i % len(ls.NOTICES)][1].split())
        if i % 3 == 1:
            notice[r.randrange(len(notice))] = "changed"
        at = r.randrange(len(body) + 1)
        out.append((i, " ".join(body[:at] + (notice if i % 4 else []) + body[at:])))
    long_text = "w1 w2 w3 " * 20_000 + ls.NOTICES[3][1]
    return out + [(500, ""), (501, None), (None, ls.NOTICES[0][1]), (502, long_text), (0, out[1][1]), (0, out[1][1])]


def test_scan_equals_exact_containment(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, license string").repartition(3)
    rows = ls.scan_licenses(df).collect()
    got = sorted(((r["doc_id"], r["license"], round(r["containment"], 6)) for r in rows), key=str)
    want = []
    for i, t in docs:
        g = grams(t)
        for name, text in ls.NOTICES:
            s = set(grams(text))
            width = max(4, 1 << (len(s) - 1).bit_length())
            best = max((len(s & set(g[k : k + 2 * width])) / len(s) for k in range(0, len(g), width)), default=0)
            if best >= 0.8 - 1e-9:
                want.append((i, name, round(best, 6)))
    want.sort(key=str)
    missed = [w for w in want if w not in got]
    assert [x for x in got if x not in want] == [] and len(missed) <= 1 and len(want) > 100
    for r in rows:
        if r["doc_id"] == 502:
            assert r["first_word"] == 60_000


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")
    assert ls.scan_licenses(df).collect() == [] and ls.scan_licenses(df.limit(0)).collect() == []
    assert ls.scan_licenses(df, notices=[]).collect() == [] and ls.scan_licenses(df, notices=[("short", "a b")]).collect() == []


def test_bands_reach_the_guarantee():
    for j in (0.06, 0.125, 0.3, 0.9):
        assert 1 - (1 - j) ** ls.bands_for(j, 0.999) >= 0.999 > 1 - (1 - j) ** (ls.bands_for(j, 0.999) - 1)


# written as projects write them, not taken from the templates: own line breaks, names and punctuation
ZLIKE = "lorem ipsum dolor sit amet consectetur " * 5
FOUND = {
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3!",
    "ISC-text": """Copyright 2020 Some Body. Permission to use, copy, modify, and/or distribute this software for any purpose with or without
    fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
    PROVIDED 'AS IS' AND SOME BODY DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL SOME BODY BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
    ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
    ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1-header": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.""",
    "GPL-2.0-header": """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.""",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License (http://example.org).",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain. Enjoy.",
}


def test_versions_and_families_beyond_the_sentences(spark):
    docs = [(name, ZLIKE + text + " " + ZLIKE) for name, text in FOUND.items()]
    rows = ls.scan_licenses(spark.createDataFrame(docs, "doc_id string, text string"), ls.templates()).collect()
    got = {d: {r["license"] for r in rows if r["doc_id"] == d} for d in FOUND}
    assert all(name in found for name, found in got.items()), got
    versions = {"GPL-2.0": "GPL-3.0", "GPL-3.0": "GPL-2.0", "LGPL-2.1-header": "LGPL-3-header", "GPL-2.0-header": "GPL-3.0-header", "CC-BY-SA-4.0-notice": "CC-BY-SA-3.0-notice"}
    assert all(other not in got[name] for name, other in versions.items()), got


def test_whole_texts_are_found_as_their_version(spark):
    texts = {n: t for n, t in ls.templates() if n.endswith("-text")}
    assert {"GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "MPL-2.0-text", "EPL-2.0-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "CC-BY-SA-4.0-text"} <= set(texts)
    r = random.Random(3)
    # a copy that lacks a word here and there
    docs = [(n, ZLIKE + " ".join(w for w in t.split() if r.random() > 0.004) + " " + ZLIKE) for n, t in texts.items()]
    rows = ls.scan_licenses(spark.createDataFrame(docs, "doc_id string, text string"), ls.templates()).collect()
    for n in texts:
        assert [x["license"] for x in rows if x["doc_id"] == n and x["license"].endswith("-text")] == [n]


def test_two_versions_side_by_side_are_both_found(spark):
    text = "This work is licensed under the GNU General Public License, version 2. This work is licensed under the GNU General Public License, version 3."
    rows = ls.scan_licenses(spark.createDataFrame([(1, text)], "doc_id int, text string"), ls.templates()).collect()
    assert {"GPL-2.0", "GPL-3.0"} <= {r["license"] for r in rows}
