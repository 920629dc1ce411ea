"""License scans, quality rules and decontamination against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import decontam, licenses, quality_rules

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SOLID = re.compile("[^\x20\x09-\x0d]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

LICENSED = [
    None, "", "nothing here", "The MIT License. mit license mit license!", "Licensed under the Apache License, Version 2.0.", "GNU General Public\nLicense v3 and gnu general public licenses",
    "CC-BY-NC 4.0 cc by CC BY 4.0", "éGNU General Public License é", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved.", "apache license " * 40, "mit  LICENSE",
    "released under the terms of the GNU Lesser General Public License version 2.1", "cc by", "by cc by by", "KMIT Licenſe",
]


def base(text):
    words = WORD.findall(lower(text))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def test_license_base(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENSED)] * 2, "doc_id long, text string, score string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == 2 * len(LICENSED)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(LICENSED[r.doc_id]), LICENSED[r.doc_id]
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[4] == ["apache", "apache-2.0"] and labels[5] == ["gpl", "gpl-3.0"] and labels[8] == ["bsd-3-clause"] and labels[12] == ["lgpl-2.1"]
    assert labels[6] == ["cc-by", "cc-by-4.0", "cc-by-nc-4.0"] and labels[9] == ["all-rights-reserved"] and labels[2] == []
    assert licenses.scan(docs.limit(0)).collect() == []


def spellings(tree):
    """Texts that a pattern matches: each branch, optional parts left out and put in, each letter of a class."""
    import re._constants as c

    out = {""}
    for op, arg in tree:
        if op is c.LITERAL:
            more = {chr(arg)}
        elif op is c.IN:
            more = {chr(x) for o, x in arg if o is c.LITERAL} or {"w"}
        elif op is c.NOT_LITERAL:
            more = {"w"}
        elif op is c.SUBPATTERN:
            more = spellings(arg[3])
        elif op is c.BRANCH:
            more = set().union(*map(spellings, arg[1]))
        elif op is c.MAX_REPEAT:
            part = spellings(arg[2])
            more = {p * n for p in part for n in {arg[0], max(arg[0], 1)}}
        else:
            assert op is c.ASSERT or op is c.ASSERT_NOT
            more = {""}
        out = {a + b for a in out for b in more}
    return out


def test_every_match_passes_its_keyword_and_the_gate():
    import re._parser as parser

    rules = licenses.signatures()
    for _, keyword, pattern, _, _ in rules:
        for text in spellings(parser.parse(pattern)):
            assert re.search(pattern, f" {text} "), (pattern, text)
            assert keyword in f" {text} ", (pattern, text)
            assert any(g in f" {text} " for g in licenses.GATES), text
    assert all(any(g in phrase for g in licenses.GATES) for phrase in licenses.BASE)


def test_signatures_without_the_word_license_and_spelled_apart(spark):
    said = {
        "released under the BSD 3-Clause terms": ["bsd-3-clause"],
        "Creative Commons Attribution Share Alike 4.0 International License": ["cc-by-sa-4.0"],
        "Creative Commons Attribution-ShareAlike 3.0 License": ["cc-by-sa-3.0"],
        "Creative Commons Attribution-Non-Commercial 4.0 International License": ["cc-by-nc-4.0"],
    }
    rows = licenses.scan(spark.createDataFrame([(t, t) for t in said], "doc_id string, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == said


GRANTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd,bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ncsa": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "": "You may copy this software for any purpose; copyright 2020 by nobody.",
}


def test_texts_without_a_name(spark):
    rows = licenses.scan(spark.createDataFrame([(k, t) for k, t in GRANTS.items()], "doc_id string, text string")).collect()
    assert {r.doc_id: ",".join(r.labels) for r in rows} == {k: k for k in GRANTS}
    assert len(licenses.TEXTS) > 40 and all(r in licenses.signatures() for r in [(n, k, f"(?<= ){p}(?= )", 2, 0.95) for n, k, p in licenses.TEXTS])


def test_signatures_are_hundreds_and_gated():
    rules = licenses.signatures()
    assert len(rules) > 200
    for _, keyword, pattern, _, confidence in rules:
        re.compile(pattern)
        assert keyword and 0 < confidence <= 1


TEXTS = [
    None, "", "one two three", "a b c d e f g h i j", "same old words in here " * 5, "x y z w v u x y z w v", "line\nline\n \nline two\n", "##$$ **&& || <> %% a b c d e f", "w " * 40, "é ü ö a b c d e f g h",
    "a b c d e a b c d e f " + "q " * 4, "\x1c\x85 a\tb\x0bc\x0cd\re f g h i j",
]


def measured(text):
    text = text or ""
    words = SOLID.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SOLID.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    docs = spark.createDataFrame([(i, t, None if i % 5 == 0 else f"h{i % 3}", 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, source string, kept int")
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        want = measured(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept) and r.host_condemned is not None
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_hosts_are_shrunk_and_condemned(spark):
    good, bad = "a few plain words that say enough to be kept", "## $$ %% && ** || <> words here also plain"
    rows = [(f"ok{h}", good) for h in range(20) for _ in range(20)] + [("junk", bad)] * 60 + [("junk", good)] * 5 + [("tiny", bad)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = quality_rules.judge(docs).groupBy("host", "host_condemned", "kept").count().collect()
    seen = {(r.host, r.host_condemned, r.kept): r["count"] for r in got if not r.host.startswith("ok")}
    assert seen == {("junk", True, False): 60, ("junk", True, True): 5, ("tiny", False, True): 1}
    assert all(r.kept and not r.host_condemned for r in got if r.host.startswith("ok"))


ITEMS = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (1, "Short item, here!"), (2, None), (3, "..."), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (10, "short ITEM here"), (None, "no id here at all")]
LONG = "Alpha, beta: gamma delta — epsilon zeta eta theta iota kappa lambda"
SEEN = [None, "", LONG.replace(" — ", " "), "x " + LONG.replace(" — ", " ") + " mu short item here", "short item", "ashort item here", "é short-item\nHERE é short item here item here", LONG, "alpha beta " * 30, "there is no id here at all, but a short item here"]


def leaks(text):
    words, items, cover = WORD.findall(lower(text)), set(), set()
    for item, said in ITEMS:
        w = WORD.findall(lower(said))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    items.add(None if item is None else str(item))
                    cover.update(range(j, j + n))
    return len(words), len(cover), sorted(items, key=lambda x: (x is None, x or ""))


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 40])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(SEEN)] * 2, "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.find_leaks(docs, bench).collect()
    assert len(rows) == 2 * len(SEEN)
    for r in rows:
        text = SEEN[r.doc_id] or ""
        assert (r.n_words, r.n_hit, r["items"]) == leaks(text), text
        cut = WORD.findall(lower(" ".join(text[s.start : s.end] for s in r.spans)))
        assert len(cut) == r.n_hit
    assert all(r.n_hit == 0 for r in decontam.find_leaks(docs, bench.limit(0)).collect())
    assert decontam.find_leaks(docs.limit(0), bench).collect() == []


def test_large_benchmark_is_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(3)
    said = [" ".join(f"w{k}" for k in rng.integers(0, 300, rng.integers(1, 60))) for _ in range(300)] + ["the same few words open it " * 3] * 4
    items = [(str(i), t) for i, t in enumerate(said)]
    texts = []
    for i in range(200):
        own = [f"w{k}" for k in rng.integers(0, 300, 80)]
        at = int(rng.integers(0, 80))
        texts.append(" ".join(own[:at] + said[int(rng.integers(len(said)))].split() + own[at:]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, texts[0]) for i in range(900, 1000)], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {r.doc_id: tuple(r) for r in decontam.find_leaks(docs, bench).collect()}
    assert sum(r[2] > 0 for r in want.values()) > 250
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    monkeypatch.setattr(decontam, "RUN_BYTES", 1000)  # so that a block's runs go to several tasks
    for bits in (decontam.FILTER_BITS, 15):
        monkeypatch.setattr(decontam, "FILTER_BITS", bits)
        scans = []
        real = decontam.map_texts
        monkeypatch.setattr(decontam, "map_texts", lambda df, text, *a, **k: (scans.append(text), real(df, text, *a, **k))[1])
        rows = decontam.find_leaks(docs, bench).collect()
        monkeypatch.setattr(decontam, "map_texts", real)
        assert scans.count("_text") == 1  # the documents, whatever the number of blocks
        assert len(rows) == 300 and {r.doc_id: tuple(r) for r in rows} == want


def test_many_words_take_more_signs(monkeypatch):
    monkeypatch.setattr(decontam, "DIGITS", 3)
    items = [(str(i), " ".join(f"w{(i * 7 + k) % 13}" for k in range(12)).encode()) for i in range(4)] + [("s", b"w1 w2")]
    found, values, codes, width = decontam.automaton("narrow", items)
    assert width == 3 and len(set(codes.values())) == len(codes) == 13
    kernel = decontam._kernel(found, values, codes, width)
    for text in ("x w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 y", "w1 w2 w1", "w2 w1", "none", ""):
        words = text.split()
        hits = {j + k for _, raw in items for w in [raw.decode().split()] for n in [min(10, len(w))] for i in range(len(w) - n + 1) for j in range(len(words)) if words[j : j + n] == w[i : i + n] for k in range(n)}
        assert kernel(pa.array([text]))[1].to_pylist() == [len(hits)], text


def test_leak_digest(spark):
    from sluice.llm.queries import op10_decontaminate  # noqa: F401  (registered)

    joined = F.sha2(F.array_join(F.array(F.lit("10"), F.lit("2")), ",").cast("binary"), 256)
    assert spark.range(1).select(joined.alias("h")).first().h == hashlib.sha256(b"10,2").hexdigest()
