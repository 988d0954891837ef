"""License scan against a version without prefilter, interval tree or word offsets."""

import re

import pytest
from testpaths import SMALL

from gaugeframe.llm import licenses
from gaugeframe.llm.license_rules import KINDS, PHRASES, SIGNATURES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    base = sorted((i, i + len(p.split()), label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    joined, starts = "", {}
    for i, w in enumerate(words):
        joined += " "
        starts[len(joined)] = i
        joined += w
    joined += " "
    found = []
    for label, kind, _, pattern in SIGNATURES:
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined):
            found.append((starts[m.start()], starts[m.start()] + len(m[0].split(" ")), list(KINDS).index(kind), label))
    order = sorted(range(len(found)), key=lambda i: (found[i][2], found[i][0] - found[i][1], i))
    kept = [found[i] for n, i in enumerate(order) if not any(found[j][0] <= found[i][0] and found[i][1] <= found[j][1] for j in order[:n] if (found[j][2], found[j][0] - found[j][1]) < (found[i][2], found[i][0] - found[i][1]) or found[j][:3] == found[i][:3])]
    return len(words), base, sorted((a, b, label) for a, b, _, label in kept)


TEXTS = [
    "Licensed under the MIT License. under the mit license", "CC-BY-NC cc by nc, CC BY NC-SA 4.0! creative commons attribution noncommercial", "GNU Lesser General Public License v2.1 or GPLv3 https://www.gnu.org/licenses/gpl-3.0.html",
    "// SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "permitted admittance limits", "日本語 MIT license ünder the mit license under the mit licensé",
    "apache license version 2 apache license version 20", "under the MIT_License", "This is free and unencumbered software released into the public domain. All rights reserved.", "the gnu affero general public license version 3 " * 50,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
]


def test_scan_equals_the_plain_version(spark, odd_rows, small):
    texts = TEXTS + [r[1] for r in odd_rows] + [r["text"] for r in small["documents"].collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in licenses.scan(docs).collect():
        n, base, kept = plain(texts[r["doc_id"]])
        assert (r["n_words"], [(d["first"], d["end"], d["label"]) for d in r["base"]]) == (n, base)
        assert sorted((d["first"], d["end"], d["label"]) for d in r["detections"] if d["kind"] != "phrase") == kept


def test_every_pattern_holds_its_keyword():
    """A pattern with its optional parts left out, in each of its alternatives, has a keyword of its signature."""
    import re._parser as parser

    def readings(tree):
        out = [""]
        for op, value in tree:
            name = str(op)
            if name == "LITERAL":
                more = [chr(value)]
            elif name == "BRANCH":
                more = [x for branch in value[1] for x in readings(branch)]
            elif name == "SUBPATTERN":
                more = readings(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                more = [""] if value[0] == 0 else readings(value[2])
            elif name == "IN":
                more = [chr(value[0][1])] if str(value[0][0]) == "LITERAL" else ["0"]
            elif name == "ANY":
                more = ["x"]
            else:
                assert name == "ASSERT_NOT"
                more = [""]
            out = [a + b for a in out for b in more]
        return out

    assert len(SIGNATURES) >= 200
    for label, kind, keyword, pattern in SIGNATURES:
        for reading in readings(parser.parse(pattern)):
            assert any(f" {k} " in f" {reading} " for k in keyword.split("|")), (label, kind, keyword, reading)


def test_containment():
    found = [(0, 10, 3, "a", 0.9), (2, 5, 2, "b", 0.9), (0, 10, 3, "c", 0.9), (3, 5, 5, "d", 0.9), (8, 12, 5, "e", 0.9), (0, 4, 3, "f", 0.9), (0, 11, 4, "g", 0.9)]
    assert [x[3] for x in licenses.uncontained(found)] == ["b", "a", "g", "e"]


def test_many_places_in_one_text():
    n, found = licenses.Scanner(SIGNATURES, PHRASES).scan("under the mit license gpl 3 " * 20_000)
    assert n == 120_000 and len(found) == 60_000


def test_query_columns_and_odd_rows(spark, odd, empty, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = licenses.query(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count()
    blank = next(r for r in rows if r["doc_id"] == 3)
    assert tuple(blank) == (3, 0, 0, None, None, "", "", 0.0)
    assert licenses.scan(empty).count() == 0


def test_query_on_the_small_table(spark):
    rows = licenses.query(spark, SMALL).collect()
    found = [r for r in rows if r["n_base"]]
    assert found and all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and r["score"] == pytest.approx(0.95) for r in found)
    assert all(r["first_word"] is not None and r["first_word"] <= r["last_word"] < r["n_words"] for r in found)
