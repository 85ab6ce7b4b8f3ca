"""Licence headers against a cosine in plain Python, and long texts."""

import math
import re
from collections import Counter

import pytest

from maskwright.llm import licenses as L

FILE_HEAD = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.

import os
"""
MIT_HEAD = """// Copyright 2021 Somebody
//
// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights
// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
// copies of the Software, and to permit persons to whom the Software is
// furnished to do so, subject to the following conditions:
//
int main() { return 0; }
"""
LABELLED = [
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3.0"), ("It is under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("This work is licensed under the GNU General Public License, version 4.", None), ("Licensed under the Apache License, Version 1.1.", None),
    (FILE_HEAD.format(3), "gpl-3.0"), (FILE_HEAD.format(2), "gpl-2.0"), (FILE_HEAD.replace("General", "Affero General").format(3), "agpl-3.0"), (FILE_HEAD.replace("program", "library").replace("General", "Lesser General").format("2.1"), "lgpl-2.1"),
    (MIT_HEAD, "mit"), ("#!/bin/sh\n# SPDX-License-Identifier: MIT\nls\n", "mit"), ("/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "gpl-2.0"), ("# SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"), ("// SPDX-License-Identifier: ISC", "isc"),
    ("Released under the MIT License.", "mit"), ("The MIT License (MIT)", "mit"), ("Licensed under CC BY 4.0.", "cc-by-4.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("He got a license to drive in the state of Maine.", None), ("er kam mit der License", None), ("No permission is granted to enter.", None), ("", None), (None, None),
]


def brute(text):
    """The best notice of the whole text where it is near enough, else over paragraphs and runs of lines, by definition."""
    whole = best_of([[L._words(x) for x in (text or "").split("\n")]])
    return whole if -whole[0] >= L.LEAST else headers(text)


def headers(text):
    lines = [L._words(x) for x in (text or "").split("\n")]
    runs = [lines[a : a + n] for a in range(len(lines)) for n in range(1, L.WRAP + 1)]
    par = []
    for line in [*lines, []]:
        if line:
            par.append(line)
        else:
            runs.append(par)
            par = []
    return best_of(runs)


def best_of(runs):
    idf, unit = L.vectors(L.TEMPLATES)
    other = math.log(1 + len(unit)) + 1
    best = (0, None)
    for run in runs:
        bag = Counter(w for line in run for w in line)
        norm = math.sqrt(sum((n * idf[w]) ** 2 if w in idf else n * other**2 for w, n in bag.items()))
        for name, v in unit:
            if norm and all(w in bag for w in v if w[0].isdigit()):
                score = round(sum(n * idf[w] * v[w] for w, n in bag.items() if w in v) / norm, 6)
                best = min(best, (-score, name), key=lambda x: (x[0], x[1] or ""))
    return best


def test_headers_equal_a_plain_cosine(spark):
    df = spark.createDataFrame([(k, f"d{k}/x", t) for k, (t, _) in enumerate(LABELLED)], "id long, path string, text string")
    got = {r["id"]: (r["own"], r["own_score"]) for r in L.own_licenses(df, texts={}).collect()}
    for k, (text, name) in enumerate(LABELLED):
        score, best = brute(text)
        assert got[k][0] == name == (best if -score >= L.LEAST else None), (text, got[k], score, best)
        if name:
            assert got[k][1] == pytest.approx(-score, abs=2e-6)


def test_core_words_lose_nothing():
    _, unit = L.vectors(L.TEMPLATES)
    for shares in (None, {w: 0.9 for w in ("the", "of", "to", "and", "this", "is", "it", "are", "that")}):
        core = set(L.core_words(L.TEMPLATES, shares=shares))
        assert all(sum(x * x for w, x in v.items() if w not in core) < L.LEAST**2 for _, v in unit) and len(core) < 80
        assert shares is None or not core & set(shares)


def test_a_text_of_many_telling_lines(spark):
    long = "\n".join(["some license text of the software"] * 100_000 + ["", "Released under the MIT License.", ""])
    df = spark.createDataFrame([(1, "a/b/x", long), (2, "a/b/y", "\n" * 200_000 + "SPDX-License-Identifier: ISC")], "id long, path string, text string")
    assert {r["id"]: (r["license"], r["how"]) for r in L.scan(df).collect()} == {1: ("mit", "own"), 2: ("isc", "own")}


def test_every_row_of_the_given_table(spark):
    """The query's whole result on the smallest table: own notices by the plain cosine, and the nearest directory's files."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: (r["license"], r["how"]) for r in L.op5_licenses(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if re.search("licen|redistribution|spdx", r["text"] or "", re.I) and len(r["text"]) < 4000:
            score, best = brute(r["text"])
            assert got[r["doc_id"]] == (best, "own") if -score >= L.LEAST else got[r["doc_id"]][1] != "own"
