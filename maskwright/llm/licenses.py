"""License scans in DataFrame operations only: sparse TF-IDF cosine to templates, then inheritance by directory.

A template is a licence notice (a sentence, an SPDX line, the paragraph at the head of files) or the full text of a licence
(``license_texts``). Header candidates are the paragraphs of a text and its runs of at most ``WRAP`` adjacent lines; a
whole text that holds a telling part is compared to notices and full texts and is a licence file from ``least`` on. The
score is the cosine of TF-IDF vectors over the templates' words, each other word weighing as one that is in no template;
the best template at or above ``least`` is taken, of a licence file the whole text's. A notice with a version is only met
by what holds that version. A file without an own licence inherits the one of the nearest ancestor directory that has a
licence file: a file joins the directory's licences on each of its ancestor paths, of which its depth bounds the number.

Only lines with a core word go on, and those near them. Core words lose nothing: of each notice's vector so much lies on
them that a text without any of them stays below ``least``. Lines are rows, never arrays that rows carry, so the work is
linear in the lines of a text.

The vocabulary and the templates are fixed tables, so what is broadcast does not grow with the corpus.

Cases: null and empty texts have no own licence; repeated rows get the same answer; of templates with one score the
first by name wins; of licence files in one directory the best score, then the first name, wins; a null path has no
ancestors; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

_GNU = {
    "agpl-3.0": ("program", "GNU Affero General Public License", "3", "AGPL-3.0"), "gpl-2.0": ("program", "GNU General Public License", "2", "GPL-2.0"), "gpl-3.0": ("program", "GNU General Public License", "3", "GPL-3.0"),
    "lgpl-2.1": ("library", "GNU Lesser General Public License", "2.1", "LGPL-2.1"), "lgpl-3.0": ("library", "GNU Lesser General Public License", "3", "LGPL-3.0"),
}


def _gnu(what: str, title: str, version: str, tag: str) -> tuple[str, ...]:
    notices = [f"This work is licensed under the {title}, version {version}.", *(f"SPDX-License-Identifier: {tag}{end}" for end in ("", "-only", "-or-later"))]
    for kind in dict.fromkeys((what, "program")):
        notices.append(f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
    return tuple(notices)


TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "bsd-2-clause": ("SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    **{name: _gnu(*parts) for name, parts in _GNU.items()},
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "Released under the ISC License."),
    "mit": (
        "Released under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mpl-2.0": (
        "This file is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}
LEAST = 0.75
#: So many texts tell which words are common.
SAMPLE = 2000
#: Besides whole paragraphs, runs of so many lines are headers.
WRAP = 6
_WORD = "[a-z]+(?:-[a-z]+)*|[0-9]+(?:\\.[0-9]+)*"
#: Each full text holds one of these; a whole text without any is not compared to them.
TELLING = ("licen", "apache", "gnu", "mozilla", "redistribution", "permission", "permitted", "cc by")

Templates = dict[str, tuple[str, ...]]


#: The name of the one licence that is a common word of German is a word of its own: in capitals, or before "license".
_NAME, _AS = r"\bMIT\b|\b(?i:mit)(?=\s+(?i:licen[cs]e)\b)", "mit-license"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, re.sub(_NAME, _AS, text, flags=re.ASCII).lower())


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, _NAME, _AS)), F.lit(f"({_WORD})"), 1)


def vectors(templates: Templates, damp: bool = False) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """(inverse document frequency of each word, name and unit TF-IDF vector of each template). damp: a word that comes n
    times counts 1 + log n, so that the words of any prose do not outweigh all others in long texts."""
    flat = [(name, text) for name in sorted(templates) for text in templates[name]]
    df = Counter(w for _, t in flat for w in set(_words(t)))
    idf = {w: math.log((1 + len(flat)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for name, text in flat:
        v = {w: (1 + math.log(n) if damp else n) * idf[w] for w, n in Counter(_words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {w: x / norm for w, x in v.items()}))
    return idf, out


def core_words(templates: Templates, least: float = LEAST, shares: dict[str, float] | None = None) -> list[str]:
    """Words such that the cosine of a text without any of them to any template is below ``least``: each template has less
    than least squared of its squared length on its other words. Words that serve most templates for the share of texts
    that hold them come first."""
    _, unit = vectors(templates)
    need = [1 - least * least + 1e-9] * len(unit)
    out: list[str] = []
    while max(need) > 0:
        gain = Counter()
        for (_, v), n in zip(unit, need):
            for w, x in v.items():
                gain[w] += min(max(n, 0), x * x)
        best = min((w for w in gain if w not in out), key=lambda w: (-gain[w] / ((shares or {}).get(w, 0) + 1 / SAMPLE), w))
        out.append(best)
        need = [n - v.get(best, 0) ** 2 for (_, v), n in zip(unit, need)]
    return out


def word_shares(files: DataFrame, templates: Templates, most: int = SAMPLE) -> dict[str, float]:
    """The shares of at most ``most`` texts that hold each word of the templates. They only choose among sets of core words
    that all lose nothing: the cost hangs on the sample, the result does not."""
    words = sorted(vectors(templates)[0])
    sample = files.where("text is not null").limit(most).select(F.array_distinct(words_of(F.col("text"))).alias("words"))
    held = sample.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, words)))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] / most for r in held.collect()}


def full_texts() -> Templates:
    """The whole texts of licences by name."""
    return {p.stem: (p.read_text(),) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def _table(spark: SparkSession, templates: Templates, damp: bool) -> tuple[DataFrame, float, list[tuple[str, int]]]:
    """((word, idf, of: its places in templates), the weight of other words, each template's name and count of numbers)."""
    idf, unit = vectors(templates, damp)
    number = lambda w: w[0].isdigit() and not damp
    table = json.dumps([{"word": w, "idf": x, "of": [{"k": k, "x": v[w], "d": int(number(w))} for k, (_, v) in enumerate(unit) if w in v]} for w, x in idf.items()])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<word:string,idf:double,of:array<struct<k:int,x:double,d:int>>>>")))
    return C.written(rows, "license-words"), math.log(1 + len(unit)) + 1, [(n, sum(map(number, v))) for n, v in unit]


def _products(bags: DataFrame, keys: list[str], templates: Templates, damp: bool = False) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(keys, square, k, dot, numbers) of each array of words and template that share a word, and the templates."""
    table, other, kinds = _table(bags.sparkSession, templates, damp)
    counts = bags.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("times"))
    weight = (F.log("times") + 1 if damp else F.col("times")) * F.col("idf")
    found = counts.join(F.broadcast(table), "word", "left").withColumn("w", weight)
    square = found.groupBy(*keys).agg(F.sum(F.coalesce(F.col("w") * F.col("w"), F.col("times") * F.lit(other * other))).alias("square"))
    dots = found.select(*keys, "w", F.inline("of")).groupBy(*keys, "k").agg(F.sum(F.col("w") * F.col("x")).alias("dot"), F.sum("d").alias("numbers"))
    return square.join(dots, keys, "left"), kinds


def _best(bags: DataFrame, keys: list[str], templates: Templates, damp: bool = False) -> DataFrame:
    """keys and best, a struct(o, name, score) of the best template for each array of words; o is the negative score.
    Each word of no template counts once, at the weight of a word that is nowhere. Without damp a template is only met by
    what holds all its numbers."""
    met, kinds = _products(bags, keys, templates, damp)
    of_template = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    scored = met.where(F.col("numbers") == of_template([n for _, n in kinds])).withColumn("score", F.round(F.col("dot") / F.sqrt("square"), 6))
    return scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("o"), of_template([n for n, _ in kinds]).alias("name"), F.col("score"))).alias("best"))


def _contains_any(lower: Column, parts: tuple[str, ...] | list[str]) -> Column:
    """A search for fixed strings, which is many times faster than a pattern over whole texts."""
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in parts])


def header_runs(lines: DataFrame, core: list[str], templates: Templates = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(row, start, end, words) of the paragraphs and runs of at most WRAP lines that hold a core word and may score ``least``,
    of lines (row, pos, words). A paragraph is a stretch of lines with words; a run of lines may cross paragraphs.

    What may score: products with a template add up over lines, and a run is at least as long as the square root of its
    lines' squares, so the sum of the lines' best products over that root bounds the score. No words are copied for it."""
    tells = F.arrays_overlap("words", F.array(*map(F.lit, core)))
    order = Window.partitionBy("row").orderBy("pos")
    blank = F.size("words") == 0
    marked = lines.withColumns({"tells": tells, "par": F.sum(blank.cast("int")).over(order)})
    near = F.max("tells").over(order.rangeBetween(1 - WRAP, WRAP - 1))
    kept = marked.withColumns({"near": near, "of": F.max("tells").over(Window.partitionBy("row", "par"))}).where("(near or of) and size(words) > 0")
    kept = C.written(kept, "license-lines")
    products, _ = _products(kept, ["row", "pos"], templates)
    each = products.groupBy("row", "pos").agg(F.coalesce(F.max("dot"), F.lit(0.0)).alias("most"), F.first("square").alias("square"))
    lines = C.written(kept.join(each, ["row", "pos"]), "license-bounds")
    may = lambda most, square: most >= least * (1 - 1e-9) * F.sqrt(square)
    spans = []
    for n in range(1, WRAP + 1):
        w = order.rangeBetween(0, n - 1)
        spans.append(F.when(F.max("tells").over(w) & may(F.sum("most").over(w), F.sum("square").over(w)), F.struct("pos", (F.col("pos") + n - 1).alias("end"))))
    runs = lines.where("near").select("row", F.array(*spans).alias("spans")).select("row", F.explode("spans").alias("x")).where("x is not null").select("row", F.col("x.pos").alias("start"), "x.end")
    pars = lines.where("of").groupBy("row", "par").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("most").alias("most"), F.sum("square").alias("square"))
    bounds = pars.where(may(F.col("most"), F.col("square"))).select("row", "par", "start", "end")
    words = runs.select("row", "start", "end", F.explode(F.sequence("start", "end")).alias("pos")).join(lines.select("row", "pos", "words"), ["row", "pos"]).drop("pos")
    words = words.unionByName(lines.where("of").join(bounds, ["row", "par"]).select("row", "start", "end", "words"))
    return words.groupBy("row", "start", "end").agg(F.flatten(F.collect_list("words")).alias("words"))


def own_licenses(files: DataFrame, templates: Templates = TEMPLATES, least: float = LEAST, texts: Templates | None = None) -> DataFrame:
    """(id, path, own, own_score, is_file) of files (id, path, text)."""
    core = core_words(templates, least, word_shares(files, templates))
    # one pass over all texts: those that hold a core word go on; most are told by a search for its letters
    low = files.select("id", "path", "text", F.lower("text").alias("low"))
    held = F.when(_contains_any(F.col("low"), [w.removesuffix("-license") for w in core]), F.arrays_overlap(words_of(F.col("text")), F.array(*map(F.lit, core))))
    seen = C.written(low.select("id", "path", F.monotonically_increasing_id().alias("row"), F.when(held, F.col("text")).alias("text")), "license-texts")
    lines = seen.where("text is not null").select("row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("row", "pos", words_of(F.col("line")).alias("words"))
    headers = _best(header_runs(lines, core, templates, least), ["row", "start", "end"], templates)
    header = headers.groupBy("row").agg(F.min("best").alias("header"))
    # licence files: the whole text, whatever its length, is a notice or a licence
    bags = seen.where("text is not null").where(_contains_any(F.lower("text"), TELLING)).select("row", words_of(F.col("text")).alias("words"))
    whole = _best(bags, ["row"], templates).union(_best(bags, ["row"], full_texts() if texts is None else texts, True)).groupBy("row").agg(F.min("best").alias("whole"))
    found = seen.select("row", "id", "path").join(C.written(header.join(whole, "row", "full"), "license-scores"), "row", "left")
    is_file = F.coalesce(F.col("whole.score") >= least, F.lit(False))
    best = F.when(is_file, F.col("whole")).when(F.col("header.score") >= least, F.col("header"))
    return found.select("id", "path", best["name"].alias("own"), best["score"].alias("own_score"), is_file.alias("is_file"))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, templates: Templates = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, license, score, how, from_directory); how is own, inherited or none. files: id, path, text, and ids
    are unique; directories are parts of a path that end before a slash, the top one is empty."""
    own = C.written(own_licenses(files, templates, least), "licenses")
    pick = F.min(F.struct((-F.col("own_score")).alias("o"), F.col("own").alias("name"), F.col("own_score").alias("score")))
    homes = own.where("is_file and own is not null and path is not null").groupBy(_parent(F.col("path")).alias("directory")).agg(pick.alias("best"))
    # the paths of files without own licence, once each directory; each joins on all of its ancestors
    parents = own.where("own is null and path is not null").select(_parent(F.col("path")).alias("parent")).distinct()
    steps = F.split("parent", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    ancestors = parents.select("parent", F.explode(F.array_distinct(up)).alias("directory"))
    near = ancestors.join(homes, "directory").groupBy("parent").agg(F.max_by(F.struct("directory", "best"), F.length("directory")).alias("home"))
    # files with a licence of their own meet nothing, so they are not dealt out under one null key
    without = own.where("own is null").withColumn("parent", _parent(F.col("path"))).join(near, "parent", "left").drop("parent")
    joined = without.unionByName(own.where("own is not null"), allowMissingColumns=True)
    return joined.select(
        "id", "path", F.coalesce("own", "home.best.name").alias("license"), F.coalesce("own_score", "home.best.score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("home").isNotNull(), "inherited").otherwise("none").alias("how"), F.when(F.col("own").isNull(), F.col("home.directory")).alias("from_directory"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/thousand/doc_id."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("id"), place.alias("path"), "text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(C.table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
