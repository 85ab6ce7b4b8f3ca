"""Ranked search against brute force in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    counts = [(doc_id, Counter(terms(t))) for doc_id, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        asked, found = Counter(terms(text)), []
        for doc_id, c in counts:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = np.array(["The", "of", "and", "É", "naïve", "x1", "日本", "a_b", "I'm", *(f"w{i}" for i in range(400))])
    p = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, int(rng.integers(0, 80)), p=p / p.sum())) for _ in range(1500)]


def test_search_equals_brute_force(spark, texts):
    docs = list(enumerate(texts[:400]))
    docs += [(1000, None), (1001, ""), (1002, "--- ..."), (1003, docs[7][1]), (1003, docs[7][1]), (None, docs[7][1]), (None, "only here ZEBRA"), (-5, docs[7][1]), (2000, "zebra of " * 30_000)]
    items = [(1, texts[7]), (2, "the OF zebra zebra"), (3, None), (4, "?!"), (5, "nowhere"), (2, "the OF zebra zebra"), (None, "x1 É é"), (7, texts[9] + " " + texts[10])]
    df = spark.createDataFrame([(*d, "own", 1) for d in docs], "doc_id long, text string, rank string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, "own") for i in items], "item_id int, text string, doc_id string")
    got = sorted((tuple(r) for r in ranking.ranked(df, asked).collect()), key=str)
    assert got == brute(docs, items) and len(got) > 60
    assert ranking.ranked(df.where("doc_id < -100"), asked).count() == 0 and ranking.ranked(df, asked.where("item_id > 100")).count() == 0


def test_an_index_of_all_terms_gives_the_same(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string")
    asked = spark.createDataFrame([(1, texts[7]), (2, texts[8])], "item_id int, text string")
    assert ranking.vocabulary_of(asked, most=3) is None
    whole = ranking.build_index(df, None)
    assert sorted(map(tuple, ranking.search_index(whole, asked, 5).collect())) == brute(list(enumerate(texts[:200])), [(1, texts[7]), (2, texts[8])], 5)


def test_blocks_under_the_threshold_stay_packed(texts):
    """One shard in this process: scores are exact and most blocks are never decompressed."""
    many = texts + [f"{t} the of" for t in texts] + ["rare gem the of w1"] * 30
    builder = ranking._Builder(None)
    list(builder.add(list(range(len(many))), *ranking.C.string_buffer(pa.array(many))))
    row = {n: v if n in ("doc_ids", "payload") else np.asarray(v) for n, v in builder.shard().items()}
    n_docs, n_terms = int(row["n_docs"]), int(row["n_terms"])
    df = dict(zip(row["terms"].tolist(), row["df"].tolist()))
    for text in ("rare gem the of w1", texts[7], "the of w1 w2"):
        shard = ranking._Shard(row, n_docs, n_terms)
        shard.prepare(row["df"])
        query = [(t, c * w) for t, c in Counter(ranking._terms(text).tolist()).items() if t in df and (w := ranking.weight(n_docs, df[t])) > 0]
        docs, scores = ranking._search(shard, query, 20, 1)
        got = sorted(zip((-scores).tolist(), docs.tolist()))[:20]
        assert [(d, -s) for s, d in got] == [(d, s) for _, _, d, s in sorted(brute(list(enumerate(many)), [(0, text)]), key=lambda r: r[1])]
        if text.startswith("rare"):
            mine = sum(int(row["blocks"][i + 1] - row["blocks"][i]) for i in np.searchsorted(row["terms"], [t for t, _ in query]))
            assert len(shard.open) < mine / 4


def test_a_skyline_holds_the_maximum_for_any_statistics():
    rng = np.random.default_rng(0)
    for _ in range(200):
        tf, n = rng.integers(1, 9, 64), rng.integers(1, 500, 64)
        a, b = ranking.skyline(tf, n)
        for docs, total in ((64, int(n.sum())), (10**9, 10**12), (5, 7)):
            assert ranking.impact(a, b, docs, total).max() == ranking.impact(tf, n, docs, total).max()
