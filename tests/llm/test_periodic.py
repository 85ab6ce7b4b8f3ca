"""Periodic runs against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import periodic


def brute(w, shortest, times):
    """Every maximal stretch of each period, less those that have a smaller one."""
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            a = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            length = i - a + p
            if i > a and length >= max(shortest, times * p) and not any(all(w[k] == w[k + q] for k in range(a, a + length - q)) for q in range(1, p)):
                out.append((a, length, p))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def sequences(draw):
    w = []
    for _ in range(draw(st.integers(1, 4))):
        unit = draw(st.lists(st.integers(0, 3), min_size=1, max_size=9))
        w += unit * draw(st.integers(1, 9)) + draw(st.lists(st.integers(0, 3), max_size=6))
    return w


@settings(max_examples=300, deadline=None)
@given(sequences(), st.integers(3, 30), st.integers(3, 4))
def test_runs_are_those_of_brute_force(w, shortest, times):
    assert periodic.find_runs(np.array(w), shortest, times) == brute(w, shortest, times)


def test_long_texts():
    assert periodic.find_runs(np.zeros(300_000, int)) == [(0, 300_000, 1)]
    w = np.arange(90_000) % 30_000
    assert periodic.find_runs(w) == [(0, 90_000, 30_000)] and periodic.find_runs(w[:-1]) == []
    assert periodic.find_runs(np.zeros(23, int)) == [] and periodic.find_runs(np.zeros(24, int)) == [(0, 24, 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words, 24, 3)
    dropped = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    s, k, p = best[0] if best else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), s, k, p, 1000 * k // p if best else None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_report_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["a", "b", "é", "ß x"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 150))))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b  a\x0bb\x0c" * 20), (1003, "a b  a\x0bb\x0c" * 20), (None, "x " * 40), (1004, "x y " * 12 + "z " * 30)]
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, start int, period string")
    got = periodic.run_report(df, plant=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got) >= 10
    assert periodic.run_report(df.where("doc_id < 0"), plant=True).count() == 0


def test_query_equals_brute_force_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    short = {k: t for k, t in texts.items() if len((t or "").split()) < 400}
    got = {r["doc_id"]: tuple(r) for r in periodic.op12_runs(spark, sf).collect()}
    assert got.keys() == texts.keys() and len(short) > 50
    assert all(got[k] == expected(k, t) for k, t in short.items())


def test_repeats_go_from_texts(spark):
    df = spark.createDataFrame([(1, "so " + "la li lu " * 9 + "end"), (2, None), (3, "as  it is")], "id int, text string")
    assert [tuple(r) for r in periodic.without_repeats(df).orderBy("id").collect()] == [(1, "so la li lu end"), (2, None), (3, "as  it is")]
