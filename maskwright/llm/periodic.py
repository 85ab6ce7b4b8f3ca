"""Periodic runs: stretches of words that repeat with a period, by harmonic grid probing, and texts without the repeats.

A run of period p and length of at least 3p holds two neighbouring multiples of p, jp and (j+1)p, whose words equal those
one period on. So for each period only the multiples of it are probed, n/1 + n/2 + n/3 + ... = n log n tests in all; what
survives is extended to both sides by comparing arrays in growing chunks, and probes within runs found before are skipped:
of the same period, and of periods that divide this one, since a run of period q shows at 2q, 3q, ... at the same place.

Everything happens in one pass over the rows; nothing is shuffled. Cases: null, empty and blank texts have no words and no
runs; equal texts under one id give equal rows; ties between runs go to the smallest start, then the smallest period; a row
without doc_id gets no planted period; other columns are ignored; memory follows the longest text of a batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

SHORTEST = 24
TIMES = 3
CHUNK = 64

Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _extended(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The stretch [a, b) around i on which w[k] == w[k + p]."""
    b, size = i, CHUNK
    while b < len(w) - p:
        to = min(b + size, len(w) - p)
        differ = w[b:to] != w[b + p : to + p]
        if differ.any():
            b += int(differ.argmax())
            break
        b, size = to, size * 2
    a, size = i, CHUNK
    while a > 0:
        to = max(a - size, 0)
        differ = (w[to:a] != w[to + p : a + p])[::-1]
        if differ.any():
            a -= int(differ.argmax())
            break
        a, size = to, size * 2
    return a, b


def _probed(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(periods, positions) of surviving probes of the periods low to high - 1, in their order: w[jp], w[(j+1)p] and
    w[(j+2)p] are equal. Over the periods at once for each j, as these are the fewer steps."""
    n, found = len(w), []
    for j in range((n - 1) // low - 1):
        p = np.arange(low, min(high - 1, (n - 1) // (j + 2)) + 1)
        mid = w[p * (j + 1)]
        hit = p[(w[p * j] == mid) & (mid == w[p * (j + 2)])]
        if len(hit):
            found.append(np.stack([hit, hit * j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, at = np.concatenate(found, axis=1)
    order = np.lexsort((at, p))
    return p[order], at[order]


def _probed_one(w: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """As _probed, of one period."""
    grid = w[::p]
    same = grid[:-1] == grid[1:]
    at = np.flatnonzero(same[:-1] & same[1:]) * p
    return np.full(len(at), p), at


def find_runs(w: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every maximal stretch of at least max(shortest, times * period) items, by start, then
    period; the period is the smallest one. times is at least 3."""
    if times < 3:
        raise ValueError("runs hold their period three times at least")
    n, found = len(w), []
    if n < shortest:
        return []
    most, low = n // times, 1
    one_by_one = int(n**0.5)
    while low <= most:
        high = low + 1 if low <= one_by_one else min(2 * low, most + 1)
        periods, places = _probed_one(w, low) if high == low + 1 else _probed(w, low, high)
        if len(periods):
            # no run of these periods lies within another of them, so the runs so far decide what is skipped
            long = np.array([r for r in found if r[1] > 2 * low], np.int64).reshape(-1, 3)
            bounds = np.flatnonzero(np.diff(periods, prepend=-1, append=-1))
            for x, y in zip(bounds[:-1], bounds[1:]):
                found += _runs_of(w, int(periods[x]), places[x:y], long, max(shortest, times * int(periods[x])))
        low = high
    return sorted(found, key=lambda r: (r[0], r[2]))


def _runs_of(w: np.ndarray, p: int, places: np.ndarray, known: np.ndarray, least: int) -> list[Run]:
    """The runs of period p, of probes in order, that no known run of a dividing period holds."""
    inner = known[p % known[:, 2] == 0]
    if len(inner):
        inner = inner[inner[:, 0].argsort(kind="stable")]
        reach = np.maximum.accumulate(inner[:, 0] + inner[:, 1] - p)  # stretches on which items equal those p further on
        k = np.searchsorted(inner[:, 0], places, side="right") - 1
        places = places[(k < 0) | (places >= reach[k])]
    out, i = [], 0
    while i < len(places):
        a, b = _extended(w, int(places[i]), p)
        if b - a + p >= least:
            out.append((a, b - a + p, p))
        i = max(i + 1, int(np.searchsorted(places, b)))
    return out


def planted(ids: np.ndarray, doc_id: int) -> np.ndarray:
    """Indices of words after a tail of one document in ten is made periodic, as a fixed rule of its id says."""
    n, h = len(ids), zlib.crc32(str(doc_id).encode())
    index, g = np.arange(n), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        index[a:] = a + (index[a:] - a) % p
    return index


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those that some run holds after its first period."""
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def strongest(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in COLUMNS.split(", ")])


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    best = strongest(runs)
    said = hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest()
    stay = kept_words(len(words), runs)
    text = hashlib.sha256(b" ".join(w for w, ok in zip(words, stay.tolist()) if ok) if runs else b" ".join(words)).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, said, text)


def run_report(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """(key, COLUMNS) for each row: the number of runs, the one of the greatest length / period, the digest of all of them
    and that of the text without their repeats. With ``plant`` the tails of some texts are made periodic first."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or "").encode().split()
                if plant and k is not None:
                    words = [words[i] for i in planted(words, k)]
                rows.append(_row(words, find_runs(word_ids(words), shortest, times) if len(words) >= shortest else []))
            columns = zip(*rows) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, _ARROW))], names=[key, *_ARROW.names])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(report, f"`{key}` {kind}, {COLUMNS}")


def without_repeats(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """docs with each text's periodic repeats taken out: its kept words, joined by one space. Texts without runs and nulls
    stay as they are."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = batch.schema.get_field_index(text), []
            for t in batch.column(at):
                words = (t.as_py() or "").encode().split()
                runs = find_runs(word_ids(words), shortest, times)
                out.append(b" ".join(np.array(words, object)[kept_words(len(words), runs)]).decode() if runs else t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, c.type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(collapse, docs.schema)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(C.table(spark, sf_dir, "documents"), plant=True)
