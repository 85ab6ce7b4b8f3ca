"""Best-fit packing of tokenized documents into sequences by bin completion.

Packing depends on lengths only, and there are at most ``capacity`` different ones. So the executors tokenize and count,
the driver solves bin completion over the histogram (its size does not grow with the corpus), and the executors place
each piece by its rank among pieces of its length.

Cases: null and empty texts are the end id alone; repeated rows are packed as often as they come; ties between pieces
of one length are broken by their values; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY, END_ID = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+)([.,!*#$%&]*)")


def _byte_chars() -> dict[int, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """The ids of white-space separated words as little-endian bytes, by the word's UTF-8 bytes.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its words in turn.
    At most ``most`` words are kept; any other is tokenized each time.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.most, self.chars = self.tok.model, most, _byte_chars()

    def _bpe(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.chars))]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if (m := _PLAIN.fullmatch(text)) and unicodedata.is_normalized("NFC", text):
            ids = self._bpe(m[1].lower()) + (self._bpe(m[2]) if m[2] else [])
        else:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes()
        if len(self) < self.most and len(word) <= 64:
            self[word] = out
        return out

    def text(self, text: bytes) -> bytes:
        if b"<|" in text:  # a special token may hold what looks like the end of a word
            return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_WORDS: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(path) or _WORDS.setdefault(path, WordIds(path))  # one tokenizer a worker, not a task
        end = np.array([END_ID], "<u4").tobytes()
        for batch in C.small_batches(batches):
            out: list[list] = [[], [], [], [], [], []]
            data, off = C.string_buffer(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = words.text(data[off[k] : off[k + 1]].tobytes()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for to, x in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        to.append(x)
            cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in out[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; with_ids adds the ids themselves."""
    path = path or tokenizer_path()
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def fewest_bins(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences (Martello and Toth's bound L2)."""
    best = 0
    big = {x: n for x, n in counts.items() if 2 * x > capacity}
    small = sorted((x for x in counts if 2 * x <= capacity), reverse=True)
    rest = 0
    for least in [capacity // 2 + 1, *small]:
        rest += least * counts[least] if 2 * least <= capacity else 0
        room = sum((capacity - x) * n for x, n in big.items() if x <= capacity - least)
        best = max(best, sum(big.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 3000, work: int = 6_000_000) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use up the histogram ``counts``.

    The incumbent fills sequence by sequence around the largest length left (``_greedy``, at most ``nodes`` nodes each).
    If it has more sequences than the lower bound, branch and bound over whole packings follows (``_branch``), which
    is exact unless it ends after ``work`` lengths looked at; then the best packing found so far stands, which may have
    more sequences than needed.
    """
    counts = {k: v for k, v in counts.items() if v}
    out = _greedy(counts, capacity, nodes)
    found = sum(t for t, _ in out)
    least = fewest_bins(counts, capacity)
    # little waste is allowed first, which leaves little to search; the last goal is one sequence less than found
    goals = sorted({least, min(found - 1, least + 7), found - 1}) if found > least else []
    for goal in goals:
        if better := _branch(counts, capacity, goal + 1, work // len(goals)):
            return better
    return out


def _fillings(room: int, have: list[int], use: tuple[int, ...], slack: int):
    """Undominated fillings of ``room`` with at most ``slack`` waste, as counts of ``have`` (longest first): none of
    their pieces, and no room left, can take a longer piece that is still there. None stands for a step of the search."""
    low = [0] * (len(have) + 1)  # the most that lengths from here on hold
    for k in range(len(have) - 1, -1, -1):
        low[k] = low[k + 1] + have[k] * use[k]
    stack = [(0, room, ())]
    while stack:
        k, r, took = stack.pop()
        yield None
        if r - low[k] > slack:
            continue
        if k == len(have) or not r:
            took += (0,) * (len(have) - len(took))
            free = [x for x, n, m in zip(have, use, took) if n > m]
            if not any(x <= r for x in free) and not any(m and any(x < y <= x + r for y in free) for x, m in zip(have, took)):
                yield took
            continue
        stack += [(k + 1, r - n * have[k], (*took, n)) for n in range(min(use[k], r // have[k]) + 1)]


def _branch(counts: dict[int, int], capacity: int, most: int, work: int) -> list[tuple[int, list[int]]] | None:
    """The best packing in fewer than ``most`` sequences, if the search finds one. Each node branches over the
    undominated fillings around the largest length left, as often as it can be repeated and once, and is left where
    the waste so far shows that the best packing cannot be beaten, or its rest was met with as few sequences."""
    have = sorted(counts, reverse=True)
    least = fewest_bins(counts, capacity)
    stack = [(tuple(counts[x] for x in have), 0, None)]
    met: dict[tuple[int, ...], int] = {}
    best = None
    while stack and work > 0:
        left, bins, plan = stack.pop()
        work -= len(left)
        slack = (most - 1 - bins) * capacity - sum(x * n for x, n in zip(have, left))
        if slack < 0 or met.get(left, most) <= bins:
            continue
        met[left] = bins
        top = next((k for k, n in enumerate(left) if n), None)
        if top is None:
            best, most = plan, bins
            if most <= least:
                break
            continue
        use = (*left[:top], left[top] - 1, *left[top + 1 :])
        found = []
        for took in _fillings(capacity - have[top], have, use, slack):
            work -= 1 if took is None else len(left)
            if work <= 0:
                break
            if took is not None:
                found.append((*took[:top], took[top] + 1, *took[top + 1 :]))
        wastes = [capacity - sum(x * n for x, n in zip(have, f)) for f in found]
        order = sorted(range(len(found)), key=lambda k: -wastes[k])  # the least waste is popped first
        times = [min(n // m for n, m in zip(left, f) if m) for f in found]
        # all repeated fillings are tried before single ones
        for k, t in [(k, 1) for k in order if times[k] > 1] + [(k, times[k]) for k in order]:
            stack.append((tuple(n - t * m for n, m in zip(left, found[k])), bins + t, (t, found[k], plan)))
    if best is None:
        return None
    out = []
    while best is not None:
        times, took, best = best
        out.append((times, [x for x, n in zip(have, took) for _ in range(n)]))
    return out[::-1]


def _greedy(counts: dict[int, int], capacity: int, nodes: int) -> list[tuple[int, list[int]]]:
    """Around the largest length left, depth-first search looks for the filling with least waste, longer pieces first,
    starting from best fit; a full sequence ends it, and after ``nodes`` nodes the best filling stands. The filling is
    repeated as often as it can be, without going back."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        if not 0 < k <= capacity:
            raise ValueError(f"length {k} does not fit {capacity}")
        left[k] = v
    out: list[tuple[int, list[int]]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        left[top] -= 1
        have = np.flatnonzero(left)[::-1].tolist()  # longest first
        left[top] += 1
        use = dict(zip(have, (left[have] - (np.array(have) == top)).tolist()))
        chosen = _complete(capacity - top, have, use, nodes)
        pattern = [top, *chosen]
        sizes, each = np.unique(pattern, return_counts=True)
        times = int((left[sizes] // each).min())
        left[sizes] -= times * each
        out.append((times, pattern))


def _complete(room: int, have: list[int], use: dict[int, int], nodes: int) -> list[int]:
    """The filling of ``room`` with least waste that the search finds."""
    least = have[-1] if have else room + 1
    best: list[int] = []
    r = room
    for x in have:  # best fit: the longest that fits, again and again
        take = min(use[x], r // x)
        best += [x] * take
        r -= take * x
        if r < least:
            break
    waste = r
    if not waste or room < least:
        return best
    from bisect import bisect_left

    negative = [-x for x in have]
    count = 0
    stack: list[tuple[int, int, list[int]]] = [(room, bisect_left(negative, -room), [])]
    while stack and waste and count < nodes:
        r, at, done = stack.pop()
        count += 1
        if r < waste:
            best, waste = done, r
            if not waste:
                break
        if r < least or at >= len(have):
            continue
        x = have[at]
        stack.append((r, at + 1, done))  # without x
        if done.count(x) < use[x] and x <= r:
            rest = r - x
            if rest and use.get(rest, 0) > (rest == x) + done.count(rest) and rest <= x:
                best, waste = [*done, x, rest], 0
                break
            stack.append((rest, max(at, bisect_left(negative, -rest)), [*done, x]))
    return best


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length, which ranks stand in which sequences, sorted by (length, rank)."""
    rows, used, base = [], {}, 0
    for times, pattern in patterns:
        at = 0
        for x in pattern:
            rank = used.get(x, 0)
            rows.append((x, rank, base, at))
            used[x] = rank + times
            at += x
        base += times
    a = np.array(rows, np.int64).reshape(-1, 4)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return {"length": a[:, 0].copy(), "rank": a[:, 1].copy(), "base": a[:, 2].copy(), "offset": a[:, 3].copy()}


def _place(slots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots["length"] * (1 << 48) + slots["rank"]
        for b in batches:
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(keys, b.column("length").to_numpy() * (1 << 48) + rank, side="right") - 1
            seq = slots["base"][k] + rank - slots["rank"][k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq, pa.int64()), pa.array(slots["offset"][k], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = 3000) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of ``tokenize``, read more than once: give a written table)."""
    cell = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), 52).cast("int")
    rows = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", cell.alias("cell"))
    cells = C.written(rows.groupBy("length", "cell").agg(F.count("*").alias("n")), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = _slots(complete_bins(counts, capacity, nodes))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.join(starts, ["length", "cell"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(slots), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(C.written(tokenize(docs, path, capacity), "pieces"), capacity)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents"))
