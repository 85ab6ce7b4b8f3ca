"""N-gram Jaccard join by a prefix tree: exact components of documents whose n-gram sets are similar enough.

A document's set holds 64-bit hashes of its distinct word n-grams (fewer words: the whole sequence as one). The global
order puts n-grams that are frequent somewhere (``HEAVY`` of a task's documents) last, and is by hash otherwise. Sets
that reach the threshold t share l of the first ``size - ceil(t * size) + l`` n-grams of either in this order, for any l up to
the smaller one's.

1. Equal sets become one class, represented by their smallest key.
2. Each class is dealt out under its prefix n-grams, an n-gram counting where a class of near enough size has it too. A
   class that holds fewer than l of these links with nothing, and one that holds k is dealt out under the first k - l + 1.
   Such an n-gram belongs to the smallest class that holds it, its owner; so classes that share n-grams mostly share
   owners too, and meet in few blocks. A class whose size no other class of a block comes near leaves it.
3. In a block the prefixes form a compressed trie. A class goes down the trie once, the overlap of a shared path being
   counted once, and leaves a subtree whose remaining length (or, past its own prefix, what it has left itself) cannot
   lift the overlap to the threshold. Pairs that
   get to an end also have to agree in maps of slot parities, which bound the overlap of whole sets. Subtrees that lie in
   the class's own tree already are passed over, so that a block yields a spanning forest of candidates, never all pairs.
4. Classes that candidates join, however far, meet whole: linked ones do, and families that only share a passage do not.
   The same trie over whole sets gives exact overlaps, and again a spanning forest.
5. Components of the links follow by hash-to-minimum label spreading, and copies get their class's label.

Cases: null, empty and blank texts have the empty set and their own component; repeated rows are copies; rows without
doc_id, or that share one, are compared by keys of their own; ties in the order are equal hashes and so equal n-grams; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

HEAVY = 0.002
HEAVY_LEAST = 24
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Threshold:
    """Similarity of num / den."""

    num: int
    den: int

    def least(self, size: int) -> int:
        """The smallest overlap that a set of this size needs with any partner."""
        return -(-self.num * size // self.den)

    def needed(self, a: int, b: int) -> int:
        """The smallest overlap of sets of sizes a and b that links them."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def common(self, size: int) -> int:
        """How many n-grams of their prefixes two sets have in common, if this is the smaller one's size. It rises with
        the size: half as many again as a set may miss, plus one."""
        return min(1 + (size - self.least(size)) // 2, self.least(size))

    def prefix(self, size: int) -> int:
        return size - self.least(size) + self.common(size)

    def fewest(self, size: int) -> int:
        """Prefix n-grams that a set of this size has in common with any partner at least."""
        return self.common(self.least(size))

    def near(self, a: Column, b: Column) -> Column:
        """Whether sets of sizes a and b, a at most b, can link."""
        return F.lit(self.num) * b <= F.lit(self.den) * a

    def columns(self, size: Column) -> tuple[Column, Column]:
        """prefix(size) and fewest(size) as columns."""
        least = lambda x: F.floor((self.num * x + self.den - 1) / self.den)
        common = lambda x: F.least(1 + F.floor((x - least(x)) / 2), least(x))
        return size - least(size) + common(size), common(least(size))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-gram hashes, ascending."""
    with np.errstate(over="ignore"):
        for i, j, words, bounds in C.word_chunks(data, off):
            h = np.zeros(max(0, len(words) - n + 1), np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
            h = C.mix(h)
            for k in range(j - i):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if b - a >= n:
                    yield np.unique(h[a : b - n + 1])
                elif b > a:
                    s = np.uint64(b - a)
                    for w in words[a:b]:
                        s = s * np.uint64(0xD6E8FEB86659FD93) + w
                    yield C.mix(np.array([s], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(_signed(flat), pa.int64()))


SEEN = "key long, size long, digest binary, bits binary, gram long, n long"


def _seen(n: int):
    """A row for each document (key, size, digest and parity map of its set) and, without a key, one for each n-gram that
    is in many of the task's documents. A set of 2^20 counters, each at most what it should be or more, names those
    while the task reads; only sums over all tasks decide."""
    names = [x.split()[0] for x in SEEN.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def batch(**cols: pa.Array) -> pa.RecordBatch:
        rows = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(rows, t)) for c, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 20
        sketch = np.zeros(1 << bits, np.int32)
        seen: dict[int, int] = {}
        docs = 0
        for b in C.small_batches(batches):
            data, off = C.string_buffer(b.column("text"))
            sets = list(shingle_sets(data, off, n))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield batch(key=b.column("key"), size=pa.array([len(s) for s in sets], pa.int64()), digest=pa.array(digest, pa.binary()), bits=pa.array([parity_bits(s) for s in sets], pa.binary()))
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            docs += len(sets)
            flat = np.concatenate(sets)
            slot = (flat >> np.uint64(64 - bits)).astype(np.int64)
            sketch += np.bincount(slot, minlength=1 << bits).astype(np.int32)
            limit = max(HEAVY_LEAST, HEAVY * docs) / 2
            hot, times = np.unique(flat[sketch[slot] >= limit], return_counts=True)
            for k, v in zip(hot.tolist(), times.tolist()):
                seen[k] = seen.get(k, 0) + v
            if len(seen) > 400_000:
                seen = {k: v for k, v in seen.items() if v >= HEAVY * docs / 4}
        keep = {k: v for k, v in seen.items() if v >= max(HEAVY_LEAST, HEAVY * docs) / 2}
        yield batch(gram=pa.array(_signed(np.array(list(keep), np.uint64))), n=pa.array(list(keep.values()), pa.int64()))

    return run


def frequent(seen: DataFrame, docs: int) -> np.ndarray:
    """The n-grams that go last, ascending. The order only steers cost, so that counts may be low by what a task left
    out; at most (average set size) / HEAVY * 4 of them exist, whatever the number of documents."""
    got = seen.where("key is null and gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    limit = max(float(HEAVY_LEAST), HEAVY / 4 * docs)
    return np.sort(got.where(F.col("n") >= limit).select("gram").toArrow()["gram"].to_numpy().view(np.uint64))


def _ordered(s: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the set in the global order, ranks that ascend in it): the top bit of a rank marks a frequent n-gram."""
    if len(heavy) and len(s):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        late = heavy[at] == s
        rank = (s >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
        return s, np.sort(rank)
    return s, s >> np.uint64(1)


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each slot of a power of two of at least the set's size: whether an odd number of n-grams fall there.
    Where two such maps differ there is an n-gram of one set alone, so they bound the overlap from above."""
    b = 1 << max(6, min(16, (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8)).tobytes()


def _folded(bits: int, size: int, to: int) -> int:
    """The map of ``size`` slots as one of ``to``: slots that agree in their low bits are added."""
    while size > to:
        size //= 2
        # slot k is bit size - 1 - k of the number, so the upper half holds slots below ``size``
        bits = (bits >> size) ^ (bits & ((1 << size) - 1))
    return bits


def _grams(n: int, heavy_ref, t: Threshold, cut: int):
    """A row for each prefix n-gram: key, size * 2^32 + place, and its rank in the global order less ``cut`` low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, low = heavy_ref.value, np.uint64(cut)
        for b in C.small_batches(batches):
            data, off = C.string_buffer(b.column("text"))
            sets = list(shingle_sets(data, off, n))
            parts = [_ordered(s, heavy)[1][: t.prefix(len(s))] if len(s) else s for s in sets]
            n_of = np.array([len(p) for p in parts], np.int64)
            if not n_of.sum():
                continue
            place = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
            about = np.repeat(np.array([len(s) for s in sets], np.int64) << 32, n_of) | place
            gram = _signed(np.concatenate(parts) >> low << low)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.repeat(np.arange(len(sets)), n_of))), pa.array(gram), pa.array(about)], ["key", "gram", "about"])

    return run


def _sets(n: int, heavy_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = heavy_ref.value
        for b in C.small_batches(batches, 128):
            data, off = C.string_buffer(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("key"), _long_lists([_ordered(s, heavy)[1] for s in shingle_sets(data, off, n)])], ["block", "key", "ranks"])

    return run


class Trie:
    """A compressed prefix tree over sorted token sequences, laid out in arrays.

    Node k stands for tokens[start[k]:stop[k]] below its parent; children of a node are neighbours. low is the least set
    size below it, after the longest remainder of a set after it; sets first to last, in sorted order, pass through it.
    """

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray, places: list[np.ndarray]):
        self.order = sorted(range(len(seqs)), key=lambda k: seqs[k].astype(">u8").tobytes())
        self.sizes = sizes[self.order]
        own = [seqs[k] for k in self.order]
        self.lengths = np.array([len(s) for s in own])
        self.tokens = np.concatenate(own) if own else np.zeros(0, np.uint64)
        base = np.concatenate(([0], np.cumsum(self.lengths)))
        lcp = np.zeros(max(0, len(own) - 1), np.int64)
        for k in range(len(lcp)):
            m = min(len(own[k]), len(own[k + 1]))
            differ = own[k][:m] != own[k + 1][:m]
            lcp[k] = int(differ.argmax()) if differ.any() else m
        rows = [(0, 0, 0, 0, len(own), 0)]  # start, stop, depth at its end, first, last, sets that end here
        kids: list[tuple[int, int]] = []
        at = 0
        while at < len(rows):
            start, stop, depth, lo, hi, _ = rows[at]
            ends = lo
            while ends < hi and self.lengths[ends] == depth:
                ends += 1
            rows[at] = (start, stop, depth, lo, hi, ends - lo)
            first = len(rows)
            if ends < hi:
                cuts = ends + np.flatnonzero(lcp[ends : hi - 1] <= depth) + 1
                edges = [ends, *cuts.tolist(), hi]
                for a, b in zip(edges, edges[1:]):
                    d = int(lcp[a : b - 1].min()) if b - a > 1 else int(self.lengths[a])
                    rows.append((int(base[a]) + depth, int(base[a]) + d, d, a, b, 0))
            kids.append((first, len(rows)))
            at += 1
        a = np.array(rows, np.int64)
        self.start, self.stop, self.depth, self.first, self.last, self.ending = a.T.copy()
        self.kids = np.array(kids, np.int64)
        self.low = np.array([self.sizes[x:y].min() if y > x else 0 for x, y in zip(self.first, self.last)])
        self.after = np.full(len(a), self.sizes.max() if len(own) else 0)
        if len(own):
            # what may follow a token: the rest of its set
            left = np.repeat(self.sizes, self.lengths) - 1 - np.concatenate([places[k] for k in self.order])
            for k in range(1, len(a)):
                self.after[k] = left[base[self.first[k] : self.last[k]] + self.depth[k] - 1].max()


class Block:
    """Sets that meet under one owner. seqs: their known tokens in global order; sizes: whole set sizes; whole: the
    sequences are the whole sets. Else they are the prefixes' tokens that other classes share, places being where they
    stand in the set and last the prefix's last token, and the overlap is only bounded."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray, t: Threshold, whole: bool, places: list[np.ndarray] | None = None, last: np.ndarray | None = None, bits: list[bytes] | None = None):
        flat = np.concatenate(seqs) if seqs else np.zeros(0, np.uint64)
        tokens, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        self.t, self.whole, self.sizes, self.seqs, self.last = t, whole, sizes, seqs, last
        self.slots = [8 * len(b) for b in bits or []]
        self.bits = [int.from_bytes(b, "big") for b in bits or []]
        every = np.arange(max((len(s) for s in seqs), default=0))
        self.places = places or [every[: len(s)] for s in seqs]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
        # a token of one set only cannot match; without it near copies share long paths and maps of tokens stay small
        often = times > 1
        self.width = int(often.sum())
        code, matters = (np.cumsum(often) - 1)[code].astype(np.int32), often[code]
        shared = [matters[a:b] for a, b in zip(bounds, bounds[1:])]
        self.codes = [code[a:b][m] for a, b, m in zip(bounds, bounds[1:], shared)]
        self.known = np.array([t.prefix(int(z)) for z in sizes])
        if not whole:
            # codes from here on may stand past the prefix's last token
            self.past = np.searchsorted(tokens[often], last >> np.uint64(33), side="left")
        self.bands = np.floor(np.log(np.maximum(sizes, 1)) / np.log(t.den / t.num) + 1e-9).astype(int)
        self.tries: dict[int, tuple[Trie, np.ndarray]] = {}
        for band in np.unique(self.bands):
            ids = np.flatnonzero(self.bands == band)
            trie = Trie([self.codes[k] for k in ids], sizes[ids], [self.places[k][shared[k]] for k in ids])
            self.tries[int(band)] = (trie, ids[trie.order])

    def _rest(self, y: int, x: int) -> int:
        """The most that prefixes of y and x leave to match, if x's ends first."""
        seen = int(np.searchsorted(self.seqs[y], self.last[x] >> np.uint64(33), side="left"))
        return int(min(self.sizes[x] - self.known[x], self.sizes[y] - (self.places[y][seen - 1] + 1 if seen else 0)))

    def _differ(self, y: int, x: int) -> int:
        """At least so many n-grams are in one of the sets alone."""
        to = min(self.slots[y], self.slots[x])
        return (_folded(self.bits[y], self.slots[y], to) ^ _folded(self.bits[x], self.slots[x], to)).bit_count()

    def near(self, ys: np.ndarray, comp: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches (of ys, sets) of pairs that may reach (whole: that do reach) the threshold; comp: pairs with one label
        are passed over."""
        mask = np.zeros((len(ys), self.width), bool)
        for i, y in enumerate(ys):
            mask[i, self.codes[y]] = True
        for band, (trie, ids) in self.tries.items():
            mine = np.flatnonzero(np.abs(self.bands[ys] - band) <= 1)
            if len(mine) and not (len(ids) == 1 and len(mine) == 1 and ids[0] == ys[mine[0]]):
                yield from self._down(trie, ids, ys, mine, mask, comp)

    def _down(self, trie: Trie, ids: np.ndarray, ys: np.ndarray, who: np.ndarray, mask: np.ndarray, comp: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of ys[who] go down the trie together, a level at a time."""
        t, flat = self.t, mask.ravel()
        nodes, overlap = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        labels = comp[ids] if comp is not None else None
        # one label throughout a node: its own, else -1
        if labels is not None:
            change = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
            ends = np.maximum(trie.last - 1, trie.first)
            plain = np.where(change[ends] == change[trie.first], labels[trie.first], -1)
        while len(nodes):
            n_end = trie.ending[nodes]
            if n_end.any():
                k = np.repeat(np.arange(len(nodes)), n_end)
                where = trie.first[nodes][k] + np.arange(len(k)) - np.repeat(np.cumsum(n_end) - n_end, n_end)
                sets, got, mine = ids[where], overlap[k], ys[who[k]]
                size = self.sizes[mine]
                need = -(-t.num * (size + self.sizes[sets]) // (t.num + t.den))
                if not self.whole:
                    # tokens up to the earlier of the two prefixes' last ones are counted; of the rest all may match
                    early = self.last[sets] <= self.last[mine]
                    got = got + np.where(early, self.sizes[sets] - self.known[sets], size - self.known[mine])
                ok = (got >= need) & (sets != mine)
                if not self.whole and ok.any():
                    at = np.flatnonzero(ok)
                    before = overlap[k][at]
                    both = (size + self.sizes[sets])[at] - 2 * need[at]
                    ok[at] = [g + (self._rest(m, s) if e else self._rest(s, m)) >= n and self._differ(m, s) <= d for g, m, s, e, n, d in zip(before, mine[at], sets[at], early[at], need[at], both)]
                if ok.any():
                    yield mine[ok], sets[ok]
            lo, hi = trie.kids[nodes, 0], trie.kids[nodes, 1]
            width = hi - lo
            if not width.any():
                return
            k = np.repeat(np.arange(len(nodes)), width)
            child = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(width) - width, width)
            if comp is not None:
                keep = plain[child] != comp[ys[who[k]]]
                child, k = child[keep], k[keep]
                if not len(child):
                    return
            span = trie.stop[child] - trie.start[child]
            hits = np.zeros(len(child), np.int64)
            for a in range(0, len(child), 20_000):  # bounded room for long edges
                z = slice(a, a + 20_000)
                n = span[z]
                pos = np.repeat(trie.start[child[z]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                cell = np.repeat(who[k[z]] * self.width, n) + trie.tokens[pos]
                hits[z] = np.add.reduceat(flat[cell], np.cumsum(n) - n, dtype=np.int64)
            over = overlap[k] + hits
            size = self.sizes[ys[who[k]]]
            need = -(-t.num * (size + trie.low[child]) // (t.num + t.den))
            rest = trie.after[child]
            if not self.whole:
                # past the asking prefix's last token nothing is counted, so that all after its prefix may match
                asks = ys[who[k]]
                past = trie.tokens[trie.stop[child] - 1] >= self.past[asks]
                rest = np.where(past, np.maximum(rest, size - self.known[asks]), rest)
            keep = over + np.minimum(rest, size) >= need
            nodes, overlap, who = child[keep], over[keep], who[k[keep]]


def _turns(n: int, width: int) -> int:
    """How many sets go down together: at most 16 MB of masks, and fewer in a large block, where most are soon found."""
    return max(1, min(256, 16_000_000 // max(1, width), 300_000 // max(1, n)))


def _forest(block: Block) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that ``block`` finds: every set asks, but no longer for sets of its own tree."""
    n = len(block.seqs)
    comp, pairs = np.arange(n), []
    step = min(64, _turns(n, block.width))
    for at in range(0, n, step):
        for a, b in block.near(np.arange(at, min(at + step, n)), comp):
            for y, x in zip(a.tolist(), b.tolist()):
                if comp[x] != comp[y]:
                    pairs.append((y, x))
                    comp[comp == comp[x]] = comp[y]
    return pairs


def candidate_links(seqs: list[np.ndarray], places: list[np.ndarray], last: np.ndarray, bits: list[bytes], sizes: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of prefixes that may reach the threshold."""
    return _forest(Block(seqs, sizes, t, False, places, last, bits))


def block_links(seqs: list[np.ndarray], sizes: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the links among whole sets."""
    return _forest(Block(seqs, sizes, t, True))


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = a.offsets.to_numpy()
    flat = a.values.to_numpy()
    flat = flat.view(np.uint64) if flat.dtype == np.int64 else flat.astype(np.uint64)
    return [flat[x:y] for x, y in zip(off, off[1:])]


def _stars(keys: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    """(a, b): every member of a tree of links with the tree's smallest key, so that no chain is longer than one group's."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while (at := up.setdefault(k, k)) != k:
            up[k] = k = up[at]
        return k

    for x, y in links:
        x, y = root(int(keys[x])), root(int(keys[y]))
        up[max(x, y)] = min(x, y)
    pairs = [(k, r) for k in list(up) if (r := root(k)) != k]
    return pa.table({"a": pa.array([k for k, _ in pairs], pa.int64()), "b": pa.array([r for _, r in pairs], pa.int64())})


def _candidates(t: Threshold):
    def run(group: pa.Table) -> pa.Table:
        places = [p.astype(np.int64) + np.arange(first - 1, first - 1 + len(p)) for p, first in zip(_lists(group["skips"]), group["first"].to_pylist())]
        return _stars(group["key"].to_numpy(), candidate_links(_lists(group["grams"]), places, group["last"].to_numpy().view(np.uint64), group["bits"].to_pylist(), group["size"].to_numpy(), t))

    return run


def _links(t: Threshold):
    def run(group: pa.Table) -> pa.Table:
        seqs = _lists(group["ranks"])
        return _stars(group["key"].to_numpy(), block_links(seqs, np.array([len(s) for s in seqs]), t))

    return run


#: A group whose members weigh more than this together (n-grams of whole sets, shared ones of prefixes) meets in parts.
MOST_TOGETHER = 8_000_000


def in_parts(rows: DataFrame, group: str, weight: Column) -> DataFrame:
    """rows whose ``group`` is replaced where it weighs more than MOST_TOGETHER: its members are dealt into parts by key, of
    about a quarter of that, and each two parts are a group of their own. Any two members still meet, and a task has a
    bounded load. rows are read more than once: give a written table."""
    load = rows.groupBy(group).agg(F.sum(weight).alias("n__")).where(F.col("n__") > MOST_TOGETHER)
    big = C.written(load.select(group, F.ceil(F.col("n__") * 4 / MOST_TOGETHER).cast("long").alias("p__")), "big")
    if big.isEmpty():
        return rows
    part = F.pmod(F.xxhash64("key"), F.col("p__"))
    cut = rows.join(big, group).withColumn("part__", part).withColumn("other__", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("p__") - 1), lambda q: q != F.pmod(F.xxhash64("key"), F.col("p__")))))
    pairs = cut.withColumn(group, F.xxhash64(group, F.least("part__", "other__"), F.greatest("part__", "other__"))).select(*rows.columns)
    return rows.join(big, group, "left_anti").select(*rows.columns).union(pairs)


def blocks_of(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block, key): the sets that are compared whole: those that candidate links join, however far."""
    merged = C.written(components(links), "merged")
    keys = C.written(merged.union(merged.select(F.col("label").alias("key"), "label").distinct()), "together")
    known = sizes.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key").select(F.col("label").alias("block"), "key", "size")
    return C.written(in_parts(C.written(known, "known"), "block", F.col("size")).select("block", "key"), "blocks")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of edges (u > v) has one edge and none is a v: then v is the label of its component."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key that links reach, for every key with a link. Labels spread by rounds of large-star
    and small-star, each of which writes its edges to the shared folder; there are about log(longest chain) of them, and
    none where the links are stars already."""
    edges = C.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = C.written(small, "edges")
        C.drop(edges)
        edges = new
    return edges.select(F.col("u").alias("key"), F.col("v").alias("label"))


SALTS = 16


def classes_of(rows: DataFrame) -> DataFrame:
    """(key, size, class): class is the smallest key with the same set. Rows are dealt out by digest and a salt, so that
    copies of one text are no single task; digests that come once meet nothing."""
    salted = rows.where("size > 0").select("key", "digest", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy("digest", "salt").agg(F.min("key").alias("class"), F.count("*").alias("n"))
    several = parts.groupBy("digest").agg(F.min("class").alias("class"), F.sum("n").alias("n")).where("n > 1")
    several = several.select("digest", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    copies = salted.join(several, ["digest", "salt"]).where("key <> class").select("key", "class")
    return C.written(copies, "copies")


def without(docs: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """docs but for those whose ``by`` is among keys (a written table). At most BROADCAST_KEYS of them (16 MB) are sent
    to all, so that texts are not shuffled; beyond that both sides are."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, by, "left_anti")


def _meetings(whole: DataFrame, t: Threshold) -> DataFrame:
    """(key, size, last, grams, skips, owners) of the classes that may link, for whole: key, known (the shared prefix n-grams
    in order: place, gram, owner), last, size. A linked pair has l of its known n-grams in common, so the first of these
    stands before a class's last l - 1 known ones: owners are those up to there. skips: how many n-grams before each are
    not known, which changes seldom where places always do."""
    k, least = F.size("known"), t.columns(F.col("size"))[1].cast("int")
    skips = F.transform("known", lambda x, i: x["place"] - i)
    return whole.where(k >= least).select("key", "size", "last", F.col("known.gram").alias("grams"), skips.alias("skips"), F.slice("known.owner", F.lit(1), k - least + 1).alias("owners"))


def link_classes(docs: DataFrame, n: int, t: Threshold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: key (unique long) and text. Gives (sets: key, size; copies: key, class; labels of linked classes: key, label)."""
    spark = docs.sparkSession
    docs = docs.select("key", "text")
    seen = C.written(docs.mapInArrow(_seen(n), SEEN), "seen")
    rows = seen.where("key is not null")
    docs_n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    heavy = spark.sparkContext.broadcast(frequent(seen, docs_n))
    copies = classes_of(rows)
    # a rank keeps ten bits more than it takes to number all n-grams: few unlike ones agree, and zeros compress
    cut = max(0, min(31, 64 - 11 - int(total).bit_length()))
    grams = without(docs, copies.select("key"), "key").mapInArrow(_grams(n, heavy, t, cut), "key long, gram long, about long")
    size, place = F.shiftright("about", 32), F.col("about").bitwiseAND(0xFFFFFFFF)
    order = Window.partitionBy("gram").orderBy("about")
    below, above = F.shiftright(F.lag("about").over(order), 32), F.shiftright(F.lead("about").over(order), 32)
    near = F.coalesce(t.near(below, size), F.lit(False)) | F.coalesce(t.near(size, above), F.lit(False))
    # each class's last prefix n-gram is kept whether or not another has it
    marked = grams.withColumn("near", near).withColumn("last", place + 1 == t.columns(size)[0]).where("near or last")
    shared = marked.withColumn("owner", F.when(F.col("near"), F.min(F.when(F.col("near"), F.col("key"))).over(Window.partitionBy("gram"))))
    # 31 bits of each shared n-gram are enough for a bound from above, and keep the order. Rows go to their class as they
    # are: an n-gram's rows hold few of one class, so that lists made before would be longer than what they hold
    short = F.struct(place.cast("int").alias("place"), F.shiftrightunsigned("gram", 33).cast("int").alias("gram"), "owner")
    whole = shared.select("key", "gram", "about", "owner").repartition("key").groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("owner").isNotNull(), short))).alias("known"), F.max(F.when(place + 1 == t.columns(size)[0], F.col("gram"))).alias("last"), F.max(size).alias("size")
    )
    met = C.written(_meetings(whole, t), "shared")
    C.settle(spark)
    first = F.array_position("owners", F.col("owner")).cast("int")
    who = met.select("key", "size", "owners", F.size("grams").alias("n"), F.explode(F.array_distinct("owners")).alias("owner")).select("owner", "key", "size", first.alias("first"), (F.col("n") - first + 1).alias("n"))
    who = C.written(with_near_size(who, t, "owner"), "met")
    # a class's lists are dealt out once it is known which owners they go to, and from the first n-gram of each: what two
    # classes have in common before it, another owner has seen
    lists = met.drop("owners").join(rows.select("key", "bits"), "key")
    rest = lambda c: F.slice(c, F.col("first"), F.col("n")).alias(c)
    dealt = in_parts(who, "owner", F.col("n")).select("owner", "key", "first", "n").join(lists, "key").select("owner", "key", "size", "last", "bits", "first", rest("grams"), rest("skips"))
    near = C.written(dealt.groupBy("owner").applyInArrow(_candidates(t), "a long, b long"), "near")
    sizes = rows.select("key", "size")
    C.settle(spark, met, who)
    near = blocks_of(near, sizes)
    if near.count() <= BROADCAST_KEYS:
        near = F.broadcast(near)  # 16 MB at most; beyond it both sides are shuffled
    sets = docs.join(near, "key").select("block", "key", "text").mapInArrow(_sets(n, heavy), "block long, key long, ranks array<long>")
    links = sets.groupBy("block").applyInArrow(_links(t), "a long, b long")
    return sizes, copies, C.written(components(links), "labels")


def with_near_size(rows: DataFrame, t: Threshold, by: str) -> DataFrame:
    """The rows to which another of the same ``by`` comes near enough in size: then the next by size does."""
    order = Window.partitionBy(by).orderBy("size")
    below, above = F.lag("size").over(order), F.lead("size").over(order)
    marked = rows.withColumn("near", F.coalesce(t.near(below, F.col("size")), F.lit(False)) | F.coalesce(t.near(F.col("size"), above), F.lit(False)))
    return marked.where("near").drop("near")


def join_components(docs: DataFrame, n: int = 3, t: Threshold = Threshold(90, 100)) -> DataFrame:
    """(key, n_shingles, component_id) for docs with key (unique long) and text."""
    C.shared_dir(docs.sparkSession)
    sizes, copies, labels = link_classes(docs, n, t)
    # only keys that are copies or linked change their label; a copy takes its class's
    moved = copies.join(labels.select(F.col("key").alias("class"), "label"), "class", "left").select("key", F.coalesce("label", "class").alias("label"))
    moved = C.written(moved.union(labels.where("key <> label")), "moved")
    joined = sizes.join(F.broadcast(moved) if moved.count() <= BROADCAST_KEYS else moved, "key", "left")
    return joined.select("key", F.col("size").alias("n_shingles"), F.coalesce("label", "key").alias("component_id"))


def _repeats(docs: DataFrame) -> bool:
    """Whether doc_ids are no keys: null or repeated."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs as a table with a key for each row, the key's name)."""
    own = "key__" + "_" * max((len(c) for c in docs.columns if c.startswith("key__")), default=0)
    return C.written(docs.withColumn(own, F.monotonically_increasing_id()), "rows"), own


def document_components(docs: DataFrame, n: int = 3, t: Threshold = Threshold(90, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs with doc_id and text: a row for each row, whether or not its doc_id is
    null or repeated; component_id is the smallest doc_id among the rows that links reach, null where all are null."""
    docs = docs.select("doc_id", "text")
    if not _repeats(docs):
        return join_components(docs.withColumnRenamed("doc_id", "key"), n, t).withColumnRenamed("key", "doc_id")
    rows, own = _keyed(docs)
    found = C.written(join_components(rows.select(F.col(own).alias("key"), "text"), n, t).join(rows.select(F.col(own).alias("key"), "doc_id"), "key"), "found")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.shared_dir(spark)
    return document_components(C.table(spark, sf_dir, "documents"), 3, Threshold(90, 100))


def keep_one(docs: DataFrame, n: int = 5, t: Threshold = Threshold(80, 100)) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (nulls last, then the smallest text).

    Every row takes part, whether or not its doc_id is null or repeated. Rows without words stay. Where doc_ids are
    unique they are the keys, and no text is shuffled or copied; else the rows are written once with keys of their own.
    """
    C.shared_dir(docs.sparkSession)
    if not _repeats(docs):
        found = join_components(docs.select(F.col("doc_id").alias("key"), "text"), n, t)
        return without(docs, C.written(found.where("key <> component_id").select(F.col("key").alias("doc_id")), "dropped"), "doc_id")
    rows, own = _keyed(docs)
    found = C.written(join_components(rows.select(F.col(own).alias("key"), "text"), n, t), "found")
    several = found.join(found.where("key <> component_id").select("component_id").distinct(), "component_id", "left_semi").select(F.col("key").alias(own), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text", own)).getField(own)
    ranked = C.written(rows.select(own, "doc_id", "text").join(several, own), "several")
    dropped = ranked.select(own, "component_id").join(ranked.groupBy("component_id").agg(first.alias("first")), "component_id").where(F.col(own) != F.col("first"))
    return without(rows, C.written(dropped.select(own), "dropped"), own).drop(own)
