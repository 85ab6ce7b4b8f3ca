"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on the driver to at most ``SAMPLE`` vectors, chosen by a hash of their keys; every row of the table
is in the index, each in the leaf that it reaches by nearest centroids. A query takes nodes from a priority queue by
inner product with their centroids, opening the best first, and goes on to further leaves as long as they come near
enough: a leaf is visited while it lies, in units of the query's length, within a gap of the best leaf that calibration
found to be needed, the smallest gap at which queries from the sample reached ``TARGET`` of their true neighbours within
the sample. So a query between clusters widens its search and one inside a cluster does not. Leaves are split into
parts by a hash, rows and queries alike, so that a hot leaf is many tasks. Scores of what is returned are sums in double
precision over the original vectors.

The sample bounds the tree, so leaves grow with the table and a query reads a constant share of it (``share_visited``).

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not
the commonest one; ties go to the smaller key; repeated vectors are separate candidates; rows that agree in their key
are never each other's candidates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 16_000
BRANCH = 12
LEAF = 400
TARGET = 0.96
PART_ROWS = 4_096
PART_QUERIES = 4_096


@dataclass
class Tree:
    """Centroids of all nodes; children of node k are first[k] .. first[k] + BRANCH at most; leaves have a number."""

    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1 if len(self.leaf) else 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.unique(at[self.count[at] > 0])
            if not len(inner):
                return self.leaf[at]
            for k in inner:
                rows = np.flatnonzero(at == k)
                c = self.centroids[self.first[k] : self.first[k] + self.count[k]]
                at[rows] = self.first[k] + np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)

    def order(self, q: np.ndarray, enough) -> list[int]:
        """Leaves in the order of best-bin-first search, until enough(leaf, its score) says stop."""
        queue, out, tie = [(0.0, 0, 0)], [], 0
        while queue:
            low, _, k = heapq.heappop(queue)
            if not self.count[k]:
                if enough(int(self.leaf[k]), -low):
                    break
                out.append(int(self.leaf[k]))
                continue
            a, b = self.first[k], self.first[k] + self.count[k]
            for node, near in zip(range(a, b), (self.centroids[a:b] @ q).tolist()):
                tie += 1
                heapq.heappush(queue, (-near, tie, node))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def build_tree(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 5) -> Tree:
    rng = np.random.default_rng(seed)
    centroids, first, count, number = [x.mean(0) if len(x) else np.zeros(1)], [0], [0], [-1]
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(rows) > leaf:
            c = _kmeans(x[rows], min(branch, len(rows)), rng)
            near = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)
            parts = [(c[k], rows[near == k]) for k in range(len(c)) if (near == k).any()]
        if len(parts) < 2:  # small, or copies of one vector
            number[node] = leaves
            leaves += 1
            continue
        first[node], count[node] = len(centroids), len(parts)
        for c, own in parts:
            todo.append((len(centroids), own))
            centroids.append(c)
            first.append(0)
            count.append(0)
            number.append(-1)
    return Tree(np.array(centroids), np.array(first), np.array(count), np.array(number))


def calibrate(tree: Tree, x: np.ndarray, k: int, target: float = TARGET, queries: int = 300) -> float:
    """The smallest gap, in units of a query's length, within which sample queries find ``target`` of their neighbours.
    Best-bin-first need not meet leaves by falling score, so a leaf's gap is the largest up to it."""
    if len(x) < 2:
        return float("inf")
    own = tree.assign(x)
    rows = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    k = min(k, len(x) - 1)
    gaps = []
    for r in rows:
        s = x @ x[r]
        s[r] = -np.inf
        true = np.argpartition(-s, k - 1)[:k]
        met: list[tuple[int, float]] = []
        tree.order(x[r], lambda leaf, score, met=met: met.append((leaf, score)))
        scores = np.array([score for _, score in met])
        gap = np.empty(tree.leaves)
        gap[[leaf for leaf, _ in met]] = np.maximum.accumulate(scores.max() - scores)
        gaps.append(gap[own[true]] / np.sqrt(x[r] @ x[r]))
    return float(np.quantile(np.concatenate(gaps), target, method="higher")) * (1 + 1e-9) + 1e-12


def usable(vector: Column) -> Column:
    clean = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & clean & F.exists(vector, lambda v: v != 0)


def _matrix(col) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def _assign(ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ref.value[0]
        for b in C.small_batches(batches, 4096):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(tree.assign(_matrix(b.column("vector"))), pa.int64())], ["id", "vector", "leaf"])

    return run


def _visits(ref, counts: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, gap = ref.value
        for b in C.small_batches(batches, 256):
            x, which, leaf = _matrix(b.column("vector")), [], []
            for r, q in enumerate(x):
                # within the gap of the best leaf so far, and until more rows than neighbours wanted are met
                state, reach = [-np.inf, 0], gap * float(np.sqrt(q @ q))

                def enough(at: int, score: float, state=state, reach=reach) -> bool:
                    state[0] = max(state[0], score)
                    stop = state[0] - score > reach and state[1] > k
                    state[1] += counts[at]
                    return stop

                for at in tree.order(q, enough):
                    which.append(r)
                    leaf.append(at)
            which = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(which), b.column("vector").take(which), pa.array(leaf, pa.int64())], ["id", "vector", "leaf"])

    return run


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products whose value depends on the two vectors alone, not on their neighbours in the matrix."""
    return (x * q).sum(axis=1)


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, out = rows["id"].to_numpy(), ([], [], [])
        if len(ids) and queries.num_rows:
            order = np.argsort(ids, kind="stable")
            ids, x, q = ids[order], _matrix(rows["vector"])[order], _matrix(queries["vector"])
            qids = queries["id"].to_numpy()
            for at in range(0, len(q), 256):
                near = q[at : at + 256] @ x.T
                for r, s in enumerate(near):
                    mine = qids[at + r]
                    s[ids == mine] = -np.inf
                    top = np.flatnonzero(s > -np.inf)
                    if len(top) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        top = np.flatnonzero(s >= edge - 1e-9 * (1 + abs(edge)))
                    exact = exact_scores(x[top], q[at + r])
                    best = np.lexsort((ids[top], -exact))[:k]
                    out[0].append(np.full(len(best), mine))
                    out[1].append(ids[top][best])
                    out[2].append(exact[best])
        cat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
        return pa.table({"query_id": cat(out[0], np.int64), "vec_id": cat(out[1], np.int64), "score": cat(out[2], np.float64)})

    return run


def search(table: DataFrame, queries: Column, k: int = 20, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows of ``table`` (vec_id long, embedding array) that meet ``queries``."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), queries.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    got = rows.select("vector").orderBy(C.crc_order("id"), "id").limit(sample).toArrow()
    x = _matrix(got["vector"]) if got.num_rows else np.zeros((0, 1))
    x = x[np.lexsort(x.T)] if len(x) else x
    tree = build_tree(x)
    ref = spark.sparkContext.broadcast((tree, calibrate(tree, x, k, target)))  # bounded by the sample
    # vectors keep their type; integers are exact as doubles
    kind = "array<float>" if dict(rows.dtypes)["vector"] == "array<float>" else "array<double>"
    schema = f"id long, vector {kind}, leaf long"
    index = C.written(rows.select("id", F.col("vector").cast(kind).alias("vector")).mapInArrow(_assign(ref), schema), "index")
    asked = rows.where("asks").select("id", F.col("vector").cast(kind).alias("vector"))
    counts = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row a leaf
        counts[r["leaf"]] = r["count"]
    visits = C.written(asked.mapInArrow(_visits(ref, counts, k), schema), "visits")
    asking = visits.groupBy("leaf").agg(F.count("*").alias("n"))
    parts = F.broadcast(spark.createDataFrame([(i, -(-int(n) // PART_ROWS)) for i, n in enumerate(counts) if n], "leaf long, parts int").join(asking, "leaf").select("leaf", "parts", F.ceil(F.col("n") / PART_QUERIES).cast("int").alias("slices")))
    left = index.join(parts, "leaf").select("id", "vector", "leaf", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = visits.join(parts, "leaf").select("id", "vector", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    by = ["leaf", "part", "slice"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_visited(table: DataFrame, queries: Column, k: int = 20, sample: int = SAMPLE, target: float = TARGET) -> float:
    """The share of the sample's rows that its queries meet, a measure of what a search costs."""
    rows = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), queries.alias("asks")).where(usable(F.col("vector")))
    x = _matrix(rows.orderBy(C.crc_order("id"), "id").limit(sample).select("vector").toArrow()["vector"])
    x = x[np.lexsort(x.T)]
    tree = build_tree(x)
    gap, counts = calibrate(tree, x, k, target), np.bincount(tree.assign(x), minlength=tree.leaves)
    met = []
    for q in x[np.linspace(0, len(x) - 1, min(200, len(x))).astype(int)]:
        best = [-np.inf]

        def enough(at: int, score: float, best=best, reach=gap * float(np.sqrt(q @ q))) -> bool:
            best[0] = max(best[0], score)
            return best[0] - score > reach

        met.append(counts[tree.order(q, enough)].sum())
    return float(np.mean(met) / len(x))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
