"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: one field of hashed words (weight log(1 + count), scaled to unit length), one bucket for
each structure statistic, and one bucket for each metadata column. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),

the sum-of-squares identity, so a text costs time in proportion to its features. The model is fitted on the driver from
at most ``SAMPLE`` labelled rows, chosen by a hash of their keys; only the feature vectors of their whole texts reach the
driver. Scoring covers whole texts of all rows.

Cases: null and empty texts score as a text without words; null metadata is a value of its own; repeated rows score
alike; without labelled rows of both kinds the model is the prior (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 12_000
WORD_BITS = 16
RANK = 4
LEVELS = 24
STATISTICS = (
    "words", "word_length", "distinct_share", "top_share", "upper_share", "digit_share", "mark_share", "mark_per_word",
    "line_length", "repeated_lines", "letter_entropy", "bigram_repeat",
)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123), *range(128, 256)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 4


def width(metadata: int) -> int:
    return (1 << WORD_BITS) + (len(STATISTICS) + metadata) * LEVELS


def _levels(x: np.ndarray, kind: str) -> np.ndarray:
    """Bucket numbers: shares in equal steps of their square root, sizes in half powers of two."""
    if kind == "share":
        return np.minimum((np.sqrt(np.clip(x, 0, 1)) * (LEVELS - 1)).astype(np.int64), LEVELS - 1)
    return np.minimum((2 * np.log2(1 + np.maximum(x, 0))).astype(np.int64), LEVELS - 1)


def _statistics(words: np.ndarray, text: np.ndarray, counts: np.ndarray) -> list[int]:
    n = len(words)
    kinds = np.bincount(_KIND[text], minlength=5)
    filled = max(1, int(kinds[1:].sum()))
    letters = max(1, int(kinds[1] + kinds[2]))
    breaks = np.flatnonzero(text == 10)
    edges = np.concatenate(([-1], breaks, [len(text)]))
    lines = len(edges) - 1
    repeated = 0.0
    if lines > 1:
        # a line's signature: a polynomial of its bytes, free of its place in the text
        size = np.diff(edges) - 1
        sign = C.span_hashes(text, edges[:-1] + 1, edges[1:])
        sign = sign[size > 0]
        repeated = 1 - len(np.unique(sign)) / len(sign) if len(sign) else 0.0
    by = np.bincount(text[text > 32], minlength=256)
    p = by[by > 0] / filled
    pairs = C.mix(words[:-1] ^ (words[1:] << np.uint64(1))) if n > 1 else words[:0]
    shares = {
        "distinct_share": len(counts) / n if n else 0, "top_share": counts.max() / n if n else 0, "upper_share": kinds[1] / letters, "digit_share": kinds[3] / filled,
        "mark_share": kinds[4] / filled, "repeated_lines": repeated, "letter_entropy": float(-(p * np.log2(p)).sum()) / 8 if len(p) else 0, "bigram_repeat": 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0,
    }
    sizes = {"words": n, "word_length": filled / n if n else 0, "mark_per_word": 4 * kinds[4] / n if n else 0, "line_length": filled / lines}
    return [int(_levels(np.float64(shares[s]), "share") if s in shares else _levels(np.float64(sizes[s]), "size")) for s in STATISTICS]


def vectors(data: np.ndarray, off: np.ndarray, metadata: list[list[float | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature ids, values) of each text."""
    mask = np.uint64((1 << WORD_BITS) - 1)
    base = 1 << WORD_BITS
    for i, j, h, bounds in C.word_chunks(data, off):
        for k in range(i, j):
            words = h[bounds[k - i] : bounds[k - i + 1]]
            full, all_counts = np.unique(words, return_counts=True)
            ids, at = np.unique(full & mask, return_inverse=True)
            x = np.log1p(np.bincount(at, weights=all_counts, minlength=len(ids)))
            x /= max(1e-9, np.sqrt((x * x).sum()))
            levels = _statistics(words, data[off[k] : off[k + 1]], all_counts)
            levels += [0 if m[k] is None or m[k] != m[k] else 1 + min(LEVELS - 2, int(_levels(np.float64(m[k]), "size"))) for m in metadata]
            fields = base + np.arange(len(levels)) * LEVELS + np.array(levels)
            yield np.concatenate((ids.astype(np.int64), fields)), np.concatenate((2 * x, np.full(len(levels), 0.5)))


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One margin for each vector; starts are where they begin in ids, none is empty."""
        v = self.v[ids] * x[:, None]
        linear = np.add.reduceat(self.w[ids] * x, starts)
        return self.w0 + linear + 0.5 * (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)).sum(1)


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -35, 35)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 12, rate: float = 0.05, decay: float = 2e-5, batch: int = 128, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, both classes weighing alike."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if not len(rows) or y.min() == y.max():
        if len(rows):
            n = len(rows)
            model.w0 = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        model.v[:] = 0
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            ids = np.concatenate([rows[k][0] for k in take])
            x = np.concatenate([rows[k][1] for k in take])
            n = np.array([len(rows[k][0]) for k in take])
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            v = model.v[ids] * x[:, None]
            s = np.add.reduceat(v, starts)
            m = model.w0 + np.add.reduceat(model.w[ids] * x, starts) + 0.5 * (s**2 - np.add.reduceat(v * v, starts)).sum(1)
            err = (sigmoid(m) - y[take]) * weight[take] / len(take)
            e = np.repeat(err, n)
            u, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, weights=e * x, minlength=len(u)) + decay * model.w[u]
            dv = (e * x)[:, None] * (np.repeat(s, n, axis=0) - v)
            dv = np.stack([np.bincount(back, weights=dv[:, f], minlength=len(u)) for f in range(RANK)], 1) + decay * model.v[u]
            g0 += err.sum() ** 2
            gw[u] += dw * dw
            gv[u] += dv * dv
            model.w0 -= rate * err.sum() / np.sqrt(g0)
            model.w[u] -= rate * dw / np.sqrt(gw[u])
            model.v[u] -= rate * dv / np.sqrt(gv[u])
    return model


def _train_rows(metadata: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.small_batches(batches):
            data, off = C.string_buffer(b.column("text"))
            made = list(vectors(data, off, [b.column(c).to_pylist() for c in metadata]))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())], ["y", "ids", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), label: str = "quality", sample: int = SAMPLE) -> Machine:
    """labels: doc_id and the label. Rows whose label is null or whose key is null train nothing; a key that is labelled
    more than once counts once, by its largest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    picked = known.orderBy(C.crc_order("doc_id"), "doc_id").limit(sample)  # at most ``sample`` pairs of numbers
    rows = docs.select("doc_id", "text", *metadata).join(F.broadcast(picked), "doc_id")
    got = rows.select("y", "text", *metadata).mapInArrow(_train_rows(metadata), "y double, ids binary, x binary").toArrow()
    vs = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for i, x in zip(got["ids"].to_pylist(), got["x"].to_pylist())]
    y = got["y"].to_numpy()
    order = sorted(range(len(vs)), key=lambda k: (len(vs[k][0]), vs[k][0].tobytes(), vs[k][1].tobytes(), y[k]))  # whatever order the tasks ended in
    return fit_machine([vs[k] for k in order], y[order], width(len(metadata)))


def _score_rows(model_ref, metadata: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_ref.value
        for b in C.small_batches(batches):
            data, off = C.string_buffer(b.column("text"))
            scores, ids, xs = [], [], []
            have = 0

            def flush() -> None:
                if ids:
                    starts = np.concatenate(([0], np.cumsum([len(i) for i in ids])[:-1]))
                    scores.append(sigmoid(model.margins(np.concatenate(ids), np.concatenate(xs), starts)))
                    ids.clear()
                    xs.clear()

            for i, x in vectors(data, off, [b.column(c).to_pylist() for c in metadata]):
                ids.append(i)
                xs.append(x)
                have += len(i)
                if have > 100_000:
                    flush()
                    have = 0
            flush()
            s = np.concatenate(scores) if scores else np.zeros(0)
            keep = [c for c in b.schema.names if c not in ("text__", "score")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    return run


def score(docs: DataFrame, model: Machine, keep: list[str], metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The columns ``keep`` and the score. An own column ``score`` of the input gives way."""
    spark = docs.sparkSession
    ref = spark.sparkContext.broadcast(model)  # 2^16 + a few hundred rows of 5 numbers: fixed
    keep = [c for c in keep if c != "score"]
    names = list(dict.fromkeys([*keep, "text", *metadata]))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes) + ", score double"
    return docs.select(*names).mapInArrow(_score_rows(ref, metadata), schema).select(*keep, "score")


def keep(docs: DataFrame, model: Machine, metadata: tuple[str, ...] = ("n_chars",), least: float = 0.5) -> DataFrame:
    """The rows of docs that score ``least`` or more, with all their columns; one named score keeps its own values."""
    own = {c: f"own__{k}" for k, c in enumerate(docs.columns) if c not in ("text", *metadata)}
    scored = score(docs.withColumnsRenamed(own), model, [own.get(c, c) for c in docs.columns], metadata)
    return scored.where(F.col("score") >= least).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learns from rows outside the held-out third."""
    return fit(docs.where(~C.held_out(F.col("doc_id"))), labels.where(~C.held_out(F.col("doc_id"))))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, C.table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", F.coalesce(C.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
