"""Shared pieces of the training-data operators: tables, the shared scratch folder, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_KEPT: dict[str, None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees: spark.checkpoint.dir, or an own one where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="maskwright-"))
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    _KEPT.pop(path, None)
    with contextlib.suppress(Exception):  # the session may be gone already; the folder is only scratch
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by release(), or else when the driver ends."""
    path = f"{shared_dir(spark)}/maskwright-scratch/{name}-{uuid.uuid4().hex}"
    _KEPT[path] = None
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and lost executors cost nothing above it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote; nothing may read these tables, or what is made of them, any more."""
    for t in tables:
        _remove(t.sparkSession, t.scratch_path)


def kept() -> list[str]:
    """The scratch paths that stand now."""
    return list(_KEPT)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes scratch tables whose readers have been written."""
    for path in paths:
        _remove(spark, path)
    settle(spark)


def settle(spark: SparkSession, *tables: DataFrame) -> None:
    """Drops tables, and lets Spark's cleaner remove the shuffle files of queries that are over: it acts on the driver's
    garbage collection, which a quiet driver may put off until disks are full."""
    drop(*tables)
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def crc_order(*cols: Column) -> Column:
    """A fixed pseudo-random order of rows that depends only on their values."""
    return F.xxhash64(*cols)


# ---- vectorised word hashing over Arrow string buffers ----

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}
STEP = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, STEP + 4096)
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("q", _PINV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _POW[key] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _span_words(b: np.ndarray, cuts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the bytes b with starts and ends; cuts are positions where a word must end. space: which bytes are
    outside words."""
    ok = np.empty(len(b) + 2, bool)
    ok[0] = ok[-1] = False
    np.logical_not(space[b], out=ok[1:-1])
    first = ok[1:-1] & ~ok[:-2]
    last = ok[1:-1] & ~ok[2:]
    inner = cuts[(cuts > 0) & (cuts < len(b))]
    first[inner] |= ok[1:-1][inner]
    last[inner - 1] |= ok[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(b, starts, ends), starts, ends


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each b[start:end] that does not depend on where it stands."""
    p, q = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=s[1:])
        h = (s[ends] - s[starts]) * q[starts] + (ends - starts).astype(np.uint64)
    return mix(h)


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and n + 1 offsets of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def word_chunks(data: np.ndarray, off: np.ndarray, lower: bool = True, space: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, word hashes, n + 1 bounds of each row's words), about STEP bytes at a time.

    A longer text is hashed in parts that end at white space, so memory follows its words, not 64 times its bytes.
    """
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STEP, side="right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= STEP or j > i + 1:
            b = LOWER[data[lo:hi]] if lower else data[lo:hi]
            h, starts, _ = _span_words(b, off[i : j + 1] - lo, space)
            yield i, j, h, np.searchsorted(starts, off[i : j + 1] - lo)
        else:
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + STEP)
                while to < hi and not space[data[to]]:
                    to += 1
                b = LOWER[data[at:to]] if lower else data[at:to]
                parts.append(_span_words(b, np.zeros(0, np.int64), space)[0])
                at = to
            h = np.concatenate(parts)
            yield i, j, h, np.array([0, len(h)])
        i = j


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
