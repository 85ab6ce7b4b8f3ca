"""Media columns: content-addressed payloads in tar shards, and metadata from header-only range reads.

A payload is stored as a PNG image of 8-bit grey samples, 64 to a line, which is lossless. Each task appends the
payloads of its rows to tar shards in a shared folder, one member for each digest that it meets, named after the digest;
rows carry digest, shard, offset and length. Metadata (width, height, depth) come from range reads of the first bytes
of a member. A shard is named after the task's attempt and appears only when it is whole; rows point into the shards of
their own attempt, so a task that runs again after an executor is lost cannot replace what other rows point into,
whatever order its rows come in. What a lost attempt wrote is pointed to by nothing. The same digest may stand in the
shards of several tasks; any of them serves.

Cases: null and empty texts are one block of zeros; repeated rows share a member within a task and agree in every value
that comes from the content; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK = 64
SHARD_BYTES = 256_000_000
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG image, a multiple of 64 samples in lines of 64."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    filtered = np.zeros((len(lines), BLOCK + 1), np.uint8)  # filter 0 before each line
    filtered[:, 1:] = lines
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", BLOCK, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from an image's first HEADER_BYTES bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not a whole image header")
    return struct.unpack(">IIB", first[16:25])


def decode(image: bytes) -> bytes:
    """The samples of an image of ``encode``; every part's checksum is tested."""
    width, height, _ = header(image[:HEADER_BYTES])
    at, body = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered image")
    return lines[:, 1:].tobytes()


def pad(data: bytes) -> bytes:
    return data + bytes(BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)


class Shard:
    """A tar file that grows by members and takes its name when it is closed."""

    def __init__(self, uri: str, name: str):
        self.fs, root = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}"
        self.out, self.at = self.fs.open_output_stream(self.part), 0

    def add(self, name: str, data: bytes) -> tuple[int, int]:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + (-len(data) % 512)
        return offset, len(data)

    def close(self) -> str:
        self.out.write(bytes(1024))
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.path


ROW = "digest string, shard string, offset long, length long, n_bytes long, payload_bytes long"
READ = "width int, height int, bits int, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(f: pa.NativeFile, offset: int, length: int) -> tuple:
    width, height, bits = header(f.read_at(HEADER_BYTES, offset))
    image = f.read_at(length, offset)
    payload = decode(image)
    mean = np.frombuffer(payload, np.uint8).mean()
    return width, height, bits, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(image), hashlib.sha256(image).hexdigest(), f"png {width}x{height} gray{bits} mean={mean:.4f}"


def _store(uri: str, keep: list[str], shard_bytes: int):
    types = dict(x.split() for x in f"{ROW}, {READ}".split(", "))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, shard = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, None
        places: dict[str, tuple] = {}  # digest to shard name, offset, length, of the open shard
        waiting: list[tuple[pa.RecordBatch, list[tuple]]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, count
            if shard:
                path = shard.close()
                with shard.fs.open_input_file(path) as f:
                    seen = {d: _read_back(f, o, n) for d, (_, o, n) in places.items()}
                for batch, rows in waiting:
                    cols = list(zip(*((d, *places[d], n, p, *seen[d]) for d, n, p in rows)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, kinds[t]) for x, t in zip(cols, types.values()))], [*keep, *types])
                shard, count = None, count + 1
                waiting.clear()
                places.clear()

        for batch in C.small_batches(batches):
            data, off = C.string_buffer(batch.column("text"))
            rows = []
            for k in range(batch.num_rows):
                payload = pad(text := data[off[k] : off[k + 1]].tobytes())
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    shard = shard or Shard(uri, f"shard-{part}-{count:04d}.tar")
                    places[digest] = (f"shard-{part}-{count:04d}.tar", *shard.add(f"{digest}.png", encode(payload)))
                rows.append((digest, len(text), len(payload)))
            waiting.append((batch.select(keep), rows))
            if shard and shard.at >= shard_bytes:
                yield from flush()
        yield from flush()

    return run


def store(docs: DataFrame, uri: str, keep: list[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns ``keep`` with each text's place in the shards under ``uri`` and what reading it back showed. Columns
    of an output's name give way."""
    out = [x.split()[0] for x in f"{ROW}, {READ}".split(", ")]
    keep = [c for c in keep if c not in out]
    names = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), ROW, READ])
    return docs.select(*names).mapInArrow(_store(uri, keep, shard_bytes), schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(C.table(spark, sf_dir, "documents"), C.scratch(spark, "media"), ["doc_id"])
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
