"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over the 67 characters of tokens, with a start state, give a token the log-likelihood ratio
sum log P_random(c | previous) / P_ordinary(c | previous). A token of ``SHORTEST`` characters or more is a secret if the
ratio a character exceeds a threshold for its length, fitted to labelled samples: short tokens need more. The samples
are random strings over usual alphabets by a seeded generator, and ordinary identifiers: at most ``WORDS`` different
words of the whole texts of at most ``SAMPLE`` rows, both chosen by hash, and a few usual parts of identifiers, alone and
joined in the usual styles, and numbers.

Spans count code points, ends exclusive. The patterns' spans always stay; a token adds one only where it meets none.
Cases: null and empty texts have no spans; repeated rows get the same spans; of spans that start alike the kinds come in
the order of KINDS; without training rows the usual parts alone train; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "markov")
SAMPLE = 300
WORDS = 8_000
LEARNED = 2_000
SHORTEST = 12
#: Where classes of lengths begin; each has a threshold.
LENGTHS = (12, 16, 20, 28, 40)
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # a run of 32 or more is exactly a leftmost match of that length
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[_c] = _i + 1
_STATES = len(_ALPHABET) + 1


class Markov:
    """log P(character | previous) with added counts; state 0 stands before a token."""

    def __init__(self, samples: list[bytes], added: float = 0.5):
        counts = np.full((_STATES, _STATES), added)
        for s in samples:
            c = _CODE[np.frombuffer(s, np.uint8)]
            np.add.at(counts, (np.concatenate(([0], c[:-1])), c), 1)
        self.log = np.log(counts / counts[:, 1:].sum(1, keepdims=True))


class Detector:
    """The log-likelihood ratio a character of tokens, and the thresholds fitted to the samples."""

    def __init__(self, random: list[bytes], ordinary: list[bytes], least: float = 0.5):
        self.ratio = Markov(random).log - Markov(ordinary).log
        scores, sizes = self.scores(ordinary), np.array([len(s) for s in ordinary])
        high = [float(scores[(sizes >= a) & (sizes < b)].max(initial=-1.0)) for a, b in zip(LENGTHS, [*LENGTHS[1:], 1 << 40])]
        # a longer token never needs more than a shorter one
        self.thresholds = np.maximum(least, np.maximum.accumulate(high[::-1])[::-1] + 0.05)

    def scores(self, tokens: list[bytes]) -> np.ndarray:
        """The ratio a character of each token; none is empty."""
        if not tokens:
            return np.zeros(0)
        n = np.array([len(t) for t in tokens])
        c = _CODE[np.frombuffer(b"".join(tokens), np.uint8)]
        starts = np.cumsum(n) - n
        before = np.concatenate(([0], c[:-1]))
        before[starts] = 0
        return np.add.reduceat(self.ratio[before, c], starts) / n

    def secret(self, tokens: list[bytes]) -> np.ndarray:
        at = np.searchsorted(LENGTHS, [len(t) for t in tokens], side="right") - 1
        return (at >= 0) & (self.scores(tokens) > self.thresholds[np.maximum(at, 0)])

    def is_secret(self, token: bytes) -> bool:
        return bool(token) and bool(self.secret([token])[0])


#: Parts of identifiers that prose may lack.
USUAL = (
    "value name index count item total user config default status error message request response server client session account backup archive version release update delete insert select create table "
    "column record number string object array buffer stream input output result handler manager service factory module package library function method class interface implementation "
    "international application environment development production temporary directory document template language character parameter argument attribute element container position"
).split()


def random_samples(n: int = 6_000, seed: int = 11) -> list[bytes]:
    rng = np.random.default_rng(seed)
    lower, upper, digits = _ALPHABET[26:52], _ALPHABET[:26], _ALPHABET[52:62]
    kinds = [digits + b"abcdef", digits + b"ABCDEF", upper + digits, lower + digits, upper + lower + digits, upper + lower + digits + b"+/", upper + lower + digits + b"_-"]
    return [bytes(np.frombuffer(k := kinds[i % len(kinds)], np.uint8)[rng.integers(0, len(k), rng.integers(SHORTEST, 64))]) for i in range(n)]


def ordinary_samples(words: list[str], n: int = 16_000, seed: int = 12) -> list[bytes]:
    """Identifiers from words, alone and joined, and numbers."""
    rng = np.random.default_rng(seed)
    known = sorted({*words, *USUAL})
    out = [w.encode() for w in known]
    for i in range(n):
        w = [known[k] for k in rng.integers(0, len(known), rng.integers(2, 5))]
        style = i % 10
        if style == 0:
            s = "_".join(w).lower()
        elif style == 1:
            s = w[0].lower() + "".join(x.title() for x in w[1:])
        elif style == 2:
            s = "-".join(w).lower()
        elif style == 3:
            s = "_".join(w).upper()
        elif style == 4:
            s = "/".join(w)
        elif style == 5:
            s = "".join(x.title() for x in w)
        elif style == 6:
            s = f"{'_'.join(w)}_{rng.integers(1, 3000)}"
        elif style == 7:
            s = f"{'-'.join(w).lower()}-{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
        elif style == 8:
            s = "".join(map(str, rng.integers(0, 10, rng.integers(6, 24))))
        else:
            s = "-".join("".join(map(str, rng.integers(0, 10, rng.integers(2, 6)))) for _ in range(4))
        out.append(s.encode())
    return out


def labelled_samples(docs: DataFrame, most: int = LEARNED) -> list[bytes]:
    """At most ``most`` different secrets that the patterns find in all texts, chosen by hash: values of assignments, access
    keys and hex runs of a token's letters that mix letters and digits, as plain words are assigned too."""
    text = F.col("text")
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p.pattern.decode()), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))))
    values = docs.where(F.length("text") >= SHORTEST).select(F.explode(found).alias("w")).where(F.col("w").rlike(f"^[A-Za-z0-9+/_=-]{{{SHORTEST},}}$") & F.col("w").rlike("[0-9]") & F.col("w").rlike("[A-Za-z]"))
    return [r["w"].encode() for r in values.distinct().orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def train(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Detector:
    """Random strings are generated ones and the secrets that the patterns find in the texts. Ordinary words come from the
    whole texts of at most ``sample`` rows, without what the patterns find; rows, words and secrets are chosen by hash, so
    a bounded number of short strings reaches the driver."""
    picked = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(C.crc_order("doc_id"), "doc_id").limit(sample)  # keys alone
    rows = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(picked), "doc_id")
    text = F.col("text")
    for p in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, p.pattern.decode(), " ")
    known = rows.select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).distinct()
    got = known.orderBy(F.xxhash64("w"), "w").limit(words).collect()
    return Detector(random_samples() + labelled_samples(docs), ordinary_samples([r["w"] for r in got]))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in bytes, by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _free(text: bytes, base: list[tuple[int, int, int]]) -> list[re.Match]:
    """Tokens that meet no base span. Both come by start, so one pass does."""
    edges = sorted((a, b) for a, b, _ in base)
    out, k, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while k < len(edges) and edges[k][0] < m.end():
            reach = max(reach, edges[k][1])
            k += 1
        if reach <= m.start():
            out.append(m)
    return out


def spans_of(texts: list[bytes], detector: Detector) -> list[tuple[list, list]]:
    """For each text (the patterns' spans, all spans) in code points. All tokens of the batch are scored at once."""
    bases = [base_spans(t) for t in texts]
    free = [_free(t, b) for t, b in zip(texts, bases)]
    hit = iter(detector.secret([m[0] for f in free for m in f]))
    out = []
    for text, base, tokens in zip(texts, bases, free):
        more = [(m.start(), m.end(), 3) for m in tokens if next(hit)]
        if not base and not more:
            out.append(([], []))
            continue
        shift = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        points = lambda spans, shift=shift: [(int(shift[a]), int(shift[b]), k) for a, b, k in spans]
        out.append((points(base), points(sorted(base + more, key=lambda s: (s[0], s[2])))))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(ref, keep: list[str], clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = ref.value
        for b in C.small_batches(batches):
            data, off = C.string_buffer(b.column("text"))
            rows, texts = [], []
            valid = b.column("text").is_valid().to_pylist()
            whole = [data[off[k] : off[k + 1]].tobytes() for k in range(b.num_rows)]
            for k, (text, (base, spans)) in enumerate(zip(whole, spans_of(whole, detector))):
                rows.append((*(sum(s[2] == i for s in base) for i in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                if clean:
                    texts.append((redact(text.decode(), spans) if spans else text.decode()) if valid[k] else None)
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if clean:
                cols.append(pa.array(texts, pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *names])

    return run


def scan(docs: DataFrame, detector: Detector, keep: list[str], clean: bool = False) -> DataFrame:
    """The columns ``keep`` with counts and spans, and with clean the redacted text as clean_text (null stays null).
    Columns of an output's name give way."""
    out = [x.split()[0] for x in FOUND.split(", ")] + ["clean_text"] * clean
    keep = [c for c in keep if c not in out]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), FOUND, *["clean_text string"] * clean])
    ref = docs.sparkSession.sparkContext.broadcast(detector)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scan(ref, keep, clean), schema)


def redacted(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs with secrets in text replaced and n_chars, if it is there, counted anew where one was; all other columns stay,
    also those named like an output of ``scan``."""
    own = {c: f"own__{k}" for k, c in enumerate(docs.columns) if c != "text"}
    found = scan(docs.withColumnsRenamed(own), detector, list(own.values()), clean=True)
    text = F.col("clean_text")
    changed = {"text": text}
    if "n_chars" in own:
        changed["n_chars"] = F.when(F.length("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return found.select(*((changed[c] if c in changed else F.col(own[c])).alias(c) for c in docs.columns))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return scan(docs, train(docs), ["doc_id"])
