"""Language ID by compression: the language whose zstandard raw-content dictionary makes the text smallest wins.

A dictionary is made of at most ``TRAIN_BLOCKS`` blocks of ``TRAIN_BLOCK`` characters, chosen by hash among all blocks of
the whole texts of at most ``TRAIN_TEXTS`` training rows of its language, themselves chosen by a hash of the key. Whole
texts are encoded, in blocks of ``BLOCK`` bytes, so that the dictionary speaks for every block of a long text alike. A
narrow margin between the two smallest sizes is a rejection.

Cases: null and empty texts and texts without a letter are ``und`` with score 0; so is every text if nothing was
learned; ties go to the language that sorts first; repeated rows get the same answer; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

TRAIN_TEXTS = 400
TRAIN_BLOCKS = 96
TRAIN_BLOCK = 1_000
BLOCK = 2_048
LEVEL = 6
MARGIN = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[^a-z]+")


def letters(text: str) -> str:
    """Lower-case runs of letters and the marks on them, one space between them: shouting, digits and signs say nothing of
    the language. Texts without a letter are empty."""
    text = text.lower()
    if text.isascii():
        return _OTHER.sub(" ", text).strip()
    import regex

    if not any(map(str.isalpha, text)):
        return ""
    return regex.sub(r"[^\p{L}\p{M}]+", " ", text).strip()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of whole texts in blocks: lang, doc_id, block, text."""
    for b in C.small_batches(batches):
        out: tuple[list, list, list, list] = ([], [], [], [])
        for lang, doc, text in zip(b.column("lang").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            text = letters(text)
            for k, at in enumerate(range(0, len(text), TRAIN_BLOCK)):
                for col, x in zip(out, (lang, doc, k, text[at : at + TRAIN_BLOCK])):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["lang", "doc_id", "block", "text"])


def _first(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The n rows of each language with the smallest hashes of ``key``: first of each of 64 parts, so that a hot language is
    no single task, then of those."""
    at = rows.withColumn("at", F.xxhash64(*key))
    part = Window.partitionBy("lang", F.pmod(F.col("at"), F.lit(64))).orderBy("at", *key)
    whole = Window.partitionBy("lang").orderBy("at", *key)
    few = at.withColumn("k", F.row_number().over(part)).where(F.col("k") <= n).drop("k")
    return few.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= n)


def dictionaries(docs: DataFrame, texts: int = TRAIN_TEXTS, blocks: int = TRAIN_BLOCKS) -> dict[str, bytes]:
    """Raw-content dictionaries by language; about 100 kB a language reach the driver."""
    keys = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "doc_id").distinct()
    picked = _first(keys, texts, "doc_id", "lang").select("lang", "doc_id")
    rows = docs.select("lang", "doc_id", "text").where(F.length("text") > 0).join(F.broadcast(picked), ["lang", "doc_id"])
    cut = rows.mapInArrow(_blocks, "lang string, doc_id long, block long, text string")
    got = _first(cut.distinct(), blocks, "doc_id", "block", "text").select("lang", "k", "text").collect()  # ``blocks`` rows a language
    out: dict[str, bytes] = {}
    for lang in sorted({r["lang"] for r in got}):
        out[lang] = b"\n".join(r["text"].encode() for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["k"]))
    return out


class Classifier:
    def __init__(self, dicts: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.langs = sorted(dicts)
        self.encoders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def classify(self, text: bytes) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        text = letters(text.decode()).encode()
        if not self.langs or not text:
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        sizes = self.sizes(text)
        a, b = sorted(sizes)[:2]
        margin = (b - a) / b
        return self.langs[sizes.index(a)], 0.5 + 0.5 * margin / (margin + 0.05), margin < MARGIN


def _predict(dicts: dict[str, bytes], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dicts)
        for b in C.small_batches(batches):
            data, off = C.string_buffer(b.column("text"))
            got = [classifier.classify(data[off[k] : off[k + 1]].tobytes()) for k in range(b.num_rows)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, dicts: dict[str, bytes], keep: list[str]) -> DataFrame:
    """Adds lang_pred, score and rejected to the columns ``keep``; columns of these names give way."""
    keep = [c for c in keep if c not in ("text", "lang_pred", "score", "rejected")]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", lang_pred string, score double, rejected boolean"
    return docs.select(*keep, "text").mapInArrow(_predict(dicts, keep), schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    dicts = dictionaries(docs.where(~C.held_out(F.col("doc_id"))))
    return predict(docs, dicts, ["doc_id"]).select("doc_id", F.coalesce(C.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
