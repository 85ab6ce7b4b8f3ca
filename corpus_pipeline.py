"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. run() applies them to documents, writing each stage's rows to the shared folder before the next.

A stage begins when the rows of the one before are written, so it first removes the scratch tables that stages before it
left in the shared folder. Cases, in every stage: an empty table gives no rows; columns of any other name are kept as
they are (packing returns its own); each stage states nulls, ties and repeated rows.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import common as C
from maskwright.llm import mixing, ngram_join, packing, quality, secret_scan


#: What the last stage of a session left.
_SCRATCH: dict[str, list[str]] = {}


def _stage(stage):
    """Removes what earlier stages left, and notes what this one leaves."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = f"{spark.sparkContext.applicationId} {id(spark._jsparkSession)} {sf_dir}"
        C.release(spark, _SCRATCH.pop(key, []))
        before = set(C.kept())
        out = stage(spark, docs, sf_dir)
        _SCRATCH[key] = [p for p in C.kept() if p not in before]
        return out

    return run


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go. Labels come from the table, texts from docs.
    A null or empty text is scored like any other; equal rows have equal scores and stay or go together; a score of
    exactly 0.5 stays."""
    model = quality.learn(docs, C.table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by five-word n-gram sets of similarity 0.8 or more, the one with the smallest doc_id stays.
    Null, empty and blank texts are nobody's copies and stay; of equal doc_ids the smallest text stays, null ids come last;
    of equal rows one stays."""
    return ngram_join.keep_one(docs, 5, ngram_join.Threshold(80, 100)).select(*docs.columns)


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows the text where one was found. All rows stay; a null text stays null; equal
    texts change alike; of overlapping secrets the whole run is one mark."""
    return secret_scan.redacted(docs, secret_scan.train(docs))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for, 0 to 3. A null source is a source of its own; texts
    without words stay once; equal rows are separate documents; ties go by a hash of the row."""
    return mixing.mix_rows(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4096 tokens. A null or empty text is the end id alone; equal rows are
    packed as often as they come; pieces of one length are ordered by their values."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tries, Markov models, Newton iterations and branch and bound are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents. Of the stages' tables only the one that the last reads stays."""
    docs, last = C.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = C.written(docs, f"stage{k}")
            if last is not None:
                C.drop(last)
            last = docs
    return docs
