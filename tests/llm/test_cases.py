"""Empty tables, and plain versions beside the operators that models make up."""

import math
import re

import numpy as np
import pytest

from maskwright.llm import chat, langid, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn int, role string, text string"


def test_an_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_chat_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat.op4_chat(spark, str(tmp_path)).count() == 0


def test_the_smallest_encoding_wins(spark):
    """The query's languages against every encoder run by hand, block by block."""
    import zstandard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dicts = langid.dictionaries(docs.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.op9_language(spark, sf).collect()}
    for r in docs.collect():
        text = " ".join(re.findall(r"[^\W\d_]+", (r["text"] or "").lower())).encode()
        if not text:
            assert got[r["doc_id"]] == langid.UNKNOWN
            continue
        sizes = {}
        for lang, data in dicts.items():
            sizes[lang] = 0
            for at in range(0, len(text), langid.BLOCK):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes[lang] += len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[at : at + langid.BLOCK]))
        if re.fullmatch(rb"[a-z ]*", text):  # marks on letters are read by another pattern
            assert got[r["doc_id"]] == min(sizes, key=lambda k: (sizes[k], k))


def test_quality_scores_equal_all_pairs(spark):
    """Whole scores of the operator against the sum over pairs of features, one by one."""
    import pyarrow as pa

    from maskwright.llm import common as C

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    rows = docs.orderBy("doc_id").limit(25).collect() + [(None, None), (None, "")]
    got = quality.score(docs.limit(0).unionByName(spark.createDataFrame([(k, r[1] if k >= 25 else r["text"], None, None, None if k >= 25 else r["n_chars"]) for k, r in enumerate(rows)], DOCS), allowMissingColumns=True), model, ["doc_id"])
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    for k, r in enumerate(rows):
        text, size = (r[1], None) if k >= 25 else (r["text"], r["n_chars"])
        data, off = C.string_buffer(pa.array([text], pa.string()))
        ((ids, x),) = quality.vectors(data, off, [[size]])
        margin = model.w0 + sum(model.w[i] * a for i, a in zip(ids, x))
        v = model.v[ids] * x[:, None]
        pairs = np.triu(v @ v.T, 1).sum() if len(ids) < 3000 else None
        if pairs is not None:
            assert scores[k] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, margin + pairs)))), rel=1e-6, abs=1e-9)
