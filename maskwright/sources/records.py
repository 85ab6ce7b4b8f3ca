"""Record sources and sinks: Parquet and JSON lines, previews, canonical records, import summaries, exports."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core as K
from ..operators import text as T

FORMATS = ("parquet", "jsonl")
BUCKETS = 500


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_records(spark: SparkSession, path: str, form: str, directory: bool = True) -> DataFrame:
    """A lazy scan. JSON lines that cannot be read fail the job. Tables are directories on a cluster; where the input is
    one file by contract, ``directory=False`` refuses them."""
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")
    at, fs = _at(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if not directory and fs.getFileStatus(at).isDirectory():
        raise ValueError(f"not a file: {path}")
    return spark.read.parquet(path) if form == "parquet" else spark.read.option("mode", "FAILFAST").json(path)


def read_in_order(spark: SparkSession, path: str, form: str, name: str = "place__") -> DataFrame:
    """read_records with each row's place in its source from 0, files by name: of Parquet by the reader's row index, of JSON
    lines by the split's offset and the rows before it there. Counts of files or splits are the only rows that meet."""
    df = read_records(spark, path, form)
    split, row = (F.lit(0).cast("long"), F.col("_metadata.row_index")) if form == "parquet" else (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = df.select("*", F.col("_metadata.file_path").alias("file__"), split.alias("split__"), row.alias("row__"))
    counts = rows.groupBy("file__", "split__").agg(F.count("*").alias("n"), F.min("row__").alias("first__"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file__", "split__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file__", "split__", (before - F.col("first__")).alias("shift__"))
    return rows.join(starts, ["file__", "split__"]).withColumn(name, F.col("row__") + F.col("shift__")).drop("file__", "split__", "row__", "shift__")


def preview(df: DataFrame, n: int = 20) -> dict:
    """Row count, columns and at most n rows, which is what a preview is."""
    if not 1 <= n <= 100:
        raise ValueError("a preview has 1 to 100 rows")
    return {"count": df.count(), "columns": df.dtypes, "rows": [r.asDict(True) for r in df.limit(n).collect()]}


def guess_columns(columns: list[str]) -> dict[str, str | None]:
    """Which columns may hold record id, entity id and text, by parts of their names; each column once."""
    hints = {"record_id": ("record", "note_id", "doc_id", "document_id", "id"), "entity_id": ("patient", "entity", "subject", "person", "mrn"), "text": ("text", "note", "body", "content")}
    out: dict[str, str | None] = {}
    for part, names in hints.items():
        left = [c for c in columns if c not in out.values()]
        out[part] = next((c for n in names for c in left if n in c.lower() and not (part == "text" and c.lower().endswith("id"))), None)
    return out


def normalize(df: DataFrame, record_id: str, entity_id: str, text: str, metadata: tuple[str, ...] = (), repair: bool = False, order: str | None = None, place: str | None = None) -> DataFrame:
    """Canonical records: ids as stripped text, the text, with ``repair`` mended, and the audit of that, exclusion of blank
    texts, metadata as a JSON object (dates in ISO form, binary as base64), and with ``order`` source_index, the row's
    place by that column from 0; ``place`` is a column that holds the place already. ``check_records`` tests what a row alone cannot show."""
    missing = sorted({record_id, entity_id, text, *metadata} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    raw = F.col(text)
    t = T.repaired(raw) if repair else raw
    kinds = dict(df.dtypes)
    plain = lambda c: F.base64(F.col(c)) if kinds[c] == "binary" else F.col(c).cast("string") if kinds[c] == "date" else F.col(c)
    meta = F.to_json(F.struct(*(plain(c).alias(c) for c in metadata)), {"ignoreNullFields": "false"}) if metadata else F.lit("{}")
    blank = K.is_blank(F.col("text"))
    rows = df.select(K.strip(F.col(record_id).cast("string")).alias("record_id"), K.strip(F.col(entity_id).cast("string")).alias("entity_id"), t.alias("text"), raw.alias("raw_text"), meta.alias("metadata"), *([F.col(order).alias("order__")] if order else [F.col(place).cast("long").alias("source_index")] if place else []))
    out = rows.select(
        "record_id", "entity_id", "text", K.sha256(F.col("text")).alias("text_sha256"), "raw_text", K.sha256(F.col("raw_text")).alias("raw_sha256"), (~F.col("raw_text").eqNullSafe(F.col("text"))).alias("changed"), F.lit(T.REPAIR if repair else "none").alias("repair"),
        blank.alias("excluded"), F.when(blank, "empty_source_text").alias("exclusion_code"), "metadata", *(["order__"] if order else ["source_index"] if place else []),
    )
    return with_source_index(out, "order__").drop("order__") if order else out


def with_source_index(df: DataFrame, order: str) -> DataFrame:
    """Adds source_index, from 0 in the order of a column, nulls first. About ``BUCKETS`` values that a hash picks cut the
    table into buckets; each is numbered by itself, from the rows of those before it, so no task sees all rows and a run
    that is repeated numbers alike. A row for each bucket is collected. Rows of one value share a bucket."""
    key = F.col(order)
    step = max(1, df.count() // BUCKETS)
    bounds = df.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).agg(F.array_sort(F.collect_set(key)).alias("bounds")).scalar()
    rows = df.withColumn("bounds__", bounds).withColumn("bucket__", F.size(F.filter("bounds__", lambda b: b <= key))).drop("bounds__")
    starts, n = [], 0
    for r in sorted(rows.groupBy("bucket__").count().collect()):
        starts += [F.lit(r["bucket__"]), F.lit(n).cast("long")]
        n += r["count"]
    if not starts:
        return df.withColumn("source_index", F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("bucket__").orderBy(key)) - 1
    return rows.withColumn("source_index", F.element_at(F.create_map(*starts), F.col("bucket__")) + within).drop("bucket__")


def check_records(records: DataFrame) -> DataFrame:
    """Raises where there are no records, or where record ids are blank or, once stripped, not unique; entity ids may repeat
    but are not blank. Returns the records."""
    sums = records.agg(F.count("*").alias("n"), K.count_if(K.is_blank(F.col("record_id"))).alias("blank"), K.count_if(K.is_blank(F.col("entity_id"))).alias("blank_entities")).first()
    if not sums["n"]:
        raise ValueError("the input has no rows")
    if sums["blank"] or sums["blank_entities"]:
        raise ValueError(f"blank ids: {sums['blank']} of records, {sums['blank_entities']} of entities")
    twice = repeated_ids(records).limit(5).collect()
    if twice:
        raise ValueError(f"record ids repeat: {', '.join(r['record_id'] for r in twice)}")
    return records


def repeated_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select("record_id")


def import_summary(records: DataFrame) -> DataFrame:
    """One aggregation over canonical records."""
    changed = K.count_if(F.col("changed") & ~F.col("excluded")) if "changed" in records.columns else F.lit(0).cast("long")
    return records.agg(F.count("*").alias("records"), K.count_if(~F.col("excluded")).alias("active"), K.count_if(F.col("excluded")).alias("excluded"), changed.alias("normalized"))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a source, each read in pieces where it is hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sha256=[_sha256(p) for p in frame["path"]])

    return files.repartition("path").mapInPandas(hashed, "path string, bytes long, sha256 string")


def _sha256(path: str) -> str:
    from pyarrow import fs

    at, name = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with at.open_input_stream(name) as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def source_digest(facts: DataFrame) -> DataFrame:
    """One row (files, bytes, digest) of file_facts: equal for equal contents, whatever the files are called."""
    return facts.agg(F.count("*").alias("files"), K.sum_or_zero(F.col("bytes")).alias("bytes"), F.lower(F.hex(F.coalesce(F.sum(F.xxhash64("sha256").cast("decimal(38,0)")), F.lit(0)).cast("string"))).alias("digest"))


def canonical_view(records: DataFrame, errors: DataFrame, with_raw: bool = True) -> DataFrame:
    """The nested view of records: ids, text, the audit of its normalization as a struct, metadata as a map, status, and the
    stage errors as a list of structs in the order of time."""
    per = errors.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "stage", "error_code", "message"))).alias("stage_errors"))
    audit = F.struct("changed", "raw_sha256", F.col("text_sha256").alias("normalized_sha256"), F.col("repair").alias("version"))
    none = F.array().cast("array<struct<created_at:timestamp,stage:string,error_code:string,message:string>>")
    raw = [F.col("raw_text").alias("raw_source_text")] if with_raw else []
    return records.join(per, "record_id", "left").select(
        "record_id", "entity_id", *raw, F.col("text").alias("source_text"), audit.alias("text_normalization"), F.from_json("metadata", "map<string,string>").alias("metadata"), F.col("status").alias("pipeline_status"), F.coalesce("stage_errors", none).alias("stage_errors")
    )


def input_records(records: DataFrame, states: DataFrame) -> DataFrame:
    """records with the status of their input stage, in source order."""
    return records.join(states.where("stage = 'input'").select("record_id", F.col("status").alias("input_status")), "record_id").orderBy("source_index")


CORE_COLUMNS = ("record_id", "entity_id", "input_row_number", "deid_status", "final_text", "raw_source_text", "normalized_text")


def export_columns(selected: list[str], metadata: tuple[str, ...], structured: tuple[str, ...] = (), mode: str = "ready_only") -> dict[str, Column]:
    """An expression for each selected column, over rows of records joined to their final text. Names are core columns,
    ``metadata.<name>``, bare metadata names, which read the final metadata, and ``raw_<name>`` of structured fields,
    which read the original. Unknown names, and metadata names that are core columns' too, are refused; all_records
    adds deid_status."""
    if mode not in ("ready_only", "all_records"):
        raise ValueError(f"no such mode: {mode}")
    if not selected or len(set(selected)) < len(selected):
        raise ValueError("export columns are given once each, and there are some")
    raw = {f"raw_{c}" for c in structured}
    unknown = [c for c in selected if not (c in CORE_COLUMNS or c in raw or c in metadata or (c.startswith("metadata.") and c[9:] in metadata))]
    if unknown:
        raise ValueError(f"unknown export columns: {', '.join(unknown)}")
    double = sorted(set(metadata) & set(CORE_COLUMNS) & set(selected))
    if double:
        raise ValueError(f"metadata columns named like core columns need metadata.<name>: {', '.join(double)}")
    wanted = list(selected) + (["deid_status"] if mode == "all_records" and "deid_status" not in selected else [])
    core = {"input_row_number": F.col("source_index") + 1, "deid_status": F.col("status"), "raw_source_text": F.col("raw_text"), "normalized_text": F.col("text")}
    field = lambda doc, name: F.try_element_at(F.from_json(doc, "map<string,string>"), F.lit(name))
    final = F.coalesce("final_metadata", "metadata")
    one = lambda c: core.get(c, F.col(c)) if c in CORE_COLUMNS else field(F.col("metadata"), c[4:]) if c in raw else field(final, c.removeprefix("metadata."))
    return {c: one(c) for c in wanted}


def export_rows(records: DataFrame, renderings: DataFrame, columns: dict[str, Column], mode: str = "ready_only") -> DataFrame:
    """The selected columns of records, all or those that are ready, left-joined to their final rendering, in source order."""
    rows = records.where("status = 'ready'") if mode == "ready_only" else records
    texts = renderings.select(F.col("rendering_id").alias("final_rendering_id"), F.col("rendered").alias("final_text"))
    return rows.join(texts, "final_rendering_id", "left").orderBy("source_index").select(*(x.alias(c) for c, x in columns.items()))


def write_records(df: DataFrame, path: str, form: str, single: bool = False) -> str:
    """Writes beside the target and renames, so that a reader sees all or nothing. Without rows the columns are strings.
    ``single`` writes one part file, for exports that one reader can hold."""
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")
    part = f"{path}.{uuid.uuid4().hex}.part"
    if df.isEmpty():
        df = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    out = df.coalesce(1) if single else df
    out.write.parquet(part) if form == "parquet" else out.write.option("ignoreNullFields", "false").json(part)
    at, fs = _at(df.sparkSession, path)
    fs.delete(at, True)
    if not fs.rename(_at(df.sparkSession, part)[0], at):
        raise OSError(f"cannot rename to {path}")
    return path
