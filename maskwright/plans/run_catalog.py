"""Queries over ledgers that runs have written: documents go through a whole run, with a detector that fails on some texts, a
retry, and in another run a review with corrections; DuckDB says what must come out."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import review as V
from ..operators import spans as S
from ..sources import records as R
from ..sources.files import shared_folder
from . import run as U
from .catalog import query

_DIGITS = S.Rule("digits", "four digits", "ID", "[0-9]{4}")


def _marker() -> Any:
    """A detector that marks the first "the" of a text, and cannot read texts of some lengths."""

    class Marker:
        def detect(self, text: str) -> list[dict[str, Any]]:
            if len(text) % 97 == 0:
                raise ValueError("cannot read texts of this length")
            at = text.find("the")
            return [{"category": "NAME", "text": "the", "start": at, "end": at + 3, "confidence": 0.9}] if at >= 0 else []

    return Marker


_RUNS: dict[tuple[str, str, bool], U.Run] = {}


def _run(spark: SparkSession, d: str, review: bool = False) -> U.Run:
    """The run over a folder's documents; queries of one session share it."""
    key = (spark.sparkContext.applicationId, d, review)
    if key not in _RUNS:
        source = C.Input(f"{d}/documents.parquet", "doc_id", "text", "source", metadata=("lang", "n_chars"))
        detectors = () if review else (C.DetectorSettings("marker", "model"),)
        config = C.Config(source, output_dir=f"{shared_folder(spark)}/maskwright-runs/{uuid.uuid4().hex}", detectors=detectors, rules=(_DIGITS,), workers=4, review=review, review_all=review)
        run = U.create_run(spark, config, detectors={"marker": _marker()}, clock=lambda: datetime.now(UTC))
        run.execute()
        if review:
            _decide(spark, run)
        else:
            run.retry(stage="detection", failed=True)
        run.execute()
        _RUNS[key] = run
    return _RUNS[key]


def _decide(spark: SparkSession, run: U.Run) -> None:
    """A third of the records is excluded; of the rest those that begin with a letter get it marked by a correction."""
    rows = run.table("records").where("not excluded").select("record_id", "text", F.pmod(F.col("record_id").cast("long"), F.lit(3)).alias("k"), F.substring("text", 1, 1).alias("first"))
    letter = (F.col("k") == 1) & F.col("first").rlike("^[A-Za-z]")
    decisions = rows.select("record_id", F.when(F.col("k") == 0, "excluded").when(letter, "corrected").otherwise("approved_unchanged").alias("disposition"), F.lit("reader").alias("reviewer_id"), F.lit(5).alias("review_seconds"))
    edits = rows.where(letter).select("record_id", F.lit("add").alias("op"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("NAME").alias("category"), F.col("first").alias("text"))
    run.decide(decisions, spark.createDataFrame([], V.SPAN_EDIT).unionByName(edits, allowMissingColumns=True))


_READ = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, doc_id, text, text IS NULL OR regexp_full_match(text, '\\s*') AS blank, length(text) % 97 = 0 AS fails FROM documents)"
_STATUS = "CASE WHEN blank THEN 'excluded' WHEN fails THEN 'failed' ELSE 'ready' END"
_STAGE = """CASE WHEN blank THEN 'excluded' WHEN stage = 'input' THEN 'succeeded' WHEN stage IN ('validation', 'review') THEN 'skipped' WHEN stage = 'export' THEN 'pending'
  WHEN fails THEN CASE WHEN stage = 'detection' THEN 'permanent_error' ELSE 'pending' END ELSE 'succeeded' END"""
_REDACTED = "regexp_replace(text, '[0-9]{4}', '[R_ID]', 'g')"


@query("q97_run_report", f"""WITH {_READ}, stages AS (SELECT unnest(['input', 'detection', 'transformation', 'validation', 'review', 'finalization', 'export']) AS stage)
SELECT 'records' AS section, '' AS stage, {_STATUS} AS status, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'stages', stage, {_STAGE}, count(*) FROM docs, stages GROUP BY ALL""")
def q97(spark, d):
    """The report after a run and a retry, of the ledger's counters alone."""
    got = _run(spark, d).status()
    rows = [("records", "", r["status"], r["n"]) for r in got["records"]["counts"]] + [("stages", r["stage"], r["status"], r["n"]) for r in got["stages"]["records"]]
    return spark.createDataFrame(rows, "section string, stage string, status string, n long")


@query("q98_run_texts", f"WITH {_READ} SELECT record_id, {_STATUS} AS status, CASE WHEN NOT blank AND NOT fails THEN regexp_replace({_REDACTED}, 'the', '[R_NAME]') END AS final_text FROM docs")
def q98(spark, d):
    run = _run(spark, d)
    finals = run.table("renderings").where("kind = 'final' and not is_stale").select("record_id", F.col("rendered").alias("final_text"))
    return run.table("records").select("record_id", "status").join(finals, "record_id", "left")


@query("q99_run_findings", f"""WITH {_READ}, found AS (SELECT record_id, 'llm' AS source_kind, CAST(position('the' IN text) > 0 AS INT) AS n FROM docs WHERE NOT blank AND NOT fails
UNION ALL SELECT record_id, 'rule', len(regexp_extract_all(text, '[0-9]{{4}}')) FROM docs WHERE NOT blank AND NOT fails) SELECT record_id, source_kind, n FROM found WHERE n > 0""")
def q99(spark, d):
    return _run(spark, d).table("findings").where("is_eligible").groupBy("record_id", "source_kind").agg(F.count("*").alias("n"))


@query("q100_run_attempts", f"""WITH {_READ} SELECT record_id, a AS attempt_number, CASE WHEN fails THEN 'permanent_error' ELSE 'succeeded' END AS status, fails AND a = 2 AS is_last_failure
FROM docs, (SELECT unnest([1, 2]) AS a) WHERE NOT blank AND (a = 1 OR fails)""")
def q100(spark, d):
    """A retry calls failed records once more, and no other."""
    rows = _run(spark, d).table("attempts")
    return rows.select("record_id", "attempt_number", "status", ((F.col("attempt_number") == 2) & (F.col("status") == "permanent_error")).alias("is_last_failure"))


@query("q101_run_review", f"""WITH {_READ}, seen AS (SELECT *, doc_id % 3 AS k, regexp_matches(text, '^[A-Za-z]') AS letter FROM docs) SELECT record_id,
CASE WHEN blank OR k = 0 THEN 'excluded' ELSE 'ready' END AS status, CASE WHEN blank THEN NULL WHEN k = 0 THEN 'excluded' WHEN k = 1 AND letter THEN 'corrected' ELSE 'approved_unchanged' END AS disposition,
CASE WHEN blank OR k = 0 THEN NULL WHEN k = 1 AND letter THEN '[R_NAME]' || regexp_replace(substring(text, 2), '[0-9]{{4}}', '[R_ID]', 'g') ELSE {_REDACTED} END AS final_text,
CASE WHEN blank THEN 0 WHEN k = 1 AND letter THEN 2 ELSE 1 END AS draft_plans FROM seen""")
def q101(spark, d):
    """Decisions with corrections on all records, and what the run makes of them."""
    run = _run(spark, d, review=True)
    finals = run.table("renderings").where("kind = 'final' and not is_stale").select("record_id", F.col("rendered").alias("final_text"))
    decided = run.stored("review_decisions").where("is_current").select("record_id", "disposition")
    drafts = run.stored("plans").where("purpose = 'draft'").groupBy("record_id").agg(F.count("*").cast("int").alias("draft_plans"))
    rows = run.table("records").select("record_id", "status").join(decided, "record_id", "left").join(finals, "record_id", "left").join(drafts, "record_id", "left")
    return rows.select("record_id", "status", "disposition", "final_text", F.coalesce("draft_plans", F.lit(0)).alias("draft_plans"))


@query("q102_source_places", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def q102(spark, d):
    """Places by the readers' positions; the table is written in the order of its ids."""
    return R.read_in_order(spark, f"{d}/documents.parquet", "parquet", "place").select("doc_id", "place")
