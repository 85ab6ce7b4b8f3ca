"""The ledger's states: first ones, latest versions, rollups, the earliest failure, the gate before finalization, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as K


def initial_states(records: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Seven rows a record (record_id, excluded): excluded everywhere, succeeded at input, else pending or skipped. The
    stages are an array of fixed length, so nothing is shuffled."""
    stage = F.col("stage")
    status = F.when(F.col("excluded"), "excluded").when(stage == "input", "succeeded").when(stage.isin(*skipped) if skipped else F.lit(False), "skipped").otherwise("pending")
    return records.select("record_id", "excluded", F.explode(F.array(*map(F.lit, K.STAGES))).alias("stage")).select("record_id", "stage", status.alias("status"))


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest version of each key of an append-only table."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_candidates(rows: DataFrame, keys: list[str], confidence: str, ordinal: str) -> DataFrame:
    """For each key the most confident row; of equal ones the first."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(confidence, F.lit(-1.0)).desc(), ordinal)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def record_status(work: DataFrame) -> DataFrame:
    """(record_id, status) of work items (record_id, status): all succeeded, else retry_pending before permanent_error
    before retry_exhausted."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    all_done = F.min((F.col("status") == "succeeded").cast("int")) == 1
    return work.groupBy("record_id").agg(F.when(all_done, "succeeded").when(has("retry_pending"), "retry_pending").when(has("permanent_error"), "permanent_error").otherwise("retry_exhausted").alias("status"))


def stage_rollup(states: DataFrame) -> DataFrame:
    """(stage, status) of states (record_id, stage, status)."""
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("int"))
    active = F.sum((~F.col("status").isin("excluded", "skipped")).cast("int"))
    status = F.when(active == 0, "skipped").when(n("succeeded") == active, "completed").when(n("retry_exhausted", "permanent_error", "blocked") > 0, "completed_with_errors").otherwise("blocked")
    return states.groupBy("stage").agg(status.alias("status"))


def run_rollup(records: DataFrame, finalization: str = "completed") -> DataFrame:
    """One row: the run's status from records (status): awaiting_review, else completed_with_errors if any failed or
    the finalization stage ended so, else completed if any is ready or all, of at least one, are excluded, else blocked."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0))
    return records.agg(F.when(n("awaiting_review") > 0, "awaiting_review").when((n("failed") > 0) | F.lit(finalization == "completed_with_errors"), "completed_with_errors").when((n("ready") > 0) | ((n("excluded") == F.count("*")) & (F.count("*") > 0)), "completed").otherwise("blocked").alias("status"))


def retry_targets(states: DataFrame) -> DataFrame:
    """(record_id, stage): the earliest failing stage of each record."""
    place = F.array_position(F.array(*map(F.lit, K.STAGES)), F.col("stage"))
    return states.where(F.col("status").isin("retry_exhausted", "permanent_error")).groupBy("record_id").agg(F.min_by("stage", place).alias("stage"))


def finalization_gate(rows: DataFrame, validation: bool = True, review_all: bool = False) -> DataFrame:
    """Adds may_finalize: transformed, disposition, violation decide."""
    approved = F.col("disposition") == "approved_unchanged"
    if validation:
        rest = F.col("violation").isNotNull() & F.when(F.col("violation") | F.lit(review_all), F.coalesce(approved, F.lit(False))).otherwise(True)
    else:
        rest = F.coalesce(approved, F.lit(False)) if review_all else F.lit(True)
    ok = F.when(F.col("disposition") == "corrected", True).when(F.col("disposition") == "excluded", False).otherwise(rest)
    return rows.withColumn("may_finalize", F.col("transformed") & ok)


def reusable(work: DataFrame, records: DataFrame, backends: DataFrame) -> DataFrame:
    """(reusable): whether exactly the pairs of all records and backends have nothing but successes. Counting pairs on
    both sides stands for the set comparison, so no product of the two is made."""
    pairs = work.groupBy("record_id", "backend").agg(F.min((F.col("status") == "succeeded").cast("int")).alias("ok")).where("ok = 1")
    known = pairs.join(records.select("record_id").distinct(), "record_id", "left_semi").join(F.broadcast(backends.select("backend").distinct()), "backend", "left_semi")
    have = pairs.agg(F.count("*").alias("all")).crossJoin(known.agg(F.count("*").alias("known")))
    want = records.agg(F.countDistinct("record_id").alias("r")).crossJoin(backends.agg(F.countDistinct("backend").alias("b")))
    return have.crossJoin(want).select(((F.col("all") == F.col("known")) & (F.col("known") == F.col("r") * F.col("b"))).alias("reusable"))
