"""The report's queries over ledger tables. Each is one DataFrame; orders are columns, so that callers may sort or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as K


def ordered_counts(rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """(column, n, place): counts by value in a fixed order, unknown values last by name; absent ones are absent."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("place", K.place_in(F.col(column), order)).orderBy("place", column)


def record_counts(records: DataFrame) -> DataFrame:
    return ordered_counts(records, "status", K.RECORD_STATUSES)


def stage_rows(stages: DataFrame, reused: tuple[str, ...] = ()) -> DataFrame:
    """stages (stage, status) with where their result comes from, in order."""
    s = F.col("status")
    source = F.when(F.col("stage").isin(*reused) if reused else F.lit(False), "reused_from_parent").when(s == "skipped", "skipped").when(s.isin("completed", "completed_with_errors"), "completed_in_this_run").otherwise("scheduled_in_this_run")
    return stages.withColumn("provenance", source).orderBy(K.place_in(F.col("stage"), K.STAGES), "stage")


def stage_matrix(states: DataFrame) -> DataFrame:
    """(stage, status, n) in the order of stages, then of statuses."""
    counts = states.groupBy("stage", "status").agg(F.count("*").alias("n"))
    return counts.orderBy(K.place_in(F.col("stage"), K.STAGES), "stage", K.place_in(F.col("status"), K.STATE_STATUSES), "status")


def finding_counts(findings: DataFrame) -> DataFrame:
    """By source kind and category: all findings, eligible ones, and different records among those."""
    counts = findings.groupBy("source_kind", "category").agg(F.count("*").alias("raw_count"), K.count_if(F.col("is_eligible")).alias("active_span_count"), F.countDistinct(F.when(F.col("is_eligible"), F.col("record_id"))).alias("active_record_count"))
    return counts.orderBy(K.place_in(F.col("source_kind"), K.SOURCE_KINDS), "source_kind", K.place_in(F.col("category"), K.CATEGORIES), "category")


def validation_totals(results: DataFrame, found: DataFrame) -> DataFrame:
    """One row over current results (validation_id, status, raw_violation, effective_violation, is_stale) and their
    findings (validation_id, ignored_by_policy)."""
    current = results.where("not is_stale")
    ignored = found.where("ignored_by_policy").join(current.select("validation_id"), "validation_id", "left_semi").agg(F.count("*").alias("ignored_findings"))
    is_ = lambda s: K.count_if(F.coalesce(F.col("status") == s, F.lit(False)))
    totals = current.agg(is_("succeeded").alias("completed"), K.count_if(F.col("raw_violation")).alias("raw_violations"), K.count_if(F.col("effective_violation")).alias("effective_violations"), is_("technical_error").alias("technical_errors"), is_("truncated").alias("truncated"))
    return totals.join(F.broadcast(ignored))  # one row each


def current_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.where("is_current and not is_stale")


def disposition_counts(decisions: DataFrame) -> DataFrame:
    return ordered_counts(current_decisions(decisions), "disposition", K.DISPOSITIONS)


def review_seconds(decisions: DataFrame) -> DataFrame:
    """(reviewed, review_seconds, average_seconds): the average to one place, half to even, 0 without decisions."""
    sums = current_decisions(decisions).agg(F.count("*").alias("reviewed"), K.sum_or_zero(F.col("review_seconds")).alias("review_seconds"))
    return sums.withColumn("average_seconds", F.when(F.col("reviewed") > 0, F.bround(F.col("review_seconds") / F.col("reviewed"), 1)).otherwise(0.0))


def reviewer_counts(decisions: DataFrame) -> DataFrame:
    """Current decisions by reviewer and disposition, with their seconds."""
    return current_decisions(decisions).groupBy("reviewer_id", "disposition").agg(F.count("*").alias("n"), K.sum_or_zero(F.col("review_seconds")).alias("review_seconds")).orderBy("reviewer_id", "disposition")


def review_records(decisions: DataFrame, records: DataFrame) -> DataFrame:
    met = current_decisions(decisions).join(records.select("record_id", "entity_id", "source_index"), "record_id")
    return met.select("record_id", "entity_id", "source_index", "disposition", "reviewer_id", "review_seconds", "created_at", "decision_id").orderBy("source_index", "created_at", "decision_id")


def structured_counts(events: DataFrame, plans: DataFrame) -> DataFrame:
    """Structured events of active plans by column, category and purpose."""
    active = plans.where("status = 'active'").select("record_id", "plan_revision")
    return events.join(active, ["record_id", "plan_revision"]).groupBy("column_name", "category", "purpose").agg(F.count("*").alias("n")).orderBy("column_name", "purpose", "category")


def attempt_counts(attempts: DataFrame) -> DataFrame:
    return ordered_counts(attempts, "status", K.ATTEMPT_STATUSES)


def attempt_detail(attempts: DataFrame, backends: DataFrame) -> DataFrame:
    """Attempts with their backend's kind, name, model and settings; backends are few and broadcast."""
    return attempts.join(F.broadcast(backends), "backend_id").orderBy("backend_kind", "backend_id", "started_at", "attempt_number", "attempt_id")


def findings_per_attempt(findings: DataFrame) -> DataFrame:
    return findings.where("attempt_id is not null").groupBy("attempt_id").agg(F.count("*").alias("findings"))


def export_history(exports: DataFrame) -> DataFrame:
    return exports.orderBy(F.desc("created_at"), "export_id")


# ---- usage ----

_COUNTS = ("request_count", "input_chars", "input_bytes", "input_tokens", "output_tokens", "total_tokens")
_COSTS = ("input_cost_usd", "output_cost_usd", "cost_usd")


def usage_rows(attempts: DataFrame) -> DataFrame:
    """attempts (usage, a JSON object or null; settings, JSON) with its numbers as columns. Missing costs are filled from
    tokens and the settings' rates; the whole cost is the sum of the parts that are known."""
    schema = ", ".join([*(f"{c} long" for c in _COUNTS), "latency_ms double", *(f"{c} double" for c in _COSTS)])
    rows = attempts.withColumn("u", F.from_json("usage", schema))
    rate = lambda side: F.get_json_object("settings", f"$.{side}_cost_per_million_tokens").try_cast("double")
    tokens = lambda side: F.when(F.col(f"u.{side}_tokens") != 0, F.col(f"u.{side}_tokens"))
    made = {f"{side}_cost_usd": F.coalesce(F.col(f"u.{side}_cost_usd"), tokens(side) * rate(side) / 1e6) for side in ("input", "output")}
    rows = rows.withColumns({c: F.col(f"u.{c}") for c in (*_COUNTS, "latency_ms")} | made | {"whole": F.col("u.cost_usd")}).drop("u")
    parts = F.when(F.coalesce("input_cost_usd", "output_cost_usd").isNotNull(), F.coalesce("input_cost_usd", F.lit(0.0)) + F.coalesce("output_cost_usd", F.lit(0.0)))
    return rows.withColumn("cost_usd", F.coalesce("whole", parts)).drop("whole")


def usage_by_backend(attempts: DataFrame, findings: DataFrame | None = None, reused: bool = False) -> DataFrame:
    """One row a backend of attempts (attempt_id, backend_id, backend_kind, status, stop_reason, raw, usage, settings,
    model_id): attempts, outcomes, requests here and reused, sizes, latency, tokens or billed units, versions, stop
    reasons, costs (null where none is known)."""
    rows = usage_rows(attempts)
    if findings is not None:
        rows = rows.join(findings_per_attempt(findings), "attempt_id", "left")
    else:
        rows = rows.withColumn("findings", F.lit(0))
    ok = F.col("status") == "succeeded"
    units = F.when(F.coalesce("request_count", F.lit(0)) > 0, F.greatest(F.lit(1), F.ceil(F.coalesce("input_chars", F.lit(0)) / 100)))
    tokens = ("input_tokens", "output_tokens", "total_tokens")
    # one pass, by stop reason besides; the few rows of a backend are then added up
    parts = rows.groupBy("backend_id", "backend_kind", "stop_reason").agg(
        F.count("*").alias("n"), K.count_if(ok).alias("good"), *(F.sum(c).alias(c) for c in ("request_count", "input_chars", "input_bytes", "latency_ms", "findings", *tokens, *_COSTS)), F.sum(units).alias("units"),
        F.collect_set("model_id").alias("models"), F.collect_set(F.get_json_object("raw", "$.ModelVersion")).alias("versions"),
    )
    again = (F.col("backend_kind") == "detector") & F.lit(reused)
    requests, latency = K.sum_or_zero(F.col("request_count")), F.coalesce(F.sum("latency_ms"), F.lit(0.0))
    stops = F.collect_list(F.when(F.col("stop_reason").isNotNull(), F.struct("stop_reason", "n")))
    out = parts.groupBy("backend_id", "backend_kind").agg(
        F.sum("n").alias("attempts"), F.sum("good").alias("successful_requests"), (F.sum("n") - F.sum("good")).alias("error_requests"), requests.alias("request_count"), K.sum_or_zero(F.when(again, 0).otherwise(F.col("request_count"))).alias("requests_in_this_run"),
        K.sum_or_zero(F.when(again, F.col("request_count"))).alias("requests_reused_from_parent"), K.sum_or_zero(F.col("input_chars")).alias("input_characters"), K.sum_or_zero(F.col("input_bytes")).alias("input_bytes"), F.bround(latency, 6).alias("latency_ms"),
        F.when(requests > 0, F.bround(latency / requests, 6)).otherwise(0.0).alias("average_latency_ms"), K.sum_or_zero(F.col("findings")).alias("findings_returned"), K.sum_or_zero(F.col("units")).alias("billable_100_character_units"),
        *(K.sum_or_zero(F.col(c)).alias(c) for c in tokens), *(F.bround(F.sum(c), 8).alias(f"actual_{c}") for c in _COSTS),
        F.array_sort(F.array_distinct(F.flatten(F.array_union(F.collect_list("models"), F.collect_list("versions"))))).alias("model_versions"), F.when(F.size(stops) > 0, F.map_from_entries(F.array_sort(stops))).alias("stop_reasons"),
    )
    return out.orderBy("backend_kind", "backend_id")


def usage_total(attempts: DataFrame) -> DataFrame:
    """One row over all usage; the cost is null where none is given. Nothing is filled in."""
    schema = ", ".join([*(f"{c} long" for c in _COUNTS), "latency_ms double", "cost_usd double"])
    u = attempts.select(F.inline(F.array(F.from_json("usage", schema))))
    return u.agg(*(K.sum_or_zero(F.col(c)).alias(c) for c in ("request_count", "input_tokens", "output_tokens", "total_tokens")), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_ms"), F.sum("cost_usd").alias("cost_usd"))


# ---- errors ----

ERROR_STAGES = ("run", *K.STAGES)


def error_list(errors: DataFrame, records: DataFrame, record_id: str | None = None, stage: str | None = None, unresolved_only: bool = True) -> DataFrame:
    """Errors with their record's place: unresolved ones first, those of no record last, then by stage, time and id."""
    rows = errors
    if record_id is not None:
        rows = rows.where(F.col("record_id") == record_id)
    if stage is not None:
        rows = rows.where(F.col("stage") == stage)
    if unresolved_only:
        rows = rows.where("not resolved")
    rows = rows.join(records.select("record_id", "source_index"), "record_id", "left")
    return rows.orderBy("resolved", F.col("source_index").asc_nulls_last(), K.place_in(F.col("stage"), ERROR_STAGES), "created_at", "error_id")


ERROR_KEYS = ("resolved", "stage", "error_class", "error_code", "message", "retryable")


def error_groups(errors: DataFrame, keys: tuple[str, ...] = ERROR_KEYS, by: str = "created_at") -> DataFrame:
    """By key: occurrences, the number of different records, and their ids by first occurrence."""
    first = errors.groupBy(*keys, "record_id").agg(F.count("*").alias("n"), F.min(by).alias("seen"))
    ids = F.array_sort(F.collect_list(F.when(F.col("record_id").isNotNull(), F.struct("seen", "record_id"))))
    return first.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.count("record_id").alias("records"), F.transform(ids, lambda x: x["record_id"]).alias("record_ids"))


# ---- pages, audit, report ----


def record_page(records: DataFrame, page: int = 1, size: int = 100, status: str | None = None) -> tuple[DataFrame, int]:
    """(the page's rows in source order, the number of all rows)."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and hold 1 to 500 rows")
    rows = records.where(F.col("status") == status) if status else records
    return rows.orderBy("source_index").offset((page - 1) * size).limit(size), rows.count()


def record_audit(tables: dict[str, DataFrame], record_id: str) -> dict[str, list[dict]]:
    """All that the ledger holds of one record; review events, a JSON list in a decision, come flat besides."""
    out = {}
    for name, df in tables.items():
        if "record_id" in df.columns:
            out[name] = [r.asDict(True) for r in df.where(F.col("record_id") == record_id).collect()]  # one record's rows
    decisions = tables.get("review_decisions")
    if decisions is not None and "events" in decisions.columns:
        flat = decisions.where(F.col("record_id") == record_id).select("decision_id", F.posexplode(F.from_json("events", "array<string>")).alias("index", "event"))
        out["review_events"] = [r.asDict() for r in flat.orderBy("decision_id", "index").collect()]
    return out


def next_action(run_status: Column, pending_review: Column, retryable: Column) -> Column:
    """What to do next: review before retry before continue; null where nothing is left."""
    return F.when(pending_review > 0, "review").when(retryable > 0, "retry").when(run_status.isin("blocked", "failed"), "continue")


def run_list(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Runs, newest first, with their numbers of records and of ready ones (records carry run_id)."""
    counts = records.groupBy("run_id").agg(F.count("*").alias("total"), K.count_if(F.col("status") == "ready").alias("ready"))
    return runs.join(counts, "run_id", "left").select("run_id", "name", "status", "created_at", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("ready", F.lit(0)).alias("ready")).orderBy(F.desc("created_at"), "run_id")


def latest_first(rows: DataFrame, key: str, stale: str, time: str) -> DataFrame:
    """One row for each key: a current one before stale ones, then the newest."""
    w = Window.partitionBy(key).orderBy(stale, F.desc(time))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
