"""Queries over ledger tables. The tables are made of the driver's: records of documents, states, attempts, decisions and
the like by arithmetic on their keys, so that every status and every branch occurs; DuckDB makes the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as K
from ..operators import control as J
from ..operators import ledger as L
from ..operators import reporting as M
from ..operators import review as V
from ..operators import spans as S
from ..operators import work as W
from ..sources import records as R
from .catalog import _FIELDS, _docs, _found, _found_sql, _t, query  # noqa: F401

# ---- tables ----


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], at: str) -> str:
    return f"list_element([{', '.join(repr(v) for v in values)}], CAST(({at}) % {len(values)} AS INTEGER) + 1)"


def _id() -> Column:
    return F.concat(F.lit("d"), F.col("doc_id"))


def _records(spark, d) -> DataFrame:
    k = F.col("doc_id")
    return _t(spark, d, "documents").select(_id().alias("record_id"), F.col("source").alias("entity_id"), k.alias("source_index"), _pick(K.RECORD_STATUSES, k).alias("status"), "text", "lang", k)


_RECORDS = f"recs AS (SELECT 'd' || doc_id AS record_id, source AS entity_id, doc_id AS source_index, {_pick_sql(K.RECORD_STATUSES, 'doc_id')} AS status, text, lang, doc_id FROM documents)"


def _states(spark, d) -> DataFrame:
    rows = _records(spark, d).select("record_id", "source_index", F.posexplode(F.array(*map(F.lit, K.STAGES))).alias("i", "stage"))
    time = F.lit("2024-01-01").cast("timestamp")
    status = _pick(K.STATE_STATUSES, F.col("source_index") * 7 + F.col("i") * 3)
    return rows.select("record_id", "stage", status.alias("status"), (F.col("source_index") % 3).cast("int").alias("attempts"), F.when(F.col("source_index") % 2 == 0, time).alias("started_at"), F.when(status.isin(*J.TERMINAL), time).alias("finished_at"))


_STATES = f"states AS (SELECT record_id, stage, {_pick_sql(K.STATE_STATUSES, 'source_index * 7 + i * 3')} AS status, source_index, i, CAST(source_index % 3 AS INTEGER) AS attempts FROM recs CROSS JOIN (VALUES {', '.join(f'({i}, {s!r})' for i, s in enumerate(K.STAGES))}) t(i, stage))"


def _attempts(spark, d) -> DataFrame:
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    part = lambda name, by: F.concat(F.lit(f'"{name}":'), (k * by).cast("string"))
    usage = F.concat(F.lit('{"request_count":1,'), F.concat_ws(",", part("input_chars", 13), part("input_bytes", 14), part("input_tokens", 3), part("output_tokens", 1), part("total_tokens", 4), part("latency_ms", 2)), F.lit("}"))
    detector = F.col("event_type").isin("view", "click")
    return _t(spark, d, "events").select(
        F.concat(F.lit("a"), e).alias("attempt_id"), F.concat(F.lit("w"), e % 700).alias("work_item_id"), F.concat(F.lit("d"), F.col("user_id")).alias("record_id"), F.concat(F.lit("b_"), "event_type").alias("backend_id"), F.when(detector, "detector").otherwise("validator").alias("backend_kind"),
        (F.floor(e / 700) + 1).cast("int").alias("attempt_number"), _pick(K.ATTEMPT_STATUSES, e).alias("status"), F.when(e % 4 == 0, "end_turn").when(e % 4 == 1, "max_tokens").alias("stop_reason"), F.concat(F.lit('{"ModelVersion":"v'), e % 3, F.lit('"}')).alias("raw"),
        F.when(e % 11 > 0, usage).alias("usage"), F.when(detector, '{"input_cost_per_million_tokens":3.0,"output_cost_per_million_tokens":15.0}').otherwise("{}").alias("settings"), F.concat(F.lit("m_"), "event_type").alias("model_id"), F.col("ts").alias("started_at"), e,
    )


_ATTEMPTS = f"""atts AS (SELECT 'a' || event_id AS attempt_id, 'w' || (event_id % 700) AS work_item_id, 'd' || user_id AS record_id, 'b_' || event_type AS backend_id, CASE WHEN event_type IN ('view', 'click') THEN 'detector' ELSE 'validator' END AS backend_kind,
  CAST(event_id // 700 + 1 AS INTEGER) AS attempt_number, {_pick_sql(K.ATTEMPT_STATUSES, 'event_id')} AS status, CASE event_id % 4 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' END AS stop_reason, event_id % 3 AS v, CASE WHEN event_id % 11 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, 'm_' || event_type AS model_id, ts AS started_at, event_id FROM events)"""


def _decisions(spark, d) -> DataFrame:
    k = F.col("doc_id")
    time = (F.lit(1_700_000_000) + (k * 37) % 1000).cast("timestamp")
    return _t(spark, d, "labels").select(
        F.concat(F.lit("v"), k).alias("decision_id"), _id().alias("record_id"), _pick(K.DISPOSITIONS, k).alias("disposition"), F.concat(F.lit("who"), k % 4).alias("reviewer_id"), (k % 50).alias("review_seconds"), (k % 3).cast("int").alias("basis_revision"),
        time.alias("created_at"), (F.col("quality") == 1).alias("is_current"), (F.col("toxic") == 1).alias("is_stale"), k,
    )


_DECISIONS = f"decs AS (SELECT 'v' || doc_id AS decision_id, 'd' || doc_id AS record_id, {_pick_sql(K.DISPOSITIONS, 'doc_id')} AS disposition, 'who' || (doc_id % 4) AS reviewer_id, doc_id % 50 AS review_seconds, CAST(doc_id % 3 AS INTEGER) AS basis_revision, (doc_id * 37) % 1000 AS at_second, quality = 1 AS is_current, toxic = 1 AS is_stale, doc_id FROM labels)"
_CURRENT = "is_current AND NOT is_stale"


def _plans(spark, d) -> DataFrame:
    """Up to three plans a record: drafts and finals, the last of each active for most records."""
    k = F.col("source_index")
    rows = _records(spark, d).select("record_id", "source_index", F.explode(F.sequence(F.lit(1).cast("long"), k % 3 + 1)).alias("r"))
    return rows.select("record_id", F.col("r").cast("int").alias("plan_revision"), F.when(F.col("r") % 2 == 1, "draft").otherwise("final").alias("purpose"), F.when((F.col("r") >= k % 3) & (k % 5 > 0), "active").otherwise("stale").alias("status"), k)


_PLANS = "plans AS (SELECT record_id, CAST(r AS INTEGER) AS plan_revision, CASE WHEN r % 2 = 1 THEN 'draft' ELSE 'final' END AS purpose, CASE WHEN r >= source_index % 3 AND source_index % 5 > 0 THEN 'active' ELSE 'stale' END AS status, source_index FROM (SELECT record_id, source_index, unnest(range(1, source_index % 3 + 2)) AS r FROM recs))"


def _results(spark, d) -> DataFrame:
    k = F.col("doc_id")
    ok = k % 4 > 0
    return _t(spark, d, "documents").select(F.concat(F.lit("x"), k).alias("validation_id"), _id().alias("record_id"), F.when(ok, "succeeded").when(k % 8 == 0, "truncated").otherwise("technical_error").alias("status"), F.when(ok, k % 3 == 0).alias("raw_violation"), F.when(ok, k % 6 == 0).alias("effective_violation"), (k % 7 == 0).alias("is_stale"), F.concat(F.lit("n"), k).alias("rendering_id"))


_RESULTS = "results AS (SELECT 'x' || doc_id AS validation_id, 'd' || doc_id AS record_id, CASE WHEN doc_id % 4 > 0 THEN 'succeeded' WHEN doc_id % 8 = 0 THEN 'truncated' ELSE 'technical_error' END AS status, CASE WHEN doc_id % 4 > 0 THEN doc_id % 3 = 0 END AS raw_violation, CASE WHEN doc_id % 4 > 0 THEN doc_id % 6 = 0 END AS effective_violation, doc_id % 7 = 0 AS is_stale, doc_id FROM documents)"


def _errors(spark, d) -> DataFrame:
    e = F.col("event_id")
    return _t(spark, d, "events").where("event_id % 5 = 0").select(
        F.concat(F.lit("e"), e).alias("error_id"), F.when(e % 15 > 0, F.concat(F.lit("d"), "user_id")).alias("record_id"), _pick(M.ERROR_STAGES, e / 5).alias("stage"), F.lit("backend").alias("error_class"), F.concat(F.lit("c"), e % 4).alias("error_code"), F.concat(F.lit("failed "), "event_type").alias("message"),
        (e % 2 == 0).alias("retryable"), (e % 3 == 0).alias("resolved"), F.col("ts").alias("created_at"),
    )


_ERRORS = f"errs AS (SELECT 'e' || event_id AS error_id, CASE WHEN event_id % 15 > 0 THEN 'd' || user_id END AS record_id, {_pick_sql(M.ERROR_STAGES, 'event_id // 5')} AS stage, 'backend' AS error_class, 'c' || (event_id % 4) AS error_code, 'failed ' || event_type AS message, event_id % 2 = 0 AS retryable, event_id % 3 = 0 AS resolved, ts AS created_at FROM events WHERE event_id % 5 = 0)"


def _place_sql(value: str, order: tuple[str, ...]) -> str:
    return f"(CASE {value} {' '.join(f'WHEN {v!r} THEN {k}' for k, v in enumerate(order))} ELSE {len(order)} END)"


# ---- reports ----


@query("q28_record_counts", f"WITH {_RECORDS} SELECT status, count(*) AS n, {_place_sql('status', K.RECORD_STATUSES)} AS place FROM recs GROUP BY status")
def q28(spark, d):
    return M.record_counts(_records(spark, d))


@query("q29_stage_matrix", f"WITH {_RECORDS}, {_STATES} SELECT stage, status, count(*) AS n FROM states GROUP BY stage, status")
def q29(spark, d):
    return M.stage_matrix(_states(spark, d))


_COST = "CASE WHEN backend_kind = 'detector' THEN {} END"


@query("q30_usage_by_backend", f"""WITH {_ATTEMPTS}, fpa AS (SELECT 'a' || event_id AS attempt_id, 1 + event_id % 3 AS f FROM events WHERE event_id % 2 = 0)
  SELECT backend_id, backend_kind, count(*) AS attempts, count(*) FILTER (status = 'succeeded') AS successful_requests, count(*) FILTER (status <> 'succeeded') AS error_requests, count(k) AS request_count, CASE WHEN backend_kind = 'detector' THEN 0 ELSE count(k) END AS requests_in_this_run,
  CASE WHEN backend_kind = 'detector' THEN count(k) ELSE 0 END AS requests_reused_from_parent, CAST(sum(13 * k) AS BIGINT) AS input_characters, CAST(sum(14 * k) AS BIGINT) AS input_bytes, CAST(sum(2 * k) AS DOUBLE) AS latency_ms, round(CAST(sum(2 * k) AS DOUBLE) / count(k), 6) AS average_latency_ms, CAST(coalesce(sum(f), 0) AS BIGINT) AS findings_returned,
  CAST(sum(greatest(1, CAST(ceil(13 * k / 100.0) AS BIGINT))) FILTER (k IS NOT NULL) AS BIGINT) AS billable_100_character_units, CAST(sum(3 * k) AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS output_tokens, CAST(sum(4 * k) AS BIGINT) AS total_tokens,
  round({_COST.format('sum(3 * k) * 3.0 / 1e6')}, 8) AS actual_input_cost_usd, round({_COST.format('sum(k) * 15.0 / 1e6')}, 8) AS actual_output_cost_usd, round({_COST.format('sum(24 * k) / 1e6')}, 8) AS actual_cost_usd,
  min(model_id) || ',v0,v1,v2' AS model_versions, 'end_turn=' || count(*) FILTER (stop_reason = 'end_turn') || ',max_tokens=' || count(*) FILTER (stop_reason = 'max_tokens') AS stop_reasons FROM atts LEFT JOIN fpa USING (attempt_id) GROUP BY backend_id, backend_kind""")
def q30(spark, d):
    e = F.col("event_id")
    findings = _t(spark, d, "events").where("event_id % 2 = 0").select(F.concat(F.lit("a"), e).alias("attempt_id"), F.explode(F.sequence(F.lit(0).cast("long"), e % 3)))
    stops = F.array_join(F.transform(F.map_entries("stop_reasons"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return M.usage_by_backend(_attempts(spark, d), findings, True).withColumn("model_versions", F.array_join("model_versions", ",")).withColumn("stop_reasons", stops)


@query("q31_error_groups", f"WITH {_ERRORS}, firsts AS (SELECT resolved, stage, error_class, error_code, message, retryable, record_id, count(*) AS n, min(created_at) AS seen FROM errs GROUP BY ALL) SELECT resolved, stage, error_class, error_code, message, retryable, CAST(sum(n) AS BIGINT) AS occurrences, count(record_id) AS records, coalesce(string_agg(record_id, ',' ORDER BY seen, record_id) FILTER (record_id IS NOT NULL), '') AS record_ids FROM firsts GROUP BY resolved, stage, error_class, error_code, message, retryable")
def q31(spark, d):
    return M.error_groups(_errors(spark, d)).withColumn("record_ids", F.array_join("record_ids", ","))


@query("q34_review_queue", f"""WITH {_RECORDS}, {_STATES}, {_DECISIONS} SELECT r.record_id, r.source_index, s.status = 'review_pending' AS pending, c.disposition, CAST(coalesce(c.review_seconds, w.seconds, 0) AS BIGINT) AS seconds
  FROM recs r JOIN states s ON s.record_id = r.record_id AND s.stage = 'review' AND s.status IN ('review_pending', 'succeeded') LEFT JOIN (SELECT * FROM decs WHERE {_CURRENT}) c ON c.record_id = r.record_id LEFT JOIN (SELECT 'd' || doc_id AS record_id, doc_id % 20 AS seconds FROM labels WHERE doc_id % 4 = 0) w ON w.record_id = r.record_id""")
def q34(spark, d):
    workspaces = _t(spark, d, "labels").where("doc_id % 4 = 0").select(_id().alias("record_id"), (F.col("doc_id") % 20).alias("seconds"))
    return V.queue_rows(_records(spark, d).drop("status"), _states(spark, d), _decisions(spark, d), workspaces)


@query("q34b_queue_summary", f"""WITH {_RECORDS}, {_STATES}, {_DECISIONS}, rows AS (SELECT s.status = 'review_pending' AS pending, c.disposition, coalesce(c.review_seconds, w.seconds, 0) AS seconds
  FROM recs r JOIN states s ON s.record_id = r.record_id AND s.stage = 'review' AND s.status IN ('review_pending', 'succeeded') LEFT JOIN (SELECT * FROM decs WHERE {_CURRENT}) c ON c.record_id = r.record_id LEFT JOIN (SELECT 'd' || doc_id AS record_id, doc_id % 20 AS seconds FROM labels WHERE doc_id % 4 = 0) w ON w.record_id = r.record_id)
  SELECT count(*) FILTER (pending) AS pending, count(disposition) AS reviewed, CAST(sum(seconds) AS BIGINT) AS total_seconds, round_even(CAST(sum(seconds) FILTER (disposition IS NOT NULL) AS DOUBLE) / count(disposition), 1) AS average_seconds FROM rows""")
def q34b(spark, d):
    return V.queue_summary(q34(spark, d))


@query("q41_validation_totals", f"""WITH {_RESULTS}, found AS (SELECT 'x' || doc_id AS validation_id, doc_id % 2 = 0 AS ignored FROM labels) SELECT count(*) FILTER (status = 'succeeded') AS completed, count(*) FILTER (raw_violation) AS raw_violations, count(*) FILTER (effective_violation) AS effective_violations, count(*) FILTER (status = 'technical_error') AS technical_errors,
  count(*) FILTER (status = 'truncated') AS truncated, (SELECT count(*) FROM found JOIN results USING (validation_id) WHERE NOT is_stale AND ignored) AS ignored_findings FROM results WHERE NOT is_stale""")
def q41(spark, d):
    found = _t(spark, d, "labels").select(F.concat(F.lit("x"), "doc_id").alias("validation_id"), (F.col("doc_id") % 2 == 0).alias("ignored_by_policy"))
    return M.validation_totals(_results(spark, d), found)


@query("q42_disposition_counts", f"WITH {_DECISIONS} SELECT disposition, count(*) AS n, {_place_sql('disposition', K.DISPOSITIONS)} AS place FROM decs WHERE {_CURRENT} GROUP BY disposition")
def q42(spark, d):
    return M.disposition_counts(_decisions(spark, d))


@query("q43_review_seconds", f"WITH {_DECISIONS} SELECT count(*) AS reviewed, CAST(coalesce(sum(review_seconds), 0) AS BIGINT) AS review_seconds, coalesce(round_even(CAST(sum(review_seconds) AS DOUBLE) / count(*), 1), 0.0) AS average_seconds FROM decs WHERE {_CURRENT}")
def q43(spark, d):
    return M.review_seconds(_decisions(spark, d))


@query("q44_review_records", f"WITH {_RECORDS}, {_DECISIONS} SELECT record_id, entity_id, source_index, disposition, reviewer_id, review_seconds, at_second, decision_id FROM decs JOIN recs USING (record_id) WHERE {_CURRENT}")
def q44(spark, d):
    return M.review_records(_decisions(spark, d), _records(spark, d)).withColumn("at_second", F.col("created_at").cast("long") - 1_700_000_000).drop("created_at")


@query("q45_structured_counts", f"WITH {_RECORDS}, {_PLANS}, ev AS (SELECT record_id, plan_revision, c AS column_name, CASE c WHEN 'name' THEN 'NAME' ELSE 'DATE' END AS category, purpose FROM plans CROSS JOIN (VALUES ('name'), ('day')) t(c)) SELECT column_name, category, ev.purpose, count(*) AS n FROM ev JOIN plans USING (record_id, plan_revision) WHERE status = 'active' GROUP BY ALL")
def q45(spark, d):
    plans = _plans(spark, d)
    events = plans.select("record_id", "plan_revision", "purpose", F.explode(F.array(F.lit("name"), F.lit("day"))).alias("column_name")).withColumn("category", F.when(F.col("column_name") == "name", "NAME").otherwise("DATE"))
    return M.structured_counts(events, plans)


@query("q46_attempt_counts", f"WITH {_ATTEMPTS} SELECT status, count(*) AS n, {_place_sql('status', K.ATTEMPT_STATUSES)} AS place FROM atts GROUP BY status")
def q46(spark, d):
    return M.attempt_counts(_attempts(spark, d))


@query("q47_attempt_detail", f"WITH {_ATTEMPTS} SELECT attempt_id, backend_kind, backend_id, upper(backend_id) AS backend_name, attempt_number, status FROM atts")
def q47(spark, d):
    attempts = _attempts(spark, d)
    backends = attempts.select("backend_id", "backend_kind", F.upper("backend_id").alias("backend_name")).distinct()
    return M.attempt_detail(attempts.drop("backend_kind"), backends).select("attempt_id", "backend_kind", "backend_id", "backend_name", "attempt_number", "status")


@query("q48_findings_per_attempt", "SELECT 'a' || (event_id % 40) AS attempt_id, count(*) AS findings FROM events WHERE event_id % 3 > 0 GROUP BY event_id % 40")
def q48(spark, d):
    e = F.col("event_id")
    return M.findings_per_attempt(_t(spark, d, "events").select(F.when(e % 3 > 0, F.concat(F.lit("a"), e % 40)).alias("attempt_id")))


@query("q49_usage_total", f"WITH {_ATTEMPTS} SELECT count(k) AS request_count, CAST(sum(3 * k) AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS output_tokens, CAST(sum(4 * k) AS BIGINT) AS total_tokens, CAST(sum(2 * k) AS DOUBLE) AS latency_ms, CAST(NULL AS DOUBLE) AS cost_usd FROM atts")
def q49(spark, d):
    return M.usage_total(_attempts(spark, d))


@query("q50_error_list", f"WITH {_RECORDS}, {_ERRORS} SELECT error_id, errs.record_id, source_index, stage, row_number() OVER (ORDER BY source_index NULLS LAST, {_place_sql('stage', M.ERROR_STAGES)}, created_at, error_id) AS place FROM errs LEFT JOIN recs ON recs.record_id = errs.record_id WHERE NOT resolved")
def q50(spark, d):
    return R.with_source_index(M.error_list(_errors(spark, d), _records(spark, d)).withColumn("key", F.struct(F.col("source_index").isNull(), "source_index", K.place_in(F.col("stage"), M.ERROR_STAGES), "created_at", "error_id")).withColumnRenamed("source_index", "si"), "key").select("error_id", "record_id", F.col("si").alias("source_index"), "stage", (F.col("source_index") + 1).alias("place"))


@query("q51_stage_rows", f"WITH {_RECORDS}, {_STATES}, r AS (SELECT stage, CASE WHEN bool_and(status IN ('excluded', 'skipped')) THEN 'skipped' WHEN bool_and(status IN ('succeeded', 'excluded', 'skipped')) THEN 'completed' WHEN bool_or(status IN ('retry_exhausted', 'permanent_error', 'blocked')) THEN 'completed_with_errors' ELSE 'blocked' END AS status FROM states GROUP BY stage) SELECT stage, status, CASE WHEN stage = 'detection' THEN 'reused_from_parent' WHEN status = 'skipped' THEN 'skipped' WHEN status LIKE 'completed%' THEN 'completed_in_this_run' ELSE 'scheduled_in_this_run' END AS provenance FROM r")
def q51(spark, d):
    return M.stage_rows(L.stage_rollup(_states(spark, d)), ("detection",))


@query("q52_run_list", "SELECT 'run' || l.lang AS run_id, l.lang AS name, 'completed' AS status, count(*) AS total, count(*) FILTER (d.doc_id % 6 = 3) AS ready FROM (SELECT DISTINCT lang FROM documents) l JOIN documents d ON d.lang = l.lang GROUP BY l.lang")
def q52(spark, d):
    records = _records(spark, d).withColumn("run_id", F.concat(F.lit("run"), "lang"))
    runs = records.groupBy("run_id", F.col("lang").alias("name")).agg(F.lit("completed").alias("status"), F.max("source_index").alias("created_at"))
    return M.run_list(runs, records).drop("created_at")


@query("q53_next_action", f"WITH {_RECORDS} SELECT record_id, CASE WHEN status = 'awaiting_review' THEN 'review' WHEN status = 'failed' THEN 'retry' WHEN status = 'processing' THEN 'continue' END AS action FROM recs")
def q53(spark, d):
    s = F.col("status")
    return _records(spark, d).select("record_id", M.next_action(F.when(s == "processing", "blocked").otherwise("completed"), (s == "awaiting_review").cast("int"), (s == "failed").cast("int")).alias("action"))


# ---- states, retry, revision ----


@query("q54_worklist", f"WITH {_RECORDS}, {_STATES} SELECT record_id, recs.source_index FROM recs JOIN states USING (record_id) WHERE stage = 'validation' AND states.status IN ('pending', 'retry_pending')")
def q54(spark, d):
    return W.worklist(_records(spark, d), _states(spark, d), "validation").select("record_id", "source_index")


@query("q55_prerequisites", f"WITH {_RECORDS}, {_STATES} SELECT record_id FROM states WHERE stage IN ('input', 'detection', 'transformation') AND status IN ('succeeded', 'skipped') GROUP BY record_id HAVING count(*) = 3")
def q55(spark, d):
    return W.ready_for(_states(spark, d), ("input", "detection", "transformation"))


@query("q56_recovered", f"WITH {_RECORDS}, {_STATES}, {_ATTEMPTS} SELECT 'state' AS kind, record_id || stage AS id, CASE WHEN status = 'running' THEN 'retry_pending' ELSE status END AS status FROM states UNION ALL SELECT 'attempt', attempt_id, CASE WHEN status = 'running' THEN 'cancelled' ELSE status END FROM atts")
def q56(spark, d):
    states, attempts = _states(spark, d), _attempts(spark, d)
    _, s, a = J.recovered(states, states, attempts)
    return s.select(F.lit("state").alias("kind"), F.concat("record_id", "stage").alias("id"), "status").union(a.select(F.lit("attempt"), "attempt_id", "status"))


@query("q57_moved_states", f"""WITH {_RECORDS}, {_STATES} SELECT record_id, stage, CASE WHEN hit THEN CASE WHEN source_index % 2 = 0 THEN 'running' ELSE 'succeeded' END ELSE status END AS status, CAST(attempts + CASE WHEN hit AND source_index % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts,
  source_index % 2 = 0 AS started, CASE WHEN hit THEN source_index % 2 = 1 ELSE status IN ({', '.join(repr(s) for s in J.TERMINAL)}) END AS finished FROM (SELECT *, stage = 'detection' AND source_index % 3 = 0 AS hit FROM states)""")
def q57(spark, d):
    k = F.col("source_index")
    changes = _records(spark, d).where("source_index % 3 = 0").select("record_id", F.lit("detection").alias("stage"), F.when(k % 2 == 0, "running").otherwise("succeeded").alias("to"), (k % 2 == 0).alias("counts"))
    moved = J.moved_state(_states(spark, d), changes, F.lit("2024-02-02").cast("timestamp"))
    return moved.select("record_id", "stage", "status", "attempts", F.col("started_at").isNotNull().alias("started"), F.col("finished_at").isNotNull().alias("finished"))


@query("q58_record_status", f"WITH {_RECORDS} SELECT record_id, CASE WHEN source_index % 4 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN source_index % 8 = 0 THEN 'new' WHEN source_index % 3 = 0 THEN 'old' END AS final_rendering_id FROM recs")
def q58(spark, d):
    k = F.col("source_index")
    rows = _records(spark, d).withColumn("final_rendering_id", F.when(k % 3 == 0, "old")).withColumn("final_metadata", F.lit("{}"))
    changes = rows.where("source_index % 4 = 0").select("record_id", F.lit("ready").alias("status"), F.when(k % 8 == 0, "new").alias("final_rendering_id"), F.lit(None).cast("string").alias("final_metadata"))
    return J.with_status(rows, changes).select("record_id", "status", "final_rendering_id")


@query("q59_resolved_errors", f"WITH {_ERRORS} SELECT error_id, resolved OR (stage = 'validation' AND coalesce(record_id IN (SELECT 'd' || doc_id FROM documents WHERE doc_id % 2 = 0), false)) AS resolved FROM errs")
def q59(spark, d):
    return J.resolved(_errors(spark, d), "validation", _records(spark, d).where("source_index % 2 = 0")).select("error_id", "resolved")


_TARGETS = "targets AS (SELECT record_id, stage, i FROM states WHERE stage = 'transformation' AND status IN ('retry_exhausted', 'permanent_error'))"


@query("q60_reset_states", f"WITH {_RECORDS}, {_STATES}, {_TARGETS} SELECT s.record_id, s.stage, CASE WHEN t.i IS NOT NULL AND s.i >= t.i AND s.status <> 'excluded' THEN CASE WHEN s.stage = 'review' THEN 'skipped' ELSE 'pending' END ELSE s.status END AS status FROM states s LEFT JOIN targets t ON t.record_id = s.record_id")
def q60(spark, d):
    states = _states(spark, d)
    return J.reset_states(states, J.retry_targets(states, stage="transformation", failed=True), ("review",)).select("record_id", "stage", "status")


@query("q61_staled", f"WITH {_RECORDS}, {_STATES}, {_TARGETS}, {_DECISIONS} SELECT decision_id, is_stale OR t.record_id IS NOT NULL AS is_stale, is_current AND NOT (is_stale OR t.record_id IS NOT NULL) AS is_current FROM decs LEFT JOIN targets t ON t.record_id = decs.record_id")
def q61(spark, d):
    return J.staled(_decisions(spark, d), "review_decisions", J.retry_targets(_states(spark, d), stage="transformation", failed=True)).select("decision_id", "is_stale", "is_current")


@query("q62_failed_records", f"WITH {_RECORDS}, {_STATES} SELECT DISTINCT record_id, recs.source_index FROM recs JOIN states USING (record_id) WHERE states.status IN ('retry_exhausted', 'permanent_error')")
def q62(spark, d):
    return J.failed_records(_records(spark, d), _states(spark, d)).select("record_id", "source_index")


@query("q63_saved_plans", f"WITH {_RECORDS}, {_PLANS}, new AS (SELECT record_id FROM recs WHERE source_index % 4 = 0) SELECT record_id, plan_revision, purpose, CASE WHEN purpose = 'draft' AND status = 'active' AND record_id IN (SELECT record_id FROM new) THEN 'stale' ELSE status END AS status FROM plans UNION ALL SELECT record_id, CAST(max(plan_revision) + 1 AS INTEGER), 'draft', 'active' FROM plans WHERE record_id IN (SELECT record_id FROM new) GROUP BY record_id")
def q63(spark, d):
    new = _records(spark, d).where("source_index % 4 = 0").select("record_id", F.lit("draft").alias("purpose"))
    return J.saved_plans(_plans(spark, d), new)


@query("q64_next_revisions", f"WITH {_RECORDS}, {_PLANS}, last AS (SELECT record_id, max(plan_revision) AS last, arg_max('h' || (plan_revision % 2), plan_revision) AS active FROM plans WHERE source_index % 7 > 0 GROUP BY record_id) SELECT r.record_id, 'h1' AS digest, CAST(CASE WHEN active = 'h1' THEN last ELSE coalesce(last, 0) + 1 END AS INTEGER) AS revision, coalesce(active <> 'h1', true) AS is_new FROM recs r LEFT JOIN last ON last.record_id = r.record_id")
def q64(spark, d):
    known = _plans(spark, d).where("source_index % 7 > 0").select("record_id", F.col("plan_revision").alias("revision"), F.concat(F.lit("h"), F.col("plan_revision") % 2).alias("digest"))
    return J.next_revisions(_records(spark, d).select("record_id", F.lit("h1").alias("digest")), known)


@query("q65_active_revision", f"WITH {_RECORDS}, {_PLANS} SELECT record_id, plan_revision FROM plans p WHERE plan_revision = (SELECT max(plan_revision) FROM plans q WHERE q.record_id = p.record_id)")
def q65(spark, d):
    return J.active(_plans(spark, d), "plan_revision").select("record_id", "plan_revision")


@query("q66_rendering_ids", f"WITH {_RECORDS}, {_PLANS} SELECT record_id, plan_revision, sha256(record_id || chr(0) || plan_revision || chr(0) || purpose) AS rendering_id FROM plans")
def q66(spark, d):
    return _plans(spark, d).select("record_id", "plan_revision", J.rendering_id(F.col("record_id"), F.col("plan_revision"), F.col("purpose")).alias("rendering_id"))


@query("q67_copied_findings", "SELECT event_id, 'child' AS run_id FROM events WHERE event_id % 4 < 2")
def q67(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.lit("parent").alias("run_id"), _pick(K.SOURCE_KINDS, F.col("event_id")).alias("source_kind"))
    return J.copied(rows, "child").select("event_id", "run_id")


# ---- resolution and rendering rows ----


def _rule_findings(spark, d) -> DataFrame:
    return W.findings(_found(spark, d).withColumn("record_id", F.col("record_id").cast("string")), "run", "rule", "embedded_rules")


_FINDING = """'finding_' || substr(sha256('["run","' || record_id || '","embedded_rules",' || s || ',' || e || ',"' || category || '","' || span_id || '","' || exact_text || '"]'), 1, 32)"""


@query("q68_finding_ids", f"WITH {_found_sql()} SELECT CAST(record_id AS VARCHAR) AS record_id, s AS start_at, {_FINDING} AS finding_id, true AS is_eligible FROM found")
def q68(spark, d):
    return _rule_findings(spark, d).select("record_id", F.col("start").alias("start_at"), "finding_id", "is_eligible")


@query("q69_findings_digest", f"""WITH {_found_sql()}, f AS (SELECT *, {_FINDING} AS id FROM found) SELECT CAST(record_id AS VARCHAR) AS record_id, sha256('[' || string_agg('{{"category":"' || category || '","end":' || e || ',"id":"' || id || '","start":' || s || ',"text":"' || exact_text || '"}}', ',' ORDER BY s, e, category, id) || ']') AS digest FROM f GROUP BY record_id""")
def q69(spark, d):
    return S.findings_digest(_rule_findings(spark, d))


@query("q70_rendering_events", f"""WITH {_found_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY s, e) AS n FROM found) SELECT record_id, s AS start_at, 'render-event_' || substr(sha256('["r' || record_id || '","' || span_id || '",' || n || ']'), 1, 32) AS rendering_event_id FROM n""")
def q70(spark, d):
    events = _found(spark, d).select("record_id", "start", "end", "category", F.col("span_id").alias("event_id"), F.concat(F.lit("r"), "record_id").alias("rendering_id"), K.placeholder(F.col("category")).alias("replacement"))
    return S.rendering_events(events).select("record_id", F.col("start").alias("start_at"), "rendering_event_id")


# ---- detection and validation ----


@query("q71_attempt_numbers", f"WITH {_ATTEMPTS}, last AS (SELECT work_item_id, max(attempt_number) AS last FROM atts GROUP BY work_item_id) SELECT 'w' || (doc_id * 2) AS work_item_id, CAST(coalesce(last, 0) + 1 AS INTEGER) AS attempt_number, 'attempt_' || substr(sha256('[\"run\",\"w' || (doc_id * 2) || '\",' || (coalesce(last, 0) + 1) || ']'), 1, 32) AS attempt_id FROM documents LEFT JOIN last ON work_item_id = 'w' || (doc_id * 2)")
def q71(spark, d):
    calls = _t(spark, d, "documents").select(F.concat(F.lit("w"), F.col("doc_id") * 2).alias("work_item_id"))
    return W.numbered_attempts(calls, "run", _attempts(spark, d)).select("work_item_id", "attempt_number", "attempt_id")


@query("q72_work_status", f"WITH {_ATTEMPTS} SELECT attempt_id, CASE WHEN status = 'succeeded' THEN 'succeeded' WHEN status = 'cancelled' THEN 'retry_pending' WHEN status IN ('retryable_error', 'truncated') THEN CASE WHEN attempt_number < 3 THEN 'retry_pending' ELSE 'retry_exhausted' END ELSE 'permanent_error' END AS work_status FROM atts")
def q72(spark, d):
    return _attempts(spark, d).select("attempt_id", W.work_status(F.col("status"), F.col("attempt_number"), 3).alias("work_status"))


@query("q73_truncations", f"WITH {_ATTEMPTS} SELECT work_item_id, count(*) FILTER (status = 'truncated') AS truncations FROM atts GROUP BY work_item_id")
def q73(spark, d):
    return W.truncations(_attempts(spark, d))


def _answered(spark, d) -> tuple[DataFrame, DataFrame]:
    """Answers about the first words of each text: one right, one off by two, one of nowhere."""
    docs = _docs(spark, d).where(F.length("text") > 20).select("record_id", F.substring("text", 1, 2000).alias("chunk")).where(F.length("chunk") > 20)
    one = lambda c, t, a, b, p: F.struct(F.lit(c).alias("category"), t.alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).cast("double").alias("confidence"))
    found = F.array(one("NAME", F.substring("chunk", 4, 12), 3, 15, 0.5), one("ODD", F.lit(""), 1, 4, None), one("DATE", F.lit("\x01 nowhere"), 0, 9, 0.9))
    rows = docs.select(F.col("record_id").alias("work_item_id"), F.col("record_id").alias("attempt_id"), "record_id", F.lit("succeeded").alias("status"), F.to_json(F.struct(found.alias("findings"))).alias("raw"))
    return rows, docs.select(F.col("record_id").alias("work_item_id"), F.lit(100).alias("start"), "chunk")


@query("q74_parsed_answers", """WITH c AS (SELECT 'd' || doc_id AS record_id, substr(text, 1, 2000) AS chunk FROM documents WHERE length(text) > 20) SELECT record_id, '0' AS span_id, 'NAME' AS category, CAST(103 AS INTEGER) AS start_at, CAST(115 AS INTEGER) AS end_at, substr(chunk, 4, 12) AS exact_text, CAST(NULL AS VARCHAR) AS error FROM c
  UNION ALL SELECT record_id, '1', 'UNMAPPED', 101, 104, substr(chunk, 2, 3), NULL FROM c UNION ALL SELECT record_id, '2', 'DATE', NULL, NULL, NULL, 'not in the text' FROM c""")
def q74(spark, d):
    return W.parse_answers(*_answered(spark, d)).select("record_id", "span_id", "category", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "exact_text", "error")


@query("q75_service_answers", """SELECT 'd' || doc_id AS record_id, CASE doc_id % 3 WHEN 0 THEN 'LOCATION' ELSE 'NAME' END AS category, CASE WHEN doc_id % 5 = 0 THEN 'truncated' WHEN doc_id % 3 = 1 THEN 'text_mismatch' WHEN doc_id % 4 = 0 THEN 'bad_confidence' END AS error, 12 AS start_at FROM documents WHERE length(text) > 20""")
def q75(spark, d):
    k = F.col("doc_id")
    docs = _t(spark, d, "documents").where(F.length("text") > 20)
    entity = F.struct(F.when(k % 3 == 0, "ADDRESS").otherwise("NAME").alias("Type"), F.when(k % 3 == 1, "\x01").otherwise(F.substring("text", 3, 4)).alias("Text"), F.lit(2).alias("BeginOffset"), F.lit(6).alias("EndOffset"), F.when(k % 4 == 0, 7.0).otherwise(0.7).alias("Score"))
    rows = docs.select(_id().alias("work_item_id"), _id().alias("attempt_id"), _id().alias("record_id"), F.lit("succeeded").alias("status"), F.to_json(F.struct(F.array(entity).alias("Entities"), F.when(k % 5 == 0, "more").alias("PaginationToken"))).alias("raw"))
    got = W.map_service_answers(rows, docs.select(_id().alias("work_item_id"), F.lit(10).alias("start"), F.col("text").alias("chunk")))
    return got.select("record_id", "category", "error", F.col("start").alias("start_at"))


@query("q76_failed_answers", "SELECT 'd' || doc_id AS work_item_id, CASE WHEN doc_id % 5 = 0 THEN 'truncated' WHEN doc_id % 3 = 1 THEN 'text_mismatch' ELSE 'bad_confidence' END AS error FROM documents WHERE length(text) > 20 AND (doc_id % 5 = 0 OR doc_id % 3 = 1 OR doc_id % 4 = 0)")
def q76(spark, d):
    return W.answers_failed(q75(spark, d).withColumnRenamed("record_id", "work_item_id"))


@query("q77_validation_outcome", f"""WITH {_ATTEMPTS}, last AS (SELECT record_id, arg_max(status, event_id) AS last, count(*) FILTER (status = 'truncated') AS cut FROM atts WHERE event_id % 60 < 2 + event_id // 100 GROUP BY record_id)
  SELECT record_id, CASE WHEN last = 'succeeded' THEN 'succeeded' WHEN last = 'truncated' AND cut < 3 THEN 'retry_pending' WHEN last IN ('truncated', 'retryable_error') THEN 'retry_exhausted' ELSE 'permanent_error' END AS status,
  CASE WHEN last = 'succeeded' THEN 'succeeded' WHEN last = 'truncated' AND cut >= 3 THEN 'truncated' WHEN last <> 'truncated' THEN 'technical_error' END AS result FROM last""")
def q77(spark, d):
    return W.validation_outcome(_attempts(spark, d).where("event_id % 60 < 2 + event_id div 100").withColumn("attempt_number", F.col("event_id")))


@query("q78_parsed_verdicts", "SELECT 'd' || doc_id AS record_id, CASE WHEN doc_id % 3 > 0 THEN 1 END AS index, CASE WHEN doc_id % 3 > 0 THEN 'NAME' END AS category, CASE WHEN doc_id % 3 = 0 THEN 'bad_answer' END AS error FROM labels")
def q78(spark, d):
    k = F.col("doc_id")
    finding = F.array(F.struct(F.lit("NAME").alias("category"), F.lit("x").alias("evidence"), F.when(k % 3 > 0, "high").otherwise("sure").alias("confidence"), F.lit("why").alias("rationale")))
    rows = _t(spark, d, "labels").select(_id().alias("record_id"), F.lit("succeeded").alias("status"), F.lit("said").alias("rationale"), F.to_json(finding).alias("findings"))
    return W.parse_verdicts(rows).select("record_id", "index", "category", "error")


@query("q79_validation_finding_ids", "SELECT 'd' || doc_id AS record_id, 'validation-finding_' || substr(sha256('[\"run\",\"d' || doc_id || '\",\"n' || doc_id || '\",1,\"' || CASE WHEN doc_id % 2 = 0 THEN 'PROFESSION' ELSE 'NAME' END || '\",\"e\"]'), 1, 32) AS validation_finding_id, doc_id % 2 = 0 AS ignored_by_policy FROM labels")
def q79(spark, d):
    k = F.col("doc_id")
    rows = _t(spark, d, "labels").select(_id().alias("record_id"), F.concat(F.lit("n"), k).alias("rendering"), F.lit(1).alias("index"), F.when(k % 2 == 0, "PROFESSION").otherwise("NAME").alias("category"), F.lit("e").alias("evidence"))
    return W.validation_findings(rows, "run", "rendering", K.DEFAULT_POLICY).select("record_id", "validation_finding_id", "ignored_by_policy")


@query("q95_registered_backends", "SELECT 'b' || c_custkey AS backend_id, sha256(c_mktsegment) AS settings_sha256, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'backend_changed' END AS error FROM customer")
def q95(spark, d):
    k = F.col("c_custkey")
    rows = _t(spark, d, "customer").select(F.concat(F.lit("b"), k).alias("backend_id"), F.col("c_mktsegment").alias("settings"), F.lit("p").alias("prompt"), F.lit(None).cast("string").alias("schema"), k)
    before = W.registered(rows.where("c_custkey % 2 = 0").withColumn("prompt", F.when(k % 3 == 0, "old").otherwise("p")))
    return W.registered(rows, before).select("backend_id", "settings_sha256", "error")


@query("q96_export_history", "SELECT 'x' || o_orderkey AS export_id, row_number() OVER (ORDER BY o_orderdate DESC, 'x' || o_orderkey) - 1 AS place FROM orders WHERE o_custkey % 10 = 0")
def q96(spark, d):
    rows = _t(spark, d, "orders").where("o_custkey % 10 = 0").select(F.concat(F.lit("x"), "o_orderkey").alias("export_id"), F.col("o_orderdate").alias("created_at"))
    newest = M.export_history(rows).withColumn("key", F.struct(-F.unix_timestamp("created_at"), "export_id"))
    return R.with_source_index(newest, "key").select("export_id", F.col("source_index").alias("place"))


# ---- review ----


@query("q80_basis_revision", f"""WITH {_RECORDS}, {_PLANS}, {_DECISIONS}, b AS (SELECT record_id, max(plan_revision) FILTER (status = 'active') AS active, max(plan_revision) AS latest FROM plans WHERE purpose = 'draft' GROUP BY record_id), c AS (SELECT record_id, max(basis_revision) AS decided FROM decs WHERE {_CURRENT} GROUP BY record_id)
  SELECT b.record_id, CAST(coalesce(active, decided, latest) AS INTEGER) AS revision FROM b LEFT JOIN c ON c.record_id = b.record_id""")
def q80(spark, d):
    return V.basis_revision(_plans(spark, d), _decisions(spark, d))


def _shown(spark, d) -> DataFrame:
    return S.resolve(_rule_findings(spark, d))


def _edits(spark, d) -> DataFrame:
    """An edit for each displayed group: removed, changed, of another record's group, or with old findings."""
    k = F.col("start") % 4
    groups = _shown(spark, d).select("record_id", "group_id", "start", "end", "finding_ids", "category")
    return groups.select("record_id", F.when(k == 1, "modify").otherwise("remove").alias("op"), F.when(k == 2, "nowhere").otherwise(F.col("group_id")).alias("group_id"), F.when(k == 1, F.lit(0)).alias("start"), F.when(k == 1, F.lit(3)).alias("end"), F.when(k == 1, "NAME").alias("category"), F.lit(None).cast("string").alias("text"), F.when(k == 3, F.array(F.lit("old"))).otherwise(F.col("finding_ids")).alias("finding_ids"))


def _edits_checked(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text")
    edits = _edits(spark, d).join(docs.select("record_id", F.substring("text", 1, 3).alias("first")), "record_id").withColumn("text", F.when(F.col("op") == "modify", F.col("first"))).drop("first")
    return V.checked_edits(edits, _shown(spark, d), docs)


_EDIT_ERROR = "CASE s % 4 WHEN 2 THEN 'unknown_group' WHEN 3 THEN 'stale_group' END"


@query("q81_checked_edits", f"WITH {_found_sql()} SELECT CAST(record_id AS VARCHAR) AS record_id, CASE WHEN s % 4 = 1 THEN 'modify' ELSE 'remove' END AS op, {_EDIT_ERROR} AS error FROM found")
def q81(spark, d):
    return _edits_checked(spark, d).select("record_id", "op", "error")


@query("q82_edited_findings", f"WITH {_found_sql()} SELECT CAST(record_id AS VARCHAR) AS record_id, s AS start_at, e AS end_at, category, 'rule' AS source_kind FROM found WHERE s % 4 >= 2 UNION ALL SELECT DISTINCT CAST(record_id AS VARCHAR), 0, 3, 'NAME', 'review' FROM found WHERE s % 4 = 1")
def q82(spark, d):
    return V.edited_findings(_rule_findings(spark, d), _edits_checked(spark, d), "run", "who").select("record_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "category", "source_kind")


@query("q83_checked_fields", "SELECT 'd' || doc_id AS record_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown_column' WHEN 2 THEN 'category_mismatch' ELSE 'original_mismatch' END AS error FROM documents")
def q83(spark, d):
    k = F.col("doc_id")
    rows = _t(spark, d, "documents")
    events = rows.select(_id().alias("record_id"), F.lit("lang").alias("column_name"), F.lit("NAME").alias("category"), F.col("lang").alias("original"))
    changes = rows.select(_id().alias("record_id"), F.when(k % 4 == 1, "other").otherwise("lang").alias("column_name"), F.when(k % 4 == 2, "DATE").otherwise("NAME").alias("category"), F.when(k % 4 == 3, "xx").otherwise(F.col("lang")).alias("original"), F.lit("new").alias("value"))
    return V.checked_fields(changes, events).select("record_id", "error")


@query("q84_checked_decisions", f"""WITH {_RECORDS}, {_PLANS}, b AS (SELECT record_id, CAST(coalesce(max(plan_revision) FILTER (status = 'active'), max(plan_revision)) AS INTEGER) AS basis FROM plans WHERE purpose = 'draft' GROUP BY record_id)
  SELECT record_id, CASE WHEN source_index % 3 + 1 = 2 THEN 'no_draft' WHEN source_index % 3 + 1 <> basis THEN 'stale_revision' WHEN source_index % 2 = 0 AND source_index % 10 >= 5 THEN 'edits_without_correction' WHEN source_index % 2 = 1 AND source_index % 10 < 5 THEN 'correction_without_edits' WHEN source_index % 11 = 0 THEN 'foreign_validation' END AS error FROM recs JOIN b USING (record_id)""")
def q84(spark, d):
    k = F.col("source_index")
    records = _records(spark, d)
    plan = (k % 3 + 1).cast("int").alias("plan_revision")
    decisions = records.select("record_id", F.when(k % 2 == 0, "approved_unchanged").otherwise("corrected").alias("disposition"), plan, (k % 10 >= 5).cast("int").alias("edits"), F.array(F.when(k % 11 == 0, F.lit("x0")).otherwise(F.concat(F.lit("x"), k))).alias("validation_ids"))
    renderings = records.select(F.concat(F.lit("n"), k).alias("rendering_id"), F.lit("draft").alias("kind"), plan)
    basis = V.basis_revision(_plans(spark, d), _decisions(spark, d).where("false"))
    results = _results(spark, d).where("validation_id <> 'x0'")
    return V.checked_decisions(decisions, basis, _plans(spark, d), results, renderings).select("record_id", "error")


@query("q85_current_decisions", "WITH v AS (SELECT 'v' || event_id AS decision_id, user_id, ts FROM events) SELECT decision_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, decision_id DESC) = 1 AS is_current FROM v")
def q85(spark, d):
    rows = _t(spark, d, "events").select(F.concat(F.lit("v"), "event_id").alias("decision_id"), F.col("user_id").alias("record_id"), F.col("ts").alias("created_at"))
    return V.superseded(rows).select("decision_id", "is_current")


@query("q86_eligibility", f"WITH {_found_sql()}, f AS (SELECT {_FINDING} AS finding_id, s FROM found) SELECT finding_id, s % 2 = 0 AS is_eligible FROM f")
def q86(spark, d):
    rows = _rule_findings(spark, d)
    return V.updated_eligibility(rows, rows.where("start % 2 = 1").select("finding_id", F.lit(False).alias("eligible")))[0].select("finding_id", "is_eligible")


@query("q87_review_timers", """WITH t AS (SELECT 'who' || (user_id % 7) AS reviewer_id, 'd' || (event_id % 30) AS record_id, date_trunc('second', ts) AS began, event_id, CASE event_type WHEN 'error' THEN 'pause' ELSE 'start' END AS kind FROM events),
  s AS (SELECT *, lead(began) OVER (PARTITION BY reviewer_id ORDER BY began, kind) AS until FROM t) SELECT record_id, reviewer_id, CAST(coalesce(sum(CASE WHEN kind = 'start' THEN epoch(until) - epoch(began) END), 0) AS BIGINT) AS seconds FROM s GROUP BY record_id, reviewer_id""")
def q87(spark, d):
    e = F.col("event_id")
    rows = _t(spark, d, "events").select("event_id", F.concat(F.lit("who"), F.col("user_id") % 7).alias("reviewer_id"), F.concat(F.lit("d"), e % 30).alias("record_id"), F.date_trunc("second", "ts").alias("at"), F.when(F.col("event_type") == "error", "pause").otherwise("start").alias("kind"), F.lit(None).cast("long").alias("seconds"))
    return V.review_seconds(rows)


@query("q88_decision_ids", "SELECT event_id, 'review_' || substr(sha256('[\"d' || event_id || '\",\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00\"]'), 1, 32) AS decision_id FROM events")
def q88(spark, d):
    return _t(spark, d, "events").select("event_id", V.decision_id(F.concat(F.lit("d"), "event_id"), F.col("ts").cast("timestamp")).alias("decision_id"))


# ---- input and export ----


@query("q89_export_rows", f"WITH {_RECORDS} SELECT record_id, source_index + 1 AS input_row_number, status AS deid_status, CASE WHEN source_index % 3 = 0 THEN 'text ' || source_index END AS final_text, CASE WHEN source_index % 2 = 0 THEN '[R_LOC]' ELSE lang END AS lang, lang AS raw_lang FROM recs")
def q89(spark, d):
    k = F.col("source_index")
    meta = lambda x: F.to_json(F.struct(x.alias("lang")))
    rows = _records(spark, d).withColumns({"metadata": meta(F.col("lang")), "final_metadata": F.when(k % 2 == 0, meta(F.lit("[R_LOC]"))), "final_rendering_id": F.when(k % 3 == 0, F.concat(F.lit("n"), k)), "raw_text": F.col("text")})
    texts = rows.where("source_index % 6 < 6").select(F.concat(F.lit("n"), k).alias("rendering_id"), F.concat(F.lit("text "), k).alias("rendered"))
    columns = R.export_columns(["record_id", "input_row_number", "final_text", "lang", "raw_lang"], ("lang",), ("lang",), "all_records")
    return R.export_rows(rows, texts, columns, "all_records")


@query("q90_input_records", f"WITH {_RECORDS}, {_STATES} SELECT record_id, recs.source_index, states.status AS input_status FROM recs JOIN states USING (record_id) WHERE stage = 'input'")
def q90(spark, d):
    return R.input_records(_records(spark, d), _states(spark, d)).select("record_id", "source_index", "input_status")


@query("q91_canonical_view", f"WITH {_RECORDS}, {_ERRORS} SELECT record_id, lang AS metadata_lang, recs.status AS pipeline_status, (SELECT count(*) FROM errs WHERE errs.record_id = recs.record_id) AS errors FROM recs")
def q91(spark, d):
    rows = R.normalize(_t(spark, d, "documents").withColumn("id", _id()), "id", "source", "text", ("lang",)).join(_records(spark, d).select("record_id", "status"), "record_id")
    return R.canonical_view(rows, _errors(spark, d)).select("record_id", F.col("metadata")["lang"].alias("metadata_lang"), "pipeline_status", F.size("stage_errors").cast("long").alias("errors"))


@query("q92_source_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_index FROM documents")
def q92(spark, d):
    return R.with_source_index(_t(spark, d, "documents").select("doc_id"), "doc_id")


@query("q93_repeated_ids", "SELECT CAST(user_id AS VARCHAR) AS record_id FROM events GROUP BY user_id HAVING count(*) > 1")
def q93(spark, d):
    return R.repeated_ids(_t(spark, d, "events").select(K.strip(F.concat(F.lit(" "), F.col("user_id"), F.lit("\t"))).alias("record_id")))


@query("q94_deterministic_ids", "SELECT doc_id, 'rec_' || substr(sha256('d' || doc_id || chr(31) || 'input' || chr(31) || (doc_id % 9)), 1, 24) AS id FROM documents")
def q94(spark, d):
    return _t(spark, d, "documents").select("doc_id", K.record_id("rec", _id(), "input", F.col("doc_id") % 9).alias("id"))


# ---- costs ----

_BACKENDS = [{"id": "service", "most_bytes": 1_000_000_000, "price_per_100": 0.01}, {"id": "model", "max_output_tokens": 8192, "input_price": 3.0, "output_price": 15.0}, {"id": "validator", "max_output_tokens": 4096, "twice": True, "input_price": 0.15}]
_PLAIN = "length(text) > 0 AND trim(text) <> ''"


@query("q39_cost_by_backend", f"""WITH t AS (SELECT length(text) AS n, length(CAST(to_json(text) AS VARCHAR)) AS j FROM documents WHERE {_PLAIN})
  SELECT 'service' AS backend_id, count(*) AS request_count, CAST(sum(n) AS BIGINT) AS input_characters, CAST(sum(greatest(1, ceil(n / 100.0))) AS BIGINT) AS units, CAST(NULL AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, round(sum(greatest(1, ceil(n / 100.0))) * 0.01, 6) AS total_cost FROM t
  UNION ALL SELECT 'model', count(*), CAST(sum(j) AS BIGINT), NULL, CAST(sum(ceil(j / 4.0)) AS BIGINT), count(*) * 8192, round(sum(ceil(j / 4.0)) * 3.0 / 1e6 + count(*) * 8192 * 15.0 / 1e6, 6) FROM t
  UNION ALL SELECT 'validator', count(*), CAST(sum(2 * j) AS BIGINT), NULL, CAST(sum(ceil(2 * j / 4.0)) AS BIGINT), count(*) * 4096, NULL FROM t""")
def q39(spark, d):
    return J.cost_by_backend(_t(spark, d, "documents").select("text"), _BACKENDS).withColumn("total_cost", F.bround("total_cost", 6)).drop("input_cost", "output_cost")


@query("q39b_cost_total", f"""WITH t AS (SELECT length(text) AS n, length(CAST(to_json(text) AS VARCHAR)) AS j FROM documents WHERE {_PLAIN}) SELECT round(sum(greatest(1, ceil(n / 100.0))) * 0.01 + sum(ceil(j / 4.0)) * 3.0 / 1e6, 6) AS input_cost, round(count(*) * 8192 * 15.0 / 1e6, 6) AS output_cost, round(sum(greatest(1, ceil(n / 100.0))) * 0.01 + sum(ceil(j / 4.0)) * 3.0 / 1e6 + count(*) * 8192 * 15.0 / 1e6, 6) AS total_cost FROM t""")
def q39b(spark, d):
    total = J.cost_total(J.cost_by_backend(_t(spark, d, "documents").select("text"), _BACKENDS[:2]))
    return total.select(*(F.bround(c, 6).alias(c) for c in total.columns))
