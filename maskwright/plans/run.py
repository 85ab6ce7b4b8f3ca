"""The life of a run: create, execute, resume, decide, status, retry, revise, export.

Tables live in a ``Ledger``: each step appends the rows that it changes, all of them in one commit or none, and finds its
work by its states. Counters of the ledger tell whether a stage has work and make up most of the report, so neither reads
records. Records are never passed through the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, DetectorSettings, parse_config
from ..functions import core as K
from ..functions import policy as P
from ..operators import control as J
from ..operators import ledger as L
from ..operators import reporting as M
from ..operators import review as V
from ..operators import spans as S
from ..operators import structured as X
from ..operators import surrogates as G
from ..operators import work as W
from ..sources import records as R
from ..sources.files import Files
from .ledger import Conflict, Head, Ledger, own_session

Detectors = dict[str, Callable[[], W.Detector]]

VALIDATOR = "validator"
#: Buckets of a run's tables: one for so many records, and no more than MOST_BUCKETS, as each commit may write a file to each.
RECORDS_A_BUCKET, MOST_BUCKETS = 5_000, 4_096

_SCHEMAS = {
    "records": "record_id string, entity_id string, text string, text_sha256 string, raw_text string, raw_sha256 string, changed boolean, repair string, excluded boolean, exclusion_code string, metadata string, source_index long",
    "status": "record_id string, status string, final_rendering_id string, final_metadata string, was string",
    "states": "record_id string, stage string, status string, attempts int, started_at timestamp, finished_at timestamp, was string",
    "errors": "error_id string, record_id string, stage string, error_class string, error_code string, message string, retryable boolean, resolved boolean, created_at timestamp, was_resolved boolean",
    "backends": "backend_id string, backend_kind string, settings string, prompt string, schema string, settings_sha256 string, prompt_sha256 string, schema_sha256 string, created_at timestamp",
    "work": "work_item_id string, record_id string, stage string, backend_id string, status string, chunk_index int, start int, end int, chunk string, settled int, rendering_id string",
    "attempts": "attempt_id string, work_item_id string, record_id string, backend_id string, backend_kind string, attempt_number int, status string, error_code string, message string, retryable boolean, systemic boolean, raw string, usage string, settings string, model_id string, stop_reason string, max_tokens int, started_at timestamp",
    "findings": "finding_id string, record_id string, source_kind string, source_name string, attempt_id string, category string, native_category string, subtype string, start int, end int, exact_text string, span_id string, confidence double, is_eligible boolean, ineligible_reason string, source_group_id string",
    "resolutions": "record_id string, revision int, digest string, reason string, created_at timestamp",
    "groups": "record_id string, revision int, group_id string, start int, end int, category string, finding_ids array<string>, original string",
    "plans": "record_id string, plan_revision int, purpose string, status string, resolution int, created_at timestamp",
    "renderings": "rendering_id string, record_id string, kind string, plan_revision int, rendered string, is_stale boolean, created_at timestamp",
    "validation_results": "validation_id string, record_id string, rendering_id string, status string, raw_violation boolean, effective_violation boolean, error_code string, message string, is_stale boolean, created_at timestamp",
    "validation_findings": "validation_finding_id string, validation_id string, record_id string, category string, evidence string, confidence string, rationale string, ignored_by_policy boolean",
    "review_decisions": "decision_id string, record_id string, disposition string, reviewer_id string, review_seconds long, basis_revision int, events string, created_at timestamp, is_current boolean, is_stale boolean",
    "timers": "event_id string, record_id string, reviewer_id string, at timestamp, kind string, seconds long, plan_revision int",
    "surrogates": G.ASSIGNED,
    "shifts": "entity_id string, weeks int",
    "structured_events": "record_id string, structured_event_id string, plan_revision int, purpose string, column_name string, category string, action string, original string, replacement string, error string",
    "exports": "export_id string, path string, format string, mode string, columns array<string>, rows long, sha256 string, status string, created_at timestamp",
}
_KEYS = {
    "records": ("record_id",), "status": ("record_id",), "states": ("record_id", "stage"), "errors": ("record_id", "error_id"), "backends": ("backend_id",), "work": ("record_id", "work_item_id"), "attempts": ("record_id", "attempt_id"), "findings": ("record_id", "finding_id"),
    "resolutions": ("record_id", "revision"), "groups": ("record_id", "revision", "group_id"), "plans": ("record_id", "plan_revision"), "renderings": ("record_id", "rendering_id"), "validation_results": ("record_id", "validation_id"), "validation_findings": ("record_id", "validation_finding_id"),
    "review_decisions": ("record_id", "decision_id"), "timers": ("record_id", "event_id"), "surrogates": ("assignment_id",), "shifts": ("entity_id",), "structured_events": ("record_id", "structured_event_id", "plan_revision"), "exports": ("export_id",),
}
_ERROR_KEY = ("stage", "error_class", "error_code", "message", "retryable")


def _error_key(resolved: str) -> Column:
    return F.when(F.col(resolved).isNotNull(), F.to_json(F.struct(F.col(resolved).alias("resolved"), *_ERROR_KEY), {"ignoreNullFields": "false"}))


_COUNTED = {"status": (F.col, "status", "was"), "states": (lambda c: F.concat("stage", F.lit("/"), c), "status", "was"), "errors": (_error_key, "resolved", "was_resolved")}


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in _SCHEMAS[name].split(", ")]


def run_id(name: str | None, at: datetime) -> str:
    clean = re.sub(r"[^A-Za-z0-9._-]+", "-", name or "").strip("-._")
    return at.strftime("%Y%m%dT%H%M%S") + (f"_{clean}" if clean else "")


class Stopped(RuntimeError):
    """A failure of a backend that concerns all calls; what was called is kept, the run is blocked."""


class Run:
    """A run's folder. ``detectors`` and ``validator`` make the callables of the configuration by name inside tasks."""

    def __init__(self, spark: SparkSession, folder: str | Path, detectors: Detectors | None = None, validator: Callable[[], W.Validator] | None = None, secrets: Callable[[str], str] | None = None, clock: Callable[[], datetime] | None = None):
        self.spark, self.folder = own_session(spark), str(folder)
        self.detectors, self.validator, self.secrets, self.clock = detectors or {}, validator, secrets, clock or (lambda: datetime.now(UTC))
        self.ledger = Ledger(self.spark, self.folder, _KEYS, {n: (make(now), make(was)) for n, (make, now, was) in _COUNTED.items()})
        self.head: Head = self.ledger.head()
        if not self.head.facts:
            raise FileNotFoundError(f"no run in {self.folder}")
        # a join of a bucketed table and another deals out the other alone, unless more partitions than buckets are wanted
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) > self.ledger.buckets:
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.ledger.buckets))

    # ---- tables ----

    @property
    def facts(self) -> dict[str, Any]:
        return self.ledger.head().facts

    @property
    def config(self) -> Config:
        return parse_config(self.head.facts["config"])

    @property
    def version(self) -> int:
        return self.ledger.head().version

    def stored(self, name: str) -> DataFrame:
        """A table as of this object's head; an empty one where none was written."""
        rows = self.ledger.read(self.head, name)
        return self.spark.createDataFrame([], _SCHEMAS[name]) if rows is None else rows

    def table(self, name: str) -> DataFrame:
        """The newest rows of a table; records with their status."""
        self.head = self.ledger.head()
        return self._records() if name == "records" else self.stored(name)

    def _records(self) -> DataFrame:
        return self.stored("records").join(self.stored("status").drop("was"), "record_id")

    def commit(self, **changes: DataFrame) -> None:
        """Appends changed rows, all or none; a column that a change lacks is null."""
        shaped = {n: df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _columns(n))) for n, df in changes.items()}
        self.head = self.ledger.commit(self.head, shaped)

    def _set(self, **facts: Any) -> None:
        self.head = self.ledger.commit(self.head, None, facts)

    @contextmanager
    def locked(self):
        with self.ledger.leased():
            self.head = self.ledger.head()
            try:
                yield
            finally:
                self.ledger.forget()

    def _keep(self, df: DataFrame) -> DataFrame:
        return self.ledger.kept(df)

    def _mine(self, rows: DataFrame) -> DataFrame:
        """rows of any session as rows of this run's."""
        return self.spark.createDataFrame([], rows.schema).unionByName(rows)

    def _now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp")

    def _count(self, name: str, *keys: str) -> int:
        return sum(self.head.counters.get(f"{name}:{k}", 0) for k in keys)

    # ---- life ----

    def execute(self) -> str:
        """Recovers what was interrupted, then runs the stages that have work; the run's status. A failure of a backend that
        concerns all calls and an interruption leave the run blocked, with its reason in the facts; any other failure
        leaves it failed."""
        with self.locked():
            self._set(status="running", blocked_by=None)
            try:
                self._recover()
                for stage in (self._detect, self._transform, self._validate, self._finalize):
                    stage()
                    self.ledger.forget()
                    self.ledger.renew()
                self._roll_up()
                self.head = self.ledger.compact(self.head)
            except Stopped as e:
                self._set(status="blocked", blocked_by=str(e))
            except KeyboardInterrupt:
                self._set(status="blocked", blocked_by="interrupted")
                raise
            except Conflict:
                raise
            except Exception:
                self._set(status="failed")
                raise
            return self.head.facts["status"]

    resume = execute

    def _recover(self) -> None:
        if not any(k.endswith("/running") for k in self.head.counters if k.startswith("states:")):
            return
        work, states, attempts = J.recovered(*(self.stored(t).where("status = 'running'") for t in ("work", "states", "attempts")))
        self.commit(work=work, states=states.withColumn("was", F.lit("running")), attempts=attempts)

    def _roll_up(self) -> None:
        """The run's and the stages' status, of the counters."""
        stages = {s: _stage_status({k: self._count("states", f"{s}/{k}") for k in K.STATE_STATUSES}) for s in K.STAGES}
        records = {k: self._count("status", k) for k in K.RECORD_STATUSES}
        self._set(status=_run_status(records, stages["finalization"]), stages=stages)

    def _open_count(self, stage: str) -> int:
        return self._count("states", f"{stage}/pending", f"{stage}/retry_pending")

    def _open(self, stage: str, *needs: str) -> DataFrame:
        """The records that a stage has to work on, in no order."""
        states = self.stored("states")
        rows = W.open_records(self._records(), states, stage)
        return rows.join(W.ready_for(states, needs), "record_id", "left_semi") if needs else rows

    def _moved(self, stage: str, outcome: DataFrame) -> DataFrame:
        """The changed states of a stage: outcome is (record_id, to), one row a record."""
        mine = self.stored("states").where(F.col("stage") == stage)
        changes = outcome.select("record_id", F.lit(stage).alias("stage"), "to", F.lit(True).alias("counts"))
        before = mine.join(outcome.select("record_id"), "record_id", "left_semi")
        return J.moved_state(before.withColumn("was", F.col("status")), changes, self._now())

    def _status(self, changes: DataFrame) -> DataFrame:
        """The changed rows of the status table: changes (record_id, status, final_rendering_id?, final_metadata?)."""
        met = self.stored("status").drop("was").withColumn("was", F.col("status"))
        wanted = changes.select("record_id", *((F.col(c) if c in changes.columns else F.lit(None).cast("string")).alias(c) for c in ("status", "final_rendering_id", "final_metadata")))
        return J.with_status(met.join(wanted.select("record_id"), "record_id", "left_semi"), wanted)

    def _failed(self, outcome: DataFrame) -> DataFrame:
        return self._status(outcome.where(F.col("to").isin(*J.FAILED)).select("record_id", F.lit("failed").alias("status")))

    def _new_errors(self, rows: DataFrame, stage: str) -> DataFrame:
        """Error rows (error_id, record_id, ...) that are not known, and those of the stage that a success resolves."""
        return W.appended(rows.withColumn("created_at", self._now()), self.stored("errors"), ["record_id", "error_id"])

    def _resolved(self, outcome: DataFrame, stage: str) -> DataFrame:
        """Open errors of a stage, of the records that now succeed, as resolved."""
        mine = self.stored("errors").where((F.col("stage") == stage) & ~F.col("resolved")).withColumn("was_resolved", F.lit(False))
        good = outcome.where("to = 'succeeded'").select("record_id")
        return J.resolved(mine.join(good, "record_id", "left_semi"), stage)

    def _register(self, rows: list[tuple[str, str, str]]) -> None:
        """Notes each backend (id, kind, settings); one that is known by other settings is refused."""
        made = self.spark.createDataFrame(rows, "backend_id string, backend_kind string, settings string").withColumns({"prompt": F.lit(None).cast("string"), "schema": F.lit(None).cast("string")})
        known = self.stored("backends")
        checked = W.registered(made, known).collect()  # a row for each backend of a configuration
        changed = [r["backend_id"] for r in checked if r["error"]]
        if changed:
            raise ValueError(f"backends changed since they were first called: {', '.join(changed)}")
        have = {r["backend_id"] for r in known.select("backend_id").collect()}
        if any(r["backend_id"] not in have for r in checked):
            self.commit(backends=W.appended(W.registered(made), known, ["backend_id"]).withColumn("created_at", self._now()))

    # ---- detection ----

    def _detect(self) -> None:
        config, rid = self.config, self.head.facts["run_id"]
        if not self._open_count("detection"):
            return
        self._register([(d.name, "detector", _settings(d)) for d in config.detectors])
        records = self._keep(self._open("detection", "input"))  # calls and their outcome change no states
        for d in config.detectors:
            self._plan_calls(d, records)
            self._call_and_settle(d)
        changes: dict[str, DataFrame] = {}
        if config.detectors:
            work = self.stored("work").where("stage = 'detection'").join(records.select("record_id"), "record_id", "left_semi")
            outcome = L.record_status(work).withColumnRenamed("status", "to")
            # texts without characters make no work
            outcome = self._keep(outcome.unionByName(records.join(work.select("record_id"), "record_id", "left_anti").select("record_id", F.lit("succeeded").alias("to"))))
        else:
            outcome = records.select("record_id", F.lit("succeeded").alias("to"))
        if config.rules:
            good = records.join(outcome.where("to = 'succeeded'"), "record_id", "left_semi")
            new = W.findings(S.rule_findings(good, list(config.rules)), rid, "rule", "embedded_rules")
            changes["findings"] = W.appended(new, self.stored("findings"), ["record_id", "finding_id"])
        self.commit(states=self._moved("detection", outcome), status=self._failed(outcome), errors=self._resolved(outcome, "detection"), **changes)

    def _plan_calls(self, d: DetectorSettings, records: DataFrame) -> None:
        items = W.work_items(W.chunk_plan(records, d.most_bytes if d.kind == "service" else None, d.overlap), self.head.facts["run_id"], d.name)
        items = items.withColumns({"stage": F.lit("detection"), "settled": F.lit(0)})
        self.commit(work=W.appended(items, self.stored("work"), ["record_id", "work_item_id"]))

    def _unsettled(self, backend: str) -> DataFrame:
        """Attempts whose outcome their work item does not show yet; of an item the last."""
        work = self.stored("work").where(F.col("backend_id") == backend).select("record_id", "work_item_id", "settled")
        rows = self.stored("attempts").where((F.col("backend_id") == backend) & (F.col("status") != "cancelled")).join(work, ["record_id", "work_item_id"])
        return rows.where("attempt_number > settled").drop("settled")

    def _todo(self, backend: str) -> DataFrame:
        """Open work items that no attempt waits to be settled for."""
        work = self.stored("work").where((F.col("backend_id") == backend) & F.col("status").isin("pending", "retry_pending"))
        return work.join(self._unsettled(backend).select("record_id", "work_item_id"), ["record_id", "work_item_id"], "left_anti")

    def _call(self, backend: str, kind: str, settings: str, calls) -> bool:
        """Makes calls, a with block of (attempts, permits), and keeps their attempts at once; whether they were stopped."""
        with calls as (attempts, held):
            made = W.numbered_attempts(attempts, self.head.facts["run_id"], self.stored("attempts").where(F.col("backend_id") == backend))
            self.commit(attempts=made.withColumns({"backend_id": F.lit(backend), "backend_kind": F.lit(kind), "settings": F.lit(settings), "model_id": F.get_json_object("raw", "$.model_id"), "started_at": self._now()}))
            return held.stopped

    def _call_and_settle(self, d: DetectorSettings) -> None:
        todo = self._keep(self._todo(d.name))
        stopped = False
        if not todo.isEmpty():
            if self.head.facts.get("plan", {}).get("detection", [""])[0] == "reuse":
                raise ValueError(f"{d.name} would be called again, against the revision's plan")
            if d.name not in self.detectors:
                raise ValueError(f"no detector named {d.name} is given")
            stopped = self._call(d.name, "detector", _settings(d), W.call_detector(todo, self.detectors[d.name], self.config.workers))
        self._settle(d)
        if stopped:
            raise Stopped(f"{d.name} stopped all calls")

    def _settle(self, d: DetectorSettings) -> None:
        """Turns attempts into findings, errors and the state of their work. Answers are read by kind: entities of a service,
        findings of a model."""
        made, work = self._keep(self._unsettled(d.name)), self.stored("work").where(F.col("backend_id") == d.name)
        entities = F.get_json_object("raw", "$.Entities").isNotNull() & F.lit(d.kind == "service")
        model, service = self._keep(W.parse_answers(made.where(~F.coalesce(entities, F.lit(False))), work)), W.map_service_answers(made.where(entities), work)
        if d.kind == "service":
            service = self._keep(service)
        item = ["record_id", "work_item_id"]  # the tables lie by record_id
        bad = W.answers_failed(model, *item).unionByName(service.where("error is not null").groupBy(*item).agg(F.first("error").alias("error")))
        answers = model.unionByName(service).join(bad.select(*item), item, "left_anti")
        new = W.findings(answers, self.head.facts["run_id"], d.source_kind, d.name, d.min_confidence)
        failed = made.join(bad, item).withColumns({"status": F.lit("permanent_error"), "error_code": F.lit("bad_answer"), "message": F.col("error"), "retryable": F.lit(False)}).drop("error")
        errors = W.error_rows(made.unionByName(failed), "detection")
        done = made.join(bad, item, "left").select("record_id", "work_item_id", "attempt_number", F.when(F.col("error").isNotNull(), "permanent_error").otherwise(W.work_status(F.col("status"), F.lit(1))).alias("now"))
        settled = work.join(done, item).withColumns({"status": F.col("now"), "settled": F.col("attempt_number")})
        self.commit(work=settled, findings=W.appended(new, self.stored("findings"), ["record_id", "finding_id"]), errors=self._new_errors(errors, "detection"))

    # ---- transformation ----

    def _resolved_groups(self, findings: DataFrame, records: DataFrame, reason: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(resolutions, groups, records with the resolution that is now theirs) of records and their findings."""
        mine = self._keep(findings.where("is_eligible").join(records.select("record_id"), "record_id", "left_semi"))
        digests = records.select("record_id").join(S.findings_digest(mine), "record_id", "left").select("record_id", F.coalesce("digest", F.lit(S.EMPTY_DIGEST)).alias("digest"))
        next_ = self._keep(J.next_revisions(digests, self.stored("resolutions")))
        fresh = next_.where("is_new").select("record_id", "revision", "digest", F.lit(reason).alias("reason"), self._now().alias("created_at"))
        groups = self._keep(V.with_original(S.resolve_linked(mine, records), records).join(fresh.select("record_id", "revision"), "record_id"))
        return fresh, groups, next_.select("record_id", "revision")

    def _next_plans(self, resolutions: DataFrame, purpose: str) -> tuple[DataFrame, DataFrame]:
        """(changed rows of plans, the new ones) for records (record_id, revision)."""
        plans = self.stored("plans")
        last = plans.groupBy("record_id").agg(F.max("plan_revision").alias("last"))
        new = resolutions.join(last, "record_id", "left").select("record_id", (F.coalesce("last", F.lit(0)) + 1).alias("plan_revision"), F.lit(purpose).alias("purpose"), F.lit("active").alias("status"), F.col("revision").alias("resolution"), self._now().alias("created_at"))
        old = plans.where((F.col("purpose") == purpose) & (F.col("status") == "active")).join(resolutions.select("record_id"), "record_id", "left_semi").withColumn("status", F.lit("stale"))
        return old.unionByName(new), new

    def _renderings(self, texts: DataFrame, plans: DataFrame, kind: str) -> DataFrame:
        """The new rendering of each record, of its new plan, and its older ones of the kind as stale."""
        made = texts.where("error is null").join(plans.select("record_id", "plan_revision"), "record_id")
        made = made.select(J.rendering_id(F.col("record_id"), F.col("plan_revision"), F.lit(kind)).alias("rendering_id"), "record_id", F.lit(kind).alias("kind"), "plan_revision", "rendered", F.lit(False).alias("is_stale"), self._now().alias("created_at"))
        old = self.stored("renderings").where((F.col("kind") == kind) & ~F.col("is_stale")).join(plans.select("record_id"), "record_id", "left_semi").withColumn("is_stale", F.lit(True))
        return old.unionByName(made)

    def _transform(self) -> None:
        if not self._open_count("transformation"):
            return
        records = self._keep(self._open("transformation", "input", "detection"))
        if records.isEmpty():
            return
        resolutions, groups, current = self._resolved_groups(self.stored("findings"), records, "detection")
        # groups of a resolution that stays are read, new ones are made
        kept = self.stored("groups").join(current, ["record_id", "revision"], "left_semi")
        drafts = self._keep(S.render(records, S.plan(groups.select(*kept.columns).unionByName(kept), self.config.policy, "draft")))
        changed, plans = self._next_plans(current, "draft")
        outcome = drafts.select("record_id", F.when(F.col("error").isNull(), "succeeded").otherwise("permanent_error").alias("to"))
        events = self._structured(records, plans, "draft")
        errors = self._new_errors(self._render_errors(drafts, "transformation"), "transformation").unionByName(self._resolved(outcome, "transformation"), allowMissingColumns=True)
        surrogates = events.pop("assigned", None)
        self.commit(states=self._moved("transformation", outcome), status=self._failed(outcome), resolutions=resolutions, groups=groups, plans=changed, renderings=self._renderings(drafts, plans, "draft"), errors=errors, **events, **({"surrogates": surrogates} if surrogates is not None else {}))

    def _render_errors(self, rows: DataFrame, stage: str) -> DataFrame:
        return rows.where("error is not null").select(K.content_id("error", K.json_string(F.col("record_id")), K.json_string(F.lit(stage)), K.json_string(F.col("error"))).alias("error_id"), "record_id", F.lit(stage).alias("stage"), F.lit("record").alias("error_class"), F.col("error").alias("error_code"), F.col("error").alias("message"), F.lit(False).alias("retryable"), F.lit(False).alias("resolved"))

    # ---- surrogates, dates, structured fields ----

    def _secret(self) -> bytes:
        return G.resolve_secret(self.config.secret_reference, self.secrets)

    def _weeks(self, records: DataFrame, secret: bytes) -> tuple[Column, DataFrame]:
        """(the weeks by which a record's dates move, shifts that are not stored yet). A stored shift that differs, as another
        secret would give, is refused."""
        weeks = K.date_shift_weeks(secret, G.DATES, F.col("entity_id"), -52, 52)
        shifts = G.date_shifts(records, secret, stored=self.stored("shifts"))
        clash = [r["entity_id"] for r in shifts.where("error is not null").limit(5).collect()]
        if clash:
            raise ValueError(f"dates of these entities have moved by other weeks before: {', '.join(clash)}")
        return weeks, shifts.join(self.stored("shifts").select("entity_id"), "entity_id", "left_anti").select("entity_id", "weeks")

    def _assigned(self, asked: DataFrame, secret: bytes) -> tuple[DataFrame, DataFrame]:
        """(new assignments, requests with their surrogate), category by category of the policy."""
        config, stored = self.config, self.stored("surrogates")
        new = given = None
        for c, (a, s) in config.policy.items():
            if a != "surrogate" or c == "DATE":
                continue
            values = config.surrogate_values.get(c) if s == "list" else None
            keyed = G.keyed(asked.where(F.col("category") == c), secret, config.consistency, "custom_list" if values else "synthetic")
            made = G.assign(keyed, values, stored.where(F.col("category") == c))
            met = keyed.join(made.select("assignment_id", "surrogate"), "assignment_id").select("event_id", "surrogate")
            rows = W.appended(made.where("error is null"), stored, ["assignment_id"])
            given, new = (met, rows) if given is None else (given.unionByName(met), new.unionByName(rows))
        return new, given

    def _typed(self) -> Column:
        """The metadata of a record with the types of the input."""
        return F.from_json("metadata", self.head.facts["metadata_schema"])

    def _structured(self, records: DataFrame, plans: DataFrame, purpose: str) -> dict[str, DataFrame]:
        """The tables with the structured events of records under their new plans, and what they take."""
        config = self.config
        mapping = config.input.structured
        if not mapping:
            return {}
        wide = records.withColumn("m", self._typed()).select("record_id", "entity_id", "source_index", *(F.col(f"m.`{c}`").alias(c) for c in mapping))
        surrogates = weeks = None
        out: dict[str, DataFrame] = {}
        wanted = {c for c in mapping.values() if config.policy[c][0] == "surrogate"}
        if wanted:
            secret = self._secret()
            if "DATE" in wanted:
                weeks, out["shifts"] = self._weeks(records, secret)
            if wanted - {"DATE"}:
                asked = X.surrogate_requests(wide, mapping, config.policy, "source_index")
                new, given = self._assigned(asked.withColumn("ordinal", F.struct(F.col("ordinal").alias("source_index"), F.lit(0).alias("start"))), secret)
                surrogates, out["assigned"] = asked.join(given, "event_id").select("record_id", "column_name", "surrogate"), new
        events = X.structured_events(wide, mapping, config.policy, weeks, surrogates)
        return out | {"structured_events": events.join(plans.select("record_id", "plan_revision"), "record_id").withColumn("purpose", F.lit(purpose))}

    def _final_metadata(self, records: DataFrame, events: DataFrame) -> DataFrame:
        """(record_id, final_metadata): the metadata of records, of which mapped columns hold their events' replacements and
        all others keep their values and types."""
        config = self.config
        if not config.input.structured:
            return records.select("record_id", F.col("metadata").alias("final_metadata"))
        per = events.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "replacement"))).alias("new"))
        value = lambda c: F.when(F.map_contains_key("new", F.lit(c)), F.try_element_at("new", F.lit(c))) if c in config.input.structured else F.col(f"m.`{c}`")
        met = records.withColumn("m", self._typed()).join(per, "record_id", "left")
        return met.select("record_id", F.to_json(F.struct(*(value(c).alias(c) for c in config.input.metadata)), {"ignoreNullFields": "false"}).alias("final_metadata"))

    # ---- validation ----

    def _validate(self) -> None:
        config = self.config
        if not config.validation:
            waiting = self.stored("states").where("stage = 'review' and status = 'pending'")
            if config.review and self._count("states", "review/pending"):
                ready = W.ready_for(self.stored("states"), ("input", "detection", "transformation"))
                self.commit(**self._routed(W.routing_without_validation(waiting.join(ready, "record_id", "left_semi"), config.review_all)))
            return
        if not self._open_count("validation"):
            return
        settings = json.dumps({"tiers": W.VALIDATION_TIERS})
        self._register([(VALIDATOR, VALIDATOR, settings)])
        records, rid = self._open("validation", "input", "detection", "transformation"), self.head.facts["run_id"]
        drafts = J.current_renderings(self.stored("renderings"), "draft").select("record_id", "rendering_id", "rendered")
        pairs = records.join(drafts, "record_id")
        whole = pairs.select("record_id", F.lit(0).alias("chunk_index"), F.lit(0).alias("start"), F.length("rendered").alias("end"), F.col("rendered").alias("chunk"), "rendering_id")
        items = W.work_items(whole, rid, VALIDATOR).withColumns({"stage": F.lit("validation"), "settled": F.lit(0), "chunk": F.lit(None).cast("string")})
        self.commit(work=W.appended(items, self.stored("work"), ["record_id", "work_item_id"]))
        cut = W.truncations(self.stored("attempts").where(F.col("backend_id") == VALIDATOR).withColumnRenamed("record_id", "r"))
        texts = pairs.select("record_id", "rendering_id", F.col("text").alias("original_text"), F.col("rendered").alias("deidentified_text"))
        todo = self._todo(VALIDATOR).select("record_id", "work_item_id", "rendering_id").join(texts, ["record_id", "rendering_id"]).join(cut, "work_item_id", "left").withColumn("truncations", F.coalesce("truncations", F.lit(0)))
        stopped = False
        if not todo.isEmpty():
            if self.validator is None:
                raise ValueError("no validator is given")
            stopped = self._call(VALIDATOR, VALIDATOR, settings, W.call_validator(todo, self.validator, config.workers))
        self._settle_validation()
        if stopped:
            raise Stopped("the validator stopped all calls")

    def _settle_validation(self) -> None:
        """Turns the validator's attempts into results, their findings, errors, states and the route to review. A result
        stands for each record whose last attempt ended: one that failed has the reason instead of a verdict."""
        config = self.config
        work = self.stored("work").where(F.col("backend_id") == VALIDATOR)
        open_, rendering = self._unsettled(VALIDATOR), work.select("record_id", "work_item_id", "rendering_id")
        mine = self.stored("attempts").where(F.col("backend_id") == VALIDATOR).join(open_.select("work_item_id", "record_id").distinct(), ["record_id", "work_item_id"], "left_semi").join(rendering, ["record_id", "work_item_id"])
        newest = F.max_by(F.struct("attempt_number", "status", "raw", "error_code", "message", "rendering_id", "work_item_id", "attempt_id"), "attempt_number")
        last = mine.groupBy("record_id").agg(newest.alias("x")).select("record_id", "x.*")
        said = W.parse_verdicts(last)
        bad = said.where("error is not null").select("record_id", F.lit(True).alias("bad")).distinct()
        ended = W.validation_outcome(mine).join(bad, "record_id", "left").select("record_id", F.when(F.col("bad"), "permanent_error").otherwise(F.col("status")).alias("to"), F.when(F.col("bad"), "technical_error").otherwise(F.col("result")).alias("result"), "bad")
        found = said.where("error is null and category is not null")
        verdicts = W.verdict(ended.where("result = 'succeeded'"), found, config.policy)
        key = K.content_id("validation", K.json_string(F.col("record_id")), K.json_string(F.col("rendering_id")))
        results = ended.where("result is not null").join(last.select("record_id", "rendering_id", "error_code", "message"), "record_id").join(verdicts, "record_id", "left")
        results = results.select(key.alias("validation_id"), "record_id", "rendering_id", F.col("result").alias("status"), "raw_violation", "effective_violation", F.when(F.col("bad"), "bad_answer").otherwise(F.col("error_code")).alias("error_code"), "message", F.lit(False).alias("is_stale"), self._now().alias("created_at"))
        rows = W.validation_findings(found.join(results.where("status = 'succeeded'").select("record_id", "validation_id", "rendering_id"), "record_id"), self.head.facts["run_id"], "rendering_id", config.policy)
        errors = W.error_rows(last.join(ended.where("`to` <> 'retry_pending'").select("record_id", "bad"), "record_id").withColumns({"status": F.when(F.col("bad"), "permanent_error").otherwise(F.col("status")), "error_code": F.when(F.col("bad"), "bad_answer").otherwise(F.col("error_code")), "retryable": F.col("status").isin("retryable_error", "truncated")}), "validation")
        settled = work.join(last.select("record_id", "work_item_id", "attempt_number"), ["record_id", "work_item_id"]).join(ended.select("record_id", "to"), "record_id").withColumns({"status": F.col("to"), "settled": F.col("attempt_number")})
        over = ended.where("`to` <> 'retry_pending'").select("record_id", "to")
        route = self._routed(W.review_routing(verdicts, config.review and config.review_all))
        self.commit(
            work=settled, validation_results=results, validation_findings=rows, errors=self._new_errors(errors, "validation").unionByName(self._resolved(over, "validation"), allowMissingColumns=True),
            states=self._moved("validation", over).unionByName(route["states"]), status=self._failed(over).unionByName(route["status"]),
        )

    def _routed(self, routing: DataFrame) -> dict[str, DataFrame]:
        """The changed states and statuses of records that go to review or past it."""
        return {"states": self._moved("review", routing.select("record_id", F.col("review_state").alias("to"))), "status": self._status(routing.select("record_id", F.col("record_status").alias("status")))}

    # ---- review ----

    def view(self, record_id: str) -> dict[str, DataFrame]:
        """What a reviewer sees of a record, and the revision that a decision refers to."""
        tables = {t: self.table(t) for t in ("records", "findings", "groups", "validation_results", "validation_findings", "renderings", "structured_events", "plans")}
        if tables["records"].where(F.col("record_id") == record_id).isEmpty():
            raise KeyError(f"no such record: {record_id}")
        tables["groups"] = J.active(tables["groups"])
        tables["structured_events"] = J.active(tables["structured_events"], "plan_revision")
        return V.record_view(tables, record_id) | {"basis": V.basis_revision(tables["plans"].where(F.col("record_id") == record_id), self.stored("review_decisions"))}

    def timer(self, record_id: str, reviewer_id: str, kind: str, seconds: int | None = None) -> None:
        """Starts, pauses or sets a reviewer's timer for a record; a start anywhere ends the reviewer's one before."""
        if kind not in ("start", "pause", "set") or (kind == "set") != (seconds is not None) or (seconds or 0) < 0:
            raise ValueError("a timer starts, pauses, or is set to seconds")
        with self.locked():
            basis = V.basis_revision(self.stored("plans").where(F.col("record_id") == record_id), self.stored("review_decisions")).first()
            if basis is None:
                raise KeyError(f"no such record under review: {record_id}")
            row = [(f"{self.head.version + 1}", record_id, reviewer_id, self.clock(), kind, seconds, basis["revision"])]
            self.commit(timers=self.spark.createDataFrame(row, _SCHEMAS["timers"]))

    def workspaces(self) -> DataFrame:
        """(record_id, reviewer_id, seconds, running, is_fresh) of all timers."""
        return V.workspaces(self.table("timers"), V.basis_revision(self.stored("plans"), self.stored("review_decisions")))

    def decide(self, decisions: DataFrame, edits: DataFrame | None = None, fields: DataFrame | None = None) -> int:
        """Review decisions (record_id, disposition, reviewer_id, review_seconds, plan_revision?, validation_ids?), one a
        record, with the edits of corrections: spans (record_id, op, group_id, finding_ids, start, end, category, text)
        and structured fields (record_id, column_name, category, original, value). The version that they made.

        A decision without a plan_revision refers to the newest; one that refers to an older is refused, as are corrections
        without edits and edits that do not fit. Findings, the new resolution, plan and rendering, the decision and the
        states go in together or not at all."""
        with self.locked():
            plans, groups = self.stored("plans"), J.active(self.stored("groups"))
            basis = V.basis_revision(plans, self.stored("review_decisions"))
            edits = self._keep(self._edits(edits, V.SPAN_EDIT))
            fields = self._keep(self._edits(fields, V.FIELD_EDIT))
            given = self._keep(self._with_basis(self._mine(decisions), basis, edits, fields))
            active = J.active(self.stored("structured_events"), "plan_revision")
            spans = self._keep(V.checked_edits(edits, groups.join(given.select("record_id"), "record_id", "left_semi"), self.stored("records")))
            values = V.checked_fields(fields, active)
            self._refuse(given, basis, plans, spans, values)
            now = self._now()
            new = given.select(V.decision_id(F.col("record_id"), now).alias("decision_id"), "record_id", "disposition", "reviewer_id", F.col("review_seconds").cast("long").alias("review_seconds"), F.col("plan_revision").alias("basis_revision"), F.lit(True).alias("is_current"), F.lit(False).alias("is_stale"), now.alias("created_at"))
            said = spans.select("record_id", F.to_json(F.struct("op", "group_id", "start", "end", "category", "text")).alias("event")).unionByName(values.select("record_id", F.to_json(F.struct("column_name", "original", "value")).alias("event")))
            new = new.join(said.groupBy("record_id").agg(F.to_json(F.array_sort(F.collect_list("event"))).alias("events")), "record_id", "left")
            old = self.stored("review_decisions").where("is_current").join(given.select("record_id"), "record_id", "left_semi").withColumn("is_current", F.lit(False))
            over = given.select("record_id", F.when(F.col("disposition") == "excluded", "excluded").otherwise("succeeded").alias("to"))
            states = self._moved("review", over)
            for stage in ("finalization", "export"):
                states = states.unionByName(self._moved(stage, over.where("`to` = 'excluded'")))
            status = self._status(given.select("record_id", F.when(F.col("disposition") == "excluded", "excluded").otherwise("reviewed").alias("status")))
            self.commit(review_decisions=old.unionByName(new, allowMissingColumns=True), states=states, status=status, **self._corrections(given.where("disposition = 'corrected'"), spans, values, active))
            return self.head.version

    def _edits(self, rows: DataFrame | None, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        return empty if rows is None else empty.unionByName(rows.select(*(c for c in empty.columns if c in rows.columns)), allowMissingColumns=True)

    def _with_basis(self, decisions: DataFrame, basis: DataFrame, edits: DataFrame, fields: DataFrame) -> DataFrame:
        n = edits.select("record_id").unionByName(fields.select("record_id")).groupBy("record_id").agg(F.count("*").cast("int").alias("edits"))
        times = decisions.groupBy("record_id").agg(F.count("*").alias("times"))
        rows = decisions.join(times, "record_id").join(n, "record_id", "left").join(basis, "record_id", "left")
        revision = F.coalesce("plan_revision", "revision") if "plan_revision" in decisions.columns else F.col("revision")
        ids = F.col("validation_ids") if "validation_ids" in decisions.columns else F.lit(None).cast("array<string>")
        return rows.select("record_id", "disposition", "reviewer_id", "review_seconds", revision.cast("int").alias("plan_revision"), F.coalesce("edits", F.lit(0)).alias("edits"), ids.alias("validation_ids"), "times")

    def _refuse(self, given: DataFrame, basis: DataFrame, plans: DataFrame, spans: DataFrame, values: DataFrame) -> None:
        """Raises with the first few reasons for which decisions cannot be taken."""
        waiting = self.stored("states").where("stage = 'review' and status = 'review_pending'").select("record_id")
        strays = given.join(waiting, "record_id", "left_anti").select("record_id", F.lit("no review is pending").alias("error"))
        twice = given.where("times > 1").select("record_id", F.lit("repeated_record").alias("error")).distinct()
        wrong = V.checked_decisions(given.drop("times"), basis, plans, self.stored("validation_results"), self.stored("renderings")).where("error is not null").select("record_id", "error")
        lost = spans.select("record_id").unionByName(values.select("record_id")).distinct().join(given.select("record_id"), "record_id", "left_anti").select("record_id", F.lit("edits_without_decision").alias("error"))
        rows = strays
        for more in (twice, wrong, lost, spans.where("error is not null").select("record_id", "error"), values.where("error is not null").select("record_id", "error")):
            rows = rows.unionByName(more)
        found = rows.limit(5).collect()
        if found:
            raise ValueError("refused: " + "; ".join(sorted(f"{r['record_id']}: {r['error']}" for r in found)))

    def _corrections(self, corrected: DataFrame, spans: DataFrame, values: DataFrame, active: DataFrame) -> dict[str, DataFrame]:
        """The changed tables of corrected records: findings, resolution, groups, draft plan, its rendering, its fields."""
        rid = self.head.facts["run_id"]
        mine = spans.join(corrected.select("record_id", "reviewer_id"), "record_id")
        records = self._keep(self._records().join(corrected.select("record_id"), "record_id", "left_semi"))
        before = self._keep(self.stored("findings").join(corrected.select("record_id"), "record_id", "left_semi"))
        gone = mine.where("op in ('remove', 'modify')").select("record_id", F.explode("finding_ids").alias("finding_id")).distinct()
        removed = before.join(gone, ["record_id", "finding_id"], "left_semi").withColumns({"is_eligible": F.lit(False), "ineligible_reason": F.lit("removed by review")})
        added = V.review_findings(mine, rid)
        after = before.join(removed.select("record_id", "finding_id"), ["record_id", "finding_id"], "left_anti").unionByName(added, allowMissingColumns=True)
        resolutions, groups, current = self._resolved_groups(after, records, "review correction")
        kept = self.stored("groups").join(current, ["record_id", "revision"], "left_semi")
        changed, plans = self._next_plans(current, "draft")
        drafts = self._keep(S.render(records, S.plan(groups.select(*kept.columns).unionByName(kept), self.config.policy, "draft")))
        events = X.overridden(active.join(corrected.select("record_id"), "record_id", "left_semi").drop("plan_revision"), values.where("error is null")).join(plans.select("record_id", "plan_revision"), "record_id")
        results = self.stored("validation_results").where("not is_stale").join(resolutions.select("record_id"), "record_id", "left_semi").withColumn("is_stale", F.lit(True))
        return {"validation_results": results, "findings": removed.unionByName(added, allowMissingColumns=True), "resolutions": resolutions, "groups": groups, "plans": changed, "renderings": self._renderings(drafts, plans, "draft"), "structured_events": events.withColumn("purpose", F.lit("draft"))}

    # ---- finalization ----

    def _finalize(self) -> None:
        config = self.config
        if not self._open_count("finalization"):
            return
        records = self._open("finalization", "input", "detection", "transformation")
        decisions = M.current_decisions(self.stored("review_decisions")).select("record_id", "disposition")
        results = self.stored("validation_results").where("not is_stale").select("record_id", F.col("effective_violation").alias("violation"))
        rows = records.join(decisions, "record_id", "left").join(results, "record_id", "left").withColumn("transformed", F.lit(True))
        ready = self._keep(L.finalization_gate(rows, config.validation, config.review and config.review_all).where("may_finalize").drop("disposition", "violation", "transformed", "may_finalize"))
        if ready.isEmpty():
            return
        active = J.active(self.stored("resolutions")).select("record_id", "revision").join(ready.select("record_id"), "record_id", "left_semi")
        groups = self.stored("groups").join(active, ["record_id", "revision"], "left_semi")
        changes: dict[str, DataFrame] = {}
        wanted = [c for c, (a, _) in config.policy.items() if a == "surrogate"]
        if wanted:
            secret = self._secret()
            met = groups.join(ready.select("record_id", "entity_id", "source_index"), "record_id")
            if "DATE" in wanted:
                weeks, changes["shifts"] = self._weeks(ready, secret)
                met = met.withColumn("weeks", weeks)
            if set(wanted) - {"DATE"}:
                asked = met.where(F.col("category").isin(*[c for c in wanted if c != "DATE"])).select(F.col("group_id").alias("event_id"), "record_id", "entity_id", "category", F.col("original").alias("original_text"), F.struct("source_index", "start").alias("ordinal"))
                changes["surrogates"], given = self._assigned(asked, secret)
                met = met.join(given.select(F.col("event_id").alias("group_id"), "surrogate"), "group_id", "left")
            groups = met
        finals = self._keep(S.render(ready, S.plan(groups, config.policy, "final")))
        changed, plans = self._next_plans(active, "final")
        drafts = J.active(self.stored("structured_events"), "plan_revision")  # what the last draft, or a correction of it, says
        events = drafts.join(ready.select("record_id"), "record_id", "left_semi").drop("plan_revision", "purpose").join(plans.select("record_id", "plan_revision"), "record_id").withColumn("purpose", F.lit("final"))
        metadata = self._final_metadata(ready, events)
        renderings = self._renderings(finals, plans, "final")
        done = renderings.where("not is_stale").join(metadata, "record_id").select("record_id", F.lit("ready").alias("status"), F.col("rendering_id").alias("final_rendering_id"), "final_metadata")
        outcome = finals.select("record_id", F.when(F.col("error").isNull(), "succeeded").otherwise("permanent_error").alias("to"))
        errors = self._new_errors(self._render_errors(finals, "finalization"), "finalization").unionByName(self._resolved(outcome, "finalization"), allowMissingColumns=True)
        failed = outcome.where("`to` <> 'succeeded'").select("record_id", F.lit("failed").alias("status"))
        if config.input.structured:
            changes["structured_events"] = events
        self.commit(states=self._moved("finalization", outcome), status=self._status(done.unionByName(failed, allowMissingColumns=True)), plans=changed, renderings=renderings, errors=errors, **changes)

    # ---- control ----

    def retry(self, record_id: str | None = None, stage: str | None = None, failed: bool = False) -> int:
        """Opens failed work again, from the earliest failed stage on; the number of records."""
        with self.locked():
            states, skipped = self.stored("states"), self.config.skipped
            targets = self._keep(J.retry_targets(states, record_id, stage, failed))
            n = targets.count()
            if not n:
                raise ValueError("nothing to retry")
            hit = targets.select("record_id")
            mine = lambda t: self.stored(t).join(hit, "record_id", "left_semi")
            back = mine("status").select("record_id", F.lit("processing").alias("status"), F.col("status").alias("was"))
            stale = {t: J.staled(mine(t), t, targets).where("is_stale") for t in ("validation_results", "review_decisions", "renderings")}
            # a draft that is not made anew is still what validation and review look at
            again = targets.where(F.col("stage").isin("input", "detection", "transformation")).select("record_id")
            drafts = stale["renderings"].where("kind = 'draft'").join(again, "record_id", "left_semi")
            stale["renderings"] = stale["renderings"].where("kind <> 'draft'").unionByName(drafts)
            self.commit(states=J.reset_states(mine("states").withColumn("was", F.col("status")), targets, skipped).where("status <> was or finished_at is null"), work=J.reset_work(mine("work"), targets).where("status = 'retry_pending'"), status=back, **stale)
            self._set(status="blocked", blocked_by="retry")
            return n

    def revise(self, config: Config, reason: str, allow_paid: bool = False) -> Run:
        """A child run over the same input. Detector calls of the parent that can be used again are copied under the child's
        ids, so that the child makes none."""
        if not reason.strip():
            raise ValueError("a revision has a reason")
        config = config.embedded()
        whole = False
        self.head = self.ledger.head()
        if config.detectors:
            backends = self.spark.createDataFrame([(d.name,) for d in config.detectors], "backend string")
            work = self.stored("work").where("stage = 'detection'").withColumnRenamed("backend_id", "backend")
            whole = bool(L.reusable(work, self._records().where("status <> 'excluded'"), backends).first()["reusable"])
        plan = J.revision_plan(self.config.parts(), config.parts(), whole)
        if plan["detection"][0] == "rerun" and not allow_paid:
            raise ValueError("this revision calls detectors again: " + plan["detection"][1])
        child = create_run(self.spark, config, detectors=self.detectors, validator=self.validator, secrets=self.secrets, clock=self.clock)
        child._set(parent_run_id=self.head.facts["run_id"], reason=reason, plan=plan)
        if plan["detection"][0] == "reuse":
            names = [d.name for d in config.detectors]
            child.commit(**J.carried_over(self.stored("work").where(F.col("stage") == "detection"), self.stored("attempts").where(F.col("backend_id").isin(names)), self.stored("findings"), child.head.facts["run_id"]), backends=self.stored("backends").where(F.col("backend_id").isin(names)))
        return child

    def status(self) -> dict[str, Any]:
        """The report. Records, states and errors come of the ledger's counters; the rest are small aggregates."""
        self.head = self.ledger.head()
        rows = lambda df: [r.asDict(True) for r in df.collect()]
        facts = self.head.facts
        reused = ("detection",) if facts.get("plan", {}).get("detection", [""])[0] == "reuse" else ()
        groups = _error_counts(self.head.counters)
        open_errors = [g for g in groups if not g["resolved"]]
        pending, retryable = self._count("states", "review/review_pending"), sum(g["occurrences"] for g in open_errors if g["retryable"])
        counts = _ordered({k.removeprefix("status:"): n for k, n in self.head.counters.items() if k.startswith("status:")}, K.RECORD_STATUSES)
        matrix = {tuple(k.removeprefix("states:").split("/", 1)): n for k, n in self.head.counters.items() if k.startswith("states:")}
        stages = {s: _stage_status({k: matrix.get((s, k), 0) for k in K.STATE_STATUSES}) for s in K.STAGES}
        action = "review" if pending else "retry" if retryable else "continue" if facts["status"] in ("blocked", "failed") else None
        decisions, events = self.stored("review_decisions"), self.stored("structured_events")
        return {
            "run_id": facts["run_id"], "status": facts["status"], "blocked_by": facts.get("blocked_by"), "as_of": self.clock().isoformat(), "is_final": facts["status"] in ("completed", "completed_with_errors", "failed"),
            "records": {"denominator": sum(counts.values()), "counts": [{"status": k, "n": n} for k, n in counts.items()]},
            "stages": {"run": [{"stage": s, "status": x, "provenance": _provenance(s, x, reused)} for s, x in stages.items()], "records": [{"stage": s, "status": k, "n": matrix[s, k]} for s in K.STAGES for k in K.STATE_STATUSES if (s, k) in matrix]},
            "findings": rows(M.finding_counts(self.stored("findings"))), "validation": rows(M.validation_totals(self.stored("validation_results"), self.stored("validation_findings")))[0],
            "review": rows(M.review_seconds(decisions))[0] | {"pending": pending, "counts": rows(M.disposition_counts(decisions)), "by_reviewer": rows(M.reviewer_counts(decisions))},
            "structured": rows(M.structured_counts(events, self.stored("plans"))), "errors": {"unresolved": sum(g["occurrences"] for g in open_errors), "retryable": retryable, "groups": groups},
            "attempts": rows(M.attempt_counts(self.stored("attempts"))), "usage": rows(M.usage_by_backend(self.stored("attempts"), self.stored("findings"), bool(reused))), "exports": rows(M.export_history(self.stored("exports"))),
            "versions": {"tables": {n: len(t["tokens"]) for n, t in self.head.tables.items()}, "ledger": self.head.version, "source": facts.get("source")}, "action": action,
        }

    def errors(self, unresolved_only: bool = True, size: int = 100) -> list[dict[str, Any]]:
        """The first errors, each with its record's place."""
        return [r.asDict() for r in M.error_list(self.table("errors"), self.stored("records"), unresolved_only=unresolved_only).limit(size).collect()]

    def export(self, path: str, columns: list[str], form: str = "parquet", mode: str = "ready_only", single: bool = True) -> int:
        """Writes the selected columns; the number of rows. Its hash and size go to the history of exports, and the export
        states of records that it changes are set."""
        with self.locked():
            config = self.config
            chosen = R.export_columns(columns, config.input.metadata, tuple(config.input.structured), mode)
            records = self._records()
            rows = R.export_rows(records, self.stored("renderings"), chosen, mode)
            R.write_records(rows, path, form, single)
            n, now = R.read_records(self.spark, path, form).count() if self._count("status", *K.RECORD_STATUSES) else 0, self.clock()
            digest = R.source_digest(R.file_facts(self.spark, path).where("path not like '%.crc' and path not like '%/\\_SUCCESS'")).first()["digest"]
            out = records if mode == "all_records" else records.where("status = 'ready'")
            mine = self.stored("states").where("stage = 'export' and status <> 'excluded'").withColumn("was", F.col("status")).join(out.select("record_id", F.lit(True).alias("hit")), "record_id", "left")
            states = mine.withColumn("status", F.when(F.col("hit"), "succeeded").otherwise("skipped")).where("status <> was")
            row = self.spark.createDataFrame([(run_id(None, now), path, form, mode, list(chosen), n, digest, "succeeded", now)], _SCHEMAS["exports"])
            self.commit(states=states, exports=row)
            return n


def _settings(d: DetectorSettings) -> str:
    return json.dumps({"kind": d.kind, "most_bytes": d.most_bytes, "overlap": d.overlap, "input_cost_per_million_tokens": d.input_price, "output_cost_per_million_tokens": d.output_price}, sort_keys=True)


def _ordered(counts: dict[str, int], order: tuple[str, ...]) -> dict[str, int]:
    return {k: counts[k] for k in (*order, *sorted(set(counts) - set(order))) if k in counts}


def _stage_status(n: dict[str, int]) -> str:
    """As L.stage_rollup, of counts by status."""
    active = sum(v for k, v in n.items() if k not in ("excluded", "skipped"))
    if not active:
        return "skipped"
    if n.get("succeeded", 0) == active:
        return "completed"
    return "completed_with_errors" if any(n.get(k, 0) for k in (*J.FAILED, "blocked")) else "blocked"


def _run_status(n: dict[str, int], finalization: str) -> str:
    """As L.run_rollup, of counts by status."""
    if n.get("awaiting_review"):
        return "awaiting_review"
    if n.get("failed") or finalization == "completed_with_errors":
        return "completed_with_errors"
    total = sum(n.values())
    return "completed" if n.get("ready") or (total and n.get("excluded") == total) else "blocked"


def _provenance(stage: str, status: str, reused: tuple[str, ...]) -> str:
    return "reused_from_parent" if stage in reused else "skipped" if status == "skipped" else "completed_in_this_run" if status.startswith("completed") else "scheduled_in_this_run"


def _error_counts(counters: dict[str, int]) -> list[dict[str, Any]]:
    """Error groups with their occurrences, most first."""
    found = [json.loads(k.removeprefix("errors:")) | {"occurrences": n} for k, n in counters.items() if k.startswith("errors:")]
    return sorted(found, key=lambda g: (g["resolved"], -g["occurrences"], str(g)))


def create_run(spark: SparkSession, config: Config, **injected: Any) -> Run:
    """Reads and checks the input, and writes the first tables in one commit; whatever fails leaves no folder."""
    config, spark = config.embedded(), own_session(spark)
    clock = injected.get("clock") or (lambda: datetime.now(UTC))
    now = clock()
    name, n = run_id(config.name, now), 1
    parent = Files(spark, config.output_dir)
    while parent.exists(name):
        n += 1
        name = f"{run_id(config.name, now)}-{n}"
    i = config.input
    source = R.read_records(spark, i.path, i.format) if i.order else R.read_in_order(spark, i.path, i.format)
    records = R.normalize(source, i.record_id, i.entity_id or i.record_id, i.text, i.metadata, i.repair, i.order, None if i.order else "place__")
    kinds = dict(source.dtypes)
    typed = ", ".join(f"`{c}` {'string' if kinds[c] in ('binary', 'date') else kinds[c]}" for c in i.metadata)
    folder = f"{parent.folder}/{name}"
    ledger = Ledger(spark, folder, _KEYS, {t: (make(a), make(b)) for t, (make, a, b) in _COUNTED.items()})
    try:
        records = ledger.kept(records, dealt=False)
        total = R.check_records(records).count()
        ledger.set_buckets(min(MOST_BUCKETS, -(-total // RECORDS_A_BUCKET)))
        places = records.agg(F.min("source_index"), F.max("source_index"), F.count_distinct("source_index")).first()
        if tuple(places) != (0, total - 1, total):
            raise ValueError("the rows of the input have no places from 0 on; it may have changed while it was read")
        facts = R.source_digest(R.file_facts(spark, i.path)).first().asDict()
        ledger.commit(Head(), None, {"run_id": name, "name": config.name, "status": "initialized", "created_at": now.isoformat(), "config": json.loads(json.dumps(config.as_dict(), default=list)), "metadata_schema": typed or "_ string", "source": facts})
        run = Run(spark, folder, **injected)
        states = L.initial_states(records, config.skipped).withColumn("attempts", F.lit(0))
        run.commit(records=records, status=records.select("record_id", F.when(F.col("excluded"), "excluded").otherwise("processing").alias("status")), states=states)
        ledger.forget()
        return run
    except BaseException:
        ledger.forget()
        parent.delete(name)
        raise


def open_run(spark: SparkSession, folder: str | Path, **injected: Any) -> Run:
    return Run(spark, folder, **injected)


def discover_runs(spark: SparkSession, output_dir: str | Path) -> list[dict[str, Any]]:
    """Runs of a folder, newest first, with their records and ready ones, of their last commits alone; what cannot be read
    is passed over."""
    out, files = [], Files(spark, str(output_dir))
    for name in files.names():
        try:
            head = Ledger(spark, f"{files.folder}/{name}", _KEYS).head()
            facts, counts = head.facts, {k.removeprefix("status:"): n for k, n in head.counters.items() if k.startswith("status:")}
            out.append({"run_id": facts["run_id"], "name": facts["name"], "status": facts["status"], "created_at": facts["created_at"], "total": sum(counts.values()), "ready": counts.get("ready", 0)})
        except (KeyError, TypeError, ValueError):  # a folder that is no whole run
            continue
    return sorted(out, key=lambda r: (r["created_at"], r["run_id"]), reverse=True)


def precheck(spark: SparkSession, config: Config, detectors: Detectors | None = None, secrets: Callable[[str], str] | None = None) -> list[dict[str, str]]:
    """What stands in the way of a run, and what it would take: (level, code, message), errors before warnings before notes."""
    issues: list[tuple[str, str, str]] = []
    add = lambda level, code, message: issues.append((level, code, message))
    try:
        config = config.embedded()
    except (OSError, ValueError) as e:
        add("error", "rules", str(e))
    i, records = config.input, None
    try:
        source = R.read_records(spark, i.path, i.format)
        records = R.normalize(source, i.record_id, i.entity_id or i.record_id, i.text, i.metadata)
        R.check_records(records)
        if R.import_summary(records).first()["active"] == 0:
            add("error", "no_active_records", "every text is blank")
    except (OSError, ValueError) as e:
        records = None
        add("error", "input", str(e))
    if "detection" in config.skipped:
        add("warning", "no_detection", "neither detectors nor rules are enabled")
    for d in config.detectors:
        if d.name not in (detectors or {}):
            add("error", "detector", f"no detector named {d.name} is given")
    surrogates = [c for c, (a, _) in config.policy.items() if a == "surrogate"]
    if surrogates:
        try:
            G.resolve_secret(config.secret_reference, secrets)
        except ValueError as e:
            add("error", "secret", str(e))
        for c in surrogates:
            if config.policy[c][1] == "list" and not config.surrogate_values.get(c):
                add("error", "surrogates", f"{c} has no list")
    if config.consistency == "entity" and not i.entity_id and surrogates:
        add("warning", "entity_scope", "without an entity column every record is an entity of its own")
    if not config.review:
        add("info", "review", "no record is reviewed")
    retained = P.retained(config.policy)
    if retained:
        add("info", "retained", f"kept as they are: {', '.join(sorted(retained))}")
    for r in config.rules:
        if config.policy[r.category][0] == "retain":
            add("warning", "rule_retained", f"rule {r.id} marks {r.category}, which is kept")
    if config.detectors and records is not None:
        backends = [{"id": d.name} | ({"most_bytes": d.most_bytes, "overlap": d.overlap, "price_per_100": d.price_per_100} if d.kind == "service" and d.most_bytes else {"max_output_tokens": d.max_output_tokens, "input_price": d.input_price, "output_price": d.output_price}) for d in config.detectors]
        costs = J.cost_by_backend(records, backends)
        for r in costs.collect():
            add("info", "cost", f"{r['backend_id']}: {r['request_count']} calls, {r['input_characters']} characters" + (f", {r['total_cost']:.4f}" if r["total_cost"] is not None else ", price unknown"))
    level = {"error": 0, "warning": 1, "info": 2}
    return [dict(zip(("level", "code", "message"), x)) for x in sorted(issues, key=lambda x: level[x[0]])]
