"""Review: queue, views, span and field edits, previews, decisions, workspaces.

Edits are rows. Span edits: (record_id, op, group_id, start, end, category, text), op being add, remove or modify; what
cannot be applied is a row with an error, so one bad edit fails no other record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as K
from ..functions import policy as P
from . import reporting as M
from . import spans as S
from . import structured as X
from . import work as W

OPS = ("add", "remove", "modify")
SPAN_EDIT = "record_id string, op string, group_id string, finding_ids array<string>, start int, end int, category string, text string"
FIELD_EDIT = "record_id string, column_name string, category string, original string, value string"


def queue(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records whose review is pending, in source order."""
    pending = states.where("stage = 'review' and status = 'review_pending'").select("record_id")
    return records.join(pending, "record_id").orderBy("source_index")


def queue_rows(records: DataFrame, states: DataFrame, decisions: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Records with a review state, with the seconds of their decision, else of their open workspace, else 0."""
    reviewed = states.where("stage = 'review' and status in ('review_pending', 'succeeded')").select("record_id", (F.col("status") == "review_pending").alias("pending"))
    rows = records.join(reviewed, "record_id").join(M.current_decisions(decisions).select("record_id", "disposition", F.col("review_seconds").alias("decided")), "record_id", "left")
    rows = rows.join(workspaces.select("record_id", F.col("seconds").alias("so_far")), "record_id", "left")
    return rows.select("record_id", "source_index", "pending", "disposition", F.coalesce("decided", "so_far", F.lit(0)).cast("long").alias("seconds"))


def queue_summary(rows: DataFrame) -> DataFrame:
    """(pending, reviewed, total_seconds, average_seconds) of queue_rows; the average is over reviewed records."""
    done = F.col("disposition").isNotNull()
    sums = rows.agg(K.count_if(F.col("pending")).alias("pending"), K.count_if(done).alias("reviewed"), K.sum_or_zero(F.col("seconds")).alias("total_seconds"), K.sum_or_zero(F.when(done, F.col("seconds"))).alias("done"))
    return sums.withColumn("average_seconds", F.when(F.col("reviewed") > 0, F.bround(F.col("done") / F.col("reviewed"), 1)).otherwise(0.0)).drop("done")


def basis_revision(plans: DataFrame, decisions: DataFrame) -> DataFrame:
    """(record_id, revision): what a review looks at: the active draft, else what the current decision looked at, else
    the latest draft. plans: record_id, plan_revision, purpose, status."""
    drafts = plans.where("purpose = 'draft'").groupBy("record_id").agg(F.max(F.when(F.col("status") == "active", F.col("plan_revision"))).alias("active"), F.max("plan_revision").alias("latest"))
    basis = M.current_decisions(decisions).groupBy("record_id").agg(F.max("basis_revision").alias("decided"))
    return drafts.join(basis, "record_id", "left").select("record_id", F.coalesce("active", "decided", "latest").alias("revision"))


def record_view(tables: dict[str, DataFrame], record_id: str) -> dict[str, DataFrame]:
    """What a reviewer sees of one record: the record, eligible findings, groups, current validation findings, the
    latest draft (a current one before stale ones) and structured fields."""
    mine = {n: df.where(F.col("record_id") == record_id) for n, df in tables.items() if "record_id" in df.columns}
    results = mine["validation_results"].where("not is_stale").select("validation_id")
    return {
        "record": mine["records"],
        "findings": mine["findings"].where("is_eligible").orderBy("start", "end", "finding_id"),
        "groups": mine["groups"].orderBy("start", "end", "group_id"),
        "validation_findings": mine["validation_findings"].join(results, "validation_id").orderBy("validation_finding_id"),
        "draft": M.latest_first(mine["renderings"].where("kind = 'draft'"), "record_id", "is_stale", "created_at"),
        "structured": mine["structured_events"].orderBy("column_name"),
    }


def checked_edits(edits: DataFrame, groups: DataFrame, records: DataFrame) -> DataFrame:
    """edits with an error column: removals and changes name a group that is there, additions and changes give a span
    whose text stands in the record. groups carry group_id and finding_ids; edits finding_ids too, which have to agree."""
    met = edits.join(groups.select("record_id", "group_id", F.col("finding_ids").alias("shown")), ["record_id", "group_id"], "left").join(records.select("record_id", F.col("text").alias("source")), "record_id", "left")
    takes, gives = F.col("op").isin("remove", "modify"), F.col("op").isin("add", "modify")
    span = S.valid_span(F.col("source"), F.col("start"), F.col("end"), F.col("text"))
    error = F.when(~F.col("op").isin(*OPS), "unknown_op").when(takes & F.col("shown").isNull(), "unknown_group").when(takes & ~F.array_sort("finding_ids").eqNullSafe(F.array_sort("shown")), "stale_group")
    error = F.coalesce(error, F.when(gives & ~F.coalesce(span, F.lit(False)), "text_mismatch").when(gives & ~F.coalesce(F.col("category").isin(*K.CATEGORIES), F.lit(False)), "unknown_category").when((F.col("op") == "add") & F.col("group_id").isNotNull(), "group_of_addition"))
    return met.withColumn("error", error).drop("shown", "source")


def review_findings(edits: DataFrame, run_id: str) -> DataFrame:
    """Findings of the reviewers (edits carry reviewer_id) for added and changed spans without error."""
    new = edits.where("error is null and op in ('add', 'modify')").select("record_id", "reviewer_id", "start", "end", "category", F.col("text").alias("exact_text"))
    made = new.withColumns({"finding_id": W.finding_id(run_id, "reviewer_id", F.lit("review")), "source_kind": F.lit("review"), "source_name": F.col("reviewer_id"), "subtype": F.lit("manual"), "native_category": F.col("category"), "span_id": F.lit("review"), "confidence": F.lit(None).cast("double"), "is_eligible": F.lit(True)})
    return made.drop("reviewer_id").dropDuplicates(["record_id", "finding_id"])


def edited_findings(findings: DataFrame, edits: DataFrame, run_id: str, reviewer: str) -> DataFrame:
    """Findings after checked edits without error: the findings of removed and changed groups go (left anti), added and
    changed spans come as findings of the reviewer."""
    gone = edits.where("error is null and op in ('remove', 'modify')").select("record_id", F.explode("finding_ids").alias("finding_id"))
    new = review_findings(edits.withColumn("reviewer_id", F.lit(reviewer)), run_id).select("record_id", "finding_id", "start", "end", "category", "exact_text", "source_kind", "source_name", "confidence", "is_eligible")
    return findings.join(gone, ["record_id", "finding_id"], "left_anti").unionByName(new, allowMissingColumns=True)


def preview_text(records: DataFrame, findings: DataFrame, policy: P.Policy, extra: DataFrame | None = None) -> DataFrame:
    """(record_id, rendered, error): the final text that findings would give. extra: columns of surrogates and weeks by
    record_id, group_id where the policy asks for them."""
    groups = with_original(S.resolve(findings.where("is_eligible")), records)
    if extra is not None:
        groups = groups.join(extra, ["record_id", "group_id"], "left")
    return S.render(records, S.plan(groups, policy))


def with_original(groups: DataFrame, records: DataFrame) -> DataFrame:
    """groups with the text they stand for."""
    met = groups.join(records.select("record_id", "text"), "record_id")
    return met.withColumn("original", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")


def checked_fields(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Changes of structured fields (record_id, column_name, category, original, value) with an error column: one change a
    column, of a column that has an event with that category and original."""
    times = changes.groupBy("record_id", "column_name").agg(F.count("*").alias("times"))
    known = events.select("record_id", "column_name", F.col("category").alias("has"), F.col("original").alias("was"))
    met = changes.join(times, ["record_id", "column_name"]).join(known, ["record_id", "column_name"], "left")
    error = F.when(F.col("times") > 1, "repeated_column").when(F.col("has").isNull(), "unknown_column").when(F.col("has") != F.col("category"), "category_mismatch").when(~F.col("was").eqNullSafe(F.col("original")), "original_mismatch")
    return met.withColumn("error", error).drop("times", "has", "was")


def preview_fields(events: DataFrame, changes: DataFrame) -> DataFrame:
    return X.overridden(events, checked_fields(changes, events).where("error is null"))


def decision_id(record: Column, decided_at: Column) -> Column:
    """decided_at: a timestamp, which is UTC."""
    iso = F.concat(F.date_format(decided_at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(decided_at, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(decided_at, "SSSSSS"))).otherwise(F.lit("")), F.lit("+00:00"))
    return K.content_id("review", K.json_string(record), K.json_string(iso))


def checked_decisions(decisions: DataFrame, basis: DataFrame, plans: DataFrame, results: DataFrame, renderings: DataFrame) -> DataFrame:
    """decisions (record_id, disposition, plan_revision, edits: their number, validation_ids) with an error column.

    The plan is the record's basis, and a draft; only corrections carry edits, and they carry some; each validation that
    a decision refers to is of a rendering of that very draft (two joins, and an anti-join finds the strays)."""
    drafts = plans.where("purpose = 'draft'").select("record_id", "plan_revision", F.lit(True).alias("is_draft"))
    met = decisions.join(basis.select("record_id", F.col("revision").alias("basis")), "record_id", "left").join(drafts, ["record_id", "plan_revision"], "left")
    of_draft = results.join(renderings.where("kind = 'draft'").select("rendering_id", "plan_revision"), "rendering_id").select("record_id", "plan_revision", "validation_id")
    stray = decisions.select("record_id", "plan_revision", F.explode("validation_ids").alias("validation_id")).join(of_draft, ["record_id", "plan_revision", "validation_id"], "left_anti").select("record_id", F.lit(True).alias("stray")).distinct()
    met = met.join(stray, "record_id", "left")
    corrected, edits = F.col("disposition") == "corrected", F.coalesce("edits", F.lit(0))
    error = F.when(~F.col("disposition").isin(*K.DISPOSITIONS), "unknown_disposition").when(F.col("is_draft").isNull(), "no_draft").when(~F.col("plan_revision").eqNullSafe(F.col("basis")), "stale_revision")
    error = F.coalesce(error, F.when(~corrected & (edits > 0), "edits_without_correction").when(corrected & (edits == 0), "correction_without_edits").when(F.col("stray"), "foreign_validation"))
    return met.withColumn("error", error).drop("basis", "is_draft", "stray")


def superseded(decisions: DataFrame) -> DataFrame:
    """decisions with is_current: the newest of each record is."""
    newest = decisions.groupBy("record_id").agg(F.max_by("decision_id", F.struct("created_at", "decision_id")).alias("newest"))
    return decisions.drop("is_current").join(newest, "record_id").withColumn("is_current", F.col("decision_id") == F.col("newest")).drop("newest")


def updated_eligibility(findings: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with the flags (finding_id, eligible) applied, the ids that are unknown)."""
    unknown = flags.join(findings.select("finding_id"), "finding_id", "left_anti").select("finding_id")
    new = findings.join(flags.select("finding_id", "eligible"), "finding_id", "left")
    return new.withColumn("is_eligible", F.coalesce("eligible", "is_eligible")).drop("eligible"), unknown


_EVENTS = "record_id string, reviewer_id string, seconds long, running boolean, plan_revision int"


def _folded(events: pd.DataFrame) -> pd.DataFrame:
    """The workspaces of one reviewer, of timer events in order. One timer runs at a time: a start anywhere, a pause or a set
    of the running one ends its stretch, whose whole seconds count. A start at another revision begins the time anew."""
    kept: dict[str, list] = {}  # record: seconds, since when it runs, revision
    running = None

    def stop(at: pd.Timestamp) -> None:
        nonlocal running
        if running is not None:
            w = kept[running]
            w[0] += max(0, int((at - w[1]).total_seconds()))
            w[1], running = None, None

    for e in events.itertuples():
        if e.kind == "start":
            if running == e.record_id and kept[running][2] == e.plan_revision:
                continue
            stop(e.at)
            w = kept.setdefault(e.record_id, [0, None, e.plan_revision])
            if w[2] != e.plan_revision:
                w[0], w[2] = 0, e.plan_revision
            w[1], running = e.at, e.record_id
        elif e.kind == "pause":
            if running == e.record_id:
                stop(e.at)
        else:
            if running == e.record_id:
                kept[running][1], running = None, None
            kept[e.record_id] = [int(e.seconds), None, e.plan_revision]
    return pd.DataFrame([(r, events["reviewer_id"].iloc[0], w[0], r == running, w[2]) for r, w in kept.items()], columns=[c.split()[0] for c in _EVENTS.split(", ")])


def workspaces(timers: DataFrame, basis: DataFrame) -> DataFrame:
    """(record_id, reviewer_id, seconds, running, plan_revision, is_fresh) of timer events (event_id, record_id, reviewer_id, at,
    kind, seconds, plan_revision): each reviewer's events are folded in their order. is_fresh: the workspace looks at the
    record's basis (record_id, revision); one that is not begins anew with its next start."""
    order = F.col("event_id").try_cast("long")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _folded(frame.sort_values(["at", "n"]))

    folded = timers.withColumn("n", order).groupBy("reviewer_id").applyInPandas(run, _EVENTS)
    return folded.join(basis.select("record_id", "revision"), "record_id", "left").select("record_id", "reviewer_id", "seconds", "running", "plan_revision", (F.col("revision") == F.col("plan_revision")).alias("is_fresh"))


def review_seconds(timer: DataFrame) -> DataFrame:
    """(record_id, reviewer_id, seconds) of timer events (record_id, reviewer_id, at, kind, event_id?): start, pause, or set with
    ``seconds``. A reviewer runs one timer: a start anywhere ends the one before. A stretch counts whole seconds; a set
    replaces what was before it; an open stretch counts nothing yet. Of events of one time and kind the event_id, a number,
    tells the order."""
    from pyspark.sql import Window

    turn = F.col("event_id").try_cast("long") if "event_id" in timer.columns else F.lit(0)
    timer = timer.withColumn("turn", turn)
    mine = Window.partitionBy("reviewer_id").orderBy("at", "kind", "turn")
    rows = timer.withColumn("until", F.when(F.col("kind") == "start", F.lead("at").over(mine)))
    rows = rows.withColumn("stretch", F.floor(F.col("until").cast("double") - F.col("at").cast("double")).cast("long"))
    fixed = rows.where("kind = 'set'").groupBy("record_id", "reviewer_id").agg(F.max_by("seconds", F.struct("at", "turn")).alias("base"), F.max("at").alias("since"))
    met = rows.join(fixed, ["record_id", "reviewer_id"], "left")
    later = F.when(F.col("since").isNull() | (F.col("at") > F.col("since")), F.col("stretch"))
    return met.groupBy("record_id", "reviewer_id").agg((F.coalesce(F.first("base"), F.lit(0)) + K.sum_or_zero(later)).alias("seconds"))
