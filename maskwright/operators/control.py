"""State, recovery, retry and revision: every change is a DataFrame of new rows for an append-only table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as K
from . import ledger as L

FAILED = ("retry_exhausted", "permanent_error")
TERMINAL = ("succeeded", "skipped", "excluded", "retry_exhausted", "permanent_error")


def recovered(work: DataFrame, states: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After an interruption: running work and states are open again, running attempts are cancelled."""
    open_again = lambda df, to: df.withColumn("status", F.when(F.col("status") == "running", to).otherwise(F.col("status")))
    return open_again(work, "retry_pending"), open_again(states, "retry_pending"), open_again(attempts, "cancelled")


def _one_each(changes: DataFrame, *keys: str) -> DataFrame:
    """Of changes that repeat a key one, the greatest by its columns, so that no row is met twice."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x")).select(*keys, "x.*")


def moved_state(states: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """states (record_id, stage, status, attempts, started_at, finished_at) after changes (record_id, stage, to, counts).

    The first running sets the start, a terminal status sets the end and any other clears it, ``counts`` adds an
    attempt. Changes of unknown states change nothing; ``unknown_states`` finds them. Of changes of one state the last by
    name counts; other columns of states stay."""
    met = states.join(_one_each(changes.select("record_id", "stage", "to", "counts"), "record_id", "stage"), ["record_id", "stage"], "left")
    to, hit = F.col("to"), F.col("to").isNotNull()
    known = ("record_id", "stage", "status", "attempts", "started_at", "finished_at")
    return met.select(
        "record_id", "stage", F.coalesce("to", "status").alias("status"), (F.col("attempts") + F.coalesce(F.col("counts").cast("int"), F.lit(0))).alias("attempts"),
        F.when(hit & (to == "running"), F.coalesce("started_at", at)).otherwise(F.col("started_at")).alias("started_at"), F.when(hit, F.when(to.isin(*TERMINAL), at)).otherwise(F.col("finished_at")).alias("finished_at"),
        *(c for c in states.columns if c not in known),
    )


def unknown_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(states, ["record_id", "stage"], "left_anti").select("record_id", "stage")


def with_status(records: DataFrame, changes: DataFrame) -> DataFrame:
    """records after changes (record_id, status, final_rendering_id, final_metadata): a null keeps the old value. Of changes of
    one record the last by name counts."""
    new = _one_each(changes.select("record_id", "status", "final_rendering_id", "final_metadata"), "record_id").select("record_id", *(F.col(c).alias(f"new_{c}") for c in ("status", "final_rendering_id", "final_metadata")))
    met = records.join(new, "record_id", "left")
    return met.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("status", "final_rendering_id", "final_metadata")}).drop(*(c for c in met.columns if c.startswith("new_")))


def resolved(errors: DataFrame, stage: str, records: DataFrame | None = None) -> DataFrame:
    """errors with those of a stage resolved, of the given records or of all."""
    hit = F.col("stage") == stage
    if records is None:
        return errors.withColumn("resolved", F.col("resolved") | hit)
    met = errors.join(records.select("record_id", F.lit(True).alias("hit")).distinct(), "record_id", "left")
    return met.withColumn("resolved", F.col("resolved") | (hit & F.coalesce("hit", F.lit(False)))).drop("hit")


def retry_targets(states: DataFrame, record_id: str | None = None, stage: str | None = None, failed: bool = False) -> DataFrame:
    """(record_id, stage): the earliest failing stage of one record, or the records that failed at one stage. One of the
    two is asked for; a stage only together with ``failed``."""
    if (record_id is None) == (stage is None and not failed) or (record_id is not None and failed) or (record_id is None and (stage is None or not failed)):
        raise ValueError("name a record, or a stage with failed")
    if record_id is not None:
        return L.retry_targets(states.where(F.col("record_id") == record_id))
    if stage not in K.STAGES:
        raise ValueError(f"no such stage: {stage}")
    return states.where((F.col("stage") == stage) & F.col("status").isin(*FAILED)).select("record_id", "stage")


def reset_states(states: DataFrame, targets: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """states after a retry of targets (record_id, stage): that stage and all later ones are open, or skipped where they
    are not enabled; excluded ones stay. Their times are cleared."""
    place = lambda c: K.place_in(F.col(c), K.STAGES)
    met = states.join(targets.select("record_id", F.col("stage").alias("from")), "record_id", "left")
    hit = F.coalesce((place("stage") >= place("from")) & (F.col("status") != "excluded"), F.lit(False))
    out = met.withColumn("hit", hit).withColumn("status", F.when(F.col("hit"), F.when(F.col("stage").isin(*skipped) if skipped else F.lit(False), "skipped").otherwise("pending")).otherwise(F.col("status")))
    return out.withColumns({c: F.when(~F.col("hit"), F.col(c)) for c in ("started_at", "finished_at") if c in states.columns}).select(*states.columns)


def reset_work(work: DataFrame, targets: DataFrame) -> DataFrame:
    """Failed work items (record_id, stage, status) of the targets are open again."""
    met = work.join(targets.select("record_id", "stage", F.lit(True).alias("hit")), ["record_id", "stage"], "left")
    again = F.coalesce("hit", F.lit(False)) & F.col("status").isin(*FAILED, "running", "retry_pending")
    return met.withColumn("status", F.when(again, "retry_pending").otherwise(F.col("status"))).select(*work.columns)


#: What a retry from a stage makes stale: everything of the tables whose own stage is not before it.
STALED_BY = {"transformation_plans": "transformation", "validation_results": "validation", "review_decisions": "review", "renderings": "finalization"}


def staled(rows: DataFrame, table: str, targets: DataFrame) -> DataFrame:
    """rows of a table with is_stale set for records whose retry reaches it."""
    reaches = targets.where(K.place_in(F.col("stage"), K.STAGES) <= K.STAGES.index(STALED_BY[table])).select("record_id", F.lit(True).alias("hit"))
    met = rows.join(reaches, "record_id", "left").withColumn("is_stale", F.coalesce("is_stale", F.lit(False)) | F.coalesce("hit", F.lit(False)))
    if "is_current" in rows.columns:
        met = met.withColumn("is_current", F.col("is_current") & ~F.col("is_stale"))
    return met.select(*rows.columns)


def failed_records(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records with a failed state, each once, in source order."""
    return records.join(states.where(F.col("status").isin(*FAILED)).select("record_id").distinct(), "record_id", "left_semi").orderBy("source_index")


# ---- plans of text and their revisions ----


def next_revisions(digests: DataFrame, known: DataFrame) -> DataFrame:
    """(record_id, digest, revision, is_new): a digest equal to that of the record's active revision keeps it, and
    nothing becomes stale; any other gets the next number. known: record_id, revision, digest."""
    last = known.groupBy("record_id").agg(F.max("revision").alias("last"), F.max_by("digest", "revision").alias("active"))
    met = digests.join(last, "record_id", "left")
    same = F.col("active").eqNullSafe(F.col("digest"))
    return met.select("record_id", "digest", F.when(same, F.col("last")).otherwise(F.coalesce("last", F.lit(0)) + 1).alias("revision"), (~same).alias("is_new"))


def active(rows: DataFrame, revision: str = "revision") -> DataFrame:
    """The rows of each record's highest revision: (record_id, revision, ...) with many rows a revision."""
    top = rows.groupBy("record_id").agg(F.max(revision).alias(revision))
    return rows.join(top, ["record_id", revision], "left_semi")


def saved_plans(plans: DataFrame, new: DataFrame) -> DataFrame:
    """plans (record_id, plan_revision, purpose, status) and new ones (record_id, purpose): revisions count over both
    purposes, and a new plan makes the active one of its purpose stale."""
    last = plans.groupBy("record_id").agg(F.max("plan_revision").alias("last"))
    added = new.join(last, "record_id", "left").select("record_id", (F.coalesce("last", F.lit(0)) + 1).alias("plan_revision"), "purpose", F.lit("active").alias("status"))
    old = plans.join(new.select("record_id", "purpose", F.lit(True).alias("hit")), ["record_id", "purpose"], "left")
    return old.select("record_id", "plan_revision", "purpose", F.when(F.col("hit") & (F.col("status") == "active"), "stale").otherwise(F.col("status")).alias("status")).unionByName(added)


def rendering_id(record: Column, revision: Column, purpose: Column) -> Column:
    """The id that a rendering's events refer to."""
    return K.sha256(F.concat_ws("\0", record, revision.cast("string"), purpose))


def current_renderings(renderings: DataFrame, kind: str) -> DataFrame:
    return renderings.where((F.col("kind") == kind) & ~F.col("is_stale"))


# ---- revision of a run ----


def revision_plan(parent: dict[str, str | None], child: dict[str, str | None], reusable: bool) -> dict[str, tuple[str, str]]:
    """What a child run does with each part of its parent, and why. parent and child: hashes of the parts ``input``,
    ``detection``, ``rules``, ``policy``, ``validation``, ``review``; a part that is off has None. Another input is no
    revision."""
    if parent["input"] != child["input"]:
        raise ValueError("a revision keeps its parent's input")
    out = {}
    for part in ("detection", "rules", "policy", "validation", "review"):
        if child[part] is None:
            out[part] = ("skip", "not enabled")
        elif part == "detection" and parent[part] == child[part] and reusable:
            out[part] = ("reuse", "all of the parent's calls have succeeded")
        elif part == "detection" and parent[part] == child[part]:
            out[part] = ("rerun", "the parent's calls are not complete")
        elif part == "detection":
            out[part] = ("rerun", "its settings have changed")
        else:
            out[part] = ("rerun", "it depends on this run")
    return out


def copied(rows: DataFrame, child: str, source_kinds: tuple[str, ...] = ("aws", "llm")) -> DataFrame:
    """A parent's rows of a detector table for a child run; of findings only those of detectors."""
    mine = rows.where(F.col("source_kind").isin(*source_kinds)) if "source_kind" in rows.columns else rows
    return mine.withColumn("run_id", F.lit(child))


def carried_over(work: DataFrame, attempts: DataFrame, findings: DataFrame, child: str) -> dict[str, DataFrame]:
    """A parent's detector work, attempts and findings under the ids that the child run's own would have, so that the child
    finds its calls made."""
    from . import work as W

    old = work.withColumnRenamed("work_item_id", "parent_item")
    items = W.work_ids(old, child).select(*work.columns, "parent_item")
    ids = items.select("record_id", F.col("parent_item").alias("work_item_id"), F.col("work_item_id").alias("child_item"))
    key = K.content_id("attempt", K.json_string(F.lit(child)), K.json_string(F.col("child_item")), F.col("attempt_number").cast("string"))
    tries = attempts.join(ids, ["record_id", "work_item_id"]).withColumn("child_attempt", key)
    calls = tries.select("record_id", "attempt_id", "child_attempt")
    mine = copied(findings, child).drop("run_id").join(calls, ["record_id", "attempt_id"]).withColumn("attempt_id", F.col("child_attempt")).drop("child_attempt")
    return {
        "work": items.drop("parent_item"), "attempts": tries.withColumns({"work_item_id": F.col("child_item"), "attempt_id": F.col("child_attempt")}).drop("child_item", "child_attempt"),
        "findings": mine.withColumn("finding_id", W.finding_id(child, "source_name", F.coalesce("span_id", F.lit("")))),
    }


# ---- costs ----


def cost_by_backend(records: DataFrame, backends: list[dict], prompt_characters: int = 0) -> DataFrame:
    """(backend_id, request_count, input_characters, units, input_tokens, output_tokens, input_cost, output_cost,
    total_cost): one pass over active records (text) for each backend.

    A backend is a dict: id, and of a service most_bytes, overlap, price_per_100; of a model max_output_tokens, input_price,
    output_price (a million tokens) and whether it reads the text ``twice``. What has no price has no cost; a total needs
    both parts. A token counts four characters, begun ones in full."""
    from . import work as W

    known = records.where(~K.is_blank(F.col("text")))
    out = None
    for b in backends:
        price = lambda n: F.lit(b.get(n)).cast("double")  # noqa: B023, E731
        if "most_bytes" in b:
            chunks = W.chunk_plan(known.withColumn("record_id", F.lit("")), b["most_bytes"], b.get("overlap", 0))
            n, units = F.col("end") - F.col("start"), F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / 100))
            row = chunks.agg(F.count("*").alias("request_count"), K.sum_or_zero(n).cast("long").alias("input_characters"), K.sum_or_zero(units).cast("long").alias("units"))
            row = row.withColumns({"input_tokens": F.lit(None).cast("long"), "output_tokens": F.lit(None).cast("long"), "input_cost": F.col("units") * price("price_per_100"), "output_cost": F.lit(0.0)})
        else:
            payload = F.length(K.json_string(F.col("text"))) * (2 if b.get("twice") else 1) + prompt_characters
            row = known.agg(F.count("*").alias("request_count"), K.sum_or_zero(payload).cast("long").alias("input_characters"), F.lit(None).cast("long").alias("units"), K.sum_or_zero(F.ceil(payload / 4)).cast("long").alias("input_tokens"))
            row = row.withColumn("output_tokens", F.col("request_count") * b["max_output_tokens"])
            row = row.withColumns({f"{side}_cost": W.token_cost(F.col(f"{side}_tokens"), price(f"{side}_price")) for side in ("input", "output")})
        row = row.withColumn("backend_id", F.lit(b["id"])).withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no backends")
    return out


def cost_total(by_backend: DataFrame) -> DataFrame:
    """One row: a sum is null where any backend's part is; output sums only backends that make output tokens, so that
    services alone cost 0.0 there."""
    whole = lambda c, of: F.when(K.count_if(of & F.col(c).isNull()) == 0, F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0.0)))
    sums = by_backend.agg(whole("input_cost", F.lit(True)).alias("input_cost"), whole("output_cost", F.col("output_tokens").isNotNull()).alias("output_cost"))
    return sums.withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def request_characters(text: Column, prompt: str, schema: str) -> Column:
    """The size of a model's request: its prompt, its schema and the text as a JSON value."""
    return F.length(K.json_string(text)) + len(prompt) + len(schema)
