"""Detection and validation as work: chunks become work items, items become attempts, attempts become findings or errors.

A ledger table is an append-only DataFrame; ``appended`` adds rows whose key is new. Detectors and validators are Python
callables that run inside tasks (``call_detector``, ``call_validator``); what they raise is a row, not a failed job."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as K
from ..functions import policy as P
from . import text as T
from .permits import Permits, permits


class Detector(Protocol):
    """detect(text) gives dicts with category, start, end, text and, where known, confidence, subtype, group."""

    def detect(self, text: str) -> list[dict[str, Any]]: ...


class Validator(Protocol):
    """validate(original_text=, deidentified_text=, max_tokens=) gives {rationale, findings, stop_reason}."""

    def validate(self, *, original_text: str, deidentified_text: str, max_tokens: int) -> dict[str, Any]: ...


@dataclass
class ServiceError(Exception):
    """A failure that a service names by a code, or an HTTP status."""

    code: str
    message: str = ""
    status: int | None = None
    truncated: bool = False
    usage: dict[str, Any] = field(default_factory=dict)


# Service codes that may pass by themselves, and those that never do.
RETRYABLE_CODES = ("InternalServerException", "ModelNotReadyException", "ServiceUnavailableException", "ThrottlingException", "TooManyRequestsException")
PERMANENT_CODES = ("AccessDeniedException", "InvalidEncodingException", "InvalidRequestException", "ResourceNotFoundException", "TextSizeLimitExceededException", "UnrecognizedClientException", "ValidationException")
VALIDATION_TIERS = (4096, 8192, 16384)


@dataclass(frozen=True)
class Failure:
    code: str
    message: str
    retryable: bool
    systemic: bool = False
    truncated: bool = False


def classify(error: BaseException) -> Failure:
    """Whether an exception may pass by itself, and whether it concerns all calls: overload, network and credentials do."""
    name, said = type(error).__name__, str(error)
    if isinstance(error, ServiceError):
        busy = error.code in RETRYABLE_CODES or (error.code not in PERMANENT_CODES and (error.status or 0) >= 500)
        return Failure(error.code, error.message or error.code, busy, busy, error.truncated)
    if isinstance(error, (TimeoutError, ConnectionError)):
        return Failure(name, said, True, True)
    if isinstance(error, PermissionError):
        return Failure(name, said, False, True)
    return Failure(name, said or name, False)


# ---- work items ----


def appended(new: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows of ``new`` to append: one of each key, and none whose key is known."""
    fresh = new.dropDuplicates(keys)
    return fresh if known is None else fresh.join(known.select(*keys), keys, "left_anti")


def chunk_plan(records: DataFrame, most_bytes: int | None = 19_000, overlap: int = 256) -> DataFrame:
    """(record_id, chunk_index, start, end, chunk) of records (record_id, text). Without a limit a text is one chunk."""
    text = F.col("text")
    spans = T.chunks(text, most_bytes, overlap) if most_bytes else F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"))))
    rows = records.select("record_id", "text", F.posexplode(spans).alias("chunk_index", "span"))
    chunk = F.substring(text, F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    return rows.select("record_id", "chunk_index", F.col("span.start").alias("start"), F.col("span.end").alias("end"), chunk.alias("chunk"))


def work_ids(items: DataFrame, run_id: str) -> DataFrame:
    """items (record_id, backend_id, chunk_index, start, end, chunk) with work_item_id, an id of what is asked of whom."""
    parts = [K.json_string(F.lit(run_id)), K.json_string(F.col("record_id")), K.json_string(F.col("backend_id")), *(F.col(c).cast("string") for c in ("chunk_index", "start", "end")), K.json_string(K.sha256(F.col("chunk")))]
    return items.withColumn("work_item_id", K.content_id("work", *parts))


def work_items(chunks: DataFrame, run_id: str, backend: str) -> DataFrame:
    """chunks with backend_id, status and work_item_id."""
    return work_ids(chunks.withColumn("backend_id", F.lit(backend)).withColumn("status", F.lit("pending")), run_id)


def open_records(records: DataFrame, states: DataFrame, stage: str) -> DataFrame:
    """records whose state at a stage is open, in no order."""
    open_ = states.where((F.col("stage") == stage) & F.col("status").isin("pending", "retry_pending"))
    return records.join(open_.select("record_id"), "record_id", "left_semi")


def worklist(records: DataFrame, states: DataFrame, stage: str) -> DataFrame:
    """open_records in source order. The join meets N1 and N2."""
    return open_records(records, states, stage).orderBy("source_index")


def ready_for(states: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(record_id) of records that have succeeded at, or skip, each of the stages."""
    done = F.sum((F.col("stage").isin(*stages) & F.col("status").isin("succeeded", "skipped")).cast("int"))
    return states.groupBy("record_id").agg(done.alias("done")).where(F.col("done") == len(stages)).select("record_id")


def registered(backends: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """backends (backend_id, settings, prompt, schema) with a hash of each; one that is known by another hash has an error."""
    rows = backends.withColumns({f"{c}_sha256": K.sha256(F.coalesce(c, F.lit(""))) for c in ("settings", "prompt", "schema")})
    if known is None:
        return rows.withColumn("error", F.lit(None).cast("string"))
    hashes = [f"{c}_sha256" for c in ("settings", "prompt", "schema")]
    met = rows.join(F.broadcast(known.select("backend_id", F.struct(*hashes).alias("before"))), "backend_id", "left")
    return met.withColumn("error", F.when(F.col("before").isNotNull() & (F.col("before") != F.struct(*hashes)), "backend_changed")).drop("before")


# ---- calls ----

_ATTEMPT = "work_item_id string, record_id string, status string, error_code string, message string, retryable boolean, systemic boolean, raw string, usage string, stop_reason string, max_tokens int"
#: Items of a task: enough that connections cost little, few enough that a table spreads out.
ITEMS_A_TASK = 256


@dataclass
class _Outcome:
    """What one call came to, as a row of _ATTEMPT without its ids."""

    row: tuple
    systemic: bool


def _tried(call: Callable[[], dict[str, Any]], usage: dict[str, Any], max_tokens: int | None) -> _Outcome:
    """Makes a call. Its answer is a JSON object; a stop reason or usage in it also go to their columns."""
    try:
        got = call()
        stop, said = got.get("stop_reason"), got.get("usage") or {}
        if stop == "max_tokens":
            raise ServiceError("truncated", "the answer is cut off", truncated=True, usage=said)
        return _Outcome(("succeeded", None, None, False, False, json.dumps(got, ensure_ascii=False), json.dumps(usage | said), stop, max_tokens), False)
    except Exception as e:  # noqa: BLE001  any failure of a call is a row
        f = classify(e)
        status = "truncated" if f.truncated else "retryable_error" if f.retryable else "permanent_error"
        stop = "max_tokens" if f.truncated else None
        return _Outcome((status, f.code, f.message, f.retryable, f.systemic, None, json.dumps(usage | getattr(e, "usage", {})), stop, max_tokens), f.systemic)


@contextmanager
def _called(items: DataFrame, columns: list[str], make: Callable[[], Any], one: Callable[[Any, Any], Iterator[tuple[Callable, dict, int | None]]], workers: int) -> Iterator[tuple[DataFrame, Permits]]:
    """(attempts, permits) of calling for each row of items. ``one`` gives a row's calls in turn: each next one is made
    where the last was cut off. The permits live until the block ends."""
    parts = max(workers, -(-items.count() // ITEMS_A_TASK))
    with permits(items.sparkSession, workers) as (held, address):

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made, stop = None, False
            with address.desk() as desk:
                for frame in frames:
                    out = []
                    for r in frame.itertuples():
                        stop = stop or not desk.may_call()
                        if stop:
                            break
                        made = made or make()
                        for call, usage, most in one(made, r):
                            got = _tried(call, usage, most)
                            out.append((r.work_item_id, r.record_id, *got.row))
                            if got.row[0] != "truncated":
                                break
                        desk.done(got.systemic)
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _ATTEMPT.split(", ")])

        yield items.select(*columns).repartition(parts).mapInPandas(run, _ATTEMPT), held


def call_detector(items: DataFrame, detector: Callable[[], Detector], workers: int = 2) -> AbstractContextManager[tuple[DataFrame, Permits]]:
    """(attempts, permits) for a with block: one attempt for each work item (work_item_id, record_id, chunk), with at most
    ``workers`` calls in flight over all tasks. The callable makes the detector inside the task. Once a failure is
    systemic no task calls any more, and items that were not called make no row; ``permits.stopped`` tells. Write the
    attempts once within the block, and with one try a task, where calls cost money."""

    def one(made: Detector, r: Any) -> Iterator:
        usage = {"request_count": 1, "input_chars": len(r.chunk), "input_bytes": len(r.chunk.encode())}

        def call() -> dict[str, Any]:
            got = made.detect(r.chunk)
            return got if isinstance(got, dict) else {"findings": got}

        yield call, usage, None

    return _called(items, ["work_item_id", "record_id", "chunk"], detector, one, workers)


def numbered_attempts(calls: DataFrame, run_id: str, known: DataFrame | None = None) -> DataFrame:
    """calls with attempt_number, counting on from the highest known of the item (by max_tokens where an item has several),
    and attempt_id."""
    tier = F.coalesce("max_tokens", F.lit(0)) if "max_tokens" in calls.columns else F.lit(0)
    rows = calls.withColumn("attempt_number", F.row_number().over(Window.partitionBy("work_item_id").orderBy(tier)))
    if known is not None:
        last = known.groupBy("work_item_id").agg(F.max("attempt_number").alias("last"))
        rows = rows.join(last, "work_item_id", "left").withColumn("attempt_number", F.coalesce("last", F.lit(0)) + F.col("attempt_number")).drop("last")
    return rows.withColumn("attempt_id", K.content_id("attempt", K.json_string(F.lit(run_id)), K.json_string(F.col("work_item_id")), F.col("attempt_number").cast("string")))


def work_status(status: Column, attempt: Column, most: int = 1) -> Column:
    """The item's status after an attempt: another try is only open while fewer than ``most`` were made."""
    again = status.isin("retryable_error", "truncated")
    return F.when(status == "succeeded", "succeeded").when(status == "cancelled", "retry_pending").when(again & (attempt < most), "retry_pending").when(again, "retry_exhausted").otherwise("permanent_error")


def error_rows(attempts: DataFrame, stage: str) -> DataFrame:
    """(error_id, record_id, stage, error_class, error_code, message, retryable, resolved) of failed attempts; the same
    attempt gives the same id."""
    bad = attempts.where("status not in ('succeeded', 'running', 'cancelled')")
    return bad.select(K.content_id("error", K.json_string(F.col("attempt_id")), K.json_string(F.lit(stage))).alias("error_id"), "record_id", F.lit(stage).alias("stage"), F.lit("backend").alias("error_class"), "error_code", "message", "retryable", F.lit(False).alias("resolved"))


def truncations(attempts: DataFrame) -> DataFrame:
    """(work_item_id, truncations)."""
    return attempts.groupBy("work_item_id").agg(K.count_if(F.col("status") == "truncated").alias("truncations"))


# ---- answers ----

_ANSWER = "array<struct<category:string,subtype:string,text:string,start:int,end:int,confidence:double,group:string>>"


def answer_text(raw: Column) -> Column:
    """The JSON text of a model's answer: its joined text parts where it has parts, else the answer itself."""
    parts = F.from_json(F.get_json_object(raw, "$.content"), "array<struct<type:string,text:string>>")
    texts = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return F.when(parts.isNotNull(), texts).otherwise(raw)


def _answered(attempts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Succeeded attempts with their chunk, met by record_id too where chunks have it: tables in buckets of it move no texts."""
    keys = [k for k in ("record_id", "work_item_id") if k in chunks.columns]
    return attempts.where("status = 'succeeded'").join(chunks.select(*keys, F.col("start").alias("base"), "chunk"), keys)


def parse_answers(attempts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates of succeeded attempts (work_item_id, record_id, raw): raw holds a JSON object with a list ``findings`` of
    {category, text, start, end, confidence?, subtype?, group?}, places within the chunk.

    Places that are off are mended by ``text.align``; findings that cannot be placed, or whose confidence is out of
    range, have an error instead; a span id is the finding's index. An answer may come as text parts ({"content": [{"type":
    "text", "text": JSON}, ...]}), of which the text ones are joined. ``answers_failed`` tells which answers are bad as a
    whole. Offsets count from the start of the record (chunks: work_item_id, start, chunk)."""
    rows = _answered(attempts, chunks)
    found = rows.select("work_item_id", "attempt_id", "record_id", "base", "chunk", F.posexplode_outer(F.from_json(F.get_json_object(answer_text(F.col("raw")), "$.findings"), _ANSWER)).alias("index", "f"))
    found = found.where("index is not null").withColumn("place", T.aligned(F.col("chunk"), F.col("f.start"), F.col("f.end"), F.col("f.text")))
    category = K.category_of(F.col("f.category"))
    bad = F.when(F.col("f.category").isNull(), "no_category").when(~F.col("f.confidence").between(0, 1), "bad_confidence").when(F.col("place.error").isNotNull(), F.col("place.error"))
    a, b = F.col("place.start"), F.col("place.end")
    return found.select(
        "work_item_id", "attempt_id", "record_id", F.col("index").cast("string").alias("span_id"), category.alias("category"), F.col("f.category").alias("native_category"), F.col("f.subtype").alias("subtype"), F.col("f.confidence").alias("confidence"), F.col("f.group").alias("source_group_id"),
        *(x.alias(n) for x, n in zip(rebased(a, b, F.col("base")), ("start", "end"))), F.substring("chunk", a + 1, b - a).alias("exact_text"), bad.alias("error"),
    )


def rebased(start: Column, end: Column, base: Column) -> tuple[Column, Column]:
    """Places within a chunk as places within its text."""
    return start + base, end + base


def answers_failed(candidates: DataFrame, *keys: str) -> DataFrame:
    """(keys, error): answers of which every finding is bad; the key is the work item's id unless others are named."""
    keys = keys or ("work_item_id",)
    return candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.first("error", ignorenulls=True).alias("error")).where("n = bad").select(*keys, "error")


def map_service_answers(attempts: DataFrame, chunks: DataFrame) -> DataFrame:
    """As parse_answers for the medical service's entities ({Type, Text, BeginOffset, EndOffset, Score, Id}): nothing is
    mended, each text has to stand at its offsets and each score has to be a number; a token of a further page is an error,
    as the answer then is not whole."""
    kind = "array<struct<Type:string,Text:string,BeginOffset:int,EndOffset:int,Score:double,Id:string>>"
    rows = _answered(attempts, chunks)
    more = F.get_json_object("raw", "$.PaginationToken").isNotNull()
    found = rows.select("work_item_id", "attempt_id", "record_id", "base", "chunk", more.alias("more"), F.posexplode(F.from_json(F.get_json_object("raw", "$.Entities"), kind)).alias("index", "f"))
    a, b, text = F.col("f.BeginOffset"), F.col("f.EndOffset"), F.col("f.Text")
    same = (a >= 0) & (b > a) & (b <= F.length("chunk")) & F.substring("chunk", a + 1, b - a).eqNullSafe(text)
    bad = F.when(F.col("more"), "truncated").when(~F.coalesce(same, F.lit(False)), "text_mismatch").when(~F.coalesce(F.col("f.Score").between(0, 1), F.lit(False)), "bad_confidence")
    return found.select(
        "work_item_id", "attempt_id", "record_id", F.coalesce("f.Id", F.col("index").cast("string")).alias("span_id"), K.category_of(F.col("f.Type")).alias("category"), F.col("f.Type").alias("native_category"), F.lit(None).cast("string").alias("subtype"), F.col("f.Score").alias("confidence"), F.lit(None).cast("string").alias("source_group_id"),
        *(x.alias(n) for x, n in zip(rebased(a, b, F.col("base")), ("start", "end"))), text.alias("exact_text"), bad.alias("error"),
    )


def eligible(confidence: Column, least: float) -> Column:
    """Whether a finding counts: without a confidence it does."""
    return F.coalesce(confidence >= least, F.lit(True))


def ineligible_reason(confidence: Column, least: float) -> Column:
    return F.when(~eligible(confidence, least), F.concat(F.lit("confidence "), confidence.cast("string"), F.lit(f" is below {least}")))


def findings(candidates: DataFrame, run_id: str, source_kind: str, source_name: str, least: float = 0.0) -> DataFrame:
    """Findings of candidates (record_id, start, end, category, span_id, exact_text, confidence?) with ids, eligibility and
    its reason. Findings of rules and of reviewers always count."""
    confidence = F.col("confidence") if "confidence" in candidates.columns else F.lit(None).cast("double")
    always = source_kind in ("rule", "review")
    rows = candidates if "error" not in candidates.columns else candidates.where("error is null")
    return rows.withColumns({
        "confidence": confidence, "source_kind": F.lit(source_kind), "source_name": F.lit(source_name), "finding_id": finding_id(run_id, F.lit(source_name), F.coalesce("span_id", F.lit("review" if source_kind == "review" else ""))),
        "is_eligible": F.lit(True) if always else eligible(confidence, least), "ineligible_reason": F.lit(None).cast("string") if always else ineligible_reason(confidence, least),
    }).dropDuplicates(["finding_id"])


def finding_id(run_id: str, source_name: Column | str, span_id: Column) -> Column:
    """The id of a finding (record_id, start, end, category, exact_text) of a source."""
    source = F.col(source_name) if isinstance(source_name, str) else source_name
    return K.content_id("finding", *map(K.json_string, (F.lit(run_id), F.col("record_id"), source)), *(F.col(c).cast("string") for c in ("start", "end")), *map(K.json_string, (F.col("category"), span_id, F.col("exact_text"))))


def eligible_findings(rows: DataFrame) -> DataFrame:
    return rows.where("is_eligible").orderBy("record_id", "start", "end", "finding_id")


# ---- validation ----

def call_validator(items: DataFrame, validator: Callable[[], Validator], workers: int = 2, tiers: tuple[int, ...] = VALIDATION_TIERS) -> AbstractContextManager[tuple[DataFrame, Permits]]:
    """As call_detector, for work items (work_item_id, record_id, original_text, deidentified_text, truncations): every
    attempt, as an answer that is cut off is asked again with the next tier of tokens; what ends otherwise is the last.
    An item starts at the tier that its earlier truncations reach; one that was cut off at the last tier is not called."""

    def one(made: Validator, r: Any) -> Iterator:
        usage = {"request_count": 1, "input_chars": len(r.original_text) + len(r.deidentified_text), "input_bytes": len(r.original_text.encode()) + len(r.deidentified_text.encode())}
        for most in tiers[int(r.truncations) :]:
            yield lambda most=most: made.validate(original_text=r.original_text, deidentified_text=r.deidentified_text, max_tokens=most), usage, most

    return _called(items.where(F.col("truncations") < len(tiers)), ["work_item_id", "record_id", "original_text", "deidentified_text", "truncations"], validator, one, workers)


def validation_outcome(attempts: DataFrame, tiers: tuple[int, ...] = VALIDATION_TIERS) -> DataFrame:
    """(record_id, status, result): a record's stage status after its latest attempt, and the result's (succeeded,
    truncated, technical_error). A truncation with a tier left is retry_pending and makes no result yet."""
    last = attempts.groupBy("record_id").agg(F.max_by("status", "attempt_number").alias("last"), K.count_if(F.col("status") == "truncated").alias("cut"))
    cut, left = F.col("last") == "truncated", F.col("cut") < len(tiers)
    status = F.when(F.col("last") == "succeeded", "succeeded").when(cut & left, "retry_pending").when(cut | (F.col("last") == "retryable_error"), "retry_exhausted").otherwise("permanent_error")
    result = F.when(F.col("last") == "succeeded", "succeeded").when(cut & ~left, "truncated").when(~cut, "technical_error")
    return last.select("record_id", status.alias("status"), result.alias("result"))


def verdict(records: DataFrame, found: DataFrame, policy: P.Policy) -> DataFrame:
    """(record_id, raw_violation, effective_violation, ignored) of validated records: findings (record_id, category) of
    categories that the policy retains are ignored. A record without findings violates nothing."""
    ignored = F.coalesce(F.col("category").isin(*P.retained(policy)), F.lit(False))
    rows = found.groupBy("record_id").agg(F.count("*").alias("n"), K.count_if(ignored).alias("ignored"))
    met = records.select("record_id").join(rows, "record_id", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("ignored", F.lit(0))
    return met.select("record_id", (n > 0).alias("raw_violation"), (n > k).alias("effective_violation"), k.cast("long").alias("ignored"))


def validation_findings(found: DataFrame, run_id: str, rendering: str, policy: P.Policy) -> DataFrame:
    """found (record_id, index from 1, category, evidence, and the rendering's id in column ``rendering``) with
    ignored_by_policy and validation_finding_id."""
    parts = [K.json_string(F.lit(run_id)), K.json_string(F.col("record_id")), K.json_string(F.col(rendering)), F.col("index").cast("string"), K.json_string(F.col("category")), K.json_string(F.col("evidence"))]
    return found.withColumn("ignored_by_policy", F.col("category").isin(*P.retained(policy))).withColumn("validation_finding_id", K.content_id("validation-finding", *parts))


def parse_verdicts(attempts: DataFrame) -> DataFrame:
    """(record_id, index, category, evidence, confidence, rationale, error) of succeeded attempts (record_id, status, and raw,
    an answer as JSON, or its parts findings and rationale): one bad finding, of an unknown category, without evidence or
    with a confidence other than low, medium or high, makes the whole answer bad."""
    kind = "array<struct<category:string,evidence:string,confidence:string,rationale:string>>"
    rows = attempts.where("status = 'succeeded'")
    if "raw" in rows.columns:
        rows = rows.withColumns({n: F.get_json_object("raw", f"$.{n}") for n in ("findings", "rationale")})
    rows = rows.withColumn("f", F.from_json("findings", kind))
    good = F.forall("f", lambda x: F.coalesce(x["category"].isin(*K.CATEGORIES) & (F.length(x["evidence"]) > 0) & x["confidence"].isin("low", "medium", "high"), F.lit(False)))
    whole = F.coalesce(F.col("rationale").isNotNull() & good, F.lit(False))
    rows = rows.select("record_id", F.when(whole, F.col("f")).alias("f"), F.when(~whole, "bad_answer").alias("error"))
    return rows.select("record_id", "error", F.posexplode_outer("f").alias("index", "x")).select("record_id", (F.col("index") + 1).alias("index"), "x.category", "x.evidence", "x.confidence", "x.rationale", "error")


def review_routing(verdicts: DataFrame, review_all: bool = False) -> DataFrame:
    """(record_id, review_state, record_status): an effective violation, or a scope of all, goes to review."""
    needs = F.col("effective_violation") | F.lit(review_all)
    return verdicts.select("record_id", F.when(needs, "review_pending").otherwise("skipped").alias("review_state"), F.when(needs, "awaiting_review").otherwise("processing").alias("record_status"))


def routing_without_validation(records: DataFrame, review_all: bool) -> DataFrame:
    """As review_routing where nothing is validated: all records go to review, or none."""
    return review_routing(records.select("record_id", F.lit(False).alias("effective_violation")), review_all)


# ---- prices ----


def token_cost(tokens: Column, rate_per_million: Column) -> Column:
    """Null where either is."""
    return tokens * rate_per_million / 1e6


def tokens_of(characters: int) -> int:
    return math.ceil(characters / 4)
