"""Runs on a real ledger: every table is looked at after execute, retry, decide and revise."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright import config as C
from maskwright.functions import core as K
from maskwright.operators import ledger as L
from maskwright.operators import reporting as M
from maskwright.operators import review as V
from maskwright.operators import spans as S
from maskwright.operators import work as W
from maskwright.plans import ledger as D
from maskwright.plans import run as U
from maskwright.sources import records as R

DECISION = "record_id string, disposition string, reviewer_id string, review_seconds int, plan_revision int"


def rows(df):
    return [tuple(r) for r in df.collect()]


def counting(folder, stop_at=None, names=("Mira", "Tomas")):
    """A detector that leaves a file for each call, and throttles from its stop_at-th one while there is a file stop."""

    class Counting:
        def detect(self, text):
            import os
            import uuid

            n = len([x for x in os.listdir(folder) if x.endswith(".call")]) + 1
            with open(f"{folder}/{uuid.uuid4().hex}.call", "w") as f:
                f.write(text)
            if stop_at and n >= stop_at and os.path.exists(f"{folder}/stop"):
                raise W.ServiceError("ThrottlingException")
            return [{"category": "NAME", "text": n, "start": text.find(n), "end": text.find(n) + len(n), "confidence": 0.9} for n in names if n in text]

    return Counting


def calls(folder):
    return sorted(p.read_text() for p in folder.glob("*.call"))


def make(spark, tmp_path, texts, detector=None, validator=None, kinds=("model",), **settings):
    table = [(f"n{k}", f"p{k % 2}", t, "Oslo", f"1/{k + 1}/2020", 40 + k, k % 2 == 0, None) for k, t in enumerate(texts)]
    spark.createDataFrame(table, "note string, who string, body string, city string, day string, age int, ok boolean, none double").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    source = C.Input(f"{tmp_path}/in", "note", "body", "who", metadata=("city", "day", "age", "ok", "none"), structured={"city": "LOCATION", "day": "DATE"})
    detectors = tuple(C.DetectorSettings(f"d{i}", kind) for i, kind in enumerate(kinds)) if detector else ()
    config = C.Config(source, output_dir=f"{tmp_path}/runs", detectors=detectors, rules=(S.Rule("num", "number", "ID", "[0-9]{4}"),), **settings)
    clock = iter(datetime(2024, 1, 1) + timedelta(seconds=k) for k in range(10_000))
    made = detector if isinstance(detector, dict) else {d.name: detector for d in detectors}
    return U.create_run(spark, config, detectors=made, validator=validator, secrets=lambda _: "secret", clock=lambda: next(clock))


def check_report(run):
    """The counters' report equals the one recomputed from the tables, and states and records agree."""
    got, records, states = run.status(), run.table("records"), run.table("states")
    assert [(r["status"], r["n"]) for r in got["records"]["counts"]] == [tuple(r)[:2] for r in M.record_counts(records).collect()]
    assert [tuple(r.values()) for r in got["stages"]["records"]] == rows(M.stage_matrix(states))
    assert {r["stage"]: r["status"] for r in got["stages"]["run"]} == dict(rows(L.stage_rollup(states)))
    want = {tuple(r[k] for k in M.ERROR_KEYS): r["occurrences"] for r in M.error_groups(run.table("errors")).collect()}
    assert {tuple(g[k] for k in M.ERROR_KEYS): g["occurrences"] for g in got["errors"]["groups"]} == want
    finalization = {r["stage"]: r["status"] for r in got["stages"]["run"]}["finalization"]
    assert got["status"] == "blocked" or got["status"] == L.run_rollup(records, finalization).first()["status"]
    for t, keys in U._KEYS.items():
        df = run.stored(t)
        assert df.groupBy(*keys).count().where("count > 1").isEmpty(), t
    return got


def test_corrections_go_in_together_or_not_at_all(spark, tmp_path):
    (tmp_path / "c").mkdir()
    run = make(spark, tmp_path, ["Secretname met Mira 1234", "Tomas", "plain", "Mira"], counting(str(tmp_path / "c")), review=True, review_all=True)
    assert run.execute() == "awaiting_review"
    view = run.view("n0")
    basis = view["basis"].first()["revision"]
    group = view["groups"].where("category = 'ID'").first()
    decide = lambda *d, **k: run.decide(spark.createDataFrame(list(d), DECISION), **k)
    edit = lambda *e: spark.createDataFrame(list(e), V.SPAN_EDIT)
    before = run.version
    for bad, edits, reason in (
        ([("n0", "corrected", "me", 1, basis)], None, "correction_without_edits"), ([("n0", "whatever", "me", 1, basis)], None, "unknown_disposition"),
        ([("n0", "excluded", "me", 1, basis), ("n0", "approved_unchanged", "me", 1, basis)], None, "repeated_record"), ([("n0", "approved_unchanged", "me", 1, basis + 1)], None, "no_draft"),
        ([("n9", "excluded", "me", 1, None)], None, "no review is pending"), ([("n0", "corrected", "me", 1, basis)], edit(("n0", "add", None, None, 0, 10, "NAME", "Wrong")), "text_mismatch"),
        ([("n0", "approved_unchanged", "me", 1, basis)], edit(("n0", "add", None, None, 0, 10, "NAME", "Secretname")), "edits_without_correction"), ([("n2", "approved_unchanged", "me", 1, None)], edit(("n0", "add", None, None, 0, 10, "NAME", "Secretname")), "edits_without_decision"),
    ):
        with pytest.raises(ValueError, match=reason):
            decide(*bad, edits=edits)
    assert run.version == before
    other = U.open_run(spark, run.folder)  # began at the same version, and is refused once that has moved on
    edits = edit(("n0", "add", None, None, 0, 10, "NAME", "Secretname"), ("n0", "remove", group["group_id"], group["finding_ids"], None, None, None, None))
    fields = spark.createDataFrame([("n0", "city", "LOCATION", "Oslo", "somewhere")], V.FIELD_EDIT)
    assert decide(("n0", "corrected", "me", 7, basis), ("n1", "excluded", "me", 1, None), edits=edits, fields=fields) == before + 1
    with pytest.raises(D.Conflict):
        other.ledger.commit(other.head, {}, {"status": "odd"})
    found = {(r["source_kind"], r["exact_text"]): r["is_eligible"] for r in run.table("findings").where("record_id = 'n0'").collect()}
    assert found == {("llm", "Mira"): True, ("rule", "1234"): False, ("review", "Secretname"): True}
    assert sorted(rows(run.table("resolutions").where("record_id = 'n0'").select("revision", "reason"))) == [(1, "detection"), (2, "review correction")]
    assert sorted(rows(run.table("plans").where("record_id = 'n0'").select("plan_revision", "status"))) == [(1, "stale"), (2, "active")]
    assert {r["plan_revision"]: (r["rendered"], r["is_stale"]) for r in run.table("renderings").where("record_id = 'n0'").collect()} == {1: ("Secretname met [R_NAME] [R_ID]", True), 2: ("[R_NAME] met [R_NAME] 1234", False)}
    decision = run.table("review_decisions").where("record_id = 'n0'").first()
    assert decision["basis_revision"] == 1 and len(json.loads(decision["events"])) == 3
    assert rows(run.table("records").where("record_id = 'n1'").select("status")) == [("excluded",)]
    decide(("n2", "approved_unchanged", "me", 2, None), ("n3", "approved_unchanged", "you", 3, None))
    assert run.execute() == "completed"
    run.export(f"{tmp_path}/out", ["record_id", "final_text", "city", "age", "ok", "none"])
    out = {r["record_id"]: tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {"n0": ("[R_NAME] met [R_NAME] 1234", "somewhere", "40", "true", None), "n2": ("plain", "[R_LOC]", "42", "true", None), "n3": ("[R_NAME]", "[R_LOC]", "43", "false", None)}
    assert json.loads(run.table("records").where("record_id = 'n2'").first()["final_metadata"]) == {"city": "[R_LOC]", "day": "[R_DATE]/[R_DATE]/2020", "age": 42, "ok": True, "none": None}
    got = check_report(run)
    assert got["exports"][0]["sha256"] and got["review"]["by_reviewer"][0]["reviewer_id"] == "me" and {r["purpose"] for r in got["structured"]} == {"draft", "final"}


def scripted():
    """A validator that objects to a word, fails on another, and cuts long ones off at small sizes."""

    class Scripted:
        def validate(self, *, original_text, deidentified_text, max_tokens):
            import os

            if "FAIL" in original_text and not os.path.exists("/tmp/maskwright-test-mended"):
                raise ValueError("cannot read this")
            if "LONG" in original_text and max_tokens < 16384:
                return {"stop_reason": "max_tokens", "usage": {"output_tokens": max_tokens}}
            found = [{"category": "NAME", "evidence": "x", "confidence": "high", "rationale": "seen"}] if "LEFT" in original_text else []
            return {"rationale": "read", "findings": found, "stop_reason": "end"}

    return Scripted


def test_later_executions_keep_what_earlier_ones_found(spark, tmp_path):
    import pathlib

    mended = pathlib.Path("/tmp/maskwright-test-mended")
    mended.unlink(missing_ok=True)
    run = make(spark, tmp_path, ["Mira", "FAIL Mira", "LEFT Mira", "LONG Mira 1234"], validator=scripted(), validation=True, review=True)
    assert run.execute() == "awaiting_review"
    results = {r["record_id"]: (r["status"], r["effective_violation"], r["error_code"]) for r in run.table("validation_results").collect()}
    assert results == {"n0": ("succeeded", False, None), "n1": ("technical_error", None, "ValueError"), "n2": ("succeeded", True, None), "n3": ("succeeded", False, None)}
    assert [(r["attempt_number"], r["max_tokens"], r["status"]) for r in run.table("attempts").where("record_id = 'n3'").orderBy("attempt_number").collect()] == [(1, 4096, "truncated"), (2, 8192, "truncated"), (3, 16384, "succeeded")]
    usage = check_report(run)["usage"]
    assert [(u["backend_kind"], u["attempts"], u["output_tokens"], u["stop_reasons"]) for u in usage] == [("validator", 6, 4096 + 8192, {"end": 3, "max_tokens": 2})]
    run.decide(spark.createDataFrame([("n2", "approved_unchanged", "me", 3, None)], DECISION))
    mended.touch()
    try:
        assert run.retry("n1") == 1 and run.execute() == "completed"
    finally:
        mended.unlink()
    assert rows(run.table("validation_results").where("not is_stale").groupBy("status").count()) == [("succeeded", 4)]
    assert run.table("validation_findings").count() == 1 and check_report(run)["validation"]["effective_violations"] == 1
    assert rows(run.table("records").select("status").distinct()) == [("ready",)] and rows(run.table("errors").select("record_id", "resolved")) == [("n1", True)]


def test_a_systemic_failure_stops_all_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ITEMS_A_TASK", 3)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "stop").touch()
    run = make(spark, tmp_path, [f"text {k} Mira" for k in range(24)], counting(str(tmp_path / "c"), 5))
    assert run.execute() == "blocked" and "stopped all calls" in run.facts["blocked_by"]
    made = len(calls(tmp_path / "c"))
    assert 5 <= made <= 5 + run.config.workers
    assert rows(run.table("states").where("stage = 'detection'").select("status").distinct()) == [("pending",)]
    good = run.table("attempts").where("status = 'succeeded'").count()
    assert good == 4 and run.table("attempts").count() == made and run.table("findings").count() == 4
    (tmp_path / "c" / "stop").unlink()
    assert run.resume() == "completed_with_errors"  # what was throttled has had its one try
    assert len(calls(tmp_path / "c")) == len(set(calls(tmp_path / "c"))) == 24
    assert run.retry(stage="detection", failed=True) == made - 4 and run.resume() == "completed"
    again = calls(tmp_path / "c")
    assert len(again) == 24 + made - 4 and run.table("attempts").where("attempt_number = 2").count() == made - 4
    assert rows(run.table("errors").select("resolved").distinct()) == [(True,)]
    check_report(run)


def test_an_escalation_goes_on_at_its_tier(spark, tmp_path):
    (tmp_path / "c").mkdir()
    folder = str(tmp_path / "c")

    def make_validator():
        class Interrupted:
            def validate(self, *, original_text, deidentified_text, max_tokens):
                import os

                open(f"{folder}/{max_tokens}-{len(os.listdir(folder))}", "w").close()
                if max_tokens == 4096:
                    return {"stop_reason": "max_tokens"}
                if len(os.listdir(folder)) == 2:
                    raise TimeoutError("no answer")
                return {"rationale": "read", "findings": []}

        return Interrupted

    run = make(spark, tmp_path, ["Mira"], validator=make_validator(), validation=True, review=True)
    assert run.execute() == "blocked" and run.retry("n0") == 1 and run.execute() == "completed"
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["4096-0", "8192-1", "8192-2"]
    assert [(r["attempt_number"], r["max_tokens"]) for r in run.table("attempts").orderBy("attempt_number").collect()] == [(1, 4096), (2, 8192), (3, 8192)]


def entities():
    class Service:
        def detect(self, text):
            at = text.find("Tomas")
            return {"Entities": [{"Type": "NAME", "Text": "Tomas", "BeginOffset": at, "EndOffset": at + 5, "Score": 0.7, "Id": 1}] if at >= 0 else []} if "BAD" not in text else {"Entities": [{"Type": "NAME", "Text": "Tomas", "BeginOffset": 1, "EndOffset": 6, "Score": 0.7}]}

    return Service


def parts():
    class Model:
        def detect(self, text):
            at = text.find("Mira")
            found = json.dumps({"findings": [{"category": "NAME", "text": "Mira", "start": at, "end": at + 4, "confidence": 0.8}] if at >= 0 else []})
            return {"content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": found[:9]}, {"type": "text", "text": found[9:]}], "stop_reason": "max_tokens" if "LONG" in text else "end", "usage": {"input_tokens": 5}}

    return Model


def test_answers_are_read_by_kind_and_a_revision_calls_nothing_again(spark, tmp_path):
    run = make(spark, tmp_path, ["Mira met Tomas", "Tomas 1234", ""], {"d0": entities(), "d1": parts()}, kinds=("service", "model"))
    assert run.execute() == "completed"
    text = lambda r: sorted(rows(r.table("renderings").where("kind = 'final'").select("record_id", "rendered")))
    assert text(run) == [("n0", "[R_NAME] met [R_NAME]"), ("n1", "[R_NAME] [R_ID]")]
    found = lambda r: sorted(rows(r.table("findings").select("record_id", "source_kind", "source_name", "start", "end", "exact_text", "span_id")))
    assert {x[1:3] for x in found(run)} == {("aws", "d0"), ("llm", "d1"), ("rule", "embedded_rules")}
    from dataclasses import replace

    run.detectors = {}  # nothing may be called
    child = run.revise(replace(run.config, policy=K.DEFAULT_POLICY | {"NAME": ("retain", None)}), "names stay")
    assert child.execute() == "completed" and text(child) == [("n0", "Mira met Tomas"), ("n1", "Tomas [R_ID]")]
    assert found(child) == found(run) and child.table("attempts").count() == run.table("attempts").count() == 4
    ids = lambda r, t, c: {x[0] for x in rows(r.table(t).select(c))}
    for t, c in (("findings", "finding_id"), ("work", "work_item_id"), ("attempts", "attempt_id")):
        assert not ids(run, t, c) & ids(child, t, c)
    got = check_report(child)
    assert {u["backend_id"]: (u["requests_in_this_run"], u["requests_reused_from_parent"]) for u in got["usage"]} == {"d0": (0, 2), "d1": (0, 2)} and got["stages"]["run"][1]["provenance"] == "reused_from_parent"
    with pytest.raises(ValueError, match="calls detectors again"):
        run.revise(replace(run.config, detectors=run.config.detectors[:1]), "one less")
    bad = make(spark, tmp_path, ["BAD Tomas", "LONG Mira"], {"d0": entities(), "d1": parts()}, kinds=("service", "model"))
    assert bad.execute() == "completed_with_errors"
    assert sorted(rows(bad.table("errors").select("record_id", "error_code"))) == [("n0", "bad_answer"), ("n1", "truncated")]


def test_dates_of_an_entity_never_move_by_other_weeks(spark, tmp_path):
    policy = K.DEFAULT_POLICY | {"DATE": ("surrogate", "date_shift:year_only")}
    run = make(spark, tmp_path, ["on 1/2/2020", "on 1/3/2020"], policy=policy, secret_reference="any")
    assert run.execute() == "completed" and run.table("shifts").count() == 2
    first = rows(run.table("shifts"))
    run.retry  # noqa: B018
    run.secrets = lambda _: "another"
    with run.locked():
        run.commit(states=run.stored("states").where("stage = 'finalization'").withColumns({"was": F.col("status"), "status": F.lit("pending")}))
    with pytest.raises(ValueError, match="other weeks"):
        run.execute()
    assert run.facts["status"] == "failed" and sorted(rows(run.table("shifts"))) == sorted(first)


# ---- the ledger itself ----


def test_tables_of_a_run_join_by_record_and_item_without_moving(spark, tmp_path):
    """Work items and attempts lie by record_id; what meets by that and more keys is not dealt out again."""
    own = D.own_session(spark)
    ledger = D.Ledger(own, f"{tmp_path}/l", {"work": ("record_id", "work_item_id"), "attempts": ("record_id", "work_item_id")})
    ledger.set_buckets(4)
    items = own.range(50).select(F.concat(F.lit("r"), "id").alias("record_id"), F.concat(F.lit("w"), "id").alias("work_item_id"), F.lit(0).alias("start"), F.lit("a the b").alias("chunk"))
    answer = '{"findings": [{"category": "NAME", "text": "the", "start": 2, "end": 5, "confidence": 2}]}'
    made = items.select("record_id", "work_item_id", F.col("work_item_id").alias("attempt_id"), F.lit("succeeded").alias("status"), F.lit(answer).alias("raw"))
    head = ledger.commit(D.Head(), {"work": items, "attempts": made})
    work, attempts, item = ledger.read(head, "work"), ledger.read(head, "attempts"), ["record_id", "work_item_id"]
    found = W.parse_answers(attempts, work)
    failed = W.answers_failed(ledger.kept(found), *item)
    for df in (W.appended(attempts, work, item), found, attempts.join(failed, item)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
    assert attempts.join(failed, item).where("error = 'bad_confidence'").count() == 50


def test_the_ledger_appends_changes_alone(spark, tmp_path):
    import os

    def size(folder):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)

    grown = []
    for n in (1_000, 100_000):
        ledger = D.Ledger(spark, f"{tmp_path}/l{n}", {"states": ("record_id", "stage"), "texts": ("record_id",)}, {"states": (F.col("status"), F.col("was"))})
        ledger.set_buckets(4)
        base = spark.range(n).select(F.concat(F.lit("r"), "id").alias("record_id"), F.lit("a").alias("stage"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("was"))
        head = ledger.commit(D.Head(), {"states": base, "texts": base.select("record_id", F.lit("t").alias("text"))}, {"a": 1})
        before = size(f"{tmp_path}/l{n}")
        new = ledger.commit(head, {"states": base.where("record_id = 'r5'").withColumns({"was": F.col("status"), "status": F.lit("done")})})
        grown.append(size(f"{tmp_path}/l{n}") - before)
        assert head.counters == {"states:open": n} and new.counters == {"states:open": n - 1, "states:done": 1}
        with pytest.raises(D.Conflict):
            ledger.commit(head, {"states": base.limit(1)})
        assert ledger.read(new, "states").where("status = 'done'").count() == 1 and ledger.read(head, "states").where("status = 'done'").count() == 0
    assert abs(grown[1] - grown[0]) < 500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.read(new, "states").join(ledger.read(new, "texts"), "record_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again = D.Ledger(spark.newSession(), f"{tmp_path}/l1000", ledger.keys)
    packed = ledger.compact(new, 1)
    assert ledger.read(packed, "states").count() == 100_000 and packed.tables["states"]["generation"] == 1 and len(packed.tables["texts"]["tokens"]) == 1
    assert again.read(again.head(), "states").where("status = 'done'").count() == 1
    with again.leased():
        with pytest.raises(RuntimeError), D.Ledger(spark, f"{tmp_path}/l1000", ledger.keys).leased():
            pass
    with again.leased(timedelta(seconds=-1)), D.Ledger(spark, f"{tmp_path}/l1000", ledger.keys).leased():
        with pytest.raises(RuntimeError):
            again.renew()


@pytest.mark.parametrize("form", R.FORMATS)
def test_rows_keep_their_places(spark, tmp_path, form):
    for k, values in enumerate(([2, 10, 1], [5] * 400 + [4], [], [7, 3])):
        frame = pd.DataFrame({"id": [str(v) for v in values], "k": k, "n": range(len(values))})
        path = tmp_path / "in" / f"part-{k}.{form}"
        path.parent.mkdir(exist_ok=True)
        if form == "parquet":
            frame.to_parquet(path, row_group_size=64)
        elif values:
            frame.to_json(path, orient="records", lines=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sorted((r["place__"], r["k"], r["n"]) for r in R.read_in_order(spark, str(tmp_path / "in"), form).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(k, n) for _, k, n in got] == [(0, 0), (0, 1), (0, 2), *((1, n) for n in range(401)), (3, 0), (3, 1)] and [p for p, _, _ in got] == list(range(406))


def test_workspaces_equal_a_simulation(spark):
    rng = np.random.default_rng(8)
    events, start = [], datetime(2024, 1, 1)
    for n in range(400):
        kind = ["start", "start", "pause", "set"][int(rng.integers(0, 4))]
        start += timedelta(seconds=float(rng.choice([0, 0.4, 1.5, 7, 60])))
        events.append((str(n), f"r{rng.integers(0, 4)}", f"u{rng.integers(0, 3)}", start, kind, int(rng.integers(0, 99)) if kind == "set" else None, int(rng.integers(1, 3))))
    want, running = {}, {}

    def stop(user, at):
        if user in running:
            record, since = running.pop(user)
            want[user, record][0] += int((at - since).total_seconds())

    for _, record, user, at, kind, seconds, revision in events:
        if kind == "start":
            if user in running and running[user][0] == record and want[user, record][1] == revision:
                continue
            stop(user, at)
            if want.get((user, record), [0, None])[1] != revision:
                want[user, record] = [0, revision]
            running[user] = (record, at)
        elif kind == "pause":
            if user in running and running[user][0] == record:
                stop(user, at)
        else:
            if user in running and running[user][0] == record:
                del running[user]
            want[user, record] = [seconds, revision]
    basis = spark.createDataFrame([(f"r{k}", 2) for k in range(4)], "record_id string, revision int")
    got = {(r["reviewer_id"], r["record_id"]): (r["seconds"], r["plan_revision"], r["running"], r["is_fresh"]) for r in V.workspaces(spark.createDataFrame(events, U._SCHEMAS["timers"]), basis).collect()}
    assert got == {k: (s, v, running.get(k[0], (None,))[0] == k[1], v == 2) for k, (s, v) in want.items()} and len(got) == 12


def test_what_a_run_appends_passes_no_driver_and_is_computed_once(spark, tmp_path, monkeypatch):
    from maskwright.plans.ledger import Ledger

    plans, append = [], Ledger._append

    def watched(self, name, t, df, version, token):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        append(self, name, t, df, version, token)

    spark.createDataFrame([(f"n{i}", f"the note {1000 + i}") for i in range(20)], "id string, text string").write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(Ledger, "_append", watched)

    class Marker:
        def detect(self, text):
            return [{"category": "NAME", "text": "the", "start": 0, "end": 3, "confidence": 0.9}]

    config = C.Config(C.Input(f"{tmp_path}/in", "id", "text"), output_dir=f"{tmp_path}/runs", detectors=(C.DetectorSettings("marker", "model"),), rules=(S.Rule("digits", "four digits", "ID", "[0-9]{4}"),), review=False)
    run = U.create_run(spark, config, detectors={"marker": lambda: Marker()})
    assert run.execute() == "completed"
    grown = [(n, p) for n, p in plans if n != "backends"]
    assert not [n for n, p in grown if "Broadcast" in p]
    assert "Broadcast" not in run.table("records")._jdf.queryExecution().executedPlan().toString()
    # answers are aligned by Python once, in a table of the step, and not for each table that takes of them
    assert {n for n, p in grown if "InPandas" in p} == {"attempts"} and not [n for n, p in grown if "ArrowEvalPython" in p and n in ("work", "errors", "states", "status")]
    assert run.table("renderings").where("kind = 'final' and rendered like '[R_NAME] note [R_ID]'").count() == 20
    assert not run.ledger.files.names("steps") and not [t for t in spark.catalog.listTables() if "_step_" in t.name]
