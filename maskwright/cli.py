"""The command line: check, run, status, resume, retry, revise, export, list. Text, or JSON with --json; 1 on errors."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from .config import read_config
from .plans import run as U


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    p.add_argument("--json", action="store_true")
    p.add_argument("--with", dest="module", help="a module with detectors (by name), validator and secrets, as far as the run needs them")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "run"):
        sub.add_parser(name).add_argument("config")
    for name in ("status", "resume"):
        sub.add_parser(name).add_argument("folder")
    sub.add_parser("list").add_argument("folder")
    retry = sub.add_parser("retry")
    retry.add_argument("folder")
    retry.add_argument("--record")
    retry.add_argument("--stage")
    retry.add_argument("--failed", action="store_true")
    revise = sub.add_parser("revise")
    revise.add_argument("folder")
    revise.add_argument("config")
    revise.add_argument("--reason", required=True)
    revise.add_argument("--allow-paid", action="store_true")
    export = sub.add_parser("export")
    export.add_argument("folder")
    export.add_argument("path")
    export.add_argument("--columns", required=True, help="names, parted by commas")
    export.add_argument("--format", default="parquet", choices=["parquet", "jsonl"])
    export.add_argument("--mode", default="ready_only", choices=["ready_only", "all_records"])
    return p


def _given(module: str | None) -> dict[str, Any]:
    """What a module gives to a run: executors import it too, so it has to be on their path."""
    if not module:
        return {}
    found = importlib.import_module(module)
    return {n: getattr(found, n) for n in ("detectors", "validator", "secrets") if hasattr(found, n)}


def _do(a: argparse.Namespace, spark: SparkSession) -> Any:
    given = _given(a.module)
    if a.command == "check":
        issues = U.precheck(spark, read_config(a.config), given.get("detectors"), given.get("secrets"))
        return {"ok": not any(i["level"] == "error" for i in issues), "issues": issues}
    if a.command == "run":
        run = U.create_run(spark, read_config(a.config), **given)
        return {"run_id": run.facts["run_id"], "folder": str(run.folder), "status": run.execute()}
    if a.command == "list":
        return {"runs": U.discover_runs(spark, a.folder)}
    run = U.open_run(spark, a.folder, **given)
    if a.command == "status":
        return run.status()
    if a.command == "resume":
        return {"status": run.resume()}
    if a.command == "retry":
        return {"records": run.retry(a.record, a.stage, a.failed)}
    if a.command == "revise":
        child = run.revise(read_config(a.config), a.reason, a.allow_paid)
        return {"run_id": child.facts["run_id"], "folder": str(child.folder), "status": child.execute()}
    return {"rows": run.export(a.path, [c.strip() for c in a.columns.split(",")], a.format, a.mode)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        out = _do(a, spark or SparkSession.builder.appName("maskwright").getOrCreate())
    except Exception as e:  # noqa: BLE001  an error is a line and an exit code
        print(json.dumps({"error": str(e)}) if a.json else f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, default=str, ensure_ascii=False) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
    return 0 if out.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())
