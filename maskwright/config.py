"""Configurations and rules as documents: JSON, or YAML where a reader for it is installed."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from .functions import core as K
from .functions import policy as P
from .operators.spans import Rule, check_rules


def read_document(path: str | Path) -> dict[str, Any]:
    """The mapping that a file holds; a missing file, a directory, an empty file and anything else are errors."""
    at = Path(path)
    if not at.exists():
        raise FileNotFoundError(f"no such file: {at}")
    if not at.is_file():
        raise ValueError(f"not a file: {at}")
    text = at.read_text(encoding="utf-8")
    if at.suffix == ".json":
        got = json.loads(text) if text.strip() else None
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"no YAML reader is installed for {at}") from e
        got = yaml.safe_load(text)
    if got is None:
        raise ValueError(f"empty file: {at}")
    if not isinstance(got, dict):
        raise ValueError(f"not a mapping: {at}")
    return got


def _known(cls: type, raw: dict[str, Any], where: str) -> dict[str, Any]:
    extra = sorted(set(raw) - {f.name for f in fields(cls)})
    if extra:
        raise ValueError(f"unknown keys in {where}: {', '.join(extra)}")
    return raw


def parse_rules(raw: dict[str, Any]) -> list[Rule]:
    """The rules of a document {rules: [{id, name, category, pattern, type?, ignore_case?}]}."""
    if set(raw) - {"rules"} or not isinstance(raw.get("rules"), list):
        raise ValueError("a rules document holds a list of rules")
    out = []
    for r in raw["rules"]:
        kind = r.get("type", "regex")
        if kind not in ("regex", "exact") or set(r) - {"id", "name", "category", "pattern", "type", "ignore_case"}:
            raise ValueError(f"not a rule: {r}")
        out.append(Rule(r["id"], r["name"], r["category"], r["pattern"], kind == "exact", bool(r.get("ignore_case", False))))
    return check_rules(out)


def read_rules(path: str | Path) -> list[Rule]:
    return parse_rules(read_document(path))


@dataclass(frozen=True)
class Input:
    path: str
    record_id: str
    text: str
    entity_id: str | None = None
    format: str = "parquet"
    metadata: tuple[str, ...] = ()
    structured: dict[str, str] = field(default_factory=dict)
    repair: bool = False
    order: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "metadata", tuple(self.metadata))
        names = [self.record_id, self.text, *([self.entity_id] if self.entity_id else []), *self.metadata]
        if any(not n or n != n.strip() for n in names):
            raise ValueError("column names are blank or padded")
        if self.record_id == self.text or self.entity_id in (self.text,):
            raise ValueError("id and text are different columns")
        if len(set(self.metadata)) < len(self.metadata) or {self.record_id, self.text} & set(self.metadata):
            raise ValueError("metadata columns are given once, and are neither id nor text")
        if set(self.structured) - set(self.metadata):
            raise ValueError("structured columns are metadata columns")
        if {f"raw_{c}" for c in self.structured} & set(self.metadata):
            raise ValueError("a metadata column is named like a structured one's original")
        if set(self.structured.values()) - set(K.CATEGORIES):
            raise ValueError("a structured column has an unknown category")


@dataclass(frozen=True)
class DetectorSettings:
    """A detector's settings; the callable itself is given to the run by name."""

    name: str
    kind: str = "service"
    min_confidence: float = 0.0
    most_bytes: int | None = 19_000
    overlap: int = 256
    max_output_tokens: int = 8_192
    price_per_100: float | None = None
    input_price: float | None = None
    output_price: float | None = None

    def __post_init__(self):
        if self.kind not in ("service", "model") or not 0 <= self.min_confidence <= 1:
            raise ValueError(f"bad detector settings: {self.name}")

    @property
    def source_kind(self) -> str:
        return {"service": "aws", "model": "llm"}[self.kind]


@dataclass(frozen=True)
class Config:
    """One run. Rules are embedded or a path, not both; validation needs review; review without validation looks at all."""

    input: Input
    output_dir: str = "runs"
    name: str | None = None
    parent_run_id: str | None = None
    detectors: tuple[DetectorSettings, ...] = ()
    workers: int = 2
    rules: tuple[Rule, ...] = ()
    rules_path: str | None = None
    policy: dict[str, tuple[str, str | None]] = field(default_factory=lambda: dict(K.DEFAULT_POLICY))
    surrogate_values: dict[str, list[str]] = field(default_factory=dict)
    consistency: str = "entity"
    secret_reference: str | None = None
    validation: bool = False
    review: bool = False
    review_all: bool = False

    def __post_init__(self):
        if not 1 <= self.workers <= 8:
            raise ValueError("1 to 8 workers")
        if len({d.name for d in self.detectors}) < len(self.detectors):
            raise ValueError("each detector once")
        if self.rules and self.rules_path:
            raise ValueError("rules are embedded or in a file, not both")
        if self.validation and not self.review:
            raise ValueError("validation needs review")
        if self.review and not self.validation and not self.review_all:
            raise ValueError("review without validation looks at all records")
        P.check(self.policy)
        if any(a == "surrogate" for a, _ in self.policy.values()) and not self.secret_reference:
            raise ValueError("surrogates need a secret reference")
        if self.consistency not in P.CONSISTENCY:
            raise ValueError(f"no such consistency: {self.consistency}")

    @property
    def skipped(self) -> tuple[str, ...]:
        """Stages that are not enabled. A validated run has a review even where no scope asks for it."""
        off = {"detection": not (self.detectors or self.rules or self.rules_path), "validation": not self.validation, "review": not (self.review or self.validation)}
        return tuple(s for s in K.STAGES if off.get(s))

    def embedded(self) -> Config:
        """The configuration with a rules file's rules in it, as a run keeps it."""
        from dataclasses import replace

        return replace(self, rules=tuple(read_rules(self.rules_path)), rules_path=None) if self.rules_path else self

    def as_dict(self) -> dict[str, Any]:
        from dataclasses import asdict

        return asdict(self)

    def parts(self) -> dict[str, str | None]:
        """Hashes of what a revision compares; None for what is off."""
        d = self.as_dict()
        return {
            "input": _hash(d["input"]), "detection": _hash(d["detectors"]) if self.detectors else None, "rules": _hash(d["rules"]) if self.rules else None,
            "policy": _hash([d["policy"], d["surrogate_values"], d["consistency"]]), "validation": _hash(True) if self.validation else None, "review": _hash(self.review_all) if self.review else None,
        }


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, non-ASCII kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=list)


def _hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def parse_config(raw: dict[str, Any]) -> Config:
    """A configuration from a document; unknown keys are errors."""
    raw = dict(_known(Config, raw, "the configuration"))
    raw["input"] = Input(**_known(Input, raw.get("input") or {}, "input"))
    raw["detectors"] = tuple(DetectorSettings(**_known(DetectorSettings, d, "a detector")) for d in raw.get("detectors", ()))
    if raw.get("rules"):
        rules = raw["rules"]
        raw["rules"] = tuple(parse_rules({"rules": list(rules)})) if rules and isinstance(rules[0], dict) and "exact" not in rules[0] else tuple(Rule(**r) for r in rules)
    else:
        raw["rules"] = ()
    if "policy" in raw:
        raw["policy"] = dict(K.DEFAULT_POLICY) | {c: tuple(v) if isinstance(v, (list, tuple)) else (v, None) for c, v in raw["policy"].items()}
    return Config(**raw)


def read_config(path: str | Path) -> Config:
    return parse_config(read_document(path))
