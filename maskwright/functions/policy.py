"""What happens to each category: policies, their checks and their lookup as Column expressions.

A policy maps every category to (action, strategy). Strategies: a generalization (year_only, age_90_plus); of surrogates
``date_shift:<fallback>`` for dates, ``list`` or ``synthetic`` for all others; else None."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import core as K

# Fixed values.
ACTIONS = ("retain", "redact", "generalize", "surrogate")
GENERALIZATIONS = {"DATE": "year_only", "AGE": "age_90_plus"}
CONSISTENCY = ("occurrence", "record", "entity")
FALLBACKS = ("redact", "year_only")

Policy = dict[str, tuple[str, str | None]]


def check(policy: Policy) -> Policy:
    """Every category has one action; only dates and ages are generalized, each in its own way; dates are the only ones
    that move and they do nothing else as surrogates."""
    if set(policy) != set(K.CATEGORIES):
        raise ValueError(f"a policy names all categories: {', '.join(sorted(set(K.CATEGORIES) ^ set(policy)))}")
    for category, (action, strategy) in policy.items():
        if action not in ACTIONS:
            raise ValueError(f"no such action: {action}")
        if action == "generalize" and GENERALIZATIONS.get(category) != strategy:
            raise ValueError(f"{category} is not generalized by {strategy}")
        if action == "surrogate":
            moves = (strategy or "").startswith("date_shift")
            if moves != (category == "DATE") or (not moves and strategy not in ("list", "synthetic")):
                raise ValueError(f"{category} has no surrogate {strategy}")
            if moves and date_fallback(policy) not in FALLBACKS:
                raise ValueError(f"no such fallback: {strategy}")
    return policy


def date_fallback(policy: Policy) -> str:
    return ((policy["DATE"][1] or "").partition(":")[2]) or "year_only"


def _lookup(category: Column, values: dict[str, str | None]) -> Column:
    return F.element_at(F.create_map(*(x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast("string")))), category)


def action_of(category: Column, policy: Policy) -> Column:
    return _lookup(category, {c: a for c, (a, _) in policy.items()})


def strategy_of(category: Column, policy: Policy) -> Column:
    return _lookup(category, {c: s for c, (_, s) in policy.items()})


def retained(policy: Policy) -> tuple[str, ...]:
    return tuple(c for c, (a, _) in policy.items() if a == "retain")
