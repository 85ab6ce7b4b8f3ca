"""Structured fields: mapped columns become rows, are transformed by the policy, and go back into their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as K
from ..functions import dates as D
from ..functions import policy as P


def structured_events(records: DataFrame, mapping: dict[str, str], policy: P.Policy = K.DEFAULT_POLICY, weeks: Column | None = None, surrogates: DataFrame | None = None) -> DataFrame:
    """(record_id, structured_event_id, column_name, category, action, original, replacement, error) for every mapped
    column that is not null; values as text. There is no draft: structured values are replaced alike at any time.

    Dates move by ``weeks``, by their type; other surrogates come from ``surrogates`` (record_id, column_name,
    surrogate). Both are needed where the policy asks for them. Records are not shuffled unless surrogates are joined."""
    P.check(policy)
    kinds = dict(records.dtypes)
    missing = sorted(set(mapping) - set(kinds))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    made = []
    for column, category in mapping.items():
        action, strategy = policy[category]
        value, text, error = F.col(column), F.col(column).cast("string"), F.lit(None).cast("string")
        if action == "retain":
            new = text
        elif action == "redact":
            new = F.lit(K.PLACEHOLDERS[category])
        elif action == "generalize":
            new = D.year_only(text) if strategy == "year_only" else K.age_90_plus(text)
        elif category == "DATE":
            if weeks is None:
                raise ValueError("dates need the weeks to move by")
            kind = "timestamp" if kinds[column].startswith("timestamp") else "date" if kinds[column] == "date" else "string"
            new, error = D.shift_value(value if kind != "string" else text, kind, weeks, P.date_fallback(policy))
        elif surrogates is None:
            raise ValueError("surrogates are needed")
        else:
            new = F.lit(None).cast("string")
        made.append(F.struct(F.lit(column).alias("column_name"), F.lit(category).alias("category"), F.lit(action).alias("action"), text.alias("original"), new.alias("replacement"), error.alias("error")))
    # each column is computed beside the record before its rows part, so that no record is read twice
    rows = records.select("record_id", F.array(*made).alias("made")).select("record_id", F.inline("made")).where("original is not null")
    if surrogates is not None:
        rows = rows.join(surrogates.select("record_id", "column_name", "surrogate"), ["record_id", "column_name"], "left")
        mine = (F.col("action") == "surrogate") & (F.col("category") != "DATE")
        rows = rows.withColumn("error", F.when(mine & F.col("surrogate").isNull(), "no_surrogate").otherwise(F.col("error"))).withColumn("replacement", F.when(mine, F.col("surrogate")).otherwise(F.col("replacement"))).drop("surrogate")
    name = F.concat_ws(":", F.lit("structured"), "record_id", "column_name")
    return rows.select("record_id", name.alias("structured_event_id"), "column_name", "category", "action", "original", "replacement", "error")


def surrogate_requests(records: DataFrame, mapping: dict[str, str], policy: P.Policy, ordinal: str) -> DataFrame:
    """Requests for the mapped columns whose category asks for surrogates; records carry entity_id and ``ordinal``."""
    columns = [(c, k) for c, k in mapping.items() if policy[k][0] == "surrogate" and k != "DATE"]
    made = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("category"), F.col(c).cast("string").alias("original_text"), F.lit(n).alias("at")) for n, (c, k) in enumerate(columns)]
    if not made:
        raise ValueError("no mapped column asks for surrogates")
    rows = records.select("record_id", "entity_id", F.col(ordinal).alias("index"), F.inline(F.array(*made))).where("original_text is not null")
    return rows.select(F.concat_ws(":", F.lit("structured"), "record_id", "column_name").alias("event_id"), "record_id", "entity_id", "column_name", "category", "original_text", (F.col("index") * len(made) + F.col("at")).alias("ordinal"))


def overridden(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Final events after a review's overrides (record_id, column_name, value, which may be null)."""
    met = events.join(overrides.select("record_id", "column_name", "value", F.lit(True).alias("given")), ["record_id", "column_name"], "left")
    return met.withColumn("replacement", F.when(F.col("given"), F.col("value")).otherwise(F.col("replacement"))).drop("value", "given")


def materialize(records: DataFrame, events: DataFrame) -> DataFrame:
    """records with each event's replacement in its column, as text; columns without an event keep their values."""
    columns = [r["column_name"] for r in events.select("column_name").distinct().collect()]  # as many as are mapped
    per = events.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "replacement"))).alias("new"))
    met = records.join(per, "record_id", "left")
    has = lambda c: F.coalesce(F.map_contains_key("new", F.lit(c)), F.lit(False))
    return met.withColumns({c: F.when(has(c), F.try_element_at("new", F.lit(c))).otherwise(F.col(c).cast("string")) for c in columns}).drop("new")


def active_events(events: DataFrame, plans: DataFrame) -> DataFrame:
    """The structured events of plans that are active, by column; of events of one id the first stands."""
    return events.dropDuplicates(["structured_event_id", "plan_revision"]).join(plans.where("status = 'active'").select("record_id", "plan_revision"), ["record_id", "plan_revision"])
