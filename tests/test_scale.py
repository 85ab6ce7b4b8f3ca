"""Rules over odd characters, long chains of linked names, and large containers, against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskwright.operators import spans as S
from maskwright.operators import surrogates as G

#: Marks, superscripts, fractions, letter-like numbers, joiners, separators, and blanks of many kinds.
ALPHABET = "aB1_- .\n\t\u0301\u00b2\u00bd\u2167\u200d\u200b\u00a0\u0085\u1680\u2003\u2028\u3000\x1c\x1f\u0660\u4e03\u00e9\u00df\u017f\u212a\u0130\u0131\U0001f642\U0001d7d8"
PATTERNS = [r"\w+", r"\W+", r"\s+", r"\S+", r"\b\w", r"\w\b", r"\B\w", r"\b.\b", r"\d+", r"\D\d", r"[\w-]+", r"[^\s]+", r"[\d.]+", r"[]\w]+", r"\w+\s\w+", r"(?:\bk|s\b)", r"\\?\w", r"[\W\d]+"]


def test_classes_are_pythons_for_any_text(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(ALPHABET + "kKsSaab  ") for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["cafe\u0301 x\u00b2", "a\u200db", "plain text only"]
    rules = [S.Rule(f"r{k}{c}", "r", "ID", p, ignore_case=c) for k, p in enumerate(PATTERNS) for c in (False, True)]
    assert [r.native for r in rules].count(False) == 2
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "record_id string, text string")
    got = {(r["record_id"], r["rule_id"], r["start"], r["end"], r["exact_text"]) for r in S.rule_findings(df, rules).collect()}
    want = {(str(k), r.id, m.start(), m.end(), m[0]) for k, t in enumerate(texts) for r in rules for m in r.compiled.finditer(t) if m.end() > m.start()}
    assert got == want and len(got) > 5000


def test_many_links_in_one_record_are_joined_in_seconds(spark):
    n = 20_000
    text = "Mira Tom. " * n
    names = [("r", f"f{k:06d}", 5 * k, 5 * k + 4, "NAME", "llm", "m", f"g{k // 2 if k % 4 < 2 else k // 4}", None) for k in range(2 * n)]
    f = spark.createDataFrame(names, "record_id string, finding_id string, start int, end int, category string, source_kind string, source_name string, source_group_id string, confidence double")
    began = time.time()
    got = S.resolve_linked(f, spark.createDataFrame([("r", text)], "record_id string, text string")).select("start", "end", F.size("finding_ids").alias("n")).collect()
    assert time.time() - began < 60 and sum(r["n"] for r in got) == 2 * n and 1 <= len(got) <= n


def serial(keyed, ways, stored):
    """First come, first served."""
    used, out = {}, {}
    for r in stored:
        used.setdefault(r["container_hmac"], set()).add(r["surrogate"])
    for r in sorted(keyed, key=lambda r: (r["ordinal"], r["scope_hmac"])):
        if r["scope_hmac"] not in out:
            mine = used.setdefault(r["container_hmac"], set())
            out[r["scope_hmac"]] = next((v for v in ways(r) if v not in mine), None)
            mine.add(out[r["scope_hmac"]])
    return out


@pytest.mark.parametrize("listed", [True, False])
def test_rounds_equal_first_come_first_served(spark, monkeypatch, listed):
    monkeypatch.setattr(G, "LARGE", 15)
    rng = random.Random(4)
    asked = [(f"e{k}", f"r{k}", f"p{min(rng.randint(0, 5), 2)}", "NAME" if listed else "PROFESSION", f"name {rng.randint(0, 45)}", k) for k in rng.sample(range(300), 200)]
    df = spark.createDataFrame(asked, "event_id string, record_id string, entity_id string, category string, original_text string, ordinal int")
    values = [f"v{k}" for k in range(12)] if listed else None
    keyed = G.keyed(df, b"key", "entity", "custom_list" if listed else "synthetic")
    rows = keyed.groupBy("container_hmac", "scope_hmac", "digest", "category").agg(F.min("ordinal").alias("ordinal")).collect()
    first = keyed.where("ordinal % 3 = 0")
    stored = spark.createDataFrame([r for r in G.assign(first, values).collect() if r["surrogate"]], G.ASSIGNED)
    known = {r["scope_hmac"] for r in stored.collect()}
    ways = (lambda r: values[int(r["digest"][:16], 16) % 12 :] + values[: int(r["digest"][:16], 16) % 12]) if listed else (lambda r: G.synthetic_candidates(r["category"], bytes.fromhex(r["digest"])))
    want = serial([r for r in rows if r["scope_hmac"] not in known], ways, stored.collect()) | {r["scope_hmac"]: r["surrogate"] for r in stored.collect()}
    got = G.assign(keyed, values, stored).collect()
    assert {r["scope_hmac"]: r["surrogate"] for r in got} == want and len(got) == len(want) == len(rows)
    assert all((r["error"] is None) == (r["surrogate"] is not None) for r in got) and (not listed or None in want.values())


def test_a_container_of_many_scopes_needs_no_group(spark):
    n = 60_000
    df = spark.range(n).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("r").alias("record_id"), F.lit("p").alias("entity_id"), F.lit("ID").alias("category"), F.concat(F.lit("name "), "id").alias("original_text"), F.col("id").alias("ordinal"))
    got = G.assign(G.keyed(df, b"key", "entity", "synthetic"))
    assert tuple(got.agg(F.count("surrogate"), F.countDistinct("surrogate")).first()) == (n, n)


def test_small_containers_pass_in_turn_through_batches(spark):
    """Containers share tasks, and one may begin in a batch and end in the next."""
    values = [f"v{k}" for k in range(6)]
    df = spark.range(700).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("r").alias("record_id"), F.concat(F.lit("p"), F.col("id") % 100).alias("entity_id"), F.lit("NAME").alias("category"), F.concat(F.lit("name "), "id").alias("original_text"), F.col("id").alias("ordinal"))
    keyed = G.keyed(df, b"key", "entity", "custom_list")
    stored = G.assign(keyed.where("ordinal < 200"), values)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = G.assign(keyed, values, stored)
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ways = lambda r: values[int(r["digest"][:16], 16) % 6 :] + values[: int(r["digest"][:16], 16) % 6]
    known = {r["scope_hmac"]: r["surrogate"] for r in stored.collect()}
    want = serial([r for r in keyed.collect() if r["scope_hmac"] not in known], ways, stored.collect()) | known
    assert {r["scope_hmac"]: r["surrogate"] for r in got} == want and len(got) == 700 and sum(r["error"] is not None for r in got) == 100
