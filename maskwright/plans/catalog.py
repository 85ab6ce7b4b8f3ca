"""Registered queries over the driver tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as K
from ..functions import dates as D
from ..operators import ledger as L
from ..operators import reporting as M
from ..operators import spans as S
from ..operators import structured as X
from ..operators import surrogates as G
from ..operators import text as T
from ..operators import work as W
from ..sources import records as R

SECRET = b"example secret"
NAMES = ["Alex", "Robin", "Sam", "Kim", "Jo"]
RULES = [
    S.Rule("email", "e-mail", "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    S.Rule("phone", "phone", "PHONE_OR_FAX", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    S.Rule("ip", "address", "IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    S.Rule("card", "long number", "ID", r"\b[0-9]{16}\b"),
]
#: Numbers are known to the validator's reader and stay.
POLICY = K.DEFAULT_POLICY | {"ID": ("retain", None)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.normalize(_t(spark, d, "documents"), "doc_id", "source", "text", ("lang",))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("record_id"), "text")


def _found(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")
    return S.rule_findings(docs, RULES)


def _found_sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        parts.append(f"""SELECT doc_id AS record_id, {k} AS rule_ordinal, '{r.id}' AS rule_id, '{r.category}' AS category, i, ms[i] AS exact_text,
          CAST(coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda p: length(p))), 0) AS INTEGER) AS b
          FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{r.pattern}') AS ms, regexp_split_to_array(text, '{r.pattern}') AS ps FROM documents WHERE text IS NOT NULL))""")
    return f"found AS (SELECT record_id, rule_ordinal, rule_id, category, exact_text, b AS s, b + length(exact_text) AS e, rule_id || ':' || row_number() OVER (PARTITION BY record_id ORDER BY rule_ordinal, b) AS span_id FROM ({' UNION ALL '.join(parts)}))"


_BLANK = "(text IS NULL OR trim(text) = '')"


@query("q01_import_summary", f"SELECT count(*) AS records, count(*) FILTER (NOT {_BLANK}) AS active, count(*) FILTER ({_BLANK}) AS excluded, CAST(0 AS BIGINT) AS normalized FROM documents")
def q01(spark, d):
    return R.import_summary(R.check_records(_records(spark, d)))


@query("q02_normalized_records", f"SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS entity_id, sha256(text) AS text_sha256, sha256(text) AS raw_sha256, false AS changed, {_BLANK} AS excluded, CASE WHEN {_BLANK} THEN 'empty_source_text' END AS exclusion_code, '{{\"lang\":\"' || lang || '\"}}' AS metadata FROM documents")
def q02(spark, d):
    return _records(spark, d).select("record_id", "entity_id", "text_sha256", "raw_sha256", "changed", "excluded", "exclusion_code", "metadata")


@query("q03_initial_states", f"SELECT CAST(doc_id AS VARCHAR) AS record_id, stage, CASE WHEN {_BLANK} THEN 'excluded' WHEN stage = 'input' THEN 'succeeded' WHEN stage = 'review' THEN 'skipped' ELSE 'pending' END AS status FROM documents CROSS JOIN (VALUES {', '.join(f"('{s}')" for s in K.STAGES)}) t(stage)")
def q03(spark, d):
    return L.initial_states(_records(spark, d), ("review",))


@query("q04_preview_page", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 40")
def q04(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "source", "n_chars", F.col("lang").alias("status"), F.col("doc_id").alias("source_index"))
    return M.record_page(rows, 3, 20, "en")[0].select("doc_id", "source", "n_chars")


@query("q05_rule_findings", f"WITH {_found_sql()} SELECT record_id, rule_id, category, s AS start_at, e AS end_at, exact_text, span_id FROM found")
def q05(spark, d):
    return _found(spark, d).select("record_id", "rule_id", "category", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "exact_text", "span_id")


@query("q06_finding_counts", f"WITH {_found_sql()} SELECT 'rule' AS source_kind, category, count(*) AS raw_count, count(*) FILTER (s % 3 > 0) AS active_span_count, count(DISTINCT CASE WHEN s % 3 > 0 THEN record_id END) AS active_record_count FROM found GROUP BY category")
def q06(spark, d):
    return M.finding_counts(_found(spark, d).withColumn("source_kind", F.lit("rule")).withColumn("is_eligible", F.col("start") % 3 > 0))


@query("q07_chunk_plan")
def q07(spark, d):
    """Chunks of 4000 bytes end where characters do, which is sequential; tests hold the plan."""
    return W.chunk_plan(_docs(spark, d), 4_000, 64).select("record_id", "chunk_index", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("q07b_ascii_chunks", """WITH RECURSIVE pieces AS (SELECT doc_id, 0 AS k, 0 AS a, least(4000, n) AS b, n FROM (SELECT doc_id, length(text) AS n FROM documents WHERE strlen(text) = length(text) AND length(text) > 0)
  UNION ALL SELECT doc_id, k + 1, b - 64, least(b - 64 + 4000, n), n FROM pieces WHERE b < n) SELECT 'd' || doc_id AS record_id, CAST(k AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_at, CAST(b AS INTEGER) AS end_at FROM pieces""")
def q07b(spark, d):
    plain = _docs(spark, d).where(F.octet_length("text") == F.length("text"))
    return W.chunk_plan(plain, 4_000, 64).select("record_id", "chunk_index", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("q07c_whole_chunks", "SELECT 'd' || doc_id AS record_id, 0 AS chunk_index, length(text) AS n, 'work_' || substr(sha256('[\"run\",\"d' || doc_id || '\",\"model\",0,0,' || length(text) || ',\"' || sha256(text) || '\"]'), 1, 32) AS work_item_id FROM documents WHERE length(text) > 0")
def q07c(spark, d):
    return W.work_items(W.chunk_plan(_docs(spark, d), None), "run", "model").select("record_id", "chunk_index", F.col("end").cast("long").alias("n"), "work_item_id")


def _groups(spark, d) -> DataFrame:
    f = _found(spark, d).withColumn("source_kind", F.lit("rule")).withColumn("confidence", F.lit(None).cast("double")).withColumn("finding_id", F.col("span_id"))
    return S.resolve(f)


_ISLANDS = f"""WITH {_found_sql()}, cuts AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY record_id ORDER BY s, e, category, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS cut FROM found),
  isles AS (SELECT *, sum(cut) OVER (PARTITION BY record_id ORDER BY s, e, category, span_id) AS isle FROM cuts),
  groups AS (SELECT record_id, min(s) AS s, max(e) AS e, arg_min(category, {{'l': -(e - s), 's': s, 'c': category, 'i': span_id}}) AS category, list_sort(list(span_id)) AS ids FROM isles GROUP BY record_id, isle)"""


@query("q08_span_groups", f"""{_ISLANDS} SELECT record_id, s AS start_at, e AS end_at, category, array_to_string(ids, ',') AS finding_ids,
  'group_' || substr(sha256('["group","' || record_id || '",' || s || ',' || e || ',["' || array_to_string(ids, '","') || '"]]'), 1, 32) AS group_id FROM groups""")
def q08(spark, d):
    return _groups(spark, d).select("record_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "category", F.array_join("finding_ids", ",").alias("finding_ids"), "group_id")


_JOINERS = (" ", " and ", ", ", " -")


@query("q09_linked_names", f"""WITH n AS (SELECT c_custkey AS k, length(c_name) AS a, length(c_mktsegment) AS b, length(list_element([{', '.join(f"'{x}'" for x in _JOINERS)}], CAST(c_custkey % 4 AS INTEGER) + 1)) AS g, c_custkey % 4 <> 1 AND c_custkey % 5 <> 0 AS linked FROM customer)
  SELECT 'c' || k AS record_id, 6 AS start_at, CAST(CASE WHEN linked THEN 6 + a + g + b ELSE 6 + a END AS INTEGER) AS end_at, 'NAME' AS category, CASE WHEN linked THEN 2 ELSE 1 END AS findings FROM n
  UNION ALL SELECT 'c' || k, CAST(6 + a + g AS INTEGER), CAST(6 + a + g + b AS INTEGER), 'NAME', 1 FROM n WHERE NOT linked""")
def q09(spark, d):
    """Two names a customer, parted by a blank, a word, a comma or a hyphen; every fifth time of two source groups."""
    k = F.col("c_custkey")
    joiner = F.element_at(F.array(*map(F.lit, _JOINERS)), (k % 4 + 1).cast("int"))
    rows = _t(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("record_id"), F.concat(F.lit("Seen: "), "c_name", joiner, "c_mktsegment", F.lit(" end")).alias("text"), F.length("c_name").alias("a"), F.length("c_mktsegment").alias("b"), F.length(joiner).alias("g"), (k % 5 == 0).alias("apart"))
    name = lambda n, start, length, group: F.struct(F.lit(n).alias("finding_id"), start.alias("start"), (start + length).alias("end"), group.alias("source_group_id"))
    found = rows.select("record_id", F.inline(F.array(name("f1", F.lit(6), F.col("a"), F.lit("g")), name("f2", F.col("a") + F.col("g") + 6, F.col("b"), F.when(F.col("apart"), "h").otherwise("g")))))
    found = found.withColumns({"category": F.lit("NAME"), "source_kind": F.lit("llm"), "source_name": F.lit("m"), "confidence": F.lit(None).cast("double")})
    return S.resolve_linked(found, rows).select("record_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "category", F.size("finding_ids").alias("findings"))


@query("q10_content_ids", """SELECT doc_id, 'rec_' || substr(sha256('["record",' || doc_id || ',"' || source || '"]'), 1, 32) AS content_id FROM documents""")
def q10(spark, d):
    return _t(spark, d, "documents").select("doc_id", K.content_id("rec", K.json_string(F.lit("record")), F.col("doc_id").cast("string"), K.json_string(F.col("source"))).alias("content_id"))


def _events(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")
    g = _groups(spark, d).join(docs, "record_id").withColumn("original", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    return S.plan(g)


@query("q11_redacted_text", "SELECT doc_id AS record_id, " + "".join("regexp_replace(" for _ in RULES) + "text" + "".join(f", '{r.pattern}', '{K.PLACEHOLDERS[r.category]}', 'g')" for r in RULES) + " AS rendered FROM documents")
def q11(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")
    return S.redact(docs, _groups(spark, d)).select("record_id", "rendered")


@query("q11b_planned_text", ORACLE_SQL["q11_redacted_text"])
def q11b(spark, d):
    """The same by way of planned events, as surrogates need it."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")
    return S.render(docs, _events(spark, d)).select("record_id", "rendered")


@query("q12_render_offsets", f"{_ISLANDS}, marks AS (SELECT *, CASE category {' '.join(f"WHEN '{c}' THEN {len(p)}" for c, p in K.PLACEHOLDERS.items())} END AS n FROM groups) SELECT record_id, s AS start_at, CAST(s + coalesce(sum(n - (e - s)) OVER (PARTITION BY record_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS output_start, CAST(s + n + coalesce(sum(n - (e - s)) OVER (PARTITION BY record_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS output_end FROM marks")
def q12(spark, d):
    return S.output_offsets(_events(spark, d)).select("record_id", F.col("start").alias("start_at"), "output_start", "output_end")


@query("q13_age_90_plus", "SELECT p_partkey, CASE WHEN p_size * 3 >= 90 AND p_size * 3 < 1000 THEN 'age 90+ y' ELSE 'age ' || (p_size * 3) || ' y' END AS aged FROM part")
def q13(spark, d):
    return _t(spark, d, "part").select("p_partkey", K.age_90_plus(F.concat(F.lit("age "), (F.col("p_size") * 3).cast("string"), F.lit(" y"))).alias("aged"))


_MARK = D.DATE_MARK


@query("q14_year_only", f"""SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN '{_MARK}/{_MARK}/' || year(o_orderdate) WHEN 1 THEN '{_MARK} {_MARK}' WHEN 2 THEN '{_MARK} ' || year(o_orderdate) WHEN 3 THEN '{_MARK}/{_MARK}/' || strftime(o_orderdate, '%y')
    WHEN 4 THEN CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%d') ELSE '{_MARK}' END WHEN 5 THEN year(o_orderdate) || ' to ' || year(o_orderdate) WHEN 6 THEN '{_MARK} {_MARK} {_MARK}' ELSE '' || year(o_orderdate) END AS year_only FROM orders""".replace("' to '", f"' {_MARK} '"))
def q14(spark, d):
    """Long and short forms: full dates, month and day, month and year, two-digit years, a number alone, two years."""
    forms = ("MM/dd/yyyy", "MMMM dd", "MMMM yyyy", "MM/dd/yy", "dd", "yyyy 'to' yyyy", "dd 'of' MMMM", "yyyy")
    text = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        text = F.when(F.col("o_orderkey") % 8 == k, F.date_format("o_orderdate", f)).otherwise(text)
    return _t(spark, d, "orders").select("o_orderkey", D.year_only(text).alias("year_only"))


def _weeks_sql(column: str) -> str:
    inner, outer = K.hmac_pads(SECRET)
    digest = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('dates' || chr(0) || {column}))))"
    return f"(('0x' || substr({digest}, 1, 16))::UHUGEINT % 104)::INTEGER"


@query("q15_date_shift_weeks", f"SELECT c_custkey, CASE WHEN k < 52 THEN k - 52 ELSE k - 51 END AS weeks FROM (SELECT c_custkey, {_weeks_sql('CAST(c_custkey AS VARCHAR)')} AS k FROM customer)")
def q15(spark, d):
    return _t(spark, d, "customer").select("c_custkey", K.date_shift_weeks(SECRET, "dates", F.col("c_custkey").cast("string")).alias("weeks"))


_MOVE = f"JOIN (SELECT c_custkey, 7 * CASE WHEN k < 52 THEN k - 52 ELSE k - 51 END AS days FROM (SELECT c_custkey, {_weeks_sql('CAST(c_custkey AS VARCHAR)')} AS k FROM customer)) ON o_custkey = c_custkey"


def _orders(spark, d) -> DataFrame:
    return _t(spark, d, "orders").join(q15(spark, d), F.col("o_custkey") == F.col("c_custkey"))


@query("q16_shift_structured_dates", f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + days AS VARCHAR) AS moved_date, strftime(o_orderdate + to_days(days), '%Y-%m-%dT%H:%M:%S') AS moved_time, CAST(CAST(o_orderdate AS DATE) + days AS VARCHAR) AS moved_text FROM orders {_MOVE}")
def q16(spark, d):
    at, weeks = F.col("o_orderdate"), F.col("weeks")
    return _orders(spark, d).select("o_orderkey", D.shift_value(F.to_date(at), "date", weeks)[0].alias("moved_date"), D.shift_value(at, "timestamp", weeks)[0].alias("moved_time"), D.shift_value(F.date_format(at, "yyyy-MM-dd"), "string", weeks)[0].alias("moved_text"))


_FORMS = ("MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "MMM dd yyyy", "MMMM yyyy", "'on' EEEE")


def _as_wide(part: str) -> str:
    """A part of the moved date, at least as wide as it was before."""
    return f"lpad(CAST({part}(t) AS VARCHAR), CAST(greatest(length(CAST({part}(t) AS VARCHAR)), length(CAST({part}(o_orderdate) AS VARCHAR))) AS INTEGER), '0')"


@query("q17_shift_text_dates", f"""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN strftime(t, '%m/%d/%Y') WHEN 1 THEN {_as_wide('month')} || '/' || {_as_wide('day')} || '/' || year(t) WHEN 2 THEN strftime(t, '%m-%d-%Y') WHEN 3 THEN strftime(t, '%Y-%m-%d')
    WHEN 4 THEN strftime(t, '%B ') || {_as_wide('day')} || ', ' || year(t) WHEN 5 THEN CASE WHEN month(o_orderdate) = 5 THEN strftime(t, '%B %d %Y') ELSE strftime(t, '%b %d %Y') END
    WHEN 6 THEN strftime(date_trunc('month', o_orderdate) + to_days(days), '%B %Y') WHEN 7 THEN '{_MARK} {_MARK}' ELSE strftime(t, '%m/%d/%Y') || ' to ' || strftime(t + to_days(3), '%m/%d/%Y') END AS moved FROM (SELECT *, o_orderdate + to_days(days) AS t FROM orders {_MOVE})""")
def q17(spark, d):
    """Numeric and written forms, a month alone, what is no date, and ranges. May is short and long alike, and comes out long."""
    at = F.col("o_orderdate")
    text = F.concat(F.date_format(at, "MM/dd/yyyy"), F.lit(" to "), F.date_format(F.date_add(at, 3), "MM/dd/yyyy"))
    for k, f in enumerate(_FORMS):
        text = F.when(F.col("o_orderkey") % 9 == k, F.date_format(at, f)).otherwise(text)
    rows = _orders(spark, d).select("o_orderkey", "weeks", text.alias("text"))  # the text is made once, and not wherever it is read
    return rows.select("o_orderkey", D.shift_text(F.col("text"), F.col("weeks")).alias("moved"))


def _requests(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(F.concat(F.lit("e"), k).alias("event_id"), F.concat(F.lit("r"), k).alias("record_id"), F.concat(F.lit("p"), F.floor(k / 5)).alias("entity_id"), F.lit("NAME").alias("category"), F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("original_text"), k.alias("ordinal"))


_SCOPE = "'surrogate/v2' || chr(0) || 'NAME' || chr(0) || 'entity' || chr(0) || 'p' || (c_custkey // 5) || chr(0) || lower(c_name)"


def _hmac_sql(message: str) -> str:
    inner, outer = K.hmac_pads(SECRET)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query("q18_scope_keys", f"SELECT c_custkey, replace({_SCOPE}, chr(0), '|') AS scope, 'surrogate-container/v2|NAME|p' || (c_custkey // 5) AS container, {_hmac_sql("'scope' || chr(0) || " + _SCOPE)} AS scope_hmac FROM customer")
def q18(spark, d):
    rows = G.keyed(_requests(spark, d), SECRET, "entity")
    return rows.select(F.col("ordinal").alias("c_custkey"), F.replace(G.scope_key("entity"), F.lit("\0"), F.lit("|")).alias("scope"), F.replace(G.container_key("entity"), F.lit("\0"), F.lit("|")).alias("container"), "scope_hmac")


@query("q19_custom_list", f"SELECT c_custkey, list_element(l, k + 1) || ' ' || list_element(l, (k + 1) % 5 + 1) AS first_two, 'surrogate-assignment_' || substr(sha256('[\"NAME\",\"custom_list\",\"' || h || '\"]'), 1, 32) AS assignment_id FROM (SELECT c_custkey, [{', '.join(f"'{n}'" for n in NAMES)}] AS l, CAST(('0x' || substr({_hmac_sql(_SCOPE)}, 1, 16))::UHUGEINT % 5 AS INTEGER) AS k, {_hmac_sql("'scope' || chr(0) || " + _SCOPE)} AS h FROM customer)")
def q19(spark, d):
    rows = G.keyed(_requests(spark, d), SECRET, "entity")
    c = G.list_candidates(NAMES, F.col("digest"))
    return rows.select(F.col("ordinal").alias("c_custkey"), F.concat_ws(" ", F.get(c, F.lit(0)), F.get(c, F.lit(1))).alias("first_two"), "assignment_id")


@query("q20_unique_assignment")
def q20(spark, d):
    """First come, first served within an entity, which SQL cannot say; tests compare it with brute force."""
    rows = G.keyed(_requests(spark, d), SECRET, "entity")
    return G.assign(rows, NAMES).select("container_hmac", "scope_hmac", "assignment_id", "surrogate", "error")


@query("q20b_assignments_of_an_entity", f"""SELECT h AS container_hmac, least(n, 5) AS given, CAST(greatest(n - 5, 0) AS BIGINT) AS refused, CASE WHEN n >= 5 THEN '{','.join(sorted(NAMES))}' END AS names FROM
  (SELECT {_hmac_sql("'container' || chr(0) || 'surrogate-container/v2' || chr(0) || 'NAME' || chr(0) || 'p' || (c_custkey // 7)")} AS h, count(DISTINCT lower(c_name)) AS n FROM customer GROUP BY c_custkey // 7)""")
def q20b(spark, d):
    """Seven names an entity and five values: five are given, each once, and the others refused."""
    rows = _requests(spark, d).withColumn("entity_id", F.concat(F.lit("p"), F.floor(F.col("ordinal") / 7)))
    got = G.assign(G.keyed(rows, SECRET, "entity"), NAMES).groupBy("container_hmac").agg(F.countDistinct("surrogate").alias("given"), K.count_if(F.col("error").isNotNull()).alias("refused"), F.array_join(F.array_sort(F.collect_set("surrogate")), ",").alias("names"))
    return got.withColumn("names", F.when(F.col("given") >= 5, F.col("names")))


_FIELDS = {"c_name": "NAME", "o_orderdate": "DATE", "o_orderpriority": "PROFESSION", "c_mktsegment": "LOCATION"}


@query("q21_structured_transform", " UNION ALL ".join(
    f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'structured:' || o_orderkey || ':{c}' AS structured_event_id, '{c}' AS column_name, '{k}' AS category, '{a}' AS action, {r} AS replacement FROM orders JOIN (SELECT c_custkey AS ck, c_name, c_mktsegment FROM customer) ON ck = o_custkey {_MOVE if c == 'o_orderdate' else ''}"
    for (c, k), a, r in zip(_FIELDS.items(), ("redact", "surrogate", "retain", "redact"), ("'[R_NAME]'", "strftime(o_orderdate + to_days(days), '%Y-%m-%dT%H:%M:%S')", "o_orderpriority", "'[R_LOC]'"))
))
def q21(spark, d):
    rows = _orders(spark, d).drop("c_custkey").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("record_id", F.col("o_orderkey").cast("string"))
    return X.structured_events(rows, _FIELDS, K.DEFAULT_POLICY | {"DATE": ("surrogate", "date_shift:year_only")}, F.col("weeks")).drop("original", "error")


@query("q21b_structured_record", f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, '[R_NAME]' AS c_name, '{_MARK}-{_MARK}' AS month_day, '' || year(o_orderdate) || '-{_MARK}-{_MARK}' AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'reviewed' ELSE '[R_LOC]' END AS c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey")
def q21b(spark, d):
    """Back in the record, after a review has overridden one field of some, also by null."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("record_id"), "o_orderkey", "c_name", F.date_format("o_orderdate", "MM-dd").alias("month_day"), F.to_date("o_orderdate").alias("day"), "c_mktsegment", "o_orderpriority")
    fields = {"c_name": "NAME", "month_day": "DATE", "day": "DATE", "c_mktsegment": "LOCATION", "o_orderpriority": "PROFESSION"}
    override = rows.where("o_orderkey % 3 < 2").select("record_id", F.lit("c_mktsegment").alias("column_name"), F.when(F.col("o_orderkey") % 3 == 1, "reviewed").alias("value"))
    return X.materialize(rows, X.overridden(X.structured_events(rows, fields), override)).drop("o_orderkey")


@query("q22_confidence_filter", "SELECT event_id, coalesce(value >= 50, true) AS eligible, CASE WHEN value < 50 THEN 'low' END AS reason FROM events")
def q22(spark, d):
    confidence = F.col("value")
    return _t(spark, d, "events").select("event_id", W.eligible(confidence, 50).alias("eligible"), F.when(W.ineligible_reason(confidence, 50).isNotNull(), "low").alias("reason"))


@query("q23_dedupe_candidates", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(value, -1) DESC, event_id) AS n FROM events) WHERE n = 1")
def q23(spark, d):
    return L.dedupe_candidates(_t(spark, d, "events"), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id")


_STATUS = {"view": "succeeded", "click": "succeeded", "signup": "retry_pending", "purchase": "permanent_error", "error": "retry_exhausted"}
_WORK = f"(SELECT user_id * 40 + event_id % 40 AS record_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status, event_type, event_id, value, props, (CASE event_id % 7 {' '.join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(K.STAGES))} END) AS stage FROM events)"


def _work(spark, d) -> DataFrame:
    status = F.element_at(F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv)), F.col("event_type"))
    stage = F.element_at(F.array(*map(F.lit, K.STAGES)), (F.col("event_id") % 7 + 1).cast("int"))
    return _t(spark, d, "events").select((F.col("user_id") * 40 + F.col("event_id") % 40).alias("record_id"), status.alias("status"), "event_type", "event_id", "value", "props", stage.alias("stage"))


@query("q24_backend_state", f"SELECT record_id, CASE WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_or(status = 'retry_pending') THEN 'retry_pending' WHEN bool_or(status = 'permanent_error') THEN 'permanent_error' ELSE 'retry_exhausted' END AS status FROM {_WORK} GROUP BY record_id")
def q24(spark, d):
    return L.record_status(_work(spark, d))


@query("q25_stage_rollup", f"SELECT stage, CASE WHEN bool_and(status = 'succeeded') THEN 'completed' WHEN bool_or(status IN ('retry_exhausted', 'permanent_error')) THEN 'completed_with_errors' ELSE 'blocked' END AS status FROM {_WORK} GROUP BY stage")
def q25(spark, d):
    return L.stage_rollup(_work(spark, d))


@query("q26_run_rollup", "SELECT CASE WHEN count(*) FILTER (quality = 0) > 0 THEN 'awaiting_review' ELSE 'completed' END AS status FROM labels")
def q26(spark, d):
    return L.run_rollup(_t(spark, d, "labels").select(F.when(F.col("quality") == 0, "awaiting_review").otherwise("ready").alias("status")))


@query("q27_retry_targets", f"SELECT record_id, arg_min(stage, list_position([{', '.join(f"'{s}'" for s in K.STAGES)}], stage)) AS stage FROM {_WORK} WHERE status IN ('retry_exhausted', 'permanent_error') GROUP BY record_id")
def q27(spark, d):
    return L.retry_targets(_work(spark, d))


@query("q32_verdict", f"WITH {_found_sql()} SELECT d.doc_id AS record_id, count(f.record_id) > 0 AS raw_violation, coalesce(bool_or(category <> 'ID'), false) AS effective_violation, count(*) FILTER (category = 'ID') AS ignored FROM documents d LEFT JOIN found f ON f.record_id = d.doc_id GROUP BY d.doc_id")
def q32(spark, d):
    return W.verdict(_t(spark, d, "documents").select(F.col("doc_id").alias("record_id")), _found(spark, d), POLICY)


@query("q33_review_routing", f"WITH {_found_sql()} SELECT d.doc_id AS record_id, CASE WHEN coalesce(bool_or(category <> 'ID'), false) THEN 'review_pending' ELSE 'skipped' END AS review_state, CASE WHEN coalesce(bool_or(category <> 'ID'), false) THEN 'awaiting_review' ELSE 'processing' END AS record_status FROM documents d LEFT JOIN found f ON f.record_id = d.doc_id GROUP BY d.doc_id")
def q33(spark, d):
    return W.review_routing(q32(spark, d))


@query("q35_finalization_gate", "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN false WHEN l.quality = 0 THEN coalesce(l.toxic = 0, false) ELSE true END AS may_finalize FROM documents d LEFT JOIN labels l USING (doc_id)")
def q35(spark, d):
    rows = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.lit(True).alias("transformed"), (F.col("quality") == 0).alias("violation"), F.when(F.col("toxic") == 0, "approved_unchanged").alias("disposition"))
    return L.finalization_gate(rows).select("doc_id", "may_finalize")


@query("q36_latest_revision", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def q36(spark, d):
    return L.latest(_t(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("q37_reuse_check", "SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) = (SELECT count(DISTINCT user_id) * count(DISTINCT event_type) FROM events) AS reusable")
def q37(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("backend"), F.lit("succeeded").alias("status"))
    return L.reusable(e, e.select("record_id"), e.select("backend"))


@query("q38_export_ready", ORACLE_SQL["q11_redacted_text"].replace(" FROM documents", ", lang FROM documents"))
def q38(spark, d):
    return q11(spark, d).join(_t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "lang"), "record_id", "left")


@query("q40_align_spans")
def q40(spark, d):
    """Every rule finding, with its offsets moved off by up to three, is put back; tests hold the rules of alignment."""
    off = F.pmod(F.xxhash64("record_id", "start"), F.lit(7)).cast("int") - 3
    rows = _found(spark, d).join(_t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text"), "record_id")
    moved = rows.select("record_id", "span_id", T.aligned("text", F.col("start") + off, F.col("end") + off, "exact_text").alias("s"))
    return moved.select("record_id", "span_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.error").alias("error"))


def entry(spark: SparkSession) -> DataFrame:
    return q11(spark, "/root/testdata/sf0.001")


from . import ledger_catalog  # noqa: E402, F401  registers the queries over ledger tables

from . import run_catalog  # noqa: E402, F401  registers the queries over ledgers of runs
