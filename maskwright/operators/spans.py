"""From text to rendered text: rule matching, span resolution, policy, rendering. Spark expressions, but for rules whose
syntax only Python reads and for dates written in words."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as dt

from ..functions import core as K
from ..functions import dates as D
from ..functions import policy as P


#: Syntax that Python and Java read differently; rules with it are matched by an Arrow function.
_FOREIGN = re.compile(r"\(\?P|\(\?\(|\(\?[aiLmsux-]+\)|\\Z|\\N|&&|\[[^\]]*\[|\{,|--")
#: What Python's classes of characters hold, as members of a Java class: letters and numbers of any kind, but no marks; white
#: space with the separators of ASCII.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CLASSES = {"w": _WORD, "d": r"\p{Nd}", "s": _SPACE}
#: Characters on which Java's own classes and Python's may differ; without them they agree.
ODD = r"[\x1c-\x1f\x{80}-\x{10ffff}]"


def spelled_out(pattern: str) -> str | None:
    """A pattern whose classes and word bounds mean in Java what they mean in Python, for any text; None where a negated
    class stands within brackets, which is not put into words here."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            e = pattern[k + 1]
            if e.lower() in _CLASSES:
                members = _CLASSES[e.lower()]
                if inside and e.isupper():
                    return None
                out.append(members if inside else f"[{'^' * e.isupper()}{members}]")
            elif e in "bB" and not inside:
                w, back = f"[{_WORD}]", f"[{_WORD}]{{1,2}}"  # one of two code units, or two of one: the look back is in units
                out.append(f"(?:(?<={back})(?!{w})|(?<!{back})(?={w}))" if e == "b" else f"(?:(?<={back})(?={w})|(?<!{back})(?!{w}))")
            else:
                out.append(c + e)
            k += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if pattern[k + 1 : k + 2] == "^":
                out.append(c)
                k, c = k + 1, "^"
            if pattern[k + 1 : k + 2] == "]":  # a bracket that stands first is a member
                out.append(c + "\\]")
                k += 2
                continue
        out.append(c)
        k += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """A regular expression in Python's syntax, or with exact a literal, that marks a category. Fields are stripped."""

    id: str
    name: str
    category: str
    pattern: str
    exact: bool = False
    ignore_case: bool = False

    def __post_init__(self):
        for field in ("id", "name", "pattern"):
            object.__setattr__(self, field, getattr(self, field).strip())
            if not getattr(self, field):
                raise ValueError(f"rule {field} is blank")
        if self.category not in K.CATEGORIES:
            raise ValueError(f"no such category: {self.category}")
        try:
            self.compiled
        except re.error as e:
            raise ValueError(f"rule {self.id} is no regular expression: {e}") from e

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(re.escape(self.pattern) if self.exact else self.pattern, re.IGNORECASE if self.ignore_case else 0)

    @property
    def native(self) -> bool:
        """Whether Spark's expressions give Python's matches: portable syntax that never matches nothing."""
        return self.exact or not (_FOREIGN.search(self.pattern) or _may_be_empty(self.pattern) or spelled_out(self.pattern) is None)

    @property
    def literal(self) -> str:
        return "\\Q" + self.pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if self.exact else self.pattern

    def _flagged(self, body: str) -> str:
        flags = ("d" if re.search(r"[.^$]", self.pattern) and not self.exact else "") + ("iu" if self.ignore_case else "")  # lines end at line feeds alone
        return f"(?{flags})" * bool(flags) + body

    @property
    def regex(self) -> str:
        """For texts without ODD characters."""
        return self._flagged(self.literal)

    @property
    def regex_for_all(self) -> str:
        return self._flagged(self.literal if self.exact else spelled_out(self.pattern))


def _may_be_empty(pattern: str) -> bool:
    """Whether the pattern can match no characters; in doubt, yes."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parser = getattr(re, "_parser", None)
        return parser is None or parser.parse(pattern).getwidth()[0] == 0


def check_rules(rules: list[Rule]) -> list[Rule]:
    if not rules:
        raise ValueError("at least one rule is needed")
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    return rules


_MATCH = "array<struct<i:int,before:int,text:string>>"


def rule_matches(text: Column, rule: Rule) -> Column:
    """array<struct<i, before, text>> of a rule's non-overlapping matches: the i-th, with ``before`` characters between it
    and the one before. Matches of no length are skipped."""
    if not rule.native:
        return _foreign_matches(rule)(text)
    if rule.regex == rule.regex_for_all:
        return _native_matches(text, rule.regex)
    return F.when(text.rlike(ODD), _native_matches(text, rule.regex_for_all)).otherwise(_native_matches(text, rule.regex))


def _native_matches(text: Column, regex: str) -> Column:
    # most texts have no match, which one search tells; the others are matched and split once each
    found, between = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    met = F.zip_with(found, between, lambda x, b: F.struct(F.length(b).alias("before"), x.alias("text")))
    rows = F.filter(F.transform(met, lambda m, k: F.struct(k.cast("int").alias("i"), m["before"].alias("before"), m["text"].alias("text"))), lambda m: m["text"].isNotNull())
    return F.when(text.rlike(regex), rows).otherwise(F.array().cast(_MATCH))


def _foreign_matches(rule: Rule):
    @F.pandas_udf(_MATCH)
    def run(text: pd.Series) -> pd.Series:
        pattern, out = rule.compiled, []
        for t in text:
            at, rows = 0, []
            for m in pattern.finditer(t or ""):
                if m.end() > m.start():
                    rows.append({"i": len(rows), "before": m.start() - at, "text": m[0]})
                    at = m.end()
            out.append(rows)
        return pd.Series(out, dtype=object)

    return run


def rule_findings(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """(record_id, rule_ordinal, rule_id, category, start, end, exact_text, span_id) of records (record_id, text).

    One pass over the text; rows without a match make none. A match's place is the sum of what lies before it, so the work
    is linear in the matches. The span id numbers a record's matches over all rules. Record ids are unique."""
    check_rules(rules)
    tagged = [_tagged(rule_matches(F.col("text"), r), k, r) for k, r in enumerate(rules)]
    rows = records.where(F.col("text").isNotNull()).select("record_id", F.explode(F.concat(*tagged)).alias("m")).select("record_id", "m.*")
    upto = F.sum(F.col("before") + F.length("exact_text")).over(Window.partitionBy("record_id", "rule_ordinal").orderBy("i"))
    placed = rows.repartition("record_id").withColumn("end", upto.cast("int")).withColumn("start", F.col("end") - F.length("exact_text"))
    number = F.row_number().over(Window.partitionBy("record_id").orderBy("rule_ordinal", "start"))
    return placed.select("record_id", "rule_ordinal", "rule_id", "category", "start", "end", "exact_text", F.concat_ws(":", "rule_id", number).alias("span_id"))


def _tagged(matches: Column, k: int, rule: Rule) -> Column:
    def tag(s: Column) -> Column:
        return F.struct(F.lit(k).alias("rule_ordinal"), F.lit(rule.id).alias("rule_id"), F.lit(rule.category).alias("category"), s["i"].alias("i"), s["before"].alias("before"), s["text"].alias("exact_text"))

    return F.transform(matches, tag)


def valid_span(text: Column, start: Column, end: Column, exact: Column) -> Column:
    """Whether a span lies in the text and its slice is what was found."""
    return (start >= 0) & (end > start) & (end <= F.length(text)) & F.substring(text, start + 1, end - start).eqNullSafe(exact)


_ORDER = ("start", "end", "category", "finding_id")


def _islands(findings: DataFrame) -> DataFrame:
    """Adds island: a number that overlapping findings of a record share. Spans that only touch do not overlap."""
    order = Window.partitionBy("record_id").orderBy(*_ORDER)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return findings.withColumn("cut", cut).withColumn("island", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def _grouped(rows: DataFrame, by: str) -> DataFrame:
    """One group for each record and ``by``, of the category of its first finding by source, confidence, length, start,
    category and id."""
    priority = F.element_at(F.create_map(*(F.lit(x) for kv in K.SOURCE_PRIORITY.items() for x in kv)), F.col("source_kind"))
    first = F.struct(priority, -F.coalesce("confidence", F.lit(-1.0)), -(F.col("end") - F.col("start")), F.col("start"), F.col("category"), F.col("finding_id"))
    groups = rows.groupBy("record_id", by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("category", first).alias("category"), F.array_sort(F.collect_list("finding_id")).alias("finding_ids"))
    ids = F.concat(F.lit("["), F.concat_ws(",", F.transform("finding_ids", K.json_string)), F.lit("]"))
    return groups.withColumn("group_id", K.content_id("group", K.json_string(F.lit("group")), K.json_string(F.col("record_id").cast("string")), F.col("start").cast("string"), F.col("end").cast("string"), ids)).drop(by)


def resolve(findings: DataFrame) -> DataFrame:
    """Overlap groups: (record_id, start, end, category, finding_ids, group_id).

    findings: record_id, finding_id, start, end, category, source_kind, confidence. Spans that overlap, directly or
    through others, form one group. One sort and one window a record."""
    return _grouped(_islands(findings), "island")


_GAP = "^[ \\t\\r\\n.,'-]+\\z"


def resolve_linked(findings: DataFrame, records: DataFrame) -> DataFrame:
    """As resolve, and names that one source has put in one source_group_id join where only blanks and ``. , ' -`` lie
    between them and the one follows the other among them. findings carry source_name and source_group_id besides.

    Islands are joined along such links, within each record's own list of them, in about the time of reading it. An island that lies wholly in the
    gap of a link stays apart, so that its group overlaps the joined one; ``render`` reports that as an error."""
    linked = Window.partitionBy("record_id", "source_name", "source_group_id").orderBy(*_ORDER)
    rows = _islands(findings)
    names = rows.where((F.col("category") == "NAME") & (F.coalesce("source_group_id", F.lit("")) != ""))
    pairs = names.select("record_id", F.lag("end").over(linked).alias("from"), F.col("start").alias("to"), F.lag("island").over(linked).alias("a"), F.col("island").alias("b")).where("to > `from` and a <> b")
    gap = F.substring(F.col("text"), F.col("from") + 1, F.col("to") - F.col("from"))
    links = pairs.join(records.select("record_id", "text"), "record_id").where(gap.rlike(_GAP)).groupBy("record_id").agg(F.collect_set(F.struct("a", "b")).alias("links"))
    several = rows.join(links, "record_id").groupBy("record_id", "links").agg(F.max("island").alias("n"))
    labels = several.select("record_id", F.posexplode(_components(F.col("n"), F.col("links.a"), F.col("links.b"))).alias("k", "joined"))
    named = rows.join(labels.select("record_id", (F.col("k") + 1).cast("long").alias("island"), "joined"), ["record_id", "island"], "left")
    return _grouped(named.withColumn("joined", F.coalesce("joined", "island")), "joined")


@F.pandas_udf(dt.ArrayType(dt.LongType()))
def _components(n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """For islands 1 to n of a record, the first island that links join each with. Roots are the smaller numbers, and paths
    are halved as they are followed."""
    out = []
    for size, left, right in zip(n, a, b):
        up = list(range(int(size) + 1))

        def root(k: int, up: list[int] = up) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for x, y in zip(left.tolist(), right.tolist()):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        out.append([root(k) for k in range(1, int(size) + 1)])
    return pd.Series(out, dtype=object)


def findings_digest(findings: DataFrame) -> DataFrame:
    """(record_id, digest): the hash of a record's findings (category, end, id, start, text) as canonical JSON, in order of
    place. A record that has none is hashed by its reader as an empty list (``EMPTY_DIGEST``)."""
    text = F.concat(F.lit('{"category":'), K.json_string(F.col("category")), F.lit(',"end":'), F.col("end").cast("string"), F.lit(',"id":'), K.json_string(F.col("finding_id")), F.lit(',"start":'), F.col("start").cast("string"), F.lit(',"text":'), K.json_string(F.col("exact_text")), F.lit("}"))
    items = findings.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, text.alias("json")))).alias("items"))
    return items.select("record_id", K.sha256(F.concat(F.lit("["), F.array_join(F.col("items.json"), ","), F.lit("]"))).alias("digest"))


EMPTY_DIGEST = hashlib.sha256(b"[]").hexdigest()


def plan(groups: DataFrame, policy: dict[str, tuple[str, str | None]] = K.DEFAULT_POLICY, purpose: str = "final") -> DataFrame:
    """Adds action and replacement; groups carry original, and for surrogates weeks (dates) and surrogate (all others).

    Retained text stays even in a draft; a draft masks all else. A final surrogate whose column is missing is an error
    now; one that is null stays null, which ``render`` reports."""
    P.check(policy)
    if purpose not in ("draft", "final"):
        raise ValueError(f"no such purpose: {purpose}")
    surrogates = {c: s for c, (a, s) in policy.items() if a == "surrogate"}
    for column, wanted in (("weeks", "DATE" in surrogates), ("surrogate", bool(set(surrogates) - {"DATE"}))):
        if purpose == "final" and wanted and column not in groups.columns:
            raise ValueError(f"surrogates need the column {column}")
    if purpose == "final" and surrogates:
        fallback = P.date_fallback(policy)
        moved = D.shift_text(F.when((F.col("category") == "DATE") & F.lit("DATE" in surrogates), F.col("original")), F.col("weeks"), fallback) if "DATE" in surrogates else F.lit(None).cast("string")
        surrogate = F.when(F.col("category") == "DATE", moved).otherwise(F.col("surrogate") if "surrogate" in groups.columns else F.lit(None).cast("string"))
    else:
        surrogate = F.lit(None).cast("string")
    action = P.action_of(F.col("category"), policy)
    return groups.withColumn("action", action).withColumn("replacement", replacement(F.col("category"), F.col("original"), policy, purpose, surrogate))


def replacement(category: Column, original: Column, policy: P.Policy, purpose: str, surrogate: Column | None = None) -> Column:
    """What stands for a text of a category; a surrogate is given."""
    action, strategy, mark = P.action_of(category, policy), P.strategy_of(category, policy), K.placeholder(category)
    general = F.when(strategy == "age_90_plus", K.age_90_plus(original)).when(strategy == "year_only", D.year_only(original))
    given = F.lit(None).cast("string") if surrogate is None else surrogate
    return F.when(action == "retain", original).when(F.lit(purpose == "draft") | (action == "redact"), mark).when(action == "generalize", general).otherwise(given)


def redact(records: DataFrame, groups: DataFrame, policy: P.Policy = K.DEFAULT_POLICY, purpose: str = "final") -> DataFrame:
    """(record_id, rendered, error) as plan and render give them, for policies whose replacements follow from the text alone:
    groups (record_id, start, end, category) meet their records in one join, and no text is read or dealt out twice."""
    P.check(policy)
    if purpose == "final" and any(a == "surrogate" for a, _ in policy.values()):
        raise ValueError("surrogates are planned before they are rendered")
    per = groups.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "category"))).alias("groups"))
    rows = records.select("record_id", "text").join(per, "record_id", "left")

    def event(x: Column) -> Column:
        original = F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), original.alias("original"), replacement(x["category"], original, policy, purpose).alias("replacement"))

    return _spliced(rows.select("record_id", "text", F.transform("groups", event).alias("events")))


def render(records: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, rendered, error) of records (record_id, text) with events (record_id, start, end, original,
    replacement). Errors are data: overlap, out_of_range, text_mismatch, null_replacement, of the first bad event; then
    rendered is null.

    The pieces of a record, its events and the text between them, meet in one array that its own events bound, and are
    joined once."""
    e = F.struct("start", "end", "original", "replacement")
    per = events.groupBy("record_id").agg(F.array_sort(F.collect_list(e)).alias("events"))
    return _spliced(records.select("record_id", "text").join(per, "record_id", "left"))


def _spliced(rows: DataFrame) -> DataFrame:
    """(record_id, rendered, error) of rows (record_id, text, events in order)."""
    text = F.col("text")
    before = lambda k: F.when(k > 0, F.get("events", k - 1)["end"]).otherwise(0)

    def fault(x: Column, k: Column) -> Column:
        wrong = ~F.substring(text, x["start"] + 1, x["end"] - x["start"]).eqNullSafe(x["original"])
        return F.when(x["start"] < before(k), "overlap").when((x["start"] < 0) | (x["end"] <= x["start"]) | (x["end"] > F.length(text)), "out_of_range").when(wrong, "text_mismatch").when(x["replacement"].isNull(), "null_replacement")

    pieces = F.transform("events", lambda x, k: F.concat(F.substring(text, before(k) + 1, x["start"] - before(k)), x["replacement"]))
    rest = F.substring(text, F.element_at("events", -1)["end"] + 1, F.length(text))
    error = F.get(F.filter(F.transform("events", fault), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.select("record_id", "text", "events", error.alias("error"))
    out = F.when(F.col("events").isNull(), text).when(F.col("error").isNull(), F.concat(F.array_join(pieces, ""), rest))
    return rows.select("record_id", out.alias("rendered"), "error")


def output_offsets(events: DataFrame) -> DataFrame:
    """Adds output_start and output_end: where each replacement stands in the rendered text."""
    order = Window.partitionBy("record_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("replacement") - (F.col("end") - F.col("start"))).over(order), F.lit(0))
    at = (F.col("start") + moved).cast("int")
    return events.withColumn("output_start", at).withColumn("output_end", at + F.length("replacement"))


def rendering_events(events: DataFrame) -> DataFrame:
    """Events of a rendering (record_id, rendering_id, event_id, start, end, category, replacement) with their output
    offsets and ids, which count a rendering's events from 1."""
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("start", "end"))
    numbered = output_offsets(events).withColumn("n", n)
    key = K.content_id("render-event", K.json_string(F.col("rendering_id")), K.json_string(F.col("event_id")), F.col("n").cast("string"))
    return numbered.withColumn("rendering_event_id", key)
