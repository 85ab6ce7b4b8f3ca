"""Dates inside text: years alone, and shifts by whole weeks that keep the way a date is written.

``shift_dates`` moves the usual numeric forms with built-in expressions; written forms and ranges go through an Arrow
function, which gets null for all other rows and remembers what it has seen."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_MARK = "[R_DATE]"

# The formats of dates with a year and without one, tried in this order; the year that stands in for a
# missing one; two days of one month; what may part two dates of a range.
FORMATS = (
    "%m/%d/%Y",
    "%m-%d-%Y",
    "%Y-%m-%d",
    "%m/%d/%y",
    "%m-%d-%y",
    "%B %d, %Y",
    "%b %d, %Y",
    "%B %d %Y",
    "%b %d %Y",
    "%m/%Y",
    "%m-%Y",
    "%B %Y",
    "%b %Y",
)
YEARLESS_FORMATS = ("%m/%d", "%m-%d", "%B %d", "%b %d", "%d %B", "%d %b")
ANCHOR_YEAR = 2000
DAYS_OF_A_MONTH = re.compile(r"([A-Za-z]+)(\s+)(\d{1,2})(\s*[–—-]\s*)(\d{1,2})")
RANGE_SEPARATOR = re.compile(r"\s+(?:to|through)\s+|\s*[–—]\s*|\s+-\s+|(?<=\d)-(?=(?:[A-Za-z]|\d{1,2}/))", re.IGNORECASE)


def _shape(text: str) -> str:
    """Runs of digits and of letters as one sign each, without blanks, which may pad a day or a whole date: a text that a
    format reads has the format's shape."""
    return re.sub(r"\s+", "", re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", text)))


_BY_SHAPE: dict[str, list[str]] = {}
for _form in (*FORMATS, *YEARLESS_FORMATS):
    _BY_SHAPE.setdefault(_shape(re.sub("%[Bb]", "May", re.sub("%[mdYy]", "1", _form))), []).append(_form)


@lru_cache(maxsize=65_536)
def parse(text: str) -> tuple[date, str] | None:
    """(date, format) of the first format that reads the whole text; yearless ones stand in the anchor year."""
    for form in _BY_SHAPE.get(_shape(text), ()):
        year = (f"{ANCHOR_YEAR} ", "%Y ") if _yearless(form) else ("", "")
        try:
            return datetime.strptime(year[0] + text, year[1] + form).date(), form
        except ValueError:
            pass
    return None


def _yearless(form: str) -> bool:
    return form in YEARLESS_FORMATS


def show(value: date, form: str, like: str) -> str:
    """value in the format of ``like``: each number as wide as there, month names and their case as there."""
    parts = iter(re.findall(r"[A-Za-z]+|\d+", like))
    names = {"%B": calendar.month_name[value.month], "%b": calendar.month_abbr[value.month], "%Y": f"{value.year:04d}", "%y": f"{value.year % 100:02d}"}

    def part(directive: re.Match) -> str:
        was = next(parts, "")
        number = {"%m": value.month, "%d": value.day}.get(directive[0])
        return names[directive[0]] if number is None else str(number).zfill(len(was))

    out = re.sub("%[A-Za-z]", part, form)
    if not any(c.isalpha() for c in like):
        return out
    return out.upper() if like.isupper() else out.lower() if like.islower() else out


def _moved(text: str, days: int) -> str | None:
    got = parse(text)
    if not got:
        return None
    try:
        return show(got[0] + timedelta(days=days), got[1], text)
    except OverflowError:
        return None


def _ends(left: str, right: str, days: int) -> tuple[str, str] | None:
    """Both ends of a range, moved; an end without a year that comes before its start lies in the year after."""
    a, b = parse(left), parse(right)
    if not a or not b or _yearless(a[1]) != _yearless(b[1]):
        return None
    start, end = a[0], b[0]
    try:
        if _yearless(a[1]) and end < start:
            end = end.replace(year=end.year + 1)
        return show(start + timedelta(days=days), a[1], left), show(end + timedelta(days=days), b[1], right)
    except (ValueError, OverflowError):
        return None


def _within_a_month(text: str, days: int) -> str | None:
    """``Month 3-5``, where both days move within one month."""
    if not (m := DAYS_OF_A_MONTH.fullmatch(text)):
        return None
    read = [parse(f"{m[1]} {m[k]}") for k in (3, 5)]
    if None in read or read[0][0] > read[1][0]:
        return None
    to = [at + timedelta(days=days) for at, _ in read]
    if to[0].replace(day=1) != to[1].replace(day=1):
        return None
    name = show(to[0], read[0][1], f"{m[1]} {m[3]}").split(" ")[0]
    return name + m[2] + str(to[0].day).zfill(len(m[3])) + m[4] + str(to[1].day).zfill(len(m[5]))


def move_text(text: str, weeks: int) -> str | None:
    """A date, or a range that reads as one in exactly one way, moved by whole weeks; None where neither can be."""
    days = 7 * weeks
    ways = [(cut[0], got) for cut in RANGE_SEPARATOR.finditer(text) if (got := _ends(text[: cut.start()], text[cut.end() :], days))]
    if len(ways) == 1:
        return ways[0][1][0] + ways[0][0] + ways[0][1][1]
    return _within_a_month(text, days) or _moved(text, days)


def year_only(text: Column) -> Column:
    """Runs of letters or digits become the date's placeholder, but for years: all numbers from 1800 to 2199; without
    any, of three runs or more the last if it has two digits; a single run of two digits above 12."""
    run = "[A-Za-z]+|\\p{Nd}+"
    runs, between = F.regexp_extract_all(text, F.lit(run), F.lit(0)), F.split(text, run, -1)
    is_year = lambda x: x.rlike("^(18|19|20|21)\\p{Nd}{2}$")
    n = F.size(runs)
    two = F.get(runs, n - 1).rlike("^\\p{Nd}{2}$")
    single = (n == 1) & two & F.get(runs, F.lit(0)).rlike("^(1[3-9]|[2-9][0-9])$")
    years = F.exists(runs, is_year)

    def keeps(x: Column, k: Column) -> Column:
        return F.when(years, is_year(x)).when(n >= 3, (k == n - 1) & two).otherwise(single)

    out = F.transform(runs, lambda x, k: F.concat(F.when(keeps(x, k), x).otherwise(F.lit(DATE_MARK)), F.get(between, k + 1)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(out, ""))


def _numeric(text: Column, weeks: Column) -> tuple[Column, Column]:
    """(is a numeric date with a four-digit year, the date moved or null)."""
    us, iso = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})\z", r"^(\d{4})-(\d{1,2})-(\d{1,2})\z"
    is_us, is_iso = text.rlike(us), text.rlike(iso)
    take = lambda p, k: F.regexp_extract(text, p, k)
    month, day = F.when(is_us, take(us, 1)).otherwise(take(iso, 2)), F.when(is_us, take(us, 3)).otherwise(take(iso, 3))
    year = F.when(is_us, take(us, 4)).otherwise(take(iso, 1))
    moved = F.date_add(F.concat_ws("-", year, month, day).try_cast("date"), (weeks * 7).cast("int"))
    moved = F.when((year >= "0001") & moved.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")), moved)
    wide = lambda x, like: F.lpad(x.cast("string"), 2, "0").substr(F.lit(3) - F.greatest(F.length(like), F.length(x.cast("string"))), F.lit(2))
    m, d, y = wide(F.month(moved), month), wide(F.dayofmonth(moved), day), F.lpad(F.year(moved).cast("string"), 4, "0")
    sign = take(us, 2)
    return is_us | is_iso, F.when(is_us, F.concat(m, sign, d, sign, y)).otherwise(F.concat_ws("-", y, m, d))


def moved(text: Column, weeks: Column) -> Column:
    """The text moved by weeks, or null where it is no date or leaves the calendar."""
    known, native = _numeric(text, weeks)
    other = F.pandas_udf(_move, "string")(F.when(~known, text), weeks)
    return F.when(known, native).otherwise(other)


def _move(text: pd.Series, weeks: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or w is None or w != w else move_text(t, int(w)) for t, w in zip(text, weeks)], dtype=object)


def fallen_back(text: Column, fallback: str) -> Column:
    if fallback not in ("year_only", "redact"):
        raise ValueError(f"no such fallback: {fallback}")
    return year_only(text) if fallback == "year_only" else F.when(text.isNotNull(), F.lit(DATE_MARK))


def shift_text(text: Column, weeks: Column, fallback: str = "year_only") -> Column:
    """A date or range moved by whole weeks; what cannot be read, or leaves the calendar, falls back. Null stays null."""
    return F.coalesce(moved(text, weeks), fallen_back(text, fallback))


def shift_value(value: Column, kind: str, weeks: Column, fallback: str | None = "year_only") -> tuple[Column, Column]:
    """(moved value as text, error) of a structured date: ``kind`` is its type, date, timestamp or string. Without a
    fallback what cannot be moved is null with an error."""
    if kind == "string":
        source, out = value, moved(value, weeks)
    else:
        days = (weeks * 7).cast("int")
        source = value.cast("string") if kind == "date" else F.regexp_replace(value.cast("string"), " ", "T")
        if kind == "date":
            to = F.date_add(value, days)
        else:
            to = value + F.make_dt_interval(days)
        text = to.cast("string") if kind == "date" else F.regexp_replace(to.cast("string"), " ", "T")
        out = F.when(F.year(to).between(1, 9999), text)
    out = F.coalesce(out, fallen_back(source, fallback)) if fallback else out
    return out, F.when(value.isNotNull() & out.isNull(), "date_not_movable")
