"""Text functions that need sequential logic: chunks, alignment and repair. Each is a pure function with an Arrow UDF
around it, which gets null for the rows that built-in expressions settle."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def chunk_text(text: str, most_bytes: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks: the longest prefix of what is left that fits; the next starts ``overlap`` back, and on."""
    if most_bytes < 1 or overlap < 0:
        raise ValueError("limits are out of range")
    width = [len(c.encode()) for c in text]
    out, at = [], 0
    while at < len(text):
        size, end = 0, at
        while end < len(text) and size + width[end] <= most_bytes:
            size, end = size + width[end], end + 1
        if end == at:
            raise ValueError("a character is longer than a chunk")
        out.append((at, end))
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def chunks(text: Column, most_bytes: int = 19_000, overlap: int = 256) -> Column:
    """array<struct<start, end>>; texts that fit are one chunk without any Python."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b} for a, b in chunk_text(t or "", most_bytes, overlap)])

    one = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    fits = F.octet_length(text) <= most_bytes
    long = F.when(~fits, text)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<struct<start:int,end:int>>")).when(fits, one).otherwise(cut(long))


def occurrences(text: str, part: str) -> list[int]:
    """Where part starts, overlapping places too."""
    return [m.start() for m in re.finditer(f"(?={re.escape(part)})", text)] if part else []


def align(text: str, start: int, end: int, found: str) -> tuple[int, int]:
    """The span meant by offsets that may be off: as given, from its start, from its end, the only place, the only
    nearest place; else an error."""
    n = len(found)
    if not found:
        if 0 <= start < end <= len(text):
            return start, end
        raise ValueError("no text and no valid offsets")
    if text[max(start, 0) : max(end, 0)] == found and start >= 0:
        return start, end
    if start >= 0 and text[start : start + n] == found:
        return start, start + n
    if end - n >= 0 and text[end - n : end] == found:
        return end - n, end
    places = occurrences(text, found)
    if len(places) == 1:
        return places[0], places[0] + n
    far = sorted((abs(p - start) + abs(p + n - end), p) for p in places)
    if not far or (len(far) > 1 and far[0][0] == far[1][0]):
        raise ValueError("ambiguous" if far else "not in the text")
    return far[0][1], far[0][1] + n


def aligned(text: Column, start: Column, end: Column, found: Column) -> Column:
    """struct<start, end, error> of align."""
    return F.pandas_udf(_aligned, "struct<start:int,end:int,error:string>")(text, start, end, found)


def _aligned(text: pd.Series, start: pd.Series, end: pd.Series, found: pd.Series) -> pd.DataFrame:
    rows = []
    for t, a, b, f in zip(text, start, end, found):
        try:
            rows.append((*align(t, int(a), int(b), f), None))
        except ValueError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["start", "end", "error"]).astype({"start": "Int32", "end": "Int32"})


#: Single-byte encodings that UTF-8 is taken for, in the order in which equal results prefer them.
ENCODINGS = ("cp1252", "latin-1", "cp1251", "mac_roman", "iso8859-2", "cp1250", "cp437")
#: So many wrong decodings may lie one over another.
DEPTH = 3
BEAM = 6


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each character; bytes that an encoding leaves open stand for the control characters of their number."""
    table = {}
    for byte in range(255, -1, -1):
        try:
            table[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    return table


@lru_cache(maxsize=None)
def _sequences(encoding: str) -> re.Pattern:
    """Stretches of characters that, as bytes of the encoding, are a lead byte of UTF-8 and its followers, again and again."""
    chars = {byte: re.escape(c) for c, byte in _bytes_of(encoding).items()}
    some = lambda low, high: "[" + "".join(chars[x] for x in range(low, high + 1) if x in chars) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}})+")


#: Kinds of characters that whole texts seldom hold: controls, private, unassigned, lone surrogates; and signs.
_ODD_KINDS = {"Cc": 3, "Cn": 3, "Co": 3, "Cs": 3, "So": 1, "Sk": 1, "Sc": 1, "Sm": 1, "No": 1, "Pf": 1, "Pi": 1, "Lm": 1}


_EAST = frozenset(("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "CJK", "HANGUL", "BOPOMOFO"))


@lru_cache(maxsize=65_536)
def _script(c: str) -> str:
    """The script of a letter by its name; those that are written together count as one."""
    name = unicodedata.name(c, "").split(" ")[0]
    return "CJK" if name in _EAST else name


_USUAL = frozenset("\u2019\u201d\u201c\u2018\u2026\u2013\u2014\xbb\xab\u060c\u061b\u061f\u0964\u0589\u055d\u05be\u05f3\u05f4")


def improbable(text: str) -> int:
    """A cost for what well decoded text seldom has: odd characters, rare punctuation right after a letter, letters of two
    scripts side by side, and a capital after a small letter, where one of the two is not ASCII. Pictures cost nothing."""
    cost, last = 0, ""
    for c in text:
        if c < "\x80" and last < "\x80":
            last = c
            continue
        kind = unicodedata.category(c)
        if c >= "\x80":
            cost += 0 if c >= "\u2600" and kind == "So" else _ODD_KINDS.get(kind, 1 if c in "\xa0\xad\xa1\xbf\xb7\xa7\xb6" else 0)
            cost += kind[0] == "P" and c not in _USUAL and last.isalpha() and c < "\u3000"
        if last and kind[0] == "L" and last.isalpha():
            cost += 2 * (_script(c) != _script(last)) + (kind == "Lu" and last.islower())
        last = c
    return cost


def _redecoded(text: str, encoding: str) -> str:
    """The text with what reads as UTF-8 taken for the encoding decoded; stretches that do not read so stay."""
    table = _bytes_of(encoding)

    def decode(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]

    return _sequences(encoding).sub(decode, text)


def decoded(text: str) -> str:
    """The most probable of the texts that undoing at most DEPTH wrong decodings gives, the text itself included: a search
    over chains of encodings that goes on from the BEAM most probable texts of each length."""
    best, cost, edge, seen = text, improbable(text), [text], {text}
    for _ in range(DEPTH):
        steps = list(dict.fromkeys(step for state in edge for e in ENCODINGS if (step := _redecoded(state, e)) not in seen))
        if not steps:
            break
        seen.update(steps)
        priced = sorted(((improbable(step), k) for k, step in enumerate(steps)))[:BEAM]
        edge = [steps[k] for _, k in priced]
        if priced[0][0] < cost:
            cost, best = priced[0][0], edge[0]
    return best


_FOLDED = {c: unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), 0x132, 0x133, 0x149, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFF01, 0xFFF0), 0x3000)}
_FOLDED |= {c: "'" for c in (0x2BC, *range(0x2018, 0x201C))} | {c: '"' for c in range(0x201C, 0x2020)}
_DROPPED = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]")


def repair(text: str) -> str:
    """Entities where no tag stands; wrong decodings undone; terminal escapes and control characters but line breaks and
    tabs out; ligatures, widths and quotes folded; pairs of surrogates joined; line breaks as line feeds; NFC."""
    if "<" not in text:
        text = html.unescape(text)
    text = decoded(text) if not text.isascii() else text
    text = re.sub("\x1b\\[[0-9;]*[A-Za-z]", "", text).translate(_FOLDED)
    if any("\ud800" <= c <= "\udfff" for c in text):
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return _DROPPED.sub("", unicodedata.normalize("NFC", re.sub("\r\n?|[\u2028\u2029\x85]", "\n", text)))


REPAIR = "maskwright-repair-2"
#: What repair can change: any character beyond ASCII, carriage returns, control characters, entities.
_SUSPECT = "[\\x00-\\x08\\x0b\\x0d-\\x1f\\x7f]|[^\\x00-\\x7f]|&[#A-Za-z]"


def repaired(text: Column) -> Column:
    """The text repaired; plain ASCII without control characters needs no Python."""
    suspect = text.rlike(_SUSPECT)
    return F.when(suspect, F.pandas_udf(_repaired, "string")(F.when(suspect, text))).otherwise(text)


def _repaired(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else repair(t))
