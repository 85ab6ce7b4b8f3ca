"""Categories, placeholders, ids, keyed hashes and text helpers as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories in report order, their placeholders, the stages in order, sources by precedence, and the
# statuses in report order.
CATEGORIES = ("NAME", "DATE", "AGE", "ID", "LOCATION", "PHONE_OR_FAX", "EMAIL", "URL", "IP_ADDRESS", "BIOMETRIC", "PHOTO", "OTHER_ID", "PROFESSION", "UNMAPPED")
PLACEHOLDERS = {
    "NAME": "[R_NAME]", "DATE": "[R_DATE]", "AGE": "[R_AGE]", "ID": "[R_ID]", "LOCATION": "[R_LOC]", "PHONE_OR_FAX": "[R_PHONE_OR_FAX]", "EMAIL": "[R_EMAIL]",
    "URL": "[R_URL]", "IP_ADDRESS": "[R_IP]", "BIOMETRIC": "[R_BIO]", "PHOTO": "[R_PHO]", "OTHER_ID": "[R_OID]", "PROFESSION": "[R_PROFESSION]", "UNMAPPED": "[R_UNMAPPED]",
}
STAGES = ("input", "detection", "transformation", "validation", "review", "finalization", "export")
SOURCE_PRIORITY = {"review": 0, "rule": 1, "llm": 2, "aws": 3}
SOURCE_KINDS = ("aws", "llm", "rule", "review")
RECORD_STATUSES = ("processing", "awaiting_review", "reviewed", "ready", "excluded", "failed")
STATE_STATUSES = ("pending", "running", "review_pending", "retry_pending", "succeeded", "skipped", "excluded", "blocked", "retry_exhausted", "permanent_error")
STAGE_STATUSES = ("pending", "running", "blocked", "completed", "completed_with_errors", "skipped", "failed")
ATTEMPT_STATUSES = ("running", "succeeded", "retryable_error", "truncated", "cancelled", "permanent_error")
DISPOSITIONS = ("approved_unchanged", "corrected", "excluded")
# How a category is treated unless a policy says otherwise.
DEFAULT_POLICY = {c: ("redact", None) for c in CATEGORIES} | {"DATE": ("generalize", "year_only"), "AGE": ("generalize", "age_90_plus"), "PROFESSION": ("retain", None)}

_SPACE = "[\\s\\x1c-\\x1f]"


def place_in(value: Column, order: tuple[str, ...]) -> Column:
    """Where a value stands in a fixed order; unknown ones come after it (sort those by name besides)."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def category_of(native: Column) -> Column:
    """Native detector types map to themselves but for ADDRESS; unknown ones are UNMAPPED, never dropped."""
    return F.when(native == "ADDRESS", "LOCATION").when(native.isin(*CATEGORIES), native).otherwise("UNMAPPED")


def placeholder(category: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv)), category)


def strip(text: Column) -> Column:
    """Without Unicode white space, and the separators 0x1C to 0x1F, at both ends."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+\\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(f"(?U)^{_SPACE}*\\z")


def collapsed(text: Column) -> Column:
    """Lower case and single blanks. Unlike full case folding it keeps the few letters that fold to two, such as sharp s."""
    return F.lower(F.regexp_replace(strip(text), f"(?U){_SPACE}+", " "))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def json_string(text: Column) -> Column:
    """A JSON string literal, non-ASCII kept."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix and 32 hex digits of the SHA-256 of a compact JSON array. Pass strings through json_string."""
    body = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.concat(F.lit(f"{prefix}_"), F.substring(sha256(body), 1, 32))


def record_id(prefix: str, record: Column, stage: str, index: Column) -> Column:
    """prefix and 24 hex digits over record, stage and index, joined by the unit separator."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(sha256(F.concat_ws("\x1f", record, F.lit(stage), index.cast("string"))), 1, 24))


def hmac_pads(secret: bytes) -> tuple[str, str]:
    """Hex of the inner and outer pads of HMAC-SHA256: what executors need of a secret."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 from two nested hashes."""
    inner, outer = hmac_pads(secret)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def u64_mod(hex_digest: Column, n: int) -> Column:
    """The first eight bytes of a digest as an unsigned number, modulo n."""
    return (F.conv(F.substring(hex_digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


def date_shift_weeks(secret: bytes, namespace: str, entity: Column, low: int = -52, high: int = 52) -> Column:
    """A fixed number of weeks for each entity: one of the allowed ones other than 0, in ascending order."""
    weeks = [w for w in range(low, high + 1) if w]
    if not weeks:
        raise ValueError("the range allows no shift")
    at = u64_mod(hmac_sha256(secret, F.concat(F.lit(namespace + "\0"), entity)), len(weeks))
    return F.element_at(F.array(*map(F.lit, weeks)), at + 1)


def age_90_plus(text: Column) -> Column:
    """The first run of one to three digits becomes 90+ if it is 90 or more."""
    first = F.regexp_extract(text, "[0-9]{1,3}", 0)
    return F.when((first != "") & (F.nullif(first, F.lit("")).cast("int") >= 90), F.regexp_replace(text, "^([^0-9]*)[0-9]{1,3}", "$190+").cast("string")).otherwise(text)
