"""Surrogates: scopes, keyed hashes, candidates, and assignments without collisions.

Requests are rows (event_id, record_id, entity_id, category, original_text, ordinal). What one name is replaced by is
fixed by the secret and its scope; within a container, one entity or one record, no two scopes share a value."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as dt

from ..functions import core as K
from ..functions import policy as P
from ..sources.files import dropped, written

#: What the keys of scopes, containers and dates begin with. To go on with another system's assignments, pass the names
#: that it uses: ``scope_key`` and ``container_key`` take a namespace, ``K.date_shift_weeks`` likewise.
SCOPES, CONTAINERS, DATES = "surrogate/v2", "surrogate-container/v2", "date-shift/v1"
CANDIDATES = 128
#: Containers with more scopes are assigned in rounds, not in a group each.
LARGE = 20_000


def resolve_secret(reference: str, resolver: Callable[[str], str | bytes] | None = None) -> bytes:
    """The secret that ``reference`` names: by the resolver, or ``env:NAME`` from the environment. Resolved on the driver;
    executors get the pads of the keyed hash alone, and no message holds the value."""
    if not reference or not reference.strip():
        raise ValueError("a secret reference is blank")
    if resolver:
        value = resolver(reference)
    elif reference.startswith("env:"):
        value = os.environ.get(reference[4:])
    else:
        raise ValueError("a secret reference is env:NAME, or has a resolver")
    if not value:
        raise ValueError(f"no secret for {reference}")
    return value.encode() if isinstance(value, str) else bytes(value)


def scope_key(consistency: str, namespace: str = SCOPES) -> Column:
    """What two requests agree in if they get one surrogate."""
    if consistency not in P.CONSISTENCY:
        raise ValueError(f"no such consistency: {consistency}")
    name = K.collapsed(F.col("original_text"))
    own = {"occurrence": F.col("event_id"), "record": F.concat(F.col("record_id"), F.lit("\0"), name), "entity": F.concat(F.col("entity_id"), F.lit("\0"), name)}[consistency]
    return F.concat(F.lit(namespace + "\0"), F.col("category"), F.lit(f"\0{consistency}\0"), own)


def container_key(consistency: str, namespace: str = CONTAINERS) -> Column:
    owner = F.col("entity_id") if consistency == "entity" else F.col("record_id")
    return F.concat(F.lit(namespace + "\0"), F.col("category"), F.lit("\0"), owner)


def keyed(requests: DataFrame, secret: bytes, consistency: str, method: str = "custom_list", namespace: str = "") -> DataFrame:
    """Adds digest (which selects), scope_hmac, container_hmac and assignment_id."""
    scope, container = scope_key(consistency, namespace + SCOPES), container_key(consistency, namespace + CONTAINERS)
    rows = requests.withColumn("digest", K.hmac_sha256(secret, scope)).withColumn("scope_hmac", K.hmac_sha256(secret, F.concat(F.lit("scope\0"), scope))).withColumn("container_hmac", K.hmac_sha256(secret, F.concat(F.lit("container\0"), container)))
    parts = (F.col("category"), F.lit(method), F.col("scope_hmac"))
    return rows.withColumn("method", F.lit(method)).withColumn("assignment_id", K.content_id("surrogate-assignment", *map(K.json_string, parts)))


def list_candidates(values: list[str], digest: Column) -> Column:
    """The list from the place that the digest picks, and round."""
    if not values or len({v.strip() for v in values}) < len(values) or not all(v.strip() for v in values):
        raise ValueError("a list of surrogates has different values, none of them blank")
    all_values, k = F.array(*map(F.lit, values)), K.u64_mod(digest, len(values))
    return F.concat(F.slice(all_values, k + 1, F.lit(len(values))), F.slice(all_values, F.lit(1), k))


def pool_sha256(values: list[str]) -> str:
    return hashlib.sha256("\n".join(values).encode()).hexdigest()


# Own pools of parts; values are made of them, so they differ from those of other generators.
_FIRST = ("Ada", "Ben", "Cora", "Dale", "Edith", "Frank", "Grace", "Hugh", "Iris", "Joel", "Kara", "Liam", "Mona", "Neil", "Opal", "Paul", "Quinn", "Rosa", "Seth", "Tara", "Uma", "Vera", "Wade", "Yara")
_LAST = ("Abbott", "Barnes", "Colby", "Dalton", "Ellery", "Foster", "Grange", "Holden", "Ivers", "Jarvis", "Keller", "Lowell", "Mercer", "Norris", "Osborn", "Porter", "Ramsey", "Sawyer", "Thorne", "Upton", "Vance", "Weaver", "Yates", "Zeller")
_STREET = ("Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Hazel", "Juniper", "Linden", "Maple", "Oak", "Poplar")
_TOWN = ("Ashford", "Brookfield", "Clearwater", "Dunmore", "Eastvale", "Fairview", "Glenwood", "Harborton", "Kingsley", "Lakeside", "Millbrook", "Northgate")
_JOB = ("archivist", "baker", "carpenter", "driver", "editor", "florist", "gardener", "jeweller", "librarian", "mason", "painter", "surveyor", "tailor", "welder")


def synthetic_value(category: str, digest: bytes, counter: int) -> str:
    """The counter-th value that a digest stands for. Each part takes its own bytes of a hash of both."""
    h = hashlib.sha256(digest + counter.to_bytes(2, "big")).digest()
    pick = lambda k, pool: pool[int.from_bytes(h[4 * k : 4 * k + 4], "big") % len(pool)]
    number = lambda k, low, high: low + int.from_bytes(h[4 * k : 4 * k + 4], "big") % (high - low + 1)
    if category == "NAME":
        return f"{pick(0, _FIRST)} {pick(1, _LAST)}"
    if category == "AGE":
        return str(number(0, 1, 89))
    if category == "LOCATION":
        return f"{number(0, 1, 9999)} {pick(1, _STREET)} Street, {pick(2, _TOWN)}"
    if category == "PHONE_OR_FAX":
        return f"({number(0, 200, 999)}) 555-{number(1, 0, 9999):04d}"
    if category == "EMAIL":
        return f"{pick(0, _FIRST)}.{pick(1, _LAST)}{number(2, 1, 999)}@example.org".lower()
    if category == "URL":
        return f"https://{pick(0, _TOWN)}-{number(1, 1, 9999)}.example.org/".lower()
    if category == "IP_ADDRESS":
        return f"{number(0, 1, 223)}.{number(1, 0, 255)}.{number(2, 0, 255)}.{number(3, 1, 254)}"
    if category == "PROFESSION":
        return pick(0, _JOB)
    x = bytearray(h[:16])
    x[6], x[8] = x[6] & 0x0F | 0x40, x[8] & 0x3F | 0x80
    x = x.hex()
    return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


def _different(category: str, digest: bytes) -> Iterator[str]:
    """The candidates of a scope, each once, as far as they are asked for."""
    seen = set()
    for k in range(CANDIDATES):
        value = synthetic_value(category, digest, k)
        if value not in seen:
            seen.add(value)
            yield value


def synthetic_candidates(category: str, digest: bytes) -> list[str]:
    return list(_different(category, digest))


ASSIGNED = "method string, category string, container_hmac string, scope_hmac string, assignment_id string, surrogate string, error string"


def assign(requests: DataFrame, values: list[str] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """One row for each (method, category, scope) of keyed requests: its surrogate, or an error.

    Scopes of a container come in the order of ``ordinal``, and each gets the first of its candidates that no other scope
    of the container has; what ``stored`` (columns of the result) holds is used again and not given twice. Candidates are
    those of ``values``, else synthetic ones. The scopes of a container meet in one group, of a list at most as many as it
    has values, as the others have the error outright; containers of more than LARGE scopes are assigned in rounds."""
    keys = ["method", "category", "container_hmac"]
    scopes = requests.groupBy(*keys, "scope_hmac", "assignment_id", "digest").agg(F.min("ordinal").alias("ordinal"))
    if stored is None:
        stored = requests.sparkSession.createDataFrame([], ASSIGNED)
    known = stored.where("surrogate is not null").select(*keys, "scope_hmac", "surrogate")
    again = scopes.join(known.select("method", "category", "scope_hmac", "surrogate"), ["method", "category", "scope_hmac"]).select(*keys, "scope_hmac", "assignment_id", "surrogate", F.lit(None).cast("string").alias("error"))
    new = scopes.join(known, ["method", "category", "scope_hmac"], "left_anti")
    none = "the list has no value left" if values else "the generator has no value left"
    large = new.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select(*keys)
    if large.isEmpty():
        return _assign_in_groups(new, known, keys, values, none).unionByName(again)
    small = _assign_in_groups(new.join(large, keys, "left_anti"), known, keys, values, none)
    return small.unionByName(_assign_in_rounds(new.join(large, keys, "left_semi"), known, keys, values, none)).unionByName(again)


def _assign_in_groups(new: DataFrame, known: DataFrame, keys: list[str], values: list[str] | None, none: str) -> DataFrame:
    """Container by container."""
    taken = known.groupBy(*keys).agg(F.collect_set("surrogate").alias("taken"))
    order = Window.partitionBy(*keys).orderBy("ordinal", "scope_hmac")
    rows = new.join(taken, keys, "left").withColumn("place", F.row_number().over(order) + F.coalesce(F.size("taken"), F.lit(0)))
    if values:
        rows = rows.withColumn("candidates", list_candidates(values, F.col("digest")))
        late = rows.where(F.col("place") > len(values)).select(*keys, "scope_hmac", "assignment_id", F.lit(None).cast("string").alias("surrogate"), F.lit(none).alias("error"))
        rows = rows.where(F.col("place") <= len(values))
    else:
        rows, late = rows.withColumn("candidates", F.lit(None).cast("array<string>")), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        container, used = None, set()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if (r.method, r.category, r.container_hmac) != container:
                    container, used = (r.method, r.category, r.container_hmac), set() if r.taken is None else set(r.taken)
                ways = r.candidates if r.candidates is not None else _different(r.category, bytes.fromhex(r.digest))
                pick = next((v for v in ways if v not in used), None)
                used.add(pick)
                out.append((r.method, r.category, r.container_hmac, r.scope_hmac, r.assignment_id, pick, None if pick else none))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ASSIGNED.split(", ")])

    # containers are many and small: a task takes all of its own in turn, and holds what one of them has taken
    given = rows.repartition(*keys).sortWithinPartitions(*keys, "place").mapInPandas(run, ASSIGNED)
    return given.unionByName(late) if late is not None else given


@F.pandas_udf(dt.StringType())
def _synthetic_way(category: pd.Series, digest: pd.Series, k: pd.Series) -> pd.Series:
    """The k-th different candidate; null where there is none, or k is null."""
    return pd.Series([None if pd.isna(n) else next(islice(_different(c, bytes.fromhex(d)), int(n), None), None) for c, d, n in zip(category, digest, k)], dtype=object)


def _assign_in_rounds(new: DataFrame, known: DataFrame, keys: list[str], values: list[str] | None, none: str) -> DataFrame:
    """What _assign_in_groups gives, without a group for each container. In a round every scope claims a candidate; of those
    that claim one value of a container the first by ordinal holds it, the others, and those that claim a value that is
    stored, go on to their next. A holder gives way to an earlier scope that comes to its value later. It ends when all
    claims hold, which is then the order of first come, first served: nobody before a scope left it a better value.
    Each round is a minimum by value, combined before it is shuffled, and is written, as the next begins from it."""
    spark = new.sparkSession
    way = lambda k: F.get(list_candidates(values, F.col("digest")), k) if values else _synthetic_way("category", "digest", k)
    state = written(new.withColumns({"k": F.lit(0), "value": way(F.lit(0)), "moved": F.lit(True)}), "claims")
    while state.where("moved").limit(1).count():
        holders = state.where("value is not null").groupBy(*keys, "value").agg(F.min(F.struct("ordinal", "scope_hmac")).alias("holder"))
        gone = known.select(*keys, F.col("surrogate").alias("value"), F.lit(True).alias("gone"))
        met = state.join(holders.join(gone, [*keys, "value"], "left"), [*keys, "value"], "left")
        lost = F.col("value").isNotNull() & (F.coalesce("gone", F.lit(False)) | (F.col("holder.scope_hmac") != F.col("scope_hmac")))
        met = met.withColumn("moved", lost).withColumn("k", F.col("k") + lost.cast("int"))
        next_ = way(F.when(F.col("moved"), F.col("k")))
        before, state = state, written(met.withColumn("value", F.when(F.col("moved"), next_).otherwise(F.col("value"))).select(*state.columns), "claims")
        dropped(spark, before)
    return state.select(*keys, "scope_hmac", "assignment_id", F.col("value").alias("surrogate"), F.when(F.col("value").isNull(), none).alias("error"))


def date_shifts(entities: DataFrame, secret: bytes, low: int = -52, high: int = 52, stored: DataFrame | None = None) -> DataFrame:
    """(entity_id, weeks, error): one shift for each different entity; one that differs from the stored one is an error."""
    rows = entities.select("entity_id").distinct().withColumn("weeks", K.date_shift_weeks(secret, DATES, F.col("entity_id"), low, high))
    if stored is None:
        return rows.withColumn("error", F.lit(None).cast("string"))
    met = rows.join(stored.select("entity_id", F.col("weeks").alias("before")), "entity_id", "left")
    return met.select("entity_id", "weeks", F.when(F.col("before") != F.col("weeks"), "date_shift_conflict").alias("error"))
