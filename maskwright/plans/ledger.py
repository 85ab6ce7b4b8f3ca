"""A run's tables as a log of changes.

A table is a folder of Parquet files in buckets of record_id, so that joins of a run's tables by record_id move no rows. A
commit appends its changed rows, each marked with the commit's number and an own token, and then writes a small file
under the next number. That file is a compare-and-swap: it can be written once, so of two writers that began at one
version the second is refused, and rows whose token no commit names are nobody's. A reader takes the newest row of each key
among the named tokens. ``compact`` writes a table's newest rows anew once many commits have added to it.

A commit also keeps facts (a JSON object) and counters, which are summed over changes: the report reads no table for them.
A lease file tells other hosts that someone works on the run; one that is older than LEASE counts as left behind."""

from __future__ import annotations

import json
import socket
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files

VERSION, TOKEN = "commit__", "token__"
#: So many commits add to a table before it is written anew.
COMPACT_AFTER = 24
#: Tables of one commit that are written at a time.
AT_ONCE = 4
LEASE = timedelta(hours=1)


class Conflict(RuntimeError):
    """Another writer has committed since."""


@dataclass
class Head:
    """What a version of the run consists of."""

    version: int = -1
    facts: dict[str, Any] = field(default_factory=dict)
    #: For each table: generation, the tokens of its commits in order, and the schema.
    tables: dict[str, dict[str, Any]] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)


def own_session(spark: SparkSession) -> SparkSession:
    """A session for a run, with the settings of the caller's, that broadcasts no table of its own accord: a run's tables grow
    with its input and lie in buckets, so their joins need not pass the driver."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        own.conf.set(name, "-1")
    # rows of one record lie in one bucket, so joins by record_id and more keys need not deal them out again either
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]], counted: dict[str, tuple[Column, Column]] | None = None):
        """keys: of each table; those of tables with a record_id hold it. counted: of some tables, what a changed row counts
        as now and what it, or null, counted as before."""
        self.spark, self.files, self.keys, self.counted = spark, Files(spark, folder), keys, counted or {}
        self._known: dict[str, tuple] = {}
        self._steps: list[str] = []

    # ---- versions ----

    def head(self) -> Head:
        names = [n for n in self.files.names("commits") if n.endswith(".json")]
        return Head(**json.loads(self.files.read(f"commits/{names[-1]}"))) if names else Head()

    def commit(self, head: Head, changes: dict[str, DataFrame] | None = None, facts: dict[str, Any] | None = None) -> Head:
        """The next version: changed rows appended, facts set, counters moved by the rows that changed. A Conflict, and
        nothing changed, where ``head`` is no longer the newest."""
        tables, counters = {n: dict(t) for n, t in head.tables.items()}, dict(head.counters)

        def write(name: str, df: DataFrame) -> dict[str, int]:
            token, t = uuid.uuid4().int & 0x7FFFFFFFFFFFFFFF, tables[name]
            self._append(name, t, df, head.version + 1, token)
            t["tokens"] = [*t["tokens"], token]
            return self._moved(name, t, token)

        for name, df in (changes or {}).items():
            t = tables.setdefault(name, {"generation": 0, "tokens": [], "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)})
            self._table(name, t)
        with ThreadPoolExecutor(AT_ONCE) as pool:  # tables are written side by side, each by its own job
            for moved in pool.map(lambda x: write(*x), (changes or {}).items()):
                for key, by in moved.items():
                    counters[key] = counters.get(key, 0) + by
        return self._named(Head(head.version + 1, head.facts | (facts or {}), tables, {k: v for k, v in counters.items() if v}))

    def _named(self, new: Head) -> Head:
        if not self.files.write_new(f"commits/{new.version:08d}.json", json.dumps(new.__dict__, default=list)):
            raise Conflict(f"version {new.version} was written by another")
        return new

    def _moved(self, name: str, t: dict[str, Any], token: int) -> dict[str, int]:
        """What the rows of a commit add to the counters; a row for each key is collected."""
        if name not in self.counted:
            return {}
        now, was = self.counted[name]
        rows = self._rows(name, t).where(F.col(TOKEN) == token)
        sides = rows.select(F.explode(F.array(F.struct(now.alias("key"), F.lit(1).alias("by")), F.struct(was.alias("key"), F.lit(-1).alias("by")))).alias("x"))
        return {f"{name}:{r['key']}": r["by"] for r in sides.where("x.key is not null").groupBy("x.key").agg(F.sum("x.by").alias("by")).collect()}

    # ---- tables ----

    @property
    def buckets(self) -> int:
        return int(self.files.read("buckets")) if self.files.exists("buckets") else 8

    def set_buckets(self, n: int) -> None:
        self.files.write("buckets", str(n))

    def _place(self, name: str, generation: int) -> str:
        return f"tables/{name}/g{generation}"

    def _table(self, name: str, t: dict[str, Any]) -> str:
        """The session's name of a generation of a table."""
        place = self._place(name, t["generation"])
        known = f"ledger_{zlib.crc32(self.files.folder.encode()):08x}_{name}_{t['generation']}"
        if not self.spark.catalog.tableExists(known):
            dealt = f"CLUSTERED BY (record_id) INTO {self.buckets} BUCKETS" if "`record_id`" in t["schema"] else ""
            self.files.fs.mkdirs(self.files.at(place))
            self.spark.sql(f"CREATE TABLE {known} ({t['schema']}, {VERSION} BIGINT, {TOKEN} BIGINT) USING parquet {dealt} LOCATION '{self.files.folder}/{place}'")
        return known

    def _append(self, name: str, t: dict[str, Any], df: DataFrame, version: int, token: int) -> None:
        rows = df.withColumn(VERSION, F.lit(version).cast("long")).withColumn(TOKEN, F.lit(token).cast("long"))
        if "record_id" in df.columns:
            rows = rows.repartition(self.buckets, "record_id")
        known = self._table(name, t)
        rows.write.insertInto(known)
        self._known.pop(known, None)

    def _rows(self, name: str, t: dict[str, Any]) -> DataFrame:
        known = self._table(name, t)
        if self._known.get(known) != tuple(t["tokens"]):  # another session may have added files
            self.spark.catalog.refreshTable(known)
            self._known[known] = tuple(t["tokens"])
        return self.spark.table(known)

    def read(self, head: Head, name: str) -> DataFrame | None:
        """The newest row of each key, or None where the table was never written."""
        t = head.tables.get(name)
        if t is None:
            return None
        rows = self._rows(name, t).where(F.col(TOKEN).isin(t["tokens"]))
        if len(t["tokens"]) > 1:
            newest = Window.partitionBy(*self.keys[name]).orderBy(F.desc(VERSION))
            rows = rows.withColumn("n__", F.row_number().over(newest)).where("n__ = 1").drop("n__")
        return rows.drop(VERSION, TOKEN)

    def kept(self, df: DataFrame, dealt: bool = True) -> DataFrame:
        """df as a table of this step, where its lineage ends, so that the tables of a commit that take of it compute it once;
        in the run's buckets where it is ``dealt`` by record_id. ``forget`` removes it."""
        name = uuid.uuid4().hex
        known = f"ledger_{zlib.crc32(self.files.folder.encode()):08x}_step_{name}"
        self._steps.append(name)
        n = self.buckets
        out = df.repartition(n, "record_id").write.bucketBy(n, "record_id") if dealt else df.write
        out.format("parquet").option("path", f"{self.files.folder}/steps/{name}").saveAsTable(known)
        return self.spark.table(known)

    def forget(self) -> None:
        while self._steps:
            name = self._steps.pop()
            self.spark.sql(f"DROP TABLE IF EXISTS ledger_{zlib.crc32(self.files.folder.encode()):08x}_step_{name}")
            self.files.delete(f"steps/{name}")

    def compact(self, head: Head, after: int = COMPACT_AFTER) -> Head:
        """Writes tables of more than ``after`` commits anew. The generation before the last is removed: readers of the
        version before this one still find theirs."""
        tables = {n: dict(t) for n, t in head.tables.items()}
        worn = [n for n, t in tables.items() if len(t["tokens"]) > after]
        for name in worn:
            rows, token = self.read(head, name), uuid.uuid4().int & 0x7FFFFFFFFFFFFFFF
            t = tables[name] = {"generation": tables[name]["generation"] + 1, "tokens": [token], "schema": tables[name]["schema"]}
            self._append(name, t, rows, head.version + 1, token)
        if not worn:
            return head
        new = self._named(Head(head.version + 1, head.facts, tables, head.counters))
        for name in worn:
            gone = tables[name]["generation"] - 2
            if gone >= 0:
                self.files.delete(self._place(name, gone))
        return new

    # ---- one worker at a time ----

    @contextmanager
    def leased(self, length: timedelta = LEASE) -> Iterator[None]:
        """Holds the run's lease, or raises where another does. ``renew`` lengthens it."""
        self._mine = {"holder": uuid.uuid4().hex, "host": socket.gethostname()}
        for _ in range(2):
            if self.files.write_new("lease", json.dumps(self._mine | {"until": (datetime.now(UTC) + length).isoformat()})):
                break
            held = json.loads(self.files.read("lease"))
            if datetime.fromisoformat(held["until"]) > datetime.now(UTC):
                raise RuntimeError(f"another process works on this run, on {held['host']}")
            self.files.delete("lease")  # left behind; of two that find it so, one gets the new one
        else:
            raise RuntimeError("another process works on this run")
        try:
            yield
        finally:
            self.files.delete("lease")

    def renew(self, length: timedelta = LEASE) -> None:
        """Lengthens the lease; a RuntimeError where it went to another meanwhile."""
        held = json.loads(self.files.read("lease")) if self.files.exists("lease") else {}
        if held.get("holder") != self._mine["holder"]:
            raise RuntimeError("the lease went to another process")
        self.files.write("lease", json.dumps(self._mine | {"until": (datetime.now(UTC) + length).isoformat()}))
