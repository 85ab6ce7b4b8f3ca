"""Small files beside tables, on the file system that Spark's paths name, and scratch tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all nodes see, or an own folder where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="maskwright-"))
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, where its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/maskwright-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes what ``written`` wrote; nothing may read it any more."""
    Files(spark, df.written_at).delete()


class Files:
    """A folder on Spark's file system; names are relative to it."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(self.conf)
        self.folder = self.fs.makeQualified(path).toString().rstrip("/")

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds; nothing where there is none."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Puts a file in place of what is there."""
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file, whole or not at all, unless there is one: False then. Of two that try, one succeeds."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        self.write(part, text)
        contexts = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf)
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            contexts.rename(self.at(part), self.at(name), options)
            return True
        except Exception as e:
            self.delete(part)
            if self.exists(name):
                return False
            raise OSError(f"cannot write {self.folder}/{name}") from e

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)
