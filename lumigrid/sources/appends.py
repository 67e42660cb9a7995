"""Numbered rows that several writers add to one folder, without gaps and without overwriting.

A writer first stores its rows in a staging folder of their own; nobody reads them yet. Then it claims numbers: the
folder's log has one small file for each addition, and the next one is put there by a rename that fails if another
writer was faster. That writer's numbers are read, and the claim is made again after them. A writer that fails before
its claim leaves an unread staging folder, and no number.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumigrid.operators.dataset import numbered

#: Claims that a writer makes before it gives up.
TRIES = 1000


class _Store:
    """Small files of a folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.jvm, self.folder = spark, spark._jvm, folder.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def move(self, old: str, new: str) -> bool:
        """Whether old could take the name new, which it cannot where new exists."""
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf) if self.path("").toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark._sc._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            files.rename(self.path(old), self.path(new), how)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
                raise
            return False
        return True

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def entries(spark: SparkSession, folder: str) -> list[dict]:
    """The additions so far, in order: data (a folder below), first (the first number) and rows."""
    store = _Store(spark, folder)
    names = [n for n in store.names("_log") if n.endswith(".json")]
    if not names:
        return []
    found = spark.read.schema("version long, data string, first long, rows long").json([f"{store.folder}/_log/{n}" for n in names]).orderBy("version").collect()
    return [r.asDict() for r in found]


@contextlib.contextmanager
def _staged(store: _Store, name: str) -> Iterator[str]:
    """A staging folder that goes if what is done with it fails."""
    try:
        yield f"{store.folder}/{name}"
    except BaseException:
        store.remove(name)
        raise


def append_rows(rows: DataFrame, folder: str, key: str, seed: int = 42) -> tuple[int, int]:
    """Add rows to folder under the next numbers, in the seeded order of key, which must be unique; (first, number of rows).

    Rows are written once, before the claim, with their places from 0; their numbers follow from the claim, so nothing
    is written again if another writer was faster. No rows claim nothing.
    """
    spark = rows.sparkSession
    store, name = _Store(spark, folder), f"data-{uuid.uuid4().hex}"
    with _staged(store, name) as path:
        numbered(rows, key, seed).write.parquet(path)
        n = spark.read.parquet(path).count()
        if not n:
            store.remove(name)
            return next_number(spark, folder), 0
        store.fs.mkdirs(store.path("_log"))
        draft = f"_log/.{name}.tmp"
        for _ in range(TRIES):
            before = entries(spark, folder)
            version, first = len(before), before[-1]["first"] + before[-1]["rows"] if before else 0
            store.write(draft, json.dumps({"version": version, "data": name, "first": first, "rows": n}))
            if store.move(draft, f"_log/{version:012d}.json"):
                return first, n
            store.remove(draft)
        raise RuntimeError(f"no numbers could be claimed in {TRIES} tries")


def next_number(spark: SparkSession, folder: str) -> int:
    last = entries(spark, folder)[-1:]
    return last[0]["first"] + last[0]["rows"] if last else 0


def numbered_name(prefix: str, number: Column) -> Column:
    """prefix_00012; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix + "_"), F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text))


def read_rows(spark: SparkSession, folder: str, prefix: str = "neg") -> DataFrame:
    """All rows that were added, with number and name. An error where none were."""
    found = entries(spark, folder)
    if not found:
        raise ValueError(f"no rows in {folder}")
    out = None
    for e in found:
        own = spark.read.parquet(f"{folder.rstrip('/')}/{e['data']}").withColumn("number", F.col("position") + e["first"]).drop("position")
        out = own if out is None else out.unionByName(own)
    return out.withColumn("name", numbered_name(prefix, F.col("number")))
