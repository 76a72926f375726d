"""Snapshots: tables written aside, then made current by swapping one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def leave_pointer(spark: SparkSession, root: str, store: str) -> None:
    """Notes in a root that its index is kept at store, under another root."""
    fs, p = _file(spark, f"{root.rstrip('/')}/.faultline/POINTER")
    out = fs.create(p, True)
    out.write(bytearray(store, "utf-8"))
    out.close()


def find_store(spark: SparkSession, path: str) -> str:
    """The store at a path, or the one that a pointer beside it names (path is <root>/.faultline/index)."""
    fs, current = _file(spark, f"{path.rstrip('/')}/CURRENT")
    beside = f"{path.rstrip('/').rpartition('/')[0]}/POINTER"
    if fs.exists(current) or not fs.exists(_file(spark, beside)[1]):
        return path
    return "".join(r[0] for r in spark.read.text(beside).collect()).strip()


class SnapshotStore:
    """Tables of one index under a path that Spark can write.

    ``write`` puts every table into a folder of its own name and then replaces the file
    CURRENT, so readers see the old tables or the new ones and never a mix.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        return _file(self.spark, path)

    def _pointer(self) -> dict | None:
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            return None
        lines = self.spark.read.text(f"{self.root}/CURRENT").collect()
        return json.loads("".join(r[0] for r in lines))

    def write(self, tables: dict[str, DataFrame], fingerprint: str = "", keep: bool = False) -> str:
        """Writes the tables as one snapshot; with keep, tables not named stay as they are."""
        name = uuid.uuid4().hex
        old = self._pointer() or {}
        paths = dict(old.get("tables", {})) if keep else {}
        for t, df in tables.items():
            df.write.parquet(f"{self.root}/snap/{name}/{t}")
            paths[t] = f"{self.root}/snap/{name}/{t}"
        fs, new = self._fs(f"{self.root}/CURRENT.{name}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"tables": paths, "fingerprint": fingerprint}), "utf-8"))
        out.close()
        _, current = self._fs(f"{self.root}/CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(new, current, options)
        return name

    def tables(self) -> list[str]:
        return sorted((self._pointer() or {}).get("tables", {}))

    def read(self, table: str, fingerprint: str | None = None) -> DataFrame | None:
        """A table of the current snapshot; None where there is none, or it was made by another extractor."""
        p = self._pointer()
        if p is None or table not in p["tables"] or fingerprint is not None and fingerprint != p["fingerprint"]:
            return None
        return self.spark.read.parquet(p["tables"][table])

    def merge(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Upserts rows: the newer batch wins for a key."""
        old = self.read(table)
        new = rows.withColumn("_batch", F.lit(1))
        both = new if old is None else new.unionByName(old.withColumn("_batch", F.lit(0)))
        top = F.max("_batch").over(Window.partitionBy(*keys))
        self.write({table: both.withColumn("_top", top).filter("_batch = _top").drop("_top", "_batch")}, keep=True, fingerprint=(self._pointer() or {}).get("fingerprint", ""))

    def cached(self, table: str, head: str, make) -> DataFrame:
        """A table that belongs to one state of the history (its head): made once, then read."""
        name = f"{table}@{head}"
        found = self.read(name)
        if found is None:
            self.write({name: make()}, keep=True, fingerprint=(self._pointer() or {}).get("fingerprint", ""))
            found = self.read(name)
        return found
