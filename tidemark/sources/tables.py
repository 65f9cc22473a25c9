"""Versioned Parquet tables: immutable folders and a log of commits, each of which lists its folders.

A commit writes a new folder and then creates the next log entry, which only one writer can. A table with
keys is laid out in buckets by a hash of them: a change reads and writes the buckets of the keys it
touches and keeps the others' folders, an append or an insert writes its own rows only. A change
names the version that it has read and fails if another commit came in between, so that no update is
lost. A reader pins the version that it finds, so a plan never reads what it overwrites. Log entries
go through Hadoop's file system, so that any store Spark can write will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Buckets of a table with keys.
BUCKETS = 64


def observed(seen: Observation) -> int:
    """The rows that a finished write counted; a plan that was found empty beforehand reports nothing."""
    row = seen._jo.getRow()
    return row.getLong(0) if row.length() else 0


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, deleted when the driver ends."""
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    )
    path = f"{root.rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place.getParent())
    fs.deleteOnExit(place)
    return path


class TableError(RuntimeError):
    """A folder that exists but is no table, or a commit that another writer has made first."""


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *p)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        log = self._path("_log")
        if not self._fs.exists(log):
            return []
        return sorted(
            int(s.getPath().getName()[:-5])
            for s in self._fs.listStatus(log)
            if s.getPath().getName().endswith(".json")
        )

    def exists(self) -> bool:
        """False if nothing is there; an error if something is that is no table."""
        if not self._fs.exists(self._path()):
            return False
        if not self.versions():
            raise TableError(f"{self.path} exists but is no table")
        return True

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path("_log", f"{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, entry: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        own = entry["parts"] if buckets is None else {str(b): entry["parts"].get(str(b), []) for b in buckets}
        paths = [f"{self.path}/{f}" for folders in own.values() for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        if not self.exists():
            raise TableError(f"no table at {self.path}")
        return self._read(self._entry(self.versions()[-1] if version is None else version))

    def _latest(self) -> tuple[int, dict]:
        if not self.exists():
            raise TableError(f"no table at {self.path}")
        at = self.versions()[-1]
        return at, self._entry(at)

    @staticmethod
    def _bucket(entry: dict) -> Column:
        types = {f.name: f.dataType for f in StructType.fromJson(entry["schema"]).fields}
        return F.pmod(F.xxhash64(*(F.col(k).cast(types[k]) for k in entry["keys"])), F.lit(BUCKETS)).cast("int")

    def _touched(self, entry: dict, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys: BUCKETS values at most."""
        return sorted(r[0] for r in rows.select(self._bucket(entry)).distinct().collect())

    def _commit(self, df: DataFrame, operation: str, version: int, keys: Sequence[str], keep: dict[str, list[str]]) -> int:
        """Write df beside the folders to keep, as the given version; the number of rows written."""
        folder = f"v={version:010d}-{uuid.uuid4().hex[:8]}"
        entry = {
            "version": version, "operation": operation, "schema": df.schema.jsonValue(), "keys": list(keys),
            "parts": keep
        }
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if keys:
            dealt = counted.withColumn("_bucket", self._bucket(entry)).hint("rebalance", "_bucket")
            dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
            new = {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}
        else:
            counted.write.parquet(f"{self.path}/{folder}")
            new = {"": folder}
        entry["parts"] = {b: [*keep.get(b, ()), *([new[b]] if b in new else ())] for b in sorted({*keep, *new})}
        try:
            stream = self._fs.create(self._path("_log", f"{version:010d}.json"), False)
        except Exception as e:
            self._fs.delete(self._path(folder), True)
            raise TableError(f"version {version} of {self.path} is taken") from e
        try:
            stream.write(bytearray(json.dumps(entry), "utf-8"))
        finally:
            stream.close()
        return observed(seen)

    def commit(
        self, df: DataFrame, operation: str = "overwrite", expected: int | None = None,
        keys: Sequence[str] | None = None
    ) -> int:
        """df is the table's content from now on. expected: the version that df was made from; fails if
        another commit came first. keys: those of the buckets; without them, the table's."""
        have = self.versions()
        version = (have[-1] if have else 0) + 1 if expected is None else expected + 1
        if keys is None:
            keys = self._entry(have[-1])["keys"] if have else ()
        self._commit(df, operation, version, keys, {})
        return version

    def create(self, schema: StructType, keys: Sequence[str] = ()) -> None:
        """An empty table, unless there is one."""
        if not self.exists():
            self.commit(self.spark.createDataFrame([], schema), "create", keys=keys)

    def pin(self, rows: DataFrame | None = None) -> Pin:
        """What the table holds in the buckets of the rows' keys (all of it without rows, or where the
        table has no keys or the rows lack one), to be replaced by a commit of the pin."""
        at, entry = self._latest()
        if rows is None or not entry["keys"] or not {*entry["keys"]} <= {*rows.columns}:
            return Pin(self, at, entry, None, self._read(entry))
        touched = self._touched(entry, rows)
        return Pin(self, at, entry, touched, self._read(entry, touched))

    def append(self, rows: DataFrame) -> int:
        """Add rows and return how many; columns that they lack are null, and those that the table
        lacks are added."""
        at, entry = self._latest()
        return self._append(rows, at, entry)

    def _append(self, rows: DataFrame, at: int, entry: dict) -> int:
        have = StructType.fromJson(entry["schema"])
        mine = [
            F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in have.fields
        ]
        more = [c for c in rows.columns if c not in have.names]
        return self._commit(rows.select(*mine, *more), "append", at + 1, entry["keys"], entry["parts"])

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows replace those of their keys."""
        pin = self.pin(rows if self._latest()[1]["keys"] == keys else None)
        old = pin.df.join(rows.select(*keys).distinct(), keys, "left_anti")
        return pin.commit(old.unionByName(rows.select(*pin.df.columns)), "upsert")

    def insert_only(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows whose keys are new; returns how many this call has written."""
        pin = self.pin(rows if self._latest()[1]["keys"] == keys else None)
        return self._append(rows.join(pin.df.select(*keys).distinct(), keys, "left_anti"), pin.version, pin.entry)

    def _where(self, predicate: Column) -> Pin:
        """The buckets that hold a row of the predicate."""
        pin = self.pin()
        return self.pin(pin.df.where(predicate)) if pin.entry["keys"] else pin

    def update_where(self, predicate: Column, values: dict[str, Column]) -> int:
        pin, hit = self._where(predicate), F.coalesce(predicate, F.lit(False))
        return pin.commit(
            pin.df.select(
                *(
                    F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
                    for c in pin.df.columns
                )
            ),
            "update"
        )

    def delete_where(self, predicate: Column) -> int:
        pin = self._where(predicate)
        return pin.commit(pin.df.where(~F.coalesce(predicate, F.lit(False))), "delete")

    def add_columns(self, columns: dict[str, str]) -> tuple[str, list[str]]:
        """("MIGRATED_SUCCESS", added) or ("ALREADY_MIGRATED", []); no row is written again."""
        at, entry = self._latest()
        have = StructType.fromJson(entry["schema"])
        new = {c: t for c, t in columns.items() if c not in have.names}
        if not new:
            return "ALREADY_MIGRATED", []
        fields = [*have.fields, *(StructField(c, _parse_datatype_string(t)) for c, t in new.items())]
        self._append(self.spark.createDataFrame([], StructType(fields)), at, entry)
        return "MIGRATED_SUCCESS", list(new)

    def _folders(self, versions: Sequence[int]) -> set[str]:
        return {f.split("/")[0] for v in versions for folders in self._entry(v)["parts"].values() for f in folders}

    def _places(self, versions: Sequence[int]) -> set[str]:
        return {f for v in versions for folders in self._entry(v)["parts"].values() for f in folders}

    def vacuum(self, keep: int = 2) -> int:
        """Delete the versions before the last ones and the folders that only they have; returns how many."""
        have = self.versions()
        old, kept = have[:-keep], self._places(have[-keep:])
        gone = self._places(old) - kept
        for f in gone:
            self._fs.delete(self._path(f), True)
        for f in self._folders(old) - {k.split("/")[0] for k in kept}:
            self._fs.delete(self._path(f), True)
        for v in old:
            self._fs.delete(self._path("_log", f"{v:010d}.json"), False)
        return len(gone)


@dataclass
class Pin:
    """Some buckets of a table (all of them if touched is None) as of a version."""

    table: Table
    version: int
    entry: dict
    touched: list[int] | None
    df: DataFrame

    def commit(self, new: DataFrame, operation: str) -> int:
        """new replaces what was pinned; the other buckets stay. Returns the new version; fails if another
        commit came since."""
        keep = {} if self.touched is None else {b: f for b, f in self.entry["parts"].items() if int(b) not in self.touched}
        self.table._commit(new, operation, self.version + 1, self.entry["keys"], keep)
        return self.version + 1
