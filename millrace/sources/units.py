"""Units of work: changes of several tables that become visible together or not at all.

A store is a folder of data folders and numbered manifests. A manifest names, for each table, the folders that hold its rows, so a
snapshot is one small file. A unit stages its new folders first and then publishes the next manifest in one rename, which fails if
another writer was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from types import TracebackType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column (and folder name) that deals a stored table's rows out.
BUCKET = "_bucket"


class Conflict(Exception):
    """Another unit was published on the same base."""


class _Files:
    """The few file operations that a store needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.fs_package = spark._jvm.org.apache.hadoop.fs
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.root = self.fs_package.Path(root)
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(conf)
        self.context = self.fs_package.FileContext.getFileContext(self.fs.getUri(), conf)
        self.no_overwrite = spark.sparkContext._gateway.new_array(self.fs_package.Options.Rename, 1)
        self.no_overwrite[0] = self.fs_package.Options.Rename.NONE

    def path(self, name: str):
        return self.fs_package.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Make ``name`` with this content, all at once; False if it is there already."""
        folder = name.rpartition("/")[0]
        self.fs.mkdirs(self.path(folder))
        staged, final = self.path(f"{folder}/.{uuid.uuid4().hex}"), self.path(name)
        stream = self.fs.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self.context.rename(staged, final, self.no_overwrite)
            return True
        except Exception:
            if not self.fs.exists(final):
                raise
            return False
        finally:
            if self.fs.exists(staged):
                self.fs.delete(staged, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """Tables under one folder that change by units of work.

    Data folders are never changed after they were written, so a reader that has taken a snapshot keeps reading it while units are
    published. A unit that fails, or loses its executor or driver, leaves folders that no manifest names. ``expire`` deletes what only old
    manifests name.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root = spark, path.rstrip("/")
        self.files = _Files(spark, self.root)

    def version(self) -> int:
        """The number of the last published manifest; 0 before any."""
        return max((int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        if not number:
            return {"tables": {}, "writers": {}}
        return json.loads(self.files.read(f"versions/{number:012d}.json"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table in the last or a given snapshot."""
        return self.rows(self.manifest(version)["tables"][table])

    def rows(self, entry: dict, parts: list[str] | None = None) -> DataFrame:
        """The rows of a manifest's table, or of some of its parts only."""
        schema = T.StructType.fromJson(entry["schema"])
        folders = [f"{self.root}/{f}" for p, f in entry["parts"].items() if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def unit(self, writer: str | None = None, number: int = 0) -> Unit:
        """A unit of work on the present snapshot. ``writer`` numbers its units upwards; one that was published is not done again. Units
        without a writer are done whenever they are asked for."""
        return Unit(self, writer, number)

    def expire(self, keep: int = 1) -> None:
        """Forget all but the last ``keep`` snapshots, and delete the folders that only forgotten ones name."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json"))
        folders = lambda numbers: {f for n in numbers for t in self.manifest(n)["tables"].values() for f in t["parts"].values()}
        old, kept = numbers[:-keep], numbers[-keep:]
        for folder in sorted(folders(old) - folders(kept)):
            self.files.delete(folder)
        for number in old:
            self.files.delete(f"versions/{number:012d}.json")


class Unit:
    """Changes on one base snapshot, published together when the ``with`` block ends without an exception.

    ``read`` sees the changes staged so far, as later statements of a transaction do. If the writer's unit of that number (or a later one) has
    been published before, ``done`` is true and changes are ignored, so a replay changes nothing.
    """

    def __init__(self, store: Store, writer: str | None, number: int) -> None:
        self.store, self.writer, self.number = store, writer, number
        self.base = store.version()
        self.manifest = store.manifest(self.base)
        self.done = self._done_in(self.manifest)
        self.folder = f"data/{uuid.uuid4().hex}"
        self.waiting: dict[str, tuple[set[str], DataFrame]] = {}

    def __enter__(self) -> Unit:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if error is None and not self.done:
            self.publish()

    def _done_in(self, manifest: dict) -> bool:
        return self.writer is not None and manifest["writers"].get(self.writer, -1) >= self.number

    def read(self, table: str) -> DataFrame:
        self._settle(table)
        return self.store.rows(self.manifest["tables"][table])

    def replace(self, table: str, rows: DataFrame, key: str | None = None, buckets: int = 1) -> None:
        """The table's new rows. With ``key`` they are dealt out to ``buckets`` folders by its hash, which ``change`` then goes by."""
        if not self.done:
            self.waiting.pop(table, None)
            entry = {"schema": rows.schema.jsonValue(), "key": key, "buckets": buckets, "parts": {}}
            self.manifest["tables"][table] = entry | {"parts": self._stage(table, rows, entry)}

    def stage(self, rows: DataFrame) -> str:
        """Write rows to a folder that ``place`` can then make part of a table."""
        folder = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{folder}")
        return folder

    def place(self, table: str, part: str, folder: str, schema: T.StructType) -> None:
        """A staged folder as a named part of a table, instead of the part of that name if there is one."""
        if not self.done:
            self._settle(table)
            entry = self.manifest["tables"].setdefault(table, {"schema": schema.jsonValue(), "key": None, "buckets": 1, "parts": {}})
            entry["parts"][part] = folder

    def change(self, table: str, keys: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> None:
        """Apply ``rule`` (table to table) to the rows of a bucketed table that share a bucket with ``keys`` (one column, the key's values).

        ``rule`` may change, add and drop rows of these keys only. Buckets without such a key are neither read nor written: their folders
        stay. So the cost of a batch is that of the buckets it touches. Changes of the same buckets that follow one another are written once, when the
        unit is published or the table is read: a rule is given the rows that the one before it makes.
        """
        if self.done:
            return
        entry = self.manifest["tables"][table]
        key = F.col(keys.columns[0])
        touched = {str(r[0]) for r in keys.select(_bucket(key, entry["buckets"])).distinct().collect()}  # at most one row per bucket
        if table in self.waiting and self.waiting[table][0] != touched:
            self._settle(table)
        rows = self.waiting[table][1] if table in self.waiting else self.store.rows(entry, [p for p in entry["parts"] if p in touched])
        self.waiting[table] = touched, rule(rows).select([f["name"] for f in entry["schema"]["fields"]])

    def _settle(self, table: str) -> None:
        """Stage what ``change`` has left waiting."""
        if table not in self.waiting:
            return
        (touched, rows), entry = self.waiting.pop(table), self.manifest["tables"][table]
        staged = self._stage(table, rows, entry)
        if not staged.keys() <= touched:
            raise ValueError(f"the rule made rows of {table} whose keys are not among those it was given")
        entry["parts"] = {p: f for p, f in entry["parts"].items() if p not in touched} | staged

    def publish(self) -> int:
        """Make the changes visible; ``Conflict`` if another unit has come first (unless it was this one's replay)."""
        for table in list(self.waiting):
            self._settle(table)
        if self.writer is not None:
            self.manifest["writers"][self.writer] = self.number
        number = self.base + 1
        if not self.store.files.publish(f"versions/{number:012d}.json", json.dumps(self.manifest)):
            if not self._done_in(self.store.manifest()):
                raise Conflict(f"version {self.base} is not the last any more; run the unit again on the present one")
        self.done = True
        return number

    def _stage(self, table: str, rows: DataFrame, entry: dict) -> dict[str, str]:
        if entry["key"] is None:
            return {"0": self.stage(rows)}
        folder = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, _bucket(F.col(entry["key"]), entry["buckets"]))
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        made = [n for n in self.store.files.names(folder) if n.startswith(f"{BUCKET}=")]
        return {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in made}


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)
