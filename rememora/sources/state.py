"""Chat state as Spark tables: load, persist, pluggable storage."""

from __future__ import annotations

import json
import re
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.schema import STATE_TABLES

# fixed values: ids that must never name a chat
RESERVED_IDS = ("__proto__", "constructor", "prototype")


def safe_chat_id(chat_id: str) -> str:
    """A chat id that can be a partition value; anything else is refused."""
    if not isinstance(chat_id, str) or not chat_id or chat_id in RESERVED_IDS:
        raise ValueError(f"unusable chat id: {chat_id!r}")
    if re.search(r"[/\\\x00]|\.\.", chat_id):
        raise ValueError(f"chat id holds a path separator: {chat_id!r}")
    return chat_id


class Backend(Protocol):
    """Where state tables live."""

    def read(self, name: str) -> DataFrame: ...

    def write(self, name: str, rows: DataFrame) -> None: ...


class ParquetBackend:
    """One folder per table, one partition per chat; a write replaces only the chats it holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        schema = STATE_TABLES[name]
        empty = self.spark.createDataFrame([], schema)
        if not self._exists(f"{self.root}/{name}"):
            return empty
        stored = self.spark.read.schema(empty.schema).parquet(f"{self.root}/{name}")
        return stored.select(*empty.columns)

    def write(self, name: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], STATE_TABLES[name]).columns
        missing = sorted(set(columns) - set(rows.columns))
        if missing:
            raise ValueError(f"{name}: missing columns {', '.join(missing)}")
        # a chat's rows meet in one task, a hot chat's in several: files grow with the data, not with tasks times chats
        (rows.select(*columns).hint("rebalance", "chat_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("chat_id").parquet(f"{self.root}/{name}"))

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


class Conflict(RuntimeError):
    """Another writer committed first."""


class BucketBackend:
    """Append-only deltas in hash buckets of chats, named by numbered manifests.

    A write adds one folder of rows, split by bucket, and one of the chats it replaces; files grow with
    buckets and data, not with chats. A version is one manifest, put in place by a rename that does not
    overwrite: of two writers from one version the second is refused (as surely as the file system refuses
    such a rename; HDFS does so atomically). A reader sees one version, whatever is written meanwhile.
    A row counts if no newer part replaces its chat. Beyond ``max_parts`` parts a write compacts the table.
    Rows without a chat are not stored. Folders of refused or replaced parts stay until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, max_parts: int = 8):
        self.spark, self.root, self.buckets, self.max_parts = spark, root.rstrip("/"), buckets, max_parts
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _files(self, path) -> list[str]:
        fs = path.getFileSystem(self._conf)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def version(self, name: str) -> int:
        """Number of the newest manifest; 0: nothing stored."""
        return max((int(f[:-5]) for f in self._files(self._path(name, "manifest")) if re.fullmatch(r"\d+\.json", f)), default=0)

    def _manifest(self, name: str, version: int) -> dict:
        if version == 0:
            return {"buckets": self.buckets, "parts": []}
        path = self._path(name, "manifest", f"{version:012d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, version: int, manifest: dict) -> int:
        draft, final = self._path(name, "manifest", f"draft-{uuid.uuid4().hex}"), self._path(name, "manifest", f"{version:012d}.json")
        fs = draft.getFileSystem(self._conf)
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(draft, final, options)
        except Exception as exc:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(exc):
                raise Conflict(f"{name}: version {version} exists") from exc
            raise
        return version

    def _bucket(self, chat, buckets: int):
        return F.pmod(F.xxhash64(chat), F.lit(buckets)).cast("int")

    def _add(self, name: str, manifest: dict, rows: DataFrame, chats: DataFrame | None = None) -> str:
        """Write rows and the chats that they replace, those of ``chats`` too; nothing names them yet."""
        part = f"part-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], STATE_TABLES[name]).columns
        missing = sorted(set(columns) - set(rows.columns))
        if missing:
            raise ValueError(f"{name}: missing columns {', '.join(missing)}")
        held = rows.select(*columns).filter("chat_id IS NOT NULL").withColumn("bucket", self._bucket(F.col("chat_id"), manifest["buckets"]))
        # a bucket's rows meet in one task, a hot one's in several
        held.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{part}/rows")
        written = self.spark.read.schema(held.schema).parquet(f"{self.root}/{name}/{part}/rows").select("chat_id")
        if chats is not None:
            written = written.unionByName(chats.select(F.col("chat_id").cast("string").alias("chat_id")).filter("chat_id IS NOT NULL"))
        written.distinct().write.parquet(f"{self.root}/{name}/{part}/chats")
        return part

    def write(self, name: str, rows: DataFrame, chats: DataFrame | None = None, at: int | None = None) -> int:
        """Replace the chats of ``rows`` and of ``chats`` (which end up empty without rows); returns the version.

        With ``at`` the write holds only on top of that version; without, it goes on top of whatever is there.
        """
        base = self.version(name)
        if at is not None and at != base:
            # refused before its rows are written; the commit decides about writers that come in between
            raise Conflict(f"{name}: version {at} is not the newest, {base}")
        part = self._add(name, self._manifest(name, base), rows, chats)
        while True:
            manifest = self._manifest(name, base)
            try:
                done = self._commit(name, base + 1, {**manifest, "parts": [*manifest["parts"], [base + 1, part]]})
                break
            except Conflict:
                if at is not None:
                    raise
                base = self.version(name)
        return self.compact(name) if len(manifest["parts"]) >= self.max_parts else done

    def compact(self, name: str) -> int:
        """One part in place of all; parts added meanwhile stay on top of it."""
        base = self.version(name)
        manifest = self._manifest(name, base)
        if len(manifest["parts"]) < 2:
            return base
        part, newest = self._add(name, manifest, self.read(name, version=base)), base
        while True:
            later = [p for p in self._manifest(name, newest)["parts"] if p[0] > base]
            try:
                return self._commit(name, newest + 1, {**manifest, "parts": [[base, part], *later]})
            except Conflict:
                newest = self.version(name)

    def read(self, name: str, chats: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The table at a version (the newest), whole or from the buckets of some chats."""
        manifest = self._manifest(name, self.version(name) if version is None else version)
        empty = self.spark.createDataFrame([], STATE_TABLES[name])
        rows = owners = None
        for number, part in manifest["parts"]:
            kept = self.spark.read.schema(empty.withColumn("bucket", F.lit(0)).schema).parquet(f"{self.root}/{name}/{part}/rows")
            if chats is not None:
                # constants, so other buckets' folders are not read
                kept = kept.filter(F.col("bucket").isin(*[self._bucket(F.lit(c), manifest["buckets"]) for c in chats])
                                   & F.col("chat_id").isin(*chats)) if chats else kept.filter("false")
            kept = kept.select(*empty.columns, F.lit(number).alias("_part"))
            rows = kept if rows is None else rows.unionByName(kept)
            if number != manifest["parts"][0][0]:
                told = self.spark.read.schema("chat_id string").parquet(f"{self.root}/{name}/{part}/chats").select(
                    F.col("chat_id").alias("_owner"), F.lit(number).alias("_newest"))
                owners = told if owners is None else owners.unionByName(told)
        if rows is None:
            return empty
        if owners is not None:
            newest = owners.groupBy("_owner").agg(F.max("_newest").alias("_newest"))
            replaced = (F.col("chat_id") == F.col("_owner")) & (F.col("_part") < F.col("_newest"))
            rows = rows.join(newest, replaced, "left_anti")
        return rows.select(*empty.columns)

    def vacuum(self, name: str, keep: int = 10) -> int:
        """Delete manifests but the newest ``keep`` and parts that these do not name; no write may run meanwhile."""
        newest, root = self.version(name), self._path(name)
        fs = root.getFileSystem(self._conf)
        kept = [v for v in range(max(1, newest - keep + 1), newest + 1)]
        named = {part for v in kept for _, part in self._manifest(name, v)["parts"]}
        gone = [self._path(name, f) for f in self._files(root) if f.startswith("part-") and f not in named]
        gone += [self._path(name, "manifest", f) for f in self._files(self._path(name, "manifest"))
                 if f not in {f"{v:012d}.json" for v in kept}]
        return sum(bool(fs.delete(path, True)) for path in gone)


class Store:
    """State of many chats over a backend; the default refuses to work, as it stores nowhere."""

    def __init__(self, backend: Backend | None = None):
        self._backend = backend

    def set_backend(self, backend: Backend) -> None:
        if not (callable(getattr(backend, "read", None)) and callable(getattr(backend, "write", None))):
            raise TypeError("a backend needs read and write")
        self._backend = backend

    @property
    def backend(self) -> Backend:
        if self._backend is None:
            raise RuntimeError("no storage backend configured")
        return self._backend

    def load(self, name: str, chats: list[str] | None = None) -> DataFrame:
        """A table, whole or for some chats; rows without chat or id are malformed and dropped."""
        asked = None if chats is None else [safe_chat_id(c) for c in chats]
        prune = asked is not None and isinstance(self.backend, BucketBackend)
        rows = (self.backend.read(name, asked) if prune else self.backend.read(name)).filter(F.col("chat_id").isNotNull())
        if "id" in rows.columns:
            rows = rows.filter(F.length("id") > 0)
        if asked is not None:
            rows = rows.filter(F.col("chat_id").isin(*asked))
        return rows

    def persist(self, name: str, rows: DataFrame) -> None:
        self.backend.write(name, rows)


def export_traces(traces: DataFrame, path: str) -> None:
    """One JSON object per line."""
    traces.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
