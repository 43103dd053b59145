"""A versioned Parquet store of several tables under one key, committed by one manifest.

A table is dealt into ``buckets`` by its key's hash, each a folder of Parquet files that never change. A manifest, a
small JSON file with the next number, names the folder of every bucket of every table: a reader lists the manifests, takes the last and reads
the folders it names. A commit writes new folders for the buckets that have changed keys, of all tables, and then its manifest, which is
renamed into place: until then readers see the state before, and after it all tables' new rows at once. A rename that finds its number
taken fails, so of two writers one must try again. Folders that no manifest names are what a failed commit left behind.

Manifests also hold the last batch of each stream, so that a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, freed

#: Keys that are shared with every task.
SHARED = 1_000_000


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class Versioned:
    """Tables under ``folder`` (any path that Spark can write). ``schemas`` has the columns of each, ``key`` among them."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], key: str = "doc_id", buckets: int = 16):
        self.spark, self.folder, self.schemas, self.key = spark, folder.rstrip("/"), schemas, key
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join([self.folder, *parts]))
        self._fs = self._path("manifests").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))
        self.buckets = self.manifest()["buckets"] if self.versions() else buckets

    # Manifests

    def versions(self) -> list[int]:
        """The numbers of the committed versions, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last, if none is named) consists of."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self.buckets if hasattr(self, "buckets") else 0, "tables": {t: {} for t in self.schemas}, "batches": {}}
        stream = self._fs.open(self._path("manifests", f"{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        name, trial = f"{manifest['version']:012d}.json", self._path("manifests", f".{uuid.uuid4().hex}")
        out = self._fs.create(trial)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._path("manifests", name)) or not self._fs.rename(trial, self._path("manifests", name)):
            self._fs.delete(trial, False)
            raise Conflict(f"version {manifest['version']} has been committed by another writer")

    # Reading

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows; with ``buckets``, of those alone."""
        listed = self.manifest(version)["tables"].get(table, {})
        paths = sorted({p for b, p in listed.items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.folder}/{p}" for p in paths])

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    # Writing

    def _write(self, rows: DataFrame, folder: str, mode: str = "error") -> None:
        """Each task writes the buckets of its own rows, which aren't dealt out for it."""
        with freed(self.spark):
            rows.withColumn("_bucket", self.bucket()).write.mode(mode).option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.folder}/{folder}")

    def _columns(self, table: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[table]).columns

    def stage(self, table: str, rows: DataFrame) -> str:
        """Writes ``rows`` of a table, computed once, to a folder that a commit can take over; readers don't see it before."""
        folder = f"data/{uuid.uuid4().hex}/{table}"
        self._write(rows.select(*self._columns(table)), folder)
        return folder

    def staged(self, table: str, folder: str) -> DataFrame:
        """The rows of a folder that ``stage`` returned."""
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{folder}")

    def commit(
        self, new: dict[str, DataFrame | str], replaced: dict[str, DataFrame], stream: str | None = None, batch: int | None = None, before_publish: Callable[[str], None] | None = None
    ) -> int:
        """The version that holds ``new`` rows of each table (a frame, or the folder of rows that are staged) in place of those whose key is in ``replaced`` (of that table).

        With ``stream`` and ``batch``, nothing is done if the stream's batch, or a later one, has been committed already. ``before_publish`` is told
        of each table when its folders are written (tests stop a commit there).
        """
        base = self.manifest()
        if stream is not None and base["batches"].get(stream, -1) >= batch:
            return base["version"]
        tables = {t: dict(b) for t, b in base["tables"].items()}
        for name in self.schemas:
            if name not in new and name not in replaced:
                continue
            rows = new.get(name, f"data/{uuid.uuid4().hex}/{name}")
            own = rows if isinstance(rows, str) else self.stage(name, rows)
            there = lambda: {s.getPath().getName().removeprefix("_bucket=") for s in self._fs.listStatus(self._path(own)) if s.getPath().getName().startswith("_bucket=")} if self._fs.exists(self._path(own)) else set()  # noqa: B023, E731
            gone = cut(replaced[name].select(self.key).distinct()) if name in replaced else None
            touched = there() | ({str(r[0]) for r in gone.select(self.bucket()).distinct().collect()} if gone is not None else set())  # at most ``buckets``
            if not touched:
                continue
            if set(touched) & tables.get(name, {}).keys():  # the rows that stay in those buckets
                kept = self.read(name, base["version"], sorted(map(int, touched)))
                if gone is not None:
                    kept = kept.join(F.broadcast(gone) if gone.limit(SHARED + 1).count() <= SHARED else gone.hint("merge"), self.key, "left_anti")
                self._write(kept.select(*self._columns(name)), own, "append")
            written = there()
            for b in touched:  # a bucket that has lost all its rows has no folder
                if b in written:
                    tables.setdefault(name, {})[b] = f"{own}/_bucket={b}"
                else:
                    tables.get(name, {}).pop(b, None)
            if before_publish:
                before_publish(name)
        batches = base["batches"] | ({stream: batch} if stream is not None else {})
        manifest = {"version": base["version"] + 1, "buckets": self.buckets, "tables": tables, "batches": batches}
        self._publish(manifest)
        return manifest["version"]

    def remove(self) -> None:
        """Deletes the store, all versions of it."""
        self._fs.delete(self._path("manifests").getParent(), True)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last ``keep`` versions names, and older manifests; returns how many folders went. Not beside a writer."""
        known = self.versions()
        held = {p.split("/_bucket=")[0] for v in known[-keep:] for b in self.manifest(v)["tables"].values() for p in b.values()}
        gone = 0
        if self._fs.exists(self._path("data")):
            for commit in self._fs.listStatus(self._path("data")):
                for table in self._fs.listStatus(commit.getPath()):
                    if f"data/{commit.getPath().getName()}/{table.getPath().getName()}" not in held:
                        self._fs.delete(table.getPath(), True)
                        gone += 1
        for v in known[:-keep]:
            self._fs.delete(self._path("manifests", f"{v:012d}.json"), False)
        return gone
