"""Versioned tables of Parquet files with atomic, idempotent commits and time travel.

A table is a folder: data/ holds immutable files, _log/ one JSON manifest for each version, created by a rename that
fails if the version exists (Hadoop's FileContext, so any file system of the cluster). A commit that loses the race reads
the log again and tries anew. A writer that passes txn=(application, number) is skipped if that number is already in the
table, so a repeated micro-batch changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.operators.latest import forward_only

ATTEMPTS = 20
#: Every so many versions the log holds a full list of files, from which a snapshot is read.
SUMMARY_EVERY = 20


class Conflict(RuntimeError):
    """Another writer took the version."""


class Folder:
    """A few file operations of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.jvm, self.gateway = jvm, spark.sparkContext._gateway
        base = jvm.org.apache.hadoop.fs.Path(root)
        self.fs = base.getFileSystem(conf)
        self.root = self.fs.makeQualified(base).toString()
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def files(self, folder: str) -> list[tuple[str, int, int]]:
        """(relative name, bytes, time of change in ms) of all files below."""
        p = self.path(folder)
        out = []
        if self.fs.exists(p):
            it = self.fs.listFiles(p, True)
            while it.hasNext():
                s = it.next()
                out.append((s.getPath().toString()[len(self.root) + 1 :], s.getLen(), s.getModificationTime()))
        return out

    def read(self, name: str) -> str:
        source = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, name: str, text: str) -> None:
        """All of the file or none of it; Conflict if it exists."""
        temporary = self.path(f"_log/.{uuid.uuid4().hex}.tmp")
        sink = self.fs.create(temporary, False)
        try:
            sink.write(bytearray(text.encode()))
        finally:
            sink.close()
        no_overwrite = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            if self.fs.exists(self.path(name)):
                raise Conflict(name)
            self.context.rename(temporary, self.path(name), no_overwrite)
        except Conflict:
            self.fs.delete(temporary, False)
            raise
        except Exception as e:
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def delete(self, name: str, recursive: bool = False) -> None:
        self.fs.delete(self.path(name), recursive)

    def publish(self, df: DataFrame, name: str) -> bool:
        """df as Parquet files in folder `name`, all at once and only once: False, and nothing written, where it exists.

        Files are written beside it, under a hidden name, and the folder is renamed when whole, so a reader sees no part of
        it, and a repeated or killed writer leaves the names of published files as they are.
        """
        if self.fs.exists(self.path(name)):
            return False
        hidden = f".{name}.{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{hidden}")
        if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(hidden), self.path(name)):
            self.delete(hidden, recursive=True)
            if not self.fs.exists(self.path(name)):
                raise OSError(f"{self.root}/{name} can't be published")
            return False
        return True


def occurring(df: DataFrame, column: str, most: int = 10_000) -> Column:
    """Condition on `column` that holds for every value of it in df: a list of them, or beyond `most` their range."""
    values = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(values) <= most:
        return F.col(column).isin(values)
    low, high = df.agg(F.min(column), F.max(column)).first()
    return F.col(column).between(low, high)


@dataclass(frozen=True)
class Snapshot:
    version: int
    files: frozenset
    schema: T.StructType
    partition_by: tuple
    txns: dict
    buckets: int


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.root = self.folder.root

    # -- log ---------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in self.folder.names("_log") if n.endswith(".json") and n[:20].isdigit()]

    def exists(self) -> bool:
        return bool(self.versions())

    def _entry(self, version: int) -> dict:
        return json.loads(self.folder.read(f"_log/{version:020d}.json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        have = [v for v in self.versions() if version is None or v <= version]
        if not have or version is not None and have[-1] != version:
            raise FileNotFoundError(f"no such version of {self.root}: {version}")
        entries = []
        for v in reversed(have):
            entries.append(e := self._entry(v))
            if "files" in e:
                break
        entries.reverse()
        first = entries[0]
        files, txns = set(first["files"]), dict(first["txns"])
        for e in entries[1:]:
            files = files - set(e["removes"]) | set(e["adds"])
            txns |= e["txn"]
        return Snapshot(have[-1], frozenset(files), T.StructType.fromJson(first["schema"]), tuple(first["partition_by"]), txns, first["buckets"])

    def history(self) -> DataFrame:
        rows = []
        for v in self.versions():
            e = self._entry(v)
            rows.append((v, e["op"], len(e["adds"]), len(e["removes"]), e["data_change"], datetime.fromtimestamp(e["at"], timezone.utc)))
        return self.spark.createDataFrame(rows, "version long, op string, added int, removed int, data_change boolean, committed_at timestamp")

    def _commit(self, base: Snapshot | None, op: str, adds: list, removes: list, *, txn=None, data_change=True, **first) -> int:
        version = 0 if base is None else base.version + 1
        entry = {"op": op, "adds": sorted(adds), "removes": sorted(removes), "txn": dict([txn]) if txn else {}, "data_change": data_change, "at": time.time()}
        if base is None:
            entry |= {"files": [], "txns": {}} | first
        elif version % SUMMARY_EVERY == 0:
            files = base.files - set(removes) | set(adds)
            entry |= {"files": sorted(files), "txns": base.txns | entry["txn"], "schema": json.loads(base.schema.json()), "partition_by": list(base.partition_by), "buckets": base.buckets}
        self.folder.create(f"_log/{version:020d}.json", json.dumps(entry))
        return version

    def _retry(self, change: Callable[[Snapshot], int | None]) -> int | None:
        """Runs a change of the newest snapshot, again after a lost race."""
        for attempt in range(ATTEMPTS):
            try:
                return change(self.snapshot())
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(min(2.0, 0.05 * 2**attempt))

    def ensure(self, schema: T.StructType, partition_by: list[str] | None = None, comment: str = "", buckets: int = 0) -> TableStore:
        """Creates the table unless it exists; of several creators one wins. buckets: for keyed tables, see upsert."""
        if not self.exists():
            try:
                self._commit(None, "create", [], [], schema=json.loads(schema.json()), partition_by=partition_by or [], buckets=buckets, comment=comment)
            except Conflict:
                pass
        return self

    # -- reading -----------------------------------------------------------

    def _load(self, snap: Snapshot, files) -> DataFrame:
        schema = snap.schema
        if not files:
            return self.spark.createDataFrame([], schema)
        hidden = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())]) if snap.buckets else schema
        df = self.spark.read.schema(hidden).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/{f}" for f in sorted(files)])
        return df.select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        snap = self.snapshot(version)
        return self._load(snap, snap.files)

    def files(self) -> int:
        return len(self.snapshot().files)

    # -- writing -----------------------------------------------------------

    def _write(self, df: DataFrame, snap: Snapshot, key: str | None = None) -> list[str]:
        """Writes df as new data files, in a folder of its own, and returns their names. The folder name is a partition value that no reader asks for."""
        commit = f"data/_c={uuid.uuid4().hex}"
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in snap.schema.fields])
        by = list(snap.partition_by)
        if snap.buckets and key:
            df, by = df.withColumn("_bucket", bucket_of(key, snap.buckets)), ["_bucket"]
        if by:
            df = df.repartition(*by) if snap.buckets and key else df
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.root}/{commit}")
        return [n for n, _, _ in self.folder.files(commit) if n.endswith(".parquet")]

    def append(self, df: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Adds rows; with txn at most once. Returns the new version, None if skipped."""
        snap = self.snapshot()
        if txn and snap.txns.get(txn[0], -1) >= txn[1]:
            return None
        adds = self._write(df, snap)

        def change(now: Snapshot) -> int | None:
            if txn and now.txns.get(txn[0], -1) >= txn[1]:
                return None
            return self._commit(now, "append", adds, [], txn=txn)

        return self._retry(change)

    def merge_insert_only(self, df: DataFrame, keys: list[str], prune: str | None = None, txn: tuple[str, int] | None = None) -> int | None:
        """Adds the rows whose key the table lacks. prune: a partition column among keys, by whose values in df the table is read."""

        def change(now: Snapshot) -> int | None:
            if txn and now.txns.get(txn[0], -1) >= txn[1]:
                return None
            have = self._load(now, now.files)
            if prune is not None:
                have = have.where(occurring(df, prune))
            adds = self._write(df.join(have.select(*keys), keys, "left_anti"), now)
            return self._commit(now, "insert", adds, [], txn=txn) if adds or txn else None

        return self._retry(change)

    def upsert(self, df: DataFrame, key: str, *, txn: tuple[str, int] | None = None, **rules) -> int | None:
        """Forward-only merge of one row for each key (see operators.latest.forward_only). Only the buckets that df touches are read and replaced."""

        def change(now: Snapshot) -> int | None:
            if txn and now.txns.get(txn[0], -1) >= txn[1]:
                return None
            touched, files = None, now.files
            if now.buckets:
                touched = {r[0] for r in df.select(bucket_of(key, now.buckets).alias("b")).distinct().collect()}  # at most `buckets` rows
                files = frozenset(f for f in now.files if any(f"/_bucket={b}/" in f for b in touched))
                if not touched:
                    return None
            merged = forward_only(self._load(now, files), df, key, **rules)
            adds = self._write(merged, now, key)
            return self._commit(now, "upsert", adds, list(files), txn=txn)

        return self._retry(change)

    # -- maintenance -------------------------------------------------------

    def compact(self, target_files: int | None = None, sort_by: list[str] | None = None, target_bytes: int = 128 << 20) -> tuple[int, int]:
        """Rewrites the table into fewer files, clustered by one column or along a Z-order curve of several, so that Parquet's statistics skip files.

        As many tasks as target_files, or as files of target_bytes hold the table. Rows are ranged by partition first, so a
        task writes few partitions and a large one is split among tasks. Streams over changes don't see it. Returns files
        before and after.
        """

        def change(now: Snapshot) -> tuple[int, int]:
            if now.buckets:
                raise ValueError("bucketed tables are rewritten by upsert")
            tasks = target_files
            if tasks is None:
                size, live = 0, set(now.files)
                for name, bytes_, _ in self.folder.files("data"):
                    size += bytes_ if name in live else 0
                tasks = max(1, -(-size // target_bytes))
            df, by = self._load(now, now.files), list(now.partition_by)
            if sort_by:
                curve = sort_by if len(sort_by) == 1 else [z_order(df, sort_by)]
                df = df.repartitionByRange(tasks, *by, *curve).sortWithinPartitions(*by, *curve)
            elif by and tasks > 1:
                df = df.repartitionByRange(tasks, *by, F.xxhash64(*df.columns))
            else:
                df = df.coalesce(tasks)
            adds = self._write(df, now)
            self._commit(now, "compact", adds, list(now.files), data_change=False)
            return len(now.files), len(adds)

        return self._retry(change)

    def vacuum(self, retain_hours: float = 168.0) -> int:
        """Deletes data files that the newest version doesn't use and that are older than the retention. Earlier versions can't be read afterwards."""
        used, limit = self.snapshot().files, (time.time() - retain_hours * 3600) * 1000
        old = [n for n, _, at in self.folder.files("data") if n not in used and at <= limit]
        for n in old:
            self.folder.delete(n)
        return len(old)

    def drop(self) -> None:
        """Removes the table, log and all."""
        self.folder.fs.delete(self.folder.jvm.org.apache.hadoop.fs.Path(self.root), True)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def z_order(df: DataFrame, columns: list[str], bits: int = 6, sample: int = 2_000):
    """Interleaved bits of the columns' ranks among values of a bounded sample, as a sort key that clusters by all of them."""
    n = (1 << bits) - 1
    rows = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(sample).collect()
    rank = lambda c, cuts: F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda x: x <= F.col(c)))
    ranks = []
    for c in columns:
        values = sorted({r[c] for r in rows if r[c] is not None})
        cuts = [values[k * len(values) // (n + 1)] for k in range(1, n + 1)] if values else []
        ranks.append(rank(c, cuts) if cuts else F.lit(0))
    return F.concat(*[F.shiftright(F.coalesce(r, F.lit(0)), b).bitwiseAND(F.lit(1)).cast("string") for b in range(bits - 1, -1, -1) for r in ranks])
