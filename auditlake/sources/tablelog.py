"""A folder of Parquet files with a log of which of them are the table.

Every change is one small file in the log, named by its version: the data files it adds, with their bucket, rows, bytes
and the least and greatest key and time in them, and the files it takes out. Only what a version names is read, so files of
a writer that was lost are no part of the table, and a reader keeps the version it began with. A version's file is written
beside the log and renamed to its number, which fails when another writer took it; that writer's change is then looked at,
and the own one goes in after it unless both take out the same file. Every ``SNAPSHOT`` versions the live files are
written as a table, from which later readers start. Files that a merge replaced stay for the readers of former versions
for ``grace`` seconds at least; files with rows that were purged go at once.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16  # of a new file's table; a file's row in the log has the number it was written with
SNAPSHOT = 20

FILE = (
    "path string, bucket int, buckets int, rows bigint, bytes bigint, least_key string, greatest_key string, "
    "least_time timestamp, greatest_time timestamp"
)
ACTION = f"version bigint, op string, {FILE}"


class Conflict(RuntimeError):
    """Another writer has taken out a file that this change rests on."""


_locks: dict[str, threading.Lock] = {}


class TableLog:
    """``key`` decides the bucket; ``time`` is the column whose range a file is known by."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        key: str,
        time: str,
        order: Sequence[str] = (),
        grace: float = 3600.0,
        buckets: int = BUCKETS,
    ):
        self.grace, self.buckets = grace, buckets
        self.spark, self.root, self.schema, self.key, self.time = spark, root.rstrip("/"), schema, key, time
        self.order = [key, *order]
        self.lock = _locks.setdefault(self.root, threading.Lock())

    # The file system the root lives on.

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The last version; 0 for a table without any."""
        return max((int(n.removesuffix(".json")) for n in self._names("_log") if n.endswith(".json")), default=0)

    def _snapshot(self, version: int) -> int:
        """The last version up to this one whose files are written as a table; 0 without any."""
        fs, numbers = self._fs(), [int(n) for n in self._names("_snapshots")]
        whole = (n for n in numbers if n <= version and fs.exists(self._path(f"{self.root}/_snapshots/{n}/_SUCCESS")))
        return max(whole, default=0)

    def live(self, version: int | None = None) -> DataFrame:
        """The files of the table as rows of ``FILE``; versions before the last snapshot may be gone."""
        version = self.version() if version is None else version
        start = self._snapshot(version)
        numbers = range(start + 1, version + 1)
        actions = self.spark.createDataFrame([], ACTION)
        if numbers:
            actions = self.spark.read.schema(ACTION).json([f"{self.root}/_log/{n:020d}.json" for n in numbers])
        if start:
            kept = self.spark.read.schema(FILE).parquet(f"{self.root}/_snapshots/{start}")
            actions = actions.unionByName(kept.withColumns({"version": F.lit(start).cast("bigint"), "op": F.lit("add")}))
        last = F.max_by(F.struct("op", *[c for c in actions.columns if c not in ("version", "op", "path")]), "version")
        return actions.groupBy("path").agg(last.alias("f")).filter("f.op = 'add'").select("path", "f.*").drop("op")

    def read(self, where: Column | None = None, version: int | None = None) -> DataFrame:
        """The rows of the live files that meet the condition on ``FILE``."""
        files = self.live(version)
        return self.open([r.path for r in (files if where is None else files.filter(where)).select("path").collect()])

    def open(self, paths: Sequence[str], place: bool = False) -> DataFrame:
        """The rows of some files, where asked for with the file's path as ``at``."""
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, at string" if place else self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in paths])
        inside = F.concat(F.lit("data/"), F.substring_index("_metadata.file_path", "/data/", -1))
        return rows.withColumn("at", inside) if place else rows

    def of_key(self, key: str) -> DataFrame:
        """The rows of one key, from the files of its bucket that may hold it."""
        here = (F.col("bucket") == F.pmod(F.xxhash64(F.lit(key)), F.col("buckets"))) & F.lit(key).between(F.col("least_key"), F.col("greatest_key"))
        return self.read(here).filter(F.col(self.key) == key)

    def write(self, rows: DataFrame) -> list[dict]:
        """Write files that are not yet part of the table, and describe them. The rows are computed once.

        Adaptive execution deals a bucket of many rows out to several tasks, and few rows of many buckets to one.
        """
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        dealt = dealt.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.order)
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        written = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.root}/{folder}")
        files = written.groupBy(F.col("_metadata.file_path").alias("at")).agg(
            F.min("_bucket").alias("bucket"), F.lit(self.buckets).alias("buckets"), F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"),
            F.min(self.key).alias("least_key"), F.max(self.key).alias("greatest_key"),
            F.min(self.time).cast("string").alias("least_time"), F.max(self.time).cast("string").alias("greatest_time"),
        )
        described = files.withColumn("path", F.concat(F.lit(folder), F.substring_index("at", folder, -1))).drop("at")
        return [r.asDict() for r in described.collect()]

    def commit(self, added: list[dict], removed: Sequence[str] = (), tries: int = 50) -> int:
        """Make one version of the table from the last one; Conflict when a removed file is no longer live."""
        for wait in range(tries):
            version = self.version()
            if removed:
                left = self.live(version).filter(F.col("path").isin(list(removed))).count()
                if left < len(set(removed)):
                    raise Conflict("a file that was to be replaced is gone")
            lines = [{"version": version + 1, "op": "add", **f} for f in added]
            lines += [{"version": version + 1, "op": "remove", "path": p} for p in removed]
            if self._claim(version + 1, "\n".join(json.dumps(line) for line in lines) + "\n"):
                if (version + 1) % SNAPSHOT == 0:
                    self.live(version + 1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_snapshots/{version + 1}")
                    self.vacuum()
                return version + 1
            time.sleep(min(1.0, 0.01 * 2**wait))
        raise Conflict(f"no version could be taken in {tries} tries")

    def _claim(self, version: int, text: str) -> bool:
        """Whether the version's file is ours. The rename is atomic where the file system's is, as on HDFS."""
        jvm, fs = self.spark._jvm, self._fs()
        beside = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(text.encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        target = self._path(f"{self.root}/_log/{version:020d}.json")
        try:
            with self.lock:
                context.rename(fs.makeQualified(beside), fs.makeQualified(target), options)
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            fs.delete(beside, False)
            return False

    def append(self, rows: DataFrame) -> list[dict]:
        added = self.write(rows)
        if added:
            self.commit(added)
        return added

    def replace(self, paths: Sequence[str], rows: DataFrame, purge: bool = True) -> None:
        """Put the rows in the place of the files, in one version; delete those now, or leave them to ``vacuum``."""
        self.commit(self.write(rows), list(paths))
        if purge:
            self._delete(paths)

    def _delete(self, paths: Sequence[str]) -> None:
        for path in paths:
            self._fs().delete(self._path(f"{self.root}/{path}"), False)

    def vacuum(self) -> int:
        """Delete what versions up to the last snapshot took out, once they are older than the grace, and their log files."""
        fs, until = self._fs(), self._snapshot(self.version())
        before = (time.time() - self.grace) * 1000
        log = self._path(f"{self.root}/_log")
        states = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(log)] if until else []
        old = [n for n, at in states if n.endswith(".json") and int(n.removesuffix(".json")) < until and at <= before]
        if not old:
            return 0
        gone = self.spark.read.schema(ACTION).json([f"{self.root}/_log/{n}" for n in old]).filter("op = 'remove'").select("path").collect()
        self._delete([r.path for r in gone])
        self._delete([f"_log/{n}" for n in old])
        return len(gone)

    def compact(self, buckets: Sequence[int], keep: Callable[[DataFrame], DataFrame], files: int = 8) -> int:
        """Merge files of like size where a bucket has many; ``keep`` drops rows that others of the same key replace.

        Like sizes are merged, so a row is rewritten as often as the logarithm of its bucket's size. Returns the
        number of files merged. Lost to another writer, the merge is left for the next time.
        """
        tier = F.floor(F.log2(F.greatest(F.col("bytes"), F.lit(1 << 16))) / 2).alias("tier")
        crowded = self.live().filter(F.col("bucket").isin(list(buckets))).groupBy("bucket", "buckets", tier).agg(F.collect_list("path").alias("paths"))
        paths = [p for r in crowded.filter(F.size("paths") >= files).select("paths").collect() for p in r.paths]
        if paths:
            try:
                self.replace(paths, keep(self.open(paths)), purge=False)
            except Conflict:
                return 0
        return len(paths)
