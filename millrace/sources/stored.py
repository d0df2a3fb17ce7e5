"""A keyed table of files that changes by versions: merges and deletes rewrite the buckets that they touch, and a change
is there as a whole or not at all.

A version is a small manifest that names the folder of each bucket. A change writes new folders beside the old ones and
then puts the next manifest in place, which only one writer can do; who comes second starts again from the new
version. Readers follow the newest manifest, so a writer that dies before the swap leaves the old version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Conflict(Exception):
    """Another writer has put this version in place."""


class StoredTable:
    """A table under ``path``, whose file system must rename without replacing (HDFS) or be a mounted folder."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, buckets: int = 16):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        fs, at = self._fs()
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def folders(self, version: int) -> dict[int, str]:
        if not version:
            return {}
        (text,) = self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).first()
        return {int(b): f for b, f in json.loads(text).items()}

    def _swap(self, version: int, folders: dict[int, str]) -> None:
        """Put the manifest of ``version`` in place, or raise ``Conflict`` if there is one."""
        jvm = self.spark._jvm
        fs, at = self._fs()
        fs.mkdirs(at)
        new, end = (jvm.org.apache.hadoop.fs.Path(at, n) for n in (f"new-{uuid.uuid4().hex}", f"{version:012d}"))
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if fs.getScheme() == "file":
            paths = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (new, end)]
            try:
                jvm.java.nio.file.Files.createLink(paths[1], paths[0])  # fails if the name is taken; rename would replace it
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                raise Conflict(version) from e
            finally:
                fs.delete(new, False)
        elif not fs.rename(new, end):
            fs.delete(new, False)
            raise Conflict(version)

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        of = self.folders(self.version() if version is None else version)
        folders = [f for b, f in sorted(of.items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, touched: list[int]) -> None:
        """The next version: ``rows`` are what the touched buckets hold then, of the others the folders stay."""
        base = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = rows.withColumn("__bucket", self._bucket())
        rows.repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(base)
        fs, _ = self._fs()
        held = self.folders(version)
        for b in touched:
            held.pop(b, None)
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/__bucket={b}")):
                held[b] = f"{base}/__bucket={b}"
        self._swap(version + 1, held)

    def _again(self, change: Callable[[int], None], tries: int = 20) -> None:
        for left in range(tries, 0, -1):
            try:
                return change(self.version())
            except Conflict:
                if left == 1:
                    raise

    def merge(self, new: DataFrame, order: list[str]) -> None:
        """Of each key the row with the largest ``order`` stays, of the stored and the new ones."""
        new = new.select(*self.schema.names)
        touched = [r[0] for r in new.select(self._bucket()).distinct().collect()]  # as many as buckets at most

        def change(version: int) -> None:
            both = self.read(version, touched).unionByName(new)
            newest = F.max_by(F.struct(*self.schema.names), F.struct(*order)).alias("row")
            self._write(both.groupBy(*self.keys).agg(newest).select("row.*"), version, touched)

        if touched:
            self._again(change)

    def delete(self, condition: Column) -> None:
        """Rows for which the condition is true go; buckets without one keep their files."""

        def change(version: int) -> None:
            gone = F.coalesce(condition, F.lit(False))
            rows = self.read(version)
            touched = [r[0] for r in rows.where(gone).select(self._bucket()).distinct().collect()]
            if touched:
                self._write(self.read(version, touched).where(~gone), version, touched)

        self._again(change)


class JobQueue:
    """Jobs that workers take: queued, running, done or failed. A job is taken by one worker only, as taking it is a new
    version of the table; one that has run for ``stale`` is queued again, up to ``attempts`` times."""

    SCHEMA = "id long, status string, attempts int, created_at timestamp, started_at timestamp, worker string"

    def __init__(self, spark: SparkSession, path: str, stale: str = "10 minutes", attempts: int = 3, buckets: int = 16):
        from pyspark.sql.types import StructType

        self.table = StoredTable(spark, path, ["id"], StructType.fromDDL(self.SCHEMA), buckets)
        self.stale, self.attempts = stale, attempts

    def add(self, jobs: DataFrame) -> None:
        """``jobs(id, created_at)`` as queued ones; those that are there already stay as they are."""
        rows = jobs.select("id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.col("created_at").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("worker"))
        self.table.merge(rows, ["attempts", "status"])

    def claim(self, worker: str, now: str, most: int = 2) -> list[int]:
        """The oldest waiting jobs for a worker, at most ``most`` (ten are allowed). What has gone stale waits again, or has
        failed after its last attempt."""
        most = max(1, min(most, 10))
        while True:
            version = self.table.version()
            at = F.lit(now).cast("timestamp")
            over = (F.col("status") == "running") & (F.col("started_at") < at - F.expr(f"interval {self.stale}"))
            failed = over & (F.col("attempts") >= self.attempts)
            rows = self.table.read(version).withColumn("status", F.when(failed, "failed").when(over, "queued").otherwise(F.col("status")))
            stale = self.table.read(version).where(over)
            mine = [r["id"] for r in rows.where("status = 'queued'").orderBy("created_at", "id").limit(most).collect()]
            changed = rows.join(stale.select("id"), "id", "left_semi").where(~F.col("id").isin(mine)) if mine else rows.join(stale.select("id"), "id", "left_semi")
            if mine:
                took = rows.where(F.col("id").isin(mine)).select(
                    "id", F.lit("running").alias("status"), (F.col("attempts") + 1).alias("attempts"), "created_at", at.alias("started_at"), F.lit(worker).alias("worker")
                )
                changed = changed.unionByName(took)
            try:
                self._put(changed, version)
                return mine
            except Conflict:
                continue

    def finish(self, worker: str, ids: list[int], status: str = "done") -> None:
        """Jobs end that this worker still holds; those that another one has taken since don't."""
        while True:
            version = self.table.version()
            mine = self.table.read(version).where(F.col("id").isin(ids) & (F.col("worker") == worker) & (F.col("status") == "running"))
            try:
                return self._put(mine.withColumn("status", F.lit(status)), version)
            except Conflict:
                continue

    def _put(self, changed: DataFrame, version: int) -> None:
        t = self.table
        touched = [r[0] for r in changed.select(t._bucket()).distinct().collect()]
        if not touched:
            return
        kept = t.read(version, touched).join(changed.select("id"), "id", "left_anti")
        t._write(kept.unionByName(changed).select(*t.schema.names), version, touched)
