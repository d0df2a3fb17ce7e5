"""Audit rows in batches, critical ones at once.

Two queries read the same stream. One writes critical rows as they come; the other gathers the rest for some seconds. A
batch is a folder named by its number, and a batch that failed runs again under the same number and replaces what it
had left, so each row is there once. Readers take finished folders only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Put = Callable[[DataFrame, str], None]


def put(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


class AuditTrail:
    """``rows`` is a stream with a column ``severity``; a null one is not critical. ``sink`` writes a batch to a folder and may
    fail: it is then tried again, ``tries`` times in all."""

    def __init__(self, rows: DataFrame, base: str, every: str = "5 seconds", sink: Put = put, tries: int = 3):
        self.rows, self.base, self.every, self.sink, self.tries = rows, base, every, sink, tries
        self.running: dict[str, StreamingQuery] = {}

    def start(self) -> AuditTrail:
        for path in ("critical", "rest"):
            self._start(path)
        return self

    def _start(self, path: str) -> None:
        which = "severity = 'critical'" if path == "critical" else "severity <> 'critical' or severity is null"
        sink, folder = self.sink, f"{self.base}/out/{path}"
        out = self.rows.where(which).writeStream.option("checkpointLocation", f"{self.base}/state/{path}")
        out = out.trigger(processingTime="0 seconds" if path == "critical" else self.every)
        self.running[path] = out.foreachBatch(lambda batch, n: sink(batch, f"{folder}/batch={n}")).start()

    def settle(self) -> AuditTrail:
        """Wait until all rows that are there have been written; what has failed goes on from its last finished batch."""
        for path in self.running:
            for left in range(self.tries, 0, -1):
                try:
                    self.running[path].processAllAvailable()
                    break
                except StreamingQueryException:
                    if left == 1:
                        raise
                    self._start(path)
        return self

    def stop(self) -> None:
        for q in self.running.values():
            q.stop()

    def read(self) -> DataFrame:
        """The rows of all finished batches."""
        spark = self.rows.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/out/*/batch=*/_SUCCESS")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        folders = [s.getPath().getParent().toString() for s in found or []]
        return spark.read.schema(self.rows.schema).parquet(*folders) if folders else spark.createDataFrame([], self.rows.schema)
