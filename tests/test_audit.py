"""Audit batches: a failing sink loses and doubles nothing; critical rows don't wait."""

import time

from millrace.streaming.audit import AuditTrail, put


def stream(spark, folder):
    return spark.readStream.schema("id long, severity string").parquet(f"{folder}/*")


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, "id long, severity string").coalesce(1).write.parquet(f"{folder}/{name}")


def ids(trail):
    return sorted(r["id"] for r in trail.read().collect())


def test_failed_batches_run_again(spark, tmp_path):
    write(spark, tmp_path / "in", "a", [(i, "critical" if i % 3 == 0 else None if i % 5 == 0 else "info") for i in range(60)])
    failures = []

    def sink(rows, folder):
        put(rows.where("id % 2 = 0"), folder)  # half of it is there when it fails
        if len(failures) < 3:
            failures.append(folder)
            raise OSError("lost")
        put(rows, folder)

    trail = AuditTrail(stream(spark, tmp_path / "in"), str(tmp_path / "out"), every="0 seconds", sink=sink, tries=6).start()
    try:
        assert ids(trail.settle()) == list(range(60)) and len(failures) == 3
        write(spark, tmp_path / "in", "b", [(100, "critical"), (101, "info")])
        assert ids(trail.settle()) == [*range(60), 100, 101]
    finally:
        trail.stop()


def test_critical_rows_do_not_wait(spark, tmp_path):
    write(spark, tmp_path / "in", "a", [(1, "critical"), (2, "info")])
    trail = AuditTrail(stream(spark, tmp_path / "in"), str(tmp_path / "out"), every="1 hour").start()
    try:
        trail.running["critical"].processAllAvailable()
        write(spark, tmp_path / "in", "b", [(3, "critical"), (4, "info")])
        trail.running["critical"].processAllAvailable()
        for _ in range(60):
            if 2 in ids(trail):
                break
            time.sleep(0.5)
        assert {1, 3} <= set(ids(trail)) and 4 not in ids(trail)
    finally:
        trail.stop()
