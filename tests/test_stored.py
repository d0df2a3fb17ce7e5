"""Stored tables: what a change rewrites, what a crash leaves, who wins."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from millrace.sources.stored import Conflict, JobQueue, StoredTable

SCHEMA = StructType().add("k", LongType()).add("at", LongType()).add("v", StringType())


def table(spark, folder):
    return StoredTable(spark, f"file://{folder}/t", ["k"], SCHEMA, buckets=4)


def held(t):
    return {r["k"]: (r["at"], r["v"]) for r in t.read().collect()}


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == {} and t.version() == 0
    t.merge(spark.createDataFrame([(k, 1, "a") for k in range(40)] + [(None, 1, "none")], SCHEMA), ["at"])
    first = t.folders(1)
    t.merge(spark.createDataFrame([(3, 2, "b"), (3, 0, "old"), (99, 1, "new")], SCHEMA), ["at"])
    second = t.folders(2)
    assert len(first) == 4 and 1 <= sum(first[b] != second[b] for b in first) <= 2
    now = held(t)
    assert now[3] == (2, "b") and now[99] == (1, "new") and now[4] == (1, "a") and now[None] == (1, "none") and len(now) == 42
    assert len(t.read(1).collect()) == 41  # older versions stay readable
    t.merge(spark.createDataFrame([], SCHEMA), ["at"])
    assert t.version() == 2


def test_deletes_leave_other_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(k, k, "a") for k in range(40)], SCHEMA), ["at"])
    before = t.folders(1)
    t.delete(F.col("at") == 7)
    after = t.folders(2)
    assert sum(before[b] != after[b] for b in before) == 1 and set(held(t)) == set(range(40)) - {7}
    t.delete(F.col("at") > 1000)
    assert t.version() == 2
    t.delete(F.col("at") >= 0)
    assert held(t) == {}


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA), ["at"])

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(StoredTable, "_swap", crash)
    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([(1, 2, "b")], SCHEMA), ["at"])
    monkeypatch.undo()
    assert held(t) == {1: (1, "a")} and t.version() == 1


def test_one_winner_for_each_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA), ["at"])
    t._swap(2, t.folders(1))
    with pytest.raises(Conflict):
        t._swap(2, t.folders(1))
    threads = [threading.Thread(target=t.merge, args=(spark.createDataFrame([(k, 1, "x")], SCHEMA), ["at"])) for k in range(10, 14)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert set(held(t)) == {1, 10, 11, 12, 13} and t.version() == 6


def test_two_workers_never_take_the_same_job(spark, tmp_path):
    q = JobQueue(spark, f"file://{tmp_path}/q", buckets=2)
    q.add(spark.range(12).select("id", F.timestamp_seconds(F.col("id") * 10).alias("created_at")))
    took = {"a": [], "b": []}

    def work(name):
        for _ in range(3):
            took[name] += q.claim(name, "2024-01-01 00:00:00", 2)

    threads = [threading.Thread(target=work, args=(n,)) for n in took]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(took["a"] + took["b"]) == list(range(12))
    assert q.claim("c", "2024-01-01 00:00:01") == []
    q.finish("a", took["a"][:1])
    q.finish("b", took["a"][1:2])  # not b's
    # all but the one that is done are stale, and go again oldest first
    again = q.claim("c", "2024-01-01 00:10:01", 10)
    assert again == [i for i in range(12) if i != took["a"][0]][:10]
    rows = {r["id"]: (r["status"], r["attempts"]) for r in q.table.read().collect()}
    assert rows[took["a"][0]] == ("done", 1) and all(rows[i] == ("running", 2) for i in again)


def test_a_job_fails_after_its_last_attempt(spark, tmp_path):
    q = JobQueue(spark, f"file://{tmp_path}/q", attempts=2, buckets=1)
    q.add(spark.range(1).select("id", F.timestamp_seconds(F.lit(0)).alias("created_at")))
    assert [q.claim("a", f"2024-01-01 0{h}:00:00") for h in range(4)] == [[0], [0], [], []]
    assert [tuple(r) for r in q.table.read().select("status", "attempts").collect()] == [("failed", 2)]
