"""Stateful folds: rows in any order and number, one hot key, idle keys."""

import random
import time
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import millrace.streaming.runs as runs
from millrace.plans.registry import QUERIES
from millrace.streaming import folds

START = datetime(2024, 1, 1)


def budget(rows, limit, window_s):
    held, want = defaultdict(deque), {}
    for at, i, user, units in sorted(rows):
        mine = held[user]
        while mine and (at - mine[0][0]).total_seconds() > window_s:
            mine.popleft()
        want[i] = sum(n for _, n in mine) + units <= limit
        if want[i]:
            mine.append((at, units))
    return want


def stream(spark, folder, **options):
    schema = "id long, user_id long, feature string, units long, at timestamp"
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(str(folder))


def write(spark, folder, rows, name):
    df = spark.createDataFrame([(i, user, "f", units, at) for at, i, user, units in rows], "id long, user_id long, feature string, units long, at timestamp")
    df.coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.mark.parametrize("batch", [7, 10_000])
def test_one_hot_key_in_many_frames(spark, tmp_path, batch):
    rng = random.Random(batch)
    rows = [(START + timedelta(seconds=rng.randint(0, 5000)), i, 1 if i % 10 else rng.randint(2, 5), rng.randint(1, 9)) for i in range(600)]
    rng.shuffle(rows)
    write(spark, tmp_path / "in", rows, "a")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = runs.finished(folds.folded(stream(spark, tmp_path / "in/*"), ["user_id", "feature"], folds.Budget(60, 300), "id long, user_id long, feature string, units long, allowed boolean"))
        got = {r["id"]: r["allowed"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == budget(rows, 60, 300)
    assert len(set(got.values())) == 2


def test_state_goes_on_and_idle_keys_leave_none(spark, tmp_path):
    """Key 1 has rows in every file, key 2 in the first alone: its timer takes its state away."""
    files = []
    for day in range(4):
        at = START + timedelta(days=3 * day)
        rows = [(at + timedelta(seconds=30 * i), 100 * day + i, 1, 3) for i in range(20)]
        rows += [(at, 90, 2, 5)] if day == 0 else []
        rows += [(at - timedelta(minutes=5), 100 * day + 50, 1, 1)] if day else []
        files += rows
        write(spark, tmp_path / "in", rows, f"f{day}")
        time.sleep(1.1)  # files are taken by age
    base = str(tmp_path / "run")
    one = stream(spark, tmp_path / "in/*", maxFilesPerTrigger=1)
    out = runs.finished(folds.folded(one, ["user_id", "feature"], folds.Budget(40, 600), "id long, user_id long, feature string, units long, allowed boolean"), base)
    assert {r["id"]: r["allowed"] for r in out.collect()} == budget(files, 40, 600)
    before = spark.conf.get(runs._PROVIDER, None)
    spark.conf.set(runs._PROVIDER, folds.PROVIDER)
    held = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "held").load()
    keys = {r["k"] for r in held.select(F.col("key.user_id").alias("k")).collect()}
    spark.conf.unset(runs._PROVIDER) if before is None else spark.conf.set(runs._PROVIDER, before)
    assert 2 not in keys and keys <= {1}


def test_presets(spark, sf_dir):
    rows = sorted((r["ts"], r["event_id"], r["user_id"], r["event_type"]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect())
    limits = {"signup": 1, "purchase": 1, "error": 2, "click": 1, "view": 1}
    state, want = {}, {}
    for at, i, user, kind in rows:
        start, n, until, bad = state.get((user, kind), (None, 0, None, 0))
        if until is not None and at < until:
            want[i] = False, bad
            continue
        if start is None or (at - start).total_seconds() >= 60:
            start, n = at, 0
        n += 1
        ok = n <= limits[kind]
        if not ok:
            bad += 1
            start, n, until = None, 0, at + timedelta(seconds=min(60 * 2 ** (bad - 1), 3600))
        state[user, kind] = start, n, until, bad
        want[i] = ok, bad
    fold = folds.Preset(limits, 60, 3600, runs.FORGET_S)
    from millrace.sources.lake import Lake

    rows = runs.events(Lake(spark, sf_dir)).withColumnRenamed("feature", "preset")
    out = runs.finished(folds.folded(rows, ["user_id", "preset"], fold, "id long, user_id long, preset string, allowed boolean, violations long"))
    assert {r["id"]: (r["allowed"], r["violations"]) for r in out.collect()} == want
    assert QUERIES["stream_ip_presets"](spark, sf_dir).count() == len(want)


class Calls:
    """A state that counts its round trips."""

    def __init__(self):
        self.n, self.of, self.timers = 0, {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            if name in ("getValueState", "getMapState"):
                return self.of.setdefault(args[0], Cell(self))
            return getattr(self.timers, {"registerTimer": "add", "deleteTimer": "remove"}[name])(args[0])

        return call


class Cell:
    def __init__(self, calls):
        self.calls, self.value, self.map = calls, None, {}

    def __getattr__(self, name):
        acts = {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: (setattr(self, "value", None), self.map.clear()),
            "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "updateValue": self.map.__setitem__, "removeKey": self.map.pop,
        }

        def call(*args):
            self.calls.n += 1
            return acts[name](*args)

        return call


def fold_of(fold, frames):
    import pandas as pd

    calls = Calls()
    fold.init(calls)
    calls.n = 0
    out = pd.concat(fold.handleInputRows(("a", "f"), iter(frames), None))
    return out, calls


def test_few_calls_for_a_key():
    import pandas as pd

    rows = pd.DataFrame({"at": [START], "id": [1], "units": [2], "preset": ["view"]})
    for fold in (folds.Budget(9, 60), folds.Preset({"view": 1}, 60, 3600, 60)):
        out, calls = fold_of(fold, [rows])
        assert len(out) == 1 and calls.n <= 3 and len(calls.timers) == 1


def test_few_calls_for_sparse_rows_in_many_frames():
    import pandas as pd

    rng = random.Random(5)
    rows = [(START + timedelta(seconds=rng.randint(0, 86400)), i, rng.randint(0, 100)) for i in range(3000)]
    frames = [pd.DataFrame(rows[a : a + 500], columns=["at", "id", "health"]) for a in range(0, 3000, 500)]
    out, calls = fold_of(folds.Fall(10, 60), frames)
    want, before = {}, None
    for _, i, h in sorted(rows):
        if before is not None and before - h >= 10:
            want[i] = before - h
        before = h
    assert dict(zip(out["id"], out["fall"])) == want
    assert calls.n < 400 and not calls.of["waiting"].map
