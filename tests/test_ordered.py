"""Ranks and rows before, against plain sorting."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.functions.ordered import numbered, with_before


def test_places_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(7)]), f"r{i:04}") for i in range(3000)]  # most scores are ties
    df = spark.createDataFrame(rows, "points int, repo string").repartition(9)
    got = [(r["points"], r["repo"], r["rank"]) for r in numbered(df, [F.desc("points"), F.asc("repo")]).collect()]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got, key=lambda r: r[2]) == [(*r, n) for n, r in enumerate(want, 1)]
    assert numbered(df.where("1 = 0"), [F.desc("points")]).count() == 0


def test_one_key_with_all_rows_in_many_slices(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [("all" if i % 50 else f"k{i % 3}", start + timedelta(minutes=rng.choice([0, 7, 60, 61, 400, rng.randint(0, 90_000)])), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "repo string, at timestamp_ntz, id int, x int")
    last, want = {}, {}
    for repo, at, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(repo, (None, None))
        last[repo] = x, i
    got = {r["id"]: (r["before_x"], r["before_id"]) for r in with_before(df, "repo", ["at", "id"], ["x", "id"]).collect()}
    assert got == want
