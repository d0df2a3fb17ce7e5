"""Pulls: reviewers are counted without a table of pairs, also with nulls, repeated lines and repeated orders."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import millrace.operators  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES
from millrace.sources.lake import Lake
from tests.compare import rows


def small(spark, sf_dir, folder):
    for t in "region nation customer".split():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").limit(50)
    orders.union(orders.limit(5)).write.parquet(f"{folder}/orders.parquet")
    k = F.col("l_linenumber")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_suppkey", F.when(k % 4 == 0, None).when(k % 3 == 0, 1).otherwise(F.col("l_suppkey")))
    lines.union(lines.limit(40)).withColumn("l_orderkey", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_orderkey"))).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_reviewers(spark, sf_dir, tmp_path):
    lake = Lake(spark, small(spark, sf_dir, tmp_path))
    want = lake.table("orders").select("o_orderkey").distinct().join(lake.table("lineitem"), F.expr("o_orderkey = l_orderkey"), "left").groupBy(F.col("o_orderkey").alias("number")).agg(F.count_distinct("l_suppkey").alias("n_reviewers"))
    got = lake.pulls.select("number", "n_reviewers")
    assert rows(got.distinct()) == rows(want) and got.schema["n_reviewers"].dataType.typeName() == "long"
    assert got.count() > want.count()


def test_no_aggregate_by_reviewer(spark, sf_dir, capsys):
    for name in ("pr_complexity", "pr_sort", "pr_summary", "pr_enrich"):
        QUERIES[name](spark, sf_dir).explain("formatted")
        plan = capsys.readouterr().out
        assert "Aggregate" in plan
        assert not re.search(r"Keys \[\d+\]: [^\n]*o_orderkey[^\n]*l_suppkey", plan), name


@pytest.mark.parametrize("name", ["pr_sort", "pr_summary", "pr_enrich"])
def test_no_table_of_a_tasks_pulls(spark, sf_dir, capsys, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, sf_dir).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "SortAggregate(key=[o_orderkey#" in plan
    assert "HashAggregate(keys=[o_orderkey#" not in plan
    # what is added up goes into the join in its order
    assert not re.search(r"Sort \[[^\n]*\n[ :+|-]*SortAggregate", plan)


def mixed(spark, sf_dir, folder):
    """Pulls of up to 40 files and some thousand lines that wait for hours to weeks; some orders twice, on other days."""
    for t in "region nation customer".split():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    now = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.max("l_shipdate")).first()[0]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.lit(now) - F.expr("make_dt_interval(0, cast(o_orderkey % 420 as int), 0, 0)"))
    again = orders.where("o_orderkey % 50 = 7").withColumn("o_orderdate", F.expr("o_orderdate - interval '9' day"))
    orders.union(again).write.parquet(f"{folder}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_quantity", F.col("l_quantity") * (F.col("l_orderkey") % 7))
    lines.select("*", F.explode(F.expr("sequence(0, cast(l_orderkey % 13 as int))"))).drop("col").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def over(x, steps):
    return next((points for least, points in steps if x > least), 0)


def test_every_open_pull_in_three_orders(spark, sf_dir, tmp_path):
    folder = mixed(spark, sf_dir, tmp_path)
    lake = Lake(spark, folder)
    now = lake.table("lineitem").agg(F.max("l_shipdate")).first()[0]
    pulls, met = [], [set(), set(), set()]
    for p in lake.pulls.where("state = 'open'").collect():
        churn, age = p["additions"] + p["deletions"], (now - p["created_at"]).total_seconds() / 86400
        parts = over(churn, [(1000, 40), (400, 25), (100, 10)]), over(p["changed_files"], [(30, 30), (15, 18), (5, 8)]), over(age, [(14, 20), (7, 10)])
        for seen, part in zip(met, parts):
            seen.add(part)
        score = sum(parts) - 10 * p["draft"] + 10 * (p["n_reviewers"] == 0) + 25 * bool(re.search("security|breaking|urgent|critical|hotfix", p["label"], re.I))
        pulls.append((p["repo"], p["number"], min(100, max(0, score)), math.floor(age * 10 + 0.5) / 10, churn, p["n_reviewers"]))
    assert met == [{0, 10, 25, 40}, {0, 8, 18, 30}, {0, 10, 20}]
    assert len(pulls) > 100 and len({p[:2] for p in pulls}) < len(pulls)
    want = [(by, *p) for by, at in (("age", 3), ("risk", 2), ("size", 4)) for p in sorted(pulls, key=lambda p: (-p[at], p[1], p[0], -p[2], -p[3]))]
    df = QUERIES["pr_sort"](spark, folder)
    assert df.columns == ["sort_by", "repo", "number", "score", "wait_days", "churn", "n_reviewers"]
    assert [tuple(r) for r in df.collect()] == want
    con = duckdb.connect()
    for t in "region nation customer orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert con.execute(ORACLES["pr_sort"]).fetchall() == want


def test_no_cap_on_sorted_pulls(spark, sf_dir):
    still = Lake(spark, sf_dir).orders.where("o_orderstatus = 'O'").count()
    by = {r["sort_by"]: r["count"] for r in QUERIES["pr_sort"](spark, sf_dir).groupBy("sort_by").count().collect()}
    assert still > 100 and by == {"risk": still, "age": still, "size": still}
