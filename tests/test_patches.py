"""Files of pulls are never dealt by their patch, of which there are few."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import millrace.operators  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES
from tests.compare import same_as_sql


@pytest.mark.parametrize("name", ["diff_review", "breaking_changes", "review_verdict", "review_scores", "review_flags"])
def test_files_are_not_dealt_by_patch(spark, sf_dir, capsys, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, sf_dir).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert re.search(r"BroadcastHashJoin \[patch#", plan)
    assert not re.search(r"SortMergeJoin \[patch#", plan)


def reviews(spark, sf_dir, folder):
    for t in "region nation customer".split():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 60")
    orders.union(orders.limit(3)).write.parquet(f"{folder}/orders.parquet")
    # few parts on few pulls, so that paths, names of files and rules repeat within a pull; some lines twice, some of no pull
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey < 1200").withColumn("l_partkey", F.col("l_partkey") % 40)
    lines = lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 9 > 0, F.col("l_orderkey") % 70))
    lines.union(lines.limit(300)).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_reviews_of_repeated_files(spark, sf_dir, tmp_path):
    folder = reviews(spark, sf_dir, tmp_path)
    con = duckdb.connect()
    for t in "region nation customer orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    for name in ("review_verdict", "review_scores"):
        same_as_sql(QUERIES[name](spark, folder), con, ORACLES[name])


def test_reviews_deal_files_once(spark, sf_dir, capsys):
    QUERIES["review_verdict"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    # one read for the pulls' sums, one for their files
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 2
    assert not re.search(r"Generate explode\(kinds", plan)
    assert not re.search(r"Aggregate\(keys?=\[number#\d+L?, ", plan)
