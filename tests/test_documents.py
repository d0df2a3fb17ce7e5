"""Exports as files: all of a commit or none of it."""

import json
import os

import pytest
from pyspark.sql import functions as F

import millrace.sources.sinks  # noqa: F401
from millrace.plans.registry import QUERIES
from millrace.sources.documents import file_name, read_documents, write_documents


def held(spark, path):
    return {r["file"]: r["body"] for r in read_documents(spark, path).collect()}


def test_files_hold_what_was_written(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(f"asia/r {i}", kind, f"body {i} é\nline") for i in range(30) for kind in ("json", "markdown", "csv", "text")] + [(None, None, None), ("../up", "csv", "x")]
    df = spark.createDataFrame(rows, "name string, kind string, body string").repartition(5)
    write_documents(df.withColumn("extra", F.lit(1)), path)
    assert held(spark, path) == {file_name(n, k): b for n, k, b in rows if b}
    write_documents(df.where("kind = 'csv'").withColumn("name", F.concat("name", F.lit("!"))), path)
    assert len(held(spark, path)) == len(rows) + 30 and not os.listdir(f"{tmp_path}/out/_pending")
    write_documents(df.where("1 = 0"), path)
    assert len(held(spark, path)) == len(rows) + 30


def test_a_failed_write_shows_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    good = spark.range(20).select(F.concat(F.lit("r"), "id").alias("name"), F.lit("csv").alias("kind"), F.raise_error(F.lit("lost")).alias("body"))
    some = spark.range(100).select(F.concat(F.lit("s"), "id").alias("name"), F.lit("csv").alias("kind"), F.lit("x").alias("body"))
    with pytest.raises(Exception, match="lost"):
        write_documents(some.union(good.select("name", "kind", F.col("body").cast("string"))), path)
    os.makedirs(f"{tmp_path}/out", exist_ok=True)
    assert held(spark, path) == {}


def test_reports(spark, sf_dir):
    files = {r["file"]: r["body"] for r in QUERIES["report_files"](spark, sf_dir).collect()}
    ranks = {r["repo"]: r for r in QUERIES["share_rankings"](spark, sf_dir).collect()}
    assert len(files) == 4 * len(ranks)
    for repo, r in ranks.items():
        one = json.loads(files[file_name(repo, "json")])
        assert one == {"rank": r["rank"], "repo": repo, "points": r["points"]}
        assert files[file_name(repo, "csv")].splitlines()[1].startswith(f"{r['rank']},{repo},")
