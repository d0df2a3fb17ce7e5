"""Writers and keyed tables: appends, upserts, exports. Everything is a plain table of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from millrace.functions.numbers import half_up
from millrace.operators.scoring import share_rankings
from millrace.operators.text import dependencies
from millrace.plans.registry import query
from millrace.sources.documents import read_documents, write_documents
from millrace.sources.lake import Lake
from millrace.sources.oracle import NOW
from millrace.sources.scratch import shared_dir
from millrace.sources.stored import JobQueue, StoredTable


def stored(lake: Lake, rows: DataFrame, keys: list[str], buckets: int = 16) -> StoredTable:
    """An empty stored table for rows like these, in a folder of its own."""
    return StoredTable(lake.spark, f"{shared_dir(lake.spark)}/millrace/table-{uuid.uuid4().hex}", keys, rows.schema, buckets)


@query("SELECT user_id, repo, id, health FROM (SELECT *, row_number() OVER (PARTITION BY user_id, repo ORDER BY created_at DESC, id DESC) AS nth FROM scans) WHERE nth = 1", "scans")
def keyed_upsert(lake: Lake) -> DataFrame:
    """Odd scans merged onto even ones in a stored table: one row per user and repository."""
    s = lake.scans.select("user_id", "repo", "id", "health", "created_at")
    table = stored(lake, s, ["user_id", "repo"])
    for half in (0, 1):
        table.merge(s.where(F.col("id") % 2 == half), ["created_at", "id"])
    return table.read().drop("created_at")


@query(f"SELECT count(*) AS kept, (SELECT count(*) FROM scans) - count(*) AS gone FROM scans WHERE created_at >= {NOW} - INTERVAL 7 DAY", "scans")
def retention_delete(lake: Lake, days: int = 7) -> DataFrame:
    """Scans older than ``days`` deleted from a stored table: how many stay and how many went."""
    s = lake.scans.select("id", "repo", "created_at")
    table = stored(lake, s, ["id"])
    table.merge(s, ["created_at"])
    first = lake.now - F.expr(f"interval '{days}' day")
    (oldest,) = s.select(first).first()
    table.delete(F.col("created_at") < F.lit(oldest))
    kept, before = table.read().agg(F.count("*").alias("kept")), table.read(1).agg(F.count("*").alias("n"))
    return kept.crossJoin(before).select("kept", (F.col("n") - F.col("kept")).alias("gone"))  # a row each


_JOBS = "SELECT id, row_number() OVER (ORDER BY created_at, id) AS nth FROM usage WHERE units > 50"


@query(f"""WITH j AS ({_JOBS}) SELECT id, CASE WHEN nth <= 2 THEN 'running' WHEN nth = 3 THEN 'done' WHEN nth <= 5 THEN 'running' ELSE 'queued' END AS status,
CAST(CASE WHEN nth <= 2 THEN 2 WHEN nth <= 5 THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN nth <= 2 OR nth = 5 THEN 'c' WHEN nth <= 4 THEN 'b' END AS worker FROM j""", "usage")
def job_queue(lake: Lake) -> DataFrame:
    """Large requests as jobs in a stored queue: a takes two and stops, b takes two and ends one, and when a's are stale c
    takes those and one more. The queue as it is then."""
    queue = JobQueue(lake.spark, f"{shared_dir(lake.spark)}/millrace/jobs-{uuid.uuid4().hex}")
    queue.add(lake.usage.where("units > 50").select("id", "created_at"))
    queue.claim("a", "2030-01-01 00:00:00", 2)
    took = queue.claim("b", "2030-01-01 00:05:00", 2)
    queue.finish("b", took[:1])
    queue.claim("c", "2030-01-01 00:11:00", 3)
    return queue.table.read().select("id", "status", "attempts", "worker")


@query("SELECT id, user_id, feature, units FROM usage", "usage")
def append_fact(lake: Lake) -> DataFrame:
    """Two appends to a fact table, read back."""
    path = f"{shared_dir(lake.spark)}/millrace/fact-{uuid.uuid4().hex}"
    u = lake.usage.select("id", "user_id", "feature", "units")
    for half in (0, 1):
        u.where(F.col("id") % 2 == half).write.mode("append").parquet(path)
    return lake.spark.read.schema(u.schema).parquet(path)


@query(None)
def sbom_export(lake: Lake) -> DataFrame:
    """A CycloneDX component list of each repository as a line of JSON."""
    part = F.struct(F.lit("library").alias("type"), F.col("lib").alias("name"), F.col("version"))
    by = dependencies(lake).groupBy("repo").agg(F.sort_array(F.collect_list(part)).alias("components"))
    bom = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.lit(1).alias("version"), F.col("components"))
    return by.select("repo", F.to_json(bom).alias("bom"))


@query(None)
def comparison_report(lake: Lake) -> DataFrame:
    """The ranking as a line of Markdown, of CSV and of JSON each."""
    r = share_rankings(lake)
    text = F.format_string("%.2f", "points")
    return r.select(
        "repo",
        F.concat(F.lit("| "), F.col("rank"), F.lit(" | "), F.col("repo"), F.lit(" | "), text, F.lit(" |")).alias("markdown"),
        F.concat_ws(",", F.col("rank").cast("string"), "repo", text).alias("csv"),
        F.to_json(F.struct("rank", "repo", "points")).alias("json"),
    )


def reports(lake: Lake) -> DataFrame:
    """``(name, kind, body)``: each repository's place in four kinds of document."""
    c = F.col
    points = F.format_string("%.2f", half_up(c("points"), 2))
    kinds = {
        "json": F.to_json(F.struct("rank", "repo", "points")),
        "markdown": F.concat(F.lit("# "), c("repo"), F.lit("\n\n| place | points |\n|-|-|\n| "), c("rank"), F.lit(" | "), points, F.lit(" |\n")),
        "csv": F.concat(F.lit("rank,repo,points\n"), c("rank"), F.lit(","), c("repo"), F.lit(","), points, F.lit("\n")),
        "text": F.concat(c("repo"), F.lit(" is number "), c("rank"), F.lit(" with "), points, F.lit(" points.\n")),
    }
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), body.alias("body")) for kind, body in kinds.items()])
    return share_rankings(lake).select(c("repo").alias("name"), F.explode(rows).alias("d")).select("name", "d.*")


@query(None)
def report_files(lake: Lake) -> DataFrame:
    """The reports written as files, and the files read back: ``(file, body)``."""
    path = f"{shared_dir(lake.spark)}/millrace/reports-{uuid.uuid4().hex}"
    write_documents(reports(lake), path)
    return read_documents(lake.spark, path)
