"""Landed payloads: raw JSON with a declared schema, base64 contents, trees, and the lists that services page out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions.ordered import first_of
from millrace.plans.registry import query
from millrace.sources.lake import Lake

REPO = "repo string, owner string, stars long, forks long, language string, private boolean"


@query("SELECT repo, owner, stars, forks, language, private, FALSE AS broken FROM repos UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, TRUE", "repos")
def src_repo_meta(lake: Lake) -> DataFrame:
    """Repository objects as they are landed, one broken payload among them: it stays as a row that says so."""
    payload = lake.repos.select(F.to_json(F.struct("repo", "owner", "stars", "forks", "language", "private")).alias("raw"))
    payload = payload.union(lake.spark.createDataFrame([("{broken",)], "raw string"))
    parsed = payload.select("raw", F.from_json("raw", REPO + ", bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("r"))
    return parsed.select("r.repo", "r.owner", "r.stars", "r.forks", "r.language", "r.private", F.col("r.bad").isNotNull().alias("broken"))


def _newest(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


@query("SELECT repo, sha, author, authored_at FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY authored_at DESC, sha) AS nth FROM commits) WHERE nth <= 50", "commits")
def src_commits(lake: Lake) -> DataFrame:
    return _newest(lake.commits, "repo", [F.desc("authored_at"), "sha"], 50).select("repo", "sha", "author", "authored_at")


@query("""WITH asked AS (SELECT DISTINCT arg_max(sha, (authored_at, sha)) AS sha FROM commits GROUP BY repo)
SELECT repo, sha, author, number, authored_at FROM commits WHERE sha IN (SELECT sha FROM asked)""", "commits")
def src_commit_detail(lake: Lake, asked: DataFrame | None = None) -> DataFrame:
    """The commits of the shas ``asked(sha)``: by default the newest one of each repository."""
    if asked is None:
        asked = lake.commits.groupBy("repo").agg(F.max_by("sha", F.struct("authored_at", "sha")).alias("sha")).select("sha").distinct()
    return lake.commits.join(asked, "sha", "left_semi").select("repo", "sha", "author", "number", "authored_at")


@query("SELECT repo, lang, bytes FROM languages", "languages")
def src_languages(lake: Lake) -> DataFrame:
    """A map of language to bytes per repository, and its rows again."""
    maps = lake.languages.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("lang", "bytes"))).alias("m"))
    return maps.select("repo", F.explode("m").alias("lang", "bytes"))


@query("SELECT repo, login, contributions FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY contributions DESC, login) AS nth FROM contributors) WHERE nth <= 30", "contributors")
def src_contributors(lake: Lake) -> DataFrame:
    return _newest(lake.contributors, "repo", [F.desc("contributions"), "login"], 30).select("repo", "login", "contributions")


@query("""WITH c AS (SELECT repo, author, date_diff('day', authored_at::DATE, (SELECT max(l_shipdate) FROM lineitem)::DATE) // 7 AS ago FROM commits)
SELECT repo, author, count(*) AS total, count(*) FILTER (ago < 4) AS recent, CAST(count(DISTINCT ago) FILTER (ago < 52) AS BIGINT) AS weeks FROM c GROUP BY ALL""", "commits")
def src_contributor_stats(lake: Lake) -> DataFrame:
    """Totals and active weeks of each contributor."""
    ago = F.floor(F.datediff(lake.commit_now, "authored_at") / 7)
    c = lake.commits.select("repo", "author", ago.alias("ago"))
    return c.groupBy("repo", "author").agg(F.count("*").alias("total"), F.count_if(F.col("ago") < 4).alias("recent"), F.count_distinct(F.when(F.col("ago") < 52, F.col("ago"))).alias("weeks"))


@query("SELECT repo, number, title, state FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY coalesce(closed_at, created_at) DESC, number) AS nth FROM pulls) WHERE nth <= 30", "pulls")
def src_pulls(lake: Lake) -> DataFrame:
    return _newest(lake.pulls, "repo", [F.coalesce("closed_at", "created_at").desc(), "number"], 30).select("repo", "number", "title", "state")


@query("SELECT repo, number, coalesce(nullif(label, ''), 'none') AS label, author FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, number) AS nth FROM pulls WHERE state = 'open') WHERE nth <= 30", "pulls")
def src_open_prs(lake: Lake) -> DataFrame:
    some = _newest(lake.pulls.where("state = 'open'"), "repo", [F.desc("created_at"), "number"], 30)
    return some.select("repo", "number", F.coalesce(F.nullif("label", F.lit("")), F.lit("none")).alias("label"), "author")


@query("SELECT path, length(content) AS n, sha256(content) AS digest FROM files", "files")
def src_contents(lake: Lake) -> DataFrame:
    """Contents come wrapped in base64 and are unwrapped here."""
    wrapped = lake.files.select("path", F.base64(F.encode("content", "UTF-8")).alias("b"))
    text = F.decode(F.unbase64("b"), "UTF-8")
    return wrapped.select("path", text.alias("t")).select("path", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


@query("""WITH t AS (SELECT repo, path, size, row_number() OVER (PARTITION BY repo ORDER BY path) AS nth, count(*) OVER (PARTITION BY repo) AS n FROM files WHERE NOT regexp_matches(path, '[.](de|fr)$'))
SELECT repo, path, size, n > 5000 AS truncated FROM t WHERE nth <= 5000""", "files")
def src_tree(lake: Lake, cap: int = 5000) -> DataFrame:
    """The first paths of each repository's tree, and whether there are more."""
    t = lake.files.where(~F.col("path").rlike("[.](de|fr)$")).select("repo", "path", "size")
    more = t.groupBy("repo").agg((F.count("*") > cap).alias("truncated"))
    return first_of(t, "repo", ["path"], cap).join(more, "repo").select("repo", "path", "size", "truncated")


@query("SELECT repo, week, total, strftime((SELECT max(l_shipdate) FROM lineitem) - to_days(CAST((52 - week) * 7 AS INT)), '%Y-%m-%d') AS week_of FROM weeks", "weeks")
def src_commit_activity(lake: Lake) -> DataFrame:
    """Weeks by number get dates back from the reference time."""
    day = F.date_sub(F.to_date(lake.commit_now), (52 - F.col("week")) * 7)
    return lake.weeks.select("repo", "week", "total", F.date_format(day, "yyyy-MM-dd").alias("week_of"))


@query("SELECT repo, id, name, conclusion FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id) AS nth FROM runs) WHERE nth <= 50", "runs")
def src_ci_runs(lake: Lake) -> DataFrame:
    return _newest(lake.runs, "repo", [F.desc("started_at"), "id"], 50).select("repo", "id", "name", "conclusion")


@query("""WITH p AS (SELECT repo, count(*) AS pulls, count(merged_at) AS merged, count(*) FILTER (label LIKE '2-%') AS bugs FROM pulls GROUP BY repo), c AS (SELECT repo, count(*) AS commits, max(authored_at) AS last_commit FROM commits GROUP BY repo),
d AS (SELECT 'repo' || (id % 10 + 5) AS target, count(*) AS deployments FROM user_events WHERE type = 'PullRequest' GROUP BY 1), r AS (SELECT repo AS target, count(*) AS runs, count(*) FILTER (event = 'push' AND conclusion = 'success' AND branch = 'main') AS released FROM runs GROUP BY repo)
SELECT n.repo, coalesce(pulls, 0) AS pulls, coalesce(merged, 0) AS merged, coalesce(bugs, 0) AS bugs, coalesce(commits, 0) AS commits, last_commit, coalesce(deployments, 0) AS deployments, coalesce(runs, 0) AS runs, coalesce(released, 0) AS released, stars
FROM nations n LEFT JOIN p USING (repo) LEFT JOIN c USING (repo) LEFT JOIN d ON d.target = 'repo' || nation LEFT JOIN r ON r.target = 'repo' || nation LEFT JOIN repos m ON m.repo = n.repo""", "pulls", "commits", "user_events", "runs", "nations", "repos")
def src_dora_inputs(lake: Lake) -> DataFrame:
    """What the delivery metrics of a repository are made of: pulls, bugs, commits, deployments, runs and its record."""
    c, n = F.col, F.count("*")
    p = lake.pulls.groupBy("repo").agg(n.alias("pulls"), F.count("merged_at").alias("merged"), F.count_if(c("label").like("2-%")).alias("bugs"))
    k = lake.commits.groupBy("repo").agg(n.alias("commits"), F.max("authored_at").alias("last_commit"))
    d = lake.user_events.where(c("type") == "PullRequest").groupBy(F.concat(F.lit("repo"), c("id") % 10 + 5).alias("target")).agg(n.alias("deployments"))
    released = (c("event") == "push") & (c("conclusion") == "success") & (c("branch") == "main")
    r = lake.runs.groupBy(c("repo").alias("target")).agg(n.alias("runs"), F.count_if(released).alias("released"))
    x = lake.nations.withColumn("target", F.concat(F.lit("repo"), c("nation"))).join(p, "repo", "left").join(k, "repo", "left")
    x = x.join(d, "target", "left").join(r, "target", "left").join(lake.repos.select("repo", "stars"), "repo", "left")
    counts = ["pulls", "merged", "bugs", "commits", "deployments", "runs", "released"]
    return x.fillna(0, counts).select("repo", *counts, "last_commit", "stars")


@query("SELECT repo, owner, stars, pushed_at FROM repos WHERE contains(repo, 'a') OR contains(coalesce(license, ''), 'm') ORDER BY stars DESC, repo LIMIT 100", "repos")
def src_search(lake: Lake, text: str = "@a") -> DataFrame:
    text = text.lstrip("@").lower()
    hit = F.contains("repo", F.lit(text)) | F.contains(F.coalesce("license", F.lit("")), F.lit("m"))
    return lake.repos.where(hit).orderBy(F.desc("stars"), "repo").limit(100).select("repo", "owner", "stars", "pushed_at")


@query("SELECT repo, owner FROM repos ORDER BY pushed_at DESC, repo LIMIT 500", "repos")
def src_my_repos(lake: Lake) -> DataFrame:
    return lake.repos.orderBy(F.desc("pushed_at"), "repo").limit(500).select("repo", "owner")


@query("""WITH r AS (SELECT owner, count(*) AS repos, CAST(sum(stars) AS BIGINT) AS stars FROM repos GROUP BY owner), p AS (SELECT split_part(repo, '/', 1) AS owner, count(*) AS pulls FROM pulls GROUP BY 1)
SELECT owner, repos, stars, coalesce(pulls, 0) AS pulls FROM r LEFT JOIN p USING (owner)""", "repos", "pulls")
def src_user_profile(lake: Lake) -> DataFrame:
    r = lake.repos.groupBy("owner").agg(F.count("*").alias("repos"), F.sum("stars").alias("stars"))
    p = lake.orders.groupBy("owner").agg(F.count("*").alias("pulls"))
    return r.join(p, "owner", "left").select("owner", "repos", "stars", F.coalesce("pulls", F.lit(0)).alias("pulls"))


@query("SELECT id, user_id, type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS nth FROM user_events) WHERE nth <= 100", "user_events")
def src_user_events(lake: Lake) -> DataFrame:
    return _newest(lake.user_events, "user_id", [F.desc("created_at"), F.desc("id")], 100).select("id", "user_id", "type")


@query("SELECT id, user_id, repo, type = 'Issues' AS unread FROM user_events WHERE type IN ('Issues', 'PullRequest')", "user_events")
def src_notifications(lake: Lake) -> DataFrame:
    some = lake.user_events.where(F.col("type").isin("Issues", "PullRequest"))
    return some.select("id", "user_id", "repo", (F.col("type") == "Issues").alias("unread"))


@query("SELECT repo, number, created_at FROM pulls WHERE NOT draft", "pulls")
def src_releases(lake: Lake) -> DataFrame:
    return lake.pulls.where(~F.col("draft")).select("repo", "number", "created_at")


@query("SELECT repo, unnest([lower(language), owner]) AS topic FROM repos", "repos")
def src_topics(lake: Lake) -> DataFrame:
    return lake.repos.select("repo", F.explode(F.array(F.lower("language"), F.col("owner"))).alias("topic"))


@query("SELECT DISTINCT owner FROM nations", "nations")
def src_orgs(lake: Lake) -> DataFrame:
    return lake.nations.select("owner").distinct()


@query("""WITH w AS (SELECT repo, week, CASE WHEN total = 0 THEN 0 ELSE least(100.0, total * 7 % 101) END AS pct FROM weeks WHERE week >= 42)
SELECT repo, round(avg(pct), 4) AS mean, round((arg_max(pct, week) - arg_min(pct, week))::DOUBLE, 4) AS trend FROM w GROUP BY repo""", "weeks")
def src_codecov(lake: Lake) -> DataFrame:
    """Coverage over the last ten points, its mean and trend."""
    w = lake.weeks.where("week >= 42").withColumn("pct", F.when(F.col("total") == 0, 0.0).otherwise(F.least(F.lit(100.0), (F.col("total") * 7 % 101).cast("double"))))
    return w.groupBy("repo").agg(F.round(F.avg("pct"), 4).alias("mean"), F.round(F.max_by("pct", "week") - F.min_by("pct", "week"), 4).alias("trend"))
