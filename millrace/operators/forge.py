"""Repositories, pull requests, commits and contributors: filters, joins, rankings and aggregates over order facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions.numbers import half_up, hours, r4, ratio
from millrace.functions.rules import as_re2
from millrace.plans.registry import query
from millrace.sources.lake import Lake
from millrace.sources.oracle import COMMIT_NOW

_H = "(epoch_us({b}) - epoch_us({a})) / 3.6e9"
MERGE_H = _H.format(a="created_at", b="merged_at")
CLOSE_H = _H.format(a="created_at", b="closed_at")


# filters and lists


@query("SELECT repo, owner, stars, language FROM repos WHERE (contains(lower(repo), 'a') OR contains(lower(coalesce(language, '')), 'auto')) AND NOT archived AND NOT private AND nation % 10 <> 7", "repos")
def repo_list_filter(lake: Lake, text: str = "a", language: str = "auto") -> DataFrame:
    """Text, type and a hidden set, the last as an anti join."""
    hidden = lake.nations.where("nation % 10 = 7").select("repo")
    hit = F.contains(F.lower("repo"), F.lit(text)) | F.contains(F.lower(F.coalesce("language", F.lit(""))), F.lit(language))
    return lake.repos.where(hit & ~F.col("archived") & ~F.col("private")).join(hidden, "repo", "left_anti").select("repo", "owner", "stars", "language")


@query("SELECT repo, owner = 'europe' AS owned, contributors > 3 AS contributor, CASE WHEN owner = 'europe' THEN 'owner' WHEN contributors > 3 THEN 'write' WHEN private THEN 'none' ELSE 'read' END AS access FROM repos", "repos")
def repo_access_level(lake: Lake, user: str = "europe") -> DataFrame:
    owned, helps = F.col("owner") == user, F.col("contributors") > 3
    access = F.when(owned, "owner").when(helps, "write").when(F.col("private"), "none").otherwise("read")
    return lake.repos.select("repo", owned.alias("owned"), helps.alias("contributor"), access.alias("access"))


@query(f"SELECT repo, stars, pushed_at FROM repos WHERE pushed_at > {COMMIT_NOW} - INTERVAL 3650 DAY AND stars > 50 ORDER BY stars DESC, repo LIMIT 30", "repos")
def trending_query(lake: Lake, days: int = 3650, stars: int = 50) -> DataFrame:
    recent = F.col("pushed_at") > lake.commit_now - F.expr(f"interval '{days}' day")
    return lake.repos.where(recent & (F.col("stars") > stars)).orderBy(F.desc("stars"), "repo").limit(30).select("repo", "stars", "pushed_at")


@query("SELECT repo, stars, forks, owner FROM repos WHERE contains(owner, 'a') ORDER BY forks DESC, repo", "repos")
def trending_sort(lake: Lake) -> DataFrame:
    return lake.repos.where(F.contains("owner", F.lit("a"))).select("repo", "stars", "forks", "owner").orderBy(F.desc("forks"), "repo")


@query("SELECT repo, stars, forks, open_issues, pushed_at FROM repos ORDER BY stars DESC, repo", "repos")
def repo_sort(lake: Lake, by: str = "stars") -> DataFrame:
    return lake.repos.select("repo", "stars", "forks", "open_issues", "pushed_at").orderBy(F.desc(by), "repo")


@query("SELECT repo, owner = 'asia' AS owned, pushed_at FROM repos ORDER BY owned DESC, pushed_at DESC, repo LIMIT 10", "repos")
def my_repos_sort(lake: Lake, user: str = "asia") -> DataFrame:
    rows = lake.repos.select("repo", (F.col("owner") == user).alias("owned"), "pushed_at")
    return rows.orderBy(F.desc("owned"), F.desc("pushed_at"), "repo").limit(10)


@query("SELECT repo, stars FROM repos WHERE NOT fork ORDER BY stars DESC, repo LIMIT 12", "repos")
def profile_repo_sort(lake: Lake) -> DataFrame:
    return lake.repos.where(~F.col("fork")).orderBy(F.desc("stars"), "repo").limit(12).select("repo", "stars")


@query("SELECT owner, repo FROM repos WHERE contains(owner, 'am') OR contains(repo, 'an')", "repos")
def org_search(lake: Lake) -> DataFrame:
    return lake.repos.where(F.col("owner").ilike("%am%") | F.col("repo").ilike("%an%")).select("owner", "repo")


@query("SELECT owner, count(*) AS repos, CAST(sum(stars) AS BIGINT) AS stars, CAST(floor(avg(forks) + 0.5) AS BIGINT) AS mean_forks, arg_max(repo, (stars, repo)) AS top_repo FROM repos GROUP BY owner", "repos")
def org_stats(lake: Lake) -> DataFrame:
    return lake.repos.groupBy("owner").agg(
        F.count("*").alias("repos"), F.sum("stars").alias("stars"), half_up(F.avg("forks")).alias("mean_forks"), F.max_by("repo", F.struct("stars", "repo")).alias("top_repo")
    )


@query("SELECT owner, count(*) AS repos FROM repos GROUP BY owner ORDER BY repos DESC, owner", "repos")
def org_sort(lake: Lake) -> DataFrame:
    return lake.repos.groupBy("owner").agg(F.count("*").alias("repos")).orderBy(F.desc("repos"), "owner")


@query("SELECT n.repo, n.owner, f.n AS forks, p.n AS pulls FROM nations n LEFT JOIN (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) f USING (nation) LEFT JOIN (SELECT repo, count(*) AS n FROM pulls GROUP BY 1) p USING (repo)", "pulls", "nations")
def admin_counts_include(lake: Lake) -> DataFrame:
    """Parents with child counts; children are counted before the join."""
    forks = lake.table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("forks"))
    pulls = lake.orders.groupBy("repo").agg(F.count("*").alias("pulls"))
    return lake.nations.join(forks, "nation", "left").join(pulls, "repo", "left").select("repo", "owner", "forks", "pulls")


# pull requests


@query(f"""SELECT repo, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'closed' AND merged_at IS NULL) AS closed, count(merged_at) AS merged,
round(count(merged_at) / count(*) * 100, 4) AS merge_rate, round(avg({MERGE_H}), 4) AS merge_h FROM pulls GROUP BY repo""", "pulls")
def compare_pr_rollup(lake: Lake) -> DataFrame:
    merge = hours(F.col("created_at"), F.col("merged_at"))
    return lake.pulls.groupBy("repo").agg(
        F.count_if(F.col("state") == "open").alias("open"),
        F.count_if((F.col("state") == "closed") & F.col("merged_at").isNull()).alias("closed"),
        F.count("merged_at").alias("merged"),
        r4(ratio(F.count("merged_at"), F.count("*")) * 100).alias("merge_rate"),
        r4(F.avg(merge)).alias("merge_h"),
    )


@query("SELECT repo, round(CASE WHEN open_issues + closed_issues = 0 THEN 0 ELSE closed_issues / (open_issues + closed_issues) * 100 END, 4) AS rate FROM repos", "repos")
def issue_resolution_rate(lake: Lake) -> DataFrame:
    return lake.repos.select("repo", r4(ratio(F.col("closed_issues") * 100, F.col("open_issues") + F.col("closed_issues"), 0)).alias("rate"))


@query(f"""WITH p AS (SELECT repo, author, CASE WHEN merged_at IS NULL THEN state WHEN {MERGE_H} < 1 THEN 'merged <1h' WHEN {MERGE_H} <= 24 THEN 'merged <=24h' WHEN {MERGE_H} <= 168 THEN 'merged <=7d' ELSE 'merged >7d' END AS bucket FROM pulls)
SELECT repo, bucket, count(*) AS n, count(DISTINCT author) AS authors FROM p GROUP BY ALL""", "pulls")
def pr_status_mix(lake: Lake) -> DataFrame:
    h = hours(F.col("created_at"), F.col("merged_at"))
    bucket = F.when(F.col("merged_at").isNull(), F.col("state")).when(h < 1, "merged <1h").when(h <= 24, "merged <=24h").when(h <= 168, "merged <=7d").otherwise("merged >7d")
    return lake.pulls.groupBy("repo", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"))


@query(f"""WITH h AS (SELECT repo, {MERGE_H} AS h FROM pulls WHERE merged_at IS NOT NULL), o AS (SELECT repo, h, row_number() OVER (PARTITION BY repo ORDER BY h) AS nth, count(*) OVER (PARTITION BY repo) AS n FROM h),
a AS (SELECT repo, count(*) AS n, avg(h) AS mean, max(h) FILTER (nth = n // 2 + 1) AS median FROM o GROUP BY repo)
SELECT repo, n, round(mean, 4) AS mean_h, round(median, 4) AS median_h, CASE WHEN median <= 24 THEN 'fast' WHEN median <= 72 THEN 'good' WHEN median <= 168 THEN 'slow' ELSE 'very slow' END AS rating FROM a""", "pulls")
def pr_cycle_time(lake: Lake) -> DataFrame:
    """Mean and upper median hours to merge. The median is read off the counts of the distinct times, which are few beside
    the pulls, so no task holds a repository's pulls."""
    h = lake.pulls.where("merged_at is not null").select("repo", hours(F.col("created_at"), F.col("merged_at")).alias("h"))
    times, by = h.groupBy("repo", "h").agg(F.count("*").alias("k")), Window.partitionBy("repo")
    o = times.withColumn("upto", F.sum("k").over(by.orderBy("h"))).withColumn("n", F.sum("k").over(by))
    a = o.groupBy("repo").agg(F.max("n").alias("n"), (F.sum(F.col("h") * F.col("k")) / F.max("n")).alias("mean"), F.min(F.when(F.expr("upto >= n div 2 + 1"), F.col("h"))).alias("median"))
    m = F.col("median")
    rating = F.when(m <= 24, "fast").when(m <= 72, "good").when(m <= 168, "slow").otherwise("very slow")
    return a.select("repo", "n", r4(F.col("mean")).alias("mean_h"), r4(m).alias("median_h"), rating.alias("rating"))


@query(f"SELECT repo, round(avg({CLOSE_H}), 4) AS close_h FROM pulls WHERE closed_at IS NOT NULL GROUP BY repo", "pulls")
def pr_cycle_closed(lake: Lake) -> DataFrame:
    return lake.pulls.where("closed_at is not null").groupBy("repo").agg(r4(F.avg(hours(F.col("created_at"), F.col("closed_at")))).alias("close_h"))


@query("""WITH a AS (SELECT repo, author, count(*) AS n, max(authored_at) AS last_at FROM commits GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, author) AS nth FROM a) WHERE nth <= 15)
SELECT repo, author, n, last_at, round(n / sum(n) OVER (PARTITION BY repo) * 100, 4) AS share FROM t""", "commits")
def work_share(lake: Lake) -> DataFrame:
    """The first fifteen authors and their share of what those fifteen did."""
    a = lake.commits.groupBy("repo", "author").agg(F.count("*").alias("n"), F.max("authored_at").alias("last_at"))
    top = a.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "author"))).where("nth <= 15")
    return top.select("repo", "author", "n", "last_at", r4(F.col("n") / F.sum("n").over(Window.partitionBy("repo")) * 100).alias("share"))


@query("""WITH a AS (SELECT author, count(*) AS commits FROM commits GROUP BY author), p AS (SELECT 'Supplier#' || right(author, 9) AS author, count(*) AS pulls FROM pulls GROUP BY 1)
SELECT a.author, commits, coalesce(pulls, 0) AS pulls FROM a LEFT JOIN p USING (author)""", "commits", "pulls")
def work_distribution(lake: Lake) -> DataFrame:
    commits = lake.commits.groupBy("author").agg(F.count("*").alias("commits"))
    pulls = lake.orders.groupBy(F.concat(F.lit("Supplier#"), F.right("c_name", F.lit(9))).alias("author")).agg(F.count("*").alias("pulls"))
    return commits.join(pulls, "author", "left").select("author", "commits", F.coalesce("pulls", F.lit(0)).alias("pulls"))


@query("SELECT repo, s_name AS reviewer, count(DISTINCT o_orderkey) AS pulls FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'O' GROUP BY ALL", "ord")
def reviewer_load(lake: Lake) -> DataFrame:
    """Open pulls per reviewer."""
    still = lake.orders.where("o_orderstatus = 'O'").select("o_orderkey", "repo")
    asked = lake.table("lineitem").select("l_orderkey", "l_suppkey").join(still, F.col("l_orderkey") == F.col("o_orderkey")).select("repo", "o_orderkey", "l_suppkey").distinct()
    load = asked.groupBy("repo", "l_suppkey").agg(F.count("*").alias("pulls"))
    names = lake.table("supplier").select("s_suppkey", F.col("s_name").alias("reviewer"))
    return load.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("repo", "reviewer", "pulls")


_SIZE = "CASE WHEN additions + deletions <= 10 THEN 'XS' WHEN additions + deletions <= 50 THEN 'S' WHEN additions + deletions <= 250 THEN 'M' WHEN additions + deletions <= 1000 THEN 'L' ELSE 'XL' END"


@query(f"SELECT repo, {_SIZE} AS size, count(*) AS n FROM pulls GROUP BY ALL", "pulls")
def pr_size_buckets(lake: Lake) -> DataFrame:
    churn = F.col("additions") + F.col("deletions")
    size = F.when(churn <= 10, "XS").when(churn <= 50, "S").when(churn <= 250, "M").when(churn <= 1000, "L").otherwise("XL")
    return lake.pulls.groupBy("repo", size.alias("size")).agg(F.count("*").alias("n"))


@query(f"""SELECT repo, count(*) AS pulls, count(*) FILTER (date_diff('day', created_at::DATE, {COMMIT_NOW}::DATE) > 7) AS stale, count(*) FILTER (n_reviewers = 0) AS unreviewed,
count(*) FILTER (label LIKE '1-%') AS urgent, round(avg(additions + deletions), 4) AS churn FROM pulls WHERE state = 'open' GROUP BY repo""", "pulls")
def pr_summary(lake: Lake) -> DataFrame:
    return lake.pulls.where("state = 'open'").groupBy("repo").agg(
        F.count("*").alias("pulls"),
        F.count_if(F.datediff(lake.commit_now, "created_at") > 7).alias("stale"),
        F.count_if(F.col("n_reviewers") == 0).alias("unreviewed"),
        F.count_if(F.col("label").like("1-%")).alias("urgent"),
        r4(F.avg(F.col("additions") + F.col("deletions"))).alias("churn"),
    )


@query("SELECT p.repo, p.number, min(authored_at) AS first_commit, count(sha) AS commits FROM pulls p LEFT JOIN commits c ON p.number = c.number AND authored_at <= merged_at WHERE merged_at IS NOT NULL GROUP BY ALL", "pulls", "commits")
def dora_first_commit(lake: Lake) -> DataFrame:
    """The first commit of each merged pull, of those up to its merge."""
    merged = lake.pulls.where("merged_at is not null").select("repo", "number", "merged_at")
    commits = lake.commits.select(F.col("number").alias("of"), "sha", "authored_at")
    met = merged.join(commits, (F.col("number") == F.col("of")) & (F.col("authored_at") <= F.col("merged_at")), "left")
    return met.groupBy("repo", "number").agg(F.min("authored_at").alias("first_commit"), F.count("sha").alias("commits"))


@query("""SELECT p.repo, number, n_reviewers, r.stars, c.contributions FROM pulls p JOIN repos r USING (repo) JOIN contributors c ON c.repo = p.repo AND c.login = p.author WHERE state = 'open'""", "pulls", "repos", "contributors")
def pr_enrich(lake: Lake) -> DataFrame:
    """Open pulls with their repository and their author's standing in it."""
    still = lake.pulls.where("state = 'open'").select("repo", "number", "author", "n_reviewers")
    known = lake.contributors.withColumnRenamed("login", "author")
    return still.join(known, ["repo", "author"]).join(lake.repos.select("repo", "stars"), "repo").select("repo", "number", "n_reviewers", "stars", "contributions")


_TYPES = {"feat": "Features", "fix": "Bug Fixes", "docs": "Documentation", "chore": "Chores", "refactor": "Refactoring", "test": "Tests", "perf": "Performance", "ci": "CI", "build": "Build", "style": "Style", "revert": "Reverts"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())


@query(f"""WITH p AS (SELECT repo, author, number, regexp_extract(title, '^([a-z]+)(\\([^)]*\\))?(!?):', 1) AS kind, regexp_extract(title, '^([a-z]+)(\\([^)]*\\))?(!?):', 3) AS bang FROM pulls WHERE merged_at IS NOT NULL)
SELECT repo, coalesce(CASE kind {_CASES} END, 'Other Changes') AS section, count(*) AS n, count(DISTINCT author) AS authors, count(*) FILTER (bang = '!') AS breaking FROM p GROUP BY ALL""", "pulls")
def changelog_groups(lake: Lake) -> DataFrame:
    """Merged pulls by conventional prefix."""
    pattern = r"^([a-z]+)(\([^)]*\))?(!?):"
    names = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    p = lake.pulls.where("merged_at is not null").withColumn("kind", F.regexp_extract("title", pattern, 1)).withColumn("bang", F.regexp_extract("title", pattern, 3))
    section = F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("Other Changes"))
    return p.groupBy("repo", section.alias("section")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"), F.count_if(F.col("bang") == "!").alias("breaking"))


# commits and contributors


@query("SELECT repo, CAST(sum(total) AS BIGINT) AS commits FROM weeks WHERE week >= 48 GROUP BY repo", "weeks")
def monthly_commits(lake: Lake) -> DataFrame:
    return lake.weeks.where("week >= 48").groupBy("repo").agg(F.sum("total").alias("commits"))


@query("""WITH b AS (SELECT repo, avg(total) FILTER (week >= 48) AS now, avg(total) FILTER (week BETWEEN 44 AND 47) AS before, sum(total) AS total FROM weeks GROUP BY repo)
SELECT repo, round(now, 4) AS now, round(before, 4) AS before, round(CASE WHEN before = 0 THEN NULL ELSE (now - before) / before * 100 END, 4) AS change,
CASE WHEN now > before * 1.1 THEN 'up' WHEN now < before * 0.9 THEN 'down' ELSE 'stable' END AS trend, round(total / 52, 4) AS weekly FROM b""", "weeks")
def velocity_change(lake: Lake) -> DataFrame:
    """Means of the last four weeks and the four before, their change and trend."""
    w = F.col("week")
    b = lake.weeks.groupBy("repo").agg(F.avg(F.when(w >= 48, F.col("total"))).alias("now"), F.avg(F.when(w.between(44, 47), F.col("total"))).alias("before"), F.sum("total").alias("total"))
    now, before = F.col("now"), F.col("before")
    trend = F.when(now > before * 1.1, "up").when(now < before * 0.9, "down").otherwise("stable")
    return b.select("repo", r4(now).alias("now"), r4(before).alias("before"), r4(ratio(now - before, before) * 100).alias("change"), trend.alias("trend"), r4(F.col("total") / 52).alias("weekly"))


@query("SELECT repo, login, contributions, round(contributions / max(contributions) OVER (PARTITION BY repo) * 100, 4) AS impact FROM contributors", "contributors")
def impact_score(lake: Lake) -> DataFrame:
    most = F.max("contributions").over(Window.partitionBy("repo"))
    return lake.contributors.select("repo", "login", "contributions", r4(F.col("contributions") / most * 100).alias("impact"))


@query("""WITH a AS (SELECT repo, author, count(*) AS n FROM commits GROUP BY ALL), p AS (SELECT *, CAST(floor(n / sum(n) OVER (PARTITION BY repo) * 100 + 0.5) AS BIGINT) AS pct FROM a),
c AS (SELECT *, row_number() OVER w AS k, sum(pct) OVER (PARTITION BY repo ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS upto FROM p WINDOW w AS (PARTITION BY repo ORDER BY n DESC, author))
SELECT repo, count(*) AS authors, CAST(coalesce(min(k) FILTER (upto >= 80), count(*)) AS BIGINT) AS bus_factor, CAST(max(pct) AS BIGINT) AS top_pct FROM c GROUP BY repo""", "commits")
def ownership_bus_factor(lake: Lake) -> DataFrame:
    """How few authors hold four fifths of the commits, by rounded shares."""
    a = lake.commits.groupBy("repo", "author").agg(F.count("*").alias("n"))
    p = a.withColumn("pct", half_up(F.col("n") / F.sum("n").over(Window.partitionBy("repo")) * 100))
    by = Window.partitionBy("repo").orderBy(F.desc("n"), "author")
    c = p.withColumn("k", F.row_number().over(by).cast("long")).withColumn("upto", F.sum("pct").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("repo").agg(F.count("*").alias("authors"), F.coalesce(F.min(F.when(F.col("upto") >= 80, F.col("k"))), F.count("*")).alias("bus_factor"), F.max("pct").alias("top_pct"))


@query("SELECT repo, greatest(1, count(DISTINCT author)) AS bus_factor FROM commits GROUP BY repo", "commits")
def dora_bus_factor(lake: Lake) -> DataFrame:
    return lake.commits.groupBy("repo").agg(F.greatest(F.lit(1), F.count_distinct("author")).alias("bus_factor"))


@query(f"""WITH a AS (SELECT author, count(*) AS n FROM commits WHERE authored_at >= {COMMIT_NOW} - INTERVAL 365 DAY GROUP BY author)
SELECT author, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM a ORDER BY n DESC, author LIMIT 5""", "commits")
def commit_analytics(lake: Lake, days: int = 365) -> DataFrame:
    a = lake.commits.where(F.col("authored_at") >= lake.commit_now - F.expr(f"interval '{days}' day")).groupBy("author").agg(F.count("*").alias("n"))
    return a.orderBy(F.desc("n"), "author").limit(5).select("author", "n", a.select(F.sum("n")).scalar().alias("total"))


@query("""WITH d AS (SELECT repo, CAST(dayofweek(authored_at) AS INT) AS day, count(*) AS n FROM commits GROUP BY ALL)
SELECT repo, arg_max(day, (n, -day)) AS peak_day, CAST(max(n) AS BIGINT) AS n FROM d GROUP BY repo""", "commits")
def weekday_peak(lake: Lake) -> DataFrame:
    """The busiest day, 0 is Sunday, the first of equals."""
    d = lake.commits.groupBy("repo", (F.dayofweek("authored_at") - 1).alias("day")).agg(F.count("*").alias("n"))
    return d.groupBy("repo").agg(F.max_by("day", F.struct(F.col("n"), -F.col("day"))).alias("peak_day"), F.max("n").alias("n"))


@query("SELECT login, CAST(sum(contributions) AS BIGINT) AS total, count(DISTINCT repo) AS repos FROM contributors GROUP BY login ORDER BY total DESC, login LIMIT 20", "contributors")
def leaderboard(lake: Lake) -> DataFrame:
    return lake.contributors.groupBy("login").agg(F.sum("contributions").alias("total"), F.count_distinct("repo").alias("repos")).orderBy(F.desc("total"), "login").limit(20)


@query("""WITH top AS (SELECT repo, login, contributions FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY contributions DESC, login) AS nth FROM contributors) WHERE nth <= 3)
SELECT repo, login, contributions, TRUE AS detailed FROM top UNION ALL SELECT repo, login, contributions, FALSE FROM contributors c WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.repo = c.repo AND t.login = c.login)""", "contributors")
def contributor_fill(lake: Lake) -> DataFrame:
    """Contributors with details, and all others from the plain list."""
    by = Window.partitionBy("repo").orderBy(F.desc("contributions"), "login")
    top = lake.contributors.withColumn("nth", F.row_number().over(by)).where("nth <= 3").drop("nth")
    rest = lake.contributors.join(top.select("repo", "login"), ["repo", "login"], "left_anti")
    return top.withColumn("detailed", F.lit(True)).unionByName(rest.withColumn("detailed", F.lit(False)))


@query("""SELECT repo, sha FROM commits c WHERE authored_at::DATE >= DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM commits d WHERE d.sha = c.sha AND d.number % 2 = 0)""", "commits")
def commit_page_dedup(lake: Lake) -> DataFrame:
    """A page of commits less those seen."""
    page = lake.commits.where("authored_at >= timestamp_ntz '2000-01-01'")
    seen = lake.commits.where("number % 2 = 0").select("sha").distinct()
    return page.join(seen, "sha", "left_anti").select("repo", "sha")


# languages, topics, files


@query("""WITH t AS (SELECT lang, CAST(sum(bytes) AS BIGINT) AS bytes FROM languages GROUP BY lang), p AS (SELECT *, bytes / sum(bytes) OVER () * 100 AS pct FROM t)
SELECT CASE WHEN pct < 2 THEN 'Other' ELSE lang END AS lang, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(pct), 4) AS pct FROM p GROUP BY 1""", "languages")
def language_rank(lake: Lake) -> DataFrame:
    t = lake.languages.groupBy("lang").agg(F.sum("bytes").alias("bytes"))
    p = t.withColumn("pct", F.col("bytes") / t.select(F.sum("bytes")).scalar() * 100)
    return p.groupBy(F.when(F.col("pct") < 2, "Other").otherwise(F.col("lang")).alias("lang")).agg(F.sum("bytes").alias("bytes"), r4(F.sum("pct")).alias("pct"))


@query("""SELECT repo, lang, bytes, round(pct, 4) AS pct FROM (SELECT *, bytes / sum(bytes) OVER (PARTITION BY repo) * 100 AS pct, row_number() OVER (PARTITION BY repo ORDER BY bytes DESC, lang) AS nth FROM languages) WHERE nth <= 2""", "languages")
def top_languages(lake: Lake, top: int = 2) -> DataFrame:
    by = Window.partitionBy("repo")
    p = lake.languages.withColumn("pct", r4(F.col("bytes") / F.sum("bytes").over(by) * 100)).withColumn("nth", F.row_number().over(by.orderBy(F.desc("bytes"), "lang")))
    return p.where(F.col("nth") <= top).select("repo", "lang", "bytes", "pct")


@query("SELECT repo, count(*) AS langs, CAST(sum(bytes) AS BIGINT) AS bytes, arg_max(lang, (bytes, lang)) AS main FROM languages GROUP BY repo", "languages")
def user_language_stats(lake: Lake) -> DataFrame:
    return lake.languages.groupBy("repo").agg(F.count("*").alias("langs"), F.sum("bytes").alias("bytes"), F.max_by("lang", F.struct("bytes", "lang")).alias("main"))


@query("SELECT owner, CAST(sum(stars) AS BIGINT) AS stars, CAST(sum(forks) AS BIGINT) AS forks, count(*) FILTER (stars > 100) AS active, arg_max(language, (stars, repo)) AS language FROM repos GROUP BY owner", "repos")
def user_profile_stats(lake: Lake) -> DataFrame:
    return lake.repos.groupBy("owner").agg(
        F.sum("stars").alias("stars"), F.sum("forks").alias("forks"), F.count_if(F.col("stars") > 100).alias("active"), F.max_by("language", F.struct("stars", "repo")).alias("language")
    )


_TOPICS = "topics AS (SELECT o_custkey % 500 AS item, lower(c_mktsegment) AS topic FROM ord JOIN customer ON o_custkey = c_custkey UNION SELECT o_custkey % 500, lower(o_orderpriority) FROM ord)"


def topics(lake: Lake) -> DataFrame:
    """``(item, topic)``, distinct."""
    item = (F.col("o_custkey") % 500).alias("item")
    segment = lake.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    a = lake.orders.select("o_custkey").join(segment, "o_custkey").select(item, F.lower("c_mktsegment").alias("topic"))
    return a.union(lake.orders.select(item, F.lower("o_orderpriority").alias("topic"))).distinct()


@query(f"WITH {_TOPICS} SELECT topic, count(*) AS n FROM topics GROUP BY topic", "ord")
def topic_counts(lake: Lake) -> DataFrame:
    return topics(lake).groupBy("topic").agg(F.count("*").alias("n"))


@query(f"WITH {_TOPICS} SELECT topic, n FROM (SELECT topic, count(*) AS n FROM topics GROUP BY topic) WHERE contains(topic, 'i') AND n >= 5 ORDER BY n DESC, topic", "ord")
def topic_filter(lake: Lake) -> DataFrame:
    return topic_counts(lake).where(F.contains("topic", F.lit("i")) & (F.col("n") >= 5)).orderBy(F.desc("n"), "topic")


@query(f"""WITH {_TOPICS}, c AS (SELECT a.topic, b.topic AS other, count(*) AS n FROM topics a JOIN topics b USING (item) WHERE a.topic <> b.topic GROUP BY ALL)
SELECT topic, other, n FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, other) AS nth FROM c) WHERE nth <= 8""", "ord")
def topic_cooccurrence(lake: Lake) -> DataFrame:
    """Topics that share items. An item has as many topics as there are segments and priorities, a fixed number."""
    t = topics(lake)
    pairs = t.join(t.withColumnRenamed("topic", "other"), "item").where("topic <> other").groupBy("topic", "other").agg(F.count("*").alias("n"))
    by = Window.partitionBy("topic").orderBy(F.desc("n"), "other")
    return pairs.withColumn("nth", F.row_number().over(by)).where("nth <= 8").select("topic", "other", "n")


@query(f"""WITH {_TOPICS}, a AS (SELECT topic, count(*) AS n FROM topics GROUP BY topic), b AS (SELECT lower(p_brand) AS topic, count(*) AS n FROM part GROUP BY 1)
SELECT coalesce(a.topic, b.topic) AS topic, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, CASE WHEN b.topic IS NULL THEN 'items' WHEN a.topic IS NULL THEN 'parts' ELSE 'both' END AS source
FROM a FULL OUTER JOIN b ON a.topic = b.topic ORDER BY n DESC, topic LIMIT 20""", "ord")
def ranked_topics(lake: Lake) -> DataFrame:
    a, b = topic_counts(lake).withColumnRenamed("n", "x"), lake.table("part").groupBy(F.lower("p_brand").alias("topic")).agg(F.count("*").alias("y"))
    source = F.when(F.col("y").isNull(), "items").when(F.col("x").isNull(), "parts").otherwise("both")
    n = F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))
    return a.join(b, "topic", "full").select("topic", n.alias("n"), source.alias("source")).orderBy(F.desc("n"), "topic").limit(20)


@query("SELECT repo, path, size FROM files ORDER BY regexp_matches(path, '[.]en$') DESC, path LIMIT 50", "files")
def dir_first_sort(lake: Lake) -> DataFrame:
    return lake.files.select("repo", "path", "size").orderBy(F.col("path").rlike("[.]en$").desc(), "path").limit(50)


@query("""SELECT repo, path, size FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN path LIKE '%.en' THEN 0 ELSE 1 END, path) AS nth FROM files WHERE size > 100 AND path NOT LIKE '%.de') WHERE nth <= 50""", "files")
def source_file_select(lake: Lake, cap: int = 50) -> DataFrame:
    """Files worth reading: excluded paths out, high-signal ones first, a cap by effort."""
    by = Window.partitionBy("repo").orderBy(F.when(F.col("path").like("%.en"), 0).otherwise(1), "path")
    some = lake.files.where((F.col("size") > 100) & ~F.col("path").like("%.de")).select("repo", "path", "size")
    return some.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= cap).select("repo", "path", "size")


@query("SELECT path, left(content, CASE WHEN path LIKE '%.en' THEN 500 ELSE 250 END) AS head, length(content) > CASE WHEN path LIKE '%.en' THEN 500 ELSE 250 END AS cut FROM files", "files")
def file_truncate(lake: Lake) -> DataFrame:
    n = F.when(F.col("path").like("%.en"), 500).otherwise(250)
    return lake.files.select("path", F.substr("content", F.lit(1), n).alias("head"), (F.length("content") > n).alias("cut"))


@query("""WITH l AS (SELECT path, i AS line, s[i] AS text FROM (SELECT path, string_split(content, chr(10)) AS s FROM files), unnest(range(1, len(s) + 1)) AS u(i))
SELECT path, CAST(line AS INT) AS line, left(text, 80) AS text FROM l WHERE regexp_matches(text, '\\b(token|password)\\b')""", "files")
def search_code(lake: Lake, pattern: str = r"\b(token|password)\b") -> DataFrame:
    """Lines that match, numbered from 1. Files without a match leave before they are split."""
    pattern = as_re2(pattern)
    hit = lake.files.where(F.col("content").rlike(pattern))
    lines = hit.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return lines.where(F.col("text").rlike(pattern)).select("path", (F.col("i") + 1).alias("line"), F.left("text", F.lit(80)).alias("text"))


@query("SELECT path, CAST(len(regexp_extract_all(content, '[Tt]h[a-z]+')) AS INT) AS n FROM files WHERE regexp_matches(content, '[Tt]h[a-z]+') ORDER BY n DESC, path LIMIT 15", "files")
def count_pattern(lake: Lake, pattern: str = "[Tt]h[a-z]+") -> DataFrame:
    n = F.regexp_count("content", F.lit(pattern)).alias("n")
    return lake.files.select("path", n).where("n > 0").orderBy(F.desc("n"), "path").limit(15)


@query("""WITH e AS (SELECT repo, split_part(path, '.', -1) AS ext, size FROM files)
SELECT repo, ext, count(*) AS files, CAST(sum(floor(size / CASE ext WHEN 'en' THEN 40 WHEN 'de' THEN 45 ELSE 50 END + 0.5)) AS BIGINT) AS lines FROM e GROUP BY ALL""", "files")
def loc_estimate(lake: Lake) -> DataFrame:
    ext = F.element_at(F.split("path", r"\."), -1)
    per = F.when(F.col("ext") == "en", 40).when(F.col("ext") == "de", 45).otherwise(50)
    e = lake.files.select("repo", ext.alias("ext"), "size")
    return e.groupBy("repo", "ext").agg(F.count("*").alias("files"), F.sum(half_up(F.col("size") / per)).alias("lines"))


@query("""WITH d AS (SELECT DISTINCT o_orderkey % 200 AS item, 'lib' || (l_partkey % 40) AS lib FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT lib, count(*) AS users FROM d GROUP BY lib""")
def dependency_graph(lake: Lake) -> DataFrame:
    """Library nodes of the graph, with their in-degree."""
    edges = lake.table("lineitem").select((F.col("l_orderkey") % 200).alias("item"), F.concat(F.lit("lib"), F.col("l_partkey") % 40).alias("lib")).distinct()
    return edges.groupBy("lib").agg(F.count("*").alias("users"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey % 200 AS item, 'lib' || (l_partkey % 40) AS lib, CAST(l_partkey % 3 AS INT) AS version FROM lineitem),
v AS (SELECT DISTINCT 'lib' || (p_partkey % 40) AS lib, CAST(p_partkey % 3 AS INT) AS version, CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM part WHERE p_partkey % 7 = 0)
SELECT item, severity, count(*) AS n FROM d JOIN v USING (lib, version) GROUP BY ALL""")
def vuln_join(lake: Lake) -> DataFrame:
    """Packages of each item against known vulnerabilities, by name and version."""
    lib = lambda c: F.concat(F.lit("lib"), F.col(c) % 40).alias("lib")
    d = lake.table("lineitem").select((F.col("l_orderkey") % 200).alias("item"), lib("l_partkey"), (F.col("l_partkey") % 3).cast("int").alias("version")).distinct()
    level = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), (F.col("p_size") % 4 + 1).cast("int"))
    v = lake.table("part").where("p_partkey % 7 = 0").select(lib("p_partkey"), (F.col("p_partkey") % 3).cast("int").alias("version"), level.alias("severity")).distinct()
    return d.join(v, ["lib", "version"]).groupBy("item", "severity").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT repo, number, created_at, draft, label, title FROM pulls)
SELECT repo, count(*) FILTER (NOT draft) AS releases, count(*) FILTER (NOT draft AND label LIKE '5-%') AS pre, max(created_at) FILTER (NOT draft) AS latest FROM p GROUP BY repo""", "pulls")
def release_stats(lake: Lake) -> DataFrame:
    shown = ~F.col("draft")
    return lake.pulls.groupBy("repo").agg(F.count_if(shown).alias("releases"), F.count_if(shown & F.col("label").like("5-%")).alias("pre"), F.max(F.when(shown, F.col("created_at"))).alias("latest"))
