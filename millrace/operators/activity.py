"""Usage, scan history, runs and user events: aggregates, windows, limits and alerts over the event facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions.ordered import with_before
from millrace.functions.numbers import half_up, hours, r4, ratio
from millrace.plans.registry import query
from millrace.sources.lake import Lake
from millrace.sources.oracle import NOW

Hours = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 3.6e9"


def last(lake: Lake, days: int) -> object:
    return F.col("created_at") >= lake.now - F.expr(f"interval '{days}' day")


@query(f"SELECT feature, CAST(sum(units) AS BIGINT) AS units, count(*) AS n FROM usage WHERE created_at >= {NOW} - INTERVAL 7 DAY GROUP BY feature", "usage")
def usage_by_feature(lake: Lake, days: int = 7) -> DataFrame:
    """Units and events of each feature over the last days."""
    return lake.usage.where(last(lake, days)).groupBy("feature").agg(F.sum("units").alias("units"), F.count("*").alias("n"))


@query(f"SELECT plan, CAST(sum(units) AS BIGINT) AS units, count(*) AS n FROM usage WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY plan", "usage")
def usage_by_plan(lake: Lake, days: int = 30) -> DataFrame:
    return lake.usage.where(last(lake, days)).groupBy("plan").agg(F.sum("units").alias("units"), F.count("*").alias("n"))


@query(f"""SELECT u.user_id, CAST(sum(units) AS BIGINT) AS units, count(*) AS n, c_name AS name FROM usage u LEFT JOIN customer ON user_id = c_custkey
WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY u.user_id, c_name ORDER BY units DESC, u.user_id LIMIT 10""", "usage")
def top_users_usage(lake: Lake, days: int = 30, top: int = 10) -> DataFrame:
    """The heaviest users with their names; only the winners meet the user table."""
    best = lake.usage.where(last(lake, days)).groupBy("user_id").agg(F.sum("units").alias("units"), F.count("*").alias("n"))
    best = best.orderBy(F.desc("units"), "user_id").limit(top)
    users = lake.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return users.join(F.broadcast(best), "user_id", "right").select("user_id", "units", "n", "name")


@query(f"SELECT feature, CAST(sum(units) AS BIGINT) AS units FROM usage WHERE created_at > {NOW} - INTERVAL 1 HOUR GROUP BY ROLLUP (feature)", "usage")
def usage_snapshot(lake: Lake) -> DataFrame:
    """Units of the last hour by feature, and their total in the row with a null feature."""
    recent = lake.usage.where(F.col("created_at") > lake.now - F.expr("interval '1' hour"))
    return recent.rollup("feature").agg(F.sum("units").alias("units"))


@query("SELECT user_id, count(*) AS n FROM usage GROUP BY user_id", "usage")
def usage_total(lake: Lake) -> DataFrame:
    return lake.usage.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT feature, CAST(sum(units) AS BIGINT) AS units FROM usage GROUP BY feature)
SELECT feature, units, CAST(greatest(max(units) OVER (), 1) AS BIGINT) AS top, round(units / greatest(max(units) OVER (), 1), 4) AS share FROM f""", "usage")
def usage_share_bar(lake: Lake) -> DataFrame:
    by = lake.usage.groupBy("feature").agg(F.sum("units").alias("units"))
    top = F.greatest(by.select(F.max("units")).scalar(), F.lit(1))
    return by.select("feature", "units", top.alias("top"), r4(F.col("units") / top).alias("share"))


@query("SELECT feature, CAST(sum(units) AS BIGINT) AS units FROM usage GROUP BY feature ORDER BY units DESC, feature", "usage")
def usage_sort(lake: Lake) -> DataFrame:
    return lake.usage.groupBy("feature").agg(F.sum("units").alias("units")).orderBy(F.desc("units"), "feature")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id, feature ORDER BY created_at, id) AS nth FROM usage)
SELECT id, user_id, feature, units, coalesce(CAST(sum(units) OVER (PARTITION BY user_id, feature ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS BIGINT), 0) AS used
FROM t""", "usage")
def usage_window(lake: Lake, window_s: int = 3600) -> DataFrame:
    """Units that each request finds used in its sliding window, if all before it were admitted."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    by = Window.partitionBy("user_id", "feature").orderBy(at).rangeBetween(-window_s * 1_000_000, -1)
    return lake.usage.select("id", "user_id", "feature", "units", F.coalesce(F.sum("units").over(by), F.lit(0)).alias("used"))


@query(f"""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM scans) AS scans,
(SELECT count(*) FROM scans WHERE created_at >= date_trunc('day', {NOW})) AS scans_today, (SELECT count(*) FROM scans WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS scans_week,
(SELECT count(*) FROM usage) AS usage_events, (SELECT count(*) FROM usage WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS usage_week,
(SELECT count(DISTINCT user_id) FROM usage WHERE plan = 'pro') AS pro_users, (SELECT count(DISTINCT user_id) FROM usage WHERE plan = 'free') AS free_users""", "usage", "scans")
def admin_stats(lake: Lake) -> DataFrame:
    """One pass over each table, then one row."""
    week = lambda d: last(lake, 7)
    s = lake.scans.agg(F.count("*").alias("scans"), F.count_if(F.col("created_at") >= F.date_trunc("day", lake.now).cast("timestamp_ntz")).alias("scans_today"), F.count_if(week(0)).alias("scans_week"))
    plan = lambda p: F.count_distinct(F.when(F.col("plan") == p, F.col("user_id"))).alias(f"{p}_users")
    u = lake.usage.agg(F.count("*").alias("usage_events"), F.count_if(week(0)).alias("usage_week"), plan("pro"), plan("free"))
    return lake.table("customer").agg(F.count("*").alias("users")).join(s, F.lit(True)).join(u, F.lit(True))


@query("SELECT repo, max(health) AS best, max(created_at) AS last_at, count(*) AS n FROM scans GROUP BY repo ORDER BY last_at DESC, repo LIMIT 50", "scans")
def scan_overview(lake: Lake, top: int = 50) -> DataFrame:
    by = lake.scans.groupBy("repo").agg(F.max("health").alias("best"), F.max("created_at").alias("last_at"), F.count("*").alias("n"))
    return by.orderBy(F.desc("last_at"), "repo").limit(top)


@query("""WITH o AS (SELECT repo, max(health) AS best FROM scans GROUP BY repo)
SELECT round(avg(best), 4) AS mean, count(*) FILTER (best >= 70) AS healthy, count(*) FILTER (best < 50) AS at_risk, count(*) AS repos FROM o""", "scans")
def fleet_summary(lake: Lake) -> DataFrame:
    best = F.col("best")
    return scan_overview(lake, 1 << 30).agg(r4(F.avg(best)).alias("mean"), F.count_if(best >= 70).alias("healthy"), F.count_if(best < 50).alias("at_risk"), F.count("*").alias("repos"))


_PERCENTILES = """WITH s AS (SELECT * FROM scans ORDER BY created_at DESC, id DESC LIMIT 5000),
m AS (SELECT 'health' AS metric, health AS x FROM s UNION ALL SELECT 'security', security FROM s UNION ALL SELECT 'quality', quality FROM s UNION ALL SELECT 'performance', performance FROM s),
p AS (SELECT metric, count(*) AS n, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c, quantile_cont(x, 0.9) AS d FROM m WHERE x > 0 GROUP BY metric HAVING count(*) >= 3)"""


@query(f"{_PERCENTILES} SELECT metric, n, CAST(floor(a + 0.5) AS BIGINT) AS p25, CAST(floor(b + 0.5) AS BIGINT) AS p50, CAST(floor(c + 0.5) AS BIGINT) AS p75, CAST(floor(d + 0.5) AS BIGINT) AS p90 FROM p", "scans")
def benchmark_percentiles(lake: Lake, newest: int = 5000) -> DataFrame:
    """Rounded percentiles of each score's positive values over the newest scans; none for fewer than three."""
    recent = lake.scans.orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    long = recent.unpivot(["id"], ["health", "security", "quality", "performance"], "metric", "x").where("x > 0")
    p = long.groupBy("metric").agg(F.count("*").alias("n"), F.percentile("x", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9)))).alias("p")).where("n >= 3")
    return p.select("metric", "n", *[half_up(F.col("p")[i]).alias(f"p{q}") for i, q in enumerate((25, 50, 75, 90))])


@query(f"""{_PERCENTILES}, b AS (SELECT floor(a + 0.5) AS p25, floor(b + 0.5) AS p50, floor(c + 0.5) AS p75, floor(d + 0.5) AS p90 FROM p WHERE metric = 'health'),
l AS (SELECT repo, health FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id DESC) AS nth FROM scans) WHERE nth = 1)
SELECT repo, health, CASE WHEN health >= p90 THEN 'top 10%' WHEN health >= p75 THEN 'top 25%' WHEN health >= p50 THEN 'above median' WHEN health >= p25 THEN 'below median' ELSE 'bottom 25%' END AS band FROM l, b""", "scans")
def benchmark_band(lake: Lake) -> DataFrame:
    """Each repository's latest score against the bands; the bands are one row."""
    bands = benchmark_percentiles(lake).where("metric = 'health'").select("p25", "p50", "p75", "p90")
    now = latest_scan(lake).select("repo", "health").join(F.broadcast(bands), F.lit(True))
    h = F.col("health")
    band = F.when(h >= F.col("p90"), "top 10%").when(h >= F.col("p75"), "top 25%").when(h >= F.col("p50"), "above median").when(h >= F.col("p25"), "below median").otherwise("bottom 25%")
    return now.select("repo", "health", band.alias("band"))


def newest_first(df: DataFrame, key: str, n: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= n)


@query("SELECT repo, id, health, security, quality, critical, created_at FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id DESC) AS nth FROM scans) WHERE nth = 1", "scans")
def latest_scan(lake: Lake) -> DataFrame:
    """The newest scan of each repository: an aggregate that combines before the shuffle, not a sort."""
    row = F.struct("id", "health", "security", "quality", "critical", "created_at")
    best = lake.scans.groupBy("repo").agg(F.max_by(row, F.struct("created_at", "id")).alias("s"))
    return best.select("repo", "s.*")


@query("""WITH n AS (SELECT * FROM scans WHERE user_id % 5 = 0 ORDER BY created_at DESC, id DESC LIMIT 50),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id DESC) AS nth FROM n) WHERE nth = 1)
SELECT count(*) AS repos, CAST(floor(avg(health) + 0.5) AS BIGINT) AS mean, count(*) FILTER (critical > 0 OR health < 40) AS critical FROM l""", "scans")
def team_fleet(lake: Lake, newest: int = 50) -> DataFrame:
    """A team's newest scans, then the latest of each repository, then one row."""
    some = lake.scans.where("user_id % 5 = 0").orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    now = newest_first(some, "repo", 1)
    return now.agg(F.count("*").alias("repos"), half_up(F.avg("health")).alias("mean"), F.count_if(F.expr("critical > 0 or health < 40")).alias("critical"))


@query(f"""WITH m AS (SELECT * FROM scans WHERE created_at >= {NOW} - INTERVAL 30 DAY),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id DESC) AS nth FROM m) WHERE nth = 1),
p AS (SELECT avg(health) AS before FROM m WHERE created_at >= {NOW} - INTERVAL 14 DAY AND created_at < {NOW} - INTERVAL 7 DAY)
SELECT count(*) AS repos, CAST(floor(avg(health) + 0.5) AS BIGINT) AS mean, CAST(floor(any_value(before) + 0.5) AS BIGINT) AS before,
CAST(floor(avg(health) + 0.5) AS BIGINT) - CAST(floor(any_value(before) + 0.5) AS BIGINT) AS delta,
(SELECT string_agg(repo, ',' ORDER BY health DESC, repo) FROM (SELECT repo, health FROM l ORDER BY health DESC, repo LIMIT 3)) AS best,
(SELECT string_agg(repo, ',' ORDER BY health, repo) FROM (SELECT repo, health FROM l WHERE health < 50 ORDER BY health, repo LIMIT 3)) AS at_risk FROM l, p""", "scans")
def weekly_digest(lake: Lake) -> DataFrame:
    """Mean of the latest scans, its change against the week before, the best and the worst three."""
    month = lake.scans.where(last(lake, 30))
    now = month.groupBy("repo").agg(F.max_by("health", F.struct("created_at", "id")).alias("health"))
    earlier = month.where((F.col("created_at") >= lake.now - F.expr("interval '14' day")) & (F.col("created_at") < lake.now - F.expr("interval '7' day")))
    before = half_up(earlier.select(F.avg("health")).scalar())
    def three(rows: DataFrame, sign: int, name: str) -> DataFrame:
        top = rows.orderBy(sign * F.col("health"), "repo").limit(3).agg(F.sort_array(F.collect_list(F.struct(sign * F.col("health"), "repo"))).alias("x"))
        return top.select(F.nullif(F.array_join(F.col("x.repo"), ","), F.lit("")).alias(name))

    mean = half_up(F.avg("health"))
    out = now.agg(F.count("*").alias("repos"), mean.alias("mean")).withColumn("before", before).withColumn("delta", F.col("mean") - F.col("before"))
    return out.join(three(now, -1, "best"), F.lit(True)).join(three(now.where("health < 50"), 1, "at_risk"), F.lit(True))


@query("""WITH l AS (SELECT repo, max(health) AS peak, min(health) AS low, count(*) AS n, arg_min(health, (created_at, id)) AS first, arg_max(health, (created_at, id)) AS last FROM scans GROUP BY repo)
SELECT repo, n, peak, low, first, last, last - first AS delta FROM l""", "scans")
def health_trend(lake: Lake) -> DataFrame:
    """First, last, peak and low of each repository's history."""
    order = F.struct("created_at", "id")
    by = lake.scans.groupBy("repo").agg(F.count("*").alias("n"), F.max("health").alias("peak"), F.min("health").alias("low"), F.min_by("health", order).alias("first"), F.max_by("health", order).alias("last"))
    return by.withColumn("delta", F.col("last") - F.col("first"))


@query("SELECT repo, id, health, critical, health - lag(health) OVER (PARTITION BY repo ORDER BY created_at, id) AS step FROM scans", "scans")
def health_series(lake: Lake) -> DataFrame:
    scans = with_before(lake.scans, "repo", ["created_at", "id"], ["health"])
    return scans.select("repo", "id", "health", "critical", (F.col("health") - F.col("before_health")).alias("step"))


@query("SELECT id, health, CASE WHEN health >= 80 THEN 'excellent' WHEN health >= 65 THEN 'good' WHEN health >= 50 THEN 'fair' WHEN health >= 35 THEN 'poor' ELSE 'critical' END AS label FROM scans", "scans")
def score_label(lake: Lake) -> DataFrame:
    h = F.col("health")
    return lake.scans.select("id", "health", F.when(h >= 80, "excellent").when(h >= 65, "good").when(h >= 50, "fair").when(h >= 35, "poor").otherwise("critical").alias("label"))


@query("""SELECT repo, id, health, before - health AS fall FROM (SELECT *, lag(health) OVER (PARTITION BY repo ORDER BY created_at, id) AS before FROM scans) WHERE before - health >= 10""", "scans")
def score_drop_alert(lake: Lake, least: int = 10) -> DataFrame:
    """Scans that fell by ``least`` points or more against the one before."""
    scans = with_before(lake.scans, "repo", ["created_at", "id"], ["health"])
    return scans.select("repo", "id", "health", (F.col("before_health") - F.col("health")).alias("fall")).where(F.col("fall") >= least)


# A small rule table, as users keep them.
RULES = [(1, "health", "lt", 30.0, None), (2, "critical", "gt", 0.0, "repo3"), (3, "security", "lt", 20.0, "repo7"), (4, "health", "drop_by", 40.0, None), (5, "quality", "gt", 97.0, "repo1")]
_RULES_SQL = ", ".join(f"({i}, '{m}', '{op}', {x}, {'NULL' if r is None else repr(r)})" for i, m, op, x, r in RULES)


@query(f"""WITH rules(rule, metric, op, threshold, filter) AS (VALUES {_RULES_SQL}),
s AS (SELECT *, lag(health) OVER (PARTITION BY repo ORDER BY created_at, id) AS before FROM scans),
v AS (SELECT id, repo, rule, op, threshold, before, health, CASE metric WHEN 'health' THEN health WHEN 'critical' THEN critical WHEN 'security' THEN security ELSE quality END AS x
  FROM s JOIN rules ON filter IS NULL OR filter = repo)
SELECT id, repo, rule, x FROM v WHERE CASE op WHEN 'lt' THEN x < threshold WHEN 'gt' THEN x > threshold ELSE before - health >= threshold END""", "scans")
def webhook_rules_match(lake: Lake) -> DataFrame:
    """Scans against every enabled rule for their repository or for all. The rules are few by the per-user limit."""
    s = with_before(lake.scans, "repo", ["created_at", "id"], ["health"]).withColumnRenamed("before_health", "before")
    rules = lake.spark.createDataFrame(RULES, "rule int, metric string, op string, threshold double, only string")
    met = s.join(F.broadcast(rules), F.col("only").isNull() | (F.col("only") == F.col("repo")))
    x = F.when(F.col("metric") == "health", F.col("health")).when(F.col("metric") == "critical", F.col("critical")).when(F.col("metric") == "security", F.col("security")).otherwise(F.col("quality"))
    hit = F.when(F.col("op") == "lt", F.col("x") < F.col("threshold")).when(F.col("op") == "gt", F.col("x") > F.col("threshold")).otherwise(F.col("before") - F.col("health") >= F.col("threshold"))
    return met.withColumn("x", x).where(hit).select("id", "repo", "rule", "x")


@query("""SELECT repo, name, count(*) AS runs, round(count(*) FILTER (conclusion = 'success') / nullif(count(*) FILTER (conclusion IS NOT NULL), 0) * 100, 4) AS pass_rate,
round(avg(date_diff('second', started_at, updated_at)) FILTER (conclusion IS NOT NULL), 4) AS mean_s, max(started_at) AS last_at FROM runs GROUP BY repo, name""", "runs")
def ci_health(lake: Lake) -> DataFrame:
    """Pass rate and mean duration of each workflow's completed runs."""
    done = F.col("conclusion").isNotNull()
    seconds = F.unix_seconds(F.col("updated_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return lake.runs.groupBy("repo", "name").agg(
        F.count("*").alias("runs"),
        r4(ratio(F.count_if(F.col("conclusion") == "success"), F.count_if(done)) * 100).alias("pass_rate"),
        r4(F.avg(F.when(done, seconds))).alias("mean_s"),
        F.max("started_at").alias("last_at"),
    )


_PAIRS = """WITH b AS (SELECT * FROM runs WHERE branch = 'main' AND event = 'push' AND conclusion IS NOT NULL),
p AS (SELECT *, lead(conclusion) OVER w AS after, lead(updated_at) OVER w AS healed_at FROM b WINDOW w AS (PARTITION BY repo ORDER BY started_at, id))"""


@query(f"""{_PAIRS} SELECT repo, count(*) AS pairs, round(avg({Hours('updated_at', 'healed_at')}), 4) AS mttr_h FROM p WHERE conclusion = 'failure' AND after = 'success' GROUP BY repo""", "runs")
def mttr_pairs(lake: Lake) -> DataFrame:
    """Failures on the default branch that the next run heals, and the mean time it takes."""
    base = lake.runs.where("branch = 'main' and event = 'push' and conclusion is not null")
    after = with_before(base, "repo", ["started_at", "id"], ["conclusion", "updated_at"])
    healed = after.where("before_conclusion = 'failure' and conclusion = 'success'")
    return healed.groupBy("repo").agg(F.count("*").alias("pairs"), r4(F.avg(hours(F.col("before_updated_at"), F.col("updated_at")))).alias("mttr_h"))


@query("SELECT id, user_id, type, repo FROM user_events WHERE type IN ('Push', 'PullRequest', 'Issues', 'Create', 'Watch')", "user_events")
def event_type_filter(lake: Lake, kinds: tuple[str, ...] = ("Push", "PullRequest", "PullRequestReview", "Issues", "Create", "Fork", "Watch", "Release")) -> DataFrame:
    return lake.user_events.where(F.col("type").isin(*kinds)).select("id", "user_id", "type", "repo")


@query("""SELECT user_id, count(*) FILTER (type = 'Push') AS pushes, count(*) FILTER (type = 'PullRequest') AS pulls, count(*) FILTER (type = 'Watch') AS stars,
CAST(coalesce(sum(commits_n) FILTER (type = 'Push'), 0) AS BIGINT) AS commits FROM user_events GROUP BY user_id""", "user_events")
def activity_counts(lake: Lake) -> DataFrame:
    t = F.col("type")
    return lake.user_events.groupBy("user_id").agg(
        F.count_if(t == "Push").alias("pushes"), F.count_if(t == "PullRequest").alias("pulls"), F.count_if(t == "Watch").alias("stars"), F.coalesce(F.sum(F.when(t == "Push", F.col("commits_n"))), F.lit(0)).alias("commits")
    )


@query("""SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(CASE type WHEN 'Push' THEN CASE WHEN commits_n = 0 THEN 1 ELSE commits_n END WHEN 'PullRequest' THEN 3 WHEN 'Issues' THEN 2 ELSE 1 END) AS BIGINT) AS weight
FROM user_events GROUP BY ALL""", "user_events")
def daily_contributions(lake: Lake) -> DataFrame:
    t = F.col("type")
    weight = F.when(t == "Push", F.coalesce(F.nullif("commits_n", F.lit(0)), F.lit(1))).when(t == "PullRequest", 3).when(t == "Issues", 2).otherwise(1)
    return lake.user_events.groupBy("user_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum(weight).alias("weight"))


@query("""WITH g AS (SELECT repo, type, count(*) AS n, max(created_at) AS newest FROM user_events GROUP BY ALL)
SELECT repo, type, n, newest, round(n / sum(n) OVER (PARTITION BY repo) * 100, 4) AS pct FROM g""", "user_events")
def notification_groups(lake: Lake) -> DataFrame:
    g = lake.user_events.groupBy("repo", "type").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))
    return g.withColumn("pct", r4(F.col("n") / F.sum("n").over(Window.partitionBy("repo")) * 100))


@query("SELECT user_id, id, type, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS nth FROM user_events) WHERE nth <= 6", "user_events")
def history_last_n(lake: Lake, n: int = 6) -> DataFrame:
    return newest_first(lake.user_events, "user_id", n).select("user_id", "id", "type", "nth")


@query("""WITH m AS (SELECT user_id, repo, max(created_at) AS at_, max(id) AS id FROM user_events GROUP BY ALL)
SELECT user_id, repo, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ DESC, repo) AS nth FROM m) WHERE nth <= 8""", "user_events")
def mru_recent(lake: Lake, cap: int = 8) -> DataFrame:
    """Move-to-front lists: the latest use of each entry, then the newest entries."""
    use = lake.user_events.groupBy("user_id", "repo").agg(F.max("created_at").alias("used"))
    by = Window.partitionBy("user_id").orderBy(F.desc("used"), "repo")
    return use.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= cap).select("user_id", "repo", "nth")


@query("SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS nth FROM scans) WHERE nth > 3", "scans")
def cap_eviction(lake: Lake, cap: int = 3) -> DataFrame:
    """Rows beyond a user's cap, oldest out."""
    return newest_first(lake.scans, "user_id", 1 << 30).where(F.col("nth") > cap).select("user_id", "id")


@query("SELECT user_id, count(*) AS n FROM scans GROUP BY user_id HAVING count(*) >= 8", "scans")
def count_guards(lake: Lake, limit: int = 8) -> DataFrame:
    return lake.scans.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)


@query("""SELECT repo, count(*) FILTER (critical > 0) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium FROM scans GROUP BY repo""", "scans")
def severity_counts(lake: Lake) -> DataFrame:
    return lake.scans.groupBy("repo").agg(F.count_if(F.col("critical") > 0).alias("critical"), F.sum("high").alias("high"), F.sum("medium").alias("medium"))


@query("SELECT id, user_id, repo, created_at FROM scans ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40", "scans")
def paginate(lake: Lake, page: int = 3, size: int = 20) -> DataFrame:
    size = min(100, max(1, size))
    ordered = lake.scans.orderBy(F.desc("created_at"), F.desc("id")).select("id", "user_id", "repo", "created_at")
    return ordered.offset((max(1, page) - 1) * size).limit(size)


@query("""SELECT id, user_id, repo FROM scans WHERE contains(lower(repo), 'repo1') OR critical > 0 ORDER BY created_at DESC, id DESC LIMIT 50""", "scans")
def audit_search(lake: Lake, text: str = "repo1") -> DataFrame:
    hit = F.col("repo").ilike(f"%{text}%") | (F.col("critical") > 0)
    return lake.scans.where(hit).orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "user_id", "repo")


@query("SELECT id, repo, event_day FROM (SELECT id, repo, strftime(created_at, '%Y-%m-%d') AS event_day, row_number() OVER (PARTITION BY user_id, feature ORDER BY created_at, id) AS nth FROM (SELECT u.*, 'r' || (id % 20) AS repo FROM usage u)) WHERE nth = 1", "usage")
def first_use(lake: Lake) -> DataFrame:
    by = Window.partitionBy("user_id", "feature").orderBy("created_at", "id")
    u = lake.usage.withColumn("nth", F.row_number().over(by)).where("nth = 1")
    return u.select("id", F.concat(F.lit("r"), F.col("id") % 20).alias("repo"), F.date_format("created_at", "yyyy-MM-dd").alias("event_day"))


@query("""WITH s AS (SELECT user_id, repo, max(created_at) AS last_at, arg_max(health, (created_at, id)) AS score FROM scans GROUP BY ALL),
d AS (SELECT *, CASE WHEN repo IN ('repo1', 'repo2', 'repo3') THEN 'daily' WHEN repo IN ('repo4', 'repo5') THEN 'weekly' ELSE 'monthly' END AS every FROM s)
SELECT user_id, repo, every, score, CASE every WHEN 'daily' THEN last_at + INTERVAL 1 DAY WHEN 'weekly' THEN last_at + INTERVAL 7 DAY ELSE last_at + INTERVAL 1 MONTH END AS next_at FROM d
WHERE CASE every WHEN 'daily' THEN last_at + INTERVAL 1 DAY WHEN 'weekly' THEN last_at + INTERVAL 7 DAY ELSE last_at + INTERVAL 1 MONTH END <= (SELECT max(ts) FROM events)""", "scans")
def schedule_due(lake: Lake) -> DataFrame:
    """Schedules whose next run is past. Months are clamped to their last day."""
    s = lake.scans.groupBy("user_id", "repo").agg(F.max("created_at").alias("last_at"), F.max_by("health", F.struct("created_at", "id")).alias("score"))
    every = F.when(F.col("repo").isin("repo1", "repo2", "repo3"), "daily").when(F.col("repo").isin("repo4", "repo5"), "weekly").otherwise("monthly")
    step = lambda x: F.col("last_at") + F.expr(f"interval {x}")
    nxt = F.when(F.col("every") == "daily", step("'1' day")).when(F.col("every") == "weekly", step("'7' day")).otherwise(step("'1' month"))
    return s.withColumn("every", every).withColumn("next_at", nxt).where(F.col("next_at") <= lake.now).select("user_id", "repo", "every", "score", "next_at")


@query("""SELECT u.user_id, count(DISTINCT s.repo) AS repos FROM (SELECT DISTINCT user_id, repo FROM user_events WHERE type = 'Watch') u
JOIN (SELECT DISTINCT repo FROM scans WHERE critical > 0) s USING (repo) GROUP BY u.user_id""", "scans", "user_events")
def digest_audience(lake: Lake) -> DataFrame:
    """Users and how many of the repositories they watch have had a critical finding."""
    watched = lake.user_events.where("type = 'Watch'").select("user_id", "repo").distinct()
    risky = lake.scans.where("critical > 0").select("repo").distinct()
    return watched.join(risky, "repo").groupBy("user_id").agg(F.count_distinct("repo").alias("repos"))


@query(f"""WITH d AS (SELECT user_id, repo, max(created_at) AS at_ FROM scans GROUP BY ALL)
SELECT user_id, repo FROM d WHERE at_ < {NOW} - INTERVAL 7 DAY AND user_id NOT IN (SELECT user_id FROM scans WHERE created_at >= {NOW} - INTERVAL 1 DAY)""", "scans")
def due_scans_no_active(lake: Lake) -> DataFrame:
    """Stale schedules of users without a recent job."""
    stale = lake.scans.groupBy("user_id", "repo").agg(F.max("created_at").alias("at")).where(F.col("at") < lake.now - F.expr("interval '7' day"))
    active = lake.scans.where(last(lake, 1)).select("user_id").distinct()
    return stale.join(active, "user_id", "left_anti").select("user_id", "repo")


@query("SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS nth FROM usage WHERE units > 50) WHERE nth = 1", "usage")
def job_claim(lake: Lake) -> DataFrame:
    """The oldest waiting job of each user."""
    jobs = lake.usage.where("units > 50").groupBy("user_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
    return jobs.select("user_id", "id")


@query(f"""SELECT user_id, repo, count(*) FILTER (created_at >= {NOW} - INTERVAL 1 DAY) AS fresh, count(*) FILTER (created_at < {NOW} - INTERVAL 1 DAY) AS expired,
CAST(arg_max(health, (created_at, id)) AS INT) AS value FROM scans GROUP BY ALL""", "scans")
def ttl_cache(lake: Lake, hours_: int = 24) -> DataFrame:
    fresh = F.col("created_at") >= lake.now - F.expr(f"interval '{hours_}' hour")
    return lake.scans.groupBy("user_id", "repo").agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("expired"), F.max_by("health", F.struct("created_at", "id")).alias("value"))
