"""Smaller filters, sorts, set operations, string functions and review steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.numbers import clamp, half_up, hours, r4, ratio, scaled
from millrace.operators import activity, forge, scoring
from millrace.operators.text import DEPS, dependencies
from millrace.plans.registry import ORACLES, QUERIES, query
from millrace.sources.lake import Lake
from millrace.sources.oracle import COMMIT_NOW, NOW

#: The same query under the name of another use of it.
for _other, _one in {
    "repo_benchmark_position": "benchmark_band",
    "latest_per_key": "latest_scan",
    "velocity_trend": "velocity_change",
    "rule_alerts": "webhook_rules_match",
    "org_filter": "org_search",
    "badge": "score_label",
}.items():
    QUERIES[_other], ORACLES[_other] = QUERIES[_one], ORACLES[_one]


# filters and sorts


@query(f"SELECT repo, language, stars FROM repos WHERE pushed_at >= {COMMIT_NOW} - INTERVAL 3000 DAY AND language = 'BUILDING'", "repos")
def trending_filter(lake: Lake, days: int = 3000, language: str = "BUILDING") -> DataFrame:
    recent = F.col("pushed_at") >= lake.commit_now - F.expr(f"interval '{days}' day")
    return lake.repos.where(recent & (F.col("language") == language)).select("repo", "language", "stars")


@query("SELECT CASE WHEN critical > 0 THEN 'open' ELSE 'done' END AS status, count(*) AS n, count(*) FILTER (contains(repo, '1')) AS hits FROM scans GROUP BY 1", "scans")
def action_item_filter(lake: Lake, text: str = "1") -> DataFrame:
    status = F.when(F.col("critical") > 0, "open").otherwise("done")
    return lake.scans.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_if(F.contains("repo", F.lit(text))).alias("hits"))


@query("SELECT id, user_id, repo FROM user_events WHERE type = 'Issues'", "user_events")
def notification_unread(lake: Lake) -> DataFrame:
    return lake.user_events.where("type = 'Issues'").select("id", "user_id", "repo")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%12%' OR c_mktsegment ILIKE '%auto%' ORDER BY c_custkey LIMIT 20")
def user_search(lake: Lake, text: str = "12") -> DataFrame:
    hit = F.col("c_name").ilike(f"%{text}%") | F.col("c_mktsegment").ilike("%auto%")
    return lake.table("customer").where(hit).orderBy("c_custkey").limit(20).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT repo FROM repos WHERE starts_with(repo, 'asia/') OR lower(repo) IN (SELECT lower(repo) FROM repos WHERE nation % 9 = 1)", "repos")
def relevant_repo(lake: Lake, owner: str = "asia") -> DataFrame:
    """One's own, or bookmarked in any case."""
    marked = lake.nations.where("nation % 9 = 1").select(F.lower("repo").alias("key")).distinct().withColumn("marked", F.lit(True))
    r = lake.repos.select("repo", F.lower("repo").alias("key")).join(marked, "key", "left")
    return r.where(F.startswith("repo", F.lit(owner + "/")) | F.col("marked")).select("repo")


@query(rf"{DEPS} SELECT lib, regexp_matches(lib, '^(@[a-z0-9-~][a-z0-9-._~]*/)?[a-z0-9-~][a-z0-9-._~]*$') AS valid FROM deps", "landed")
def pkg_name_valid(lake: Lake) -> DataFrame:
    return dependencies(lake).select("lib", F.col("lib").rlike(r"^(@[a-z0-9-~][a-z0-9-._~]*/)?[a-z0-9-~][a-z0-9-._~]*$").alias("valid"))


@query("SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS nth FROM files WHERE regexp_matches(path, '[13579][.](en|fr)$') AND NOT regexp_matches(path, '/9')) WHERE nth <= 8", "files")
def context_file_select(lake: Lake, cap: int = 8) -> DataFrame:
    some = lake.files.where(F.col("path").rlike("[13579][.](en|fr)$") & ~F.col("path").rlike("/9")).select("repo", "path")
    return some.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where(F.col("nth") <= cap).select("repo", "path")


@query("SELECT topic, round(frac - floor(frac), 4) AS place FROM (SELECT topic, sin(length(topic) * 127 + ascii(topic)) * 10000 AS frac FROM (SELECT DISTINCT lower(o_orderpriority) AS topic FROM orders))")
def topic_sort(lake: Lake) -> DataFrame:
    """A fixed shuffle by name."""
    t = lake.table("orders").select(F.lower("o_orderpriority").alias("topic")).distinct()
    x = F.sin(F.length("topic") * 127 + F.ascii("topic")) * 10000
    return t.select("topic", r4(x - F.floor(x)).alias("place")).orderBy("place")


# Labels that add to a pull's risk.
_RISKY = "(?i)security|breaking|urgent|critical|hotfix"


@query(f"""WITH o AS (SELECT *, additions + deletions AS churn, (epoch_us({COMMIT_NOW}) - epoch_us(created_at)) / 3.6e9 / 24 AS age FROM pulls WHERE state = 'open'),
x AS (SELECT repo, number, CAST(least(100, greatest(0, CASE WHEN churn > 1000 THEN 40 WHEN churn > 400 THEN 25 WHEN churn > 100 THEN 10 ELSE 0 END
 + CASE WHEN changed_files > 30 THEN 30 WHEN changed_files > 15 THEN 18 WHEN changed_files > 5 THEN 8 ELSE 0 END + CASE WHEN age > 14 THEN 20 WHEN age > 7 THEN 10 ELSE 0 END
 - CASE WHEN draft THEN 10 ELSE 0 END + CASE WHEN n_reviewers = 0 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(label, '{_RISKY}') THEN 25 ELSE 0 END)) AS INT) AS score,
 floor(age * 10 + .5) / 10 AS wait_days, churn, n_reviewers FROM o)
SELECT sort_by, repo, number, score, wait_days, churn, n_reviewers FROM x, (VALUES ('risk'), ('age'), ('size')) AS s(sort_by)
ORDER BY sort_by, CASE sort_by WHEN 'risk' THEN score WHEN 'age' THEN wait_days ELSE churn END DESC, number, repo, score DESC, wait_days DESC""", "pulls")
def pr_sort(lake: Lake) -> DataFrame:
    """Every open pull in each of three orders: the riskiest, the oldest and the largest first, ties by number."""
    c = F.col
    o = lake.pulls.where("state = 'open'").withColumn("churn", c("additions") + c("deletions")).withColumn("age", hours(c("created_at"), lake.commit_now) / 24)
    lines = F.when(c("churn") > 1000, 40).when(c("churn") > 400, 25).when(c("churn") > 100, 10).otherwise(0)
    files = F.when(c("changed_files") > 30, 30).when(c("changed_files") > 15, 18).when(c("changed_files") > 5, 8).otherwise(0)
    old = F.when(c("age") > 14, 20).when(c("age") > 7, 10).otherwise(0)
    more = F.when(c("n_reviewers") == 0, 10).otherwise(0) + F.when(c("label").rlike(_RISKY), 25).otherwise(0) - F.when(c("draft"), 10).otherwise(0)
    x = o.select("repo", "number", clamp(lines + files + old + more).alias("score"), half_up(c("age"), 1).alias("wait_days"), "churn", "n_reviewers")
    x = x.repartition("repo", "number")  # the sort samples what is dealt out here instead of doing the joins twice
    keys = {"risk": "score", "age": "wait_days", "size": "churn"}
    orders = F.array(*[F.struct(F.lit(name).alias("sort_by"), c(key).cast("double").alias("key")) for name, key in keys.items()])
    listed = x.select(F.inline(orders), *x.columns).orderBy("sort_by", F.desc("key"), "number", "repo", F.desc("score"), F.desc("wait_days"))
    return listed.select("sort_by", *x.columns)


@query("SELECT id, repo, CASE WHEN critical > 0 THEN 0 WHEN high > 1 THEN 1 WHEN medium > 2 THEN 2 ELSE 3 END AS rank FROM scans ORDER BY rank, repo, id LIMIT 200", "scans")
def severity_sort(lake: Lake) -> DataFrame:
    rank = F.when(F.col("critical") > 0, 0).when(F.col("high") > 1, 1).when(F.col("medium") > 2, 2).otherwise(3)
    return lake.scans.select("id", "repo", rank.alias("rank")).orderBy("rank", "repo", "id").limit(200)


@query("SELECT repo, round((.4 * stars + .4 * open_issues + .2 * (CASE WHEN has_wiki THEN 100 ELSE 0 END))::DOUBLE, 4) AS points FROM repos ORDER BY points DESC, repo", "repos")
def radar_rank(lake: Lake) -> DataFrame:
    points = 0.4 * F.col("stars") + 0.4 * F.col("open_issues") + 0.2 * F.when(F.col("has_wiki"), 100).otherwise(0)
    return lake.repos.select("repo", r4(points).alias("points")).orderBy(F.desc("points"), "repo")


@query("SELECT repo FROM repos WHERE contains(lower(repo), 'ia') ORDER BY repo", "repos")
def palette_filter(lake: Lake, text: str = "IA") -> DataFrame:
    return lake.repos.where(F.contains(F.lower("repo"), F.lit(text.lower()))).select("repo").orderBy("repo")


@query(f"WITH t AS (SELECT o_custkey % 500 AS item, lower(o_orderpriority) AS topic, max(o_orderdate) AS at_ FROM ord GROUP BY ALL) SELECT topic, count(*) AS n, max(at_) AS latest FROM t WHERE at_ >= {COMMIT_NOW} - INTERVAL 1500 DAY GROUP BY topic ORDER BY n DESC, topic LIMIT 20", "ord")
def trending_topics(lake: Lake, days: int = 1500) -> DataFrame:
    t = lake.orders.groupBy((F.col("o_custkey") % 500).alias("item"), F.lower("o_orderpriority").alias("topic")).agg(F.max("o_orderdate").alias("at"))
    t = t.where(F.col("at") >= lake.commit_now - F.expr(f"interval '{days}' day"))
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.max("at").alias("latest")).orderBy(F.desc("n"), "topic").limit(20)


# set operations


@query("SELECT id, 'critical' AS kind FROM scans WHERE critical > 0 UNION ALL SELECT id, 'weak' FROM scans WHERE health < 20", "scans")
def union_all_findings(lake: Lake) -> DataFrame:
    of = lambda cond, kind: lake.scans.where(cond).select("id", F.lit(kind).alias("kind"))
    return of("critical > 0", "critical").unionByName(of("health < 20", "weak"))


@query("SELECT repo, user_id FROM scans UNION SELECT repo, user_id FROM user_events", "scans", "user_events")
def union_distinct_pairs(lake: Lake) -> DataFrame:
    return lake.scans.select("repo", "user_id").union(lake.user_events.select("repo", "user_id")).distinct()


@query("SELECT DISTINCT user_id FROM usage WHERE feature = 'click' AND units > 90 EXCEPT SELECT user_id FROM usage WHERE feature = 'purchase' AND units > 90", "usage")
def except_users(lake: Lake) -> DataFrame:
    of = lambda f: lake.usage.where((F.col("feature") == f) & (F.col("units") > 90)).select("user_id")
    return of("click").distinct().join(of("purchase").distinct(), "user_id", "left_anti")


@query("SELECT user_id FROM usage WHERE feature = 'click' INTERSECT SELECT user_id FROM usage WHERE feature = 'signup'", "usage")
def intersect_users(lake: Lake) -> DataFrame:
    of = lambda f: lake.usage.where(F.col("feature") == f).select("user_id").distinct()
    return of("click").join(of("signup"), "user_id", "left_semi")


@query("""WITH a AS (SELECT id, left(repo || ' finding ' || (id % 9), 40) AS head FROM scans WHERE id % 3 = 0), b AS (SELECT id, left(repo || ' finding ' || (id % 9), 40) AS head FROM scans WHERE id % 3 = 1)
SELECT head, 'model' AS source FROM (SELECT DISTINCT head FROM a) UNION ALL SELECT head, 'static' FROM (SELECT DISTINCT head FROM b) WHERE head NOT IN (SELECT head FROM a)""", "scans")
def llm_finding_merge(lake: Lake) -> DataFrame:
    """Findings of two sources; of those that start alike, the first source's stay."""
    head = F.left(F.concat("repo", F.lit(" finding "), F.col("id") % 9), F.lit(40)).alias("head")
    of = lambda n: lake.scans.where(F.col("id") % 3 == n).select(head).distinct()
    return of(0).withColumn("source", F.lit("model")).unionByName(of(1).join(of(0), "head", "left_anti").withColumn("source", F.lit("static")))


# scores


def _pick(column: str):
    return lambda lake: scoring.compare_repos(lake).select("repo", column)


for _n in ("tier", "confidence"):
    query(ORACLES["compare_repos"].replace("SELECT repo, round(overall, 4) AS overall, rank()", f"SELECT repo, {_n} FROM (SELECT repo, round(overall, 4) AS overall, rank()") + ")", name=_n)(_pick(_n))


@query("SELECT repo, round((rank() OVER (ORDER BY stars) - 1) / count(*) OVER () * 100, 4) AS percentile FROM repos", "repos")
def cohort_percentile(lake: Lake) -> DataFrame:
    """The share of the cohort that is strictly below, counted over the distinct numbers of stars."""
    r = lake.repos.select("repo", "stars")
    met = r.join(scoring.positions(r, "stars"), F.col("stars").eqNullSafe(F.col("value")))
    return met.select("repo", r4(F.col("below") / F.col("every") * 100).alias("percentile"))


@query(f"WITH b AS (SELECT min(stars) AS lo, max(stars) AS hi FROM repos) SELECT repo, round({scoring._sql_scaled('stars', 'lo', 'hi', False)}, 4) AS linear, round({scoring._sql_scaled('stars', 'lo', 'hi', True)}, 4) AS log, round(100 - {scoring._sql_scaled('stars', 'lo', 'hi', False)}, 4) AS inverted FROM repos, b", "repos")
def normalize_score(lake: Lake) -> DataFrame:
    r = lake.repos.select("repo", "stars")
    lo, hi, x = r.select(F.min("stars")).scalar(), r.select(F.max("stars")).scalar(), F.col("stars")
    return r.select("repo", r4(scaled(x, lo, hi)).alias("linear"), r4(scaled(x, lo, hi, log=True)).alias("log"), r4(scaled(x, lo, hi, invert=True)).alias("inverted"))


@query("SELECT id, CAST(floor((security + quality + health) / 3 + .5) AS BIGINT) AS overall FROM scans", "scans")
def review_overall(lake: Lake) -> DataFrame:
    return lake.scans.select("id", half_up((F.col("security") + F.col("quality") + F.col("health")) / 3).alias("overall"))


# strings


@query("""WITH d AS (SELECT event_id AS id, date_diff('second', ts, (SELECT max(ts) FROM events)) AS s, CAST(floor(value * 1000) AS BIGINT) AS b, ts FROM events)
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago,
CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (b // 1024) || ' KB' ELSE (b // 1048576) || ' MB' END AS size FROM d""")
def format_relative(lake: Lake) -> DataFrame:
    """Ages and sizes in words; from thirty days on the date."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = F.expr("s")
    e = lake.table("events").select(F.col("event_id").alias("id"), (F.floor(micros(lake.now) / 1_000_000) - F.floor(micros(F.col("ts")) / 1_000_000)).alias("s"), F.floor(F.col("value") * 1000).alias("b"), "ts")
    part = lambda c, by, unit: F.concat(F.floor(F.col(c) / by), F.lit(unit))
    ago = F.when(seconds < 60, "just now").when(seconds < 3600, part("s", 60, "m ago")).when(seconds < 86400, part("s", 3600, "h ago")).when(seconds < 30 * 86400, part("s", 86400, "d ago")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    size = F.when(F.col("b") < 1024, part("b", 1, " B")).when(F.col("b") < 1048576, part("b", 1024, " KB")).otherwise(part("b", 1048576, " MB"))
    return e.select("id", ago.alias("ago"), size.alias("size"))


# an answer with a whole object in prose, one in a fence, one that breaks off, and one without
_SAID = """CASE event_id % 4 WHEN 0 THEN concat('It is {"k": ', k, ', "note": "a } in \\\\"quotes\\\\"", "in": {"x": 1}} as asked }') WHEN 1 THEN concat('```json\n{"k": ', k, '}\n```')
WHEN 2 THEN concat('{"k": ', k, ', "in": {') ELSE concat('nothing for ', k) END"""


def balanced(text: Column) -> Column:
    """The first object in a text whose brackets close, brackets in strings not counted; null if none does. Only brackets,
    quotes and backslashes are walked, not every sign."""
    start = F.locate("{", text)
    rest = F.substr(text, start)
    # each step is the text up to and with the next sign that matters
    steps = F.regexp_extract_all(rest, F.lit(r'(?s)[^{}"\\]*(?:\\.|[{}"])'), F.lit(0))
    first = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        sign, at = F.right(x, F.lit(1)), a["at"] + F.length(x)
        escaped = F.substr(x, F.length(x) - 1, F.lit(1)) == "\\"
        quote = (sign == '"') & ~escaped
        depth = a["depth"] + F.when(a["quoted"] | escaped, 0).when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        closed = (a["end"] == 0) & (depth == 0) & (a["depth"] == 1)
        return F.struct(depth.alias("depth"), (a["quoted"] != quote).alias("quoted"), at.alias("at"), F.when(closed, at).otherwise(a["end"]).alias("end"))

    end = F.aggregate(steps, first, step, lambda a: a["end"])
    return F.when((start > 0) & (end > 0), F.substr(rest, F.lit(1), end))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 < 2 THEN k END AS k FROM ev", "ev")
def balanced_json(lake: Lake) -> DataFrame:
    """The first whole object in an answer, and what it says of k."""
    said = lake.events.select("event_id", F.expr(_SAID).alias("text"))
    return said.select(F.col("event_id").alias("id"), F.get_json_object(balanced(F.col("text")), "$.k").cast("int").alias("k"))


@query(f"{DEPS}, v AS (SELECT repo, lib, regexp_replace(version, '^[^0-9A-Za-z]+', '') AS version FROM deps) SELECT * FROM v WHERE regexp_matches(version, '^[0-9]')", "landed")
def clean_semver(lake: Lake) -> DataFrame:
    """Versions without their range prefix; what does not start with a digit is none."""
    v = F.regexp_replace("version", "^[^0-9A-Za-z]+", "")
    return dependencies(lake).select("repo", "lib", v.alias("version")).where(F.col("version").rlike("^[0-9]"))


# streams' batch forms


@query(f"SELECT user_id, repo, arg_max(health, (created_at, id)) AS value FROM scans WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY ALL", "scans")
def knowledge_ttl(lake: Lake, days: int = 30) -> DataFrame:
    fresh = lake.scans.where(activity.last(lake, days))
    return fresh.groupBy("user_id", "repo").agg(F.max_by("health", F.struct("created_at", "id")).alias("value"))


@query("SELECT repo, number FROM pulls WHERE state = 'open' AND NOT draft AND label LIKE '1-%'", "pulls")
def pr_webhook(lake: Lake) -> DataFrame:
    """Pulls whose opening asks for a review."""
    return lake.pulls.where((F.col("state") == "open") & ~F.col("draft") & F.col("label").like("1-%")).select("repo", "number")


@query("""WITH s AS (SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM user_events WHERE dayofweek(created_at) = 1 GROUP BY ALL)
SELECT user_id, day, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY user_id) AS nth FROM s) WHERE nth <= 50""", "user_events")
def digest_gate(lake: Lake, cap: int = 50) -> DataFrame:
    """Users to write to on Mondays, at most fifty a day."""
    monday = lake.user_events.where(F.dayofweek("created_at") == 2)
    s = monday.groupBy("user_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return s.withColumn("nth", F.row_number().over(Window.partitionBy("day").orderBy("user_id"))).where(F.col("nth") <= cap).select("user_id", "day", "n")


@query("SELECT repo, language, round(forks / nullif(stars, 0), 4) AS fork_ratio, round(open_issues / nullif(stars, 0), 4) AS issue_ratio FROM repos", "repos")
def repo_ratios(lake: Lake) -> DataFrame:
    return lake.repos.select("repo", "language", r4(ratio(F.col("forks"), F.col("stars"))).alias("fork_ratio"), r4(ratio(F.col("open_issues"), F.col("stars"))).alias("issue_ratio"))


@query(None)
def json_export(lake: Lake) -> DataFrame:
    """Topics and their counts as lines of JSON."""
    return forge.topic_counts(lake).select(F.to_json(F.struct("topic", "n")).alias("line"))
