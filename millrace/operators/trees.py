"""Repository trees: manifests, what a repository uses, and what follows from it.

Evidence (a path's name, folders and extension, a package, a key of a manifest) meets the table of markers in one
equality join; flags, patterns, strengths, concerns and recommendations are conditions over the flags that it found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.text import DEPS, above, above_sql, dependencies, manifests, sources
from millrace.plans.registry import query
from millrace.sources.fixtures import cte, table
from millrace.sources.lake import Lake
from millrace.sources.markers import FLAGS

#: What follows from the flags: a name and a condition, the same in both dialects.
PATTERNS = {
    "server-rendered application": "full_stack",
    "application in the browser": "interface AND NOT full_stack",
    "back-end service": "service AND NOT full_stack",
    "remote procedures": "remote_calls",
    "graph interface": "graph_api",
    "route handlers in folders": "routes",
    "pages in folders": "page_folder AND full_stack",
    "relational store": "relational",
    "document store": "documents",
    "versioned schema": "schema_changes AND relational",
    "cache in front of a store": "cache AND (relational OR documents)",
    "work in the background": "jobs",
    "container image": "container",
    "cluster deployment": "cluster AND container",
    "hosted functions": "hosted AND NOT container",
    "many packages in one repository": "workspaces",
    "folders by feature": "features",
    "payments taken": "payments",
    "mail sent": "mail",
    "tests at two levels": "unit_tests AND browser_tests",
}
STRENGTHS = {
    "types are checked": "static_types",
    "every change is built": "pipeline",
    "style is settled by tools": "linting AND formatting",
    "tested in units": "unit_tests",
    "tested in the browser": "browser_tests",
    "runs anywhere": "container",
    "schema changes are versioned": "schema_changes",
    "failures are seen": "telemetry",
    "requests are throttled": "throttling",
    "headers are hardened": "safe_headers",
    "known sign-in library": "sign_in",
}
CONCERNS = {
    "nothing is tested": "NOT unit_tests AND NOT browser_tests",
    "nothing builds changes": "NOT pipeline",
    "failures go unseen": "n_files > 50 AND NOT telemetry",
    "sign-in without throttling": "sign_in AND NOT throttling",
    "forms without a forgery guard": "service AND sign_in AND NOT forgery_guard",
    "flawed packages": "n_risky > 0",
    "deep folders": "n_deep > 20",
    "very many packages": "n_deps > 120",
}
ISSUES = {"medium:settings are not shown by a sample": "NOT sample_settings", "medium:no pipeline": "NOT pipeline", "low:no linter": "NOT linting"}
#: (name, effort, what it gains, condition)
ADVICE = [
    ("raise flawed packages", "low", "high", "n_risky > 0"),
    ("build every change", "low", "high", "NOT pipeline"),
    ("start with tests of the core", "high", "high", "NOT unit_tests"),
    ("throttle sign-in", "low", "high", "sign_in AND NOT throttling"),
    ("record failures", "medium", "high", "NOT telemetry AND n_files > 40"),
    ("test the main paths in a browser", "medium", "medium", "interface AND unit_tests AND NOT browser_tests"),
    ("show the settings in a sample", "low", "medium", "NOT sample_settings"),
    ("let a tool settle style", "low", "low", "NOT linting OR NOT formatting"),
]
RECOMMENDED = {f"{name} ({effort} effort, {gain} gain)": condition for name, effort, gain, condition in ADVICE}
LANGUAGES = {"ts": r"\.tsx?$", "js": r"\.jsx?$", "py": r"\.py$", "go": r"\.go$", "rust": r"\.rs$"}

#: The name of a file of tests.
_TEST = r"^test_|[._](test|spec)\."
_SRC = "src AS (SELECT repo, path FROM code UNION ALL SELECT repo, path FROM files)"
TREE = f"""{DEPS}, {_SRC}, {cte('markers')}, {cte('advisories')},
cut AS (SELECT repo, path, string_split(path, '/') AS parts FROM src),
evidence AS (
  SELECT repo, 'file' AS kind, parts[-1] AS name FROM cut
  UNION ALL SELECT repo, 'extension', regexp_extract(parts[-1], '[.]([^.]+)$', 1) FROM cut
  UNION ALL SELECT repo, 'folder', unnest(list_distinct(parts[1:len(parts) - 1])) FROM cut
  UNION ALL SELECT repo, 'file', file FROM manifests
  UNION ALL SELECT DISTINCT repo, 'package', lib FROM deps
  UNION ALL SELECT repo, 'key', unnest(json_keys(content)) FROM manifests WHERE file = 'package.json' AND json_valid(content)),
met AS (SELECT repo, flag FROM evidence JOIN markers USING (kind, name) GROUP BY repo, flag, kind, name, least HAVING count(*) >= least),
tree AS (SELECT repo, count(*) AS n_files, count(*) FILTER (len(parts) > 7) AS n_deep, count(*) FILTER (regexp_matches(parts[-1], '{_TEST}')) AS n_tests FROM cut GROUP BY repo),
judged AS (SELECT repo, EXISTS (SELECT 1 FROM advisories a WHERE a.lib = d.lib AND a.registry = d.registry AND {above_sql('a.fixed', 'd.version')}) AS flawed FROM deps d),
lib AS (SELECT repo, count(*) AS n_deps, count(*) FILTER (flawed) AS n_risky FROM judged GROUP BY repo),
told AS (SELECT repo, list(DISTINCT flag) AS flags FROM met GROUP BY repo),
det AS (SELECT repo, coalesce(n_files, 0) AS n_files, coalesce(n_deep, 0) AS n_deep, coalesce(n_tests, 0) AS n_tests, coalesce(n_deps, 0) AS n_deps, coalesce(n_risky, 0) AS n_risky,
  {', '.join(f"coalesce(list_contains(flags, '{f}'), FALSE) AS {f}" for f in FLAGS)} FROM tree FULL JOIN lib USING (repo) LEFT JOIN told USING (repo))"""


def detected(lake: Lake) -> DataFrame:
    """A row per repository: its files, deep paths, packages and flawed packages, and a boolean for each flag."""
    paths = sources(lake).select("repo", F.split("path", "/").alias("parts"))
    name, folders = F.element_at("parts", -1), F.array_distinct(F.slice("parts", 1, F.size("parts") - 1))
    fact = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.alias("name"))
    of_path = F.concat(F.array(fact("file", name), fact("extension", F.regexp_extract(name, r"\.([^.]+)$", 1))), F.transform(folders, lambda x: fact("folder", x)))
    deps, found = dependencies(lake), manifests(lake)
    keys = F.when(F.col("file") == "package.json", F.json_object_keys("content"))
    of_manifest = F.concat(F.array(fact("file", F.col("file"))), F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda x: fact("key", x)))
    evidence = paths.select("repo", F.explode(of_path).alias("e")).unionAll(found.select("repo", F.explode(of_manifest).alias("e")))
    evidence = evidence.unionAll(deps.select("repo", fact("package", F.col("lib")).alias("e")).distinct()).select("repo", "e.*")
    markers = table(lake.spark, "markers")
    met = evidence.join(F.broadcast(markers), ["kind", "name"]).groupBy("repo", "flag", "kind", "name", "least").agg(F.count("*").alias("n")).where("n >= least")
    told = met.groupBy("repo").agg(F.collect_set("flag").alias("flags"))
    tree = paths.groupBy("repo").agg(F.count("*").alias("n_files"), F.count_if(F.size("parts") > 7).alias("n_deep"), F.count_if(name.rlike(_TEST)).alias("n_tests"))
    lib = flawed(deps, lake).groupBy("repo").agg(F.count("*").alias("n_deps"), F.count_if("flawed").alias("n_risky"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_files", "n_deep", "n_tests", "n_deps", "n_risky")]
    flags = [F.coalesce(F.array_contains("flags", f), F.lit(False)).alias(f) for f in FLAGS]
    return tree.join(lib, "repo", "full").join(told, "repo", "left").select("repo", *counts, *flags)


def flawed(deps: DataFrame, lake: Lake) -> DataFrame:
    """``deps`` with ``flawed``: whether an advisory names the package and a later version as the first without the flaw."""
    advisories = table(lake.spark, "advisories").groupBy("lib", "registry").agg(F.collect_list("fixed").alias("fixes"))
    met = deps.join(F.broadcast(advisories), ["lib", "registry"], "left")
    return met.withColumn("flawed", F.coalesce(F.exists("fixes", lambda x: above(x, F.col("version"))), F.lit(False))).drop("fixes")


def names_of(conditions: dict[str, str]) -> Column:
    return F.concat_ws(", ", *[F.when(F.expr(c), n) for n, c in conditions.items()])


def names_sql(conditions: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items()) + "], lambda x: x IS NOT NULL), ', ')"


@query(f"{TREE} SELECT repo, {names_sql({f: f for f in FLAGS})} AS flags FROM det", "files", "landed")
def detector_flags(lake: Lake) -> DataFrame:
    return detected(lake).select("repo", names_of({f: f for f in FLAGS}).alias("flags"))


@query(f"{TREE} SELECT repo, {names_sql(PATTERNS)} AS patterns FROM det", "files", "landed")
def architecture_patterns(lake: Lake) -> DataFrame:
    return detected(lake).select("repo", names_of(PATTERNS).alias("patterns"))


@query(f"{TREE} SELECT repo, {names_sql(STRENGTHS)} AS strengths, {names_sql(CONCERNS)} AS concerns FROM det", "files", "landed")
def architecture_notes(lake: Lake) -> DataFrame:
    """Strengths and concerns."""
    return detected(lake).select("repo", names_of(STRENGTHS).alias("strengths"), names_of(CONCERNS).alias("concerns"))


@query(f"{TREE} SELECT repo, {names_sql(ISSUES)} AS issues FROM det", "files", "landed")
def structural_issues(lake: Lake) -> DataFrame:
    return detected(lake).select("repo", names_of(ISSUES).alias("issues"))


@query(f"{TREE} SELECT repo, {names_sql(RECOMMENDED)} AS recommendations FROM det", "files", "landed")
def recommendations(lake: Lake) -> DataFrame:
    """What to do next, with its effort and gain."""
    return detected(lake).select("repo", names_of(RECOMMENDED).alias("recommendations"))


@query(f"""{DEPS}, {cte('advisories')} SELECT repo, lib, version FROM deps d WHERE EXISTS (SELECT 1 FROM advisories a WHERE a.lib = d.lib AND a.registry = d.registry AND {above_sql('a.fixed', 'd.version')})""", "landed")
def risky_deps(lake: Lake) -> DataFrame:
    """Dependencies at a version that a public advisory names."""
    return flawed(dependencies(lake), lake).where("flawed").select("repo", "lib", "version")


@query(f"{DEPS}, {cte('advisories')} SELECT repo, lib, version, fixed, advisory FROM deps d JOIN advisories a USING (lib, registry) WHERE {above_sql('a.fixed', 'd.version')}", "landed")
def advisory_join(lake: Lake) -> DataFrame:
    """Every advisory that holds for a dependency's version."""
    met = dependencies(lake).join(F.broadcast(table(lake.spark, "advisories")), ["lib", "registry"])
    return met.where(above(F.col("fixed"), F.col("version"))).select("repo", "lib", "version", "fixed", "advisory")


_PRIMARY = "CASE WHEN ts > 0 AND ts >= js AND ts >= py AND ts >= go THEN 'TypeScript' WHEN py > js AND py > go THEN 'Python' WHEN go > js THEN 'Go' WHEN rust > js THEN 'Rust' WHEN js > 0 THEN 'JavaScript' ELSE 'Unknown' END"


@query(f"WITH {cte('code')}, {_SRC}, n AS (SELECT repo, {', '.join(f"count(*) FILTER (regexp_matches(path, '{p}')) AS {n}" for n, p in LANGUAGES.items())} FROM src GROUP BY repo) SELECT repo, {_PRIMARY} AS language FROM n", "files")
def primary_language(lake: Lake) -> DataFrame:
    n = sources(lake).groupBy("repo").agg(*[F.count_if(F.col("path").rlike(p)).alias(k) for k, p in LANGUAGES.items()])
    return n.select("repo", F.expr(_PRIMARY).alias("language"))
