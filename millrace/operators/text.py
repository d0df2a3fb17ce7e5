"""Source text: the rule engine, import graph, manifests, and string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.numbers import half_up, r4
from millrace.functions.ordered import first_of
from millrace.functions.rules import as_re2, needed, pack
from millrace.plans.registry import query
from millrace.sources.advisories import REGISTRIES
from millrace.sources.fixtures import cte, literal, table
from millrace.sources.lake import Lake

_FILES = f"WITH {cte('code')}, src AS (SELECT repo, path, content FROM code UNION ALL SELECT repo, path, coalesce(content, '') FROM files)"
_PACK = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in pack())
_HITS = f"""{_FILES}, rules(family, rule, severity, confidence, pattern) AS (VALUES {_PACK}),
hits AS (SELECT repo, path, family, rule, CASE WHEN confidence < .55 THEN 'low' WHEN confidence < .7 AND severity = 'critical' THEN 'high' ELSE severity END AS severity,
  CAST(len(regexp_extract_all(content, pattern)) AS INT) AS n FROM src, rules WHERE regexp_matches(content, pattern) AND NOT (path LIKE '%.test.%'))"""


def sources(lake: Lake) -> DataFrame:
    """``(repo, path, content)`` of the inline tree and of the whole corpus; a null text is an empty one."""
    corpus = lake.files.select("repo", "path", F.coalesce("content", F.lit("")).alias("content"))
    return table(lake.spark, "code").unionByName(corpus)


def _worth(pattern: str) -> Column:
    """Whether a text holds the words that the pattern can't match without: most texts hold none, and a search for a
    word costs little beside a pattern."""
    low, lists = needed(pattern)
    text, out = F.col("low" if low else "content"), F.lit(True)
    for words in lists:
        one = F.lit(False)
        for w in words:
            one = one | F.contains(text, F.lit(w))
        out = out & one
    return out


def rule_scan(files: DataFrame, rules: list[tuple[str, str, str, float, str]]) -> DataFrame:
    """``(repo, path, family, rule, severity, n)`` of every rule that a file matches. The rules are fixed columns of
    one pass over the files, not rows that the files are crossed with; a count is only made where there is a match."""
    text = F.col("content")

    def hit(family: str, rule: str, severity: str, confidence: float, pattern: str) -> Column:
        level = "low" if confidence < 0.55 else "high" if confidence < 0.7 and severity == "critical" else severity
        row = F.struct(F.lit(family).alias("family"), F.lit(rule).alias("rule"), F.lit(level).alias("severity"), F.regexp_count(text, F.lit(as_re2(pattern))).alias("n"))
        return F.when(_worth(pattern) & text.rlike(as_re2(pattern)), row)

    found = F.array_compact(F.array(*[hit(*r) for r in rules]))
    read = files.where(~F.col("path").like("%.test.%")).select("repo", "path", "content", F.lower("content").alias("low"))
    return read.select("repo", "path", F.explode(found).alias("h")).select("repo", "path", "h.*")


@query(f"{_HITS} SELECT * FROM hits", "files")
def rules_x_files(lake: Lake) -> DataFrame:
    return rule_scan(sources(lake), pack())


@query(f"""{_HITS} SELECT family, rule, repo, path FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY repo, path) AS nth FROM hits) WHERE nth <= CASE family WHEN 'performance' THEN 2 ELSE 3 END""", "files")
def rule_hit_cap(lake: Lake) -> DataFrame:
    """The first files of each rule, as the report shows them."""
    h = first_of(rules_x_files(lake), "rule", ["repo", "path"], 3)
    return h.where(F.col("nth") <= F.when(F.col("family") == "performance", 2).otherwise(3)).select("family", "rule", "repo", "path")


@query(f"{_HITS} SELECT repo, family, severity, count(*) AS files, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY ALL", "files")
def finding_counts(lake: Lake) -> DataFrame:
    return rules_x_files(lake).groupBy("repo", "family", "severity").agg(F.count("*").alias("files"), F.sum("n").alias("n"))


@query(f"""{_HITS}, c AS (SELECT repo, count(*) FILTER (family = 'security' AND severity = 'critical') AS c, count(*) FILTER (family = 'security' AND severity = 'high') AS h, count(*) FILTER (family = 'security' AND severity = 'medium') AS m,
count(*) FILTER (family = 'security' AND severity = 'low') AS l FROM hits GROUP BY repo) SELECT repo, c, h, m, l, least(98, greatest(5, 84 - 22 * c - 14 * h - 6 * m - 2 * l)) AS score FROM c""", "files")
def security_score(lake: Lake) -> DataFrame:
    s = rules_x_files(lake)
    n = lambda level: F.count_if((F.col("family") == "security") & (F.col("severity") == level))
    c = s.groupBy("repo").agg(n("critical").alias("c"), n("high").alias("h"), n("medium").alias("m"), n("low").alias("l"))
    score = F.least(F.lit(98), F.greatest(F.lit(5), 84 - 22 * F.col("c") - 14 * F.col("h") - 6 * F.col("m") - 2 * F.col("l")))
    return c.withColumn("score", score)


# import graph

# What an import looks like, and the endings that a specifier may leave out.
_IMPORT = r"""(?:(?m:^)import\s+[^\n]*?\s+from\s+|require\s*\(\s*|import\s*\(\s*)['"]([^'"]+)['"]"""
_ENDING, _INDEX = r"\.(ts|tsx|js|jsx)$", r"/index\.(ts|tsx|js)$"

_UP = "regexp_replace({}, '(^|/)[^/.][^/]*/\\.\\./', '\\1')"
_EDGES = f"""{_FILES}, raw AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, {literal(_IMPORT)}, 1)) AS spec FROM src),
whole AS (SELECT repo, path, CASE WHEN spec LIKE '@/%' OR spec LIKE '~/%' THEN substr(spec, 3) ELSE ltrim(regexp_replace(path, '[^/]*$', '') || spec, '/') END AS place FROM raw WHERE spec LIKE '@/%' OR spec LIKE '~/%' OR spec LIKE './%' OR spec LIKE '../%'),
spec AS (SELECT repo, path, {_UP.format(_UP.format(_UP.format("replace(replace(place, '/./', '/'), '/./', '/')")))} AS stem FROM whole),
stems AS (SELECT repo, path, string_split(unnest(list_distinct([path, regexp_replace(path, '{_ENDING}', ''), regexp_replace(path, '{_INDEX}', '')])), '/') AS parts FROM src),
keys AS (SELECT repo, path, parts, unnest(range(1, len(parts) + 1)) AS i FROM stems),
target AS (SELECT repo, array_to_string(parts[i:], '/') AS stem, arg_min(path, (i > 1, path)) AS target FROM keys GROUP BY ALL),
edges AS (SELECT DISTINCT s.repo, s.path AS importer, target FROM spec s JOIN target t ON t.repo = s.repo AND t.stem = s.stem)"""


def _resolved(path: Column, spec: Column) -> Column:
    """The path that a specifier names: from the root for ``@/`` and ``~/``, else from the importer's folder."""
    parts = F.split(F.concat(F.regexp_replace(path, "[^/]*$", ""), spec), "/")

    def step(acc: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(part.isin(".", ""), acc).otherwise(F.concat(acc, F.array(part)))

    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(spec.rlike("^[@~]/"), F.substr(spec, F.lit(3))).otherwise(F.array_join(walked, "/"))


def imports(lake: Lake) -> DataFrame:
    """``(repo, importer, target)``: relative and root imports, resolved to one file of the repository.

    A file answers to its path, with or without its ending or ``/index.*``, and to every tail of these. Of the files that
    answer to a name the one is taken whose whole path it is, else the first by path: that is settled once for each name
    before the join, so the join makes a row for each import at most, and only paths move."""
    files = sources(lake)
    spec = files.where(F.contains("content", F.lit("import")) | F.contains("content", F.lit("require")))
    spec = spec.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(1)))).alias("spec")).where(F.col("spec").rlike(r"^(@|~|\.\.?)/"))
    stems = F.array_distinct(F.array("path", F.regexp_replace("path", _ENDING, ""), F.regexp_replace("path", _INDEX, "")))
    keys = files.select("repo", "path", F.explode(stems).alias("stem")).select("repo", "path", F.split("stem", "/").alias("parts"))
    tail = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct((i > 1).alias("partial"), F.array_join(F.slice("parts", i, F.size("parts")), "/").alias("stem")))
    named = keys.select("repo", "path", F.explode(tail).alias("t")).groupBy("repo", "t.stem").agg(F.min(F.struct("t.partial", "path"))["path"].alias("target"))
    asked = spec.select("repo", F.col("path").alias("importer"), _resolved(F.col("path"), F.col("spec")).alias("stem")).distinct()
    return asked.join(named, ["repo", "stem"]).select("repo", "importer", "target").distinct()


@query(f"{_EDGES} SELECT * FROM edges", "files")
def import_resolve(lake: Lake) -> DataFrame:
    return imports(lake)


@query(f"{_EDGES} SELECT e.repo, e.importer, count(*) AS imports, count(b.importer) AS cycles, CASE WHEN count(*) > 20 THEN 'high' WHEN count(*) > 12 THEN 'medium' ELSE 'low' END AS risk FROM edges e LEFT JOIN edges b ON b.repo = e.repo AND b.importer = e.target AND b.target = e.importer GROUP BY ALL", "files")
def coupling(lake: Lake) -> DataFrame:
    """Imports of each file, and how many of them import it in turn."""
    edges = imports(lake)
    back = edges.select("repo", F.col("target").alias("importer"), F.col("importer").alias("target"), F.lit(True).alias("back"))
    n = F.count("*")
    return edges.join(back, ["repo", "importer", "target"], "left").groupBy("repo", "importer").agg(n.alias("imports"), F.count("back").alias("cycles"), F.when(n > 20, "high").when(n > 12, "medium").otherwise("low").alias("risk"))


# What a file does, as patterns of its text.
MARKS = {
    "raw": r"req\.(json|body)",
    "checked": "(?i)valid|parse|schema",
    "queries": "(?i)prisma|query",
    "orm": "(?i)prisma",
    "mutates": "function (POST|PUT|DELETE)",
    "guarded": "(?i)auth|session",
    "server_env": r"process\.env\.",
    "client": "use client",
    "quiet": "catch *([(][^)]*[)])? *[{] *[}]",
    "shared": "export let",
    "writes": r"state[.]\w+ *[+-]?=",
}
_MARKED = f"{_EDGES}, m AS (SELECT repo, path, {', '.join(f'regexp_matches(content, {literal(p)}) AS {n}' for n, p in MARKS.items())} FROM src)"


def marked(lake: Lake, wanted: str, role: str) -> DataFrame:
    """``(repo, role)``: the files whose marks fit a condition. Texts stay behind; the joins move paths."""
    marks = [F.col("content").rlike(p).alias(n) for n, p in MARKS.items()]
    return sources(lake).select("repo", F.col("path").alias(role), *marks).where(wanted).select("repo", role)


@query(f"{_MARKED} SELECT e.repo, importer, min(target) AS target FROM edges e JOIN m a ON a.path = importer AND a.repo = e.repo JOIN m b ON b.path = target AND b.repo = e.repo WHERE a.raw AND NOT a.checked AND b.queries AND NOT b.checked GROUP BY ALL", "files")
def xfile_unvalidated_input(lake: Lake) -> DataFrame:
    """Raw request input that reaches a database file with no check in either; the first target of each file."""
    met = imports(lake).join(marked(lake, "raw and not checked", "importer"), ["repo", "importer"], "left_semi")
    met = met.join(marked(lake, "queries and not checked", "target"), ["repo", "target"], "left_semi")
    return met.groupBy("repo", "importer").agg(F.min("target").alias("target"))


@query(f"{_MARKED} SELECT e.repo, importer, target FROM edges e JOIN m a ON a.path = importer AND a.repo = e.repo JOIN m b ON b.path = target AND b.repo = e.repo WHERE a.mutates AND NOT a.guarded AND b.orm", "files")
def xfile_auth_bypass(lake: Lake) -> DataFrame:
    met = imports(lake).join(marked(lake, "mutates and not guarded", "importer"), ["repo", "importer"], "left_semi")
    return met.join(marked(lake, "orm", "target"), ["repo", "target"], "left_semi").select("repo", "importer", "target")


@query(f"{_MARKED} SELECT repo, path FROM m WHERE server_env AND EXISTS (SELECT 1 FROM edges e JOIN m i ON i.path = importer AND i.repo = e.repo WHERE e.target = m.path AND e.repo = m.repo AND i.client)", "files")
def xfile_server_env_client(lake: Lake) -> DataFrame:
    """Files that read the environment and are imported by a client component."""
    used = imports(lake).join(marked(lake, "client", "importer"), ["repo", "importer"], "left_semi")
    return marked(lake, "server_env", "path").join(used.select("repo", F.col("target").alias("path")), ["repo", "path"], "left_semi")


@query(f"{_MARKED}, k AS (SELECT repo, target, importer, row_number() OVER (PARTITION BY repo, target ORDER BY importer) AS nth FROM edges) SELECT m.repo, path, string_agg(importer, ',' ORDER BY importer) AS callers FROM m JOIN k ON k.repo = m.repo AND target = path WHERE nth <= 3 AND quiet GROUP BY ALL", "files")
def xfile_silent_failure(lake: Lake) -> DataFrame:
    """Files that swallow errors, with up to three of their callers."""
    by = Window.partitionBy("repo", "target").orderBy("importer")
    called = imports(lake).join(marked(lake, "quiet", "target"), ["repo", "target"], "left_semi")
    met = called.withColumn("nth", F.row_number().over(by)).where("nth <= 3")
    return met.groupBy("repo", F.col("target").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("importer")), ",").alias("callers"))


@query(f"{_MARKED} SELECT m.repo, m.path, count(DISTINCT importer) AS n FROM m JOIN edges e ON e.repo = m.repo AND target = m.path JOIN m i ON i.path = importer AND i.repo = e.repo WHERE m.shared AND i.writes GROUP BY ALL HAVING count(DISTINCT importer) >= 2", "files")
def xfile_shared_mutable(lake: Lake) -> DataFrame:
    """Files that export a binding which two or more of their importers change."""
    met = imports(lake).join(marked(lake, "shared", "target"), ["repo", "target"], "left_semi").join(marked(lake, "writes", "importer"), ["repo", "importer"], "left_semi")
    return met.groupBy("repo", F.col("target").alias("path")).agg(F.count("*").alias("n")).where("n >= 2")  # edges are distinct


# audits of source files

_WORDS = r"\b(if|for|while|case|catch)\b|&&|\|\|"


@query(rf"{_FILES}, c AS (SELECT repo, path, CAST(1 + len(regexp_extract_all(content, '{_WORDS}')) AS INT) AS cyclomatic FROM src) SELECT repo, path, cyclomatic, CASE WHEN cyclomatic > 20 THEN 'critical' WHEN cyclomatic > 10 THEN 'high' WHEN cyclomatic > 5 THEN 'medium' ELSE 'low' END AS risk FROM c", "files")
def complexity(lake: Lake) -> DataFrame:
    n = 1 + F.regexp_count("content", F.lit(as_re2(_WORDS)))
    return sources(lake).select("repo", "path", n.alias("cyclomatic"), F.when(n > 20, "critical").when(n > 10, "high").when(n > 5, "medium").otherwise("low").alias("risk"))


_LINES = f"{_FILES}, l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src)"


@query(rf"""{_LINES}, c AS (SELECT *, len(regexp_extract_all(line, '\b(if|for|while|switch|catch)\b')) AS branches, len(line) - len(replace(line, '{{', '')) - len(line) + len(replace(line, '}}', '')) AS d FROM l),
s AS (SELECT *, sum(d) OVER w AS level FROM c WINDOW w AS (PARTITION BY repo, path ORDER BY i)),
m AS (SELECT *, level - least(0, min(level) OVER (PARTITION BY repo, path ORDER BY i)) AS depth FROM s),
b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY repo, path ORDER BY i), 0) AS before FROM m)
SELECT repo, path, CAST(sum(branches * (1 + before)) AS INT) AS cognitive FROM b GROUP BY ALL""", "files")
def cognitive_complexity(lake: Lake) -> DataFrame:
    """A fold over the lines: each branch counts one more than the braces it stands in."""
    lines = F.split("content", "\n")

    def step(acc: Column, line: Column) -> Column:
        branches = F.regexp_count(line, F.lit(as_re2(r"\b(if|for|while|switch|catch)\b")))
        depth = acc["depth"] + F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))
        return F.struct((acc["score"] + branches * (1 + acc["depth"])).alias("score"), F.greatest(F.lit(0), depth).alias("depth"))

    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("depth"))
    score = F.aggregate(lines, start, step, lambda acc: acc["score"])
    return sources(lake).select("repo", "path", score.alias("cognitive"))


@query(rf"""{_LINES}, c AS (SELECT repo, path, i, trim(line, ' ') AS bare, contains(line, '/*') AS opens, contains(line, '*/') AS closes FROM l),
o AS (SELECT *, coalesce(last_value(CASE WHEN closes THEN FALSE WHEN opens THEN TRUE END IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS inside FROM c)
SELECT repo, path, CAST(count(*) FILTER (NOT (inside OR opens OR bare = '' OR regexp_matches(bare, '^(//|#|import\b|from\b)'))) AS INT) AS lines FROM o GROUP BY ALL""", "files")
def strip_non_executable(lake: Lake) -> DataFrame:
    """Lines of code without comment lines, block comments and imports: a fold that remembers an open comment."""
    lines = F.split("content", "\n")

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        opens, closes = F.contains(bare, F.lit("/*")), F.contains(bare, F.lit("*/"))
        skip = acc["inside"] | opens | bare.rlike(r"^(//|#|import\b|from\b)") | (bare == "")
        return F.struct(F.when(skip, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"), ((acc["inside"] | opens) & ~closes).alias("inside"))

    start = F.struct(F.lit(0).alias("kept"), F.lit(False).alias("inside"))
    return sources(lake).select("repo", "path", F.aggregate(lines, start, step, lambda a: a["kept"]).alias("lines"))


# The methods of a route; a handler's text goes from its head to the next one's.
_HANDLER = r"(?:async )?function (GET|POST|PUT|PATCH|DELETE)\b"
#: Words, in calls or names, of who may and of what is let in.
_ALLOWED, _CHECKED = r"(?i)\b(auth\w*|session\w*|requireUser|currentUser|permission\w*)\b", r"(?i)(\b\w*schema\w*|valid(ate|ator|ated)?|safeParse|\bparse)\b"


@query(rf"""{_FILES}, h AS (SELECT repo, path, unnest(regexp_extract_all(content, {literal(_HANDLER)}, 1)) AS method, unnest(string_split_regex(content, {literal(_HANDLER)})[2:]) AS body FROM src WHERE path LIKE '%/api/%' OR path LIKE 'api/%')
SELECT repo, path, method, regexp_matches(body, {literal(_ALLOWED)}) AS auth, regexp_matches(body, {literal(_CHECKED)}) AS validated,
  method <> 'GET' AND NOT (regexp_matches(body, {literal(_ALLOWED)}) AND regexp_matches(body, {literal(_CHECKED)})) AS open FROM h""", "files")
def route_audit(lake: Lake) -> DataFrame:
    """``(repo, path, method, auth, validated, open)`` of each handler: what its own text asks of a request, and whether one
    that changes things lacks either."""
    routes = sources(lake).where(F.col("path").like("%/api/%") | F.col("path").like("api/%"))
    methods, bodies = F.regexp_extract_all("content", F.lit(_HANDLER), F.lit(1)), F.split("content", _HANDLER)
    pairs = F.arrays_zip(methods.alias("method"), F.slice(bodies, 2, F.size(bodies)).alias("body"))
    h = routes.select("repo", "path", F.explode(pairs).alias("h")).select("repo", "path", "h.*")
    auth, checked = F.col("body").rlike(_ALLOWED), F.col("body").rlike(_CHECKED)
    return h.select("repo", "path", "method", auth.alias("auth"), checked.alias("validated"), ((F.col("method") != "GET") & ~(auth & checked)).alias("open"))


#: Success criteria of the Web Content Accessibility Guidelines that markup alone can miss: (criterion, elements or none for any,
#: what the attributes must hold, what they must not).
CRITERIA = [
    ("1.1.1 picture without words", "img area", None, r"(?i)\b(alt|aria-label|aria-labelledby)\s*=|role=.(none|presentation)"),
    ("1.4.2 sound that starts alone", "audio video", r"(?i)\bautoplay\b", r"(?i)\bmuted\b"),
    ("2.1.1 pointer needed", "div span li td p section", r"(?i)\bonclick\s*=", r"(?i)\b(onkeydown|onkeyup|onkeypress|role)\s*="),
    ("2.2.2 moving text", "marquee blink", None, None),
    ("2.4.3 order set by number", "", r"(?i)\btabindex=\W*[1-9]", None),
    ("3.1.1 page without language", "html", None, r"(?i)\blang\s*="),
    ("3.3.2 field without label", "input select textarea", None, r"(?i)\b(id|title|aria-label|aria-labelledby)\s*=|type=.(hidden|submit|reset|button)"),
    ("4.1.2 frame without title", "iframe frame", None, r"(?i)\btitle\s*="),
    ("4.1.2 hidden control", "a button input select textarea", r"(?i)\baria-hidden=\W*true", r"(?i)\btabindex=\W*-1"),
]
#: An element's start: its name and attributes, in which an arrow function's sign does not end it.
_START = "<([A-Za-z][A-Za-z0-9.]*)([^<>]*(?:=>[^<>]*)*)>"
#: A button with nothing but markup inside; group 1 is its attributes.
_BARE = r"(?i)<button\b([^<>]*(?:=>[^<>]*)*)>\s*(?:<[^<>]*>\s*)*</button>"
_NAMED = r"(?i)\b(title|aria-label|aria-labelledby)\s*="
_A11Y = ", ".join(
    f"('{name}', len(list_filter(e, lambda x: " + " AND ".join(["TRUE"] + [f"list_contains([{', '.join(f"'{n}'" for n in of.split())}], lower(x[1]))"] * bool(of) + [f"regexp_matches(x[2], {literal(has)})"] * bool(has) + [f"NOT regexp_matches(x[2], {literal(unless)})"] * bool(unless)) + ")))"
    for name, of, has, unless in CRITERIA
)


@query(f"""{_FILES}, e AS (SELECT repo, path, content, list_zip(regexp_extract_all(content, {literal(_START)}, 1), regexp_extract_all(content, {literal(_START)}, 2)) AS e FROM src WHERE contains(content, '<')),
i AS (SELECT repo, path, unnest([{_A11Y}, ('4.1.2 button without words', len(list_filter(regexp_extract_all(content, {literal(_BARE)}, 1), lambda x: NOT regexp_matches(x, {literal(_NAMED)}))))]) AS i FROM e) SELECT repo, path, i[1] AS issue, CAST(i[2] AS INT) AS n FROM i WHERE i[2] > 0""", "files")
def a11y_audit(lake: Lake) -> DataFrame:
    """``(repo, path, issue, n)``: elements of a file that fail a success criterion. Each file's elements are read once."""
    name, attributes = (F.regexp_extract_all("content", F.lit(_START), F.lit(i)) for i in (1, 2))
    elements = F.zip_with(name, attributes, lambda x, y: F.struct(F.lower(x).alias("name"), y.alias("of")))

    def row(issue: str, n: Column) -> Column:
        return F.struct(F.lit(issue).alias("issue"), n.alias("n"))

    def failing(of: str, has: str | None, unless: str | None) -> Column:
        def fails(x: Column) -> Column:
            out = x["name"].isin(of.split()) if of else F.lit(True)
            out = out & x["of"].rlike(has) if has else out
            return out & ~x["of"].rlike(unless) if unless else out

        return F.size(F.filter("e", fails))

    bare = F.size(F.filter(F.regexp_extract_all("content", F.lit(_BARE), F.lit(1)), lambda x: ~x.rlike(_NAMED)))
    rows = [row(issue, failing(*of)) for issue, *of in CRITERIA] + [row("4.1.2 button without words", bare)]
    files = sources(lake).where(F.contains("content", F.lit("<"))).select("repo", "path", "content", elements.alias("e"))
    return files.select("repo", "path", F.explode(F.array(*rows)).alias("i")).select("repo", "path", "i.*").where("n > 0")


@query(rf"""{_FILES}, used AS (SELECT repo, name, bool_or(client) AS client FROM (SELECT repo, contains(content, 'use client') AS client, unnest(regexp_extract_all(content, 'process\.env\.([A-Z_]+)', 1)) AS name FROM src) GROUP BY ALL),
declared AS (SELECT DISTINCT repo, unnest(regexp_extract_all(content, '(?m)^([A-Z_]+)=', 1)) AS name FROM src WHERE path LIKE '.env%')
SELECT u.repo, u.name, d.name IS NOT NULL AS declared, client AND NOT regexp_matches(u.name, '^(NEXT_)?PUBLIC_') AS client_secret FROM used u LEFT JOIN declared d USING (repo, name)""", "files")
def env_audit(lake: Lake) -> DataFrame:
    """Variables of the environment that code reads: whether an example file declares them, and whether a client component
    reads one that is not public."""
    files = sources(lake)
    names = lambda df, p, *more: df.select("repo", *more, F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("name"))
    declared = names(files.where(F.col("path").like(".env%")), "(?m)^([A-Z_]+)=").distinct().withColumn("declared", F.lit(True))
    used = names(files, r"process\.env\.([A-Z_]+)", F.contains("content", F.lit("use client")).alias("client")).groupBy("repo", "name").agg(F.bool_or("client").alias("client"))
    secret = F.col("client") & ~F.col("name").rlike("^(NEXT_)?PUBLIC_")
    return used.join(declared, ["repo", "name"], "left").select("repo", "name", F.coalesce("declared", F.lit(False)).alias("declared"), secret.alias("client_secret"))


@query(rf"""{_FILES}, x AS (SELECT DISTINCT repo, unnest(regexp_extract_all(content, 'export (?:async )?(?:function|const|let) (\w+)', 1)) AS name FROM src WHERE path NOT LIKE '%.test.%'),
t AS (SELECT DISTINCT repo, unnest(regexp_extract_all(content, '\w+')) AS name FROM src WHERE path LIKE '%.test.%'),
n AS (SELECT x.repo, count(*) AS exported, count(t.name) AS tested FROM x LEFT JOIN t ON t.repo = x.repo AND t.name = x.name GROUP BY ALL)
SELECT *, round(tested / exported * 100, 4) AS share, CASE WHEN tested < .3 * exported THEN 'critical' WHEN tested < .6 * exported THEN 'high' WHEN tested < .8 * exported THEN 'medium' ELSE 'low' END AS risk FROM n""", "files")
def export_test_coverage(lake: Lake) -> DataFrame:
    """Exported names, and those that a test file mentions. Tests are split into words, so the join is on equal names."""
    code, test = sources(lake), F.col("path").like("%.test.%")
    names = code.where(~test).select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"export (?:async )?(?:function|const|let) (\w+)"), F.lit(1))).alias("name")).distinct()
    said = code.where(test).select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0))).alias("name")).distinct().withColumn("tested", F.lit(True))
    n = names.join(said, ["repo", "name"], "left").groupBy("repo").agg(F.count("*").alias("exported"), F.count("tested").alias("tested"))
    under = lambda x: F.col("tested") < x * F.col("exported")
    share = r4(F.col("tested") / F.col("exported") * 100)
    return n.withColumn("share", share).withColumn("risk", F.when(under(0.3), "critical").when(under(0.6), "high").when(under(0.8), "medium").otherwise("low"))


# The test framework that a file at the root, a package or a word of requirements.txt stands for.
CONFIGS = {
    "jest.config.js": "Jest", "jest.config.ts": "Jest", "vitest.config.ts": "Vitest", "vitest.config.js": "Vitest", ".nycrc": "nyc", "codecov.yml": "Codecov",
    ".codecov.yml": "Codecov", "pytest.ini": "pytest", "setup.cfg": "pytest", ".coveragerc": "coverage.py", "go.mod": "go test",
}
RUNNERS = {"jest": "Jest", "vitest": "Vitest", "mocha": "Mocha", "jasmine": "Jasmine", "ava": "Ava", "tap": "Tap", "c8": "c8", "nyc": "nyc"}
REQUIRED = {"pytest": "pytest", "coverage": "coverage.py", "nose": "nose"}


# manifests

# The grammar of each manifest that is read by pattern; group 1 is the package, group 2 its version.
_MANIFESTS = {
    "requirements.txt": r"(?m)^([A-Za-z][A-Za-z0-9_.-]*)(?:[=<>~!]=([0-9.]+))?",
    "go.mod": r"(?m)^\t([^ \n]+) v([0-9.]+)",
    "Cargo.toml": r'(?m)^([a-z][a-z0-9_-]*) = (?:\{ version = )?"([0-9.]+)"',
    "Gemfile": r"""(?m)^gem ['"]([a-z_-]+)['"](?:, ['"]([0-9.]+)['"])?""",
    "pom.xml": r"<artifactId>([^<]+)</artifactId>(?:<version>([^<]*)</version>)?",
}
MANIFESTS = f"{cte('manifests').replace('manifests(', 'inline_manifests(', 1)}, manifests AS (SELECT * FROM inline_manifests UNION ALL SELECT repo, file, content FROM landed)"
DEPS = f"""WITH {cte('code')}, {MANIFESTS},
npm AS (SELECT repo, content FROM manifests WHERE file = 'package.json' AND json_valid(content)),
kept AS (SELECT repo, unnest(json_keys(content, '$.dependencies')) AS lib, content, 'dependencies' AS part FROM npm UNION ALL SELECT repo, unnest(json_keys(content, '$.devDependencies')), content, 'devDependencies' FROM npm),
named AS (SELECT repo, lib, json_extract_string(content, '$.' || part || '."' || lib || '"') AS version FROM kept WHERE part = 'dependencies' OR NOT coalesce(list_contains(json_keys(content, '$.dependencies'), lib), FALSE)),
read AS ({' UNION ALL '.join(f"SELECT repo, '{REGISTRIES[f]}' AS registry, unnest(list_zip(regexp_extract_all(content, {literal(p)}, 1), regexp_extract_all(content, {literal(p)}, 2))) AS d FROM manifests WHERE file = '{f}'" for f, p in _MANIFESTS.items())}),
deps AS (SELECT repo, lib, version, 'npm' AS registry FROM named UNION ALL SELECT repo, d[1], nullif(d[2], ''), registry FROM read)"""


def manifests(lake: Lake) -> DataFrame:
    """``(repo, file, content)`` of the inline manifests and of those that the landed tables name."""
    return table(lake.spark, "manifests").unionByName(lake.landed)


def above(x: Column, version: Column) -> Column:
    """Whether the dotted number in ``x`` is later than that in ``version``; not if there is no version."""
    return F.coalesce(_parts(x) > _parts(version), F.lit(False))


def _parts(x: Column) -> Column:
    parts = F.split(F.regexp_extract(x, "[0-9][0-9.]*", 0), r"\.")
    return F.when(x.isNotNull(), F.array(*[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(4)]))


def above_sql(x: str, version: str) -> str:
    parts = lambda v: "[" + ", ".join(f"coalesce(try_cast(list_extract(string_split(regexp_extract({v}, '[0-9][0-9.]*'), '.'), {i}) AS INT), 0)" for i in range(1, 5)) + "]"
    return f"({version} IS NOT NULL AND {parts(x)} > {parts(version)})"


def dependencies(lake: Lake, cap: int = 40) -> DataFrame:
    """``(repo, lib, version, registry)`` of each manifest by its own grammar. Broken manifests give no rows."""
    m, c = manifests(lake), F.col("content")
    parsed = F.from_json(c, "dependencies map<string,string>, devDependencies map<string,string>")
    both = F.map_concat(F.coalesce(parsed["dependencies"], F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce(parsed["devDependencies"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(parsed["dependencies"], k), F.lit(False))))
    pair = lambda name, version: F.struct(name.alias("lib"), version.alias("version"))

    def by_regex(pattern: str) -> Column:
        lib, version = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
        return F.zip_with(lib, version, lambda a, b: pair(a, F.nullif(b, F.lit(""))))

    found = F.when(F.col("file") == "package.json", F.transform(F.map_entries(both), lambda e: pair(e["key"], e["value"])))
    for file, pattern in _MANIFESTS.items():
        found = found.when(F.col("file") == file, by_regex(pattern))
    registry = F.create_map(*[F.lit(x) for pair in REGISTRIES.items() for x in pair])[F.col("file")].alias("registry")
    return m.select("repo", registry, F.explode(F.slice(found, 1, cap)).alias("d")).select("repo", "d.*", "registry")


@query(f"{DEPS} SELECT repo, lib, version FROM deps", "landed")
def manifest_parse(lake: Lake) -> DataFrame:
    return dependencies(lake).drop("registry")


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(f"""{DEPS}, src AS (SELECT repo, path FROM code UNION ALL SELECT repo, path FROM files), found AS (SELECT repo, path AS config, {_case('path', CONFIGS)} AS framework FROM src
UNION ALL SELECT repo, file, {_case('file', CONFIGS)} FROM manifests UNION ALL SELECT repo, NULL, {_case('lib', RUNNERS)} FROM deps
UNION ALL SELECT repo, NULL, unnest([{', '.join(f"CASE WHEN contains(content, '{k}') THEN '{v}' END" for k, v in REQUIRED.items())}]) FROM manifests WHERE file = 'requirements.txt')
SELECT repo, array_to_string(list_sort(list(DISTINCT framework)), ',') AS frameworks, count(DISTINCT config) AS configs FROM found WHERE framework IS NOT NULL GROUP BY repo""", "files", "landed")
def framework_detect(lake: Lake) -> DataFrame:
    """Test frameworks of each repository that has any, from files at its root and from its manifests."""
    m, none = manifests(lake), F.lit(None).cast("string")
    files = sources(lake).select("repo", F.col("path").alias("config")).unionByName(m.select("repo", F.col("file").alias("config")))
    by_file = files.select("repo", "config", F.expr(_case("config", CONFIGS)).alias("framework"))
    by_lib = dependencies(lake).select("repo", none.alias("config"), F.expr(_case("lib", RUNNERS)).alias("framework"))
    words = F.array(*[F.when(F.contains("content", F.lit(k)), v) for k, v in REQUIRED.items()])
    by_word = m.where(F.col("file") == "requirements.txt").select("repo", none.alias("config"), F.explode(words).alias("framework"))
    found = by_file.unionByName(by_lib).unionByName(by_word).where("framework is not null")
    return found.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"), F.count_distinct("config").alias("configs"))


#: Vulnerabilities of parts: a stated level, a score, a vector, or nothing.
_VULNERABLE = """v AS (SELECT CAST(id AS VARCHAR) AS id, severity, cvss FROM osv_inline UNION ALL
SELECT 'P' || p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'moderate' WHEN 2 THEN 'Critical' WHEN 3 THEN 'unheard' END,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CVSS:3.1/AV:N' ELSE (p_size % 10) || '.' || (p_partkey % 10) END FROM part)"""
_OSV = f"WITH {cte('osv').replace('osv(', 'osv_inline(', 1)}, {_VULNERABLE}"


def vulnerabilities(lake: Lake) -> DataFrame:
    """``(id, severity, cvss)`` of the inline vulnerabilities and of every part."""
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    level = F.when(key % 6 == 0, "HIGH").when(key % 6 == 1, "moderate").when(key % 6 == 2, "Critical").when(key % 6 == 3, "unheard")
    score = F.when(key % 5 == 0, none).when(key % 5 == 1, "CVSS:3.1/AV:N").otherwise(F.concat(F.col("p_size") % 10, F.lit("."), key % 10))
    parts = lake.table("part").select(F.concat(F.lit("P"), key).alias("id"), level.alias("severity"), score.alias("cvss"))
    return table(lake.spark, "osv").unionByName(parts)


@query(f"""{_OSV} SELECT id, CASE WHEN lower(severity) IN ('critical', 'high', 'medium', 'low') THEN lower(severity) WHEN lower(severity) = 'moderate' THEN 'medium' WHEN cvss IS NULL THEN 'medium'
WHEN try_cast(cvss AS DOUBLE) >= 9 THEN 'critical' WHEN try_cast(cvss AS DOUBLE) >= 7 THEN 'high' WHEN try_cast(cvss AS DOUBLE) >= 4 THEN 'medium' ELSE 'low' END AS level FROM v""")
def osv_severity(lake: Lake) -> DataFrame:
    """The stated level, else the score's band; a vector string is no number and counts as low."""
    s, x = F.lower("severity"), F.col("cvss").try_cast("double")
    level = F.when(s.isin("critical", "high", "medium", "low"), s).when(s == "moderate", "medium").when(F.col("cvss").isNull(), "medium").when(x >= 9, "critical").when(x >= 7, "high").when(x >= 4, "medium").otherwise("low")
    return vulnerabilities(lake).select("id", level.alias("level"))


@query(f"{_OSV}, x AS (SELECT try_cast(cvss AS DOUBLE) AS x FROM v) SELECT count(*) FILTER (x >= 9) AS critical, count(*) FILTER (x >= 7 AND x < 9) AS high, count(*) FILTER (x >= 4 AND x < 7) AS medium, count(*) FILTER (x < 4) AS low FROM x")
def dep_risk_counts(lake: Lake) -> DataFrame:
    x = F.col("cvss").try_cast("double")
    return vulnerabilities(lake).agg(F.count_if(x >= 9).alias("critical"), F.count_if((x >= 7) & (x < 9)).alias("high"), F.count_if((x >= 4) & (x < 7)).alias("medium"), F.count_if(x < 4).alias("low"))


# strings and versions


def fuzzy_score(q: Column, t: Column) -> Column:
    """Sum of 1 / (place + 1) over the signs of ``q`` found in order in ``t``, places counted from 0; 0 if one is missing, 1 if ``q`` is empty."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        found = F.call_function("locate", ch, t, acc["at"] + 1)
        ok = acc["ok"] & (found > 0)
        return F.struct(F.when(ok, found).otherwise(acc["at"]).alias("at"), F.when(ok, acc["score"] + 1 / found).otherwise(acc["score"]).alias("score"), ok.alias("ok"))

    signs = F.filter(F.split(q, ""), lambda c: c != "")
    score = F.aggregate(signs, start, step, lambda acc: F.when(acc["ok"], acc["score"]).otherwise(0.0))
    return F.when(q == "", 1.0).otherwise(score)


@query(None)
def fuzzy_match(lake: Lake) -> DataFrame:
    n = table(lake.spark, "names")
    return n.select("q", "t", r4(fuzzy_score(F.lower("q"), F.lower("t"))).alias("score"))


@query(None)
def fuzzy_sort(lake: Lake, asked: tuple[str, ...] = ("wid", "smlt", "LB"), most: int = 20) -> DataFrame:
    """``(q, id, name, score, nth)``: for each query the parts whose name holds its signs in order, best first."""
    names = lake.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    met = names.select("*", F.explode(F.array(*map(F.lit, asked))).alias("q"))
    found = met.withColumn("score", r4(fuzzy_score(F.lower("q"), F.lower("name")))).where(F.col("score") > 0).withColumn("less", -F.col("score"))
    return first_of(found, "q", ["less", "name", "id"], most).select("q", "id", "name", "score", "nth")


@query(f"""WITH {cte('numbers').replace('numbers(', 'inline(', 1)}, numbers AS (SELECT CAST(x AS BIGINT) AS x FROM inline UNION ALL SELECT CAST(floor(o_totalprice) AS BIGINT) * (1 + o_orderkey % 9) FROM orders)
SELECT x, CASE WHEN x >= 1000000 THEN printf('%.1fM', floor(x / 100000.0 + .5) / 10) WHEN x >= 1000 THEN printf('%.1fk', floor(x / 100.0 + .5) / 10) ELSE CAST(x AS VARCHAR) END AS text FROM numbers""")
def format_number(lake: Lake) -> DataFrame:
    """Sums of orders, and odd numbers, in short."""
    x = F.col("x")
    short = lambda by, unit: F.format_string("%.1f" + unit, half_up(x / by, 1))
    sums = lake.table("orders").select((F.floor("o_totalprice").cast("long") * (1 + F.col("o_orderkey") % 9)).alias("x"))
    every = table(lake.spark, "numbers").select(x.cast("long").alias("x")).unionByName(sums)
    return every.select("x", F.when(x >= 1_000_000, short(1e6, "M")).when(x >= 1000, short(1e3, "k")).otherwise(x.cast("string")).alias("text"))


# versions of packages against the first one without a flaw, and odd ones
_PAIRS = f"""{DEPS}, {cte('advisories')}, {cte('versions').replace('versions(', 'inline_versions(', 1)},
versions AS (SELECT a, b FROM inline_versions UNION ALL SELECT version, fixed FROM deps JOIN advisories USING (lib, registry) WHERE version IS NOT NULL)"""


def version_pairs(lake: Lake) -> DataFrame:
    """``(a, b)``: the version of each dependency that an advisory names, and the first without the flaw."""
    met = dependencies(lake).join(F.broadcast(table(lake.spark, "advisories")), ["lib", "registry"]).where("version is not null")
    return table(lake.spark, "versions").unionByName(met.select(F.col("version").alias("a"), F.col("fixed").alias("b")))


_PART = "coalesce(try_cast(list_extract(string_split(regexp_replace({v}, '^[^0-9]*', ''), '.'), {i}) AS INT), 0)"
_KEY = lambda v: "[" + ", ".join(_PART.format(v=v, i=i) for i in (1, 2, 3)) + "]"


@query(f"{_PAIRS} SELECT a, b, CASE WHEN {_KEY('a')} > {_KEY('b')} THEN 1 WHEN {_KEY('a')} < {_KEY('b')} THEN -1 ELSE 0 END AS sign FROM versions", "landed")
def compare_versions(lake: Lake) -> DataFrame:
    """Dotted versions by number, part by part; missing parts are 0."""

    def key(v: str) -> Column:
        parts = F.split(F.regexp_replace(v, "^[^0-9]*", ""), r"\.")
        return F.array(*[F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in (1, 2, 3)])

    return version_pairs(lake).select("a", "b", F.when(key("a") > key("b"), 1).when(key("a") < key("b"), -1).otherwise(0).alias("sign"))


@query("SELECT conv_id, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id")
def token_estimate(lake: Lake) -> DataFrame:
    return lake.table("conversations").groupBy("conv_id").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens"), F.count("*").alias("messages"))


@query("""WITH p AS (SELECT *, turn // 2 AS pair FROM conversations), q AS (SELECT conv_id, pair, sum(length(text)) AS n FROM p GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pair DESC) AS after, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) AS nth FROM q)
SELECT p.conv_id, p.turn FROM p JOIN s USING (conv_id, pair) WHERE after <= 1500 OR nth <= 2""")
def prune_messages(lake: Lake, budget: int = 1500, keep: int = 2) -> DataFrame:
    """The newest pairs of turns that fit the budget, and the last ones in any case."""
    p = lake.table("conversations").select("conv_id", "turn", F.expr("turn div 2").alias("pair"), F.length("text").alias("n"))
    q = p.groupBy("conv_id", "pair").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("conv_id").orderBy(F.desc("pair"))
    s = q.select("conv_id", "pair", F.sum("n").over(by).alias("after"), F.row_number().over(by).alias("nth"))
    return p.join(s.where((F.col("after") <= budget) | (F.col("nth") <= keep)), ["conv_id", "pair"], "left_semi").select("conv_id", "turn")


@query("SELECT page_id, regexp_replace(url, '^https?://(www[.])?', '') AS web, sha256(url) AS key FROM pages")
def web_url(lake: Lake) -> DataFrame:
    return lake.table("pages").select("page_id", F.regexp_replace("url", "^https?://(www[.])?", "").alias("web"), F.sha2("url", 256).alias("key"))


@query(rf"WITH n AS (SELECT DISTINCT repo FROM repos) SELECT repo, regexp_matches(repo, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') AS valid FROM n", "repos")
def repo_name_valid(lake: Lake) -> DataFrame:
    return lake.nations.select("repo", F.col("repo").rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$").alias("valid"))
