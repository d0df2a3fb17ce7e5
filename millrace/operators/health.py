"""Health and debt of repositories, from what they use and what the rule pack finds in their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions.numbers import clamp, half_up
from millrace.functions.rules import pack
from millrace.operators.text import _HITS, rule_scan, sources
from millrace.operators.trees import ISSUES, TREE, detected
from millrace.plans.registry import query
from millrace.sources.lake import Lake

#: Files of a repository that count for one rule.
CAPS = {"security": 3, "quality": 3, "performance": 2}
_COUNTED = [("security", "critical"), ("security", "high"), ("security", "medium"), ("security", "low"), ("quality", "medium"), ("quality", "low"), ("performance", "high"), ("performance", "medium"), ("performance", "low")]
_GUARDS = ["sign_in", "throttling", "safe_headers", "forgery_guard", "sample_settings"]
_FRONT = f"""{TREE}, texts AS (SELECT repo, path, content FROM code UNION ALL SELECT repo, path, coalesce(content, '') FROM files),
rules({_HITS.split('rules(', 1)[1].replace('FROM src, rules', 'FROM texts, rules')},
capped AS (SELECT repo, family, severity, least(count(*), CASE family WHEN 'performance' THEN 2 ELSE 3 END) AS n FROM hits GROUP BY repo, family, rule, severity),
counted AS (SELECT repo, {', '.join(f"coalesce(sum(n) FILTER (family = '{f}' AND severity = '{s}'), 0) AS {f[:3]}_{s}" for f, s in _COUNTED)} FROM capped GROUP BY repo),
x AS (SELECT d.*, {', '.join(f"CAST(coalesce({f[:3]}_{s}, 0) AS BIGINT) AS {f[:3]}_{s}" for f, s in _COUNTED)} FROM det d LEFT JOIN counted USING (repo))"""

# the sub-scores, the same in both dialects
_IF = lambda flag, yes, no=0: f"(CASE WHEN {flag} THEN {yes} ELSE {no} END)"
_STRUCTURE = " + ".join(_IF(c, 6 if name.startswith("medium") else 2) for name, c in ISSUES.items())
SCORES = {
    "security": (f"84 - 22 * sec_critical - 14 * sec_high - 6 * sec_medium - 2 * sec_low - ({_STRUCTURE}) + least(10, 2 * ({' + '.join(_IF(g, 1) for g in _GUARDS)}))", 5, 98),
    "quality": (f"68 + {_IF('static_types', 8)} + {_IF('linting', 6)} + {_IF('formatting', 3)} + {_IF('unit_tests', 8, -15)} - 5 * qua_medium - 2 * qua_low", 15, 97),
    "testability": (f"{_IF('unit_tests', 50, 5)} + {_IF('pipeline', 18)} + {_IF('browser_tests', 8)} + {_IF('n_tests > 5', 8)} + {_IF('n_tests > 20', 8)}", 5, 97),
    "deps": (f"88 - 8 * n_risky - {_IF('n_deps > 150', 15, _IF('n_deps > 100', 8, _IF('n_deps > 60', 3)))}", 15, 97),
    "performance": ("85 - 12 * per_high - 6 * per_medium - 2 * per_low", 15, 97),
}
WEIGHTS = {"security": 0.28, "quality": 0.22, "testability": 0.22, "deps": 0.18, "performance": 0.1}
_DEBT = f"80 - {_IF('NOT unit_tests', 20)} - {_IF('NOT pipeline', 15)} - 5 * n_risky - 4 * qua_medium - qua_low"
_SUBS = ", ".join(f"CAST(least({hi}, greatest({lo}, {e})) AS BIGINT) AS {n}" for n, (e, lo, hi) in SCORES.items())


def judged(lake: Lake) -> DataFrame:
    """What a repository uses with its findings by family and severity, a rule counted in a few files at most."""
    hits = rule_scan(sources(lake), pack()).groupBy("repo", "family", "rule", "severity").agg(F.count("*").alias("n"))
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])[F.col("family")]
    hits = hits.withColumn("n", F.least("n", cap))
    sums = [F.coalesce(F.sum(F.when((F.col("family") == f) & (F.col("severity") == s), F.col("n"))), F.lit(0)).alias(f"{f[:3]}_{s}") for f, s in _COUNTED]
    counted = hits.groupBy("repo").agg(*sums)
    return detected(lake).join(counted, "repo", "left").fillna(0, [f"{f[:3]}_{s}" for f, s in _COUNTED])


@query(f"""{_FRONT}, y AS (SELECT repo, {_SUBS} FROM x), z AS (SELECT *, CAST(floor({' + '.join(f'{w} * {n}' for n, w in WEIGHTS.items())} + .5) AS BIGINT) AS health FROM y)
SELECT *, CASE WHEN health >= 85 THEN 'A' WHEN health >= 70 THEN 'B' WHEN health >= 55 THEN 'C' WHEN health >= 40 THEN 'D' ELSE 'F' END AS grade FROM z""", "files", "landed")
def health_score(lake: Lake) -> DataFrame:
    """Five sub-scores of each repository, their weighted sum and grade."""
    subs = judged(lake).select("repo", *[clamp(F.expr(e), lo, hi).cast("long").alias(n) for n, (e, lo, hi) in SCORES.items()])
    total = F.lit(0.0)
    for n, w in WEIGHTS.items():
        total = total + w * F.col(n)
    health = F.col("health")
    grade = F.when(health >= 85, "A").when(health >= 70, "B").when(health >= 55, "C").when(health >= 40, "D").otherwise("F")
    return subs.withColumn("health", half_up(total)).withColumn("grade", grade)


@query(f"""{_FRONT}, d AS (SELECT repo, CAST(least(90, greatest(15, {_DEBT})) AS BIGINT) AS debt FROM x)
SELECT repo, debt, CASE WHEN debt >= 70 THEN 'low' WHEN debt >= 50 THEN 'moderate' WHEN debt >= 35 THEN 'high' ELSE 'severe' END AS level FROM d""", "files", "landed")
def tech_debt(lake: Lake) -> DataFrame:
    """What is missing and what is found, as one number; the lower, the more debt."""
    debt = clamp(F.expr(_DEBT), 15, 90).cast("long")
    return judged(lake).select("repo", debt.alias("debt"), F.when(debt >= 70, "low").when(debt >= 50, "moderate").when(debt >= 35, "high").otherwise("severe").alias("level"))
