"""The logical tables of ``lake`` as DuckDB common table expressions."""

from __future__ import annotations

from millrace.sources.advisories import CATALOGUE
from millrace.sources.fixtures import cte

_TABLES = {
    "ev": ("", "SELECT *, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) AS k FROM events"),
    "scans": (
        "ev",
        """SELECT event_id AS id, user_id, 'repo' || (event_id % 20) AS repo, health,
  CAST(least(100, greatest(0, health + k % 11 - 5)) AS INT) AS security, CAST(least(100, greatest(0, health + k % 7 - 3)) AS INT) AS quality,
  CAST(least(100, greatest(0, health + k % 13 - 6)) AS INT) AS performance, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS critical,
  k % 3 AS high, k % 5 AS medium, ts AS created_at
FROM (SELECT *, CAST(least(100, greatest(0, floor(value + 0.5))) AS INT) AS health FROM ev)""",
    ),
    "usage": ("ev", "SELECT event_id AS id, user_id, event_type AS feature, CAST(greatest(1, k) AS BIGINT) AS units, CASE WHEN user_id % 2 = 0 THEN 'free' ELSE 'pro' END AS plan, ts AS created_at FROM ev"),
    "runs": (
        "ev",
        """SELECT event_id AS id, 'repo' || (user_id % 10) AS repo, 'flow' || (k % 8) AS name,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type IN ('purchase', 'view') THEN 'success' END AS conclusion,
  CASE WHEN event_type = 'signup' THEN 'workflow_dispatch' ELSE 'push' END AS event, CASE WHEN user_id % 3 = 0 THEN 'dev' ELSE 'main' END AS branch,
  ts AS started_at, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS updated_at FROM ev""",
    ),
    "user_events": (
        "ev",
        """SELECT event_id AS id, user_id, CASE event_type WHEN 'signup' THEN 'Create' WHEN 'purchase' THEN 'PullRequest' WHEN 'click' THEN 'Push' WHEN 'view' THEN 'Watch' WHEN 'error' THEN 'Issues' END AS type,
  'repo' || (event_id % 20) AS repo, k % 5 AS commits_n, ts AS created_at FROM ev""",
    ),
    "nations": ("", "SELECT n_nationkey AS nation, lower(r_name) AS owner, lower(r_name) || '/' || lower(n_name) AS repo FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "landed": (
        "nations",
        f"""WITH {cte('catalogue')}, {cte('forms')},
used AS (SELECT s_nationkey AS nation, l_partkey % {len(CATALOGUE)} AS k, max(l_partkey) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
named AS (SELECT repo, file, lib, (p % 9) || '.' || (p % 31) || '.' || (p % 13) AS version FROM used JOIN catalogue USING (k) JOIN nations USING (nation) WHERE (k * k + 3 * nation) % 5 < 2)
SELECT repo, file, any_value(head) || replace(array_to_string(list(front || lib || middle || version || back ORDER BY lib), chr(1)), chr(1), any_value(between)) || any_value(foot) AS content FROM named JOIN forms USING (file) GROUP BY repo, file""",
    ),
    "ord": ("nations", "SELECT o.*, c_name, nation, owner, repo FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = nation"),
    "pulls": (
        "ord",
        """SELECT repo, o_orderkey AS number,
  ['feat: ', 'fix(core): ', 'docs: ', 'hotfix ', 'revert: ', 'chore: ', 'feat!: '][o_orderkey % 7 + 1] || 'change ' || o_orderkey AS title,
  c_name AS author, o_custkey % 12 AS author_repos, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, o_orderkey % 11 = 0 AS draft,
  o_orderpriority AS label, CAST(coalesce(additions, 0) AS BIGINT) AS additions, CAST(coalesce(deletions, 0) AS BIGINT) AS deletions,
  coalesce(changed_files, 0) AS changed_files, coalesce(n_reviewers, 0) AS n_reviewers, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN done_at END AS merged_at, CASE WHEN o_orderstatus <> 'O' THEN done_at END AS closed_at
FROM ord LEFT JOIN (
  SELECT l_orderkey, sum(l_quantity) AS additions, sum(l_linenumber) AS deletions, count(*) AS changed_files, count(DISTINCT l_suppkey) AS n_reviewers,
    min(l_shipdate) FILTER (l_shipdate >= o_orderdate) AS done_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    ),
    "commits": ("ord", "SELECT repo, l_orderkey || '-' || l_linenumber AS sha, l_orderkey AS number, s_name AS author, l_shipdate AS authored_at FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"),
    "weeks": (
        "commits",
        """SELECT repo, CAST(51 - ago AS INT) AS week, coalesce(n, 0) AS total
FROM (SELECT repo, unnest(range(0, 52)) AS ago FROM nations) LEFT JOIN (
  SELECT repo, date_diff('day', authored_at::DATE, (SELECT max(l_shipdate) FROM lineitem)::DATE) // 7 AS ago, count(*) AS n FROM commits GROUP BY ALL) USING (repo, ago)""",
    ),
    "contributors": ("ord", "SELECT repo, c_name AS login, count(*) AS contributions FROM ord GROUP BY ALL"),
    "languages": ("", "SELECT source AS repo, lang, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ALL"),
    "files": ("", "SELECT source AS repo, 'src/' || doc_id || '.' || lang AS path, n_chars AS size, text AS content FROM documents"),
    "repos": (
        "ord",
        """SELECT n.nation, n.repo, n.owner, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks, coalesce(watchers, 0) AS watchers,
  coalesce(open_issues, 0) AS open_issues, coalesce(closed_issues, 0) AS closed_issues, coalesce(contributors, 0) AS contributors, created_at, pushed_at, language,
  n.nation % 6 = 5 AS private, n.nation % 7 = 6 AS archived, n.nation % 5 = 4 AS fork, n.nation % 2 = 0 AS has_wiki, n.nation % 3 = 0 AS has_pages,
  n.nation % 5 = 0 AS has_discussions, n.nation % 4 = 0 AS has_projects, CASE WHEN n.nation % 3 <> 0 THEN 'mit' END AS license, n.nation % 4 = 1 AS code_of_conduct
FROM nations n
LEFT JOIN (SELECT nation, count(*) AS stars, count(*) FILTER (o_orderstatus = 'O') AS open_issues, count(*) FILTER (o_orderstatus = 'F') AS closed_issues,
  min(o_orderdate) AS created_at, max(o_orderdate) AS pushed_at, count(DISTINCT o_custkey) AS contributors FROM ord GROUP BY nation) USING (nation)
LEFT JOIN (SELECT c_nationkey AS nation, count(*) AS forks FROM customer GROUP BY 1) USING (nation)
LEFT JOIN (SELECT s_nationkey AS nation, count(*) AS watchers FROM supplier GROUP BY 1) USING (nation)
LEFT JOIN (SELECT nation, c_mktsegment AS language FROM (SELECT c_nationkey AS nation, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS nth
  FROM customer GROUP BY 1, 2) WHERE nth = 1) USING (nation)""",
    ),
}
#: Reference times.
NOW, COMMIT_NOW = "(SELECT max(ts) FROM events)", "(SELECT max(l_shipdate) FROM lineitem)"


def sql(body: str, *tables: str) -> str:
    """``body`` with the logical tables it names, and what they build on, in front. A body that is itself a WITH query
    goes on from there."""
    done: list[str] = []

    def need(name: str) -> None:
        for under in _TABLES[name][0].split():
            need(under)
        if name not in done:
            done.append(name)

    for t in tables:
        need(t)
    if not done:
        return body
    front = ",\n".join(f"{t} AS ({_TABLES[t][1]})" for t in done)
    body = body.strip()
    return f"WITH {front}" + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
