"""DuckDB SQL for the queries that SQL can express, written for whole tables."""

from __future__ import annotations

from millrace.llm import licenses, secrets, urls


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def op3() -> str:
    literal = lambda x: "NULL" if x is None else _text(x) if isinstance(x, str) else str(x)
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in licenses.templates())
    return rf"""
WITH template(t, label, exact, place, a, b, c, runs, length) AS (VALUES {rows}),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_text(licenses.WORD)}) AS w
  FROM documents),
run AS (SELECT rid, i - 1 AS pos, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM doc, unnest(range(1, len(w))) AS u(i)),
hit AS (SELECT rid, pos, place, pos - place AS diagonal, t, label, exact, runs, length
        FROM run JOIN template ON x = a AND y = b AND (c IS NULL OR c = z)),
phrase AS (SELECT rid, label, diagonal AS first FROM hit WHERE exact = 1 GROUP BY rid, t, label, runs, diagonal HAVING count(*) = runs),
gap AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, t ORDER BY diagonal, pos) > {licenses.GAP} THEN 1 ELSE 0 END AS new
  FROM hit WHERE exact = 0),
region AS (SELECT *, sum(new) OVER (PARTITION BY rid, t ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS r FROM gap),
step AS (SELECT *, lag(place) OVER (PARTITION BY rid, t, r ORDER BY pos, place) AS before FROM region),
kept AS (
  SELECT rid, label, count(DISTINCT place) / runs AS score FROM step GROUP BY rid, t, label, runs, length, r
  HAVING count(DISTINCT place) / runs >= {licenses.COVER} AND count(*) FILTER (before IS NULL OR place > before) >= {licenses.COVER} * runs
     AND max(pos) + 3 - min(pos) <= {licenses.LONGEST} * length),
b AS (
  SELECT rid, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM phrase GROUP BY rid),
every AS (SELECT rid, label, 1.0::DOUBLE AS score FROM phrase UNION ALL SELECT rid, label, score::DOUBLE FROM kept),
e AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM every GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM doc LEFT JOIN b USING (rid) LEFT JOIN e USING (rid)"""


def op4() -> str:
    found = "\nUNION ALL\n".join(
        f"""SELECT rid, {_text(kind)} AS raw, i, length(b[i]) AS before, length(x[i]) AS whole, length(v[i]) AS value
FROM (SELECT rid, regexp_split_to_array(text, {_text(p)}) AS b, regexp_extract_all(text, {_text(p)}, 0) AS x,
             regexp_extract_all(text, {_text(p)}, 2) AS v FROM doc), unnest(range(1, len(x) + 1)) AS u(i)"""
        for kind, p in secrets.PATTERNS.items()
    )
    order = " ".join(f"WHEN {_text(k)} THEN {i}" for i, k in enumerate(secrets.KINDS))
    role = " ".join(f"WHEN {_text(k)} THEN {_text(r)}" for k, r in secrets.ROLES.items())
    line = "kind || ':' || start || ':' || stop, ',' ORDER BY start, nth, stop"
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({found}),
placed AS (SELECT *, CAST(sum(before + whole) OVER (PARTITION BY rid, raw ORDER BY i) AS BIGINT) AS stop FROM raw),
part AS (
  SELECT rid, stop - whole AS start, stop,
    CASE raw WHEN 'assign' THEN CASE WHEN value >= {secrets.ASSIGN_LEAST} THEN 'assign' WHEN value >= {secrets.WEAK_LEAST} THEN 'weak' END
             WHEN 'access' THEN CASE WHEN whole >= {secrets.ACCESS_LEAST} THEN 'access' END ELSE raw END AS kind
  FROM placed),
known AS (SELECT *, CASE kind {role} END AS role, CASE kind {order} END AS nth FROM part WHERE kind IS NOT NULL),
near AS (
  SELECT a.rid, a.kind, a.start, a.stop, a.nth, bool_or(b.role = 'secret') AS s, bool_or(b.role = 'identifier') AS i, bool_or(b.role = 'endpoint') AS e
  FROM known a JOIN known b ON a.rid = b.rid AND abs(a.start - b.start) <= {secrets.SCOPE}
  WHERE a.kind IN ('weak', 'identifier', 'endpoint') GROUP BY ALL),
span AS (
  SELECT rid, kind, start, stop, nth FROM known WHERE kind IN ('assign', 'access', 'hex')
  UNION ALL
  SELECT rid, kind, start, stop, nth FROM near
  WHERE CASE kind WHEN 'weak' THEN i OR e WHEN 'identifier' THEN s ELSE s AND i END),
told AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg({line}) FILTER (nth < 3) AS base, string_agg({line}) AS spans
  FROM span GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN told USING (rid)"""


def op5() -> str:
    letter = lambda group, shift: f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[{5 * group + 1}:{5 * group + 5}])::INT >> {shift}) & 31) + 1]"
    base32 = " || ".join(letter(g, s) for g in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH page AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
top AS (SELECT h, max(page_id) AS last FROM page GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM page JOIN top USING (h)"""


def op7() -> str:
    ordered = sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> str:
        site, _, rest = rule.partition("/")
        return f"(host = {_text(site)} OR suffix(host, {_text('.' + site)})) AND starts_with(path, {_text('/' + rest)})"

    rule = " ".join(f"WHEN {fits(r)} THEN {_text(r)}" for r, _ in ordered)
    verdict = " ".join(f"WHEN {_text(r)} THEN {_text(v)}" for r, v in urls.RULES)
    return rf"""
WITH one AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
two AS (SELECT *, CASE {rule} END AS rule, string_split(host, '.') AS parts FROM one),
three AS (
  SELECT rid, page_id, host, path, rule, CASE rule {verdict} END AS base,
    list_sort(list_distinct(list_filter([
      'top=' || parts[len(parts)], 'site=' || array_to_string(parts[greatest(1, len(parts) - 1):len(parts)], '.'), 'first=' || parts[1],
      'folder=' || regexp_extract(path, '(?s)^/([^/]*)/', 1), 'type=' || regexp_extract(path, '\.([A-Za-z0-9]+)$', 1),
      'query=' || regexp_extract(url, '(?s)^[^#]*?\?([^=&#]+)', 1),
      'scheme=' || lower(regexp_extract(url, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://', 1))], lambda t: NOT regexp_full_match(t, '[a-z]+=')))) AS tokens
  FROM two),
subset AS (
  SELECT rid, base, list_filter(tokens, lambda t, i: (mask >> CAST(i - 1 AS INT)) & 1 = 1) AS items
  FROM three, unnest(range(1, CAST(2 ** len(tokens) AS INT))) AS u(mask) WHERE len(tokens) > 0),
counted AS (
  SELECT items, count(*) AS n_tokens, count(*) FILTER (base = 'allow') AS allow, count(*) FILTER (base = 'block') AS block
  FROM subset WHERE base IS NOT NULL GROUP BY items),
mined AS (
  SELECT items, verdict, n_both, n_tokens FROM (
    SELECT items, n_tokens, 'allow' AS verdict, allow AS n_both FROM counted
    UNION ALL SELECT items, n_tokens, 'block', block FROM counted)
  WHERE n_both > 0 AND n_both >= ceil({urls.MIN_SUPPORT} * (SELECT count(*) FROM three WHERE base IS NOT NULL))
    AND n_both / n_tokens >= {urls.MIN_CONFIDENCE}),
best AS (
  SELECT rid, verdict, row_number() OVER (PARTITION BY rid ORDER BY n_both / n_tokens DESC, n_both DESC, len(items) DESC, array_to_string(items, ' ') DESC) AS nth
  FROM subset JOIN mined USING (items) WHERE base IS NULL)
SELECT page_id, host, path, rule, coalesce(base, verdict, 'allow') AS verdict
FROM three LEFT JOIN (SELECT rid, verdict FROM best WHERE nth = 1) USING (rid)"""


def op8() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def op11() -> str:
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT rid, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_UPPER}, {_LOWER}) AS key
  FROM doc, unnest(range(1, len(lines) + 1)) AS u(i)),
often AS (SELECT key FROM line WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
told AS (
  SELECT rid, count(*) AS n_lines, count(o.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL) AS kept
  FROM line l LEFT JOIN often o ON l.key = o.key GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM doc JOIN told USING (rid)"""


def op12() -> str:
    """Each round is an assignment and the floors of the means, over the vectors' components as rows."""
    nearest = """SELECT rid, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT v.rid, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM cell v JOIN centre{n} m USING (i) GROUP BY ALL) GROUP BY rid"""
    rounds = ",\n".join(
        f"""near{n} AS ({nearest.format(n=n)}),
mean{n} AS (SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM near{n} JOIN cell USING (rid) GROUP BY ALL),
centre{n + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM centre{n} LEFT JOIN mean{n} USING (c, i))"""
        for n in range(3)
    )
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT rid, i, v[i] AS x FROM kept, unnest(range(1, 65)) AS u(i)),
first AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM kept ORDER BY c LIMIT 16),
centre0 AS (SELECT c, i, x FROM first JOIN cell USING (rid)),
{rounds},
last AS ({nearest.format(n=3)}),
hashed AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM centre3 GROUP BY c)
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM last JOIN kept USING (rid) JOIN hashed ON hashed.c = best.c"""


def op13() -> str:
    return rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
said AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM said, unnest([1, 2, 3]) AS a(m), unnest(range(1, len(w) - m + 2)) AS b(i)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 10),
split AS (
  SELECT lang, phrase, words, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM often, unnest([1, 2]) AS u(k) WHERE k < words),
headed AS (SELECT s.*, o.f AS l FROM split s JOIN often o ON o.lang = s.lang AND o.phrase = s.head),
cut AS (
  SELECT s.lang, s.phrase, s.words, s.a, s.k, s.l, o.f AS r, CAST((1000000::HUGEINT * s.a * s.a) // (s.l::HUGEINT * o.f) AS BIGINT) AS score
  FROM headed s JOIN often o ON o.lang = s.lang AND o.phrase = s.tail),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS longer FROM often, unnest([1, 2]) AS u(i) WHERE words = 3 GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inner_part i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
