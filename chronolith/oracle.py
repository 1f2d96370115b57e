"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

_COMMITS = """
c AS (
  SELECT o_orderkey AS hash,
    CASE WHEN o_custkey % 3 = 0 THEN 'name:customer ' || o_custkey ELSE 'u' || o_custkey || '@x.org' END AS key,
    'Customer ' || o_custkey AS name, CAST(o_orderdate AS DATE) AS d,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day,
    strftime(o_orderdate, '%Y-%m') AS bucket, o_orderstatus = 'P' AS merge, o_orderpriority AS subject,
    -(CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10000000000 + o_orderkey) AS seq
  FROM orders
)"""


def _changes(path: str) -> str:
    return f"""
f AS (
  SELECT c.*, {path} AS path, CAST(l_quantity AS INTEGER) AS a, l_linenumber AS r, l_linenumber = 7 AS bin, l_linenumber = 6 AS ren,
    CASE WHEN l_linenumber = 6 THEN 'old/' || l_suppkey END AS old_path
  FROM lineitem JOIN c ON l_orderkey = hash
)"""


_F = _COMMITS + "," + _changes("CAST(l_partkey AS VARCHAR)")
_FINE = _COMMITS + "," + _changes("l_suppkey || '/' || l_partkey")
_ADDS, _DELS = (f"CAST(coalesce(sum({x}) FILTER (NOT bin), 0) AS BIGINT)" for x in ("a", "r"))
_TODAY = "(SELECT CAST(max(o_orderdate) AS DATE) FROM orders)"
_TODAY_DAY = f"date_diff('day', DATE '1970-01-01', {_TODAY})"

_FILES = """
s AS (
  SELECT CAST(p_partkey AS VARCHAR) AS rel, p_brand || '/' || p_type AS dir, p_brand AS language, p_size * 10 AS code, p_size % 4 AS comment,
    p_size % 3 AS blank, p_size * 10 + p_size % 4 + p_size % 3 AS total, p_size % 9 AS decisions, p_size * 100 AS bytes,
    p_size % 13 AS complexity, p_size % 5 AS funcs, p_partkey % 4 AS debt, p_partkey % 4 * 2 AS debt_weight, p_partkey % 3 AS suppressed,
    p_partkey % 7 = 0 AS is_test, p_partkey % 11 = 0 AS is_generated
  FROM part
)"""
_EDGES = """
e AS (
  SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_partkey <> l_suppkey
)"""
_EVENTS = """
every AS (
  SELECT DISTINCT user_id AS src, CAST(props->>'$.k' AS BIGINT) AS dst FROM events WHERE event_type = 'error' AND user_id <> CAST(props->>'$.k' AS BIGINT)
), g AS (
  -- what has no way in or no way out is in no cycle
  SELECT src, dst FROM every WHERE src IN (SELECT dst FROM every) AND dst IN (SELECT src FROM every)
), reach(a, b) AS (
  SELECT src, dst FROM g UNION SELECT a, dst FROM reach JOIN g ON b = src
), mutual AS (
  SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a
)"""

_SIGNALS = f"""
{_F}, {_FILES}, {_EDGES}, {_EVENTS},
fa AS (SELECT path, key, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT path, count(*) AS authors, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM fa GROUP BY path),
h AS (SELECT path, count(*) AS commits, max(day) AS last_day FROM f GROUP BY path),
fi AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), fo AS (SELECT src, count(*) AS n FROM e GROUP BY src),
tested AS (SELECT DISTINCT dst FROM e WHERE src IN (SELECT rel FROM s WHERE is_test)),
sig AS (
  SELECT s.*, coalesce(h.commits, 0) AS commits, coalesce(o.authors, 0) AS authors, coalesce(o.hhi, 0) AS hhi, coalesce(fi.n, 0) AS fan_in,
    coalesce(fo.n, 0) AS fan_out, s.rel IN (SELECT dst FROM tested) AS is_tested, s.rel IN (SELECT CAST(node AS VARCHAR) FROM mutual) AS in_cycle,
    complexity / greatest(1, funcs) AS per_function, {_TODAY_DAY} - last_day AS days_since, NOT is_test AND NOT is_generated AND code > 0 AS rankable
  FROM s LEFT JOIN h ON h.path = rel LEFT JOIN o ON o.path = rel LEFT JOIN fi ON fi.dst = rel LEFT JOIN fo ON fo.src = rel
), mx AS (
  SELECT max(commits) AS m1, max(complexity) AS m2, max(per_function) AS m3, max(code) AS m4, max(debt_weight) AS m5, max(suppressed) AS m6, max(fan_in) AS m7 FROM sig
), p AS (
  SELECT sig.*, {{churn}} AS churn, 0.5 * {{cx}} + 0.5 * {{pf}} AS complexity_part, {{size}} AS size, {{debt}} AS debt_part,
    CASE WHEN commits > 0 THEN hhi ELSE 0 END AS ownership, {{blast}} AS blast_radius,
    CASE WHEN is_test OR is_generated OR is_tested THEN 0.0 WHEN commits > 0 THEN 1.0 ELSE 0.35 END AS untested, {{sup}} AS suppression
  FROM sig, mx
), k AS (
  SELECT *, least(100, 100 * (churn * .20 + complexity_part * .22 + size * .10 + debt_part * .12 + ownership * .10 + blast_radius * .10 + untested * .10 + suppression * .06)) AS risk FROM p
)"""


def _n(v: str, m: str) -> str:
    return f"CASE WHEN {m} <= 0 OR {v} <= 0 THEN 0.0 ELSE least(1.0, ln(1.0 + {v}) / ln(1.0 + {m})) END"


_SIGNALS = _SIGNALS.format(
    churn=_n("commits", "m1"), cx=_n("complexity", "m2"), pf=_n("per_function", "m3"), size=_n("code", "m4"), debt=_n("debt_weight", "m5"), sup=_n("suppressed", "m6"), blast=_n("fan_in", "m7")
)
_REASONS = [("churn", "churn", ".20"), ("complexity", "complexity_part", ".22"), ("size", "size", ".10"), ("debt", "debt_part", ".12"), ("ownership", "ownership", ".10"), ("blastRadius", "blast_radius", ".10"), ("untested", "untested", ".10"), ("suppression", "suppression", ".06")]

_MONTHS = f"""
{_COMMITS}, m AS (SELECT bucket, count(*) AS commits, count(*) FILTER (merge) AS merges, count(DISTINCT key) AS authors FROM c GROUP BY bucket),
spine AS (
  SELECT CAST(i AS INTEGER) AS ord, strftime(date_trunc('month', {_TODAY}) - to_months(CAST(25 - i AS INTEGER)), '%Y-%m') AS month FROM range(26) t(i)
), line AS (
  SELECT ord, month, coalesce(commits, 0) AS commits, coalesce(merges, 0) AS merges, coalesce(authors, 0) AS authors FROM spine LEFT JOIN m ON bucket = month
)"""
_AUTHORS = f"""
{_COMMITS}, a AS (
  SELECT key, min_by(name, seq) AS name, count(*) AS commits, count(*) FILTER (merge) AS merges, min(day) AS first_day, max(day) AS last_day,
    count(DISTINCT bucket) AS active_months, min(seq) AS first_seq
  FROM c GROUP BY key
)"""
_HEALTH = f"""
{_SIGNALS}, au AS (SELECT key, max(day) AS last_day FROM c GROUP BY key),
line AS (
  SELECT i, (SELECT count(*) FROM c WHERE bucket = strftime(date_trunc('month', {_TODAY}) - to_months(CAST(i AS INTEGER)), '%Y-%m')) AS commits FROM range(6) t(i)
), ranked AS (SELECT commits, row_number() OVER (ORDER BY commits DESC) AS i, count(*) OVER () AS n FROM sig WHERE rankable AND commits > 0),
comp(key, v) AS (
  SELECT 'maintainability', 1 - least(1, greatest(0, ((SELECT quantile_disc(per_function, 0.5) FROM sig WHERE rankable) - 2) / 10))
  UNION ALL SELECT 'tests', least(1, 1.6 * (SELECT count(*) FILTER (is_tested) / count(*) FROM sig WHERE NOT is_test))
  UNION ALL SELECT 'ownership', (SELECT least(1, count(*) FILTER ({_TODAY_DAY} - last_day <= 180) / greatest(2, count(*) * 0.25)) FROM au)
  UNION ALL SELECT 'debt', (SELECT 1 - least(1, sum(debt) / (sum(code) / 1000) / 20) FROM sig)
  UNION ALL SELECT 'structure', (SELECT 1 - least(1, 8 * count(*) FILTER (in_cycle) / count(*)) FROM sig)
  UNION ALL SELECT 'focus', 1 - least(1, greatest(0, ((SELECT sum(commits) FILTER (i <= greatest(1, floor(0.1 * n))) / sum(commits) FROM ranked) - 0.3) / 0.4))
  UNION ALL SELECT 'velocity', (SELECT count(*) FILTER (commits > 0) / 6 FROM line)
), hc AS (SELECT key, CAST(floor(v * 100 + 0.5) AS BIGINT) AS value FROM comp),
ix AS (SELECT avg(value) AS v FROM hc),
gr AS (SELECT CAST(floor(v + 0.5) AS BIGINT) AS value, CASE WHEN v >= 85 THEN 'A' WHEN v >= 72 THEN 'B' WHEN v >= 58 THEN 'C' WHEN v >= 42 THEN 'D' ELSE 'E' END AS grade FROM ix)"""

_MARKERS = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
w(marker, weight) AS (VALUES ('THE', 1), ('CONTENT', 2), ('LICENSE', 3), ('COPYRIGHT', 2)),
mk AS (
  SELECT doc_id, line, marker, weight, unnest(range((length(upper(body)) - length(replace(upper(body), marker, ''))) // length(marker))) AS i FROM l, w
)"""

_PATHS = """
paths AS (
  SELECT ['src', 'node_modules', 'lib', 'gen', 'tests', 'dist', 'a.b'][p_partkey % 7 + 1] || '/p' || p_partkey ||
    ['.ts', '.py', '.png', '.d.ts', '.min.js', '', '.Md', '.test.js', '.pb.go'][p_partkey % 9 + 1] AS rel,
    CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size % 50 * 40000 AS BIGINT) END AS size
  FROM part
)"""


def _classified(needle: str) -> str:
    return f"""{_PATHS}, seg AS (SELECT rel, size, string_split(rel, '/')[1] AS dir, regexp_extract(lower(rel), '(\\.[^./]*)$', 1) AS ext FROM paths),
cl AS (
  SELECT rel, size,
    CASE WHEN ext = '.ts' THEN 'TypeScript' WHEN ext = '.py' THEN 'Python' WHEN ext = '.js' THEN 'JavaScript' WHEN ext = '.go' THEN 'Go' WHEN ext = '.md' THEN 'Markdown' END AS language,
    coalesce(CASE WHEN ext IN ('.ts', '.js') THEN dir = 'tests' OR rel LIKE '%.test.%' WHEN ext = '.py' THEN dir = 'tests' END, false) AS test,
    dir IN ('node_modules', 'dist') AS vendor,
    dir IN ('node_modules', 'gen', 'dist') OR rel LIKE '%.min.js' OR rel LIKE '%.pb.go' AS generated,
    CASE WHEN contains(rel, '{needle}') THEN 'excluded' WHEN dir IN ('node_modules', 'dist') THEN 'vendor' WHEN ext = '.png' THEN 'binary' WHEN size IS NULL THEN 'missing'
      WHEN size = 0 THEN 'empty' WHEN size > 1500000 THEN 'large' END AS skip
  FROM seg
)"""


_SPECS = """
sp AS (
  SELECT DISTINCT page_id, spec FROM (
    SELECT page_id, regexp_replace(trim(unnest(string_split(m, ','))), '\\s+as\\s+.*$', '', 's') AS spec
    FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS m FROM pages)
  ) WHERE spec <> ''
)"""
_RESOLVED = f"""
{_SPECS}, kn AS (SELECT DISTINCT spec AS path FROM sp WHERE length(spec) <= 4),
rs AS (
  SELECT page_id AS src, spec, coalesce(
    (SELECT path FROM kn WHERE path = spec), (SELECT path FROM kn WHERE path = substr(spec, 1, 4)),
    (SELECT path FROM kn WHERE path = substr(spec, 1, 3)), (SELECT path FROM kn WHERE path = lower(substr(spec, 1, 3)))) AS target
  FROM sp
), cleaned AS (SELECT regexp_replace(regexp_replace(regexp_replace(spec, '^/+', ''), '^package:', ''), '^node:', '') AS x FROM rs WHERE target IS NULL),
named AS (
  SELECT CASE WHEN x LIKE '@%' THEN array_to_string(string_split(x, '/')[1:2], '/')
    WHEN regexp_extract(x, '^([^/:]*)', 1) = '' OR (NOT regexp_matches(x, '[@/.:]') AND NOT regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9_-]*$')) THEN NULL
    ELSE regexp_extract(x, '^([^/:]*)', 1) END AS name FROM cleaned
), ex AS (SELECT name, count(*) AS importers FROM named WHERE name IS NOT NULL GROUP BY name),
mf AS (SELECT upper(name) AS name FROM ex WHERE length(name) % 2 = 0 UNION SELECT regexp_extract(url, '://([^/.]*)', 1) FROM pages)"""


def _free(extra: str) -> str:
    from .registry import LOCAL_NAMES, STDLIB

    names = STDLIB["node"] + (LOCAL_NAMES if extra == "local" else ["self"])
    return ", ".join(f"'{n}'" for n in names)


_COVER = f"""
{_FILES}, {_EDGES}, te AS (SELECT DISTINCT dst AS rel FROM e WHERE src IN (SELECT rel FROM s WHERE is_test) UNION SELECT rel FROM s WHERE is_test),
cv AS (SELECT s.*, rel IN (SELECT rel FROM te) AS is_tested FROM s)"""

SQL = {
    "history_summary": f"""WITH {_F}, n AS (SELECT count(*) AS e FROM c WHERE hash NOT IN (SELECT l_orderkey FROM lineitem))
SELECT x.*, (SELECT e FROM n) AS empty_commits, y.* FROM
(SELECT count(*) AS commits, count(*) FILTER (merge) AS merges, count(*) AS authored_commits, count(DISTINCT key) AS authors, min(day) AS oldest_day, max(day) AS newest_day FROM c) x,
(SELECT {_ADDS} AS adds, {_DELS} AS dels, count(*) FILTER (bin) AS binary_changes, count(*) FILTER (ren) AS renames FROM f) y""",
    "file_churn": f"WITH {_F} SELECT path, count(*) AS commits, {_ADDS} AS adds, {_DELS} AS dels, min(day) AS first_day, max(day) AS last_day, bool_or(bin) AS binary FROM f GROUP BY path",
    "file_birth_last": f"""WITH {_FINE} SELECT path, arg_min(hash, (day, seq)) AS born_commit, arg_max(key, (day, seq)) AS last_author, arg_max(subject, (day, seq)) AS last_subject,
arg_min(old_path, (seq, old_path)) FILTER (ren) AS merged_into FROM f GROUP BY path""",
    "file_author": f"WITH {_F} SELECT path, key, count(*) AS n FROM f GROUP BY ALL",
    "file_month": f"WITH {_F} SELECT path, bucket, count(*) AS n FROM f GROUP BY ALL",
    "author_activity": f"WITH {_AUTHORS} SELECT * EXCLUDE first_seq FROM a",
    "month_activity": f"WITH {_MONTHS} SELECT * FROM m",
    "author_file_counts": f"WITH {_F} SELECT key, count(DISTINCT path) AS files FROM f GROUP BY key",
    "month_file_counts": f"WITH {_F} SELECT bucket, count(DISTINCT path) AS files FROM f GROUP BY bucket",
    "file_hhi": f"""WITH {_F}, fa AS (SELECT path, key, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT path, sum(n) AS t FROM fa GROUP BY path)
SELECT path, count(*) AS authors, round(sum((n / t) ** 2), 6) AS hhi FROM fa JOIN t USING (path) GROUP BY path""",
    "empty_commits": f"WITH {_COMMITS} SELECT hash, bucket FROM c WHERE hash NOT IN (SELECT l_orderkey FROM lineitem)",
    "history_window": f"WITH {_COMMITS} SELECT hash, key, bucket FROM c WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' ORDER BY seq LIMIT 500",
    "line_churn": f"WITH {_F} SELECT bucket, {_ADDS} AS adds, {_DELS} AS dels FROM f GROUP BY bucket",
    "shortlog": f"WITH {_COMMITS} SELECT name AS author, key AS email, count(*) AS commits FROM c WHERE NOT merge GROUP BY ALL",
    "bus_factor": f"""WITH {_AUTHORS}, r AS (SELECT sum(commits) OVER (ORDER BY commits DESC, key) AS upto, row_number() OVER (ORDER BY commits DESC, key) AS i, sum(commits) OVER () AS t FROM a)
SELECT CAST(min(i) AS BIGINT) AS bus_factor FROM r WHERE upto >= 0.5 * t""",
    "churn_concentration": f"""WITH {_FINE}, h AS (SELECT path, count(*) AS n FROM f GROUP BY path), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, path) AS i, count(*) OVER () AS files FROM h)
SELECT CAST(max(files) AS BIGINT) AS files, CAST(greatest(1, floor(max(files) * 0.1)) AS BIGINT) AS top_files, round(sum(n) FILTER (i <= greatest(1, floor(files * 0.1))) / sum(n), 6) AS share FROM r""",
    "single_owner": f"WITH {_FINE} SELECT path, count(*) AS commits FROM f GROUP BY path HAVING count(*) >= 2 AND count(DISTINCT key) = 1",
    "stale_files": f"WITH RECURSIVE {_SIGNALS} SELECT rel, CAST(code AS BIGINT) AS code, CAST(days_since AS INTEGER) AS days_since FROM sig WHERE rankable AND days_since > 30 AND code > 200 ORDER BY code DESC, rel LIMIT 20",
    "orphan_files": f"WITH {_F}, {_FILES} SELECT rel, CAST(code AS BIGINT) AS code FROM s WHERE NOT is_test AND code > 0 AND rel NOT IN (SELECT path FROM f) ORDER BY code DESC, rel LIMIT 20",
    "deleted_paths": f"WITH {_F} SELECT path, count(*) AS commits FROM f WHERE path NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10) GROUP BY path",
    "timeline_26m": f"WITH {_MONTHS} SELECT * FROM line",
    "cadence_6m": f"WITH {_MONTHS} SELECT count(*) FILTER (commits > 0) AS active_months, round(count(*) FILTER (commits > 0) / 6, 6) AS cadence FROM line WHERE ord >= 20",
    "peak_month": f"WITH {_MONTHS} SELECT month, commits FROM line ORDER BY commits DESC, ord LIMIT 1",
    "timeline_downsampled": f"WITH {_MONTHS} SELECT CAST(ord // 4 AS BIGINT) AS bucket, max(commits) AS commits FROM line GROUP BY 1",
    "author_share": f"""WITH {_AUTHORS} SELECT key, commits - merges AS non_merge, CAST(last_day - first_day AS INTEGER) AS tenure_days, CAST({_TODAY_DAY} - last_day AS INTEGER) AS last_active,
CASE WHEN {_TODAY_DAY} - last_day <= 30 THEN 'active' WHEN {_TODAY_DAY} - last_day <= 180 THEN 'recent' WHEN {_TODAY_DAY} - last_day <= 365 THEN 'lurking' ELSE 'dormant' END AS label,
round(commits / sum(commits) OVER (), 6) AS share FROM a""",
    "topk_authors": f"WITH {_AUTHORS} SELECT key, commits FROM a ORDER BY commits DESC, first_seq LIMIT 15",
    "median_per_function": f"WITH {_FILES} SELECT round(quantile_disc(complexity / greatest(1, funcs), 0.5), 6) AS value FROM s",
    "author_search": f"WITH {_AUTHORS} SELECT key, commits FROM a WHERE contains(lower(name), 'r 12') OR contains(key, 'r 12')",
    "line_census": """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS s FROM documents WHERE text <> ''), n AS (
SELECT doc_id, count(*) AS total, count(*) FILTER (regexp_matches(s, '^\\s*$')) AS blank, count(*) FILTER (trim(s) LIKE '#%') AS comment FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(total, 0) AS total, coalesce(total - blank - comment, 0) AS code, coalesce(comment, 0) AS comment, coalesce(blank, 0) AS blank FROM documents LEFT JOIN n USING (doc_id)""",
    "marker_counts": f"WITH {_MARKERS} SELECT marker, count(*) AS count, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT doc_id) AS files FROM mk GROUP BY marker",
    "oldest_marker": f"""WITH RECURSIVE {_MARKERS}, {_SIGNALS} SELECT rel, CAST(line AS INTEGER) AS line, marker, CAST(days_since AS INTEGER) AS days_since FROM mk JOIN sig ON rel = CAST(doc_id AS VARCHAR)
WHERE weight >= 2 AND days_since IS NOT NULL ORDER BY days_since DESC, rel, weight DESC, line, marker LIMIT 1""",
    "suppression_counts": "SELECT doc_id, n AS suppressed FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)licen[cs]e|copyright|spdx')) AS BIGINT) AS n FROM documents) WHERE n > 0",
    "keyword_decisions": """WITH t AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9_$.]', ' ', 'g') AS x, text FROM documents), w AS (SELECT doc_id, unnest(string_split(x, ' ')) AS p FROM t),
one AS (SELECT doc_id, count(*) FILTER (p IN ('the', 'in') OR regexp_matches(p, '^(the|in)\\.')) AS n FROM w GROUP BY doc_id),
two AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_$.])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9_$.])of\\s+the(?:[^A-Za-z0-9_$]|$)')) AS n FROM t)
SELECT doc_id, CAST(one.n + two.n AS BIGINT) AS decisions FROM one JOIN two USING (doc_id)""",
    "operator_decisions": "SELECT page_id, CAST(len(regexp_extract_all(replace(url, '?:', ''), '\\?|&&|\\|\\|')) AS BIGINT) AS decisions FROM pages",
    "nesting_depth": """WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '[{}()\\[\\]]')) AS ch, generate_subscripts(regexp_extract_all(html, '[{}()\\[\\]]'), 1) AS i FROM pages),
d AS (SELECT page_id, i, sum(CASE WHEN ch IN ('{', '(', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS p FROM b),
q AS (SELECT page_id, p - least(0, min(p) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM d)
SELECT pages.page_id, CAST(coalesce(max(depth), 0) AS BIGINT) AS depth FROM pages LEFT JOIN q USING (page_id) GROUP BY pages.page_id""",
    "definition_counts": """SELECT doc_id, CAST(least(2000, len(regexp_extract_all(text, '\\bthe\\s+\\w+')) + len(regexp_extract_all(text, '(?m)^[A-Z]\\w+'))) AS BIGINT) AS funcs FROM documents""",
    "comment_lines": """WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->') AS m FROM pages)
SELECT page_id, CAST(len(m) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(m, lambda s: len(string_split(s, chr(10))))), 0) AS BIGINT) AS lines FROM x""",
    "import_specs": f"WITH {_SPECS} SELECT * FROM sp",
    "language_rollup": f"""WITH {_FILES} SELECT coalesce(language, '*') AS language, count(*) AS files, count(*) FILTER (is_test) AS test_files, count(*) FILTER (NOT is_test) AS source_files,
{', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('code', 'comment', 'blank', 'total', 'decisions', 'bytes', 'debt', 'suppressed'))}, min(rel) AS first_rel FROM s GROUP BY ROLLUP (language)""",
    "path_classify": f"WITH {_classified('/p1')} SELECT * FROM cl",
    "skip_histogram": f"WITH {_classified('/p1')} SELECT coalesce(skip, 'kept') AS skip, count(*) AS n FROM cl GROUP BY 1",
    "path_functions": f"""WITH {_PATHS} SELECT rel, string_split(rel, '/')[-1] AS base, regexp_extract(string_split(rel, '/')[-1], '^.+(\\.[^.]*)$', 1) AS ext,
string_split(rel, '/')[1] AS parent, string_split(rel, '/')[1] AS top FROM paths""",
    "tested_semi": f"WITH {_COVER} SELECT rel FROM te",
    "coverage_total": f"WITH {_COVER} SELECT count(*) AS source_files, count(*) FILTER (is_tested) AS covered, round(count(*) FILTER (is_tested) / count(*), 6) AS ratio FROM cv WHERE NOT is_test",
    "coverage_by_dir": f"""WITH {_COVER}, d AS (SELECT dir, count(*) FILTER (NOT is_test) AS source, count(*) FILTER (is_test) AS tests, count(*) FILTER (NOT is_test AND is_tested) AS covered,
CAST(coalesce(sum(code) FILTER (NOT is_test), 0) AS BIGINT) AS code FROM cv GROUP BY dir)
SELECT *, round(covered / source, 6) AS ratio, CASE WHEN tests > 0 THEN round(code / tests, 6) END AS code_per_test FROM d WHERE source > 0""",
    "least_covered": f"""WITH {_COVER}, d AS (SELECT language AS dir, count(*) FILTER (NOT is_test) AS source, count(*) FILTER (is_test) AS tests, count(*) FILTER (NOT is_test AND is_tested) AS covered,
sum(code) FILTER (NOT is_test) AS code, min(rel) AS first_rel FROM cv GROUP BY language), q AS (SELECT * FROM d WHERE source > 0),
b AS (SELECT * FROM q WHERE tests = 0 ORDER BY covered / source, code DESC, first_rel LIMIT 10), r AS (SELECT * FROM q ORDER BY covered / source, code DESC, first_rel LIMIT 6)
SELECT dir, source, tests, covered FROM b UNION ALL SELECT dir, source, tests, covered FROM r WHERE (SELECT count(*) FROM b) = 0""",
    "edges_distinct": """SELECT DISTINCT user_id AS src, CAST(props->>'$.k' AS BIGINT) AS dst FROM events WHERE event_type = 'error' AND user_id <> CAST(props->>'$.k' AS BIGINT)""",
    "fan_in": f"WITH {_EDGES} SELECT dst AS rel, count(*) AS fan_in FROM e GROUP BY dst",
    "fan_out": f"WITH {_EDGES} SELECT src AS rel, count(*) AS fan_out FROM e GROUP BY src",
    "blast_radius_top": f"WITH {_EDGES} SELECT dst AS rel, count(*) AS fan_in FROM e GROUP BY dst ORDER BY fan_in DESC, rel LIMIT 10",
    "reverse_deps": f"WITH {_EDGES} SELECT src FROM e WHERE dst = '7'",
    "scc_members": f"WITH RECURSIVE {_EVENTS} SELECT component, node FROM mutual",
    "cycle_vs_cluster": f"""WITH RECURSIVE {_EVENTS} SELECT component, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, count(*) AS size,
CASE WHEN count(*) > 8 THEN 'cluster' ELSE 'cycle' END AS kind FROM mutual GROUP BY component""",
    "cluster_core": f"""WITH RECURSIVE {_EVENTS}, fi AS (SELECT dst, count(*) AS n FROM every GROUP BY dst)
SELECT component, node, n AS fan_in, CAST(row_number() OVER (PARTITION BY component ORDER BY n DESC, node) AS INTEGER) AS place FROM mutual JOIN fi ON dst = node QUALIFY place <= 4""",
    "owner_labels": f"""WITH RECURSIVE {_SIGNALS}, la AS (SELECT path, arg_max(name, (day, seq)) AS name FROM f GROUP BY path)
SELECT rel, CASE WHEN authors = 0 THEN '-' WHEN authors = 1 THEN name ELSE authors || ' people' END AS owner FROM sig LEFT JOIN la ON path = rel""",
    "resolve_first_match": f"WITH {_RESOLVED} SELECT src, spec, target FROM rs",
    "externals_top": f"WITH {_RESOLVED} SELECT * FROM ex ORDER BY importers DESC, name LIMIT 15",
    "undeclared": f"WITH {_RESOLVED} SELECT * FROM ex WHERE lower(name) NOT IN (SELECT lower(name) FROM mf) AND lower(name) NOT IN ({_free('local')})",
    "unused_declared": f"""WITH {_RESOLVED} SELECT DISTINCT lower(name) AS name FROM mf WHERE lower(name) NOT IN (SELECT lower(name) FROM ex) AND lower(name) NOT IN ({_free('self')})
AND name NOT LIKE '@%' ORDER BY name LIMIT 50""",
    "set_union": f"WITH {_EDGES} SELECT src AS rel FROM e UNION SELECT dst FROM e",
    "set_except": f"WITH {_EDGES} SELECT src AS rel FROM e EXCEPT SELECT dst FROM e",
    "repo_maxima": f"""WITH RECURSIVE {_SIGNALS} SELECT m1 AS max_commits, CAST(m2 AS BIGINT) AS max_complexity, round(m3, 6) AS max_per_function, CAST(m4 AS BIGINT) AS max_code,
CAST(m5 AS BIGINT) AS max_debt_weight, CAST(m6 AS BIGINT) AS max_suppressed, m7 AS max_fan_in FROM mx""",
    "risk_parts": f"WITH RECURSIVE {_SIGNALS} SELECT rel, {', '.join(f'round({c}, 6) AS {c}' for _, c, _ in _REASONS)} FROM p",
    "risk_topk": f"WITH RECURSIVE {_SIGNALS} SELECT rel, commits, fan_in, round(risk, 6) AS risk FROM k WHERE rankable ORDER BY k.risk DESC, rel LIMIT 20",
    "risk_reasons": f"""WITH RECURSIVE {_SIGNALS}, t AS (SELECT * FROM k WHERE rankable ORDER BY risk DESC, rel LIMIT 50),
u AS ({' UNION ALL '.join(f"SELECT rel, {i} AS i, '{n}' AS key, {c} * {w} * 100 AS v FROM t" for i, (n, c, w) in enumerate(_REASONS))})
SELECT rel, CAST(row_number() OVER (PARTITION BY rel ORDER BY v DESC, i) - 1 AS INTEGER) AS place, key, round(v, 6) AS contribution FROM u WHERE v >= 3""",
    "untested_hot": f"""WITH RECURSIVE {_SIGNALS}, t AS (SELECT * FROM k WHERE rankable ORDER BY risk DESC, rel LIMIT 100)
SELECT rel, round(risk, 6) AS risk FROM t WHERE NOT is_tested AND commits > 3 ORDER BY t.risk DESC, rel LIMIT 6""",
    "health_components": f"WITH RECURSIVE {_HEALTH} SELECT key, value FROM hc",
    "health_grade": f"WITH RECURSIVE {_HEALTH} SELECT value, grade FROM gr",
    "fail_on": f"WITH RECURSIVE {_HEALTH} SELECT grade >= 'C' AS failed FROM gr",
    "cache_key": f"""WITH {_PATHS} SELECT rel, substr(translate(to_base64(unhex(sha1('3' || chr(0) || 'abc' || chr(0) || rel || chr(0) || size || chr(0) || (size * 1000 + 7)))), '+/', '-_'), 1, 22) AS cache_key,
string_split(rel, '/')[1] AS shard FROM paths WHERE size IS NOT NULL""",
    "cache_hit_split": f"""WITH {_PATHS} SELECT count(*) FILTER (size % 3 = 0) AS hits, count(*) FILTER (size % 3 <> 0) AS misses, round(count(*) FILTER (size % 3 = 0) / count(*), 6) AS hit_rate
FROM paths WHERE size IS NOT NULL""",
    "stream_history": f"""WITH {_F} SELECT path, count(*) AS commits, {_ADDS} AS adds, {_DELS} AS dels, min(day) AS first_day, max(day) AS last_day, CAST(arg_min(hash, (day, seq)) AS VARCHAR) AS born_commit,
arg_max(key, (day, seq)) AS last_author FROM f GROUP BY path""",
    "incremental_equals_batch": f"""WITH {_F} SELECT path, count(*) AS commits, {_ADDS} AS adds, {_DELS} AS dels, min(day) AS first_day, max(day) AS last_day, arg_min(hash, (day, seq)) AS born_commit,
arg_max(key, (day, seq)) AS last_author FROM f GROUP BY path""",
}
