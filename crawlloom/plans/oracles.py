"""The SQL that says the same as the registered queries, for another engine on the same tables."""

from __future__ import annotations

from crawlloom.plans import fixtures as fx

W, N, U = r"[ \t\n\r\x0B\f]", r"[^ \t\n\r\x0B\f=/]", r"[^ \t\n\r\x0B\f/]"
ATTRIBUTE = rf"""{N}*{W}*={W}*(?:"[^"]*"?|''[^'']*''?|{U}*)|{N}+"""
BASE = "https://thther.example.org/en/685"

SCHEME = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
HOST = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
RAW_PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
PATH = f"CASE WHEN contains({RAW_PATH}, '%') THEN url_decode(replace({RAW_PATH}, '+', '%2B')) ELSE {RAW_PATH} END"
QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
FRAGMENT = "regexp_extract({u}, '(?s)^[^#]*#(.*)$', 1)"
KEY = f"{SCHEME} || '://' || lower({HOST}) || CASE WHEN {PATH} <> '/' THEN regexp_replace({PATH}, '/$', '') ELSE {PATH} END || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END"
PLAIN = r"^(?:[A-Za-z0-9_.~$&+,/:;=@!''()*\[\]-]|%[0-9A-Fa-f]{{2}})*$"


def escape(p: str) -> str:
    coded = "replace(replace(url_encode(c), '+', '%20'), '*', '%2A')"
    decoded = f"CASE WHEN contains({p}, '%') THEN url_decode(replace({p}, '+', '%2B')) ELSE {p} END"
    return f"CASE WHEN regexp_matches({p}, '{PLAIN.replace('{{', '{').replace('}}', '}')}') THEN {p} ELSE array_to_string([CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.~$&+,/:;=@-]$') THEN c ELSE {coded} END FOR c IN string_split({decoded}, '')], '') END"


def of(template: str, u: str = "url") -> str:
    return template.replace("{u}", u)


LINKS = rf"""
tags AS (SELECT page_id, {of(SCHEME)} || '://' || {of(HOST)} AS site, [t FOR t IN regexp_extract_all(coalesce(html, ''), '<([^>]*)>', 1) IF regexp_matches(t, '^[ \t\r\n]*a[ /]')] AS tags FROM pages),
attrs AS (SELECT page_id, site, flatten([[a FOR a IN regexp_extract_all(t, '{ATTRIBUTE}') IF regexp_matches(a, '(?s)^(?i:href)({W}*=.*)?$')] FOR t IN tags]) AS attrs FROM tags),
vals AS (SELECT page_id, site, [trim(regexp_replace(regexp_replace(a, '(?s)^(?i:href){W}*=?{W}*', ''), '(?s)^(?:"([^"]*)"?|''([^'']*)''?)$', '\1\2')) FOR a IN attrs] AS vals FROM attrs),
hrefs AS (SELECT page_id, site, vals[i] AS v, i FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM vals)),
rooted AS (SELECT page_id, i, site, regexp_extract(v, '^([^?#]*)', 1) AS p, regexp_extract(v, '^[^?#]*(\?[^#]*)', 1) AS q FROM hrefs WHERE v LIKE '/%' AND v NOT LIKE '//%'),
linked AS (SELECT page_id, site || {escape("p")} || q AS link, min(i) AS i FROM rooted GROUP BY ALL),
links AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS ord, link FROM linked)"""

TYPE = """CASE WHEN ct = '' THEN '' WHEN ct = 'text/html' THEN 'html' WHEN ct = 'text/css' THEN 'css' WHEN contains(ct, 'javascript') OR ct = 'application/json' THEN 'script'
 WHEN ct LIKE 'image/%' THEN 'image' WHEN ct LIKE 'font/%' THEN 'font' WHEN ct LIKE 'text/%' THEN 'text' ELSE 'other' END"""
TYPED = f"typed AS (SELECT * EXCLUDE ct, {TYPE} AS resource_type FROM (SELECT *, trim(split_part(trim(lower(content_type)), ';', 1)) AS ct FROM curr))"
SNAPSHOTS = f"prev AS ({fx.PREV}), curr AS ({fx.CURR})"
STATUS = "CASE WHEN {c} = 0 THEN 'unreachable' ELSE CAST({c} AS VARCHAR) END"
CHANGES = f"""changes AS (
 SELECT 'Added' AS type, url, '' AS previous, '' AS current FROM curr WHERE url NOT IN (SELECT url FROM prev)
 UNION ALL SELECT 'Removed', url, '', '' FROM prev WHERE url NOT IN (SELECT url FROM curr)
 UNION ALL SELECT 'Status Change', c.url, {STATUS.format(c="p.status_code")}, {STATUS.format(c="c.status_code")} FROM prev p JOIN curr c USING (url) WHERE p.status_code <> c.status_code
 UNION ALL SELECT 'Content-Type Change', c.url, p.content_type, c.content_type FROM prev p JOIN curr c USING (url) WHERE p.content_type <> c.content_type)"""
PLACE = "CASE type WHEN 'Added' THEN 0 WHEN 'Removed' THEN 1 WHEN 'Status Change' THEN 2 ELSE 3 END"
DIFF = f"WITH {SNAPSHOTS}, {CHANGES} "

REASON = f"""CASE WHEN {of(PATH, "ref")} <> '/' AND regexp_replace({of(PATH, "ref")}, '/$', '') = regexp_replace({of(PATH, "url")}, '/$', '') THEN 'Trailing slash variant'
 WHEN {of(FRAGMENT, "ref")} = '' AND {of(FRAGMENT, "url")} <> '' THEN 'URLs differing only by fragments'
 WHEN {of(QUERY, "ref")} <> {of(QUERY, "url")} THEN 'Query-string duplicate' ELSE 'Canonicalization duplicate' END"""
GROUPS = f"""dup AS ({fx.DUP}), keyed AS (SELECT *, {of(KEY)} AS dup_key FROM dup),
firsts AS (SELECT *, first_value(url) OVER (PARTITION BY dup_key ORDER BY pos) AS ref FROM keyed),
voted AS (SELECT dup_key, reason, count(*) AS n, CASE reason WHEN 'URLs differing only by fragments' THEN 0 WHEN 'Query-string duplicate' THEN 1 WHEN 'Canonicalization duplicate' THEN 2 ELSE 3 END AS place
  FROM (SELECT *, {REASON} AS reason FROM firsts) GROUP BY ALL),
reasons AS (SELECT dup_key, reason FROM voted QUALIFY row_number() OVER (PARTITION BY dup_key ORDER BY n DESC, place) = 1),
grouped AS (SELECT dup_key, coalesce(arg_min(url, pos) FILTER (WHERE {of(PATH)} = '/' OR NOT {of(PATH)} LIKE '%/'), arg_min(url, pos)) AS canonical,
  CASE WHEN count(DISTINCT url) = 1 THEN 1 ELSE 0 END AS severity, count(*) AS n_variants, string_agg(url, ', ' ORDER BY pos) AS variant_urls, string_agg(parent_url, '|' ORDER BY pos) AS parents
  FROM keyed GROUP BY dup_key HAVING count(*) > 1),
groups AS (SELECT g.*, CASE WHEN g.severity = 1 THEN 'Exact duplicate URL entries' ELSE r.reason END AS reason FROM grouped g JOIN reasons r USING (dup_key))"""

ODD = f"""{SNAPSHOTS}, {TYPED},
odd AS (SELECT pos, CASE WHEN pos % 31 = 0 THEN '' WHEN pos % 37 = 0 THEN 'ftp://e.test/' || pos WHEN pos % 41 = 0 THEN 'not-a-url-' || pos WHEN pos % 23 = 0 THEN url || '{{item}}' ELSE url END AS url,
  'p' || pos AS parent_url, status_code, content_type, CASE WHEN pos % 43 = 0 THEN 'bogus' ELSE resource_type END AS resource_type FROM typed)"""
STRUCTURE = """structure AS (
 SELECT 0 AS section, url, 'empty_url' AS kind, 1 AS severity, 'page has an empty URL' AS detail, '' AS parents FROM {t} WHERE url = ''
 UNION ALL SELECT 0, url, 'invalid_url', 1, 'URL is not a valid absolute http(s) URL', '' FROM {t} WHERE url <> '' AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')
 UNION ALL SELECT 0, url, 'invalid_url', 1, 'URL scheme must be http or https', '' FROM {t} WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AND NOT regexp_matches(url, '^(?i:https?)://')
 UNION ALL SELECT 0, url, 'missing_status', 1, 'page has no status code recorded', '' FROM {t} WHERE url <> '' AND status_code = 0
 UNION ALL SELECT 0, url, 'missing_content_type', 1, 'page has no content type recorded', '' FROM {t} WHERE url <> '' AND trim(content_type) = ''
 UNION ALL SELECT 0, url, 'invalid_resource_type', 1, 'unknown resource type "' || resource_type || '"', '' FROM {t} WHERE url <> '' AND resource_type NOT IN ('', 'html', 'css', 'script', 'image', 'font', 'text', 'other')
 UNION ALL SELECT 0, url, 'template_placeholder', 0, 'URL contains a template placeholder (e.g. /{{item.link}})', parent_url FROM {t} WHERE url <> '' AND (contains(url, '{{') OR contains(url, '}}')))"""


def sanity(t: str, base: str, previous: str) -> str:
    return f"""totals AS (SELECT count(*) AS n, count(*) FILTER (WHERE status_code = 0 OR status_code >= 400) AS bad, {previous} AS p FROM {t}),
base AS (SELECT url, status_code FROM {t} WHERE url IN ('{base}', CASE WHEN '{base}' LIKE '%/' THEN rtrim('{base}', '/') ELSE '{base}/' END) ORDER BY pos LIMIT 1),
sanity AS (
 SELECT 2 AS section, url, 'base_url_status' AS kind, 0 AS severity, 'base URL returned HTTP ' || status_code || ' (expected 200)' AS detail, '' AS parents FROM base WHERE status_code <> 200
 UNION ALL SELECT 2, '{base}', 'base_url_missing', 0, 'base URL was not found among the crawled pages', '' FROM totals WHERE (SELECT count(*) FROM base) = 0
 UNION ALL SELECT 2, '{base}', 'low_page_count', 0, 'crawl produced only ' || n || ' pages; possible incomplete crawl', '' FROM totals WHERE n < 3
 UNION ALL SELECT 2, '{base}', 'excessive_unreachable', 0, bad || ' of ' || n || ' pages were unreachable (status 0 or >=400)', '' FROM totals WHERE n > 0 AND bad > 0.5 * n
 UNION ALL SELECT 2, '{base}', 'page_count_drop', 0, 'current crawl contains significantly fewer pages than the previous snapshot (previous: ' || p || ', current: ' || n || '); possible incomplete crawl', '' FROM totals WHERE p > 0 AND n < 0.5 * p)"""


DUP_FINDINGS = "dups AS (SELECT 1 AS section, canonical AS url, 'duplicate_url' AS kind, severity, reason || ' — ' || n_variants || ' variant(s): ' || variant_urls AS detail, parents FROM groups)"
ALL = f"WITH {GROUPS}, t AS (SELECT *, '' AS resource_type FROM dup), {STRUCTURE.format(t='t')}, {DUP_FINDINGS}, {sanity('t', 'https://e.test/p/1', '3')}, found AS (SELECT * FROM structure UNION ALL SELECT * FROM dups UNION ALL SELECT * FROM sanity) "
#: In odd no two rows share a key, save the rows without a URL.
ODD_GROUPS = f"""okeyed AS (SELECT *, CASE WHEN url = '' THEN '' WHEN url LIKE 'not-a%' THEN url ELSE {of(KEY)} END AS k FROM odd),
ogroups AS (SELECT k, CASE WHEN count(DISTINCT url) = 1 THEN 1 ELSE 0 END AS severity FROM okeyed GROUP BY k HAVING count(*) > 1)"""

REACH = f"""WITH RECURSIVE graph AS ({fx.GRAPH}),
walk(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT g.dst, w.depth + 1 FROM walk w JOIN graph g ON g.src = w.node WHERE w.depth < 60),
near AS (SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node)"""

SQL: dict[str, str] = {
    "extract_links": f"WITH {LINKS} SELECT * FROM links",
    "link_out_degree": f"WITH {LINKS} SELECT p.page_id, count(l.link)::BIGINT AS n_links FROM pages p LEFT JOIN links l ON p.page_id = l.page_id GROUP BY p.page_id",
    "url_split": f"SELECT page_id, {of(SCHEME)} AS scheme, {of(HOST)} AS host, {of(PATH)} AS path, {of(QUERY)} AS query, {of(FRAGMENT)} AS fragment FROM pages",
    "url_canonicalize": f"SELECT page_id, {of(SCHEME)} || '://' || {of(HOST)} || CASE WHEN {of(RAW_PATH)} = '' THEN '/' ELSE {escape(of(RAW_PATH))} END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS canonical_url FROM pages",
    "url_dup_key": f"WITH dup AS ({fx.DUP}) SELECT pos, {of(KEY)} AS dup_key FROM dup",
    "url_base_candidates": "SELECT page_id, url || ' ' || CASE WHEN url LIKE '%/' THEN rtrim(url, '/') ELSE url || '/' END AS candidates FROM pages",
    "url_parent_path": f"SELECT page_id, CASE WHEN url = '' THEN '/' WHEN {of(PATH)} = '' THEN url ELSE {of(PATH)} END AS parent_path FROM pages",
    "robots_url": f"SELECT DISTINCT {of(SCHEME)} || '://' || {of(HOST)} || '/robots.txt' AS robots_url FROM pages",
    "resource_type": f"WITH {SNAPSHOTS}, {TYPED} SELECT pos, resource_type FROM typed",
    "is_html": f"WITH {SNAPSHOTS} SELECT pos, lower(content_type) LIKE 'text/html%' AS is_html FROM curr",
    "status_text": f"WITH {SNAPSHOTS} SELECT pos, {STATUS.format(c='status_code')} AS status_text FROM curr",
    "exclude_paths": f"""SELECT page_id, url FROM (SELECT page_id, url, CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END AS p FROM (SELECT page_id, url, {of(PATH)} AS p FROM pages))
 WHERE NOT (p = '/en' OR p LIKE '/en/%' OR p = '/fr' OR p LIKE '/fr/%')""",
    "diff_added": DIFF + "SELECT url FROM changes WHERE type = 'Added'",
    "diff_removed": DIFF + "SELECT url FROM changes WHERE type = 'Removed'",
    "diff_status": DIFF + "SELECT url, previous, current FROM changes WHERE type = 'Status Change'",
    "diff_content_type": DIFF + "SELECT url, previous, current FROM changes WHERE type = 'Content-Type Change'",
    "diff_report": DIFF + "SELECT * FROM changes",
    "diff_stats": DIFF
    + """SELECT (SELECT count(*) FROM prev) AS total_previous, (SELECT count(*) FROM curr) AS total_current, count(*) FILTER (WHERE type = 'Added') AS added,
 count(*) FILTER (WHERE type = 'Removed') AS removed, count(*) FILTER (WHERE type = 'Status Change') AS status_changes, count(*) FILTER (WHERE type = 'Content-Type Change') AS content_type_changes FROM changes""",
    "diff_by_site": DIFF + f"SELECT {of(SCHEME)} || '://' || {of(HOST)} AS site, type, count(*) AS n FROM changes GROUP BY ALL",
    "dedup_last_wins": f"WITH dup AS ({fx.DUP}) SELECT url, arg_max((pos % 5 + 200)::INTEGER, pos) AS status_code, arg_max(content_type, pos) AS content_type FROM dup GROUP BY url",
    "dup_groups": f"WITH {GROUPS} SELECT dup_key, canonical, severity, n_variants, variant_urls FROM groups",
    "dup_reason": f"WITH {GROUPS} SELECT dup_key, reason FROM groups",
    "dup_summary": f"WITH {GROUPS} SELECT severity, count(*) AS n_groups, sum(n_variants)::BIGINT AS n_urls FROM groups GROUP BY severity",
    "validate_structural": f"WITH {ODD}, {STRUCTURE.format(t='odd')} SELECT * FROM structure",
    "validate_sanity": f"WITH {SNAPSHOTS}, {sanity('curr', BASE, '(SELECT 3 * count(*) FROM prev)')} SELECT * FROM sanity",
    "validate_all": ALL + "SELECT * FROM found",
    "validate_strict": ALL + "SELECT kind, 1 AS severity, count(*) AS n FROM found GROUP BY kind",
    "severity_counts": f"""WITH {ODD}, {STRUCTURE.format(t="odd")}, {ODD_GROUPS}, {sanity("odd", BASE, "3")},
 found AS (SELECT kind, severity FROM structure UNION ALL SELECT 'duplicate_url', severity FROM ogroups UNION ALL SELECT kind, severity FROM sanity)
 SELECT CASE WHEN severity = 1 THEN 'error' ELSE 'warning' END AS severity, kind, count(*) AS n FROM found GROUP BY ALL""",
    "has_errors": f"""WITH {SNAPSHOTS} SELECT 'curr' AS snapshot, (SELECT count(*) FROM curr WHERE status_code = 0 OR content_type = '') > 0 OR (SELECT count(*) FROM curr) = 0 AS has_errors
 UNION ALL SELECT 'prev', (SELECT count(*) FROM prev WHERE status_code = 0 OR content_type = '') > 0 OR (SELECT count(*) FROM prev) = 0""",
    "crawl_reach": REACH + " SELECT n.node, n.depth, coalesce((SELECT min(g.src) FROM graph g JOIN near m ON m.node = g.src WHERE g.dst = n.node AND m.depth = n.depth - 1), -1) AS parent FROM near n",
    "crawl_replay": REACH
    + """, named AS (SELECT node, depth, 'https://e.test/n/' || node AS url FROM near)
 SELECT n.url, coalesce((SELECT min(m.url) FROM graph g JOIN named m ON m.node = g.src WHERE g.dst = n.node AND m.depth = n.depth - 1), '') AS parent_url,
 CASE WHEN n.node IN (SELECT src FROM graph) THEN 200 ELSE 404 END AS status_code,
 CASE WHEN n.node IN (SELECT src FROM graph) THEN 'text/html; charset=utf-8' ELSE 'text/plain; charset=utf-8' END AS content_type,
 CASE WHEN n.node IN (SELECT src FROM graph) THEN 'html' ELSE 'text' END AS resource_type FROM named n""",
    "sitemap_urls": "SELECT DISTINCT url FROM pages WHERE url <> ''",
    "robots_sitemaps": """SELECT * FROM (VALUES ('https://a.test', 'https://a.test/one.xml'), ('https://a.test', 'https://a.test/two.xml # kept'), ('https://b.test', 'https://b.test/sitemap.xml'),
 ('https://c.test:8080', 'https://c.test:8080/sitemap.xml'), ('https://e.test', 'https://e.test/sitemap.xml')) t(base_url, sitemap)""",
    "snapshot_roundtrip": f"WITH {SNAPSHOTS}, {TYPED} SELECT pos, url, parent_url, status_code, content_type, resource_type FROM typed",
    "crawl_seeded": f"""WITH RECURSIVE graph AS ({fx.GRAPH}),
 edges AS (SELECT CASE WHEN src = 4 THEN unnest([3, 4]) ELSE src END AS src, dst FROM graph WHERE src NOT IN (3, 6)),
 open AS (SELECT * FROM edges WHERE dst NOT IN (0, 5)),
 walk(node, depth) AS (SELECT unnest([0, 2, 9])::BIGINT, 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN open e ON e.src = w.node WHERE w.depth < 60),
 near AS (SELECT node, min(depth) AS depth, 'https://e.test/n/' || node AS url FROM walk GROUP BY node),
 found AS (SELECT n.url, coalesce((SELECT min(m.url) FROM open e JOIN near m ON m.node = e.src WHERE e.dst = n.node AND m.depth = n.depth - 1), '') AS parent_url,
  CASE WHEN node = 6 THEN 302 WHEN (CASE WHEN node = 3 THEN 4 ELSE node END) IN (SELECT src FROM graph) THEN 200 ELSE 404 END AS status_code FROM near n
  UNION ALL SELECT 'https://off.test/x', '', 404)
 SELECT row_number() OVER (ORDER BY url) - 1 AS pos, url, parent_url, status_code, CASE status_code WHEN 200 THEN 'text/html; charset=utf-8' WHEN 302 THEN 'text/html' ELSE 'text/plain; charset=utf-8' END AS content_type,
  CASE WHEN status_code = 404 THEN 'text' ELSE 'html' END AS resource_type FROM found""",
    "sitemap_gzip": "SELECT * FROM (VALUES (0, '<urlset>\u00e9</urlset>'), (1, '<urlset/>'), (2, NULL), (3, NULL)) t(n, body)",
    "snapshot_document": f"""WITH {SNAPSHOTS}, {TYPED} SELECT row_number() OVER (ORDER BY url) - 1 AS pos, url, parent_url, status_code, content_type, resource_type,
 '{BASE}' AS base_url, epoch(TIMESTAMP '2024-05-01 12:00:00')::BIGINT AS crawled_at FROM typed""",
    "snapshot_csv": f"WITH {SNAPSHOTS} SELECT (row_number() OVER (ORDER BY url) - 1)::INTEGER AS pos, url, {STATUS.format(c='status_code')} AS status_text, content_type FROM curr",
    "changes_csv": DIFF
    + """SELECT (row_number() OVER (PARTITION BY type ORDER BY url) - 1)::INTEGER AS pos, url, previous, current,
 CASE type WHEN 'Added' THEN 'added.csv' WHEN 'Removed' THEN 'removed.csv' WHEN 'Status Change' THEN 'status_changes.csv' ELSE 'content_type_changes.csv' END AS file FROM changes""",
    "report_csv": f"{DIFF}SELECT (row_number() OVER (ORDER BY {PLACE}, url) - 1)::INTEGER AS pos, type, url, previous, current FROM changes",
    "diff_ordered": f"{DIFF}SELECT row_number() OVER (ORDER BY {PLACE}, url) - 1 AS pos, type, url, previous, current FROM changes",
    "report_json": DIFF
    + """SELECT CASE type WHEN 'Added' THEN 'added' WHEN 'Removed' THEN 'removed' WHEN 'Status Change' THEN 'status_changes' ELSE 'content_type_changes' END AS list,
 (row_number() OVER (PARTITION BY type ORDER BY url) - 1)::INTEGER AS pos, url, CASE WHEN type LIKE '% Change' THEN previous END AS previous, CASE WHEN type LIKE '% Change' THEN current END AS current FROM changes""",
    "report_text": f"""{DIFF}, sizes AS (SELECT t.*, (SELECT count(*) FROM changes c WHERE c.type = t.type) AS n
  FROM (VALUES (1, 'Added', 'Added URLs', '+', 'Added:'), (2, 'Removed', 'Removed URLs', '-', 'Removed:'), (3, 'Status Change', 'Status Code Changes', '~', 'Status changes:'), (4, 'Content-Type Change', 'Content-Type Changes', '~', 'Content-Type changes:')) t(place, type, heading, sign, label)),
 rows AS (
  SELECT 0 AS part, i AS sub, '' AS url, l AS line FROM (VALUES (0, '=== Deployment Report ==='), (1, 'Base URL:   {BASE}'), (2, 'Previous:   2024-05-01T12:00:00Z'), (3, 'Current:    2024-05-02T12:00:00Z'), (4, ''), (5, 'Statistics:')) v(i, l)
  UNION ALL SELECT 0, 6, '', '  ' || rpad('URLs (previous):', 23, ' ') || count(*) FROM prev UNION ALL SELECT 0, 7, '', '  ' || rpad('URLs (current):', 23, ' ') || count(*) FROM curr
  UNION ALL SELECT 0, 7 + place, '', '  ' || rpad(label, 23, ' ') || n FROM sizes UNION ALL SELECT 0, 12, '', ''
  UNION ALL SELECT place, 0, '', heading || ' (' || n || '):' FROM sizes UNION ALL SELECT place, 1, '', '  (none)' FROM sizes WHERE n = 0
  UNION ALL SELECT s.place, 2, c.url, '  ' || s.sign || ' ' || c.url || CASE WHEN s.sign = '~' THEN '  ' || c.previous || ' -> ' || c.current ELSE '' END FROM changes c JOIN sizes s USING (type)
  UNION ALL SELECT place, 3, '', '' FROM sizes)
 SELECT (row_number() OVER (ORDER BY part, sub, url) - 1)::INTEGER AS pos, line FROM rows""",
    "findings_text": f"""{ALL}, placed AS (SELECT *, row_number() OVER (ORDER BY section, CASE WHEN section = 0 THEN -severity END, CASE WHEN section < 2 THEN url END, CASE WHEN section = 0 THEN kind END,
   CASE kind WHEN 'base_url_status' THEN 0 WHEN 'base_url_missing' THEN 1 WHEN 'low_page_count' THEN 2 WHEN 'excessive_unreachable' THEN 3 ELSE 4 END) AS place FROM found),
 sizes AS (SELECT (SELECT count(*) FROM found WHERE severity = 1) AS e, (SELECT count(*) FROM found WHERE severity = 0) AS w),
 rows AS (
  SELECT -1 AS part, 0 AS place, 0 AS sub, 'Snapshot Validation' AS line UNION ALL SELECT -1, 0, 1, ''
  UNION ALL SELECT 0, 0, 0, 'Errors (' || e || ')' FROM sizes UNION ALL SELECT 0, 0, 1, 'No errors found.' FROM sizes WHERE e = 0
  UNION ALL SELECT 1, 0, 0, 'Warnings (' || w || ')' FROM sizes UNION ALL SELECT 1, 0, 1, 'No warnings found.' FROM sizes WHERE w = 0
  UNION ALL SELECT 1 - severity, place, 0, '[' || kind || '] ' || url FROM placed UNION ALL SELECT 1 - severity, place, 1, '  ' || detail FROM placed
  UNION ALL SELECT 1 - severity, place, 2, '  Found from: ' || replace(parents, '|', ', ') FROM placed WHERE section = 1 OR kind = 'template_placeholder'
  UNION ALL SELECT unnest([0, 1]), 1000000000, 0, ''
  UNION ALL SELECT 2, 0, 0, 'Summary' UNION ALL SELECT 2, 0, 1, '  Warnings: ' || w FROM sizes UNION ALL SELECT 2, 0, 2, '  Errors: ' || e FROM sizes
  UNION ALL SELECT 2, 0, 3, CASE WHEN e > 0 THEN '\u2717 Snapshot validation failed.' ELSE '\u2713 Snapshot validation passed.' END FROM sizes)
 SELECT (row_number() OVER (ORDER BY part, place, sub) - 1)::INTEGER AS pos, line FROM rows""",
    "duplicates_text": f"""WITH {GROUPS}, seen AS (SELECT k.*, g.canonical, g.reason, g.severity FROM keyed k JOIN groups g USING (dup_key)),
 sizes AS (SELECT s.severity, s.word, s.part, count(g.dup_key) AS g, coalesce(sum(g.n_variants), 0)::BIGINT AS u FROM (VALUES (1, 'error', 0), (0, 'warning', 1)) s(severity, word, part) LEFT JOIN groups g ON g.severity = s.severity GROUP BY ALL),
 rows AS (
  SELECT -1 AS part, '' AS canonical, 0 AS sub, 0 AS pos, 0 AS nth, 'Duplicate URL Report' AS line UNION ALL SELECT -1, '', 1, 0, 0, ''
  UNION ALL SELECT part, '', 0, 0, 0, upper(word[1]) || word[2:] || 's (' || g || ')' FROM sizes UNION ALL SELECT part, '', 1, 0, 0, 'No ' || word || 's found.' FROM sizes WHERE g = 0
  UNION ALL SELECT 1 - severity, canonical, i, 0, 0, CASE i WHEN 0 THEN CASE severity WHEN 1 THEN '[error] ' ELSE '[warning] ' END || canonical WHEN 1 THEN 'Canonical:' WHEN 2 THEN canonical WHEN 3 THEN 'Reason:' WHEN 4 THEN reason WHEN 5 THEN 'Variants:' ELSE '' END
   FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5, 7]) AS i FROM groups)
  UNION ALL SELECT 1 - severity, canonical, 6, pos, i, CASE i WHEN 0 THEN '  \u2022 ' || url WHEN 1 THEN '    Parent: /' WHEN 2 THEN '    Status: ' || status_code ELSE '    Content-Type: ' || content_type END FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM seen)
  UNION ALL SELECT part, chr(1114111), 0, 0, 0, '' FROM sizes
  UNION ALL SELECT 2, '', 0, 0, 0, 'Summary' UNION ALL SELECT 2, '', 1 + part, 0, 0, '  ' || upper(word[1]) || word[2:] || 's: ' || g || ' (groups), ' || u || ' (urls)' FROM sizes)
 SELECT (row_number() OVER (ORDER BY part, canonical, sub, pos, nth) - 1)::INTEGER AS pos, line FROM rows""",
    "findings_ordered": f"""WITH {ODD}, named AS (SELECT * FROM odd WHERE url <> ''), {STRUCTURE.format(t="named")}, {sanity("named", BASE, "3")}, found AS (SELECT * FROM structure UNION ALL SELECT * FROM sanity)
 SELECT row_number() OVER (ORDER BY section, CASE WHEN section = 0 THEN -severity END, CASE WHEN section < 2 THEN url END, CASE WHEN section = 0 THEN kind END,
  CASE kind WHEN 'base_url_status' THEN 0 WHEN 'base_url_missing' THEN 1 WHEN 'low_page_count' THEN 2 WHEN 'excessive_unreachable' THEN 3 ELSE 4 END) - 1 AS pos, section, url, kind, severity FROM found""",
    "dup_by_severity": f"WITH {GROUPS} SELECT severity, row_number() OVER (PARTITION BY severity ORDER BY canonical) - 1 AS pos, canonical FROM groups",
    "findings_by_severity": f"WITH {ODD}, {STRUCTURE.format(t='odd')} SELECT CASE severity WHEN 1 THEN 'errors' ELSE 'warnings' END AS part, url, kind FROM structure",
    "validate_whole": f"""WITH {SNAPSHOTS}, {TYPED}, first AS (SELECT min(url) AS url FROM curr), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE pos % 3 <> 0) AS bad FROM curr)
 SELECT 'empty' AS "case", * FROM (VALUES (0, '', 'empty_snapshot', 1, 'snapshot contains no pages (corrupted or empty structure)', ''),
  (2, '{BASE}', 'base_url_missing', 0, 'base URL was not found among the crawled pages', ''), (2, '{BASE}', 'low_page_count', 0, 'crawl produced only 0 pages; possible incomplete crawl', '')) v(section, url, kind, severity, detail, parents)
 UNION ALL SELECT 'no base', 0, '', 'missing_base_url', 1, 'snapshot is missing its base URL', ''
 UNION ALL SELECT 'base fails', 2, url, 'base_url_status', 0, 'base URL returned HTTP 500 (expected 200)', '' FROM first
 UNION ALL SELECT 'base fails', 2, url, 'excessive_unreachable', 0, n || ' of ' || n || ' pages were unreachable (status 0 or >=400)', '' FROM first, n
 UNION ALL SELECT 'down', 2, 'https://nowhere.test', 'base_url_missing', 0, 'base URL was not found among the crawled pages', ''
 UNION ALL SELECT 'down', 2, 'https://nowhere.test', 'excessive_unreachable', 0, bad || ' of ' || n || ' pages were unreachable (status 0 or >=400)', '' FROM n""",
    "sanity_by_site": f"""WITH {SNAPSHOTS}, sites AS (SELECT {of(SCHEME)} || '://' || {of(HOST)} AS site, min(url) AS base_url, 2 * count(*) AS p FROM prev GROUP BY ALL),
 counts AS (SELECT {of(SCHEME)} || '://' || {of(HOST)} AS site, count(*) AS n, count(*) FILTER (WHERE status_code = 0 OR status_code >= 400) AS bad FROM curr GROUP BY ALL),
 judged AS (SELECT s.*, coalesce(c.n, 0) AS n, coalesce(c.bad, 0) AS bad, b.url AS found, b.status_code FROM sites s LEFT JOIN counts c USING (site)
  LEFT JOIN curr b ON b.url = s.base_url OR b.url = CASE WHEN s.base_url LIKE '%/' THEN rtrim(s.base_url, '/') ELSE s.base_url || '/' END
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY b.pos) = 1)
 SELECT site, found AS url, 'base_url_status' AS kind, 0 AS severity, 'base URL returned HTTP ' || status_code || ' (expected 200)' AS detail FROM judged WHERE status_code <> 200
 UNION ALL SELECT site, base_url, 'base_url_missing', 0, 'base URL was not found among the crawled pages' FROM judged WHERE found IS NULL
 UNION ALL SELECT site, base_url, 'low_page_count', 0, 'crawl produced only ' || n || ' pages; possible incomplete crawl' FROM judged WHERE n < 3
 UNION ALL SELECT site, base_url, 'excessive_unreachable', 0, bad || ' of ' || n || ' pages were unreachable (status 0 or >=400)' FROM judged WHERE n > 0 AND bad > 0.5 * n
 UNION ALL SELECT site, base_url, 'page_count_drop', 0, 'current crawl contains significantly fewer pages than the previous snapshot (previous: ' || p || ', current: ' || n || '); possible incomplete crawl' FROM judged WHERE p > 0 AND n < 0.5 * p""",
    "stream_changes": DIFF + "SELECT 0::BIGINT AS batch, 'Added' AS type, url, '' AS previous, '' AS current FROM prev UNION ALL SELECT 1, * FROM changes",
    "base_admission": "SELECT * FROM (VALUES ('http://a.test', true), ('HTTPS://a.test/x?y', true), ('ftp://a.test/', false), ('a.test', false), ('https:///x', false), ('mailto:a@b.test', false), ('', false), ('http://', false)) t(url, taken)",
    "cli_arguments": """SELECT * FROM (VALUES ('base_url', '"https://a.test"', '"https://a.test"'), ('exclude', '["/b", "/a"]', '[]'), ('workers', '7', '50'), ('timeout', '90.0', '30.0'), ('snapshot', '"snapshot.json"', '"snapshot.json"'), ('json', 'false', 'false'),
 ('no_replace', 'false', 'false'), ('quiet', 'true', 'false'), ('strict', 'false', 'false'), ('csv', '""', '""'), ('version', 'false', 'false')) t(setting, "full", bare) UNPIVOT (value FOR line IN ("full", bare))""",
    "report_times": "SELECT * FROM (VALUES (0, '2024-02-29T23:59:58Z'), (1, '2023-12-31T23:00:00Z')) t(n, printed)",
    "snapshot_files": """SELECT * FROM (VALUES ('lock', '.lock'), ('temp', '.tmp'), ('exists before', 'False'), ('pid in the lock', 'True'), ('second lock', 'refused'), ('lock after', 'False'), ('nothing to clean', 'None'),
 ('cleaned', '.tmp'), ('temp after', 'False'), ('exists after', 'True'), ('temp after replacement', 'False')) t(what, value)""",
    "crawl_progress": """WITH n AS (SELECT count(*) % 20 + 3 AS n FROM pages), levels AS (SELECT unnest(range(0, 5)) AS level)
 SELECT level::INTEGER AS level, least(n, 2 ** (level + 1) - 1)::INTEGER AS done, greatest(0, least(n, 2 ** (level + 2) - 1) - (2 ** (level + 1) - 1))::INTEGER AS queued FROM levels, n WHERE 2 ** level <= n""",
}
