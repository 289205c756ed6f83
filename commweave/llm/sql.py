"""DuckDB SQL for the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = """(VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
 ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS rules(rhost, rpath, rverdict)"""
_TAG = """(?i)<(?:link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b|meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b)[^>]*>"""
_TARGET = """(?i)\\b(?:href\\s*=\\s*|url\\s*=\\s*["'']?)["'']?([^"''\\s>]+)"""


def _after(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({_after(url)}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({_after(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _normal(url: str) -> str:
    kept = f"list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))"
    query = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string(list_sort({kept}), '&') ELSE '' END"
    return f"CASE WHEN instr({url}, '://') > 0 THEN regexp_replace({_host(url)}, ':(80|443)$', '') || regexp_replace({_path(url)}, '/$', '') || {query} END"


def _folded(path: str) -> str:
    whole = f"regexp_replace(regexp_replace({path}, '^/', ''), '(^|/)(\\.\\.?)$', '\\1\\2/')"
    return f"list_reduce(list_prepend('', string_split({whole}, '/')), lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"


#: Aliases are URLs with one normal form, or joined by a canonical link or a refresh; what a rule says of any of them counts.
OP5_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT page_id, url, html, {_host("url")} AS host, {_path("url")} AS path, {_normal("url")} AS k FROM pages),
tags AS (
  SELECT url, k, {_path("url")} AS path, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) AS site,
    replace(regexp_extract(tag, '{_TARGET}', 1), '&amp;', '&') AS link
  FROM (SELECT *, unnest(regexp_extract_all(html, '{_TAG}')) AS tag FROM keyed)),
cut AS (SELECT *, regexp_extract(link, '^([^?#]*)', 1) AS lpath FROM tags WHERE link <> '' AND k IS NOT NULL),
resolved AS (
  SELECT k AS src, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN lpath = '' THEN site || path || CASE WHEN starts_with(link, '?') THEN link ELSE regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) END
    WHEN starts_with(link, '/') THEN site || {_folded("lpath")} || substr(link, length(lpath) + 1)
    ELSE site || {_folded("(regexp_replace(path, '[^/]*$', '') || lpath)")} || substr(link, length(lpath) + 1) END AS target FROM cut),
links AS (SELECT DISTINCT src, {_normal("target")} AS dst FROM resolved WHERE instr(target, '://') > 0),
known AS (SELECT DISTINCT k, host, path FROM keyed WHERE k IS NOT NULL UNION SELECT dst, {_host("('http://' || dst)")}, {_path("('http://' || dst)")} FROM links),
ruled AS (
  SELECT known.*, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY known.k, known.host, known.path ORDER BY length(rhost || rpath) DESC NULLS LAST, rverdict) AS n
  FROM known LEFT JOIN {_RULES} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT * FROM ruled WHERE n = 1),
bare AS (
  SELECT p.page_id, p.url, p.host, p.path, p.k, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(rhost || rpath) DESC NULLS LAST, rverdict) AS n
  FROM (SELECT DISTINCT page_id, url, host, path, k FROM keyed) p LEFT JOIN {_RULES} ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)),
reach(a, b) AS (
  SELECT DISTINCT k, k FROM known
  UNION
  SELECT reach.a, CASE WHEN links.src = reach.b THEN links.dst ELSE links.src END FROM reach JOIN links ON links.src = reach.b OR links.dst = reach.b),
theirs AS (SELECT reach.a, min(best.rverdict) AS v FROM reach JOIN best ON best.k = reach.b WHERE best.rverdict IS NOT NULL GROUP BY reach.a)
SELECT keyed.page_id, keyed.host, keyed.path, bare.rule, coalesce(bare.rverdict, v, 'allow') AS verdict
FROM keyed JOIN bare ON bare.n = 1 AND bare.page_id IS NOT DISTINCT FROM keyed.page_id AND bare.url IS NOT DISTINCT FROM keyed.url LEFT JOIN theirs ON theirs.a = keyed.k
"""
