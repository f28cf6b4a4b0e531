"""DuckDB SQL of the shared inputs of the queries: records and events, written independently of the Spark plans."""

from __future__ import annotations

from ..functions.crawlers import catalog
from ..functions.hashing import TEST_KEY
from ..sources.adapter import DUCKDB_RECORDS

ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/7\nDisallow: /*.env$\n\nUser-agent: GPTBot\nDisallow: /fr/\n"

_I = bytes(b ^ 0x36 for b in TEST_KEY.ljust(64, b"\0"))
_O = bytes(b ^ 0x5C for b in TEST_KEY.ljust(64, b"\0"))


def hm(purpose: str, value: str, n: int = 64, blob: bool = False) -> str:
    body = value if blob else f"encode({value})"
    return f"left(sha256(unhex('{_O.hex()}') || unhex(sha256(unhex('{(_I + purpose.encode() + bytes(1)).hex()}') || {body}))), {n})"


def _re2(token: str) -> str:
    return "".join("\\" + c if c in ".+*?()[]{}|^$\\/" else c for c in token.lower()).replace("'", "''")


def cat() -> str:
    rows = ", ".join(f"({e['rank']}, '{e['name']}', '{e['category']}', {str(e['protected_default']).lower()}, '(?:^|[ /;()+]){_re2(e['token'])}(?:$|[ /;()+])')" for e in catalog())
    return f"cat(rank, name, category, protected, pattern) AS (VALUES {rows})"


_SEGMENT = """CASE WHEN contains(x, '/') OR contains(x, '\\') THEN '{encoded-separator}' WHEN x IN ('.', '..') THEN '{dot-segment}'
  WHEN regexp_full_match(x, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN '{email}'
  WHEN regexp_full_match(x, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}') THEN '{uuid}'
  WHEN regexp_full_match(x, '[0-9]{4}') AND CAST(x AS INT) BETWEEN 1900 AND 2100 THEN '{year}'
  WHEN regexp_full_match(x, '[0-9]+') THEN '{int}' WHEN regexp_full_match(x, '[0-9a-fA-F]{16,}') THEN '{hex}'
  WHEN regexp_full_match(x, '[A-Za-z0-9_-]{24,}={0,2}') THEN '{token}' WHEN strlen(x) > 96 THEN '{long}' ELSE x END"""

_FAILED = "(method IN ('GET', 'HEAD') AND status IN (400, 401, 403, 404))"

NORMALISED = f"""rec AS ({DUCKDB_RECORDS}),
{cat()},
claims AS (SELECT ua, arg_min(name, rank) AS crawler, arg_min(category, rank) AS category, arg_min(protected, rank) AS protected_default, count(*) AS claim_matches
  FROM (SELECT DISTINCT user_agent AS ua FROM rec) JOIN cat ON regexp_matches(lower(ua), pattern) GROUP BY ua),
s1 AS (SELECT rec.*, crawler, category, protected_default, coalesce(claim_matches, 0) AS claim_matches,
  split_part(request_uri, '?', 1) AS path, CASE WHEN contains(request_uri, '?') THEN substr(request_uri, strpos(request_uri, '?') + 1) ELSE '' END AS query
  FROM rec LEFT JOIN claims ON ua = user_agent),
s2 AS (SELECT *, NOT contains(regexp_replace(path, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') AS uri_ok,
  list_transform(string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/')[2:], lambda x: url_decode(x)) AS d,
  list_filter(string_split(query, '&'), lambda x: x <> '') AS pairs FROM s1),
s3 AS (SELECT *, list_transform(d, lambda x: {_SEGMENT}) AS seg, '/' || array_to_string(d, '/') AS decoded,
  list_sort(list_transform(pairs, lambda x: {{'k': CASE WHEN regexp_full_match(url_decode(replace(split_part(x, '=', 1), '+', ' ')), '[A-Za-z0-9_.-]{{1,64}}') THEN url_decode(replace(split_part(x, '=', 1), '+', ' '))
     ELSE '{{key-' || {hm("query-key", "url_decode(replace(split_part(x, '=', 1), '+', ' '))", 8)} || '}}' END,
    'v': {hm("query-value", "url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' '))")}}})) AS kv FROM s2),
s4 AS (SELECT *, '/' || array_to_string(seg, '/') AS route, coalesce(list_position(list_transform(range(1, len(d) + 1), lambda i: d[i] <> seg[i]), true), 0) AS ph,
  list_sort(list_distinct(list_transform(kv, lambda x: x.k))) AS query_keys FROM s3),
s5 AS (SELECT *, CASE WHEN regexp_full_match(path, '[A-Za-z0-9!$&''()*+,;=:@\\[\\]._~/-]*') AND NOT contains(path, '//') AND NOT list_has_any(seg, ['{{encoded-separator}}', '{{dot-segment}}'])
    THEN CASE WHEN ph = 0 THEN route WHEN ph = 1 THEN '/' ELSE '/' || array_to_string(seg[1:ph - 1], '/') || '/' END END AS actionable_prefix,
  CASE WHEN len(pairs) > 0 THEN {hm("query", "unhex(array_to_string(list_transform(kv, lambda x: printf('%08x', strlen(x.k)) || hex(encode(x.k)) || '00000040' || hex(encode(x.v))), ''))", 32, True)} END AS query_fingerprint,
  NOT contains(query, ';') AND NOT contains(regexp_replace(query, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') AND (query = '' OR len(pairs) > 0) AS query_ok,
  CASE WHEN uri_ok THEN lower(decoded) ELSE lower(request_uri) END AS dl FROM s4),
s6 AS (SELECT *, list_filter([
    CASE WHEN dl = '/.env' OR starts_with(dl, '/.env.') THEN 'env-file-scan' END, CASE WHEN starts_with(dl, '/.git/') THEN 'git-metadata-scan' END,
    CASE WHEN contains(lower(request_uri), '${{jndi:') THEN 'log4shell-probe' END, CASE WHEN list_contains(string_split_regex(dl, '[/\\\\]'), '..') THEN 'path-traversal-scan' END,
    CASE WHEN {_FAILED} AND (starts_with(dl, '/phpmyadmin/') OR starts_with(dl, '/pma/')) THEN 'phpmyadmin-scan' END,
    CASE WHEN string_split(rtrim(dl, '/'), '/')[-1] IN ('c99.php', 'r57.php', 'shell.php', 'cmd.php', 'wso.php') THEN 'shell-probe' END,
    CASE WHEN {_FAILED} AND (dl = '/wp-login.php' OR starts_with(dl, '/wp-admin/')) THEN 'wp-login-scan' END], lambda x: x IS NOT NULL) AS probes,
  path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS target FROM s5),
norm AS (SELECT *, CASE WHEN NOT uri_ok OR NOT query_ok OR coalesce(regexp_matches(actionable_prefix, '[^\\x21-\\x7e]|[\\\\%?#*{{}}]') OR contains(actionable_prefix, '..'), false) THEN 'invalid_uri' END AS reject_code,
  CASE WHEN len(probes) > 0 THEN 'security_probe' ELSE coalesce(category, 'unclassified') END AS primary_class, ts_us - ts_us % 60000000 AS minute_us,
  {hm("client", "client_ip", 32)} AS client_key, {hm("url", "request_uri", 32)} AS url_fingerprint, {hm("ua", "user_agent")} AS ua_hash,
  CASE WHEN crawler IS NOT NULL THEN sha256(unhex('636c61696d00') || encode(crawler)) ELSE {hm("ua", "user_agent")} END AS ua_key,
  CASE WHEN referer = '' THEN NULL ELSE lower(regexp_extract(referer, '^https?://([^/]+)', 1)) END AS referer_host,
  CASE WHEN crawler IS NULL THEN NULL WHEN starts_with(lower(crawler), 'gptbot') THEN NOT starts_with(target, '/fr/')
    WHEN regexp_matches(target, '^/.*\\.env$') THEN false WHEN starts_with(target, '/en/7') THEN true WHEN starts_with(target, '/en/') THEN false ELSE true END AS robots_allowed FROM s6)"""

EVENTS = NORMALISED + ",\nev AS (SELECT * FROM norm WHERE reject_code IS NULL)"


def kmv(value: str) -> str:
    return f"list_sort(list(DISTINCT substr(sha256({value}), 1, 16)) FILTER ({value} IS NOT NULL))[1:64]"


def estimate(sk: str, n: str) -> str:
    kth = f"CAST(CAST(('0x' || {sk}[64]) AS UBIGINT) AS HUGEINT)"
    return f"CAST(CASE WHEN {sk} IS NULL THEN 0 WHEN len({sk}) < 64 THEN len({sk}) ELSE greatest(64, least({n}, {63 << 64}::HUGEINT // {kth})) END AS BIGINT)"


def conservative(sk: str, n: str) -> str:
    e = estimate(sk, n)
    return f"CAST(CASE WHEN len({sk}) = 64 THEN {e} // 1000000 * 619000 + {e} % 1000000 * 619000 // 1000000 ELSE {e} END AS BIGINT)"


def ppm(n: str, d: str) -> str:
    return f"CAST(CASE WHEN {n} > 0 AND {d} > 0 THEN least(1000000, CAST({n} AS HUGEINT) * 1000000 // {d}) ELSE 0 END AS BIGINT)"


CELLS = """cube AS (SELECT minute_us, route, actionable_prefix, ua_key, primary_class, method, status, cache_state, max(crawler) AS crawler, max(category) AS category, bool_or(protected_default) AS protected_default,
  count(*) AS requests, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, CAST(sum(request_duration_us) AS BIGINT) AS request_duration_us, count(request_duration_us) AS request_duration_samples,
  CAST(sum(upstream_duration_us) AS BIGINT) AS upstream_duration_us, count(upstream_duration_us) AS upstream_samples, count(referer_host) AS referer_present FROM ev GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY minute_us, route, actionable_prefix, ua_key, primary_class, method, status, cache_state")

ROUTES = f"""route_one AS (SELECT route, actionable_prefix, count(*) AS requests, count(query_fingerprint) AS query_requests, count_if(status = 404) AS status_404, count_if(method IN ('GET', 'HEAD')) AS cache_eligible,
  count_if(method IN ('GET', 'HEAD') AND cache_state <> 'unknown') AS cache_samples, count_if(method IN ('GET', 'HEAD') AND cache_state IN ('miss', 'bypass', 'expired')) AS cache_misses,
  CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, CAST(sum(upstream_duration_us) AS BIGINT) AS upstream_duration_us, count(upstream_duration_us) AS upstream_samples FROM ev GROUP BY route, actionable_prefix),
route_sk AS (SELECT route, {kmv("client_key")} AS c, {kmv("url_fingerprint")} AS u, {kmv("query_fingerprint")} AS q FROM ev GROUP BY route),
routes AS (SELECT a.*, {conservative("c", "requests")} AS distinct_clients, {conservative("u", "requests")} AS distinct_urls, {conservative("q", "requests")} AS distinct_queries, len(c) = 64 OR len(u) = 64 OR coalesce(len(q), 0) = 64 AS distinct_approximate
  FROM (SELECT route, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(query_requests) AS BIGINT) AS query_requests, CAST(sum(status_404) AS BIGINT) AS status_404, CAST(sum(cache_eligible) AS BIGINT) AS cache_eligible,
    CAST(sum(cache_samples) AS BIGINT) AS cache_samples, CAST(sum(cache_misses) AS BIGINT) AS cache_misses, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, CAST(sum(upstream_duration_us) AS BIGINT) AS upstream_duration_us,
    CAST(sum(upstream_samples) AS BIGINT) AS upstream_samples, CASE WHEN count(actionable_prefix) = count(*) AND min(actionable_prefix) = max(actionable_prefix) THEN min(actionable_prefix) END AS actionable_prefix FROM route_one GROUP BY route) a JOIN route_sk USING (route))"""

SUBJECTS = f"""subjects AS (SELECT *, {conservative("sk", "requests")} AS distinct_routes FROM (SELECT client_key, ua_key, count(*) AS requests, count_if(status BETWEEN 400 AND 499) AS status_4xx, count_if(referer_host IS NULL) AS no_referer,
  count_if(len(probes) > 0) AS probe_requests, count_if(NOT coalesce(robots_allowed, true)) AS robots_violations, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, bool_or(crawler IS NOT NULL) AS claimed,
  max(crawler) AS crawler, max(category) AS category, {kmv("route")} AS sk FROM ev GROUP BY client_key, ua_key))"""


def rate(time: str = "ts_us") -> str:
    """Token buckets by folding each subject's requests in order."""
    return f"""profiles(profile, rate, burst) AS (VALUES ('gentle', 60, 20), ('standard', 30, 10), ('strict', 10, 5)),
steps AS (SELECT client_key, ua_key, profile, seq, rate, burst, {time} AS t FROM ev, profiles),
folded AS (SELECT client_key, ua_key, profile, list_reduce(list({{'seq': seq, 't': t, 'rate': CAST(rate AS BIGINT), 'cap': CAST((burst + 1) * 60000000 AS BIGINT)}} ORDER BY seq),
  lambda a, x: {{'last': CASE WHEN a.broken OR x.t < a.last THEN a.last ELSE x.t END, 'broken': a.broken OR x.t < a.last,
    'tokens': CASE WHEN a.broken OR x.t < a.last THEN a.tokens ELSE least(x.cap, a.tokens + (x.t - a.last) * x.rate) - CASE WHEN least(x.cap, a.tokens + (x.t - a.last) * x.rate) >= 60000000 THEN 60000000 ELSE 0 END END,
    'yes': CASE WHEN NOT (a.broken OR x.t < a.last) AND least(x.cap, a.tokens + (x.t - a.last) * x.rate) >= 60000000 THEN list_append(a.yes, x.seq) ELSE a.yes END,
    'no': CASE WHEN NOT (a.broken OR x.t < a.last) AND least(x.cap, a.tokens + (x.t - a.last) * x.rate) < 60000000 THEN list_append(a.no, x.seq) ELSE a.no END}},
  {{'last': min(t), 'broken': false, 'tokens': CAST(1260000000 AS BIGINT), 'yes': CAST([] AS BIGINT[]), 'no': CAST([] AS BIGINT[])}}) AS r FROM steps GROUP BY client_key, ua_key, profile),
decided AS (SELECT profile, unnest(r.yes) AS seq, true AS allowed FROM folded UNION ALL SELECT profile, unnest(r.no), false FROM folded),
impacts AS (SELECT ua_key, primary_class, profile, max(crawler) AS crawler, max(category) AS category, count(*) AS modeled_requests, count_if(allowed) AS allowed_requests, count_if(NOT allowed) AS limited_requests,
  CAST(coalesce(sum(CASE WHEN allowed THEN bytes_sent END), 0) AS BIGINT) AS allowed_bytes, CAST(coalesce(sum(CASE WHEN NOT allowed THEN bytes_sent END), 0) AS BIGINT) AS limited_bytes,
  CAST(sum(CASE WHEN NOT allowed THEN upstream_duration_us END) AS BIGINT) AS limited_upstream_us, count(CASE WHEN NOT allowed THEN upstream_duration_us END) AS limited_upstream_samples
  FROM decided JOIN ev USING (seq) GROUP BY ua_key, primary_class, profile)"""
