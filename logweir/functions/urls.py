"""Request targets: acceptance, route normalisation, actionable prefix, query keys and referer host.

All are Spark SQL expressions over named columns, so that whole-stage code generation and Catalyst see them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import hmac_hex, length_prefixed

CONTROL = r"[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}]"
MAX_ROUTE, MAX_PREFIX, MAX_KEYS = 512, 256, 32


def _unescaped(x: str) -> str:
    """Percent-decoded path text; null for a malformed escape. A plus sign stays one."""
    return f"try_url_decode(replace({x}, '+', '%2B'))"


def _segment(x: str) -> str:
    """Class of a decoded path segment, or the segment itself. The order of the cases matters."""
    return f"""CASE
      WHEN contains({x}, '/') OR contains({x}, '\\\\') THEN '{{encoded-separator}}'
      WHEN {x} IN ('.', '..') THEN '{{dot-segment}}'
      WHEN {x} RLIKE '^[^@\\\\s]+@[^@\\\\s]+[.][^@\\\\s]+\\\\z' THEN '{{email}}'
      WHEN {x} RLIKE '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}\\\\z' THEN '{{uuid}}'
      WHEN {x} RLIKE '^(19[0-9][0-9]|20[0-9][0-9]|2100)\\\\z' THEN '{{year}}'
      WHEN {x} RLIKE '^[0-9]+\\\\z' THEN '{{int}}'
      WHEN {x} RLIKE '(?i)^[0-9a-f]{{16,}}\\\\z' THEN '{{hex}}'
      WHEN {x} RLIKE '^[A-Za-z0-9_-]{{24,}}={{0,2}}\\\\z' THEN '{{token}}'
      WHEN octet_length({x}) > 96 THEN '{{long}}'
      ELSE {x} END"""


def split_target(df: DataFrame, uri: str = "request_uri") -> DataFrame:
    """Adds path, query and uri_ok: origin form, or absolute http(s) form with a host and without user information."""
    absolute = "'(?i)^https?://[^/?#@]+'"
    rest = f"CASE WHEN {uri} RLIKE {absolute} THEN regexp_replace({uri}, {absolute}, '') ELSE {uri} END"
    return (
        df.withColumn("_rest", F.expr(rest))
        .withColumn("path", F.expr("CASE WHEN substring_index(_rest, '?', 1) IN ('', '*') THEN '/' ELSE substring_index(_rest, '?', 1) END"))
        .withColumn("query", F.expr("CASE WHEN contains(_rest, '?') THEN substr(_rest, locate('?', _rest) + 1) ELSE '' END"))
        .withColumn("uri_ok", F.expr(f"({uri} LIKE '/%' OR {uri} = '*' OR {uri} RLIKE {absolute}) AND NOT path RLIKE '%(?![0-9a-fA-F]{{2}})'"))
        .drop("_rest")
    )


def escaped_path(path: str = "path", decoded: str = "decoded_path") -> str:
    """A path in its escaped form: as it stands where it is validly encoded, else its decoded form encoded anew."""
    out = f"replace(url_encode({decoded}), '+', '%20')"
    for code, char in (("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@")):
        out = f"replace({out}, '{code}', '{char}')"
    return f"(CASE WHEN {path} RLIKE '^[A-Za-z0-9!$&\\'()*+,;=:@\\\\[\\\\]%._~/-]*\\\\z' THEN {path} ELSE {out} END)"


def normalise_route(df: DataFrame, key: bytes) -> DataFrame:
    """Adds route, actionable_prefix, decoded_path and path_ok to rows with `path`."""
    cut = MAX_ROUTE - 42 - len("/{truncated-0123456789abcdef}")
    out = df.withColumn("_d", F.expr(f"transform(slice(split(path, '/'), 2, 100000), s -> {_unescaped('s')})"))
    out = out.withColumn("path_ok", F.expr(f"NOT exists(_d, d -> d IS NULL OR contains(d, '�') OR d RLIKE '{CONTROL}')"))
    out = out.withColumn("_s", F.expr(f"transform(_d, d -> {_segment('d')})"))
    out = out.withColumn("_first", F.expr("array_position(transform(zip_with(_d, _s, (d, s) -> d <> s), b -> CAST(b AS INT)), 1)"))
    out = out.withColumn("_route", F.expr("concat('/', array_join(_s, '/'))")).withColumn("decoded_path", F.expr("concat('/', array_join(_d, '/'))"))
    long_ = f"octet_length(_route) > {MAX_ROUTE}"
    # cut at the last slash of the first bytes, so no character is split
    kept = f"regexp_extract(decode(substr(encode(_route, 'UTF-8'), 1, {cut}), 'UTF-8'), '(?s)^(.+)/', 1)"
    head = f"CASE WHEN {kept} = '' THEN '/' ELSE {kept} END"
    out = out.withColumn("route", F.expr(f"CASE WHEN {long_} THEN concat({head}, '/{{truncated-', {hmac_hex(key, 'url', escaped_path(), 16)}, '}}') ELSE _route END"))
    plain = "path RLIKE '^[A-Za-z0-9!$&\\'()*+,;=:@\\\\[\\\\]._~/-]*\\\\z' AND NOT contains(path, '//')"
    closed = "exists(_s, s -> s IN ('{encoded-separator}', '{dot-segment}'))"
    prefix = "CASE WHEN _first = 0 THEN _route WHEN _first = 1 THEN '/' ELSE concat('/', array_join(slice(_s, 1, CAST(_first AS INT) - 1), '/'), '/') END"
    out = out.withColumn("_prefix", F.expr(prefix))
    out = out.withColumn("actionable_prefix", F.expr(f"CASE WHEN {plain} AND NOT {closed} AND NOT {long_} AND octet_length(_prefix) <= {MAX_PREFIX} THEN _prefix END"))
    return out.drop("_d", "_s", "_first", "_route", "_prefix")


def prefix_safe(prefix: str) -> str:
    """Whether an actionable prefix may stand in a server rule; a record with another one is rejected."""
    return f"({prefix} IS NULL OR NOT ({prefix} RLIKE '[^\\\\x21-\\\\x7e]|[\\\\\\\\%?#*{{}}]' OR contains({prefix}, '..')))"


def query_keys(df: DataFrame, key: bytes) -> DataFrame:
    """Adds query_keys, query_fingerprint and query_ok to rows with `query`."""
    name = hmac_hex(key, "query-key", "k", 8)
    safe = f"transform(array(try_url_decode(substring_index(p, '=', 1))), k -> CASE WHEN k RLIKE '^[A-Za-z0-9_.-]{{1,64}}\\\\z' THEN k ELSE concat('{{key-', {name}, '}}') END)[0]"
    value = "try_url_decode(CASE WHEN contains(p, '=') THEN substr(p, locate('=', p) + 1) ELSE '' END)"
    out = df.withColumn("_p", F.expr("CASE WHEN query = '' THEN CAST(array() AS ARRAY<STRING>) ELSE filter(split(query, '&'), p -> p <> '') END"))
    out = out.withColumn("_kv", F.expr(f"array_sort(transform(_p, p -> struct({safe} AS k, {hmac_hex(key, 'query-value', value)} AS v)))"))
    out = out.withColumn("_keys", F.expr("array_sort(array_distinct(transform(_kv, x -> x.k)))"))
    bad = "contains(query, ';') OR exists(_p, p -> try_url_decode(p) IS NULL) OR (query <> '' AND size(_p) = 0)"
    out = out.withColumn("query_ok", F.expr(f"NOT ({bad})"))
    out = out.withColumn("query_keys", F.expr(f"CASE WHEN size(_keys) > {MAX_KEYS} THEN concat(slice(_keys, 1, {MAX_KEYS - 1}), array('{{overflow}}')) ELSE _keys END"))
    both = f"aggregate(_kv, X'', (a, x) -> concat(a, {length_prefixed('x.k')}, {length_prefixed('x.v')}))"
    out = out.withColumn("query_fingerprint", F.expr(f"CASE WHEN query <> '' AND size(_p) > 0 THEN {hmac_hex(key, 'query', both, 32)} END"))
    return out.drop("_p", "_kv", "_keys")


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def canonical_ipv6(ip: str) -> str:
    """Plain text of an IPv6 address, null for anything else: lower case, no leading zeros, the first of the longest runs of
    two or more zero groups as `::`; an address that maps an IPv4 one is that one. Addresses with a zone are null."""
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    dotted = f"^(.*:){_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}\\\\z"
    octet = lambda i: f"CAST(regexp_extract(x, '{dotted}', {i}) AS INT)"
    pair = lambda i: f"lower(hex({octet(i)} * 256 + {octet(i + 1)}))"
    hex_only = f"CASE WHEN NOT contains(x, '.') THEN x WHEN x RLIKE '{dotted}' THEN concat(regexp_extract(x, '{dotted}', 1), {pair(2)}, ':', {pair(4)}) END"
    side = lambda i: f"CASE WHEN coalesce(get(h, {i}), '') = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(h[{i}], ':') END"
    # a is what stands before `::`, b what stands behind it
    sides = f"named_struct('n', size(h), 'a', {side(0)}, 'b', {side(1)})"
    valid = "forall(concat(p.a, p.b), g -> g RLIKE '^[0-9a-f]{1,4}\\\\z') AND (p.n = 1 AND size(p.a) = 8 OR p.n = 2 AND size(p.a) + size(p.b) <= 7)"
    groups = f"CASE WHEN {valid} THEN transform(concat(p.a, array_repeat('0', 8 - size(p.a) - size(p.b)), p.b), g -> regexp_replace(g, '^0+(?=.)', '')) END"
    number = lambda i: f"CAST(conv(g[{i}], 16, 10) AS INT)"
    ipv4 = "concat_ws('.', " + ", ".join(f"{number(i)} div 256, {number(i)} % 256" for i in (6, 7)) + ")"
    run = "get(filter(transform(sequence(8, 2, -1), k -> concat(':', repeat('0:', k))), z -> contains(s, z)), 0)"
    short = f"CASE WHEN z IS NULL THEN trim(':' FROM s) ELSE concat(ltrim(':', substring_index(s, z, 1)), '::', rtrim(':', substr(s, locate(z, s) + length(z)))) END"
    text = f"CASE WHEN array_join(slice(g, 1, 6), ':') = '0:0:0:0:0:ffff' THEN {ipv4} WHEN g IS NOT NULL THEN {let("concat(':', array_join(g, ':'), ':')", 's', let(run, 'z', short))} END"
    return let(f"lower({ip})", "x", let(hex_only, "y", let("split(y, '::')", "h", let(sides, "p", let(groups, "g", text)))))


def referer_host(referer: str) -> str:
    """Lower-cased host of an http(s) referer without user information, if its labels are those of a DNS name; an address in
    brackets in its plain form."""
    end = "(:[0-9]*)?([/?#]|\\\\z)"
    host = f"lower(regexp_extract({referer}, '(?i)^https?://([^/?#@:\\\\[\\\\]]+){end}', 1))"
    label = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
    address = f"regexp_extract({referer}, '(?i)^https?://\\\\[([0-9a-f:.]+)\\\\]{end}', 1)"
    return f"(CASE WHEN {host} RLIKE '^{label}([.]{label})*\\\\z' THEN {host} WHEN contains({referer}, '://[') THEN {canonical_ipv6(address)} END)"


def segment_prefix(column: str, prefix: str) -> str:
    """Policy matching: the prefix itself or below it; a trailing slash does not matter. `prefix` is a literal."""
    p = prefix.rstrip("/")
    return f"{column} IS NOT NULL" if not p else f"({column} = '{p}' OR startswith({column}, '{p}/'))"


def rule_prefix(column: str, prefix: str) -> str:
    """Protection matching of two columns: equal, below, or anything that starts with a prefix ending in a slash."""
    return f"({column} = {prefix} OR startswith({column}, CASE WHEN {prefix} LIKE '%/' THEN {prefix} ELSE concat({prefix}, '/') END))"
