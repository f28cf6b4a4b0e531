"""Log lines to records: one anchored regular expression, or a variant with its types checked. No inference anywhere.

Each parser takes (seq, line) and returns seq, line_code and the record columns. line_code is null for a parsed line,
`empty_line` for one to skip, else the reason of its rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crawlers import catalog
from ..functions.numbers import optional_us, seconds_to_us, upstream_us
from ..functions.probes import STATIC_SIGNATURES
from ..functions.urls import CONTROL, canonical_ipv6

RECORD_COLUMNS = ("ts_us", "client_ip", "method", "request_uri", "status", "bytes_sent", "request_duration_us", "upstream_duration_us", "cache_state", "user_agent", "referer")
PROTOCOLS = ("HTTP/0.9", "HTTP/1.0", "HTTP/1.1", "HTTP/2.0", "HTTP/3.0")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:[.]{_OCTET}){{3}}\\z"


def canonical_ip(ip: str) -> Column:
    """Plain form of an address, null for anything else. `ip` is an expression."""
    return F.expr(f"CASE WHEN {ip} RLIKE '{_IPV4}' THEN {ip} WHEN contains({ip}, ':') THEN {canonical_ipv6(ip)} END")


def _integer(text: str) -> str:
    return f"CASE WHEN {text} RLIKE '^[+-]?[0-9]{{1,18}}\\\\z' THEN CAST({text} AS BIGINT) END"


def _finish(df: DataFrame, code: str, values: dict[str, str]) -> DataFrame:
    out = df.withColumns({f"_{k}": F.expr(v) for k, v in values.items() if k != "error_class"})
    out = out.withColumn("line_code", F.expr(code))
    if "error_class" in values:
        out = out.withColumn("_error_class", F.expr(values["error_class"]))
    further = [c for c in ("flag", "nginx_uri", "limit_req_status", "error_class") if c in values]
    return out.select("seq", "line_code", *(F.col(f"_{c}").alias(c) for c in (*RECORD_COLUMNS, *further)))


def nginx_combined(lines: DataFrame) -> DataFrame:
    """Plain access log. Durations are unknown and so is the cache state; `-` stays as it is in referer and agent."""
    quoted = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
    shape = rf'^[ \t]*([^ \t]+)[ \t]+[^ \t]+[ \t]+[^ \t]+[ \t]*\[([^\[\]]*)\][ \t]*{quoted}[ \t]*([^ \t]+)[ \t]+([^ \t]+)[ \t]*{quoted}[ \t]*{quoted}(.*)\z'
    part = lambda i: F.regexp_extract("line", shape, i)
    plain = lambda c: F.regexp_replace(c, r'\\(["\\])', "$1")
    out = lines.select("seq", "line", F.rlike("line", F.lit(shape)).alias("ok"), part(1).alias("ip"), part(2).alias("time"), plain(part(3)).alias("request"), part(4).alias("status_text"), part(5).alias("bytes_text"), plain(part(6)).alias("referer_text"), plain(part(7)).alias("agent"), part(8).alias("rest"))
    out = out.withColumn("words", F.expr("filter(split(request, '[ \\\\t\\\\n\\\\x0b\\\\f\\\\r]+'), x -> x <> '')")).withColumn("canonical", canonical_ip("ip"))
    out = out.withColumn("at", F.expr("try_to_timestamp(time, 'dd/MMM/yyyy:HH:mm:ss Z')"))
    protocols = ", ".join(f"'{p}'" for p in PROTOCOLS)
    code = f"""CASE WHEN line = '' THEN 'empty_line' WHEN NOT ok THEN 'invalid_structure' WHEN trim(rest) <> '' THEN 'trailing_data' WHEN request = '-' THEN 'missing_request'
      WHEN size(words) <> 3 THEN 'invalid_structure' WHEN words[2] NOT IN ({protocols}) THEN 'unsupported_protocol' WHEN at IS NULL THEN 'invalid_timestamp'
      WHEN canonical IS NULL THEN 'invalid_ip' WHEN _status IS NULL THEN 'invalid_status' WHEN _bytes_sent IS NULL THEN 'invalid_bytes' END"""
    return _finish(out, code, {
        "ts_us": "unix_micros(at)", "client_ip": "canonical", "method": "get(words, 0)", "request_uri": "get(words, 1)", "status": f"try_cast({_integer('status_text')} AS INT)", "bytes_sent": _integer("bytes_text"),
        "request_duration_us": "CAST(NULL AS BIGINT)", "upstream_duration_us": "CAST(NULL AS BIGINT)", "cache_state": "'unknown'", "user_agent": "agent", "referer": "referer_text",
    })


def _variant(lines: DataFrame) -> DataFrame:
    """Adds v and its schema as text; null where the line is no JSON object, has a repeated key or something after it."""
    out = lines.withColumn("v", F.try_parse_json(F.when(F.rlike("line", F.lit(r"(?s)^\s*\{.*\}\s*\z")), F.col("line"))))
    # as the only element of an array, so that nothing may follow it
    alone = F.try_parse_json(F.concat(F.lit("["), F.col("line"), F.lit("]")))
    one = alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
    return out.withColumn("shape", F.when(one, F.schema_of_variant("v")))


def cache_state(text: str) -> str:
    return f"CASE WHEN upper({text}) IN ('HIT', 'MISS', 'BYPASS', 'EXPIRED', 'STALE') THEN lower({text}) ELSE 'unknown' END"


def nginx_json(lines: DataFrame, protection: bool = False) -> DataFrame:
    """Structured access log: all values are JSON strings; further keys are ignored. flag: an unknown cache state.

    With `protection` the record of the flood detector: all keys and two more have to be there, nginx_uri and
    limit_req_status are added, and error_class says whether a rejected line's content or its structure is at fault."""
    required = ("timestamp", "remote_addr", "method", "uri", "status", "bytes_sent")
    optional = ("request_time", "upstream_response_time", "upstream_cache_status", "user_agent", "referer")
    out = _variant(lines)
    for name in required + optional:
        out = out.withColumn(f"j_{name}", F.expr(f"coalesce(try_variant_get(v, '$.{name}', 'string'), '')"))
    strings = " AND ".join(f"shape RLIKE '[<, ]{n}: STRING'" for n in required)
    typed = f"shape RLIKE '(^OBJECT<|, )({'|'.join(required + optional)}): (?!STRING|VOID)'"
    out = out.withColumn("canonical", canonical_ip("j_remote_addr"))
    out = out.withColumn("at", F.expr("CASE WHEN j_timestamp RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\\\\z' THEN try_to_timestamp(j_timestamp) END"))
    bad_duration = "(_request_duration_us IS NULL AND j_request_time NOT IN ('', '-')) OR exists(transform(split(j_upstream_response_time, ','), x -> trim(x)), x -> x NOT IN ('', '-') AND NOT x RLIKE '^[0-9]+([.][0-9]+)?\\\\z')"
    code = f"""CASE WHEN line = '' THEN 'empty_line' WHEN shape IS NULL OR NOT ({strings}) OR {typed} THEN 'invalid_json' WHEN at IS NULL THEN 'invalid_timestamp'
      WHEN canonical IS NULL THEN 'invalid_ip' WHEN _status IS NULL THEN 'invalid_status' WHEN _bytes_sent IS NULL THEN 'invalid_bytes' WHEN {bad_duration} THEN 'invalid_duration' END"""
    blank = lambda c: f"CASE WHEN {c} = '-' THEN '' ELSE {c} END"
    more = {}
    if protection:
        for name in ("nginx_uri", "limit_req_status"):
            out = out.withColumn(f"j_{name}", F.expr(f"coalesce(try_variant_get(v, '$.{name}', 'string'), '')"))
        every = " AND ".join(f"shape RLIKE '[<, ]{n}: STRING'" for n in (*required, *optional, "nginx_uri", "limit_req_status"))
        broken = f"line <> '' AND NOT coalesce({every}, false)"
        content = f"""WHEN octet_length(j_nginx_uri) NOT BETWEEN 1 AND 65536 OR NOT startswith(j_nginx_uri, '/') OR j_nginx_uri RLIKE '{CONTROL}' THEN 'invalid_nginx_uri'
          WHEN j_limit_req_status NOT IN ('', '-', 'PASSED', 'DELAYED', 'REJECTED', 'DELAYED_DRY_RUN', 'REJECTED_DRY_RUN') OR j_limit_req_status = 'REJECTED' AND _status <> 429 THEN 'invalid_limit_req_status' END"""
        code = f"CASE WHEN {broken} THEN 'invalid_json' " + code.removeprefix("CASE ").removesuffix("END") + content
        more = {"nginx_uri": "j_nginx_uri", "limit_req_status": "j_limit_req_status", "error_class": f"CASE WHEN {broken} THEN 'sensor_structure' WHEN line_code IS NOT NULL THEN 'record_content' END"}
    return _finish(out, code, more | {
        "ts_us": "unix_micros(at)", "client_ip": "canonical", "method": "j_method", "request_uri": "j_uri", "status": f"try_cast({_integer('j_status')} AS INT)", "bytes_sent": _integer("j_bytes_sent"),
        "request_duration_us": optional_us("j_request_time"), "upstream_duration_us": upstream_us("j_upstream_response_time"), "cache_state": cache_state("j_upstream_cache_status"),
        "user_agent": blank("j_user_agent"), "referer": blank("j_referer"), "flag": "upper(j_upstream_cache_status) NOT IN ('', '-', 'HIT', 'MISS', 'BYPASS', 'EXPIRED', 'STALE')",
    })


def caddy_json(lines: DataFrame) -> DataFrame:
    """Structured access log with numbers and nested headers; the first value of a header counts. flag: it had several."""
    out = _variant(lines)
    paths = {"ts": "$.ts", "status": "$.status", "size": "$.size", "duration": "$.duration", "ip": "$.request.remote_ip", "method": "$.request.method", "uri": "$.request.uri", "ua": "$.request.headers[\"User-Agent\"][0]", "ua2": "$.request.headers[\"User-Agent\"][1]", "ref": "$.request.headers.Referer[0]", "ref2": "$.request.headers.Referer[1]"}
    for name, path in paths.items():
        out = out.withColumn(f"j_{name}", F.expr(f"try_variant_get(v, '{path}', 'string')"))
    number = lambda n: f"shape RLIKE '[<, ]{n}: (BIGINT|DECIMAL)'"
    out = out.withColumn("canonical", canonical_ip("j_ip"))
    typed = " AND ".join([number("ts"), number("duration"), "shape RLIKE '[<, ]status: BIGINT'", "shape RLIKE '[<, ]size: BIGINT'"])
    present = "shape RLIKE '[<, ]request: OBJECT' AND j_ip IS NOT NULL AND j_method IS NOT NULL AND j_uri IS NOT NULL"
    doubles = "shape RLIKE '[<, ](ts|duration): DOUBLE'"
    code = f"""CASE WHEN line = '' THEN 'empty_line' WHEN shape IS NULL OR NOT ({present}) THEN 'invalid_json' WHEN {doubles} THEN 'invalid_duration' WHEN NOT ({typed}) THEN 'invalid_json'
      WHEN _ts_us IS NULL THEN 'invalid_timestamp' WHEN _request_duration_us IS NULL THEN 'invalid_duration' WHEN canonical IS NULL THEN 'invalid_ip' WHEN _status IS NULL THEN 'invalid_status' WHEN _bytes_sent IS NULL THEN 'invalid_bytes' END"""
    return _finish(out, code, {
        "ts_us": seconds_to_us("coalesce(j_ts, '')"), "client_ip": "canonical", "method": "j_method", "request_uri": "j_uri", "status": f"try_cast({_integer('j_status')} AS INT)", "bytes_sent": _integer("j_size"),
        "request_duration_us": seconds_to_us("coalesce(j_duration, '')"), "upstream_duration_us": "CAST(NULL AS BIGINT)", "cache_state": "'unknown'", "user_agent": "coalesce(j_ua, '')", "referer": "coalesce(j_ref, '')", "flag": "j_ua2 IS NOT NULL OR j_ref2 IS NOT NULL",
    })


#: Keys of a canonical event with their JSON types; a type with a question mark may be null.
CANONICAL = {
    "schema_version": "BIGINT", "timestamp": "STRING", "client_key": "STRING", "method": "STRING", "route": "STRING", "actionable_prefix": "STRING?", "url_fingerprint": "STRING",
    "query_keys": "ARRAY<STRING>", "query_fingerprint": "STRING?", "status": "BIGINT", "bytes_sent": "BIGINT", "request_duration_us": "BIGINT?", "upstream_duration_us": "BIGINT?",
    "cache_state": "STRING", "ua_hash": "STRING", "claimed_crawler": "STRING?", "claimed_category": "STRING?", "claimed_protected_default": "BOOLEAN?", "referer_host": "STRING?",
    "security_probe_ids": "ARRAY<STRING>", "robots_allowed": "BOOLEAN?",
}

_SPARK_TYPE = {"STRING": "string", "BIGINT": "bigint", "BOOLEAN": "boolean", "ARRAY<STRING>": "array<string>"}


def canonical_line(events: DataFrame) -> DataFrame:
    """(seq, line): events as closed JSON with every key of CANONICAL, nulls written out."""
    claim = {"claimed_crawler": "claim.name", "claimed_category": "claim.category", "claimed_protected_default": "claim.protected_default"}
    values = {"schema_version": "1L", "timestamp": "date_format(timestamp_micros(ts_us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"} | claim
    return events.select("seq", F.to_json(F.struct(*(F.expr(values.get(k, k)).alias(k) for k in CANONICAL)), {"ignoreNullFields": "false"}).alias("line"))


def canonical_json(lines: DataFrame) -> DataFrame:
    """Canonical events from closed JSON: seq, line_code, flag (nanoseconds were cut off) and the event's columns.

    All keys have to be there and no other; a claim is whole or absent and as the catalog has it; the time is in UTC."""
    out = _variant(lines)
    keys = "map_keys(CAST(v AS MAP<STRING, VARIANT>))"
    out = out.withColumn("keys", F.expr(f"CASE WHEN shape IS NOT NULL THEN {keys} END"))
    for name, kind in CANONICAL.items():
        out = out.withColumn(f"t_{name}", F.expr(f"schema_of_variant(try_variant_get(v, '$.{name}', 'variant'))"))
        out = out.withColumn(f"j_{name}", F.expr(f"try_variant_get(v, '$.{name}', '{_SPARK_TYPE[kind.removesuffix('?')]}')"))

    def typed(name: str, kind: str) -> str:
        plain, array = kind.removesuffix("?"), kind.startswith("ARRAY")
        allowed = [f"'{plain}'", *(["'ARRAY<VOID>'"] if array else []), *(["'VOID'"] if kind.endswith("?") else [])]
        more = f" AND (t_{name} <> 'ARRAY<VOID>' OR size(j_{name}) = 0)" if array else ""
        return f"coalesce(t_{name} IN ({', '.join(allowed)}){more}, false)"

    names = ", ".join(f"'{k}'" for k in CANONICAL)
    claims = "(CASE WHEN j_claimed_crawler IS NULL THEN 0 ELSE 1 END + CASE WHEN j_claimed_category IS NULL THEN 0 ELSE 1 END + CASE WHEN j_claimed_protected_default IS NULL THEN 0 ELSE 1 END)"
    hex_ = lambda c, n: f"{c} RLIKE '^[0-9a-f]{{{n}}}\\\\z'"
    sorted_ = lambda c: f"{c} = array_sort(array_distinct({c}))"
    text = lambda c, n: f"(octet_length({c}) BETWEEN 1 AND {n} AND NOT {c} RLIKE '{CONTROL}')"
    probes = ", ".join(f"'{k}'" for k in STATIC_SIGNATURES)
    entries = ", ".join(f"'{e['name']} {e['category']} {str(e['protected_default']).lower()}'" for e in catalog())
    valid = " AND ".join([
        "at IS NOT NULL AND unix_micros(at) > 0", hex_("j_client_key", 32), hex_("j_url_fingerprint", 32), hex_("j_ua_hash", 64), "j_method RLIKE '^[A-Z][A-Z0-9_-]{0,15}\\\\z'",
        text("j_route", 512), "startswith(j_route, '/')", "(j_actionable_prefix IS NULL OR startswith(j_actionable_prefix, '/') AND " + text("j_actionable_prefix", 512) + ")", "j_status BETWEEN 100 AND 599", "j_bytes_sent >= 0",
        "coalesce(j_request_duration_us, 0) >= 0", "coalesce(j_upstream_duration_us, 0) >= 0", "j_cache_state IN ('hit', 'miss', 'bypass', 'expired', 'stale', 'unknown')",
        sorted_("j_query_keys"), "size(j_query_keys) <= 32", f"forall(j_query_keys, x -> {text('x', 80)})", "(size(j_query_keys) = 0) = (j_query_fingerprint IS NULL)",
        f"(j_query_fingerprint IS NULL OR {hex_('j_query_fingerprint', 32)})", sorted_("j_security_probe_ids"), f"forall(j_security_probe_ids, x -> x IN ({probes}))",
        "(j_claimed_crawler IS NOT NULL OR j_robots_allowed IS NULL)", "(j_referer_host IS NULL OR " + text("j_referer_host", 253) + ")",
    ])
    utc = "j_timestamp RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}([.][0-9]+)?(Z|[+-]00:00)\\\\z'"
    out = out.withColumn("at", F.expr(f"CASE WHEN {utc} THEN try_to_timestamp(regexp_replace(j_timestamp, '([.][0-9]{{6}})[0-9]+', '$1')) END"))
    code = f"""CASE WHEN line = '' THEN 'empty_line' WHEN shape IS NULL OR size(array_except(array({names}), keys)) > 0 THEN 'invalid_json' WHEN size(array_except(keys, array({names}))) > 0 THEN 'unknown_field'
      WHEN NOT ({" AND ".join(typed(k, v) for k, v in CANONICAL.items())}) OR j_schema_version <> 1 THEN 'invalid_json' WHEN at IS NULL THEN 'invalid_timestamp' WHEN {claims} NOT IN (0, 3) THEN 'invalid_json' WHEN NOT coalesce({valid}, false) THEN 'invalid_json'
      WHEN {claims} = 3 AND concat_ws(' ', j_claimed_crawler, j_claimed_category, CAST(j_claimed_protected_default AS STRING)) NOT IN ({entries}) THEN 'invalid_claim' END"""
    out = out.withColumn("line_code", F.expr(code))
    claim = F.expr("CASE WHEN j_claimed_crawler IS NOT NULL THEN struct(j_claimed_crawler AS name, j_claimed_category AS category, j_claimed_protected_default AS protected_default) END")
    cut = F.expr("regexp_extract(j_timestamp, '[.][0-9]{6}([0-9]*)', 1) RLIKE '[1-9]'")
    primary = F.expr("CASE WHEN size(j_security_probe_ids) > 0 THEN 'security_probe' WHEN j_claimed_crawler IS NOT NULL THEN j_claimed_category ELSE 'unclassified' END")
    rest = [F.col(f"j_{k}").alias(k) for k in CANONICAL if not k.startswith("claimed_") and k not in ("schema_version", "timestamp", "status")]
    return out.select("seq", "line_code", cut.alias("flag"), F.unix_micros("at").alias("ts_us"), F.col("j_status").cast("int").alias("status"), *rest, claim.alias("claim"), primary.alias("primary_class"))


PARSERS = {"nginx-combined": nginx_combined, "nginx-json": nginx_json, "caddy-json": caddy_json}
