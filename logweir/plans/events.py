"""From parsed records to normalised, pseudonymised events; rejected rows keep their reason and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crawlers import with_claim
from ..functions.hashing import hmac_hex
from ..functions.probes import RobotsRule, robots_allowed, security_probes
from ..functions.urls import CONTROL, normalise_route, prefix_safe, query_keys, referer_host, split_target

MINUTE_US = 60_000_000

EVENT_COLUMNS = (
    "seq", "ts_us", "minute_us", "client_key", "method", "route", "actionable_prefix", "url_fingerprint", "query_keys", "query_fingerprint", "status", "bytes_sent",
    "request_duration_us", "upstream_duration_us", "cache_state", "ua_hash", "ua_key", "claim", "referer_host", "security_probe_ids", "robots_allowed", "primary_class", "claim_matches",
)

#: Checks of a raw record in the order in which the first failure names the reason.
RAW_CHECKS = (
    ("invalid_timestamp", "ts_us IS NULL OR ts_us <= 0"),
    ("invalid_ip", "client_ip IS NULL OR client_ip = ''"),
    ("invalid_method", "method IS NULL OR NOT upper(method) RLIKE '^[A-Z][A-Z0-9_-]{0,15}\\\\z'"),
    ("invalid_uri", f"request_uri IS NULL OR octet_length(request_uri) NOT BETWEEN 1 AND 65536 OR request_uri RLIKE '{CONTROL}'"),
    ("invalid_status", "status IS NULL OR status NOT BETWEEN 100 AND 599"),
    ("invalid_bytes", "bytes_sent IS NULL OR bytes_sent < 0"),
    ("invalid_duration", "request_duration_us < 0 OR upstream_duration_us < 0"),
    ("invalid_user_agent", f"octet_length(user_agent) > 4096 OR user_agent RLIKE '{CONTROL}'"),
    ("invalid_referer", f"octet_length(referer) > 8192 OR referer RLIKE '{CONTROL}'"),
)


def raw_code() -> str:
    return "CASE " + " ".join(f"WHEN {check} THEN '{code}'" for code, check in RAW_CHECKS) + " END"


def normalised(records: DataFrame, key: bytes, robots: list[RobotsRule] | None = None) -> DataFrame:
    """Every record with its event columns and reject_code (null for an accepted event)."""
    out = records.withColumn("raw_code", F.expr(raw_code()))
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("request_uri", "user_agent", "referer")})
    out = out.withColumn("method", F.upper("method"))
    out = query_keys(normalise_route(split_target(out), key), key)
    out = with_claim(out)
    decoded = "CASE WHEN uri_ok AND path_ok THEN decoded_path END"
    out = out.withColumn("security_probe_ids", F.expr(security_probes("method", "request_uri", decoded, "status")))
    target = "CASE WHEN query = '' THEN path ELSE concat(path, '?', query) END"
    verdict = f"CASE WHEN claim IS NOT NULL THEN {robots_allowed(robots, 'claim.name', target)} END" if robots is not None else "CAST(NULL AS BOOLEAN)"
    pick = {
        "robots_allowed": verdict,
        "referer_host": referer_host("referer"),
        "client_key": hmac_hex(key, "client", "client_ip", 32),
        "url_fingerprint": hmac_hex(key, "url", "request_uri", 32),
        "ua_hash": hmac_hex(key, "ua", "user_agent"),
        "minute_us": f"ts_us - ts_us % {MINUTE_US}",
        "cache_state": "CASE WHEN lower(cache_state) IN ('hit', 'miss', 'bypass', 'expired', 'stale') THEN lower(cache_state) ELSE 'unknown' END",
    }
    out = out.withColumns({k: F.expr(v) for k, v in pick.items()})
    out = out.withColumn("primary_class", F.expr("CASE WHEN size(security_probe_ids) > 0 THEN 'security_probe' WHEN claim IS NOT NULL THEN claim.category ELSE 'unclassified' END"))
    out = out.withColumn("ua_key", F.expr("CASE WHEN claim IS NOT NULL THEN sha2(concat(X'636c61696d00', CAST(claim.name AS BINARY)), 256) ELSE ua_hash END"))
    bad = f"NOT uri_ok OR NOT path_ok OR NOT query_ok OR NOT {prefix_safe('actionable_prefix')}"
    return out.withColumn("reject_code", F.expr(f"CASE WHEN raw_code IS NOT NULL THEN raw_code WHEN {bad} THEN 'invalid_uri' END"))


def _where(df: DataFrame, condition: str) -> DataFrame:
    """A filter that stays above the projections it tests.

    Pushed down it would be rewritten over the raw columns, with the whole chain of expressions copied for each use;
    the row number, which no rule moves, keeps the test where its columns already are."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(f"{condition} AND _row >= 0").drop("_row")


def events(records: DataFrame, key: bytes, robots: list[RobotsRule] | None = None) -> DataFrame:
    """Accepted events only; addresses, targets, agents and referers are gone."""
    return _where(normalised(records, key, robots), "reject_code IS NULL").select(*EVENT_COLUMNS)


def rejects(records: DataFrame, key: bytes) -> DataFrame:
    """(seq, code) of rejected records; never any content."""
    return _where(normalised(records, key), "reject_code IS NOT NULL").select("seq", F.col("reject_code").alias("code"))
