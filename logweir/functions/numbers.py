"""Exact integer arithmetic: ratios, roundings, durations from decimal text. Builders of Spark SQL expressions."""

from __future__ import annotations


def ratio_ppm(n: str, d: str) -> str:
    """Parts per million, rounded down; 0 unless both are positive, at most 1 000 000."""
    return f"(CASE WHEN {n} > 0 AND {d} > 0 THEN least(1000000L, CAST({n} AS DECIMAL(20,0)) * 1000000 div {d}) ELSE 0L END)"


def half_up(n: str, d: str) -> str:
    """n / d of non-negative decimals rounded half up."""
    return f"(({n}) div ({d}) + CASE WHEN 2 * (({n}) % ({d})) >= ({d}) THEN 1L ELSE 0L END)"


def seconds_to_us(text: str) -> str:
    """Decimal seconds as text to microseconds, half up at the seventh digit; null for anything else."""
    whole, part = f"regexp_extract({text}, '^([0-9]+)', 1)", f"rpad(regexp_extract({text}, '[.]([0-9]+)$', 1), 7, '0')"
    value = f"CAST({whole} AS DECIMAL(20,0)) * 1000000 + CAST(substr({part}, 1, 6) AS BIGINT) + CASE WHEN substr({part}, 7, 1) >= '5' THEN 1 ELSE 0 END"
    return f"(CASE WHEN {text} RLIKE '^[0-9]{{1,15}}([.][0-9]+)?\\\\z' THEN try_cast({value} AS BIGINT) END)"


def optional_us(text: str) -> str:
    """Like seconds_to_us; missing and `-` are null."""
    return f"(CASE WHEN {text} IN ('', '-') THEN NULL ELSE {seconds_to_us(text)} END)"


def upstream_us(text: str) -> str:
    """Sum of a comma-separated list of durations without its `-` entries; null when nothing is left."""
    parts = f"filter(transform(split({text}, ','), x -> trim(x)), x -> x NOT IN ('-', ''))"
    us = seconds_to_us("x")
    return f"(CASE WHEN size({parts}) > 0 THEN aggregate(transform({parts}, x -> {us}), 0L, (a, x) -> a + x) END)"


def zone_mib(states: str) -> str:
    """Memory of a rate zone: 512 bytes a state, whole MiB, 1 at least."""
    return f"greatest(1L, ({states} * 512 + 1048575) div 1048576)"


def threshold(p99: str, floor: int, multiplier: int, window_s: int) -> str:
    """Baseline per minute scaled to the window, rounded up, times the multiplier; never under the floor."""
    return f"greatest({floor}L, (({p99} * {window_s} + 59) div 60) * {multiplier})"


def rfc3339(us: str) -> str:
    """Microseconds as a UTC time in RFC 3339 form, without zeros at the end of its fraction."""
    text = f"date_format(timestamp_micros({us}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    return f"concat(CASE WHEN {us} % 1000000 = 0 THEN substr({text}, 1, 19) ELSE regexp_replace({text}, '0+\\\\z', '') END, 'Z')"
