"""Findings: rules over the aggregate tables, one stream of rows for each kind, united and ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_id
from ..functions.numbers import ratio_ppm


@dataclass(frozen=True)
class Thresholds:
    crawltrap_min_requests: int = 1000
    crawltrap_min_url_variants: int = 200
    crawltrap_variant_ratio_ppm: int = 500_000
    query_min_requests: int = 500
    query_min_variants: int = 200
    query_variant_ratio_ppm: int = 300_000
    expensive_404_min_requests: int = 100
    expensive_404_ratio_ppm: int = 700_000
    expensive_404_min_upstream_us: int = 5_000_000
    cache_bust_min_requests: int = 500
    cache_bust_miss_ratio_ppm: int = 800_000
    automation_min_requests: int = 1000
    automation_min_routes: int = 300
    automation_4xx_ratio_ppm: int = 800_000
    automation_no_referer_ratio_ppm: int = 990_000
    automation_min_probes: int = 10
    automation_score_threshold: int = 4


COLUMNS = ("id", "kind", "severity", "route", "subject", "requests", "confidence")
_VOLUME = "CASE WHEN requests >= 1000 THEN 'high' WHEN requests >= 100 THEN 'medium' ELSE 'low' END"


def _rows(df: DataFrame, kind: str, severity: str, route: str = "NULL", subject: str = "NULL", requests: str = "requests", confidence: str = "'high'", id_subject: str | None = None) -> DataFrame:
    fid = stable_id("fd_", "finding-v1", f"'{kind}'", f"coalesce({route}, '')", f"coalesce({id_subject or subject}, '')")
    values = {"id": fid, "kind": f"'{kind}'", "severity": severity, "route": f"CAST({route} AS STRING)", "subject": f"CAST({subject} AS STRING)", "requests": f"CAST({requests} AS BIGINT)", "confidence": confidence}
    return df.select(*(F.expr(v).alias(k) for k, v in values.items()))


def crawl_traps(routes: DataFrame, total_upstream: DataFrame, t: Thresholds) -> DataFrame:
    """`total_upstream`: one row with the upstream time of all traffic."""
    cond = f"requests >= {t.crawltrap_min_requests} AND distinct_urls >= {t.crawltrap_min_url_variants} AND {ratio_ppm('distinct_urls', 'requests')} >= {t.crawltrap_variant_ratio_ppm} AND (query_requests > 0 OR contains(route, '{{'))".replace("{{", "{")
    severity = f"CASE WHEN requests div {t.crawltrap_min_requests} >= 10 AND {ratio_ppm('upstream_duration_us', '_total')} >= 10000 THEN 'high' ELSE 'medium' END"
    return _rows(routes.where(cond).crossJoin(F.broadcast(total_upstream.select(F.col("upstream_duration_us").alias("_total")))), "crawl_trap_path_cardinality", severity, "route")


def query_explosions(routes: DataFrame, t: Thresholds) -> DataFrame:
    cond = f"actionable_prefix IS NOT NULL AND query_requests >= {t.query_min_requests} AND distinct_queries >= {t.query_min_variants} AND {ratio_ppm('distinct_queries', 'query_requests')} >= {t.query_variant_ratio_ppm} AND distinct_urls >= {t.query_min_variants}"
    return _rows(routes.where(cond), "query_space_explosion", "'medium'", "route")


def expensive_404s(routes: DataFrame, t: Thresholds) -> DataFrame:
    cond = f"requests >= {t.expensive_404_min_requests} AND {ratio_ppm('status_404', 'requests')} >= {t.expensive_404_ratio_ppm} AND upstream_duration_us >= {t.expensive_404_min_upstream_us}"
    confidence = f"CASE WHEN {ratio_ppm('upstream_samples', 'requests')} < 900000 THEN 'medium' ELSE 'high' END"
    return _rows(routes.where(cond), "expensive_404", "'high'", "route", confidence=confidence)


def cache_busting(routes: DataFrame, t: Thresholds) -> DataFrame:
    cond = f"cache_eligible >= {t.cache_bust_min_requests} AND distinct_queries >= {t.query_min_variants} AND {ratio_ppm('cache_samples', 'cache_eligible')} >= 900000 AND {ratio_ppm('cache_misses', 'cache_samples')} >= {t.cache_bust_miss_ratio_ppm}"
    return _rows(routes.where(cond), "cache_busting", "'medium'", "route")


def automation(subjects: DataFrame, t: Thresholds) -> DataFrame:
    """Unclaimed clients that behave like programs. A client with several such agents is one finding: the largest score."""
    span = "(last_seen_us - first_seen_us)"
    score = f"""CASE WHEN distinct_routes >= {t.automation_min_routes} THEN 2 ELSE 0 END
      + CASE WHEN {ratio_ppm("status_4xx", "requests")} >= {t.automation_4xx_ratio_ppm} THEN 2 ELSE 0 END
      + CASE WHEN {ratio_ppm("no_referer", "requests")} >= {t.automation_no_referer_ratio_ppm} THEN 1 ELSE 0 END
      + CASE WHEN probe_requests >= {t.automation_min_probes} THEN 2 ELSE 0 END
      + CASE WHEN {span} >= 600000000 AND requests >= ({span} - 1) div 1000000 + 1 THEN 1 ELSE 0 END"""
    scored = subjects.where(f"NOT claimed AND requests >= {t.automation_min_requests}").withColumn("score", F.expr(score)).where(f"score >= {t.automation_score_threshold}")
    best = scored.groupBy("client_key").agg(F.max(F.struct("score", F.col("probe_requests").alias("p"), "requests")).alias("b"))
    best = best.select("client_key", "b.score", "b.p", "b.requests")
    confidence = f"CASE WHEN score < {t.automation_score_threshold + 2} THEN 'low' WHEN p >= {t.automation_min_probes} THEN 'high' ELSE 'medium' END"
    return _rows(best, "automation_candidate", "'medium'", subject="concat(substr(client_key, 1, 12), '…')", confidence=confidence, id_subject="client_key")


def robots(violations: DataFrame) -> DataFrame:
    return _rows(violations, "robots_violation", _VOLUME, "route", "crawler")


def probes(hits: DataFrame) -> DataFrame:
    return _rows(hits, "security_probe", _VOLUME, "route", "probe_id")


def missing_metrics(summary: DataFrame) -> DataFrame:
    pairs = "stack(3, 'request_duration', request_duration_samples, 'upstream_duration', upstream_samples, 'cache_state', cache_samples) AS (metric, samples)"
    return _rows(summary.select("accepted", F.expr(pairs)).where("accepted > 0 AND samples = 0"), "metrics_missing", "'info'", subject="metric", requests="0")


def overflow(counts: DataFrame) -> DataFrame:
    """`counts`: one row with the overflow count."""
    return _rows(counts.where("overflow > 0"), "cardinality_overflow", "'medium'", subject="'bounded_dimensions'", requests="0")


def order_degraded(flags: DataFrame) -> DataFrame:
    """`flags`: one row with order_degraded."""
    return _rows(flags.where("order_degraded"), "input_order_degraded", "'medium'", subject="'rate_model'", requests="0")


def united(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    return out


def ranked(findings: DataFrame, n: int = 10_000) -> DataFrame:
    """Gravest first, then kind, route and subject."""
    rank = F.expr("CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END")
    return findings.orderBy(rank.desc(), "kind", F.coalesce("route", F.lit("")), F.coalesce("subject", F.lit(""))).limit(n)


#: What each kind of route finding rests on: names of columns of the route report.
EVIDENCE = {
    "crawl_trap_path_cardinality": ("requests", "distinct_urls", "query_requests", "upstream_duration_us"),
    "query_space_explosion": ("query_requests", "distinct_queries", "distinct_urls"),
    "expensive_404": ("requests", "status_404", "upstream_duration_us", "upstream_samples"),
    "cache_busting": ("cache_eligible", "cache_samples", "cache_misses", "distinct_queries"),
}


def with_evidence(findings: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds evidence: for findings about routes, structs (metric, value) by metric; null for others."""
    names = sorted({m for ms in EVIDENCE.values() for m in ms})
    own = routes.select(F.col("route").alias("_route"), *(F.col(m).cast("bigint").alias(f"_{m}") for m in names))
    each = lambda ms: F.array_sort(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("value")) for m in ms)))
    evidence = F.coalesce(*(F.when(F.col("kind") == k, each(ms)) for k, ms in EVIDENCE.items()))
    return findings.join(own, findings["route"] == own["_route"], "left").select(*findings.columns, F.when(F.col("_route").isNotNull(), evidence).alias("evidence"))


def route_ids(events: DataFrame) -> DataFrame:
    """The route dimension: (route, actionable_prefix, id); ids grow with first arrival and never change."""
    return events.groupBy("route", "actionable_prefix").agg(F.min("seq").alias("id"))


def with_route_id(findings: DataFrame, dimension: DataFrame) -> DataFrame:
    """Adds route_id: the lowest id of the variants of the finding's route, null without such a route."""
    lowest = dimension.groupBy(F.col("route").alias("_route")).agg(F.min("id").alias("route_id"))
    return findings.join(lowest, findings["route"] == lowest["_route"], "left").drop("_route")
