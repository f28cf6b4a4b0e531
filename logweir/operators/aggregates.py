"""Star schema of an analysis: the fact cube, its grouped statistics and the report tables on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kmv
from ..functions.numbers import ratio_ppm

CELL_KEYS = ("minute_us", "route", "actionable_prefix", "ua_key", "primary_class", "method", "status", "cache_state")
OVERFLOW_ROUTE, OVERFLOW_UA = "/{overflow}", "0" * 64


def _n(cond: str | None = None, name: str = "requests"):
    return (F.count(F.lit(1)) if cond is None else F.sum(F.expr(f"CASE WHEN {cond} THEN 1L ELSE 0L END"))).alias(name)


def cells(events: DataFrame) -> DataFrame:
    """Fact cube. Sums of durations are null exactly where there is no sample."""
    return events.groupBy(*CELL_KEYS).agg(
        _n(),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.sum("request_duration_us").alias("request_duration_us"),
        F.count("request_duration_us").alias("request_duration_samples"),
        F.sum("upstream_duration_us").alias("upstream_duration_us"),
        F.count("upstream_duration_us").alias("upstream_samples"),
        F.count("referer_host").alias("referer_present"),
    )


def merge_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Additive merge of two partial cubes: what an upsert of a new batch into an old one amounts to."""
    both = a.unionByName(b)
    sums = [c for c in a.columns if c not in CELL_KEYS]
    return both.groupBy(*CELL_KEYS).agg(*(F.sum(c).alias(c) for c in sums))


def route_stats(events: DataFrame) -> DataFrame:
    """One row for each (route, actionable_prefix), with distinct sketches of clients, targets and queries."""
    keys = ["route", "actionable_prefix"]
    cacheable = "method IN ('GET', 'HEAD')"
    stats = events.groupBy(*keys).agg(
        _n(),
        _n("query_fingerprint IS NOT NULL", "query_requests"),
        _n("status = 404", "status_404"),
        _n(f"{cacheable}", "cache_eligible"),
        _n(f"{cacheable} AND cache_state <> 'unknown'", "cache_samples"),
        _n(f"{cacheable} AND cache_state IN ('miss', 'bypass', 'expired')", "cache_misses"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.sum("upstream_duration_us").alias("upstream_duration_us"),
        F.count("upstream_duration_us").alias("upstream_samples"),
    )
    for value, name in (("client_key", "clients_sketch"), ("url_fingerprint", "urls_sketch"), ("query_fingerprint", "queries_sketch")):
        s = kmv.sketch(events, keys, value, name).withColumnsRenamed({k: f"_{k}" for k in keys})
        on = [stats["route"] == s["_route"], stats["actionable_prefix"].eqNullSafe(s["_actionable_prefix"])]
        stats = stats.join(s, on, "left").drop("_route", "_actionable_prefix")
    return stats


def route_report(stats: DataFrame) -> DataFrame:
    """Variants of a route merged by its path: the prefix stays only where all variants share it; distinct counts are
    the conservative estimates of the merged sketches."""
    sums = ("requests", "query_requests", "status_404", "cache_eligible", "cache_samples", "cache_misses", "bytes_sent", "upstream_samples")
    fold = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, kmv.K).alias(c)
    sketches = ("clients_sketch", "urls_sketch", "queries_sketch")
    same = "count(actionable_prefix) = count(1) AND min(actionable_prefix) = max(actionable_prefix)"
    out = stats.groupBy("route").agg(
        *(F.sum(c).alias(c) for c in sums),
        F.sum("upstream_duration_us").alias("upstream_duration_us"),
        F.expr(f"CASE WHEN {same} THEN min(actionable_prefix) END").alias("actionable_prefix"),
        *(fold(c) for c in sketches),
    )
    names = {"clients_sketch": "distinct_clients", "urls_sketch": "distinct_urls", "queries_sketch": "distinct_queries"}
    for c, name in names.items():
        out = out.withColumn(name, F.expr(kmv.conservative(c, "requests")))
    approximate = " OR ".join(f"size({c}) = {kmv.K}" for c in sketches)
    return out.withColumn("distinct_approximate", F.expr(approximate)).drop(*sketches)


def subject_stats(events: DataFrame) -> DataFrame:
    """One row for each (client_key, ua_key)."""
    keys = ["client_key", "ua_key"]
    stats = events.groupBy(*keys).agg(
        _n(),
        _n("status BETWEEN 400 AND 499", "status_4xx"),
        _n("referer_host IS NULL", "no_referer"),
        _n("size(security_probe_ids) > 0", "probe_requests"),
        _n("NOT coalesce(robots_allowed, true)", "robots_violations"),
        F.min("ts_us").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.max(F.col("claim").isNotNull()).alias("claimed"),
    )
    return stats.join(kmv.sketch(events, keys, "route", "routes_sketch"), keys, "left").withColumn("distinct_routes", F.expr(kmv.conservative("routes_sketch", "requests")))


def robots_violations(events: DataFrame) -> DataFrame:
    return events.where("robots_allowed = false").groupBy(F.col("claim.name").alias("crawler"), "route").agg(_n())


def route_query_keys(events: DataFrame) -> DataFrame:
    return events.select("route", F.explode("query_keys").alias("query_key")).groupBy("route", "query_key").agg(_n())


def probe_hits(events: DataFrame) -> DataFrame:
    """Hits by signature and the route's actionable prefix, or the route without one."""
    one = events.select(F.explode("security_probe_ids").alias("probe_id"), F.coalesce("actionable_prefix", "route").alias("route"))
    return one.groupBy("probe_id", "route").agg(_n())


def user_agents(events: DataFrame) -> DataFrame:
    """Dimension: one row for each agent key, with the claim it makes."""
    return events.groupBy("ua_key").agg(F.max("claim.name").alias("crawler"), F.max("claim.category").alias("category"), F.max("claim.protected_default").alias("protected_default"))


def summary(events: DataFrame) -> DataFrame:
    return events.agg(
        _n(name="accepted"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"),
        F.sum("request_duration_us").alias("request_duration_us"),
        F.count("request_duration_us").alias("request_duration_samples"),
        F.sum("upstream_duration_us").alias("upstream_duration_us"),
        F.count("upstream_duration_us").alias("upstream_samples"),
        F.coalesce(_n("cache_state <> 'unknown'", "cache_samples"), F.lit(0)).alias("cache_samples"),
        F.count("referer_host").alias("referer_present"),
        F.count("robots_allowed").alias("robots_checked"),
        F.min("ts_us").alias("first_event_us"),
        F.max("ts_us").alias("last_event_us"),
    )


def coverage(events: DataFrame) -> DataFrame:
    """How much of the traffic carries each optional metric, in parts per million."""
    s = summary(events)
    pairs = {"request_duration_ppm": "request_duration_samples", "upstream_ppm": "upstream_samples", "cache_ppm": "cache_samples", "referer_ppm": "referer_present", "robots_ppm": "robots_checked"}
    return s.select("accepted", *(F.expr(ratio_ppm(n, "accepted")).alias(k) for k, n in pairs.items()))


def classes(cube: DataFrame) -> DataFrame:
    return cube.groupBy("primary_class").agg(F.sum("requests").alias("requests"), F.sum("bytes_sent").alias("bytes_sent"), F.sum("upstream_duration_us").alias("upstream_duration_us"), F.sum("upstream_samples").alias("upstream_samples"))


def crawlers(cube: DataFrame, agents: DataFrame) -> DataFrame:
    """Traffic of each claimed crawler, its probe traffic included. The cube is summed by agent before it meets names."""
    by_ua = cube.groupBy("ua_key").agg(F.sum("requests").alias("requests"), F.sum("bytes_sent").alias("bytes_sent"), F.sum("upstream_duration_us").alias("upstream_duration_us"), F.sum("upstream_samples").alias("upstream_samples"))
    return by_ua.join(agents.where("crawler IS NOT NULL"), "ua_key").select("crawler", "category", "protected_default", "requests", "bytes_sent", "upstream_duration_us", "upstream_samples")


def top_query_keys(keys: DataFrame, n: int = 20) -> DataFrame:
    """For each route its most frequent query keys, in order."""
    w = Window.partitionBy("route").orderBy(F.desc("requests"), "query_key")
    ranked = keys.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return ranked.groupBy("route").agg(F.expr("transform(array_sort(collect_list(struct(r, query_key))), x -> x.query_key)").alias("top_query_keys"))


def top_expensive(df: DataFrame, name: str, n: int) -> DataFrame:
    """Most upstream time first, unknown last; then requests, then name."""
    return df.orderBy(F.desc_nulls_last("upstream_duration_us"), F.desc("requests"), name).limit(n)


def bounded(events: DataFrame, column: str, limit: int, other: str, only: str = "true") -> DataFrame:
    """`column` with all but the first `limit` values (by first arrival) replaced by `other`; overflow marks those rows.

    First arrivals are a grouped minimum; the `limit` earliest are one bounded top-k, broadcast back by its size."""
    kept = events.where(only).groupBy(column).agg(F.min("seq").alias("_first")).orderBy("_first").limit(limit).select(F.col(column).alias("_kept"))
    joined = events.join(F.broadcast(kept), F.col(column) == F.col("_kept"), "left")
    over = F.expr(f"({only}) AND _kept IS NULL")
    return joined.withColumn("overflow", over).withColumn(column, F.when(over, F.lit(other)).otherwise(F.col(column))).drop("_kept")


def first_errors(rejected: DataFrame, n: int = 1000) -> DataFrame:
    return rejected.orderBy("seq").limit(n)
