"""Flood detector over rolling windows, as DataFrame operations that serve batch replay and micro-batches alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kmv
from ..functions.numbers import threshold
from ..functions.urls import rule_prefix

#: Paths that never become a rule.
EXCLUDED = ("/.well-known/acme-challenge/", "/health", "/healthz", "/live", "/livez", "/ready", "/readyz")


@dataclass(frozen=True)
class Detection:
    window_s: int = 60
    interval_s: int = 10
    consecutive: int = 2
    max_lag_s: int = 30
    multiplier: int = 10
    volume_min_requests: int = 1000
    volume_min_share_ppm: int = 200_000
    distributed_min_requests: int = 300
    distributed_min_clients: int = 100
    distributed_min_client_ratio_ppm: int = 300_000
    distributed_min_coverage_ppm: int = 800_000
    distributed_min_upstream_us: int = 30_000_000
    distributed_min_average_us: int = 100_000
    max_groups: int = 5000
    ttl_s: int = 600
    max_rules: int = 64


def accounting(df: DataFrame, status: str = "status", limiter: str = "limit_req_status") -> DataFrame:
    """Adds denominator, candidate and refresh from the answer's status and what the limiter said."""
    served = f"{status} NOT IN (403, 429)"
    dry = f"{limiter} IN ('DELAYED_DRY_RUN', 'REJECTED_DRY_RUN')"
    return df.withColumns({
        "denominator": F.expr(f"{limiter} <> 'REJECTED'"),
        "candidate": F.expr(f"{limiter} <> 'REJECTED' AND {served}"),
        "refresh": F.expr(f"CASE WHEN {limiter} = 'REJECTED' THEN {status} = 429 WHEN {dry} THEN false ELSE {served} END"),
    })


def lateness(df: DataFrame, d: Detection) -> DataFrame:
    """Adds gate: null for a fresh record, else why it is left out. Needs ts_us and receipt_us."""
    lag = "(receipt_us - ts_us)"
    return df.withColumn("gate", F.expr(f"CASE WHEN receipt_us <= 0 OR ts_us <= 0 THEN 'invalid-time' WHEN {lag} < 0 THEN 'future' WHEN {lag} > {d.max_lag_s * 1_000_000}L OR {lag} >= {d.window_s * 1_000_000}L THEN 'stale' END"))


def bucket_end(interval_s: int, ts: str = "ts_us") -> str:
    """End of the interval (end - i, end] that a time falls into."""
    return f"(({ts} - 1) div {interval_s * 1_000_000} + 1) * {interval_s * 1_000_000}"


def action_safe(method: str = "method", prefix: str = "actionable_prefix", more: tuple[str, ...] = ()) -> str:
    """Whether a rule may be made of a method and a prefix: nothing that overlaps an excluded path, either way round."""
    overlap = " OR ".join(f"{rule_prefix(prefix, repr(p))} OR {rule_prefix(repr(p), prefix)}" for p in (*EXCLUDED, *more))
    return f"({prefix} IS NOT NULL AND {method} <> 'OPTIONS' AND {prefix} <> '/' AND NOT ({overlap}))"


def evaluations(df: DataFrame, d: Detection) -> DataFrame:
    """Each row for each evaluation whose window (eval - window, eval] holds its bucket. Rows carry bucket_us."""
    n = d.window_s // d.interval_s
    return df.withColumn("eval_us", F.explode(F.expr(f"transform(sequence(0, {n - 1}), i -> bucket_us + i * {d.interval_s * 1_000_000}L)")))


def site_counts(records: DataFrame, d: Detection) -> DataFrame:
    """Requests of the whole site in each window: summed by bucket first, so that windows add few rows."""
    by_bucket = records.where("denominator").groupBy(F.expr(bucket_end(d.interval_s)).alias("bucket_us")).agg(F.count("*").alias("n"))
    return evaluations(by_bucket, d).groupBy("eval_us").agg(F.sum("n").alias("site_requests"))


def groups(records: DataFrame, d: Detection) -> DataFrame:
    """Window sums of volume groups (method, prefix) and shape groups (method, route), with a sketch of clients."""
    safe = records.where(f"candidate AND {action_safe()}").withColumn("bucket_us", F.expr(bucket_end(d.interval_s)))
    two = F.explode(F.array(F.struct(F.lit("volume").alias("kind"), F.col("actionable_prefix").alias("path")), F.struct(F.lit("shape").alias("kind"), F.col("route").alias("path"))))
    keyed = safe.withColumn("_g", two).select("bucket_us", "method", "actionable_prefix", "client_key", "upstream_duration_us", "_g.kind", "_g.path")
    keys = ["kind", "method", "path"]
    sums = keyed.groupBy(*keys, "bucket_us").agg(F.count("*").alias("requests"), F.count("upstream_duration_us").alias("upstream_samples"), F.coalesce(F.sum("upstream_duration_us"), F.lit(0)).alias("upstream_us"), F.min("actionable_prefix").alias("lo"), F.max("actionable_prefix").alias("hi"))
    windows = evaluations(sums, d).groupBy(*keys, "eval_us").agg(*(F.sum(c).alias(c) for c in ("requests", "upstream_samples", "upstream_us")), F.min("lo").alias("path_prefix"), F.expr("min(lo) <> max(hi)").alias("unsafe"))
    clients = kmv.sketch(keyed, [*keys, "bucket_us"], "client_key", "sk")
    merged = evaluations(clients, d).groupBy(*keys, "eval_us").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sk")))), 1, kmv.K).alias("sk"))
    return windows.join(merged, [*keys, "eval_us"]).withColumn("clients", F.expr(kmv.conservative("sk", "requests"))).drop("sk")


def at_least(n: str, denominator: str, ppm: int) -> str:
    """n / denominator >= ppm millionths, exactly."""
    return f"({denominator} > 0 AND CAST({n} AS DECIMAL(20,0)) * 1000000 >= CAST({denominator} AS DECIMAL(20,0)) * {ppm})"


def thresholds(windows: DataFrame, prefix_p99: DataFrame, route_p99: DataFrame, route_upstream_p99: DataFrame, d: Detection) -> DataFrame:
    """Adds thresholds from the baseline and able: whether all holds but the share of the site. A series without a baseline
    has the floor. Baselines are static, so streams may be judged as well."""
    named = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), "method", "path", F.col("p99").alias(name))
    base = named(prefix_p99, "volume", "p99").unionByName(named(route_p99, "shape", "p99"))
    out = windows.join(base, ["kind", "method", "path"], "left").join(named(route_upstream_p99, "shape", "up99"), ["kind", "method", "path"], "left").na.fill(0, ["p99", "up99"])
    volume, shape = (threshold("p99", f, d.multiplier, d.window_s) for f in (d.volume_min_requests, d.distributed_min_requests))
    out = out.withColumn("request_threshold", F.expr(f"CASE WHEN kind = 'volume' THEN {volume} ELSE {shape} END"))
    out = out.withColumn("upstream_threshold", F.expr(f"CASE WHEN kind = 'shape' THEN {threshold('up99', d.distributed_min_upstream_us, d.multiplier, d.window_s)} END"))
    by_shape = f"""clients >= {d.distributed_min_clients} AND {at_least("clients", "requests", d.distributed_min_client_ratio_ppm)}
      AND {at_least("upstream_samples", "requests", d.distributed_min_coverage_ppm)} AND upstream_us >= upstream_threshold AND upstream_us >= CAST(upstream_samples AS DECIMAL(20,0)) * {d.distributed_min_average_us}"""
    return out.withColumn("able", F.expr(f"NOT unsafe AND requests >= request_threshold AND (kind = 'volume' OR {by_shape})"))


def qualified(windows: DataFrame, site: DataFrame, prefix_p99: DataFrame, route_p99: DataFrame, route_upstream_p99: DataFrame, d: Detection) -> DataFrame:
    """Adds thresholds from the baseline and qualified; the requests of the whole site come from `site`."""
    out = thresholds(windows, prefix_p99, route_p99, route_upstream_p99, d).join(site, "eval_us", "left").na.fill(0, ["site_requests"])
    return out.withColumn("qualified", F.expr(f"able AND (kind = 'shape' OR {at_least('requests', 'site_requests', d.volume_min_share_ppm)})")).drop("able")


def streaks(rows: DataFrame, d: Detection) -> DataFrame:
    """Qualified evaluations with their consecutive number; a missed or absent evaluation starts anew."""
    w = Window.partitionBy("kind", "method", "path").orderBy("eval_us")
    hit = rows.where("qualified").withColumn("_i", F.expr(f"eval_us div {d.interval_s * 1_000_000}") - F.row_number().over(w))
    return hit.withColumn("streak", F.row_number().over(Window.partitionBy("kind", "method", "path", "_i").orderBy("eval_us"))).drop("_i")


def proposals(rows: DataFrame, d: Detection) -> DataFrame:
    """One row for each evaluation, method and prefix that qualified often enough."""
    reason = F.expr("CASE WHEN kind = 'volume' THEN 'extreme-volume' ELSE 'distributed-expense' END")
    hit = streaks(rows, d).where(F.col("streak") >= d.consecutive)
    return hit.groupBy("eval_us", "method", "path_prefix").agg(F.min("request_threshold").alias("request_threshold"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"))


def attempts(records: DataFrame, rules: DataFrame, d: Detection) -> DataFrame:
    """Requests that would refresh an active rule (method, path_prefix), for each window. `rules` is bounded by max_rules."""
    r = F.broadcast(rules.select(F.col("method").alias("_m"), "path_prefix"))
    hit = records.where("refresh AND actionable_prefix IS NOT NULL").join(r, (F.col("method") == F.col("_m")) & F.expr(rule_prefix("actionable_prefix", "path_prefix")))
    by_bucket = hit.groupBy("method", "path_prefix", F.expr(bucket_end(d.interval_s)).alias("bucket_us")).agg(F.count("*").alias("n"))
    return evaluations(by_bucket, d).groupBy("method", "path_prefix", "eval_us").agg(F.sum("n").alias("attempts"))


def tracked(records: DataFrame, d: Detection) -> DataFrame:
    """Groups (kind, method, path) that each evaluation keeps: the first `max_groups` by their first request (seq) in its
    window, volume before shape. overflow tells how many it had to leave out.

    Counts are bounded before the rank: only as many rows of an evaluation as it may keep leave a task."""
    safe = records.where(f"candidate AND {action_safe()}").withColumn("bucket_us", F.expr(bucket_end(d.interval_s)))
    two = F.explode(F.array(F.struct(F.lit(1).alias("o"), F.lit("volume").alias("kind"), F.col("actionable_prefix").alias("path")), F.struct(F.lit(2).alias("o"), F.lit("shape").alias("kind"), F.col("route").alias("path"))))
    keyed = safe.select("seq", "bucket_us", "method", two.alias("g")).groupBy("g.kind", "method", "g.path", "bucket_us").agg(F.min(F.struct("seq", "g.o")).alias("first"))
    each = evaluations(keyed, d).groupBy("kind", "method", "path", "eval_us").agg(F.min("first").alias("first"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("eval_us").orderBy("first", "kind", "method", "path"))).where(F.col("rank") <= d.max_groups)
    total = each.groupBy("eval_us").agg(F.greatest(F.count("*") - d.max_groups, F.lit(0)).alias("overflow"))
    return ranked.join(total, "eval_us").select("eval_us", "kind", "method", "path", "rank", "overflow")


def intake(gated: DataFrame, d: Detection) -> DataFrame:
    """What came in before each evaluation: records, fresh ones, the counts by reason of those left out, the largest lag of
    a fresh one, and suspended: data came, but none of it was fresh. Needs receipt_us, ts_us and gate (see `lateness`)."""
    by = {f"rejected_{r.replace('-', '_')}": f"count_if(gate = '{r}')" for r in ("future", "stale", "invalid-time")}
    sums = {"records": "count(1)", "fresh": "count_if(gate IS NULL)"} | by | {"max_lag_us": "coalesce(max(CASE WHEN gate IS NULL THEN receipt_us - ts_us END), 0)", "suspended": "count_if(gate IS NULL) = 0"}
    return gated.groupBy(F.expr(bucket_end(d.interval_s, "receipt_us")).alias("eval_us")).agg(*(F.expr(v).alias(k) for k, v in sums.items()))


def sensor_health(lines: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Adds suspended: more than 10 structural errors among the last 100 lines of a site. Needs site, seq, structure_error.

    A site's lines are windowed in blocks of consecutive numbers, so that a busy site is many tasks; each block brings the
    last 99 lines before it, which are at most the last 99 of the block before where numbers have no gaps, else of the
    nearest earlier ones that have lines."""
    rows = lines.withColumn("_b", F.expr(f"seq div {block}"))
    last = Window.partitionBy("site", "_b").orderBy(F.desc("seq"))
    tails = rows.withColumn("_r", F.row_number().over(last)).where("_r <= 99").select("site", "seq", "_b", "structure_error")
    # what each block takes over: the 99 nearest of the tails before it, folded over the few blocks of the site
    ends = tails.groupBy("site", "_b").agg(F.array_sort(F.collect_list(F.struct("seq", "structure_error"))).alias("own"))
    held = ends.withColumn("before", F.collect_list("own").over(Window.partitionBy("site").orderBy("_b").rowsBetween(-99, -1)))
    near = held.select("site", "_b", F.explode(F.expr("slice(reverse(array_sort(flatten(before))), 1, 99)")).alias("x")).select("site", "_b", "x.seq", "x.structure_error", F.lit(True).alias("_carried"))
    both = rows.withColumn("_carried", F.lit(False)).unionByName(near, allowMissingColumns=True)
    w = Window.partitionBy("site", "_b").orderBy("seq").rowsBetween(-99, 0)
    errors, n = F.sum(F.col("structure_error").cast("int")).over(w), F.count("*").over(w)
    return both.withColumn("suspended", (n == 100) & (errors > 10)).where("NOT _carried").drop("_b", "_carried")
