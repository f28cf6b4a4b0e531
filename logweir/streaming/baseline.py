"""Historical baseline: nearest-rank p99 of each minute series, zeros included, without ever making the zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MINUTE_US = 60_000_000


def history(cube: DataFrame) -> DataFrame:
    """Minute sums of what could have reached the backend: limiter and deny answers left out."""
    return cube.where("status NOT IN (403, 429)").groupBy("minute_us", "route", "actionable_prefix", "method").agg(F.sum("requests").alias("requests"), F.coalesce(F.sum("upstream_duration_us"), F.lit(0)).alias("upstream_us"), F.sum("upstream_samples").alias("upstream_samples"))


def complete_minutes(bounds: DataFrame) -> DataFrame:
    """One row from first_event_us and last_event_us: start_us, end_us and minutes, partial minutes at the ends left out."""
    start = f"(first_event_us + {MINUTE_US - 1}) div {MINUTE_US} * {MINUTE_US}"
    end = f"last_event_us div {MINUTE_US} * {MINUTE_US}"
    return bounds.select(F.expr(start).alias("start_us"), F.expr(end).alias("end_us"), F.expr(f"greatest(0L, ({end} - {start}) div {MINUTE_US})").alias("minutes"))


def p99(hist: DataFrame, minutes: DataFrame, path: str, value: str) -> DataFrame:
    """(method, path, p99) of each series; series of partial minutes alone stand with 0.

    Of N minutes the value of rank ceil(0.99 N) counts: with z zeros it is the (rank - z)-th positive one."""
    rows = hist.where(F.col(path).isNotNull()).crossJoin(F.broadcast(minutes))
    inside = f"CASE WHEN minute_us >= start_us AND minute_us < end_us THEN {value} ELSE 0 END"
    by_minute = rows.groupBy("method", F.col(path).alias("path"), "minute_us").agg(F.sum(F.expr(inside)).alias("v"), F.max("minutes").alias("minutes"))
    w = Window.partitionBy("method", "path").orderBy("v", "minute_us")
    n = F.sum(F.expr("CASE WHEN v > 0 THEN 1 ELSE 0 END")).over(Window.partitionBy("method", "path"))
    positive = F.sum(F.expr("CASE WHEN v > 0 THEN 1 ELSE 0 END")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = by_minute.withColumn("n", n).withColumn("k", positive)
    at = "v > 0 AND k = (99 * minutes + 99) div 100 - (minutes - n)"
    return ranked.groupBy("method", "path").agg(F.coalesce(F.max(F.expr(f"CASE WHEN {at} THEN v END")), F.lit(0)).cast("bigint").alias("p99"))


def eligible(minutes: DataFrame, input_format: str, route_overflow: bool) -> DataFrame:
    """Why a history can't serve as a baseline, comma-joined; empty if it can."""
    reasons = [("input-format-is-not-nginx-json", "true" if input_format != "nginx-json" else "false"), ("fewer-than-1440-complete-minutes", "minutes < 1440"), ("route-overflow", str(route_overflow).lower())]
    return minutes.select("minutes", F.expr("array_join(array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in reasons) + ")), ',')").alias("reasons"))
