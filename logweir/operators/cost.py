"""Cost allocation in whole kopecks: egress by bytes, hosting by upstream time, both rounded half up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up

GIB = 1 << 30
#: A mean month in seconds.
MONTH_S = 2_629_746


def allocate(rows: DataFrame, totals: DataFrame, hosting_month: int, egress_gib: int) -> DataFrame:
    """Adds egress_kopecks, hosting_kopecks and total_kopecks to rows with bytes_sent, upstream_duration_us, requests and
    upstream_samples. `totals` is one row: first_event_us, last_event_us, upstream_duration_us, accepted, upstream_samples.

    The window's hosting cost is divided by upstream time, and only where every request of all traffic has a sample; a
    component without a tariff is null and so is a total without any component."""
    t = totals.select(
        F.expr("greatest(1L, (last_event_us - first_event_us + 999999) div 1000000)").alias("_window"),
        F.col("upstream_duration_us").alias("_total"),
        F.expr("accepted = upstream_samples AND upstream_duration_us > 0").alias("_full"),
    )
    out = rows.crossJoin(F.broadcast(t))
    egress = half_up(f"CAST(bytes_sent AS DECIMAL(20,0)) * {egress_gib}", f"CAST({GIB} AS DECIMAL(20,0))") if egress_gib else "CAST(NULL AS BIGINT)"
    share = f"CAST({hosting_month} AS DECIMAL(11,0)) * CAST(_window AS DECIMAL(9,0)) * CAST(coalesce(upstream_duration_us, 0) AS DECIMAL(16,0))"
    hosting = f"CASE WHEN _full THEN {half_up(share, f'CAST({MONTH_S} AS DECIMAL(7,0)) * CAST(_total AS DECIMAL(18,0))')} END" if hosting_month else "CAST(NULL AS BIGINT)"
    out = out.withColumn("egress_kopecks", F.expr(egress)).withColumn("hosting_kopecks", F.expr(hosting))
    total = "CASE WHEN egress_kopecks IS NOT NULL OR hosting_kopecks IS NOT NULL THEN coalesce(egress_kopecks, 0L) + coalesce(hosting_kopecks, 0L) END"
    return out.withColumn("total_kopecks", F.expr(total)).drop("_window", "_total", "_full")
