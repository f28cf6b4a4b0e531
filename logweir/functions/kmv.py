"""K-minimum-values sketch of 64 hashes for distinct counts, kept as a sorted array of 16-digit hex strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 64
#: 63 * 2 ** 64
_NUMERATOR = (K - 1) << 64


def hash16(value: str) -> str:
    """First 8 bytes of SHA-256 in hex; such strings sort as the unsigned numbers they are."""
    return f"substr(sha2(CAST({value} AS BINARY), 256), 1, 16)"


def sketch(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Grouped sketches of an expression (nulls left out), for groups of any size.

    Duplicates go in a partial aggregation and each salt of a group keeps its 64 smallest hashes before they meet."""
    hashed = df.select(*keys, F.expr(hash16(value)).alias("_h")).where("_h IS NOT NULL").distinct()
    salted = hashed.withColumn("_part", F.expr("substr(_h, 16, 1)"))
    own = Window.partitionBy(*keys, "_part").orderBy("_h")
    small = salted.withColumn("_r", F.row_number().over(own)).where(f"_r <= {K}")
    return small.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("_h")), 1, K).alias(name))


def merge(a: str, b: str) -> str:
    return f"slice(array_sort(array_union({a}, {b})), 1, {K})"


def estimate(sk: str, total: str) -> str:
    """Distinct values: exact below 64 hashes, else 63 * 2^64 / kth rounded down, from 64 to `total`."""
    kth = f"CAST(conv(element_at({sk}, {K}), 16, 10) AS DECIMAL(20,0))"
    big = f"(CAST({_NUMERATOR} AS DECIMAL(38,0)) >= (CAST({total} AS DECIMAL(17,0)) + 1) * {kth})"
    return f"(CASE WHEN {sk} IS NULL THEN 0L WHEN size({sk}) < {K} THEN CAST(size({sk}) AS BIGINT) WHEN {big} THEN {total} ELSE greatest({K}L, CAST({_NUMERATOR} AS DECIMAL(38,0)) div {kth}) END)"


def conservative(sk: str, total: str) -> str:
    """A lower estimate for full sketches: 61.9 percent, rounded down."""
    e = estimate(sk, total)
    return f"(CASE WHEN size({sk}) = {K} THEN {e} div 1000000 * 619000 + {e} % 1000000 * 619000 div 1000000 ELSE {e} END)"
