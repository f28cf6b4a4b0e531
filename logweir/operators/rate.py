"""Token-bucket model: what a rate limit would have let through, for each client and agent and three profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stage import once

SCALE = 60_000_000
#: Requests a minute and burst of each profile.
PROFILES = {"gentle": (60, 20), "standard": (30, 10), "strict": (10, 5)}


#: Microseconds without a request after which every bucket is full again, whatever it held.
FULL_US = max(-(-(burst + 1) * SCALE // rate) for rate, burst in PROFILES.values())
#: Consecutive numbers (seq) whose requests of a subject are looked at in one window.
BLOCK = 1 << 20


def placed(events: DataFrame, carried: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """seq, client_key, ua_key, ts_us and the `carried` columns with unordered (true from the subject's first step back in
    time on) and segment: the seq of the last request that found every bucket full because nothing came for FULL_US.

    A subject's requests are windowed in blocks of consecutive numbers; what passes from block to block is one row of
    each, so a subject with half of the log is as many tasks as it has blocks."""
    names = dict.fromkeys(("seq", "client_key", "ua_key", "ts_us", *carried))
    rows = once(events.select(*names, F.expr(f"seq div {block}").alias("_b")), "subjects")
    keys = ["client_key", "ua_key", "_b"]
    w = Window.partitionBy(*keys).orderBy("seq")
    gap = F.col("ts_us") - F.lag("ts_us").over(w)
    rows = rows.withColumn("_gap", gap).withColumns({"_back": F.expr("coalesce(_gap < 0, false)"), "_cut": F.expr(f"CASE WHEN _gap >= {FULL_US}L THEN seq END")}).drop("_gap")
    ends = rows.groupBy(*keys).agg(F.min("seq").alias("_at"), F.min_by("ts_us", "seq").alias("_first"), F.max_by("ts_us", "seq").alias("_last"), F.max("_back").alias("_any"), F.max("_cut").alias("_own"))
    over = Window.partitionBy("client_key", "ua_key").orderBy("_b")
    ends = ends.withColumn("_step", F.col("_first") - F.lag("_last").over(over))
    ends = ends.withColumns({"_edge": F.expr("coalesce(_step < 0, false)"), "_new": F.expr(f"CASE WHEN coalesce(_step >= {FULL_US}L, true) THEN _at END")})
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("_edge") | F.coalesce(F.max(F.expr("_any OR _edge")).over(before), F.lit(False))
    begun = F.coalesce("_new", F.max(F.expr("coalesce(_own, _new)")).over(before))
    held = ends.select(*keys, late.alias("_late"), begun.alias("_begun"))
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(held, keys).select(*names, (F.col("_late") | F.max("_back").over(to_here)).alias("unordered"), F.coalesce(F.max("_cut").over(to_here), "_begun").alias("segment"))


def unordered(events: DataFrame) -> DataFrame:
    """seq, client_key, ua_key and unordered: true from a subject's first step back in time on."""
    return placed(events).select("seq", "client_key", "ua_key", "unordered")


def decisions(events: DataFrame, carried: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """seq with modeled and, for each profile, whether the bucket lets the request through (null: not modelled), and the
    `carried` columns of the request.

    All buckets are full where a segment begins, so segments are exact and independent of each other. Partitions hold
    whole segments in input order and are streamed: what is kept is one bucket state for each profile. A subject that
    never pauses for FULL_US (36 seconds) is one segment: its decisions follow from each other."""
    names = tuple(PROFILES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, state = None, 0, []
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("seq", "client_key", "ua_key", "segment", "ts_us", "unordered"))
            for seq, client, ua, segment, ts, broken in zip(*columns, strict=True):
                if broken:
                    out.append((seq, False, None, None, None))
                    continue
                if (client, ua, segment) != own:
                    own, last = (client, ua, segment), ts
                    state = [(burst + 1) * SCALE for _, burst in PROFILES.values()]
                allowed = []
                for i, (rate, burst) in enumerate(PROFILES.values()):
                    tokens = min((burst + 1) * SCALE, state[i] + (ts - last) * rate)
                    allowed.append(tokens >= SCALE)
                    state[i] = tokens - SCALE if allowed[i] else tokens
                last = ts
                out.append((seq, True, *allowed))
            frame = pd.DataFrame(out, columns=["seq", "modeled", *names]).astype({n: "boolean" for n in names})
            yield frame.assign(**{c: batch[c].to_numpy() for c in carried})

    rows = placed(events, carried, block).repartition("client_key", "ua_key", "segment").sortWithinPartitions("client_key", "ua_key", "segment", "seq")
    types = dict(events.dtypes)
    return rows.mapInPandas(run, "seq bigint, modeled boolean, " + ", ".join([f"{n} boolean" for n in names] + [f"{c} {types[c]}" for c in carried]))


def rate_impacts(events: DataFrame) -> DataFrame:
    """Modelled, allowed and limited traffic by agent, class and profile."""
    facts = ("ua_key", "primary_class", "bytes_sent", "upstream_duration_us")
    each = decisions(events, facts).where("modeled").select(*facts, F.expr(f"stack({len(PROFILES)}, " + ", ".join(f"'{n}', {n}" for n in PROFILES) + ") AS (profile, allowed)"))
    sums = {
        "modeled_requests": "count(1)",
        "allowed_requests": "count_if(allowed)",
        "limited_requests": "count_if(NOT allowed)",
        "allowed_bytes": "coalesce(sum(CASE WHEN allowed THEN bytes_sent END), 0)",
        "limited_bytes": "coalesce(sum(CASE WHEN NOT allowed THEN bytes_sent END), 0)",
        "limited_upstream_us": "sum(CASE WHEN NOT allowed THEN upstream_duration_us END)",
        "limited_upstream_samples": "count(CASE WHEN NOT allowed THEN upstream_duration_us END)",
    }
    return each.groupBy("ua_key", "primary_class", "profile").agg(*(F.expr(v).alias(k) for k, v in sums.items()))
