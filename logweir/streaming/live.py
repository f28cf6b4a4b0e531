"""Structured Streaming form of the detector: windowed sums with a watermark, and rules kept as keyed state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .detector import Detection, action_safe


def windowed(records: DataFrame, d: Detection) -> DataFrame:
    """Rolling volume groups of a stream. Buckets are open at their start, hence the microsecond; late rows beyond the
    watermark are dropped and their windows' state with them."""
    timed = records.withColumn("at", F.timestamp_micros(F.col("ts_us") - 1)).withWatermark("at", f"{d.max_lag_s} seconds")
    safe = timed.where(f"candidate AND {action_safe()}")
    w = F.window("at", f"{d.window_s} seconds", f"{d.interval_s} seconds")
    return safe.groupBy(w, "method", "actionable_prefix").agg(F.count("*").alias("requests"), F.count("upstream_duration_us").alias("upstream_samples")).select(F.unix_micros("window.end").alias("eval_us"), "method", "actionable_prefix", "requests", "upstream_samples")


RULE_SCHEMA = "method string, path_prefix string, event string, eval_us bigint, expires_us bigint"
_STATE = "site string, rules string"


def rules(proposals: DataFrame, d: Detection) -> DataFrame:
    """Rule changes (activated, refreshed, capacity, expired) from a stream of proposals (site, eval_us, method,
    path_prefix).

    State is one JSON text of at most max_rules rules for each site, kept in the checkpoint. A rule ends by the clock of
    the evaluations: the watermark follows eval_us of all sites, and when it reaches the time at which a site's first rule
    expires, that site is called without a proposal of its own. Evaluations that are not later than the site's last one
    are left out."""
    import json

    names = ["method", "path_prefix", "event", "eval_us", "expires_us"]

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({"eval_us": "int64", "expires_us": "Int64"})

    def expired(held: dict, now: int) -> list:
        gone = sorted(n for n, e in held.items() if e <= now)
        return [(*n.split(" ", 1), "expired", now, None) for n in gone if held.pop(n) is not None]

    def keep(state: GroupState, site: str, held: dict, last: int) -> None:
        if not held:
            state.remove()
            return
        state.update((site, json.dumps({"rules": held, "last": last})))
        # timers must lie ahead of the watermark
        state.setTimeoutTimestamp(max(min(held.values()) // 1000, state.getCurrentWatermarkMs() + 1))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[1]) if state.exists else {"rules": {}, "last": 0}
        held, last = known["rules"], known["last"]
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() * 1000
            out = expired(held, now)
            keep(state, key[0], held, last)
            yield frame(out)
            return
        rows, out = pd.concat(list(batches), ignore_index=True).sort_values(["eval_us", "method", "path_prefix"]), []
        for now, group in rows[rows["eval_us"] > last].groupby("eval_us", sort=True):
            last = int(now)
            fresh = {}
            for method, prefix in zip(group["method"], group["path_prefix"], strict=True):
                name, expires = f"{method} {prefix}", last + d.ttl_s * 1_000_000
                if name not in held and len(held) >= d.max_rules:
                    out.append((method, prefix, "capacity", last, None))
                    continue
                out.append((method, prefix, "refreshed" if name in held else "activated", last, expires))
                held[name] = fresh[name] = expires
            out += expired(held, last)
        keep(state, key[0], held, last)
        yield frame(out)

    timed = proposals.withColumn("at", F.timestamp_micros("eval_us")).withWatermark("at", "0 seconds")
    return timed.groupBy("site").applyInPandasWithState(step, RULE_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def applied(changes: DataFrame, min_interval_s: int) -> DataFrame:
    """Which evaluations (site, eval_us, n_rules, removed, changed) hand their rules on: those that change something and
    are the first with rules, take one away, or come `min_interval_s` after the last that was handed on. A change that has
    to wait is carried to the next evaluation. Evaluations of a site are few (one an interval) and follow one another, so a
    site's are folded in one task, row by row in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("eval_us", ignore_index=True)
        last, applied_n, waiting, took, out = None, 0, False, False, []
        for at, n, removed, changed in zip(rows["eval_us"], rows["n_rules"], rows["removed"], rows["changed"], strict=True):
            waiting, took = waiting or bool(changed), took or bool(removed)
            now = waiting and (took or applied_n == 0 and n > 0 or last is None or at - last >= min_interval_s * 1_000_000)
            out.append((waiting, now))
            if now:
                last, applied_n, waiting, took = at, n, False, False
        return rows[["site", "eval_us"]].assign(apply_required=[a for a, _ in out], apply_now=[b for _, b in out])

    return changes.groupBy("site").applyInPandas(run, f"site {dict(changes.dtypes)['site']}, eval_us bigint, apply_required boolean, apply_now boolean")


def state_folder(root: str, *settings: str) -> str:
    """The checkpoint folder of a stream whose state only counts under these settings (the detector's configuration, the
    digest of its baseline): others get a folder of their own and so begin anew."""
    parts = b"".join(len(x.encode()).to_bytes(4, "big") + x.encode() for x in settings)
    return f"{root}/state-{hashlib.sha256(parts).hexdigest()[:32]}"


def evaluation_time(now_us: int, last_us: int, d: Detection) -> int | None:
    """The evaluation that is due: the last full interval's end, if it is later than the one before, else None."""
    at = now_us // (d.interval_s * 1_000_000) * (d.interval_s * 1_000_000)
    return at if at > max(last_us, 0) else None
