"""The whole detector as a stream: group windows with mergeable sketches, then evaluations of each site.

Two keyed operators follow one another, both with event-time timers at the ends of intervals:

- `Windows`, for each site and share of its groups (kind, method, path): counts and client sketches by bucket. When the
  watermark passes an evaluation, the buckets of its window are merged and handed on; buckets that no later window holds are
  dropped. A share keeps a bucket's groups in one value, so a timer reads a window in a few calls.
- `Evaluations`, for each site: which groups are tracked, what qualifies, streaks, rules with their end, what was left out
  at intake, suspension, and when rules are handed on. A site's rows are one a group and interval, not one a request.

Requests are summed within each task, many Arrow batches at a time, before they are shuffled, so a busy group or site moves
few rows. The clock is the
receipt: an evaluation is due when receipts are `max_lag_s` past it, when every fresh request of its window is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import kmv
from ..functions.urls import rule_prefix
from . import detector
from .detector import Detection

#: What a stream of records has: `structure_error` marks lines that are no records, whose other columns are null.
RECORDS = "site string, seq bigint, receipt_us bigint, ts_us bigint, method string, actionable_prefix string, route string, client_key string, upstream_duration_us bigint, denominator boolean, candidate boolean, refresh boolean, structure_error boolean"
_GROUP = ["site", "kind", "method", "path"]
_SUMS = "requests bigint, upstream_samples bigint, upstream_us bigint, lo string, hi string, first_seq bigint"
#: Shares that a site's groups are dealt over; rows and their sketches (comma-separated) that a task sums at a time.
SHARES, CHUNK = 64, 1 << 17
_WINDOW = f"site string, kind string, method string, path string, at timestamp, {_SUMS}, sk array<string>"
EVENTS = "site string, eval_us bigint, event string, kind string, method string, path string, path_prefix string, n bigint, request_threshold bigint, reasons string, expires_us bigint, apply_now boolean"
#: Lines whose errors suspend a sensor, and how many errors they may hold.
HEALTH_LINES, HEALTH_ERRORS = 100, 10
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _stamp(us: pd.Series) -> pd.Series:
    return pd.to_datetime(us, unit="us")


def _clocked(df: DataFrame, d: Detection) -> DataFrame:
    """A second more than the lag: a record in order never falls into a window that has ended."""
    return df.withWatermark("at", f"{d.max_lag_s + 1} seconds")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together, so that sums are made of more rows than Arrow brings at a time."""
    held, n = [], 0
    for x in batches:
        held.append(x)
        n += len(x)
        if n >= CHUNK:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _partial_groups(records: DataFrame, d: Detection) -> DataFrame:
    """Sums of each chunk of rows by group and bucket, with the 64 smallest client hashes; and the site's last receipt, as
    a group of kind clock, so that time goes on when nothing qualifies."""
    use = F.expr(f"coalesce(NOT structure_error AND gate IS NULL AND candidate AND {detector.action_safe()}, false)")
    fresh = detector.lateness(records, d).withColumn("use", use)
    rows = fresh.select("site", "method", F.expr(detector.bucket_end(d.interval_s)).alias("bucket_us"), "actionable_prefix", "route", "seq", "receipt_us", "upstream_duration_us", F.expr(kmv.hash16("client_key")).alias("h"), "use")
    keys = [*_GROUP, "bucket_us"]
    names = [*keys, *(c.split()[0] for c in _SUMS.split(", ")), "sk", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _chunks(batches):
            clock = x.groupby("site", as_index=False).agg(at=("receipt_us", "max"))
            blank = {"kind": "clock", "method": "", "path": "", "lo": "", "hi": "", "sk": ""} | dict.fromkeys(("bucket_us", "requests", "upstream_samples", "upstream_us", "first_seq"), 0)
            yield clock.assign(**blank, at=_stamp(clock["at"]))[names]
            used = x[x["use"].astype(bool)]
            used = used.assign(upstream_duration_us=pd.to_numeric(used["upstream_duration_us"]))
            for kind, path in (("volume", "actionable_prefix"), ("shape", "route")):
                own = used[used[path].notna()]
                if own.empty:
                    continue
                own = own.assign(kind=kind, path=own[path])
                by = own.groupby(keys, sort=False)
                out = by.agg(requests=("seq", "size"), upstream_samples=("upstream_duration_us", "count"), upstream_us=("upstream_duration_us", "sum"), lo=("actionable_prefix", "min"), hi=("actionable_prefix", "max"), first_seq=("seq", "min"), at=("receipt_us", "max")).reset_index()
                hashes = pd.DataFrame({"g": by.ngroup(), "h": own["h"]}).dropna().drop_duplicates().sort_values(["g", "h"])
                small = hashes[hashes.groupby("g").cumcount() < kmv.K].groupby("g")["h"].agg(",".join)
                yield out.assign(sk=small.reindex(range(len(out))).fillna("").to_numpy(), at=_stamp(out["at"]), upstream_us=out["upstream_us"].astype("int64"), bucket_us=out["bucket_us"].astype("int64"))[names]

    return rows.mapInPandas(run, f"site string, kind string, method string, path string, bucket_us bigint, {_SUMS}, sk string, at timestamp")


class Windows(StatefulProcessor):
    """Buckets of a share of a site's groups; the merged ones of a window when its evaluation is due."""

    def __init__(self, d: Detection):
        self.step, self.window = d.interval_s * 1_000_000, d.window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        one = ",".join(c.replace(" ", ":") for c in f"kind string, method string, path string, {_SUMS}, sk string".split(", "))
        self.buckets = handle.getMapState("buckets", "bucket_us bigint", f"groups array<struct<{one}>>")

    @staticmethod
    def _merged(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        sk = a[6] or b[6]
        if a[6] and b[6] and a[6] != b[6]:
            sk = ",".join(sorted({*a[6].split(","), *b[6].split(",")})[: kmv.K])
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4]), min(a[5], b[5]), sk)

    def _held(self, at: int) -> dict[tuple, tuple]:
        """A bucket's groups: (kind, method, path) and their sums."""
        held = self.buckets.getValue((at,))
        return {tuple(x[:3]): tuple(x[3:]) for x in held[0]} if held else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ("bucket_us", "kind", "method", "path", "requests", "upstream_samples", "upstream_us", "lo", "hi", "first_seq", "sk")
        new: dict[int, dict[tuple, tuple]] = {}
        for x in rows:
            x = x[x["kind"] != "clock"]
            for at, kind, method, path, *own in zip(*(x[c].tolist() for c in names), strict=True):
                groups, name = new.setdefault(at, {}), (kind, method, path)
                groups[name] = self._merged(groups.get(name), tuple(own))
        ended, due = timerValues.getCurrentWatermarkInMs() * 1000, set()
        for at, groups in new.items():
            held = self._held(at)
            for name, own in groups.items():
                held[name] = self._merged(held.get(name), own)
            self.buckets.updateValue((at,), ([(*name, *own) for name, own in held.items()],))
            due |= {e for e in range(at, at + self.window, self.step) if e > ended}
        for e in due:
            self.handle.registerTimer(e // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, total = expiredTimerInfo.getExpiryTimeInMs() * 1000, {}
        for at in range(due - self.window + self.step, due + 1, self.step):
            held = self._held(at)
            for name, own in held.items():
                total[name] = self._merged(total.get(name), own)
            if held and at + self.window == due + self.step:
                self.buckets.removeKey((at,))
        if total:
            names = ["site", "kind", "method", "path", "at", *(c.split()[0] for c in _SUMS.split(", ")), "sk"]
            rows = [(key[0], *name, pd.Timestamp(due, unit="us"), *own[:6], own[6].split(",") if own[6] else []) for name, own in total.items()]
            yield pd.DataFrame(rows, columns=names)

    def close(self) -> None: ...


def group_windows(records: DataFrame, d: Detection) -> DataFrame:
    """The rows of `detector.groups`, by site, from a stream, each once its window has ended; with first_seq, the first
    request of the window."""
    share = F.pmod(F.hash("kind", "method", "path"), F.lit(SHARES))
    sums = _clocked(_partial_groups(records, d).withColumn("share", share), d).groupBy("site", "share")
    out = sums.transformWithStateInPandas(Windows(d), _WINDOW, "Append", "EventTime", eventTimeColumnName="at")
    return out.withColumns({"eval_us": F.unix_micros("at"), "path_prefix": F.col("lo"), "unsafe": F.expr("lo <> hi"), "clients": F.expr(kmv.conservative("sk", "requests"))}).drop("lo", "hi", "sk")


#: What reaches a site's evaluations: row is g (a group's window), s (requests of the site), i (intake), h (health lines) or
#: a (attempts), and the columns that these have.
_SITE = "site string, row string, at timestamp, eval_us bigint, kind string, method string, path string, path_prefix string, first_seq bigint, requests bigint, request_threshold bigint, able boolean, records bigint, fresh bigint, future bigint, stale bigint, invalid bigint, lag_us bigint, lines array<bigint>"


def _intake(records: DataFrame, d: Detection) -> DataFrame:
    """Sums of each chunk of rows for a site: requests and attempts by bucket, intake and the last lines by receipt."""
    rows = detector.lateness(records, d).withColumns({"bucket_us": F.expr(detector.bucket_end(d.interval_s)), "eval_us": F.expr(detector.bucket_end(d.interval_s, "receipt_us"))})
    rows = rows.select("site", "seq", "receipt_us", F.expr("receipt_us - ts_us").alias("lag_us"), "gate", "bucket_us", "eval_us", "method", "actionable_prefix", F.expr("coalesce(denominator, false)").alias("denominator"), F.expr("coalesce(refresh AND actionable_prefix IS NOT NULL, false)").alias("refresh"), F.expr("coalesce(structure_error, false)").alias("error"))
    names = [c.split()[0] for c in _SITE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _chunks(batches):
            fresh = ~x["error"] & x["gate"].isna()
            x = x.assign(fresh=fresh, lag_us=x["lag_us"].where(fresh, 0).fillna(0), records=1, **{k: x["gate"] == g for k, g in (("future", "future"), ("stale", "stale"), ("invalid", "invalid-time"))})
            count = x.groupby(["site", "eval_us"], sort=False)
            intake = count.agg(records=("records", "sum"), fresh=("fresh", "sum"), future=("future", "sum"), stale=("stale", "sum"), invalid=("invalid", "sum"), lag_us=("lag_us", "max"), at=("receipt_us", "max")).reset_index().assign(row="i")
            last = x.sort_values("seq").groupby(["site", "eval_us"], sort=False).tail(HEALTH_LINES)
            health = last.assign(line=last["seq"] * 2 + last["error"]).groupby(["site", "eval_us"], sort=False).agg(lines=("line", list), at=("receipt_us", "max")).reset_index().assign(row="h")
            site = x[fresh & x["denominator"]].groupby(["site", "bucket_us"], sort=False).agg(requests=("seq", "size"), at=("receipt_us", "max")).reset_index().rename(columns={"bucket_us": "eval_us"}).assign(row="s")
            tried = x[fresh & x["refresh"]].groupby(["site", "bucket_us", "method", "actionable_prefix"], sort=False).agg(requests=("seq", "size"), at=("receipt_us", "max")).reset_index().rename(columns={"bucket_us": "eval_us", "actionable_prefix": "path_prefix"}).assign(row="a")
            for part in (p for p in (intake, health, site, tried) if len(p)):
                whole = {c: part[c].astype("int64") for c in part.columns if c in ("requests", "records", "fresh", "future", "stale", "invalid", "lag_us", "eval_us")}
                none = {c: pd.Series([None] * len(part), dtype=object) for c in names if c not in part.columns}
                yield part.assign(at=_stamp(part["at"]), **whole, **none)[names]

    return _clocked(rows.mapInPandas(run, _SITE), d)


class Evaluations(StatefulProcessor):
    """A site's evaluations, one at each interval's end that has anything to evaluate, strictly one after the other."""

    def __init__(self, d: Detection, min_interval_s: int):
        self.d, self.step, self.window = d, d.interval_s * 1_000_000, d.window_s * 1_000_000
        self.pause = min_interval_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.groups = handle.getMapState("groups", "eval_us bigint", "over bigint, first array<struct<kind:string,method:string,path:string,path_prefix:string,requests:bigint,request_threshold:bigint,able:boolean>>")
        self.site = handle.getMapState("site", "bucket_us bigint", "n bigint")
        self.came = handle.getMapState("came", "eval_us bigint", "records bigint, fresh bigint, future bigint, stale bigint, invalid bigint, lag_us bigint")
        self.lines = handle.getMapState("lines", "eval_us bigint", "lines array<bigint>")
        self.recent = handle.getValueState("recent", "lines array<bigint>")
        self.tried = handle.getMapState("tried", "method string, path_prefix string, bucket_us bigint", "n bigint")
        self.streaks = handle.getValueState("streaks", "eval_us bigint, held array<struct<kind:string,method:string,path:string,n:bigint>>")
        self.rules = handle.getMapState("rules", "method string, path_prefix string", "request_threshold bigint, reasons string, first_us bigint, last_us bigint, expires_us bigint")
        self.applied = handle.getMapState("applied", "method string, path_prefix string", "expires_us bigint")
        self.last = handle.getValueState("last", "eval_us bigint, applied_us bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rules from a former run; what has ended meanwhile was left out by `restored`."""
        for x in initialState.itertuples(index=False):
            self.rules.updateValue((x.method, x.path_prefix), (x.request_threshold, x.reasons, x.first_us, x.last_us, x.expires_us))
            self._due(int(x.expires_us))

    def _due(self, us: int) -> None:
        self.handle.registerTimer(-(-us // self.step) * self.step // 1000)

    def _requests(self, now: int) -> int:
        """The site's requests in a window; the bucket that no later window holds goes."""
        first = now - self.window + self.step
        total = sum((self.site.getValue((at,)) or (0,))[0] for at in range(first, now + 1, self.step))
        self.site.removeKey((first,))
        return total

    def _attempts(self, now: int) -> dict[tuple, int]:
        """Attempts by rule in a window; buckets that no later window holds go."""
        first, total = now - self.window + self.step, {}
        for (method, path, at), (n,) in list(self.tried.iterator()):
            if first <= at <= now:
                total[method, path] = total.get((method, path), 0) + n
            if at <= first:
                self.tried.removeKey((method, path, at))
        return total

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        over: dict[int, list] = {}
        ended, tracked, sums, came, lines = timerValues.getCurrentWatermarkInMs() * 1000, None, {}, {}, {}
        rules, met, most = None, {}, 4 * self.d.max_groups
        for x in rows:
            for r in x[x["row"].isin(("i", "h"))].itertuples(index=False):
                at = int(r.eval_us)
                if r.row == "i":
                    old = came.get(at, (0,) * 6)
                    came[at] = (*(a + int(b) for a, b in zip(old, (r.records, r.fresh, r.future, r.stale, r.invalid), strict=False)), max(old[5], int(r.lag_us)))
                else:
                    lines[at] = sorted([*lines.get(at, []), *map(int, r.lines)])[-HEALTH_LINES:]
            site = x[x["row"] == "s"]
            for at, n in site["requests"].astype("int64").groupby(site["eval_us"].astype("int64")).sum().items():
                sums[self.site, (int(at),)] = sums.get((self.site, (int(at),)), 0) + int(n)
            tried = x[x["row"] == "a"]
            if len(tried) and rules is None:
                rules = list(self.rules.keys())
            if rules:
                each = tried["requests"].astype("int64").groupby([tried["method"], tried["path_prefix"], tried["eval_us"].astype("int64")]).sum()
                for (method, path, at), n in each.items():
                    if (method, path) not in met:
                        met[method, path] = self._ruling(rules, method, path)
                    for m, p in met[method, path]:
                        sums[self.tried, (m, p, int(at))] = sums.get((self.tried, (m, p, int(at))), 0) + int(n)
            windows = x[x["row"] == "g"]
            tracked = windows if tracked is None else pd.concat([tracked, windows])
            if len(tracked) > most:
                tracked = self._first(tracked, over)
                most = max(most, 2 * len(tracked))
        for (state, name), n in sums.items():
            state.updateValue(name, ((state.getValue(name) or (0,))[0] + n,))
        for at, own in came.items():
            old = self.came.getValue((at,)) or (0,) * 6
            self.came.updateValue((at,), (*(a + b for a, b in zip(old[:5], own[:5], strict=True)), max(old[5], own[5])))
            if at > ended:
                self._due(at)
        for at, own in lines.items():
            old = (self.lines.getValue((at,)) or ([],))[0]
            self.lines.updateValue((at,), (sorted([*old, *own])[-HEALTH_LINES:],))
        if tracked is not None and len(tracked):
            for at, own in self._first(tracked, over).groupby("eval_us"):
                first = [(r.kind, r.method, r.path, r.path_prefix, int(r.requests), int(r.request_threshold), bool(r.able)) for r in own.itertuples(index=False)]
                self.groups.updateValue((int(at),), (sum(over[int(at)]), first))
                self._due(int(at))
        return iter(())

    @staticmethod
    def _ruling(rules: list[tuple], method: str, path: str) -> list[tuple]:
        """Those of the active rules that a request meets."""
        return [(m, p) for m, p in rules if m == method and (path == p or path.startswith(p if p.endswith("/") else p + "/"))]

    def _first(self, windows: pd.DataFrame, over: dict[int, list]) -> pd.DataFrame:
        """Groups that were first to come, `max_groups` of each evaluation, volume before shape; `over` counts the rest. All
        windows of an evaluation come in one batch, as one watermark ends them."""
        order = windows.assign(_o=(windows["kind"] == "shape") * 1).sort_values(["eval_us", "first_seq", "_o", "kind", "method", "path"])
        kept = order.groupby("eval_us", sort=False).head(self.d.max_groups)
        for at, n in (order.groupby("eval_us").size() - kept.groupby("eval_us").size()).items():
            over.setdefault(int(at), []).append(int(n))
        return kept.drop(columns="_o")

    def _suspended(self, now: int) -> tuple[bool, bool, tuple]:
        """Whether the sensor may activate rules, whether detection is suspended, and the intake of the interval."""
        came = self.came.getValue((now,)) or (0,) * 6
        before = list(self.recent.get()[0]) if self.recent.exists() else []
        lines = sorted([*before, *(self.lines.getValue((now,)) or ([],))[0]])[-HEALTH_LINES:]
        if lines != before:
            self.recent.update((lines,))
            self.lines.removeKey((now,))
        broken = len(lines) == HEALTH_LINES and sum(x & 1 for x in lines) > HEALTH_ERRORS
        return came[1] > 0 and not broken, broken or (came[0] > 0 and came[1] == 0), came

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, d = expiredTimerInfo.getExpiryTimeInMs() * 1000, [], self.d
        last, applied_us = self.last.get() if self.last.exists() else (0, 0)
        if now <= last:
            return

        def tell(event: str, *, kind=None, method=None, path=None, prefix=None, n=None, least=None, reasons=None, expires=None, apply_now=None) -> None:
            out.append((key[0], now, event, kind, method, path, prefix, n, least, reasons, expires, apply_now))

        may, suspended, came = self._suspended(now)
        if suspended:
            tell("suspended")
        for name, n in zip(("records", "fresh", "future", "stale", "invalid-time", "max-lag"), came, strict=True):
            if n:
                tell("intake", kind=name, n=n)
        site = self._requests(now)
        over, held = self.groups.getValue((now,)) or (0, [])
        if over:
            tell("overflow", n=over)
        proposed: dict[tuple, tuple] = {}
        at, ran = self.streaks.get() if self.streaks.exists() else (0, [])
        # an evaluation without it ends a streak
        before, streaks = {(k, m, p): n for k, m, p, n in ran} if at == now - self.step else {}, []
        for rank, (kind, method, path, prefix, n, least, able) in enumerate(held):
            tell("tracked", kind=kind, method=method, path=path, prefix=prefix, n=rank + 1)
            good = able and (kind == "shape" or (site > 0 and n * 1_000_000 >= site * d.volume_min_share_ppm))
            if not (may and good):
                continue
            streak = before.get((kind, method, path), 0) + 1
            streaks.append((kind, method, path, streak))
            tell("qualified", kind=kind, method=method, path=path, prefix=prefix, n=streak, least=least)
            if streak >= d.consecutive:
                reason, old = "extreme-volume" if kind == "volume" else "distributed-expense", proposed.get((method, prefix), (least, set()))
                proposed[method, prefix] = (min(old[0], least), old[1] | {reason})
        if streaks or ran:
            self.streaks.update((now, streaks))
        rules = self._ruled(now, may, proposed, tell)
        applied_us = self._handed_on(now, rules, applied_us, tell)
        self.last.update((now, applied_us))
        self.came.removeKey((now,))
        self.groups.removeKey((now,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({c: "Int64" for c in ("n", "request_threshold", "expires_us")})

    def _ruled(self, now: int, may: bool, proposed: dict, tell) -> dict:
        expires, rules, fresh = now + self.d.ttl_s * 1_000_000, dict(self.rules.iterator()), set()
        for (method, prefix), (least, reasons) in sorted(proposed.items()):
            named = {"method": method, "prefix": prefix}
            tell("proposal", **named, least=least, reasons=",".join(sorted(reasons)))
            old = rules.get((method, prefix))
            if old is None and len(rules) >= self.d.max_rules:
                tell("capacity", **named)
                continue
            why = ",".join(sorted(reasons | set(old[1].split(",")) if old else reasons))
            rules[method, prefix] = (old[0] if old else least, why, old[2] if old else now, now, expires)
            fresh.add((method, prefix))
            tell("refreshed" if old else "activated", **named, least=rules[method, prefix][0], expires=expires)
        tried = self._attempts(now)
        for name in sorted(rules):
            if may and name not in fresh and tried.get(name, 0) >= rules[name][0]:
                rules[name] = (*rules[name][:3], now, expires)
                fresh.add(name)
                tell("refreshed", kind="active-attempts", method=name[0], prefix=name[1], n=tried.get(name, 0), least=rules[name][0], expires=expires)
        for name in [x for x in sorted(rules) if rules[x][4] <= now and x not in fresh]:
            tell("expired", method=name[0], prefix=name[1])
            del rules[name]
            self.rules.removeKey(name)
        for name in fresh:
            self.rules.updateValue(name, rules[name])
            self._due(expires)
        return rules

    def _handed_on(self, now: int, rules: dict, applied_us: int, tell) -> int:
        """Whether the rules go out now: the first ones and removals at once, else `min_interval_s` after the last time."""
        want, have = {k: v[4] for k, v in rules.items()}, {k: v[0] for k, v in self.applied.iterator()}
        if want == have:
            return applied_us
        ready = bool(have.keys() - want.keys()) or not have or applied_us == 0 or now - applied_us >= self.pause
        tell("apply", n=len(want), apply_now=ready)
        if not ready:
            self._due(applied_us + self.pause)
            return applied_us
        self.applied.clear()
        for name, expires in sorted(want.items()):
            self.applied.updateValue(name, (expires,))
            tell("rule", method=name[0], prefix=name[1], least=rules[name][0], reasons=rules[name][1], expires=expires)
        return now

    def close(self) -> None: ...


def events(records: DataFrame, d: Detection, baselines: tuple[DataFrame, DataFrame, DataFrame], min_interval_s: int = 0, rules: DataFrame | None = None) -> DataFrame:
    """Everything that the detector says about a stream of RECORDS, as EVENTS: tracked and qualified groups (n: rank and
    streak), proposals, rules that are activated, refreshed, expired or find no room, intake, suspension, and what is handed
    on. `baselines` as for `detector.thresholds`; `rules` are those of a former run (see `restored`).

    Null methods, paths and clients are no candidates; lines without a receipt are left out; a record that comes twice counts
    twice; an empty stream says nothing."""
    known = records.where("receipt_us > 0")
    judged = detector.thresholds(group_windows(known, d), *baselines, d).withColumn("row", F.lit("g"))
    names = [c.split()[0] for c in _SITE.split(", ")]
    both = judged.select(*(c for c in names if c in judged.columns)).unionByName(_intake(known, d), allowMissingColumns=True)
    initial = None if rules is None else rules.groupBy("site")
    return both.groupBy("site").transformWithStateInPandas(Evaluations(d, min_interval_s), EVENTS, "Append", "EventTime", initialState=initial)


def start(found: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run `events` into the folder `out`, whose partitions are evaluations: a batch that is repeated after a failure
    replaces its own evaluations and changes nothing. `once` ends when all input is read."""
    spark = found.sparkSession

    def hand_over(df: DataFrame, _: int) -> None:
        df.repartition("site", "eval_us").write.partitionBy("site", "eval_us").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = found.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(_STORE, before)


def handed(spark: SparkSession, out: str) -> DataFrame:
    """All events handed over so far."""
    return spark.read.schema(EVENTS).parquet(out)


def restored(spark: SparkSession, checkpoint: str, now_us: int) -> DataFrame:
    """Rules that a checkpoint holds and that have not ended at `now_us`, for a new run. Settings that must not share rules
    have folders of their own (`live.state_folder`), so another digest finds none."""
    rows = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "rules").load(checkpoint)
    out = rows.select(F.col("key.site").alias("site"), "user_map_key.*", "user_map_value.*") if "user_map_key" in rows.columns else rows.select(F.col("key.site").alias("site"), F.explode("map_value").alias("k", "v")).select("site", "k.*", "v.*")
    return out.where(F.col("expires_us") > now_us)
