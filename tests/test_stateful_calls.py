"""How often the streaming detector asks its state, and what it sums before: by fakes of the state, and in small batches."""

from collections import Counter

import pandas as pd

from logweir.streaming import stateful
from logweir.streaming.detector import Detection

D = Detection(window_s=20, interval_s=10, consecutive=2, multiplier=1, volume_min_requests=1, volume_min_share_ppm=1)
S = 1_000_000


class Map(dict):
    __hash__ = object.__hash__

    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def getValue(self, key):
        self.calls[self.name] += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls[self.name] += 1
        self[key] = value

    def removeKey(self, key):
        self.calls[self.name] += 1
        self.pop(key, None)

    def iterator(self):
        self.calls[self.name] += 1
        return iter(list(self.items()))

    def keys(self):
        self.calls[self.name] += 1
        return iter(list(super().keys()))


class Value:
    def __init__(self, calls, name):
        self.calls, self.name, self.held = calls, name, None

    def exists(self):
        self.calls[self.name] += 1
        return self.held is not None

    def get(self):
        self.calls[self.name] += 1
        return self.held

    def update(self, value):
        self.calls[self.name] += 1
        self.held = value


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getMapState(self, name, *_):
        return Map(self.calls, name)

    def getValueState(self, name, *_):
        return Value(self.calls, name)

    def registerTimer(self, ms):
        self.timers.add(ms)


class Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_attempts_and_streaks_are_read_at_once():
    h, e = Handle(), stateful.Evaluations(D, 0)
    e.init(h)
    names = [c.split()[0] for c in stateful._SITE.split(", ")]
    row = dict.fromkeys(names)
    intake = row | {"row": "i", "records": 1, "fresh": 1, "future": 0, "stale": 0, "invalid": 0, "lag_us": 0}
    site = row | {"row": "s", "requests": 1500}
    groups = [row | {"row": "g", "kind": "volume", "method": "GET", "path": f"/{k}/", "path_prefix": f"/{k}/", "first_seq": k, "requests": 5, "request_threshold": 1, "able": True} for k in range(300)]
    tried = [row | {"row": "a", "method": "GET", "path_prefix": f"/{k % 2}/x", "requests": 1} for k in range(300)]
    e.rules["GET", "/0/"] = (1, "extreme-volume", 0, 0, 10**12)
    for at in (10 * S, 20 * S):
        rows = [x | {"site": "s", "eval_us": at, "at": pd.Timestamp(at, unit="us")} for x in (intake, site, *groups, *tried)]
        list(e.handleInputRows(("s",), iter([pd.DataFrame(rows[:300], columns=names), pd.DataFrame(rows[300:], columns=names)]), Time(0)))
    assert h.calls["rules"] == 2
    for at in (10, 20):
        (out,) = e.handleExpiredTimer(("s",), Time(at * 1000), Time(at * 1000))
        assert sorted(out[out["event"] == "qualified"]["n"]) == [at // 10] * 300
    assert h.calls["streaks"] <= 6 and e.tried == {("GET", "/0/", 20 * S): (150,)}
    assert (out["event"] == "proposal").sum() == 300


def test_a_share_reads_a_window_at_once():
    h, w = Handle(), stateful.Windows(D)
    w.init(h)
    columns = ["kind", "method", "path", "bucket_us", "requests", "upstream_samples", "upstream_us", "lo", "hi", "first_seq", "sk"]
    rows = [("shape", "GET", f"/{k % 200}", at, 1, 1, 7, "/a", f"/{k % 200}", k, f"{k:016x}") for at in (10 * S, 20 * S) for k in range(400)]
    list(w.handleInputRows(("s", 0), iter([pd.DataFrame(rows, columns=columns)]), Time(0)))
    assert h.timers == {10_000, 20_000, 30_000} and h.calls["buckets"] == 4
    out = {at: next(w.handleExpiredTimer(("s", 0), Time(at), Time(at))) for at in (10_000, 20_000, 30_000)}
    assert h.calls["buckets"] == 12 and not w.buckets
    assert {at: (len(x), *x["requests"].unique(), *x["upstream_us"].unique()) for at, x in out.items()} == {10_000: (200, 2, 14), 20_000: (200, 4, 28), 30_000: (200, 2, 14)}
    assert all(x.set_index("path")["sk"]["/5"] == [f"{k:016x}" for k in (5, 205)] for x in out.values())


def test_small_batches_are_summed_together(spark):
    rows = [("s", k, k + 1, k + 1, "GET", f"/{k % 3}/", f"/{k % 3}/", f"c{k % 100}", None if k % 4 else 5, True, True, True, False) for k in range(600)]
    df = spark.createDataFrame(rows, stateful.RECORDS).coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 10)
    try:
        got = [r for r in stateful._partial_groups(df, D).collect() if r["kind"] != "clock"]
    finally:
        spark.conf.set(size, before)
    assert sorted((r["kind"], r["path"], r["requests"], r["upstream_samples"], r["upstream_us"], r["first_seq"], len(r["sk"].split(","))) for r in got) == sorted((k, f"/{p}/", 200, 50, 250, p, 64) for k in ("volume", "shape") for p in range(3))
