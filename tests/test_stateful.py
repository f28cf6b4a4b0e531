"""The streaming detector: suspension, rules with their end, restart, restored rules and repeated batches."""

import os

import pytest

from logweir.streaming import stateful
from logweir.streaming.detector import Detection

D = Detection(window_s=20, interval_s=10, consecutive=2, max_lag_s=5, multiplier=1, volume_min_requests=5, volume_min_share_ppm=1, distributed_min_requests=10**9, ttl_s=30, max_rules=1)
S = 1_000_000


def line(seq, t, prefix="/a/", lag=0, error=False):
    if error:
        return ("s", seq, t, *(None,) * 9, True)
    return ("s", seq, t, t - lag, "GET", prefix, prefix, f"c{seq % 3}", 5, True, True, True, False)


def busy(start, end, first, prefix="/a/", n=12):
    return [line(first + k, start * S + (end - start) * S * (k + 1) // n, prefix) for k in range(n)]


#: Two busy intervals, one with a broken sensor, one whose lines are all stale, a quiet end.
FILES = [
    busy(0, 10, 0) + busy(10, 20, 20) + busy(10, 20, 40, "/b/", 6),
    [line(100 + k, 21 * S + k, error=k % 5 == 0) for k in range(100)] + busy(22, 30, 300, "/b/", 6),
    [line(400 + k, 31 * S + k * 1000, "/b/") for k in range(120)] + [line(600, 45 * S, lag=6 * S)],
    [line(700, 400 * S, error=True)],
    [line(701, 800 * S, error=True)],
]


@pytest.fixture
def setting(spark, tmp_path):
    none = spark.createDataFrame([], "method string, path string, p99 bigint")

    def put(folder, numbers):
        for i in numbers:
            spark.createDataFrame(FILES[i], stateful.RECORDS).coalesce(1).write.parquet(str(tmp_path / folder / str(i)))

    def run(folder, name, rules=None):
        records = spark.readStream.schema(stateful.RECORDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder / "*"))
        found = stateful.events(records, D, (none,) * 3, min_interval_s=15, rules=rules)
        stateful.start(found, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"), once=True).awaitTermination(300)
        return told(name)

    def told(name):
        rows = stateful.handed(spark, str(tmp_path / f"{name}-out")).collect()
        return sorted(((r.eval_us // S, r.event, r.kind, r.path_prefix, r.n, r.expires_us, r.apply_now) for r in rows), key=repr)

    return put, run, told, tmp_path


def test_detector_in_a_stream(spark, setting):
    put, run, told, path = setting
    put("all", range(5))
    one = run("all", "one")
    of = lambda *names: [(t, e, p) for t, e, k, p, *_ in one if e in names]
    # /a/ qualifies at 10 and 20; at 30 the sensor is broken, and at 50 all that came was stale
    assert of("activated", "expired") == [(20, "activated", "/a/"), (50, "expired", "/a/")]
    assert sorted(t for t, _, _ in of("suspended")) == [30, 50, 400] and not [x for x in of("proposal") if x[0] in (30, 50)]
    assert {(t, n) for t, e, k, _, n, *_ in one if (e, k) == ("intake", "stale")} == {(50, 1)}
    assert (20, "apply", None, None, 1, None, True) in one and (50, "apply", None, None, 0, None, True) in one
    assert max(n for _, e, k, p, n, *_ in one if e == "qualified" and p == "/a/") == 2

    # the same with a restart in the middle, and rules that are read from its checkpoint then
    put("parts", range(3))
    run("parts", "two")
    kept = stateful.restored(spark, str(path / "two-cp"), 0)
    assert [(r.site, r.method, r.path_prefix, r.expires_us) for r in kept.collect()] == [("s", "GET", "/a/", 50 * S)]
    assert stateful.restored(spark, str(path / "two-cp"), 50 * S).isEmpty()
    # another checkpoint begins with them: they end in time
    saved = spark.createDataFrame(kept.collect(), kept.schema)
    put("late", (3, 4))
    assert [(e, p) for _, e, _, p, *_ in run("late", "three", saved) if e == "expired"] == [("expired", "/a/")]
    put("parts", (3, 4))
    assert run("parts", "two") == one

    # a batch that was not committed runs again and changes nothing
    done = path / "two-cp" / "commits"
    last = max((int(x) for x in os.listdir(done) if x.isdigit()))
    os.remove(done / str(last))
    if (done / f".{last}.crc").exists():
        os.remove(done / f".{last}.crc")
    assert run("parts", "two") == one
