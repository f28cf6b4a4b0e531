"""Token buckets and the order latch where one subject holds most of the log."""

import random

from pyspark.sql import functions as F

from logweir.operators import rate


def log(spark, breaks):
    rng, rows, at = random.Random(5), [], 0
    for seq in range(1500):
        at += rng.choice([0, 1, 2, 3, 5, 36]) * 1_000_000 + rng.choice([0, 0, 0, 1, -1 if breaks and seq > 1200 else 0]) * 70_000_000 * rng.choice([0, 0, 0, 1])
        rows.append((seq, "hot" if rng.random() < 0.8 else f"c{rng.randrange(9)}", f"u{rng.randrange(1, 3) if seq % 50 == 0 else 1}", at))
    return rows, spark.createDataFrame(rows, "seq bigint, client_key string, ua_key string, ts_us bigint")


def plain(rows):
    out, held = {}, {}
    for seq, client, ua, ts in rows:
        s = held.setdefault((client, ua), {"last": ts, "late": False, "left": {n: (b + 1) * 60_000_000 for n, (_, b) in rate.PROFILES.items()}})
        s["late"] = s["late"] or ts < s["last"]
        passed = {}
        if not s["late"]:
            for n, (r, b) in rate.PROFILES.items():
                s["left"][n] = min((b + 1) * 60_000_000, s["left"][n] + (ts - s["last"]) * r)
                passed[n] = s["left"][n] >= 60_000_000
                s["left"][n] -= 60_000_000 * passed[n]
            s["last"] = ts
        out[seq] = (s["late"], not s["late"], *(passed.get(n) for n in rate.PROFILES))
    return out


def test_blocks_and_segments_change_nothing(spark):
    for breaks in (False, True):
        rows, df = log(spark, breaks)
        expected = plain(rows)
        assert any(x[0] for x in expected.values()) == breaks and {x[4] for x in expected.values()} >= {True, False}
        for block in (7, 100, rate.BLOCK):
            late = {r["seq"]: r["unordered"] for r in rate.placed(df, block=block).collect()}
            assert late == {k: x[0] for k, x in expected.items()}
            got = {r["seq"]: tuple(r)[1:] for r in rate.decisions(df, block=block).collect()}
            assert got == {k: x[1:] for k, x in expected.items()}


def test_a_hot_subject_is_many_segments(spark):
    rows, df = log(spark, False)
    sizes = rate.placed(df, block=100).where("client_key = 'hot'").groupBy("segment").count()
    n = sum(r[1] == "hot" for r in rows)
    assert sizes.agg(F.max("count")).first()[0] < n / 10 and sizes.count() > 100 and n > len(rows) / 2
    assert rate.FULL_US == 36_000_000
