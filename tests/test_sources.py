"""Log grammars, line sources, policies and stream state on small hand-made input."""

import gzip
import hashlib
import json

import pytest

from logweir.functions import numbers, probes
from logweir.operators import policy
from logweir.plans.events import normalised
from logweir.sources import lines, parsers, streams
from logweir.streaming import live
from logweir.streaming.detector import Detection

KEY = bytes(32)


def combined(ip="198.51.100.7", at="02/Mar/2025:23:59:58 -0130", request="GET /shop/items?sort=asc HTTP/2.0", status="304", size="77", referer="-", agent="Reader/3 (test)", end=""):
    return f'{ip} - alice [{at}] "{request}" {status} {size} "{referer}" "{agent}"{end}'


def nginx(drop=(), **more):
    record = {"timestamp": "2025-03-03T01:29:58.5Z", "remote_addr": "198.51.100.7", "method": "POST", "uri": "/cart", "status": "201", "bytes_sent": "9", "request_time": "0.25", "upstream_response_time": "-, 0.1", "upstream_cache_status": "BYPASS", "user_agent": "Reader/3", "referer": "https://a.example/x"} | more
    return json.dumps({k: v for k, v in record.items() if k not in drop})


def caddy(drop=(), request=None, **more):
    record = {"ts": 1740965398.25, "request": {"remote_ip": "198.51.100.7", "method": "GET", "uri": "/a", "headers": {"User-Agent": ["Reader/3"]}} | (request or {}), "status": 404, "size": 12, "duration": 0.5} | more
    return json.dumps({k: v for k, v in record.items() if k not in drop})


GOOD, BAD = {}, {}
GOOD["nginx-combined"] = [combined(), combined(ip="2001:DB8:0:0::A"), combined(request="DELETE / HTTP/1.0"), combined(status="100", size="0"), combined(agent='a \\"quoted\\" word'), combined(referer="https://x.example/"), "  " + combined()]
BAD["nginx-combined"] = [combined(ip="300.1.1.1"), combined(ip="[::1]"), combined(at="02-Mar-2025"), combined(at="31/Foo/2025:00:00:00 +0000"), combined(request="-"), combined(request="GET /only-two"), combined(request="GET /a b HTTP/1.1"), combined(request="GET / SPDY/3"), combined(status="6x"), combined(status="600"), combined(size="-"), combined(size="-4"), combined(end=" more"), combined().replace("[", ""), combined().removesuffix('"'), "plain words"]
GOOD["nginx-json"] = [nginx(), nginx(other="kept out", deep={"x": [1]}), nginx(drop=("referer", "user_agent", "request_time")), nginx(request_time="-", upstream_response_time="-"), nginx(timestamp="2025-03-03T03:29:58+02:00"), nginx(remote_addr="::ffff:192.0.2.9"), nginx(upstream_cache_status="NEW")]
BAD["nginx-json"] = [nginx(drop=("method",)), nginx(status=201), nginx(status="99"), nginx(bytes_sent="1.5"), nginx(request_time="1e-3"), nginx(upstream_response_time="0.1, x"), nginx(remote_addr="host.example"), nginx(timestamp="03/Mar/2025"), nginx(user_agent=["a"]), nginx()[:-1], nginx() + " {}", nginx()[:-1] + ', "uri": "/again"}', "[]", "null"]
GOOD["caddy-json"] = [caddy(), caddy(request={"headers": {}}), caddy(request={"headers": {"User-Agent": ["a", "b"], "Referer": ["https://r.example"]}}), caddy(duration=0), caddy(size=0, level="info"), caddy(request={"remote_ip": "2001:db8::7"})]
BAD["caddy-json"] = [caddy(drop=("ts",)), caddy(drop=("request",)), caddy(ts="1740965398"), caddy(status="404"), caddy(status=1000), caddy(size=-1), caddy(size=None), caddy(duration=-0.5), caddy(request={"remote_ip": "198.51.100.7:1"}), caddy().replace("0.5", "5e-1"), caddy()[:-1] + ', "size": 3}', "{}"]


@pytest.mark.parametrize("kind", sorted(GOOD))
def test_grammar(spark, kind):
    cases = [(x, True) for x in GOOD[kind]] + [(x, False) for x in BAD[kind]] + [("", False)]
    parsed = parsers.PARSERS[kind](spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "seq bigint, line string"))
    got = {r["seq"]: r["line_code"] is None and r["raw_code"] is None for r in normalised(parsed, KEY).select("seq", "line_code", "raw_code").collect()}
    assert {cases[i][0]: ok for i, ok in got.items()} == dict(cases)


def test_values_of_lines(spark):
    one = lambda parse, line: parse(spark.createDataFrame([(0, line)], "seq bigint, line string")).first()
    r = one(parsers.nginx_combined, combined())
    assert (r["ts_us"], r["method"], r["request_uri"], r["status"], r["bytes_sent"], r["referer"]) == (1740965398000000, "GET", "/shop/items?sort=asc", 304, 77, "-")
    r = one(parsers.nginx_json, nginx())
    assert (r["ts_us"], r["request_duration_us"], r["upstream_duration_us"], r["cache_state"]) == (1740965398500000, 250000, 100000, "bypass")
    r = one(parsers.caddy_json, caddy(request={"headers": {"User-Agent": ["a", "b"]}}))
    assert (r["ts_us"], r["request_duration_us"], r["user_agent"], r["flag"]) == (1740965398250000, 500000, "a", True)


def test_protection_record(spark):
    full = {"nginx_uri": "/cart", "limit_req_status": "PASSED"}
    cases = [(nginx(**full), None, None), (nginx(**full, status="429") .replace("PASSED", "REJECTED"), None, None), (nginx(**(full | {"limit_req_status": "REJECTED"})), "record_content", "invalid_limit_req_status"), (nginx(**(full | {"nginx_uri": "cart"})), "record_content", "invalid_nginx_uri"), (nginx(**full, drop=("referer",)), "sensor_structure", "invalid_json"), (nginx(), "sensor_structure", "invalid_json"), (nginx(**full, status="x"), "record_content", "invalid_status"), ("{", "sensor_structure", "invalid_json"), ("", "record_content", "empty_line")]
    df = parsers.nginx_json(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "seq bigint, line string"), protection=True)
    assert {r["seq"]: (r["error_class"], r["line_code"]) for r in df.collect()} == {i: c[1:] for i, c in enumerate(cases)}


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "2.log").write_bytes(b"one\r\n\ntwo\rx\n" + b"y" * 50 + b"\nlast")
    (tmp_path / "more").mkdir()
    for name in "ba":
        (tmp_path / "more" / f"{name}.log").write_bytes(f"first of {name}\nsecond of {name}\n".encode())
    got = lines.read_lines(spark, [str(tmp_path / "2.log"), str(tmp_path / "more")], max_line=20).orderBy("seq").collect()
    assert [(r["source_ordinal"], r["line"], r["line_code"]) for r in got] == [(0, "one", None), (0, "", "empty_line"), (0, "two\rx", None), (0, "", "line_too_long"), (0, "last", None), *((k, f"{n} of {x}", None) for k, x in ((1, "a"), (2, "b")) for n in ("first", "second"))]


def test_gzip_is_known_by_its_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(gzip.compress(b"a\n\n") + gzip.compress(b"b\r\n" + b"z" * 3_000_000 + b"\nend"))
    got = streams.read_sources(spark, [str(tmp_path / "x.log")], max_bytes=1 << 24, max_ratio=10_000)[0].orderBy("seq").collect()
    assert [(r["line"], r["line_code"]) for r in got] == [("a", None), ("", "empty_line"), ("b", None), ("", "line_too_long"), ("end", None)]


def test_expansion_is_bounded(spark, tmp_path):
    made = {"bomb": gzip.compress(bytes(1 << 26)), "cut": gzip.compress(b"abc" * 99)[:-9], "plain": b"x\n", "good": gzip.compress(b"y\n" * 10)}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    facts = {r["path"].rsplit("/", 1)[1]: r for r in streams.source_facts(spark, [str(tmp_path)]).collect()}
    assert {k: r["error"] for k, r in facts.items()} == {"bomb": "expansion limit exceeded", "cut": "invalid gzip stream", "plain": None, "good": None}
    assert facts["good"]["expanded_bytes"] == 20 and facts["good"]["sha256"] == hashlib.sha256(made["good"]).hexdigest() and facts["bomb"]["expanded_bytes"] <= 200 * len(made["bomb"])
    with pytest.raises(ValueError, match="expansion limit"):
        streams.read_sources(spark, [str(tmp_path / "good")], max_bytes=19)


def test_sources_share_one_cap(spark, tmp_path):
    made = {"0.log": b"a\nb\n", "1.gz": gzip.compress(b"c\n" * 500), "2.log": gzip.compress(b"d\r\n" * 300) + gzip.compress(b"last"), "3.gz": b"", "4.gz": b"\x1f"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    size = 4 + 1000 + 904 + 0 + 1
    rows, facts = streams.read_sources(spark, [str(tmp_path)], max_bytes=size)
    got = facts.orderBy("source_ordinal").collect()
    assert [(r["compressed"], r["bytes"], r["expanded_bytes"], r["lines"]) for r in got] == [(n in (1, 2), len(c), e, k) for n, (c, e, k) in enumerate(zip(made.values(), (4, 1000, 904, 0, 1), (2, 500, 301, 0, 1), strict=True))]
    assert [r["sha256"] for r in got] == [hashlib.sha256(c).hexdigest() for c in made.values()]
    assert [r["line"] for r in rows.orderBy("seq").collect()] == ["a", "b"] + ["c"] * 500 + ["d"] * 300 + ["last", "\x1f"]
    for cap, message in ((size - 1, "source 4: expansion"), (1200, "source 2: expansion"), (4, "expansion limit")):
        with pytest.raises(ValueError, match=message):
            streams.read_sources(spark, [str(tmp_path)], max_bytes=cap)


def test_what_is_no_source(spark, tmp_path):
    (tmp_path / "cut").write_bytes(gzip.compress(b"abc\n" * 9999)[:-9])
    (tmp_path / "tail").write_bytes(gzip.compress(b"abc\n") + b"more")
    (tmp_path / "link").symlink_to(tmp_path / "cut")
    for names, message in ((["cut"], "source 0: invalid gzip"), (["tail"], "source 0: invalid gzip"), (["link"], "regular file"), (["none"], "regular file"), (["cut"] * 65, "65 inputs"), ([], "0 inputs")):
        with pytest.raises(Exception, match=message):
            streams.read_sources(spark, [str(tmp_path / n) for n in names])


def test_expansion_takes_flat_memory(tmp_path):
    import resource

    with gzip.open(tmp_path / "x", "wb", compresslevel=1) as f:
        for _ in range(300):
            f.write((b"0123456789" * 10 + b"\n") * 10_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    stream = streams.Stream(str(tmp_path / "x"), 1 << 34, 10_000)
    assert sum(1 for _ in streams.split_lines(stream.blocks(), 1000)) == 3_000_000
    assert stream.expanded == 303_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000


def test_routes(spark):
    rows = [("/members/bob@mail.example/notes/1999/7", "/members/{email}/notes/{year}/{int}", "/members/"), ("/", "/", "/"), ("/x//y", "/x//y", None), ("/x%2Fy", "/{encoded-separator}", None), ("/1999", "/{year}", "/"), ("/größe", "/größe", None), ("/" + "y." * 49, "/{long}", "/")]
    df = spark.createDataFrame([(i, 1, "192.0.2.1", "GET", u, 200, 0, None, None, "", "", "") for i, (u, *_) in enumerate(rows)], "seq bigint, ts_us bigint, client_ip string, method string, request_uri string, status int, bytes_sent bigint, request_duration_us bigint, upstream_duration_us bigint, cache_state string, user_agent string, referer string")
    got = normalised(df, KEY).orderBy("seq").select("route", "actionable_prefix").collect()
    assert [tuple(r) for r in got] == [(b, c) for _, b, c in rows]


def test_static_signatures(spark):
    hit = {
        "env-file-scan": ["/.env?a", "/srv/www/.ENV.bak", "/.env/x"], "git-metadata-scan": ["/sub/.git", "/.GIT?x", "/a/.git/index"], "log4shell-probe": ["/?h=${JNDI:rmi://198.51.100.1/o}"],
        "path-traversal-scan": ["/..", "/img/..%2Fkeys", "/img%5C%2e%2E%5ckeys", "/img\\..?x"], "phpmyadmin-scan": ["/PhpMyAdmin/index.php"], "shell-probe": ["/up/wso.php?cmd=id", "c99.php"], "wp-login-scan": ["/wp-login.php?r=1", "/wp-admin/"],
    }
    miss = ["/.envy", "/a.env", "/.gitignore", "/x.git/", "/?h=$jndi:", "/a..b/c", "/..a", "/x/pma/", "/wso.php5", "/a/wp-login.php"]
    rows = [(u, k) for k, us in hit.items() for u in us] + [(u, "") for u in miss]
    got = spark.createDataFrame(rows, "u string, k string").selectExpr("u", f"array_join({probes.static_signatures('u')}, ',') AS got", "k").collect()
    assert [(r["u"], r["got"]) for r in got] == rows


def test_numbers(spark):
    one = lambda e: spark.range(1).selectExpr(f"{e} AS x").first()[0]
    assert one(numbers.ratio_ppm("9223372036854775806L", "9223372036854775807L")) == 999_999
    assert one(numbers.seconds_to_us("'0.0000015'")) == 2 and one(numbers.seconds_to_us("'1.'")) is None
    assert [one(numbers.threshold(f"{p}L", 7, 10, 10)) for p in (61, 119, 121, 0)] == [110, 200, 210, 7]
    assert one(numbers.zone_mib("65537L")) == 33


def policy_text(**rule):
    first = {"id": "no-feeds", "match": {"crawler_names": [], "categories": ["claimed_other_crawler"], "path_prefixes": ["/feed"], "methods": ["HEAD"]}, "action": {"kind": "deny", "rate_profile": None, "cache_ttl_seconds": None}} | rule
    return json.dumps({"schema_version": 1, "name": "mine & yours", "description": "one <rule>", "rules": [first]}, separators=(",", ":"))


def test_policy_hash_and_rules():
    text = policy_text()
    escaped = text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    assert policy.parse_policy(text).sha256() == hashlib.sha256(escaped.encode()).hexdigest()
    for bad in (text.replace('"name":"mine & yours",', ""), text.replace('"name"', '"title"'), text.replace("claimed_other_crawler", "nobody"), text.replace('"/feed"', '"feed"'), text[:-1] + ',"name":"again"}'):
        with pytest.raises(ValueError):
            policy.parse_policy(bad)


def test_acknowledgements():
    found = [("a", "high", True), ("b", "high", False), ("c", "medium", True)]
    assert policy.acknowledged(found, ["c", "a"]) and not any(policy.acknowledged(found, x) for x in (["a"], ["a", "c", "b"], ["a", "a", "c"], []))


def test_windows_of_a_stream_end(spark, tmp_path):
    """Windows close behind the watermark; what comes for a closed one is left out."""
    d = Detection(window_s=20, interval_s=10, max_lag_s=5)
    schema = "ts_us bigint, method string, actionable_prefix string, candidate boolean, upstream_duration_us bigint"
    src, out = tmp_path / "in", []
    src.mkdir()
    stream = live.windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*")), d)
    for i, times in enumerate(((10, 12), (100,), (11, 101), (300,))):
        spark.createDataFrame([(t * 1_000_000, "GET", "/a/", True, 5) for t in times], schema).coalesce(1).write.parquet(str(src / f"p{i}"))
        run = stream.writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert sorted((x[0] // 1_000_000, x[3]) for x in out) == [(10, 1), (20, 2), (30, 1), (100, 1), (110, 2), (120, 1)]


def test_robots_text():
    rules = probes.parse_robots("User-agent: a\nUser-agent: b\nDisallow: /x # no\nAllow:\n\nUser-agent: *\nDisallow: /*.gif$")
    assert [(r.agent, r.allow, r.path) for r in rules] == [("a", False, "/x"), ("b", False, "/x"), ("*", False, "/*.gif$")]


def test_rule_state_in_a_stream(spark, tmp_path):
    """Refresh, capacity, and the end of a quiet site's rule by the time of another site's evaluations."""
    d = Detection(ttl_s=60, max_rules=1)
    src, out = tmp_path / "in", []
    schema = "site string, eval_us bigint, method string, path_prefix string"
    steps = [[("s", 1, "GET", "/a"), ("s", 1, "GET", "/b")], [("s", 2, "GET", "/a"), ("s", 2, "GET", "/b")], [("s", 2, "GET", "/c")], [("t", 200, "GET", "/z")], [("t", 201, "GET", "/z")]]
    seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    src.mkdir()
    start = lambda: live.rules(seen, d).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    for i, rows in enumerate(steps):
        spark.createDataFrame([(s, t * 1_000_000, m, p) for s, t, m, p in rows], schema).coalesce(1).write.parquet(str(src / f"p{i}"))
        start().awaitTermination(120)
    assert sorted((x[:3] for x in out if x[1] in ("/a", "/b", "/c"))) == [("GET", "/a", "activated"), ("GET", "/a", "expired"), ("GET", "/a", "refreshed"), ("GET", "/b", "capacity"), ("GET", "/b", "capacity")]
    assert [x[2] for x in out if x[1] == "/z"] == ["activated", "refreshed"]


def test_when_rules_are_handed_on(spark):
    rows = [("s", t * 1_000_000, n, removed, changed) for t, n, removed, changed in ((10, 0, False, False), (20, 1, False, True), (30, 2, False, True), (40, 2, False, False), (60, 2, False, False), (70, 1, True, True), (75, 1, False, False))]
    got = live.applied(spark.createDataFrame(rows, "site string, eval_us bigint, n_rules int, removed boolean, changed boolean"), 30).orderBy("eval_us").collect()
    assert [(r["apply_required"], r["apply_now"]) for r in got] == [(False, False), (True, True), (True, False), (True, False), (True, True), (True, True), (False, False)]


def test_state_and_evaluation_times():
    d = Detection(interval_s=10)
    assert live.state_folder("/cp", "a", "b") == live.state_folder("/cp", "a", "b") != live.state_folder("/cp", "ab", "")
    assert [live.evaluation_time(t, last, d) for t, last in ((25_000_000, 0), (29_999_999, 20_000_000), (30_000_000, 20_000_000), (5, 0))] == [20_000_000, None, 30_000_000, None]
