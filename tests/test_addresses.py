"""Plain form of addresses, of clients and of referers, against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from logweir.functions.urls import canonical_ipv6, referer_host, segment_prefix
from logweir.sources.parsers import canonical_ip

ODD = [
    "::", "::1", "1::", "1::2", "::ffff:192.0.2.9", "::FFFF:c000:209", "0:0:0:0:0:ffff:1.2.3.4", "64:ff9b::198.51.100.7", "::1.2.3.4", "2001:DB8:0:0::A", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "0:1:0:1:0:1:0:1",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3::4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "::::", ":", "", ":1", "1:", "1:2:3:4:5:6:7:", ":1:2:3:4:5:6:7", "12345::", "g::", "::1%eth0", "fe80::1%25eth0",
    "::ffff:192.0.2.256", "::ffff:192.0.02.1", "::ffff:192.0.2", "::ffff:192.0.2.1.1", "192.0.2.1::", "::192.0.2.1:1", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::3:4:5:6:7:1.2.3.4", "::1\n", " ::1", "::٣", "0000::0001", "00000::1", "192.0.2.1", "192.0.02.1", "1.2.3", "host", None,
]


def plain(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return None if getattr(ip, "scope_id", None) else str(getattr(ip, "ipv4_mapped", None) or ip)


def made(n):
    rng = random.Random(8)
    for _ in range(n):
        groups = [0 if rng.random() < 0.55 else rng.choice([1, 0xFFFF, rng.randrange(1 << 16)]) for _ in range(8)]
        form = rng.choice(["{:x}", "{:X}", "{:04x}"])
        text = [form.format(g) for g in groups]
        if rng.random() < 0.5:
            a = rng.randrange(8)
            b = rng.randrange(a, 9)
            yield ":".join(text[:a]) + "::" + ":".join(text[b:])
        else:
            yield ":".join(text if rng.random() < 0.9 else text[: rng.randrange(9)])


def test_addresses_equal_the_standard_library(spark):
    texts = ODD + list(made(2000))
    rows = spark.createDataFrame([(x,) for x in texts], "ip string").select("ip", canonical_ip("ip").alias("any"), F.expr(canonical_ipv6("ip")).alias("v6")).collect()
    for r in rows:
        want = plain(r["ip"])
        assert r["any"] == want, r
        assert r["v6"] == (want if r["ip"] and ":" in r["ip"] else None), r


def test_referer_hosts(spark):
    cases = {
        "https://Docs.example/p": "docs.example", "http://192.0.2.1:80/": "192.0.2.1", "https://[2001:DB8::0:1]:8443/x?y": "2001:db8::1", "http://[::ffff:192.0.2.9]": "192.0.2.9", "http://[::1]#top": "::1", "HTTP://[::A]?q": "::a",
        "http://[fe80::1%25eth0]/": None, "http://[::1": None, "http://[::1]x/": None, "http://user@[::1]/": None, "http://[1::2::3]/": None, "ftp://[::1]/": None, "http://[]/": None, "-": None, "": None, None: None, "http://a@b.example/": None, "http://-a.example/": None,
        "http://[::1]:port/": None, "http://x.example/[::1]": "x.example",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "referer string").select("referer", F.expr(referer_host("referer")).alias("host")).collect()
    assert {r["referer"]: r["host"] for r in rows} == cases


def test_root_prefix_needs_an_actionable_path(spark):
    rows = spark.createDataFrame([("/a",), ("/",), (None,)], "p string").select("p", F.expr(f"coalesce({segment_prefix('p', '/')}, false)").alias("hit")).collect()
    assert [r["hit"] for r in rows] == [True, True, False]
