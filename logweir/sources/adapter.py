"""Access-log records made from the tables `events` and `pages`, row by row, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.stage import spread

#: Paths that every so many events ask for instead of a page: (modulus, remainder 0) -> request target.
SPECIAL = (
    (97, "/.env"),
    (101, "/wp-login.php"),
    (103, "/a/../etc"),
    (107, "/.git/config"),
    (109, "/users/alice@example.test/archive/2026/42"),
    (113, "/items/550e8400-e29b-41d4-a716-446655440000"),
    (127, "/archive/2024/42"),
    (131, "/blob/0123456789abcdef0123"),
    (137, "/t/AbCdEfGhIjKlMnOpQrStUvWxYz"),
    (139, "/x%2Fy/z"),
    (149, "/a*b"),
    (151, "/q?a=%zz"),
    (157, "/bad%zz"),
    (163, "/caf%C3%A9/menu"),
    (167, "/list?b=2&a=1&a=3&weird%20key=1"),
    (173, "/s?x=${jndi:ldap}"),
    (179, "/pma/index.php"),
    (181, "/up/shell.php"),
)

AGENTS = (
    "GPTBot/1.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "Googlebot GPTBot",
    "Applebot-Extended/1.0",
    "NotGPTBotSuffix",
    "Mozilla/5.0 (X11; Linux x86_64)",
    "bingbot/2.0",
    "",
)

STATES = ("hit", "miss", "bypass", "expired", "stale", "unknown")


def records_sql(div: str, micros: str) -> str:
    """The adapter as SQL; the two dialects differ in integer division and in how a timestamp becomes microseconds."""
    special = " ".join(f"WHEN event_id % {m} = 0 THEN '{p}'" for m, p in SPECIAL)
    agents = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGENTS))
    states = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES))
    return f"""
SELECT event_id AS seq, {micros} AS ts_us,
  '10.0.' || CAST(user_id {div} 256 AS VARCHAR(9)) || '.' || CAST(user_id % 256 AS VARCHAR(9)) AS client_ip,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' WHEN event_type = 'error' AND k % 2 = 1 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE {special}
    WHEN event_type = 'click' AND page LIKE '%?%' THEN page || '&p=' || CAST(k AS VARCHAR(9))
    WHEN event_type = 'click' THEN page || '?p=' || CAST(k AS VARCHAR(9))
    ELSE page END AS request_uri,
  CAST(CASE WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 404 WHEN k < 70 THEN 403 WHEN k < 80 THEN 429 ELSE 500 END
    WHEN event_id % 101 = 0 OR event_id % 179 = 0 THEN 404 ELSE 200 END AS INT) AS status,
  CAST(floor(abs(value) * 100) AS BIGINT) AS bytes_sent,
  CAST(floor(abs(value) * 1000) AS BIGINT) AS request_duration_us,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(floor(abs(value) * 900) AS BIGINT) END AS upstream_duration_us,
  CASE k % 6 {states} END AS cache_state,
  CASE user_id % 8 {agents} END AS user_agent,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'https://Docs' || CAST(k % 4 AS VARCHAR(9)) || '.example/p' END AS referer
FROM (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, CAST(regexp_extract(e.props, '[0-9]+', 0) AS INT) AS k,
    regexp_replace(regexp_replace(p.url, '^[a-z]+://[^/]*', ''), '#.*$', '') AS page
  FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) c JOIN pages p ON p.page_id = e.event_id % c.n
) AS joined"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parsed record for each event: seq, ts_us, client_ip, method, request_uri, status, bytes_sent, both
    durations, cache_state, user_agent and referer."""
    events, pages = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("events", "pages"))
    sql = records_sql("div", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{", "{{").replace("}", "}}")
    # the number of pages as a column of the events: as a relation of its own it could be joined last, and a filter on the
    # target, which needs both tables, would have pages and events meet without a key before
    numbered = "(SELECT *, event_id % nullif((SELECT count(*) FROM {pages}), 0) AS page_no FROM {events}) e JOIN {pages} p ON p.page_id = e.page_no"
    sql = sql.replace("events e CROSS JOIN (SELECT count(*) AS n FROM pages) c JOIN pages p ON p.page_id = e.event_id % c.n", numbered)
    return spread(spark.sql(sql, events=events, pages=pages))


DUCKDB_RECORDS = records_sql("//", "epoch_us(ts)")
