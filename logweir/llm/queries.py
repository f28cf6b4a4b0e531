"""The opN_ queries: each applies one operator to its whole table and derives the digest columns asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from .alignment import align_tokens
from .common import WORD, crc, table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language import identify_language
from .licenses import scan_licenses
from .merkle import merkle_manifest, tampered
from .near_dedup import near_dedup
from .packing import pack_documents
from .quality import quality_scores, row_id
from .secrets import scan_secrets
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .url_filter import url_filter


def op1_exact_dedup(spark, sf_dir):
    out = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_secrets(spark, sf_dir):
    out = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_quality(spark, sf_dir):
    fold = lambda c: crc(c) % 4 == 2
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~fold(row_id()))
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    out = scan_licenses(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score", "spans")


def op7_language(spark, sf_dir):
    fold = crc(F.col("doc_id")) % 5 == 0
    out = identify_language(table(spark, sf_dir, "documents"), train=~fold)
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op9_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest(table(spark, sf_dir, "documents"), now=tampered()).drop("proof")


def op13_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_secrets, op4_quality, op5_best_fit_packing, op6_license_scan, op7_language, op8_decontaminate, op9_near_dedup, op10_url_filter, op11_substring_dedup, op12_merkle_manifest, op13_alignment)}

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '{WORD}')"
#: The pattern rules written once more by hand, by where they hold: words of a host, names in it, and paths.
_PATTERNS = "(?is)" + "|".join((
    "^([^/]*[^a-z0-9/])?(spam|farm|link[^a-z0-9]farm|pills|cheap[^a-z0-9]pharmacy|casino|poker|betting|payday[^a-z0-9]loans|replica[^a-z0-9]watches|adult|xxx|porn|escort|warez|torrents|keygen|doorway)([^a-z0-9]|$)",
    "^([^/]*[.])?((ads|ad|adserver|banner|tracker|tracking|analytics|pixel)([^a-z0-9]|$)|click[^a-z0-9]track)",
    "/(login|log-in|signin|sign-in|logout|register|password[^a-z0-9]reset|cart|checkout|wp-login[.]php|search[^a-z0-9]results|share[^a-z0-9]facebook|cookie[^a-z0-9]consent|404)([^a-z0-9]|$)",
    "/(wp-admin/|cgi-bin/|tag/.*/page/|print[^a-z0-9].*[^a-z0-9]version([^a-z0-9]|$))",
))

#: SQL twins. The others learn, tokenise, or need components, running positions or bounded errors: their tests hold
#: them against plain versions.
ORACLE: dict[str, str] = {
    "op1_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
hit AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, n, s, w[s:s + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)) JOIN win USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op10_url_filter": f"""WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOW}) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/' WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/' WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL OR regexp_matches(host || path, '{_PATTERNS}') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
