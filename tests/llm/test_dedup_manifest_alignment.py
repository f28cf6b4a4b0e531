"""Substring dedup, Merkle manifests and tokenizer alignment against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import alignment, merkle, substring_dedup
from logweir.llm.alignment import align_tokens, coalesce
from logweir.llm.merkle import Branches, merkle_manifest, missing, tampered

from . import brute
from .test_operators import DOCS, prose


def held(df, expected, *by):
    key = lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in by)
    got, want = sorted((r.asDict(True) for r in df.collect()), key=key), sorted(expected, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert {k: g[k] for k in w} == w


def passages(seed, n=60):
    """Documents that share parts of a few passages, at odd places, with copies, shared and null ids."""
    rng = random.Random(seed)
    stock = [prose(rng, rng.randint(45, 160)).split() for _ in range(5)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(stock)
            a = rng.randint(0, len(x) - 1)
            parts += prose(rng, rng.randint(0, 30)).split() + x[a : a + rng.randint(1, 160)]
        out.append((i, rng.choice((" ", "\n", "\t \x0b")).join(parts)))
    out += [(100 + k, out[k][1]) for k in range(8)] + [(3, out[9][1]), (3, out[9][1]), (None, out[5][1]), (None, prose(rng, 80)), (-1, out[12][1]), (200, None), (201, ""), (202, " \n"), (203, "na " * 400), (204, "na " * 130)]
    return out


def table(spark, docs, schema="doc_id bigint, text string"):
    rows = [(*r, "junk", 7, True) for r in docs]
    return spark.createDataFrame(rows, schema + ", hash string, low int, kept boolean").repartition(3)


@pytest.mark.parametrize("size", [8, 50, 51])
def test_substrings(spark, monkeypatch, size):
    docs = passages(size) + ([(300 + i, t) for i, t in DOCS] if size == 50 else [])
    held(substring_dedup.substring_dedup(table(spark, docs), size=size).drop("hash"), brute.substrings(docs, size), "doc_id", "kept_sha256", "n_removed")
    monkeypatch.setattr(substring_dedup, "LOCAL_ROWS", 40)
    monkeypatch.setattr(substring_dedup, "BROADCAST_KEYS", 0)
    held(substring_dedup.substring_dedup(table(spark, docs), size=size), brute.substrings(docs, size), "doc_id", "kept_sha256", "n_removed")


def test_substrings_with_text(spark):
    docs = passages(2)
    rows = substring_dedup.substring_dedup(table(spark, docs), with_text=True).collect()
    for r in rows:
        assert brute.sha(r.kept) == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
        assert len(r.kept.split()) == r.n_words - r.n_removed
    assert any(len(r.spans) > 1 for r in rows)
    with pytest.raises(TypeError):
        substring_dedup.substring_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_hot_passage_is_a_row_a_task(spark):
    """A passage that most documents hold: each flush sends one row on for each of its windows."""
    rng = random.Random(1)
    shared = prose(rng, 90)
    docs = [(i, f"{prose(rng, 20)} {shared} {prose(rng, 20)}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    held(substring_dedup.substring_dedup(df), brute.substrings(docs), "doc_id")
    words = [substring_dedup._Words(t) for _, t in docs[:50]]
    at = [np.arange(w.n - 49) for w in words]
    keys = [np.full(len(a), i) for i, a in enumerate(at)]
    rows = substring_dedup._smallest(np.concatenate([w.hashes(50) for w in words]), np.concatenate(keys), np.concatenate(at), np.concatenate(keys))
    assert rows[rows.low.notna()].hash.value_counts().max() == 1


MERKLE = "doc_id bigint, source string, lang string, n_chars int, text string"


def manifest_rows(seed, n):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "é", "zz", *(f"x{k}" for k in range(10))]
    rows = [(i, rng.choice((None, "web", "é")), rng.choice(langs[: rng.choice((5, 16))]) if i % 2 else "en", rng.choice((None, i)), rng.choice((None, "", prose(rng, 9), f"ÄB {i}"))) for i in range(n)]
    return rows + rows[:9] + [(None, None, None, None, None), (None, "a", "en", 1, "B"), (1, "other", "en", 2, "C"), (5000, "s", "alone", 1, "T")]


@pytest.mark.parametrize(("n", "part"), [(700, 4096), (700, 37), (3, 2)])
def test_manifest(spark, monkeypatch, n, part):
    monkeypatch.setattr(merkle, "SLICE", part)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 1_000_000 if part == 37 else 0)
    rows = manifest_rows(n, n)
    out = merkle_manifest(table(spark, rows, MERKLE), now=tampered())
    held(out.drop("proof"), brute.merkle(rows), "doc_id", "leaf", "proof_sha256")
    some = merkle_manifest(table(spark, rows, MERKLE), prove=F.col("doc_id") % 5 == 2)
    want = [r | {"folded_root": r["root"], "verified": True} for r in brute.merkle(rows) if r["doc_id"] is not None and r["doc_id"] % 5 == 2]
    held(some, want, "doc_id", "leaf", "proof_sha256")


def test_octopus_is_minimal():
    """What is asked for is enough for the root, and nothing of it could be derived."""
    rng = random.Random(0)
    for n in (1, 2, 8, 9, 64, 65, 600):
        leaves = [brute.sha(str(i)) for i in range(n)]
        levels = brute._tree(leaves)
        for _ in range(10):
            known = sorted(rng.sample(range(n), rng.randint(1, min(n, 40))))
            asked = {(level, i) for level, places in missing(np.array(known), n) for i in places.tolist()}
            tree = Branches({i: leaves[i] for i in known}, n, {p: levels[p[0]][p[1]] for p in asked})
            assert tree.root == levels[-1][0] and not asked & {(level, i // 8**level) for i in known for level in range(9)}
            if asked:
                with pytest.raises(KeyError):
                    Branches({i: leaves[i] for i in known}, n, {p: "" for p in asked - {rng.choice(sorted(asked))}})


ODD = ["<|endoftext|> and </s> <unk>", "tab\tand  two   spaces \n new\r\nline ", " lead", "a▁b", "▁", "日本語テキスト ①ﬁ é", "it's we'll 12345 !!! ...", "\x00nul \x1f x᠎ y　z\u0085 w", "émoji 👩‍👩‍👧 ok", "x" * 500, "   ", "{\r\n  a: 1;\r\n}", "ß" * 30 + " A" * 30]


def test_alignment(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, t) for i, t in DOCS if i != 9] + [(100 + i, t) for i, t in enumerate(ODD)] + [(7, "x y"), (None, "x y")]
    docs += [(200 + i, "".join(rng.choice(" \n\t .,'aáB1_▁"[: rng.choice((9, 13))]) for _ in range(60))) for i in range(30)]
    want = brute.alignment(docs)
    held(align_tokens(table(spark, docs)), want, "doc_id", "n_a", "groups_sha256")
    assert sum(r["n_a"] == 0 for r in want) < len(want) / 2
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 20)
    monkeypatch.setattr(alignment, "STRETCH", 300)
    for heads in (0, 30):
        held(align_tokens(table(spark, docs), heads=heads), want, "doc_id", "n_a", "groups_sha256")
    texts = align_tokens(table(spark, docs), with_groups=True).where("n_a > 0").collect()
    assert all(brute.sha(r.groups) == r.groups_sha256 and r.groups.count(";") + 1 == r.n_groups for r in texts)


def test_coalesce():
    of_a, of_b, a, b = coalesce(np.array([2, 3, 1, 4]), np.array([5, 2, 3]))
    assert of_a.tolist() == [0, 0, 1, 1] and of_b.tolist() == [0, 1, 1]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (3, 1), (3, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], MERKLE)
    assert substring_dedup.substring_dedup(empty).count() == merkle_manifest(empty).count() == align_tokens(empty).count() == 0


def test_large_paths_copy_no_keys(spark, monkeypatch):
    """Beyond broadcasts, a repeated key is copied to the salts that occur, and no key holds every document."""
    from logweir.llm import decontaminate as de
    from logweir.llm import exact_dedup as ex

    monkeypatch.setattr(ex, "BROADCAST_KEYS", 0)
    copied, of = [], ex.salt_of
    monkeypatch.setattr(ex, "salt_of", lambda c, n: copied.append(n) or of(c, n))
    rows = spark.createDataFrame([(i, "same") for i in range(6)] + [(9, "other")], "doc_id bigint, text string")
    found = ex._flagged(rows.select(F.col("doc_id").alias("_id"), F.length("text").alias("_len"), F.lit(True).alias("_in")), ["_len"], 256)
    assert found.where("_in").count() == 6 and copied and "explode" not in found._jdf.queryExecution().optimizedPlan().toString()

    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, item if i % 2 else "a b c d") for i in range(40)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    monkeypatch.setattr(de, "BROADCAST_WINDOWS", 0)
    shingles = de._window_shingles(de.item_windows(items, "item_id", "text", 10), 3).select("key", "k")
    plan = de._occurrences(docs, "doc_id", "text", [3], shingles, False)
    assert plan.where("at < 0").count() == 40 and plan.where("at >= 0").groupBy("key").count().agg({"count": "max"}).first()[0] == 20
    assert de.decontaminate(docs, items).where("contaminated").count() == 20
