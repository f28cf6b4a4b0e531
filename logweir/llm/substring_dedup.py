"""Removal of passages that stand in an earlier document, found by fixed-block anchors.

A passage of `size` words that two documents share holds a whole block of the earlier one, if blocks of half that length
lie side by side there. So the blocks are indexed, every rolling window of a block's length probes them, and hits are
extended to whole passages:

- index and probes meet by the smallest gram of a block or window. Neighbouring windows that have the same smallest gram
  probe together, as one row for about ten words,
- a window of `size` words around a hit is removed when an equal one starts in a document with a smaller id; neighbouring
  ones together are the maximal repeat. Of the windows that meet in a task only those of the smallest id go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bucketed, salted_lookup, staged
from .rolling import Hashed, covered, ints, leftmost_minima, packed, runs, unpacked

#: Rows that are looked through for repeats before they are shuffled.
LOCAL_ROWS = 1_000_000
#: Keys of texts with hits are broadcast up to this many (8 bytes each); beyond it texts are shuffled to them.
BROADCAST_KEYS = 1_000_000

#: state of a row: alone so far; stands for its hash in the task, where others have it too; one of those others.
ALONE, FIRST, MORE = range(3)


class _Words:
    """Words of a text, joined by single spaces, with hashes of any run of them."""

    def __init__(self, text: str):
        self.joined = b" ".join(text.encode("utf-8", "surrogatepass").split())
        gaps = np.flatnonzero(np.frombuffer(self.joined, dtype=np.uint8) == 32)
        some = self.joined[:1]  # without words there is no first start and no last end
        self.start, self.end = np.append([0] * len(some), gaps + 1).astype(np.int64), np.append(gaps, [len(self.joined)] * len(some)).astype(np.int64)
        self.n = len(self.start)

    def hashes(self, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the `size` words from each of the places `at`, or from all."""
        at = np.arange(max(0, self.n - size + 1)) if at is None else at
        return Hashed(self.joined).at(self.start[at], self.end[at + size - 1])


class Shape:
    """Lengths in words: blocks of half a passage, and grams of a third of a block that stand for them."""

    def __init__(self, size: int):
        if not 8 <= size < 2048:
            raise ValueError("passages of 8 to 2047 words")
        self.size, self.block = size, (size + 1) // 2
        self.gram = max(1, self.block // 3)
        self.width = self.block - self.gram + 1


def _probes(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray] | None:
    """Smallest grams of all windows, each with the first window that has it, how many have it, and whether one of them is
    a block."""
    words = _Words(text)
    if words.n < shape.size:
        return None
    grams = words.hashes(shape.gram)
    at, first, n = np.unique(leftmost_minima(grams, shape.width), return_index=True, return_counts=True)
    block = -(-first // shape.block) * shape.block < first + n
    return grams[at], (first << 12) | (n << 1) | block


def _met(h: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """Probes of a task by their gram; one of each gram tells the others whether a block has it, too."""
    order = np.lexsort((pos, key, h))
    h, key, pos = h[order], key[order], pos[order]
    new = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1]))  # copies of a text count once
    h, key, pos = h[new], key[new], pos[new]
    first = np.append(True, h[1:] != h[:-1])
    more = np.append(~first[1:], False)
    block = np.maximum.reduceat(pos & 1, np.flatnonzero(first))[np.cumsum(first) - 1]
    state = np.where(first, np.where(more, FIRST, ALONE), MORE)
    return pd.DataFrame({"hash": h.view(np.int64), "key": key, "pos": pos, "state": state.astype(np.int8), "block": block.astype(np.int8)})


def _hits(base: DataFrame, shape: Shape) -> DataFrame:
    """(key, hits): runs of windows whose smallest gram a block has and another place, too; staged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for key, text in zip(batch["key"].tolist(), batch["text"].tolist(), strict=True):
                if found := _probes(text, shape):
                    held.append((found[0], np.full(len(found[0]), key, dtype=np.int64), found[1]))
                    n += len(found[0])
            if n >= LOCAL_ROWS:
                yield _met(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield _met(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = staged(base.mapInPandas(run, "hash bigint, key bigint, pos bigint, state tinyint, block tinyint"), "probes")
    by_hash, place = Window.partitionBy("hash"), F.struct("key", "pos")
    one = rows.where(f"state <= {FIRST}").withColumn("a", F.min(place).over(by_hash)).withColumn("z", F.max(place).over(by_hash)).withColumn("b", F.max("block").over(by_hash))
    found = rows.where(f"state = {MORE}").select("key", "pos").union(one.where(f"b = 1 AND (a <> z OR state = {FIRST})").select("key", "pos"))
    return staged(found.groupBy("key").agg(F.collect_set("pos").alias("hits")), "hits")


def _around(hits, shape: Shape, n: int) -> np.ndarray:
    """Starts of the passages that hold a window of one of the hits."""
    hits = ints(hits)
    first, count = hits >> 12, (hits >> 1) & 0x7FF
    return np.flatnonzero(covered(first + shape.block - shape.size, first + count, n - shape.size + 1))


def _smallest(h: np.ndarray, key: np.ndarray, pos: np.ndarray, low: np.ndarray) -> pd.DataFrame:
    """Passages of a task: those of the smallest id that has their hash go on with it; the others are settled, as runs."""
    order = np.lexsort((low, h))
    h, key, pos, low = h[order], key[order], pos[order], low[order]
    first = np.append(True, h[1:] != h[:-1])
    open_ = low == low[np.flatnonzero(first)][np.cumsum(first) - 1]
    k, p = key[~open_], pos[~open_]
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)) if len(k) else np.zeros(0, dtype=bool)
    last = np.append(np.flatnonzero(new)[1:], len(k)) - 1 if len(k) else np.zeros(0, dtype=np.int64)
    settled = pd.DataFrame({"hash": 0, "key": k[new], "pos": packed(p[new], p[last] + 1), "low": pd.array([None] * int(new.sum()), dtype="Int64")})
    still = pd.DataFrame({"hash": h[open_].view(np.int64), "key": key[open_], "pos": packed(pos[open_], pos[open_] + 1), "low": pd.array(low[open_], dtype="Int64")})
    return pd.concat([still, settled])


def _repeats(texts: DataFrame, shape: Shape) -> DataFrame:
    """(key, gone): runs of starts of passages that start in a document with a smaller id, too; staged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for key, text, hits, low in zip(*(batch[c].tolist() for c in ("key", "text", "hits", "low")), strict=True):
                words = _Words(text)
                at = _around(hits, shape, words.n)
                held.append((words.hashes(shape.size, at), np.full(len(at), key, dtype=np.int64), at, np.full(len(at), low, dtype=np.int64)))
                n += len(at)
            if n >= LOCAL_ROWS:
                yield _smallest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield _smallest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = staged(texts.select("key", "text", "hits", "low").mapInPandas(run, "hash bigint, key bigint, pos bigint, low bigint"), "passages")
    later = rows.where("low IS NOT NULL").withColumn("a", F.min("low").over(Window.partitionBy("hash"))).where("low > a")
    found = rows.where("low IS NULL").select("key", "pos").union(later.select("key", "pos"))
    return staged(found.groupBy("key").agg(F.collect_set("pos").alias("gone")), "gone")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, with_text: bool = False) -> DataFrame:
    """One row for each input row: the id column, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)
    and, if asked for, kept and spans (start and end of the removed runs, in words).

    Words are separated by ASCII white space and otherwise unchanged. A word is removed when `size` consecutive words
    that cover it also start in a document with a smaller id; passages never cross documents and are judged on the
    input. Ids are integers. Null and empty texts have no words; documents of fewer than `size` words stay whole. Rows
    that repeat, and different texts under one id, are not earlier than each other, so none is removed for the other. A
    null id is neither smaller nor larger than any: its row stays whole and removes nothing. Very long texts are one
    text each; an empty table gives no rows; further columns are ignored. Passages and texts count as equal when 64-bit
    hashes agree.

    Copies of a text are one text with the smallest of their ids; the others go whole. A passage that a third of all
    documents hold meets in one task as a row for each task and word."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    shape, spark = Shape(size), docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x.encode("utf-8", "surrogatepass").split() for x in batch["text"].tolist()]
            kept = [b" ".join(x) for x in found]
            out = {"_id": batch["_id"], "key": batch["key"], "n_words": [len(x) for x in found], "_sha": [hashlib.sha256(x).hexdigest() for x in kept]}
            yield pd.DataFrame(out | ({"_kept": [x.decode("utf-8", "surrogatepass") for x in kept]} if with_text else {}))

    whole = staged(base.mapInPandas(digests, "_id bigint, key bigint, n_words bigint, _sha string" + ", _kept string" * with_text), "digests")
    owners = whole.where("_id IS NOT NULL").groupBy("key").agg(F.min("_id").alias("low"), F.max("_id").alias("_high"))
    hits = _hits(base.select("key", "text"), shape).join(owners.select("key", "low"), "key")
    hits = staged(hits, "owned")
    keys = hits.select("key")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = base.select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"])
    texts = bucketed(texts, "key", int(spark.conf.get("spark.sql.shuffle.partitions")))
    gone = _repeats(texts.join(hits, "key"), shape)
    schema = "key bigint, n_removed bigint, kept_sha256 string" + ", kept string, spans array<struct<start:bigint,end:bigint>>" * with_text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, found in zip(*(batch[c].tolist() for c in ("key", "text", "gone")), strict=True):
                words = np.array(text.encode("utf-8", "surrogatepass").split(), dtype=object)
                start, end = unpacked(found)
                mask = covered(start, end + size - 1, len(words))
                kept = b" ".join(words[~mask])
                row = (key, int(mask.sum()), hashlib.sha256(kept).hexdigest())
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(*runs(mask), strict=True)] if with_text else None
                out.append(row + ((kept.decode("utf-8", "surrogatepass"), spans) if with_text else ()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    cuts = texts.join(gone, "key").select("key", "text", "gone").mapInPandas(cut, schema)
    info = staged(cuts.join(owners.where("low < _high").select("key", "low"), "key", "full"), "cuts")
    out = salted_lookup(whole, info, "key", "_id")
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    n, known = F.col("n_words"), F.col("_id").isNotNull()
    copy = F.coalesce(F.col("_id") > F.col("low"), F.lit(False)) & (n >= size)
    cols = {
        "n_removed": F.when(copy, n).when(known, F.coalesce("n_removed", zero)).otherwise(zero),
        "kept_sha256": F.when(copy, none).when(known, F.coalesce("kept_sha256", "_sha")).otherwise(F.col("_sha")),
    }
    if with_text:
        one = F.array(F.struct(zero.alias("start"), n.alias("end")))
        cols["kept"] = F.when(copy, F.lit("")).when(known, F.coalesce("kept", "_kept")).otherwise(F.col("_kept"))
        cols["spans"] = F.when(copy, one).when(known & F.col("spans").isNotNull(), F.col("spans")).otherwise(F.slice(one, 1, 0))
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", *(c.alias(k) for k, c in cols.items()))
