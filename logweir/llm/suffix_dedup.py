"""Removal of repeated byte strings by bucket-pointer refinement of locally chosen suffixes.

Full suffix sorting would shuffle a row for every byte. Here the suffixes that enter are anchors: in every window of
5/8 of the length asked for, the place of its smallest q-gram. They are the same wherever that window stands, so a string
can repeat only if all its anchors do. Initial buckets are those of the q-grams; they are refined by the bucket
identifiers of later offsets, never by the texts again, and each round takes only what the one before left and reuses
its identifiers:

- pairs: the bucket of an anchor and that of the next one, which together hold all bytes from the one to the other,
- stretches: the refined buckets from an anchor on for as long as the length asked for; one that stands elsewhere too
  settles all strings inside it, and of equal stretches only the first one takes part in later rounds,
- strings at the ends of stretches: by the refined bucket of their first anchor, where an open string has it,
- those strings themselves, for which alone texts are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, salted_lookup, staged
from .rolling import Hashed, chained, covered, ints, leftmost_minima, mix, packed, runs, unpacked

#: Rows that are looked through for repeats before they are shuffled.
LOCAL_ROWS = 1_000_000
#: Keys of texts with repeats are broadcast up to this many (8 bytes each); beyond it texts are shuffled.
BROADCAST_KEYS = 1_000_000

_ROW = "hash bigint, key bigint, pos bigint, state tinyint"

#: state of a row: alone so far; the first of its hash, which repeats in the same task (or is wanted); another one of it.
ALONE, FIRST, MORE = range(3)


class Shape:
    """Lengths that follow from that of the strings: every `window` bytes have an anchor, a gram of `q` bytes among
    `width` places. A string has `inner` windows more than one; grams of neighbouring anchors touch, since width <= q."""

    def __init__(self, size: int):
        if not 16 <= size < 4096:
            raise ValueError("strings of 16 to 4095 bytes")
        self.size, self.window = size, size * 5 // 8
        self.q = self.window // 2 + 1
        self.width = self.window + 1 - self.q
        self.inner = size - self.window


def _anchors(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a text's anchors, and their places with how far before them the first and last window that chooses
    them start."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) < shape.window:
        return None
    grams = Hashed(data).every(shape.q)
    chosen = leftmost_minima(grams, shape.width)
    at, first, n = np.unique(chosen, return_index=True, return_counts=True)
    return grams[at], (at << 24) | ((at - first) << 12) | (at - first - n + 1)


class _Chain:
    """What is known of a text's repeated anchors, without the text."""

    def __init__(self, at, bucket, shape: Shape):
        at, bucket = ints(at), ints(bucket).view(np.uint64)
        self.shape, self.bucket, self.at = shape, bucket, at >> 24
        self.lo, self.hi = self.at - ((at >> 12) & 0xFFF), self.at - (at & 0xFFF)
        gap = np.diff(self.at)
        self.near = gap <= shape.q
        self.pair = mix(bucket[:-1] + mix(bucket[1:] ^ gap.astype(np.uint64)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.pair[self.near], self.at[:-1][self.near]

    def links(self, pairs) -> np.ndarray:
        """Which anchors' pairs repeat."""
        return self.near & np.isin(self.at[:-1], ints(pairs))

    def stretches(self, pairs) -> tuple[np.ndarray, np.ndarray]:
        """From each anchor over repeated pairs: the shortest stretch that holds a string, and the one that holds all
        strings up to the next anchor's."""
        q, size, k = self.shape.q, self.shape.size, len(self.at)
        ok = self.links(pairs)
        last = np.minimum.accumulate(np.append(np.where(ok, k, np.arange(k - 1)), k - 1)[::-1])[::-1]
        i = np.flatnonzero(ok)
        j = np.concatenate([np.searchsorted(self.at, self.at[i] + size - q), np.searchsorted(self.at, self.at[i + 1] - 1 + size - q)])
        i = np.concatenate([i, i])
        keep = (j <= last[i]) & (j > i)
        pos, first = np.unique(packed(self.at[i[keep]], self.at[np.minimum(j[keep], k - 1)] + q), return_index=True)
        i, j = i[keep][first], j[keep][first]
        return chained(mix(self.pair + np.diff(self.at).astype(np.uint64)), i, j), pos

    def ends(self, pairs, stretches, firsts, copied: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of starts that share their string's first anchor and take part, by that anchor's pair; FIRST where one
        of them is open. Starts take part when all anchors of their string repeat and they lie in no stretch but in
        first ones; they are open when they lie in none. Of equal strings the first one takes part, and the first of
        those besides an open one: a stretch around it can't have an earlier equal."""
        shape, n = self.shape, int(self.hi[-1]) + 1
        ok = self.links(pairs)
        apart = ~covered(self.lo, self.hi + 1, n)
        broken = np.zeros(n, dtype=bool)
        broken[self.hi[:-1][~ok]] = True
        a, b = np.cumsum(np.append(0, apart)), np.cumsum(np.append(0, broken))
        m = n - shape.inner
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        s = np.arange(m)
        able = (a[s + shape.inner + 1] == a[s]) & (b[s + shape.inner] == b[s])

        def inside(packed: np.ndarray) -> np.ndarray:
            start, end = unpacked(packed)
            return covered(start, end - shape.size + 1, m)

        part = able & ~inside(np.setdiff1d(ints(stretches), ints(firsts)))
        open_ = part & ~inside(stretches) & (not copied)
        first = np.where(part, np.searchsorted(self.lo, s, side="right") - 1, -1)
        start = np.flatnonzero(np.append(True, first[1:] != first[:-1]) & (first >= 0))
        edge = np.flatnonzero(np.append(first[1:] != first[:-1], True) & (first >= 0)) + 1
        opens = np.cumsum(np.append(0, open_))
        state = np.where(opens[edge] > opens[start], FIRST, ALONE)
        return self.pair[first[start]], packed(start, edge), state


def _local_repeats(h: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((pos, key, h))
    h, key, pos = h[order], key[order], pos[order]
    new = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1]))  # copies of a text count once
    h, key, pos = h[new], key[new], pos[new]
    first = np.append(True, h[1:] != h[:-1])
    more = np.append(~first[1:], False)
    return _frame(h, key, pos, np.where(first, np.where(more, FIRST, ALONE), MORE))


def _frame(h: np.ndarray, key: np.ndarray, pos: np.ndarray, state: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"hash": h.astype(np.int64), "key": key, "pos": pos.astype(np.int64), "state": state.astype(np.int8)})


def _rows(df: DataFrame, of: Callable, name: str) -> DataFrame:
    """What `of` returns for each row of `df` (its key and further columns): hashes, places and maybe states; without
    states, repeats within the task are found out here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            given = []
            for key, *known in zip(batch["key"].tolist(), *(batch[c].tolist() for c in batch.columns if c != "key"), strict=True):
                h, pos, *state = of(*known) or ((), ())
                if len(h):
                    (given if state else held).append((h, np.full(len(h), key, dtype=np.int64), pos, *state))
                    n += 0 if state else len(h)
            if given:
                yield _frame(*(np.concatenate(x) for x in zip(*given, strict=True)))
            if n >= LOCAL_ROWS:
                yield _local_repeats(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield _local_repeats(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return staged(df.mapInPandas(run, _ROW), f"round-{name}")


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (hash, key, pos) whose hash stands at more than one place, and the first place of each such hash.

    Each task has found what repeats within it, so at most one row for a hash and LOCAL_ROWS rows is shuffled: a
    string that a third of all texts hold meets in one task as a few rows."""
    by_hash, place = Window.partitionBy("hash"), F.struct("key", "pos")
    met = rows.where(f"state <= {FIRST}").withColumn("a", F.min(place).over(by_hash)).withColumn("z", F.max(place).over(by_hash))
    found = rows.where(f"state IN ({FIRST}, {MORE})").select("hash", "key", "pos").union(met.where(f"a <> z and state = {ALONE}").select("hash", "key", "pos"))
    first = met.where(f"(a <> z or state = {FIRST}) and key = a.key and pos = a.pos")
    return found, first.select("key", "pos").distinct()


def _wanted(rows: DataFrame) -> DataFrame:
    """(key, pos) of rows whose hash some marked row has. Unmarked rows are distinct content, hence few for a hash."""
    marked = rows.where(f"state = {FIRST}")
    met = rows.where(f"state = {ALONE}").join(marked.select("hash").distinct(), "hash", "left_semi")
    return marked.select("key", "pos").union(met.select("key", "pos"))


def _lists(found: DataFrame, name: str, *cols: str) -> DataFrame:
    value = F.struct(*cols) if len(cols) > 1 else F.col("pos")
    return staged(found.groupBy("key").agg(F.array_sort(F.collect_set(value)).alias(name)), f"found-{name}")


def _bytes_covered(at, q: int):
    """How many bytes the grams at the sorted places `at` cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(acc, x):
        start = F.shiftright(x, 24)
        return F.struct((acc["n"] + start + q - F.greatest(acc["to"], start)).alias("n"), (start + q).alias("to"))

    return F.aggregate(at, zero, step, lambda acc: acc["n"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, with_text: bool = False) -> DataFrame:
    """One row for each input row: the id column, n_bytes, n_removed, n_spans, kept_sha256, n_repeated and, if asked for,
    kept (the remaining bytes) and spans (start and end of the removed runs).

    A byte is removed when a string of `size` bytes that covers it also starts anywhere else, in the same text or
    another one; strings never cross texts and are judged on the input. A null text counts as empty; texts shorter
    than `size` stay whole. Repeated rows repeat each other's strings: a text that other rows hold too goes whole. Very
    long texts are one text each, whatever their length; an empty table gives no rows; further columns are ignored. Two
    strings count as equal when 64-bit bucket identifiers agree. All occurrences are removed: none is kept as the first.

    n_repeated sees shorter repeats, too, and removes nothing: it counts the bytes of those grams of 5/16 of `size` that
    are chosen as anchors and stand anywhere else, and all bytes of repeated texts. A passage of 5/8 of `size` or more
    that repeats always has one; a repeat shorter than a gram never counts."""
    shape, spark = Shape(size), docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    data = F.col("text").cast("binary")
    whole = base.select("_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(data, 256).alias("_sha"), *([data.alias("_data")] if with_text else []))
    whole = whole if with_text else staged(whole, "digests")
    copies = staged(whole.select("key").groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.lit(True).alias("copied")), "copies")
    # initial buckets; copies of a text count as one text here
    rows = _rows(base.select("key", "text"), lambda t: _anchors(t, shape), "grams")
    known = _lists(_repeated(rows)[0], "anchors", "pos", "hash").select("key", F.col("anchors.pos").alias("at"), F.col("anchors.hash").alias("bucket"))
    rows = _rows(known, lambda at, bucket: _Chain(at, bucket, shape).pairs() if len(at) > 1 else None, "pairs")
    pairs = _lists(_repeated(rows)[0], "pairs")
    chains = staged(known.join(pairs, "key"), "chains")
    repeated, firsts = _repeated(_rows(chains, lambda at, bucket, p: _Chain(at, bucket, shape).stretches(p), "stretches"))
    repeated, firsts = _lists(repeated, "stretches"), _lists(firsts, "firsts")
    ends = chains.join(repeated, "key", "left").join(firsts, "key", "left").join(copies, "key", "left")
    of_ends = lambda at, bucket, p, s, r, c: _Chain(at, bucket, shape).ends(p, s, r, c is True)
    runs_left = _wanted(_rows(ends.select("key", "at", "bucket", "pairs", "stretches", "firsts", "copied"), of_ends, "ends"))
    runs_left = _lists(runs_left, "runs")

    keys = staged(repeated.select("key").union(runs_left.select("key")).distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = bucketed(base.select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"]), "key", int(spark.conf.get("spark.sql.shuffle.partitions")))

    def strings(text: str, left) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        at = np.flatnonzero(covered(*unpacked(left), len(data) - size + 1))
        return Hashed(data).at(at, at + size), at

    strings_found = _lists(_repeated(_rows(texts.join(runs_left, "key"), strings, "strings"))[0], "strings")
    schema = "key bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, spans array<struct<start:bigint,end:bigint>>" * with_text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, stretches, found in zip(*(batch[c].tolist() for c in ("key", "text", "stretches", "strings")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                (start, end), at = unpacked(stretches), ints(found)
                gone = covered(np.concatenate([start, at]), np.concatenate([end, at + size]), len(data))
                first, last = runs(gone)
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                row = (key, int(gone.sum()), len(first), hashlib.sha256(kept).hexdigest())
                out.append(row + ((kept, [{"start": int(x), "end": int(y)} for x, y in zip(first, last, strict=True)]) if with_text else ()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    touched = texts.join(repeated, "key", "left").join(strings_found, "key", "left").where("stretches IS NOT NULL OR strings IS NOT NULL")
    touched = touched.select("key", "text", "stretches", "strings").mapInPandas(cut, schema)
    measured = known.select("key", _bytes_covered(F.col("at"), shape.q).alias("_covered"))
    info = staged(touched.join(measured, "key", "full").join(copies, "key", "full"), "cuts")
    out = salted_lookup(whole, info, "key", "_id")
    n, all_gone = F.col("n_bytes"), F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_bytes") >= size)
    cols = {
        "n_removed": F.when(all_gone, n).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))),
        "n_spans": F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).cast("long"),
        "kept_sha256": F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "_sha")),
        "n_repeated": F.when(F.col("copied") & (n >= shape.window), n).otherwise(F.coalesce("_covered", F.lit(0).cast("long"))),
    }
    if with_text:
        one = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
        cols["kept"] = F.when(all_gone, F.lit(b"")).otherwise(F.coalesce("kept", "_data"))
        cols["spans"] = F.when(all_gone, one).otherwise(F.coalesce("spans", F.slice(one, 1, 0)))
    return out.select(F.col("_id").alias(id_col), "n_bytes", *(c.alias(k) for k, c in cols.items()))
