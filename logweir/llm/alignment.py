"""Alignment of two tokenizers' tokens by interval coalescing, and how often their ids are linked in the corpus.

Texts are cut into segments where both tokenizers must begin a token: before a space that follows no white space. All
tokens of the new segments of a stretch of texts are laid on one line and coalesced in one pass; a worker remembers the
segments that it has seen. Links of a document leave it as distinct id pairs with counts. How many documents hold a pair
is a sum with partial sums; the most frequent pairs come back in a broadcast of bounded size, the others in a shuffle in
which no pair has many rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: An id pair is one number: the id of A, shifted, and the id of B.
SHIFT = 15
#: Pairs that come back in a broadcast, at most (about 100 bytes each); the others are joined in a shuffle.
HEADS = 1_000_000
#: Segments that a worker remembers, and characters of texts that it takes up together.
CACHE_SEGMENTS, STRETCH = 250_000, 2_000_000

_CUT = re.compile(r"(?<=[^\s\u180e])(?= )")


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two tokenizers: A as JSON, the same vocabulary as ranks with its pattern, and B as a sentencepiece model."""

    a: str
    a_ranks: str
    a_pattern: str
    b: str


def installed() -> Tokenizers:
    import public_tokenizers as p

    return Tokenizers(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model"))


#: What is known of a segment: n_a, n_b, n_groups, its groups with a ";" behind each, its links as packed id pairs, and
#: whether the tokens give it back byte for byte.
Segment = tuple[int, int, int, str, bytes, bool]


def coalesce(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the lengths of tokens that cover the same line: the group of each A and of each B token, and which A and which B
    token of each link, in the order of A and then of B.

    All intervals are sorted by start; a group begins where a start reaches the largest end so far."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    start, end = np.concatenate([end_a - len_a, end_b - len_b]), np.concatenate([end_a, end_b])
    side = np.repeat([0, 1], [len(len_a), len(len_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(start), dtype=np.int64)
    group[order] = np.cumsum(np.append(False, start[order][1:] >= reach[:-1])) if len(start) else []
    low = np.searchsorted(end_b, end_a - len_a, side="right")
    many = np.searchsorted(end_b - len_b, end_a, side="left") - low
    link_a = np.repeat(np.arange(len(len_a)), many)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + low[link_a]
    return group[: len(len_a)], group[len(len_a) :], link_a, link_b


class Aligner(dict):
    """Aligned segments of texts by the segment's string, which begins with the space that stands before the text."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(files.a_ranks, "rb") as f:
            ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("local", pat_str=files.a_pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(files.a)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        of_b = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.bytes_a, self.bytes_b = np.full(max(ranks.values()) + 1, b"", dtype=object), np.array(of_b, dtype=object)
        for x, i in ranks.items():
            self.bytes_a[i] = x
        self.size_a, self.size_b = (np.array([len(x) for x in xs]) for xs in (self.bytes_a, self.bytes_b))
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.shown = np.array([[f"{i}{mark}" for i in ids] for mark in ",|;"], dtype=object)
        self.space = self.pieces.piece_to_id("▁")
        #: no piece goes on past a space that follows other characters, so texts may be cut there
        self.cut = not any(re.search("[^▁]▁", x) for x in names)

    def segments(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.cut else [" " + text]

    def ids_a(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and how many each segment has. Segments without white space at their end are encoded as one text: A begins
        a token at the space that the next one begins with."""
        plain, out = [k for k, x in enumerate(new) if not x[-1].isspace() and not any(t in x for t in self.special)], {}
        ids = np.array(self.coder.encode_ordinary("".join([new[k] for k in plain])), dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.size_a[ids]), np.cumsum([len(new[k].encode()) for k in plain])) + 1
        if len(plain) == len(new):
            return ids, np.diff(ends, prepend=0)
        out = dict(zip(plain, np.split(ids, ends[:-1]), strict=True)) if plain else {}
        for k, x in enumerate(new):
            if k not in out:
                out[k] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype=np.int64)
        each = [out[k] for k in range(len(new))]
        return np.concatenate(each), np.array([len(x) for x in each])

    def ids_b(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [x or [self.space] for x in self.pieces.encode([x[1:] for x in new], num_threads=1)]  # nothing is put before an empty string
        n = np.array([len(x) for x in each])
        return np.fromiter(chain.from_iterable(each), dtype=np.int64, count=int(n.sum())), n

    def learn(self, new: list[str]) -> None:
        """Align the segments `new`, all in one pass, and remember them."""
        all_a, n_a = self.ids_a(new)
        all_b, n_b = self.ids_b(new)
        if b"".join(self.bytes_a[all_a]) != "".join(new).encode() or b"".join(self.bytes_b[all_b]) != "".join(new).encode():
            to_a, to_b = np.cumsum(n_a)[:-1], np.cumsum(n_b)[:-1]
            each = zip(new, np.split(all_a, to_a), np.split(all_b, to_b), strict=True)
            good = np.array([b"".join(self.bytes_a[i]) == x.encode() == b"".join(self.bytes_b[j]) for x, i, j in each])
            self.update((x, (0, 0, 0, "", b"", False)) for x, ok in zip(new, good, strict=True) if not ok)
            new = [x for x, ok in zip(new, good, strict=True) if ok]
            all_a, all_b, n_a, n_b = all_a[np.repeat(good, n_a)], all_b[np.repeat(good, n_b)], n_a[good], n_b[good]
        if not new:
            return
        of_a, of_b, link_a, link_b = coalesce(self.size_a[all_a], self.size_b[all_b])
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        links = ((all_a[link_a] << SHIFT) | all_b[link_b]).astype(np.int32).tobytes()
        ids, of, side = np.concatenate([all_a, all_b]), np.concatenate([of_a, of_b]), np.repeat([0, 1], [len(all_a), len(all_b)])
        order = np.lexsort((side, of))  # stable: ids of a side stay in order
        last = np.append((of[order][1:] != of[order][:-1]) | (side[order][1:] != side[order][:-1]), True)
        shown = self.shown[np.where(last, side[order] + 1, 0), ids[order]].tolist()
        to_link, to_group = np.searchsorted(link_a, to_a) * 4, of_a[to_a - 1] + 1
        i = j = g = k = 0
        for x, i2, j2, g2, k2 in zip(new, to_a.tolist(), to_b.tolist(), to_group.tolist(), to_link.tolist(), strict=True):
            self[x] = (i2 - i, j2 - j, g2 - g, "".join(shown[i + j : i2 + j2]), links[k:k2], True)
            i, j, g, k = i2, j2, g2, k2

    def align(self, texts: list[str]) -> Iterator[list[Segment]]:
        """Segments of each text; none for a text that is empty or that the tokenizers don't give back byte for byte."""
        cut = [self.segments(x) if x else [] for x in texts]
        every = set(chain.from_iterable(cut))
        new = sorted(every.difference(self))
        if len(self) + len(new) > CACHE_SEGMENTS:
            self.clear()
            new = sorted(every)
        if new:
            self.learn(new)
        for x in cut:
            of = [self[s] for s in x]
            yield of if all([s[5] for s in of]) else []
        for s in new:
            if len(s) >= 64:
                del self[s]


@lru_cache(maxsize=1)
def aligner(files: Tokenizers) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(files)


def token_links(docs: DataFrame, id_col: str, text_col: str, files: Tokenizers, with_groups: bool) -> DataFrame:
    """One row for each document: _id, n_a, n_b, n_groups, n_links, groups_sha256, maybe groups, and its distinct pairs with
    how often it has them."""
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string" + ", groups string" * with_groups + ", pairs array<int>, times array<int>"

    def rows(ids: list, texts: list[str]) -> pd.DataFrame:
        out = []
        for i, found in zip(ids, aligner(files).align(texts), strict=True):
            n_a, n_b, n_groups, parts, packed, _ = zip(*found, strict=True) if found else ((), (), (), (), (), ())
            groups, links = "".join(parts)[:-1], np.frombuffer(b"".join(packed), dtype=np.int32)
            pairs, times = np.unique(links, return_counts=True)
            counts = (sum(n_a), sum(n_b), sum(n_groups), len(links))
            out.append((i, *counts, hashlib.sha256(groups.encode()).hexdigest() if found else "", *((groups,) if with_groups else ()), pairs, times.astype(np.int32)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, n = [], [], 0
            for i, text in zip(batch["_id"].tolist(), batch["_text"].tolist(), strict=True):
                ids.append(i)
                texts.append(text)
                n += len(text)
                if n >= STRETCH:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield rows(ids, texts)

    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return base.mapInPandas(run, schema)


def _heads(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, `most` at most, and the rest, if any. The bound between them is a power of two: beyond
    `most` pairs, each of the rest has a small share of all rows."""
    by_power = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()  # at most 63 rows
    total, least = 0, None
    for k, n in sorted(by_power, reverse=True):
        total += n
        if total > most:
            break
        least = k
    if total <= most:
        return counts, None
    bound = F.lit(2).cast("long") ** least if least is not None else F.lit(float("inf"))
    return counts.where(F.col("count") >= bound), counts.where(F.col("count") < bound)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: Tokenizers | None = None, with_groups: bool = False, heads: int = HEADS) -> DataFrame:
    """One row for each input row: the id column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked
    for, groups, as `a1,a2|b1;a3|b2,b3`.

    Both tokenizers read a space and the text, without special tokens. Offsets where tokens of both end cut them into
    groups; tokens that share a byte are linked. The count of an id pair is the number of rows that hold it linked;
    count_sum adds it up over a row's links, n_best counts the links whose count is the highest of their A id.

    Null and empty texts, and those that the tokens don't give back byte for byte, have no tokens: zeros and ''. Rows that
    repeat are documents each; pairs tied for the highest count are all best; null ids are ids like any other; very
    long texts are aligned whole; an empty table gives no rows; further columns are ignored."""
    links = token_links(docs, id_col, text_col, files or installed(), with_groups)
    links = staged(links.withColumn("_row", F.monotonically_increasing_id()), "links")
    each = links.select("_row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = staged(each.groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    counts = staged(counts.withColumn("best", F.col("count") == highest), "best")
    often, rest = _heads(counts, heads)
    sums = [F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    found = each.join(F.broadcast(often), "pair").groupBy("_row").agg(*sums)
    if rest is not None:
        found = found.union(each.join(rest, "pair").groupBy("_row").agg(*sums)).groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    out = links.drop("pairs", "times").join(found, "_row", "left")
    names = ["n_a", "n_b", "n_groups", "n_links"]
    return out.select(F.col("_id").alias(id_col), *names, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *(["groups"] if with_groups else []))
