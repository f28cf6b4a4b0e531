"""Best-fit packing of documents into token sequences, improved by a swap-based local search."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Pieces that are packed together; the number of such groups grows with the data.
GROUP_PIECES = 8192


def vocabulary_path() -> str:
    """The tokenizer whose ids count."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    """The same vocabulary in the form that the faster encoder reads."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, as the tokenizer at `path` gives them without adding any of its
    own.

    Texts without one of the tokenizer's special strings go through a faster encoder of the same vocabulary (`ranks`), whole: a memory
    of words' ids costs more than it saves where many words are rare."""

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.coder.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.whole(text)


@cache
def _encoder(path: str, ranks: str, pattern: str) -> ByteEncoder:
    """Loaded once for all tasks of a worker."""
    return ByteEncoder(path, ranks, pattern)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, ranks: str, pattern: str, capacity: int, with_ids: bool) -> DataFrame:
    """Documents as pieces of at most `capacity` ids: _id, piece, start, length, ids_crc32 and, if asked for, ids.

    Each document ends with id 0. Only longer ones are cut; all pieces but the first are full."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, ranks, pattern)
        for batch in batches:
            out = []
            for i, text in zip(batch["_id"].tolist(), batch["_text"].tolist(), strict=True):
                ids = encoder.encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                at, to, piece = 0, n % capacity or min(n, capacity), 0
                while at < n:
                    part = ids[4 * at : 4 * to]
                    out.append((i, piece, at, to - at, zlib.crc32(part), *((part,) if with_ids else ())))
                    at, to, piece = to, to + capacity, piece + 1
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return base.mapInPandas(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of places in `lengths`. Open bins stand by their room in one bit mask, so the
    tightest room that is wide enough is found without a search."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        wide = mask >> n
        if wide:
            room = n + (wide & -wide).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        room -= n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty the least filled bins, one after another, by exchanges with other underfull bins.

    An exchange moves one document, or swaps one for one or two for one, such that the fuller bin gains: the sum of
    squared fills strictly increases, so the search ends. Of all exchanges with a bin, the one that fills it most is
    made. A bin that can't be emptied is set aside until another exchange is made. It ends when no exchange is left or
    when what is left open is less than one bin."""
    full = [b for b in bins if sum(lengths[k] for k in b) == capacity]
    open_ = [sorted((lengths[k], k) for k in b) for b in bins if sum(lengths[k] for k in b) < capacity]
    fill = [sum(n for n, _ in b) for b in open_]
    alive = set(range(len(open_)))

    def exchange(a: int, b: int) -> bool:
        """Let bin b gain from bin a as much as one exchange can."""
        room, own, other = capacity - fill[b], open_[a], open_[b]
        best, what = 0, None
        singles = [(n, (x,)) for x, (n, _) in enumerate(own)]
        doubles = [(own[x][0] + own[y][0], (x, y)) for x in range(len(own)) for y in range(x)]
        for n, xs in singles + doubles:
            if len(xs) == 1 and n <= room and n > best:
                best, what = n, (xs, None)
            y = bisect_left(other, (n - room, -1))  # smallest document of b whose place makes enough room
            if y < len(other) and 0 < (gain := n - other[y][0]) <= room and gain > best:
                best, what = gain, (xs, y)
        if what is None or fill[b] + best <= fill[a]:
            return False
        xs, y = what
        moved = [own[x] for x in xs]
        back = other.pop(y) if y is not None else None
        for x in sorted(xs, reverse=True):
            own.pop(x)
        for d in moved:
            insort(other, d)
        if back:
            insort(own, back)
        fill[b] += best
        fill[a] -= best
        return True

    aside: set[int] = set()  # bins from which no other one gains, as things stand
    while len(alive) > 1 and alive - aside and sum(capacity - fill[b] for b in alive) >= capacity:
        a = min(alive - aside, key=lambda b: (fill[b], b))
        aside.add(a)
        # fuller bins first; a bin that is full by now takes no more part
        for b in sorted(alive - {a}, key=lambda b: (-fill[b], b)):
            while fill[a] and fill[b] < capacity and exchange(a, b):
                aside.clear()
            if not fill[a]:
                break
        if not fill[a]:
            alive.discard(a)
            aside.discard(a)
    return full + [[k for _, k in open_[b]] for b in sorted(alive)]


def _pack_group(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["_id", "piece", "start"], kind="stable", ignore_index=True)
        lengths = [int(n) for n in pieces["length"]]
        sequence, offset = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        group = int(pieces["_group"].iloc[0]) << 32 if len(pieces) else 0
        for s, ks in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for k in ks:
                sequence[k], offset[k] = group + s, at
                at += lengths[k]
        return pieces.drop(columns="_group").assign(sequence_id=sequence, offset=offset)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None, ranks: str | None = None, pattern: str | None = None, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """One row for each piece: the id column, piece, start, length, ids_crc32, [ids,] sequence_id and offset.

    Every document has at least the id 0 at its end, so a null or empty text is a piece of length 1. An empty table
    gives no rows. Rows that share an id are packed as documents of their own; further columns are ignored. Ids are
    those of the tokenizer in the file `path`, to whose special tokens their strings in a text belong.

    Pieces are dealt by hash into groups of about `group_pieces`, each packed in a task of its own: memory stays the
    same at any size, one very long document spreads over many groups, and each group wastes less than a bin or two
    of some thousands."""
    path, ranks, pattern = path or vocabulary_path(), ranks or ranks_path(), pattern or split_pattern()
    pieces = staged(token_pieces(docs, id_col, text_col, path, ranks, pattern, capacity, with_ids), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "piece"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return grouped.groupBy("_group").applyInPandas(_pack_group(capacity), schema).withColumnRenamed("_id", id_col)
