"""License scans: exact phrases, and short notices with a bounded number of errors found from exact seeds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int


#: Base phrases and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: The method's notices: lower-case words, and how many characters may be inserted, deleted or replaced.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mpl-2.0", "subject to the terms of the mozilla public license", 4),
    Notice("public-domain", "released into the public domain", 2),
    Notice("reserved", "all rights reserved", 1),
)

_SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """Cut into errors + 1 parts: with at most `errors` errors, one part at least stays exact (pigeonhole)."""
    k, n = notice.errors + 1, len(notice.text)
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeFinder:
    """Spans of notices in a text of single-spaced words."""

    def __init__(self, notices=NOTICES):
        import regex

        self.notices = [(n, seeds(n), regex.compile(f"(?b)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.errors}}}")) for n in notices]

    def find(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, errors, length of the notice) of matches that don't overlap: the one with the fewest errors,
        the leftmost of those, then the best of what is left before and behind it, until nothing matches.

        Each seed is searched for in its own window only, the notice's length and errors around it. A window's best match
        waits in a heap; what is left of a window beside a match that was taken is searched again, so the work is linear in
        the seeds, however many notices stand side by side."""
        out = []
        for notice, parts, pattern in self.notices:
            size, e = len(notice.text), notice.errors
            windows = set()
            for off, part in parts:
                at = text.find(part)
                while at >= 0:
                    windows.add((max(0, at - off - e), min(len(text), at - off + size + e)))
                    at = text.find(part, at + 1)
            waiting: list[tuple[int, int, int, int, int]] = []
            taken = _Taken(size)

            def search(a: int, b: int) -> None:
                if b - a >= size - e and (m := pattern.search(text, a, b)):  # noqa: B023
                    heapq.heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))  # noqa: B023

            for a, b in windows:
                search(a, b)
            while waiting:
                errors, start, end, a, b = heapq.heappop(waiting)
                if not taken.between(start, end):
                    taken.add(start, end)
                    out.append((start, end, notice.label, errors, size))
                for x, y in taken.between(a, b):
                    search(a, x)
                    a = y
                search(a, b)
        return sorted(out)


class _Taken:
    """Spans that don't overlap, by the cells of `size` characters that they touch."""

    def __init__(self, size: int):
        self.size, self.cells = size, {}

    def add(self, a: int, b: int) -> None:
        for cell in range(a // self.size, (b - 1) // self.size + 1):
            self.cells.setdefault(cell, []).append((a, b))

    def between(self, a: int, b: int) -> list[tuple[int, int]]:
        """Spans that overlap [a, b), by start."""
        near = {x for cell in range(a // self.size, (b - 1) // self.size + 1) for x in self.cells.get(cell, ())}
        return sorted((x, y) for x, y in near if x < b and y > a)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row for each input row: the id column, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (start, end in words, end exclusive; label; errors), labels sorted and distinct.

    Texts are lower-cased in A-Z and read as words; base phrases are counted at every place where their words stand
    consecutively. `notices` is the method's table, open to callers. A notice may differ by its number of errors and may span word ends. The score is 1 with a base
    phrase, else the largest 1 - errors / length of a notice, 0 without any. Null and empty texts have no words.
    Repeated rows are scanned alike, very long texts whole; an empty table gives no rows; further columns are ignored, and
    every row is judged by itself: no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, spans array<struct<start:bigint,end:bigint,label:string,errors:int>>"
    phrases = [(label, f" {p} ".encode()) for label, p in PHRASES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = NoticeFinder(notices)
        for batch in batches:
            out = []
            for i, text in zip(batch["_id"].tolist(), batch["_text"].tolist(), strict=True):
                found = text.encode("utf-8", "surrogatepass").translate(_SEPARATE).split()
                padded = b" " + b" ".join(found) + b" "
                places, base = [], set()
                for label, p in phrases:
                    at = padded.find(p)
                    while at >= 0:
                        places.append(at)
                        base.add(label)
                        at = padded.find(p, at + 1)
                gaps = np.flatnonzero(np.frombuffer(padded, dtype=np.uint8) == 32)
                places = np.searchsorted(gaps, places).tolist()  # spaces before a byte are words before it
                joined = padded.decode("utf-8", "surrogatepass")
                hits = finder.find(joined)
                gaps = gaps if len(joined) == len(padded) else np.flatnonzero(np.array([c == " " for c in joined])) if hits else gaps
                before = lambda at: int(np.searchsorted(gaps, at))  # noqa: E731, B023
                spans = [{"start": before(s + 1) - 1, "end": before(e), "label": x, "errors": k} for s, e, x, k, _ in hits]
                score = 1.0 if base else max((1 - k / n for *_, k, n in hits), default=0.0)
                labels = sorted(base | {x["label"] for x in spans})
                out.append((i, len(found), len(places), min(places, default=None), max(places, default=None), sorted(base), labels, score, spans))
            frame = pd.DataFrame(out, columns=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return base.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
