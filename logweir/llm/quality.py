"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_hash

#: Random Fourier features; the normal equations have this many rows, whatever the corpus.
FEATURES = 192
#: Bins of raw scores that calibration sums into.
BINS = 512
SEED = 7

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "lower", "digit", "space", "newline", "high",
    "sentence_marks", "other_marks", "bar", "bang", "distinct_words", "distinct_lines", "common_word", "shouted", "marked_words", "line_words",
)

_UP, _LOW, _DIG = range(65, 91), range(97, 123), range(48, 58)
_WORD_BYTES = bytes(c if c in _UP or c in _LOW or c in _DIG or c >= 128 else 32 for c in range(256))


def statistics(text: str) -> list[float]:
    """Shape of a whole text as numbers of similar size; shares enter by their root, counts by their logarithm."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    by = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) if data else np.zeros(256, dtype=np.int64)
    root = lambda x, of: (x / of) ** 0.5
    tokens, lines = data.split(), data.split(b"\n")
    words = data.translate(_WORD_BYTES).split()
    w = max(1, len(tokens))
    seen: dict[bytes, int] = {}
    for x in tokens:
        seen[x] = seen.get(x, 0) + 1
    marks = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    plain = int(by[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum())
    return [
        float(np.log1p(len(data))), float(np.log1p(len(tokens))), len(data) / w / 8, root(max(map(len, tokens), default=0), 64),
        root(int(by[65:91].sum()), n), root(int(by[97:123].sum()), n), root(int(by[48:58].sum()), n), root(int(by[32]), n), root(int(by[10]), n), root(int(by[128:].sum()), n),
        root(plain, n), root(marks - plain, n), root(int(by[124]), n), root(int(by[33]), n),
        len(seen) / w, len(set(lines)) / len(lines), root(max(seen.values(), default=0), w), root(sum(x.isupper() and len(x) > 2 for x in words), w),
        root(sum(not x[-1:].isalnum() and x[-1] < 128 for x in tokens), w), float(np.log1p(w / len(lines))),
    ]


def _isotonic(x: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the blocks of the increasing step function nearest to `mean`."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, n, mean, strict=True):
        blocks.append([a * b, b, b * c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    rows = np.array(blocks)
    return rows[:, 0] / rows[:, 1], rows[:, 2] / rows[:, 1]


class _Map:
    """Standardises statistics and maps them to cosine features, whose products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, width: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), FEATURES)) / width
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _solve(a: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    penalty = ridge * np.eye(len(a))
    penalty[-1, -1] = 1e-6  # the constant is free
    return np.linalg.solve(a + penalty, y)


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", ridge: float = 0.05, width: float = 8.0, threshold: float = 0.7) -> DataFrame:
    """One row for each input row: the id column, score (0 to 1), predicted (1 where score >= threshold, else 0) and
    text_hash (which tells rows of one id but different texts apart).

    `train` is a condition on `row_id()` that marks the rows whose labels may be used; null labels are
    left out, and several labels of an id count as one, their mean. All of them are used: each partition sums its normal equations for two halves (by the id's hash), the
    sums are added up in a shuffle and the system, of a fixed size, is solved on the driver. Each half is scored by
    the other half's fit to calibrate: raw scores are counted in bins and pooled to an increasing function. A score is 0.98 of
    that level and 0.02 of the raw score, which keeps the order of documents inside a pooled block. A null text
    counts as empty; empty texts are scored as any other; very long texts enter whole. Without a usable label every score is 0.5; with labels of one
    value it is that value. Repeated rows are scored alike, further columns are ignored and
    an empty table gives no rows."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "_hash": batch["_hash"], "_x": [statistics(t) for t in batch["_text"]]})

    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), text_hash(F.col(text_col)).alias("_hash"))
    rows = staged(base.mapInPandas(stats, f"_id {id_type}, _hash bigint, _x array<double>"), "statistics")
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.avg(F.col(label_col).cast("double")).alias("_y"))
    known = rows.where(train).join(marked, F.col("_id") == F.col("_lid")).select("_id", "_x", "_y", F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int").alias("_half"))
    known = staged(known, "training")
    size = range(len(STATISTICS))
    each = [f(F.get("_x", F.lit(k))) for k in size for f in (F.avg, F.stddev_pop)]
    whole = known.agg(F.count("*").alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi"), F.array(*each).alias("m")).first()
    if not whole["n"] or whole["lo"] == whole["hi"]:
        score = F.lit(0.5 if not whole["n"] else min(1.0, max(0.0, whole["lo"])))
        return rows.select(F.col("_id").alias(id_col), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.col("_hash").alias("text_hash"))
    moments = np.array(whole["m"]).reshape(-1, 2)
    features = _Map(moments[:, 0], moments[:, 1], width)
    width_all = FEATURES + 1

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for half, part in batch.groupby("_half"):
                z = features(np.stack(part["_x"].to_numpy()))
                sums[half] = sums.get(half, 0) + z.T @ np.hstack([z, part["_y"].to_numpy()[:, None]])
        for half, s in sums.items():
            yield pd.DataFrame({"_half": half, "_row": np.arange(width_all), "_v": list(s)})

    parts = known.mapInPandas(normal, "_half int, _row int, _v array<double>")
    total = parts.groupBy("_half", "_row").agg(F.array(*(F.sum(F.get("_v", F.lit(k))) for k in range(width_all + 1))).alias("_v")).collect()  # 2 * (FEATURES + 1) rows
    system = np.zeros((2, width_all, width_all + 1))
    for r in total:
        system[r["_half"], r["_row"]] = r["_v"]
    fit = lambda s: _solve(s[:, :-1], s[:, -1], ridge)
    weights, halves = fit(system.sum(axis=0)), [fit(system[1]), fit(system[0])]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, y = np.zeros(BINS, dtype=np.int64), np.zeros(BINS)
        for batch in batches:
            for half, part in batch.groupby("_half"):
                raw = features(np.stack(part["_x"].to_numpy())) @ halves[half]
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                np.add.at(n, at, 1)
                np.add.at(y, at, part["_y"].to_numpy())
        keep = np.flatnonzero(n)
        yield pd.DataFrame({"_bin": keep.astype(np.int32), "_n": n[keep], "_y": y[keep]})

    found = known.mapInPandas(binned, "_bin int, _n bigint, _y double").groupBy("_bin").agg(F.sum("_n").alias("_n"), F.sum("_y").alias("_y")).orderBy("_bin").toPandas()  # BINS rows at most
    centre = (found["_bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    xs, ys = _isotonic(centre, found["_n"].to_numpy(dtype=float), (found["_y"] / found["_n"]).to_numpy())

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = features(np.stack(batch["_x"].to_numpy())) @ weights if len(batch) else np.zeros(0)
            # a little of the raw score keeps the order inside a pooled block
            level = 0.98 * np.interp(raw, xs, ys) + 0.02 * np.clip(raw, 0, 1)
            score = np.round(np.clip(level, 0, 1), 9)
            yield pd.DataFrame({"_id": batch["_id"], "score": score, "predicted": (score >= threshold).astype(np.int32), "text_hash": batch["_hash"]})

    return rows.mapInPandas(apply, f"_id {id_type}, score double, predicted int, text_hash bigint").withColumnRenamed("_id", id_col)


def row_id() -> Column:
    """The id column as `train` conditions see it."""
    return F.col("_id")
