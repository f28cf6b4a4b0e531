"""Language identification by a mixture of languages for each document, fitted by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Byte trigrams are hashed to so many buckets: the model has this many numbers a language, whatever the corpus.
BUCKETS = 1 << 15
#: A model of more languages (256 KB each, in every worker) is refused rather than cut.
MAX_LANGUAGES = 1000
#: Bytes of text that are handled as one array with a model of up to 16 languages; with more languages, fewer.
CHUNK = 1 << 18

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of hashed trigrams: text number, bucket, count; sorted by text number.

    Letters are folded in A-Z; whatever else is ASCII separates words, and words keep one space on either side."""
    folded = [b" " + b" ".join(t.encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" " for t in texts]
    sizes = np.array([len(f) for f in folded], dtype=np.int64)
    data = np.frombuffer(b"".join(folded), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (data[2:] * np.uint32(0xC2B2AE35))
    bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    keep = owner[:-2] == owner[2:]
    key, n = np.unique(owner[:-2][keep] * BUCKETS + bucket[keep].astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, n.astype(np.float64)


def _chunks(texts: list[str], langs: int = 1) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size * max(1, langs / 16) >= CHUNK:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fit_languages(docs: DataFrame, text_col: str, lang_col: str, train: Column) -> tuple[list[str], np.ndarray]:
    """Languages and the logarithm of each bucket's probability in them, counted over all training rows.

    Counts are summed in each task, then by (language, bucket) in a shuffle; what reaches the driver is the model."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in batch.groupby("_lang", sort=False)["_text"]:
                texts = own.tolist()
                for part in _chunks(texts):
                    _, bucket, n = trigram_counts(texts[part])
                    sums.setdefault(lang, np.zeros(BUCKETS))
                    np.add.at(sums[lang], bucket, n)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"_lang": lang, "_bucket": at.astype(np.int32), "_n": s[at].astype(np.int64)})

    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    sums = rows.mapInPandas(count, "_lang string, _bucket int, _n bigint").groupBy("_lang", "_bucket").agg(F.sum("_n").alias("_n"))
    sums = staged(sums, "trigrams")
    langs = sorted(r["_lang"] for r in sums.select("_lang").distinct().collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model of more than {MAX_LANGUAGES} is too large for a worker")
    table = np.full((len(langs), BUCKETS), 0.5)
    if langs:
        place = {lang: k for k, lang in enumerate(langs)}
        packed = sums.groupBy("_lang").agg(F.collect_list("_bucket").alias("b"), F.collect_list("_n").alias("n"))  # at most BUCKETS each
        for r in packed.toLocalIterator():  # beside the table, the driver holds one partition's languages
            table[place[r["_lang"]], r["b"]] += np.array(r["n"], dtype=float)
        table /= table.sum(axis=1, keepdims=True)
    return langs, np.log(table)


def _em(p: np.ndarray, n: np.ndarray, owner: np.ndarray, first: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text's languages and its log-likelihood under them. A proportion of 0 stays 0."""
    share, total = start, np.add.reduceat(n, first)
    for _ in range(steps):
        r = p * share[owner]
        r *= (n / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(r, first, axis=0) / total[:, None]
    like = np.log(np.maximum((p * share[owner]).sum(axis=1), 1e-300))
    return share, np.add.reduceat(n * like, first)


def mixtures(texts: list[str], table: np.ndarray, penalty: float, steps: int = 10) -> np.ndarray:
    """Language proportions of each text over the set of languages with the best penalised likelihood.

    A mixture of all languages ranks them; its first one, two, ... languages are then fitted alone. A set of s
    languages costs (s - 1) * penalty * log(trigrams), which alone ends the set: larger sets are tried until no likelihood
    could pay for them. Texts without a trigram have proportions of 0."""
    out = np.zeros((len(texts), len(table)))
    doc, bucket, n = trigram_counts(texts)
    if not len(doc):
        return out
    own, first, owner = np.unique(doc, return_index=True, return_inverse=True)
    logp = table.T[bucket]
    logp -= logp.max(axis=1, keepdims=True)  # the same for all sets, so it does not matter in comparisons
    p = np.exp(logp)
    langs = len(table)
    share, _ = _em(p, n, owner, first, np.full((len(own), langs), 1 / langs), steps)
    order = np.argsort(-share, axis=1, kind="stable")
    cost = penalty * np.log(np.maximum(2.0, np.add.reduceat(n, first)))
    best, chosen = np.full(len(own), -np.inf), share.copy()
    # no set's likelihood is above this, as the mixture likelihood is concave in the proportions
    mix = (p * share[owner]).sum(axis=1)
    total = np.add.reduceat(n, first)
    slope = np.add.reduceat(p * (n / np.maximum(mix, 1e-300))[:, None], first, axis=0).max(axis=1) / total
    most = np.add.reduceat(n * np.log(np.maximum(mix, 1e-300)), first) + total * np.log(np.maximum(slope, 1.0)) + 1e-6
    for s in range(1, langs + 1):
        left = np.flatnonzero(most - (s - 1) * cost > best)  # texts for which so many languages can still pay
        if not len(left):
            break
        at = np.isin(owner, left)
        sub = np.searchsorted(left, owner[at])
        start = np.zeros((len(left), langs))
        ranked = order[left, :s]
        np.put_along_axis(start, ranked, np.maximum(np.take_along_axis(share[left], ranked, axis=1), 1e-3), axis=1)
        start /= start.sum(axis=1, keepdims=True)
        fitted, like = _em(p[at], n[at], sub, np.searchsorted(sub, np.arange(len(left))), start, 0 if s == 1 else steps // 2)
        better = like - (s - 1) * cost[left] > best[left]
        best[left] = np.where(better, like - (s - 1) * cost[left], best[left])
        chosen[left[better]] = fitted[better]
    out[own] = chosen
    return out


def identify_language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 4.0) -> DataFrame:
    """One row for each input row: the id column, lang_pred, score (the language's share of the text) and languages (all
    of the chosen set with their shares, largest first).

    `train` marks the rows to learn from; of those, rows with null text or language are left out. A text that is null
    or has no letter is `und` with score 0 and no languages, as are all texts when nothing could be learned. Ties go to
    the language that sorts first. Repeated rows are judged alike, very long texts are judged whole, an empty
    table gives no rows and further columns are ignored. More than MAX_LANGUAGES languages are refused. Learning shuffles
    sums of hashed trigrams alone; prediction is one pass without a shuffle."""
    langs, table = fit_languages(docs, text_col, lang_col, train)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, letters = batch["_text"].tolist(), batch["_letter"].to_numpy(dtype=bool)
            rows = []
            for part in _chunks(texts, len(langs)):
                share = mixtures(texts[part], shared.value, penalty) if langs else np.zeros((len(texts[part]), 1))
                rows += list(share)
            preds, scores, sets = [], [], []
            for row, ok in zip(rows, letters, strict=True):
                k = int(np.argmax(row))
                ok = bool(ok and langs and row[k] > 0)
                preds.append(langs[k] if ok else "und")
                scores.append(float(min(1.0, row[k])) if ok else 0.0)
                sets.append([{"lang": langs[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0] if ok else [])
            yield pd.DataFrame({"_id": batch["_id"], "lang_pred": preds, "score": scores, "languages": sets})

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.rlike(text, F.lit(r"\p{L}")).alias("_letter"))
    return base.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
