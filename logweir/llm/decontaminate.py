"""Benchmark decontamination: a prefix-filtered join of documents with item windows, verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salt_of, staged, words

#: Windows (about 150 bytes each) are broadcast up to this many; beyond it both sides are shuffled by shingle.
BROADCAST_WINDOWS = 200_000
#: Ids of documents with a window's rarest shingle are broadcast up to this many (16 bytes each); beyond it texts are
#: shuffled to them.
BROADCAST_DOCUMENTS = 1_000_000


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct windows of `size` consecutive words (w, n, text) with the items that have them; a shorter item is one
    window, an item without words none."""
    base = items.select(F.col(id_col).alias("_item"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0)))
    each = base.select("_item", F.explode(F.transform(starts, lambda s: F.slice("_w", s + 1, F.lit(size)))).alias("w"))
    return each.groupBy("w").agg(F.sort_array(F.collect_set("_item")).alias("items")).select("w", F.size("w").alias("n"), F.array_join("w", " ").alias("win"), "items")


def _key(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(w, at + i) for i in range(k)))


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    k = F.least(F.lit(shingle), F.col("n"))
    one = windows.withColumn("k", k).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("n") - k)))
    key = F.coalesce(*(F.when(F.col("k") == i, _key(F.col("w"), F.col("off"), i)) for i in range(1, shingle + 1)))
    return one.withColumn("key", key)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, ks: list[int], known: DataFrame, local: bool) -> DataFrame:
    """Where shingles of `known` (key, k) stand in documents: rows (_id, _fp, n_words, at,
    key, k), and one for each document itself with `at` -1, which meets nothing. Rows are told apart by id and a hash of
    the text. With few keys (`local`) all comes from one reading of the texts without a shuffle; else shingles meet the
    keys in a join whose large partitions Spark splits, and documents don't take part in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_fp"), words(text).alias("_w")).withColumn("n_words", F.size("_w"))
    w, none = F.col("_w"), F.array().cast("array<int>")
    of = lambda at, k: F.xxhash64(*(F.get(w, at + i) for i in range(k)))
    starts = [F.when(F.col("n_words") >= k, F.sequence(F.lit(0), F.col("n_words") - k)).otherwise(none) for k in ks]
    if len(ks) == 1:
        keys = F.concat(F.array(F.lit(0).cast("long")), F.transform(starts[0], lambda at: of(at, ks[0])))
        each = base.select("_id", "_fp", "n_words", F.posexplode(keys).alias("_p", "key"))
        each = each.select("_id", "_fp", "n_words", (F.col("_p") - 1).alias("at"), "key", F.lit(ks[0]).alias("k"))
    else:
        placed = lambda k: lambda at: F.struct(at.alias("at"), of(at, k).alias("key"), F.lit(k).alias("k"))
        own = [F.transform(s, placed(k)) for k, s in zip(ks, starts, strict=True)]
        itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("key"), F.lit(ks[0]).alias("k")))
        each = base.select("_id", "_fp", "n_words", F.inline(F.concat(itself, *own)))
    known = known.select("key", "k").distinct()
    if local:
        met = each.join(F.broadcast(known.withColumn("_known", F.lit(True))), ["key", "k"], "left")
        return met.where("at < 0 OR _known").drop("_known")
    alone = base.select(F.lit(0).cast("long").alias("key"), F.lit(ks[0]).alias("k"), "_id", "_fp", "n_words", F.lit(-1).alias("at"))
    return each.where("at >= 0").join(known, ["key", "k"]).unionByName(alone)


def find_windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, size: int, shingle: int) -> DataFrame:
    """One row for each document: _id, _fp, n_words and hits, the occurrences of item windows in it as an array of
    struct(start, end, items) with words as places and ends exclusive; null where there are none.

    Prefix filter: all shingles of a window have to occur, so its rarest one in the corpus has to; only that one is
    joined. Length bound: a document is at least as long as the window. Positional bound: the window must fit around
    the place of its shingle. What is left is compared word by word, in the few documents that hold such a shingle."""
    windows = staged(item_windows(items, item_id, item_text, size), "windows")
    ks = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), F.col("n"))).distinct().collect())  # at most `shingle` values
    local = windows.count() <= BROADCAST_WINDOWS
    of_windows = _window_shingles(windows, shingle)
    occurs = staged(_occurrences(docs, id_col, text_col, ks or [shingle], of_windows.select("key", "k"), local), "occurrences")
    found = occurs.where("at >= 0")
    # rarity: how often each shingle of any window occurs in the whole corpus
    counts = found.groupBy("key", "k").agg(F.count("*").alias("_c"))
    ranked = of_windows.join(staged(counts, "shingles"), ["key", "k"], "left")
    rarest = ranked.groupBy("win").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "off", "key", "k")).alias("r"))
    rarest = rarest.where("r.c > 0").select("win", "r.off", "r.key", "r.k")
    chosen = staged(windows.drop("w").join(rarest, "win"), "rarest")
    fits = (F.col("at") >= F.col("off")) & (F.col("at") - F.col("off") + F.col("n") <= F.col("n_words"))
    if local:
        pairs = found.join(F.broadcast(chosen), ["key", "k"])
    else:
        salted = found.withColumn("_salt", salt_of(F.struct("_id", "at"), 64))
        dealt = salted.select("key", "k", "_salt").distinct().join(chosen, ["key", "k"])  # only salts that occur
        pairs = salted.join(dealt, ["key", "k", "_salt"])
    start = F.col("at") - F.col("off")
    place = F.struct(start.alias("start"), (start + F.col("n")).alias("end"), "win", "items")
    maybe = staged(pairs.where(fits).groupBy("_id", "_fp").agg(F.collect_set(place).alias("maybe")), "maybe")
    few = maybe.count() <= BROADCAST_DOCUMENTS
    ids = maybe.select(F.col("_id").alias("_mid"), F.col("_fp").alias("_mfp"))
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    held = base.join(F.broadcast(ids) if few else ids, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_fp") == F.col("_mfp")), "left_semi")
    texts = held.dropDuplicates(["_id", "_fp"]).select(F.col("_id").alias("_tid"), F.col("_fp").alias("_tfp"), words(F.col("_text")).alias("_w"))
    met = maybe.join(texts, F.col("_id").eqNullSafe(F.col("_tid")) & (F.col("_fp") == F.col("_tfp")))
    same = F.filter("maybe", lambda x: F.array_join(F.slice("_w", x["start"] + 1, x["end"] - x["start"]), " ") == x["win"])
    hits = met.select("_tid", "_tfp", F.transform(same, lambda x: x.dropFields("win")).alias("hits")).where(F.size("hits") > 0)
    docs_ = occurs.where("at < 0").select("_id", "_fp", "n_words")
    return docs_.join(hits, F.col("_id").eqNullSafe(F.col("_tid")) & (F.col("_fp") == F.col("_tfp")), "left").drop("_tid", "_tfp")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, shingle: int = 3) -> DataFrame:
    """One row for each document: the id column, n_words, n_hit, item_ids (sorted) and contaminated, and text_hash, which
    tells rows that share an id but not the text apart.

    A window is `size` consecutive words of an item, or a whole shorter item. A document word is hit when it stands
    inside any occurrence of a window. Null and empty texts have no words: such documents are clean and such items
    have no window. An empty benchmark leaves all documents clean, an empty table gives no rows. A null id is as good as
    any; repeated rows are judged alike; very long texts are read whole. Further columns are ignored.

    Every text is cut into words once, and again only where a window's rarest shingle stands. Only occurrences of shingles
    are written, with one narrow row a document; a window that very many documents hold meets in tasks by document, never
    by window."""
    found = find_windows(docs, items, id_col, text_col, item_id, item_text, size, shingle)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def step(acc, x):
        more = F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))

    spans = F.array_sort(F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    n_hit = F.coalesce(F.aggregate(spans, zero, step, lambda acc: acc["n"]), F.lit(0)).cast("long")
    none = F.array().cast(f"array<{dict(items.select(item_id).dtypes)[item_id]}>")
    ids = F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))), none)
    return found.select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), ids.alias("item_ids"), F.col("hits").isNotNull().alias("contaminated"), F.col("_fp").alias("text_hash"))
