"""Exact dedup by progressive refinement: length, then a hash of the first bytes, then a digest of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, salt_of, staged, text_hash

#: Keys of surviving groups are broadcast up to this many (16 bytes each); beyond it rows meet them in a salted join.
BROADCAST_KEYS = 1_000_000


def _flagged(rows: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """`rows` with _in: whether more than one of those that are in so far has the row's keys."""
    inside = rows.where("_in").withColumn("_s", salt_of(F.col("_id"), salts))
    counted = inside.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    found = counted.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_hit"))
    found = staged(found, "exact-keys")
    if found.count() <= BROADCAST_KEYS:
        met = rows.join(F.broadcast(found), keys, "left")
    else:
        dealt = counted.select(*keys, "_s").join(found, keys)  # only salts that occur
        met = rows.withColumn("_s", salt_of(F.col("_id"), salts)).join(dealt, [*keys, "_s"], "left").drop("_s")
    return met.withColumn("_in", F.col("_in") & F.coalesce("_hit", F.lit(False))).drop("_hit")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False, salts: int = SALTS) -> DataFrame:
    """One row for each input row: the id column, keep_id, group_size, kept, digest and text_hash (which tells rows of one
    id but different texts apart).

    Texts are equal when byte-identical; a null text counts as the empty one. Of equal texts the row with the
    largest id stays. Rows that share both id and text share their fate (all of them are kept or none). A null id
    never wins over another; a group of null ids alone keeps them. An empty table gives no rows; very long
    texts are hashed whole. Further columns of the input are ignored, whatever their names.

    The full digest is taken for rows whose length and first characters occur again, or for all with `digest_all`
    (a caller that wants every digest); elsewhere it is null. Groups are counted by (digest, salt) first, so a
    group that holds a third of all rows is spread over `salts` tasks."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_len", F.octet_length("_text")).withColumn("_in", F.lit(True))
    second = _flagged(base, ["_len"], salts)
    second = second.withColumn("_pre", F.when(F.col("_in"), F.xxhash64(F.substring("_text", 1, prefix))).otherwise(0))
    third = _flagged(second, ["_len", "_pre"], salts)
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    third = third.select("_id", "_in", (digest if digest_all else F.when(F.col("_in"), digest)).alias("digest"), text_hash(F.col("_text")).alias("text_hash"))
    rows = staged(third.withColumn("_salt", salt_of(F.col("_id"), salts)), "exact-rows")

    parts = rows.where("_in").groupBy("digest", "_salt").agg(F.max("_id").alias("_max"), F.count("*").alias("_n"))
    groups = (
        parts.groupBy("digest")
        .agg(F.max("_max").alias("_keep"), F.sum("_n").alias("_size"), F.collect_set("_salt").alias("_salts"))
        .where("_size > 1")
        .select(F.col("digest").alias("_digest"), "_keep", "_size", F.explode("_salts").alias("_gsalt"))
    )
    # a row without a digest has a key of its own that no group has
    key = F.coalesce(rows["digest"], F.concat(F.lit("-"), rows["_id"].cast("string")), F.lit("-"))
    joined = rows.join(groups, (key == groups["_digest"]) & (rows["_salt"] == groups["_gsalt"]), "left")
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "digest",
        "text_hash",
    )
