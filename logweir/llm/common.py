"""Helpers shared by the corpus operators: shared-folder staging, salted lookups and tokenisation expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many ways the rows of one key are dealt out before a join or a count.
SALTS = 256

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Runs of characters that are no ASCII separators; A-Z are lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Folders of our own, by application, for sessions that name none.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends here and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """`df` written in buckets by `key` to the shared folder, so that later joins on it move the other side only. The
    catalog holds it only for as long as it takes to read its description."""
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: from here on the files alone are needed
    spark.sql(f"DROP TABLE {name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt_of(col: Column, salts: int = SALTS) -> Column:
    """A salt that depends on the row alone, so that a retried task deals its rows as before."""
    return F.pmod(F.xxhash64(col), F.lit(salts)).cast("int")


def salted_lookup(rows: DataFrame, values: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """Left join of `rows` with `values` (one row for each key), safe for a key that holds most of the rows.

    Only the (key, salt) combinations that occur are copied from `values`, so no key meets more than `salts`
    rows in one task and the join itself is one to one on the value side."""
    salted = rows.withColumn("_salt", salt_of(F.col(by), salts))
    dealt = salted.select(key, "_salt").distinct().join(values, key)
    return salted.join(dealt, [key, "_salt"], "left").drop("_salt")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; texts that are all ASCII take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def crc(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def text_hash(text: Column) -> Column:
    """What tells rows that share an id but not the text apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """`docs` without the rows in `gone`, by id and, with `text_col`, by the `text_hash` that `gone` then has; null ids
    match null ids.

    Up to `broadcast_rows` of them (16 bytes each) are broadcast, so texts stay where they are; more are joined in a
    shuffle."""
    hashed = [F.col("text_hash").alias("_gone_hash")] if text_col else []
    gone = staged(gone.select(F.col(id_col).alias("_gone"), *hashed).distinct(), "gone")
    hint = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    same = docs[id_col].eqNullSafe(hint["_gone"])
    if text_col:
        same = same & (text_hash(docs[text_col]) == hint["_gone_hash"])
    return docs.join(hint, same, "left_anti")
