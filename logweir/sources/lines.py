"""Line sources: ordered files, over-long and empty lines, the running abort rule. Compressed files: `streams`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_LINE = 1_048_576
#: Fixed value: paths that one analysis takes.
MAX_INPUTS = 64
#: A file's lines take this many numbers.
SOURCE_STEP = 1 << 42
#: Bytes that are expanded at a time, and up to which an expansion's ratio doesn't count.
BLOCK, FREE = 1 << 20, 1 << 20


def _coded(df: DataFrame, max_line: int) -> DataFrame:
    long_ = F.octet_length("line") > max_line
    return df.withColumn("line_code", F.when(long_, "line_too_long").when(F.col("line") == "", "empty_line")).withColumn("line", F.when(long_, "").otherwise(F.col("line")))


def read_lines(spark: SparkSession, paths: list[str], max_line: int = MAX_LINE) -> DataFrame:
    """(seq, source_ordinal, line, line_code) of plain text files in the order given; a folder or pattern gives its files
    in the order of their names, each a source of its own.

    Lines end with LF; one CR before it goes. seq grows with source and place: a line's number within its file split is
    added to the byte at which the split begins, so splits need no common counter and large files stay splittable."""
    if not 1 <= len(paths) <= MAX_INPUTS:
        raise ValueError(f"{len(paths)} inputs; 1 to {MAX_INPUTS} are read at a time")
    files: dict[str, int] = {}
    for path in paths:
        for name in sorted(spark.read.text(path).inputFiles()):
            files.setdefault(name, len(files))
    # the two ways in which Spark writes a file's name differ in the slashes behind the scheme
    plain = lambda c: F.regexp_replace(c, "^([^:/]+):/+", "$1:/")
    sources = spark.createDataFrame(list(files.items()), "_file string, source_ordinal int").withColumn("_file", plain("_file"))
    raw = spark.read.option("lineSep", "\n").text(list(paths))
    raw = raw.select(F.regexp_replace("value", "\r\\z", "").alias("line"), plain("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    first = raw.groupBy("_file", "_at").agg(F.min("_n").alias("_first")).join(sources, "_file")  # one row for each split
    placed = raw.join(first, ["_file", "_at"])
    return _coded(placed.select((F.col("source_ordinal") * F.lit(SOURCE_STEP) + F.col("_at") + F.col("_n") - F.col("_first")).alias("seq"), "source_ordinal", "line"), max_line)


class ExpansionError(ValueError):
    """A compressed source grows beyond what is allowed."""


def parse_abort(lines: DataFrame) -> DataFrame:
    """From (seq, rejected) of non-empty lines: total, rejected, abort_seq of the first line at which too many were
    rejected (or null), and whether the final rule fails.

    Running counts are summed in two levels of blocks, so that a window sees at most 4096 rows of a block and the one over
    all blocks a row for 16 million numbers."""
    sizes = {"_b": 12, "_c": 24}
    blocked = lines.withColumns({k: F.shiftright("seq", n) for k, n in sizes.items()}).withColumn("bad", F.col("rejected").cast("long"))
    small = blocked.groupBy("_c", "_b").agg(F.count("*").alias("n"), F.sum("bad").alias("r"))
    large = small.groupBy("_c").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over, inside = Window.orderBy("_c"), Window.partitionBy("_c").orderBy("_b")
    large = large.select("_c", before("n", over).alias("n0"), before("r", over).alias("r0"))
    small = small.select("_c", "_b", before("n", inside).alias("n1"), before("r", inside).alias("r1")).join(large, "_c")
    own = Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = blocked.join(small.drop("_c"), "_b").select("seq", "rejected", (F.col("n0") + F.col("n1") + F.count("*").over(own)).alias("total"), (F.col("r0") + F.col("r1") + F.sum("bad").over(own)).alias("bad"))
    hit = run.where("rejected AND CASE WHEN total < 10000 THEN bad > 100 ELSE bad >= (total * 50001 + 999999) div 1000000 END")
    whole = lines.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("rejected").cast("long")), F.lit(0)).alias("rejected"))
    final = F.expr("rejected > greatest(100, total div 1000)").alias("final_abort")
    return whole.crossJoin(hit.agg(F.min("seq").alias("abort_seq"))).select("total", "rejected", "abort_seq", final)
