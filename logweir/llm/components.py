"""Connected components of a table of links, by alternating stars; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Minima of so many links are broadcast (16 bytes each), and a round is one job; beyond it they are written and joined.
BROADCAST_LINKS = 100_000


def _least_neighbour(pairs: DataFrame, few: bool) -> DataFrame:
    """Each pair (u, v) with m, the smallest v of its u. Unless the pairs are few, the minima are written first, so that a
    hub's pairs are an exchange of their own whose large partitions Spark splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(F.broadcast(least) if few else staged(least, "least"), "u")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = _least_neighbour(both, few).withColumn("m", F.least("m", "u"))
    return seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _least_neighbour(down, few)
    return seen.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")


def _stars(links: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: nothing is left to do."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 OR a = 1 AND b = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v) between integers to (u, v) where v is the smallest id of u's component, for all u but those v.

    Each round links all larger neighbours of an id, then the id and its smaller neighbours, to the smallest
    neighbour; rounds grow as the logarithm of the largest component and end when all links are stars. Loops and repeated
    links do no harm; no links give no rows. The first round reads `edges` several times: what is costly is staged before."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    few = now.count() <= BROADCAST_LINKS
    while True:
        now = staged(_small_star(_large_star(now, few).where("u <> v").distinct(), few).where("u <> v").distinct(), "links")
        if _stars(now):
            return now
