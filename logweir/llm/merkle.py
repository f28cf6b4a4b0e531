"""Merkle manifest of a table: a tree for each group, a tree over their roots, and a proof for each row by octopus multiproofs.

Rows are put in order by a range partitioning and counts of its partitions, so no task sees a whole group. Trees grow level
by level in shuffles that shrink eightfold. Leaf partitions are slices of SLICE places of a tree: each works out the
smallest union of nodes that its leaves lack (an octopus), all of which are fetched in one join; shared interiors are
derived from leaves and fetched nodes, and every leaf's own proof is spelled out from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, crc, staged

#: Children of a node.
WIDTH = 8
#: Places of a tree that form one leaf partition.
SLICE = 4096
#: Rows (at most 100 bytes each) that are broadcast; more are joined in a shuffle.
BROADCAST_ROWS = 1_000_000
#: Key of the tree over the trees of the groups, whose keys are empty or begin with "=".
TOP = "/"


def _field(col: Column) -> Column:
    text = col.cast("string")
    return F.when(col.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: of each value its length in bytes and itself, "-" for null."""
    return F.sha2(F.concat(*map(_field, columns)).cast("binary"), 256)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Staged `rows` with idx, the place within `tree` by `order`, and n, the tree's size. Rows that nothing tells apart
    stand in any order, spread over partitions by a number of their own."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    ranged = rows.repartitionByRange(parts, "tree", *(F.col(c).asc_nulls_first() for c in order), "_tie")
    ranged = ranged.sortWithinPartitions("tree", *(F.col(c).asc_nulls_first() for c in order), "_tie")
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    counts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy("tree")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = staged(counts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n")), "counts")
    return ranged.join(_few(counts), ["tree", "_part"]).withColumn("idx", F.col("_row") + F.col("_shift")).drop("_tie", "_part", "_row", "_shift")


def _grown(leaves: DataFrame) -> DataFrame:
    """All nodes above `leaves` (tree, idx, n, hash): tree, level, idx, hash and size, the number of nodes of that level."""
    now, level, found = leaves.select("tree", "idx", F.col("n").alias("size"), "hash").where("size > 1"), 0, None
    while not now.isEmpty():
        level += 1
        run = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = now.groupBy("tree", "size", F.expr(f"idx div {WIDTH}").alias("_up")).agg(F.sha2(F.array_join(F.transform(run, lambda x: x["hash"]), "").cast("binary"), 256).alias("hash"))
        nodes = staged(up.select("tree", F.lit(level).alias("level"), F.col("_up").alias("idx"), "hash", F.expr(f"(size + {WIDTH - 1}) div {WIDTH}").alias("size")), "nodes")
        found = nodes if found is None else found.union(nodes)
        now = nodes.select("tree", "idx", "size", "hash").where("size > 1")
    return found if found is not None else leaves.select("tree", F.lit(0).alias("level"), "idx", "hash", F.col("n").alias("size")).limit(0)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def missing(idx: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Octopus: the nodes (level, places) of a tree with `n` leaves that together with the leaves `idx` give its root, and no
    more: siblings of what is known, but for those that are known or can be derived."""
    out, level, known = [], 0, np.unique(idx)
    while n > 1:
        up = np.unique(known // WIDTH)
        run = (up[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        out.append((level, np.setdiff1d(run[run < n], known, assume_unique=True)))
        known, n, level = up, -(-n // WIDTH), level + 1
    return out


class Branches:
    """A tree as far as some of its leaves and the nodes that they lack show it."""

    def __init__(self, known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]):
        self.runs: list[dict[int, list[str]]] = []
        while n > 1:
            level, up = len(self.runs), {}
            for p in {i // WIDTH for i in known}:
                up[p] = [known[i] if i in known else fetched[level, i] for i in range(p * WIDTH, min(n, p * WIDTH + WIDTH))]
            self.runs.append(up)
            known, n = {p: _hash("".join(run)) for p, run in up.items()}, -(-n // WIDTH)
        self.root = known[0]
        self._beside: dict[tuple[int, int], str] = {}

    def beside(self, i: int, level: int = 0) -> str:
        """Siblings of a node and of all above it, joined."""
        if level == len(self.runs):
            return ""
        if (level, i) not in self._beside:
            run, k = self.runs[level][i // WIDTH], i % WIDTH
            self._beside[level, i] = "".join(run[:k] + run[k + 1 :]) + self.beside(i // WIDTH, level + 1)
        return self._beside[level, i]

    def folded(self, i: int, leaf: str) -> str:
        """The root that follows from another leaf at place i."""
        for runs in self.runs:
            run, k = runs[i // WIDTH], i % WIDTH
            leaf, i = _hash("".join([*run[:k], leaf, *run[k + 1 :]])), i // WIDTH
        return leaf


def _asked(slices: DataFrame) -> DataFrame:
    """What each slice lacks: (tree, slice, of, level, idx), where `of` is the tree that has the node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, part, idx, n, rank, trees in zip(*(batch[c].tolist() for c in ("tree", "slice", "idx", "n", "rank", "trees")), strict=True):
                for of, at, size in ((tree, np.asarray(idx), n), (TOP, np.array([rank]), trees)):
                    found = missing(at, size)
                    found.append((len(found), np.array([0])))  # the root, to verify against
                    level, places = np.repeat([x[0] for x in found], [len(x[1]) for x in found]), np.concatenate([x[1] for x in found])
                    yield pd.DataFrame({"tree": tree, "slice": part, "of": of, "level": level, "idx": places})

    slices = slices.select("tree", "slice", F.transform("leaves", lambda x: x["idx"]).alias("idx"), "n", "rank", "trees")
    return staged(slices.mapInPandas(run, "tree string, slice bigint, of string, level int, idx bigint"), "asked")


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", now: dict[str, Column] | None = None, prove: Column | None = None) -> DataFrame:
    """One row for each input row, or for each that `prove` picks: the id column, leaf, subroot, root, proof (siblings level
    by level, left to right, as hex texts one after the other), proof_sha256, folded_root and verified.

    A leaf is the digest of `columns` in that order. The leaves of a group stand by id; eight consecutive nodes become
    their digest until one is left, a lone leaf itself: the subroot. The subroots, by group, likewise give the root.
    `now` says what columns hold at the time of verification, where that is another value: folded_root follows from that
    row and the original siblings, and verified says whether it is the root.

    Null values are values of their own; a null group is a group, and comes first; null ids come first in a group, and
    empty texts differ from null ones. Rows with equal ids stand by digest; rows that repeat have a leaf and a proof each. An
    empty table gives no rows; very long texts are digested whole; further columns are ignored, whatever their names.
    A group of any size is spread over range partitions; a slice has at most SLICE leaves."""
    of = lambda named: leaf([named.get(c, F.col(c)) for c in columns])
    tree = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    picked = F.lit(True) if prove is None else F.coalesce(prove, F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), tree.alias("tree"), of({}).alias("hash"), of(now or {}).alias("now"), picked.alias("picked"))
    leaves = staged(_placed(rows, ["_id", "hash"]), "placed")
    nodes = _grown(leaves)
    subroots = nodes.where("size = 1").select("tree", "hash").union(leaves.where("n = 1").select("tree", "hash"))
    tops = staged(_placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("_of"), "hash"), ["_of"]), "tops")
    every = leaves.select("tree", F.lit(0).alias("level"), "idx", "hash").union(nodes.select("tree", "level", "idx", "hash"))
    every = every.union(tops.select("tree", F.lit(0), "idx", "hash")).union(_grown(tops).select("tree", "level", "idx", "hash"))

    slices = leaves.where("picked").groupBy("tree", "n", F.expr(f"idx div {SLICE}").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("idx", "_id", "hash", "now"))).alias("leaves"))
    ranks = tops.select(F.col("_of").alias("tree"), F.col("idx").alias("rank"), F.col("n").alias("trees"))
    slices = staged(slices.join(_few(ranks), "tree"), "slices")
    asked = _asked(slices).withColumnRenamed("tree", "_tree")
    fetched = _few(asked).join(every.withColumnRenamed("tree", "of"), ["of", "level", "idx"])
    fetched = fetched.groupBy(F.col("_tree").alias("tree"), "slice").agg(F.collect_list(F.struct((F.col("of") == TOP).alias("top"), "level", "idx", "hash")).alias("fetched"))
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaves, got, n, rank, trees in zip(*(batch[c].tolist() for c in ("leaves", "fetched", "n", "rank", "trees")), strict=True):
                low, high = ({(x["level"], x["idx"]): x["hash"] for x in got if x["top"] == top} for top in (False, True))
                own = Branches({x["idx"]: x["hash"] for x in leaves}, n, low)
                top = Branches({rank: own.root}, trees, high)
                subroot, root = low[len(own.runs), 0], high[len(top.runs), 0]
                beside, out = top.beside(rank), []
                for x in leaves:
                    proof = own.beside(x["idx"]) + beside
                    to = top.root if x["now"] == x["hash"] else top.folded(rank, own.folded(x["idx"], x["now"]))
                    out.append((x["_id"], x["hash"], subroot, root, proof, _hash(proof), to, to == root))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    out = slices.join(fetched, ["tree", "slice"]).select("leaves", "fetched", "n", "rank", "trees").mapInPandas(expand, schema)
    return out.withColumnRenamed("_id", id_col)


def tampered(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """A tampering to try manifests with: the text in lower case (A-Z) where 3 divides the id's checksum."""
    return {text_col: F.when(crc(F.col(id_col)) % 3 == 0, ascii_lower(F.col(text_col))).otherwise(F.col(text_col))}
