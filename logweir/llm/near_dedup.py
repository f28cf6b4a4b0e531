"""Near-dedup by a chosen-path similarity join: documents branch by selected minwise tokens until nodes are small."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import salted_lookup, staged
from .components import components

#: Minwise values of a document. Paths use them whole, sketches the low byte of each.
MINWISE = 128
#: Independent trees, each a root node that holds all documents. Their numbers are chosen so that no two roots pick the
#: same minwise function.
ROOTS = (1, 2, 3, 4, 5, 6)
#: Minwise functions that a node picks; it sends each document to one child for each.
PICKS = 2
#: Trees whose leaves are compared first; leaves of the others are compared where these left something apart.
FIRST_TREES = 2
#: Nodes of at most so many documents are compared exhaustively.
LEAF = 1024
#: Levels after which a node that is still larger is compared exactly, in blocks of about LEAF documents; before that,
#: one that keeps KEPT of its parent's documents or more, since branching would only multiply its rows.
LEVELS, KEPT = 5, 1 / 2
#: Documents of a large node that all others of it are compared with first.
PIVOTS = 8
#: Shingles in a block of an exact comparison (8 bytes each); long documents make smaller blocks.
BLOCK_SHINGLES = 1 << 20
#: Leaves are looked at together up to about this many rows' pairs.
MANY_ROWS = 1024
#: A leaf with more pairs to confirm than this has them counted all at once.
MANY_PAIRS = 256
#: A pair of just the similarity that is asked for has so low a sketch estimate that it is left out less often than this;
#: pairs that stay are confirmed on their full sets.
SKETCH_MISS = 1e-7
#: Pivots of so many large nodes are broadcast (about 1.4 kB a node); beyond it they are dealt to the rows of their nodes.
BROADCAST_NODES = 4096
#: Ids of candidates are broadcast up to this many (8 bytes each); beyond it texts are shuffled to them.
BROADCAST_IDS = 1_000_000

_MUL = (np.random.default_rng(11).integers(0, 1 << 63, MINWISE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str, size: int, known: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence when it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = _mix(h + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def minwise(hashes: np.ndarray) -> np.ndarray:
    out = np.full(MINWISE, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        out = np.minimum(out, ((hashes[at : at + 4096][None, :] * _MUL[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype("<u4")


def _documents(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Each row's number of shingles, fingerprint of its set, minwise values and sketch."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for batch in batches:
            out = []
            for text in batch["_text"]:
                h = shingle_hashes(text, size, known)
                m = minwise(h) if len(h) else None
                out.append((len(h), *((xxhash.xxh3_128_hexdigest(h.tobytes()), m.tobytes(), (m & 0xFF).astype(np.uint8).tobytes()) if len(h) else (None, None, None))))
            yield pd.DataFrame(out, columns=["n", "fp", "mw", "sketch"]).assign(_id=batch["_id"].to_numpy())

    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return base.mapInPandas(run, "n bigint, fp string, mw binary, sketch binary, _id bigint")


def _children(rows: DataFrame) -> DataFrame:
    """Child nodes of (id, k, mw, node, ...) rows: a node picks PICKS minwise functions by its own hash, and a child is
    known by its path of tokens."""
    share = MINWISE // PICKS
    slots = [F.pmod(F.xxhash64("node", F.lit(b)), F.lit(share)).cast("int") + b * share for b in range(PICKS)]
    child = [F.xxhash64(F.col("node"), slot, F.substring(F.col("mw"), slot * 4 + 1, F.lit(4))) for slot in slots]
    rest = [c for c in rows.columns if c not in ("mw", "node")]
    return rows.select(*rest, F.explode(F.array(*child)).alias("node"))


def _pivot_pairs(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (id, k, v, vk) of a large node's documents with the one of its pivots that has the nearest sketch.

    Pivots are the documents with the smallest hashes of their ids, so nodes that share most of their documents mostly
    have the same ones and give the same pairs."""
    threshold, least = percent / 100, _least_estimate(percent / 100)
    r = F.xxhash64("id")
    first = large.groupBy("node", F.pmod(F.shiftright(r, 20), F.lit(PIVOTS)).alias("_p")).agg(F.min(F.struct(r.alias("r"), "id", "k")).alias("p"))
    of_node = first.select("node", "p.id", "p.k").join(sets.select("id", "k", "n", "sketch"), ["id", "k"])
    pivots = staged(of_node.groupBy("node").agg(F.collect_list(F.struct("id", "k", "n", "sketch")).alias("pivots")), "pivots")  # PIVOTS at most
    members = large.select("node", "id", "k")
    few = pivots.count() <= BROADCAST_NODES
    rows = (members.join(F.broadcast(pivots), "node", "left") if few else salted_lookup(members, pivots, "node", "id")).join(sets.select("id", "k", "n", "sketch"), ["id", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("pivots")
            row, flat = np.repeat(np.arange(len(batch)), of.value_lengths().to_numpy()), of.flatten()
            ids, ks, n = (batch.column(c).to_numpy() for c in ("id", "k", "n"))
            pid, pk, pn = (flat.field(c).to_numpy() for c in ("id", "k", "n"))
            sketch, psketch = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, MINWISE) for c in (batch.column("sketch"), flat.field("sketch")))
            at = np.flatnonzero(((ids[row] != pid) | (ks[row] != pk)) & (np.minimum(n[row], pn) >= threshold * np.maximum(n[row], pn)))
            e = _estimated(sketch, row[at], psketch, at) if len(at) else np.zeros(0)
            at, e = at[e >= least], e[e >= least]
            order = np.lexsort((-e, row[at]))
            at = at[order][np.unique(row[at][order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row[at]], ks[row[at]], pid[at], pk[at])], names=["id", "k", "v", "vk"])

    return rows.mapInArrow(run, "id bigint, k bigint, v bigint, vk bigint").distinct()


def _confirmed_pairs(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Links (u, v) among the given pairs, by their full sets."""
    wanted = pairs.select("id", "k").union(pairs.select("v", "vk"))
    full = staged(_full_sets(docs, wanted, id_col, text_col, size).join(wanted, ["id", "k"], "left_semi"), "full")
    of_pivot = full.select(F.struct("id", "k").alias("p"), F.col("hashes").alias("other"))
    rows = salted_lookup(pairs.withColumn("p", F.struct(F.col("v").alias("id"), F.col("vk").alias("k"))), of_pivot, "p", "id").join(full, ["id", "k"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["hashes"], batch["other"], strict=True):
                both = len(np.intersect1d(np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8"), assume_unique=True))
                keep.append(100 * both >= percent * ((len(a) + len(b)) // 8 - both))
            yield batch.loc[np.array(keep, dtype=bool), ["u", "v"]]

    return rows.select(F.col("id").alias("u"), "v", "hashes", "other").mapInPandas(run, "u bigint, v bigint")


def _grown(sets: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Memberships (node, id, k, late) of the leaves of all trees, those of large nodes that are to be compared whole, and
    the links found on the way.

    A large node is settled before it branches: its documents are compared with a few of its own, and what is linked by
    that counts as one from then on. A node whose documents are all connected has nothing left to find and ends."""
    roots = sets.select("id", "k", "mw", F.explode(F.array(*(F.lit(r).cast("long") for r in ROOTS))).alias("node"))
    rows = _children(roots.withColumn("late", F.col("node") > ROOTS[FIRST_TREES - 1]))
    counts = staged(rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    counted = staged(rows.join(counts, "node"), "nodes")
    leaves, whole = [counted.where(F.col("c") <= LEAF).select("node", "id", "k", "late")], []
    large = counted.where(F.col("c") > LEAF)
    if large.isEmpty():
        return leaves[0], None, None
    links = staged(confirm(_pivot_pairs(large, sets, percent)), "settled")
    settled = components(links).select(F.col("u").alias("id"), F.col("v").alias("comp"))
    rows = large.join(settled, "id", "left").select("node", "id", "k", "late", F.coalesce("comp", "id").alias("comp"), F.lit(None).cast("long").alias("parent"))
    for level in range(1, LEVELS + 1):
        rows = staged(rows, "nodes")
        parts = rows.groupBy("node", "comp").agg(F.count("*").alias("m"), F.max("parent").alias("parent"))
        stats = parts.groupBy("node").agg(F.sum("m").alias("c"), F.count("*").alias("comps"), F.sum(F.col("m").cast("double") * F.col("m")).alias("_s"), F.max("parent").alias("_p")).where("comps > 1")
        few = (F.col("c").cast("double") * F.col("c") - F.col("_s")) / 2 <= F.col("c") * F.lit(float(LEAF))  # pairs that are left
        stays = few | F.lit(level == LEVELS) | F.coalesce(F.col("c") >= KEPT * F.col("_p"), F.lit(False))
        stats = staged(stats.select("node", "c", F.when(F.col("c") <= LEAF, 0).when(stays, 1).otherwise(2).alias("fate")), "counts")
        left = staged(rows.drop("parent").join(stats, "node"), "nodes")
        leaves.append(left.where("fate = 0").select("node", "id", "k", "late"))
        whole.append(left.where("fate = 1").select("node", "id", "k"))
        on = left.where("fate = 2")
        if on.isEmpty():
            break
        rows = _children(on.select("id", "k", "node", "late", "comp", F.col("c").alias("parent")).join(sets.select("id", "k", "mw"), ["id", "k"]))
    over = staged(_union(whole), "whole")
    return _union(leaves), None if over.isEmpty() else over, links


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _by_node(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole nodes of rows that come sorted by node, so many at a time as have about MANY_ROWS squared pairs; a node is
    never longer than a leaf, or two blocks."""

    def bounded(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node = rows["node"].to_numpy()
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        cost = np.diff(np.append(first, len(node))).astype(np.int64) ** 2
        part = (np.cumsum(cost) - cost) // MANY_ROWS**2
        for k in np.flatnonzero(np.append(True, part[1:] != part[:-1])):
            ends = np.flatnonzero(part > part[k])
            yield rows.iloc[first[k] : first[ends[0]] if len(ends) else len(node)]

    rest: pd.DataFrame | None = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        node = batch["node"].to_numpy()
        cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
        rest = batch.iloc[cut:].reset_index(drop=True)
        if cut:
            yield from bounded(batch.iloc[:cut])
    if rest is not None and len(rest):
        yield from bounded(rest)


def _pairs(node: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same node whose sizes allow the similarity, by distance in the order."""
    for d in range(1, len(node)):
        a = np.flatnonzero(node[d:] == node[:-d])
        if not len(a):
            return
        a = a[np.minimum(n[a], n[a + d]) >= threshold * np.maximum(n[a], n[a + d])]
        if len(a):
            yield a, a + d


def _estimated(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the sets with sketches x[a] and y[b]."""
    agree = np.concatenate([(x[a[i : i + 8192]] == y[b[i : i + 8192]]).mean(axis=1) for i in range(0, len(a), 8192)])
    return (agree - 1 / 256) / (1 - 1 / 256)


def _least_estimate(threshold: float) -> float:
    """The lowest estimate that keeps the rate of missed pairs below SKETCH_MISS, by the binomial tail of agreeing bytes."""
    p = threshold + (1 - threshold) / 256
    tail, agree = 0.0, 0
    while agree < MINWISE and (tail := tail + comb(MINWISE, agree) * p**agree * (1 - p) ** (MINWISE - agree)) < SKETCH_MISS:
        agree += 1
    return (agree / MINWISE - 1 / 256) / (1 - 1 / 256)


def _candidates(members: DataFrame, threshold: float) -> DataFrame:
    """Memberships of documents whose sketch comes near another one of the same leaf."""
    least = _least_estimate(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _by_node(batches):
            node, n = batch["node"].to_numpy(), batch["n"].to_numpy()
            sketch = np.frombuffer(b"".join(batch["sketch"]), dtype=np.uint8).reshape(-1, MINWISE)
            near = np.zeros(len(node), dtype=bool)
            for a, b in _pairs(node, n, threshold):
                ok = _estimated(sketch, a, sketch, b) >= least
                near[a[ok]] = near[b[ok]] = True
            yield batch.loc[near, ["id", "k", "node", "late"]]

    return members.mapInPandas(run, "id bigint, k bigint, node bigint, late boolean")


class _Connected:
    """Which of n places are connected so far."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[y] = x
        return x != y


def _star(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same connections as links of each id with the smallest one that it reaches."""
    ids = sorted({x for link in links for x in link})
    place = {x: k for k, x in enumerate(ids)}
    known = _Connected(len(ids))
    for x, y in links:
        known.join(*sorted((known.find(place[x]), known.find(place[y]))))
    return [(x, ids[known.find(k)]) for k, x in enumerate(ids) if known.find(k) != k]


def _links_of(a: list[int], b: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Of the pairs (a, b) of places in `sets`, the likeliest first, links that connect all that is similar.

    Pairs are looked at one by one while most of them are links or connected already. After MANY_PAIRS that were
    neither, what is left is counted all at once, where the sets are small enough for that."""
    known, out, failed = _Connected(len(sets)), [], 0
    small = sum(map(len, sets)) <= BLOCK_SHINGLES
    for at, (x, y) in enumerate(zip(a, b, strict=True)):
        if known.find(x) == known.find(y):
            continue
        if small and failed >= MANY_PAIRS:
            n = np.array([len(s) for s in sets])
            both = _shared(sets, sets)
            u, v = np.array(a[at:]), np.array(b[at:])
            ok = 100 * both[u, v] >= percent * (n[u] + n[v] - both[u, v])
            return out + [(x, y) for x, y in zip(u[ok].tolist(), v[ok].tolist(), strict=True) if known.join(x, y)]
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            known.join(x, y)
            out.append((x, y))
        else:
            failed += 1
    return out


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """Connections (u, v) by links that are confirmed on full sets: of each leaf what is similar in it, each document with
    the smallest id that links reach there."""
    threshold, least = percent / 100, _least_estimate(percent / 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _by_node(batches):
            node, n, ids = batch["node"].to_numpy(), batch["n"].to_numpy(), batch["id"].to_numpy()
            sketch = np.frombuffer(b"".join(batch["sketch"]), dtype=np.uint8).reshape(-1, MINWISE)
            sets = [np.frombuffer(s, dtype="<u8") for s in batch["hashes"]]
            maybe, out = [(np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32))], []
            for a, b in _pairs(node, n, threshold):
                e = _estimated(sketch, a, sketch, b)
                ok = e >= least
                maybe.append((e[ok].astype(np.float32), a[ok].astype(np.int32), b[ok].astype(np.int32)))
            e, a, b = (np.concatenate(x) for x in zip(*maybe, strict=True))
            order = np.lexsort((-e, node[a]))
            a, b = a[order], b[order]
            for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(node[a])) + 1):
                if len(own):
                    places, at = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
                    found = _links_of(at[: len(own)].tolist(), at[len(own) :].tolist(), [sets[k] for k in places], percent)
                    out += _star([(int(ids[places[x]]), int(ids[places[y]])) for x, y in found])
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return members.mapInPandas(run, "u bigint, v bigint")


def _full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Shingle hashes of the sets of the documents in `ids`, one row for each id and set, from whole texts. What is wanted
    of them is a join with (id, k). `ids` may repeat and is read twice."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, size, known).tobytes() for t in batch["_text"]]
            yield pd.DataFrame({"id": batch["id"], "fp": [xxhash.xxh3_128_hexdigest(x) for x in sets], "hashes": sets})

    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = ids.select("id").distinct()
    own = F.broadcast(own) if ids.count() <= BROADCAST_IDS or own.count() <= BROADCAST_IDS else own
    found = base.join(own, "id", "left_semi").mapInPandas(run, "id bigint, fp string, hashes binary")
    return found.select("id", F.xxhash64("fp").alias("k"), "hashes").dropDuplicates(["id", "k"])


def _block_pairs(over: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, side, id, k, n, comp) for each pair of blocks that has to be compared; a block with itself has side 0.

    Nodes whose documents reach the same smallest id over one node more are one family, all of whose documents are
    compared with each other but for pairs that the links found so far connect and pairs whose sizes are too different.
    Blocks hold one size class, in which a document can only be similar to those of its own and the two next classes; a
    component of more than LEAF documents of a class has blocks of its own, which are not compared with each other."""
    first = over.groupBy("node").agg(F.min("id").alias("_f"))
    reach = salted_lookup(over, first, "node", "id").groupBy("id").agg(F.min("_f").alias("_r"))
    placed = staged(over.join(reach, "id"), "reach")
    families = placed.groupBy("node").agg(F.min("_r").alias("fam"))
    members = salted_lookup(placed.drop("_r"), families, "node", "id").select("fam", "id", "k").distinct()
    step = max(float(np.log(100 / percent)), 1e-3) * (1 + 1e-6)  # never a ratio of sizes that is allowed over two classes
    rows = members.join(found.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").join(sets.select("id", "k", "n"), ["id", "k"])
    rows = rows.select("id", "k", "n", "fam", F.coalesce("comp", "id").alias("comp"), F.floor(F.log(F.col("n").cast("double")) / step).alias("cls"))
    rows = staged(rows, "families")
    several = rows.groupBy("fam").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select("fam")
    rows = rows.join(several, "fam")
    own = rows.groupBy("fam", "cls", "comp").agg(F.count("*").alias("c")).where(F.col("c") > LEAF).select("fam", "cls", "comp", F.lit(True).alias("own"))
    rows = rows.join(own, ["fam", "cls", "comp"], "left").withColumn("g", F.when(F.col("own"), F.col("comp")))
    sizes = rows.groupBy("fam", "cls", "g").agg(F.ceil(F.greatest(F.count("*") / LEAF, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    same = rows.alias("r").join(sizes.alias("s"), F.expr("r.fam = s.fam AND r.cls = s.cls AND r.g <=> s.g"))
    block = F.xxhash64("r.fam", "r.cls", F.col("r.g").isNull(), "r.g", F.pmod(F.xxhash64("r.id"), F.col("s.parts")))
    rows = staged(same.select("r.id", "r.k", "r.n", "r.comp", "r.fam", "r.cls", "r.g", block.alias("block")), "blocks")
    blocks = rows.select("fam", "cls", "g", "block").distinct()
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr("x.fam = y.fam AND x.block <= y.block AND abs(x.cls - y.cls) <= 1 AND NOT coalesce(x.g = y.g, false)"))
    sides = F.when(F.expr("x.block = y.block"), F.array(F.struct(F.lit(0).alias("side"), F.col("x.block").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x.block").alias("block")), F.struct(F.lit(1).alias("side"), F.col("y.block").alias("block"))))
    pairs = pairs.select(F.xxhash64("x.block", "y.block").alias("node"), F.inline(sides))
    return pairs.join(rows.select("id", "k", "n", "comp", "block"), "block").select("node", "side", "id", "k", "n", "comp")


def _sides(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """The rows of each pair of blocks, sorted by side, and the places of those on either side."""
    for batch in _by_node(batches):
        for _, one in batch.groupby("node", sort=False):
            one = one.reset_index(drop=True)
            cut = int(np.searchsorted(one["side"].to_numpy(), 1))
            yield one, np.arange(cut), np.arange(cut, len(one)) if cut < len(one) else np.arange(cut)


def _apart(one: pd.DataFrame, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b may be linked: not connected yet, and of sizes that allow the similarity."""
    n, comp = one["n"].to_numpy(), one["comp"].to_numpy()
    x, y = n[a][:, None], n[b][None, :]
    return (comp[a][:, None] != comp[b][None, :]) & (np.minimum(x, y) >= threshold * np.maximum(x, y))


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of a has in common with each set of b."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    every = [np.concatenate(s) if s else np.zeros(0, dtype="<u8") for s in (a, b)]
    keys = np.intersect1d(*every)
    placed = []
    for sets, values in zip((a, b), every, strict=True):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(keys, values)
        known = at < len(keys)
        known[known] = keys[at[known]] == values[known]
        order = np.argsort(at[known], kind="stable")
        placed.append((row[known][order], at[known][order]))
    for start in range(0, len(keys), 2048):
        dense = []
        for sets, (row, at) in zip((a, b), placed, strict=True):
            lo, hi = np.searchsorted(at, (start, start + 2048))
            m = np.zeros((len(sets), 2048), dtype=np.float32)
            m[row[lo:hi], at[lo:hi] - start] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _across(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Links (u, v) between documents of block pairs that nothing connected so far, confirmed on full sets."""
    threshold, least = percent / 100, _least_estimate(percent / 100)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one, a, b in _sides(batches):
            sketch = np.frombuffer(b"".join(one["sketch"]), dtype=np.uint8).reshape(-1, MINWISE)
            x, y = np.nonzero(_apart(one, a, b, threshold))
            keep = np.zeros(len(one), dtype=bool)
            if len(x):
                ok = _estimated(sketch, a[x], sketch, b[y]) >= least
                keep[a[x[ok]]] = keep[b[y[ok]]] = True
            yield one.loc[keep, ["node", "side", "id", "k", "n", "comp"]]

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one, a, b in _sides(batches):
            hashes = [np.frombuffer(s, dtype="<u8") for s in one["hashes"]]
            n, ids, comp = one["n"].to_numpy(), one["id"].to_numpy(), one["comp"].tolist()
            both = _shared([hashes[k] for k in a], [hashes[k] for k in b])
            x, y = np.nonzero(_apart(one, a, b, threshold) & (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)))
            root = {c: c for c in comp}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            out = []
            for i, j in zip(a[x].tolist(), b[y].tolist(), strict=True):
                u, v = find(comp[i]), find(comp[j])
                if u != v:
                    root[v] = u
                    out.append((ids[i], ids[j]))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    dealt = lambda df: df.repartition("node").sortWithinPartitions("node", "side", "id")
    left = dealt(pairs.join(sets.select("id", "k", "sketch"), ["id", "k"])).mapInPandas(near, "node bigint, side int, id bigint, k bigint, n bigint, comp bigint")
    left = staged(left, "apart")
    full = _full_sets(docs, left, id_col, text_col, size)
    return dealt(left.join(full, ["id", "k"])).mapInPandas(confirm, "u bigint, v bigint")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row for each input row: the id column, n_shingles, component_id and kept.

    A document's set holds its distinct shingles of `size` words (white-space words, A-Z lower-cased); shorter texts
    are one shingle; null texts and texts without words have an empty set and are linked with nothing. Documents are
    linked when their sets' Jaccard similarity is `percent` / 100 or more; component_id is the smallest id that links
    reach, kept says whether it is the row's own. Ids are of an integer type (others are refused); a document is known by
    its id, so rows with words that share one share their component, which the links of all their texts make; a null id is
    linked with nothing. Very long texts enter whole, and compare only with few others at a time; an empty table gives no rows;
    further columns are ignored.

    Rows of equal sets meet in one representative by a pre-aggregated minimum. Representatives are put into independent
    trees, whose nodes branch by minwise tokens of their choice. What shares a leaf and has near sketches is confirmed on
    full sets there, so no list of pairs is ever made: each leaf returns fewer links than it has documents. Leaves with the
    same members are compared once, and those of later trees only where the first ones left their documents apart; large
    nodes are settled by pivots before they branch, and compared whole, in pairs of blocks, if branching doesn't make them
    small, but for what is connected already.
    A pair at just the similarity 0.75 has no common child of a root in any tree once in 16 million, and once in 500 000
    if it has to stay together down to the last level; the filter of sketches misses fewer than 1 in 10 million."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col}: near_dedup needs integer ids")
    rows = staged(_documents(docs, id_col, text_col, size), "shingles")
    # rows of equal sets have the same values of all kinds
    sets = rows.where("fp is not null and _id is not null").groupBy("fp").agg(F.min("_id").alias("id"), *(F.any_value(c).alias(c) for c in ("n", "mw", "sketch")))
    sets = staged(sets.select("id", F.xxhash64("fp").alias("k"), "n", "fp", "mw", "sketch"), "sets")
    owners = sets.select("fp", "id")
    confirm = lambda pairs: _confirmed_pairs(staged(pairs, "pairs"), docs, id_col, text_col, size, percent)
    leaves, over, settled = _grown(sets, confirm, percent)
    looks = sets.select("id", "k", "n", "sketch")
    # without a number of partitions, so that Spark merges small ones: each costs a Python call, however few its rows
    dealt = lambda df: df.repartition("node").sortWithinPartitions("node", "id")
    near = staged(_candidates(dealt(leaves.join(looks, ["id", "k"])), percent / 100), "candidates")

    def links_in(near: DataFrame) -> DataFrame:
        # one leaf of those with the same members
        same = near.groupBy("node").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id", "k") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64("id", "k")).alias("x"))
        once = same.where("c > 1").groupBy("c", "s", "x").agg(F.min("node").alias("node")).select("node")
        near = staged(near.join(once, "node").select("id", "k", "node"), "compared")
        full = _full_sets(docs, near, id_col, text_col, size)
        return _confirmed(dealt(near.join(looks, ["id", "k"]).join(full, ["id", "k"])), percent)

    # an id with several texts links their sets
    several = rows.where("fp is not null and _id is not null").groupBy("_id").agg(F.min("fp").alias("_a"), F.max("fp").alias("_b")).where("_a <> _b").select("_id")
    links = rows.join(several, "_id").join(owners, "fp").select(F.col("_id").alias("u"), F.col("id").alias("v"))
    links = staged(links_in(near.where("not late")).union(links), "confirmed")
    found = components(links if settled is None else links.union(settled))
    # leaves of the other trees that hold documents which are still apart
    later = near.where("late").join(found.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    apart = later.groupBy("node").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select("node")
    more = staged(links_in(near.where("late").join(apart, "node")), "confirmed")
    if over is not None:
        pairs = _block_pairs(over, found, sets, percent)
        more = more.union(staged(_across(pairs, sets, docs, id_col, text_col, size, percent), "across"))
    found = found if more.isEmpty() else components(found.union(more))
    of_set = owners.join(found.select(F.col("u").alias("id"), F.col("v").alias("_c")), "id", "left").select("fp", F.coalesce("_c", "id").alias("_c"))
    # a row without a set has a key of its own that no set has
    keyed = rows.select("_id", "n", F.coalesce("fp", F.concat(F.lit("-"), F.col("_id").cast("string")), F.lit("-")).alias("fp"))
    out = salted_lookup(keyed, of_set, "fp", "_id")
    component = F.when(F.col("_id").isNull(), None).otherwise(F.coalesce("_c", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
