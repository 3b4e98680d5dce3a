"""Jaccard join of word shingles with a count-vector R-tree (operator 8).

A document is the set of its shingles of five words. Shingle hashes fall into GROUPS groups; the numbers in the groups are
a point, and the overlap of two sets is at most the sum of the smaller coordinates. Sets that reach the threshold share
one of the first n - ceil(0.8 n) + 1 shingles in any common order; here rare ones (by a sketch of counts over all
documents) come first. Documents that share such a shingle form a tile; in a tile an R-tree over the points finds the pairs
whose bound suffices, and these are verified on the whole sets. Equal sets are one node from the start.

Components need no pair within what is already linked: two rounds link the members of each tile to one or a few of
them, and only then the trees search the pairs that are left between components, all of them.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD, blocks, drop, lean, mix64, ragged, span_hashes, utf8, with_row, words, written
from .components import components

SHINGLE = 5
GROUPS = 512
#: Counters of the sketch that orders shingles by frequency: a fixed size, 4 MB.
SKETCH = 1 << 20
PIECES = 16
#: Bytes of text that are hashed together (about 40 times as many in working arrays).
BLOCK = 1 << 20
#: Partial pieces of the sketch that one task adds up.
MERGE = 256
#: Prefix entries (8 bytes) that one shard holds, about.
SHARD = 1_000_000
#: Places of a set that a prefix entry tells apart, rounded down: those of a prefix, the first fifth, fit into a byte.
PLACES = 1024
#: Nodes (16 bytes each) whose texts are found by a broadcast; more are joined by shuffle.
BROADCAST_NODES = 500_000
#: Rows of tiles that one task of the tree round gets, about.
TREE_ROWS = 25_000
#: Points of a leaf or children of an inner node of the R-tree.
FANOUT = 32
#: Members of a tile that all its members are held against, in the first and the second round.
PIVOTS = (1, 4)
#: Members of a tile that one tree holds; larger tiles are split and their parts joined pair by pair.
TILE = 4096
_ODD = mix64(np.arange(11, 11 + SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the rows (with repeats) and the row of each."""
    buf, offs = utf8(texts)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends, first = words(buf, offs)
    codes = span_hashes(LOWER[buf], starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(first[1:], n) - np.arange(len(codes))  # words from here to the end of the row
    at = np.flatnonzero((left >= SHINGLE) | ((left == n[row]) & (n[row] < SHINGLE)))
    found = np.zeros(len(at), np.uint64)
    padded = np.append(codes, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        found += np.where(left[at] > k, padded[at + k] * _ODD[k], np.uint64(0))
    return mix64(found + np.minimum(left[at], SHINGLE).astype(np.uint64) * _ODD[SHINGLE]), row[at]


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of shingles by the low bits of their hashes, over all documents. PIECES rows reach the driver, whatever the input."""
    size = SKETCH // PIECES

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for a, b in blocks(batch.column(0), BLOCK):
                h, _ = shingles(batch.column(0)[a:b])
                total += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        parts = [zlib.compress(total[k * size : (k + 1) * size].tobytes(), 1) for k in range(PIECES)]
        slot = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([slot] * PIECES, pa.int64()), pa.array(parts, pa.binary())], names=["piece", "slot", "data"])

    def add(own: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for x in own["data"]:
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"piece": own["piece"].iloc[:1], "slot": own["slot"].iloc[:1] // MERGE, "data": [zlib.compress(total.tobytes(), 1)]})

    parts = docs.select("text").mapInArrow(lean(run), "piece int, slot long, data binary")
    left = docs.rdd.getNumPartitions()
    while True:  # a tree of sums: no task adds more than MERGE partial pieces
        parts = parts.groupBy("piece", F.floor(F.col("slot") / MERGE)).applyInPandas(add, "piece int, slot long, data binary")
        left = -(-left // MERGE)
        if left <= 1:
            break
    out = np.zeros(SKETCH, np.int64)
    for r in parts.collect():
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(zlib.decompress(r["data"]), np.int64)
    return out


def sets(texts: pa.Array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, each row's in order of frequency class and hash, and where rows begin (n + 1)."""
    h, row = shingles(texts)
    key = row * 64 + order[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
    by = np.lexsort((h, key))
    h, row = h[by], row[by]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], np.searchsorted(row[new], np.arange(len(texts) + 1))


def node_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each row's set; 0 for the empty set."""
    n = np.diff(at)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix64(h), out=sums[1:])
    return np.where(n > 0, mix64(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64) * _ODD[0]), np.uint64(0))


def six(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, as six bytes."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def leads(h: np.ndarray, at: np.ndarray, prefix: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place in ``h`` of each row's lead: the first shingle of the frequency class that most of its prefix has. Near copies mostly have the same."""
    row = np.repeat(np.arange(len(prefix)), prefix)
    kind = order[(h[ragged(at[:-1], prefix)] & np.uint64(SKETCH - 1)).astype(np.int64)]
    counts = np.bincount(row * 64 + kind, minlength=64 * len(prefix)).reshape(-1, 64)
    before = np.cumsum(counts, axis=1) - counts
    return at[:-1] + before[np.arange(len(prefix)), counts.argmax(axis=1)]


def describe(docs: DataFrame, order: np.ndarray, shards: int) -> DataFrame:
    """A row for each document (shard -1: doc_id, mark (a hash of its text), n, node, point) and rows of packed prefix entries for the shards of the index.

    node: hash of the set (64 bits, with its size; among a thousand million distinct sets about 0.03 pairs collide); 0 for the empty set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order.astype(np.int64))

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                h, at = sets(batch.column(1)[a:b], shared.value)
                n = np.diff(at)
                row = np.repeat(np.arange(b - a), n)
                node = node_of(h, at)
                points = np.bincount(row * GROUPS + (h >> np.uint64(64 - 9)).astype(np.int64), minlength=(b - a) * GROUPS).astype("<u4").reshape(-1, GROUPS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1] * (b - a), pa.int32()), batch.column(0)[a:b], batch.column(2)[a:b], pa.array(n), pa.array(node.view(np.int64)), pa.array([zlib.compress(p.tobytes(), 1) for p in points], pa.binary())],
                    names=["shard", "doc_id", "mark", "n", "node", "data"],
                )
                prefix = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                once = np.zeros(b - a, bool)
                once[np.unique(node, return_index=True)[1]] = True  # a set once in each block
                pick = np.flatnonzero((np.arange(len(h)) - at[row] < prefix[row]) & once[row])
                lead = leads(h, at, prefix, shared.value)
                shard = (mix64(h[pick]) % np.uint64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                pick, cut = pick[by], np.searchsorted(shard[by], np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cut))
                data = []
                for x in used:
                    own = pick[cut[x] : cut[x + 1]]
                    first = np.flatnonzero(np.r_[True, row[own][1:] != row[own][:-1]])
                    of = row[own[first]]
                    place = np.where(own == lead[row[own]], 0, (own - at[row[own]]) * PLACES // n[row[own]]).astype(np.uint8)
                    data.append(pickle.dumps((node[of], np.diff(np.r_[first, len(own)]).astype(np.uint32), n[of].astype(np.uint32), six(h[lead[of]]), place.tobytes(), six(h[own])), 5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.array(np.diff(cut)[used]), pa.nulls(len(used), pa.int64()), pa.array(data, pa.binary())],
                    names=["shard", "doc_id", "mark", "n", "node", "data"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return own.mapInArrow(lean(run), "shard int, doc_id long, mark long, n long, node long, data binary")


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def partnered(first: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """True for rows with a partner in their run (``first``: where runs begin): two sets of ``n`` shingles whose first common one has ``rest`` from it on.

    Their overlap is at most the smaller rest, and a Jaccard index of 0.8 requires 9 x overlap >= 4 x (both sizes): the size of
    each is at most the reach of the other. Rows in order of size, the two largest reaches up to a place tell whether one is enough.
    """
    if not len(n):
        return np.zeros(0, bool)
    reach = (9 * rest - 4 * n) // 4
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(n)]))
    by = np.lexsort((n, run))  # runs stay where they are
    size, reach = n[by], reach[by]
    base = run * (max(int(size.max()), int(reach.max())) + 1)
    largest = np.maximum.accumulate(base + reach)
    loser = np.minimum(reach, np.r_[0, largest[:-1]] - base)
    second = np.maximum.accumulate(base + np.maximum(loser, 0))
    last = np.searchsorted(base + size, base + reach, "right") - 1
    inside = last >= first[run]
    best = np.where(size <= reach, second[last], largest[last]) - base  # a row is no partner of its own
    out = np.zeros(len(n), bool)
    out[by] = inside & (best >= size)
    return out


def shared_prefixes(entries: DataFrame) -> DataFrame:
    """(tile, node): the nodes of each prefix shingle (48 bits of its hash) that at least two nodes have. The number of shards follows the number of entries.

    A tile is named by a hash of its set of nodes, so that shingles of the same nodes - those of a passage that they share - make one
    tile, once in each shard. As shards grow in number with the input, so would these repeats. A tile therefore has only the nodes that
    have a partner in it (:func:`partnered`), and nodes that all have the same lead are left to the tile of that one. Neither loses a
    pair: a linked pair stays in the tile of the first shingle that both sets have, or in that of their common lead, where each has
    place 0 and which is not left to another.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for v in own["data"]:
            node, k, n, lead, place, high = pickle.loads(v)
            parts.append((from_six(high), np.repeat(node, k), np.frombuffer(place, np.uint8), np.repeat(n, k), np.repeat(from_six(lead), k)))
        key, node, place, n, lead = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((place, node, key))
        x, y = key[by], node[by]
        by = by[np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]]  # of shingles with the same 48 bits the earlier place
        x = key[by]
        same = x[1:] == x[:-1]
        by = by[np.r_[same, False] | np.r_[False, same]]
        n = n[by].astype(np.int64)
        by = by[partnered(starts_of(key[by]), n, n + -place[by].astype(np.int64) * n // PLACES)]
        if not len(by):
            return pd.DataFrame({"tile": np.zeros(0, np.int64), "node": np.zeros(0, np.int64)})
        key, node, lead = key[by], node[by], lead[by]
        first = starts_of(key)
        size = np.diff(np.r_[first, len(key)])
        name = mix64(np.add.reduceat(mix64(node), first) + size.astype(np.uint64))
        least = np.minimum.reduceat(lead, first)
        stay = np.flatnonzero((least != np.maximum.reduceat(lead, first)) | (least == key[first]))
        once = np.zeros(len(first), bool)
        once[stay[np.unique(name[stay], return_index=True)[1]]] = True
        rows = np.repeat(once, size)
        return pd.DataFrame({"tile": np.repeat(name, size)[rows].view(np.int64), "node": node[rows].view(np.int64)})

    return entries.groupBy("shard").applyInPandas(lean(run), "tile long, node long").distinct()


def unfold(points) -> np.ndarray:
    """Points (rows of GROUPS counts) from their stored form."""
    return np.stack([np.frombuffer(zlib.decompress(p), "<u4") for p in points]).astype(np.int32)


class CountTree:
    """R-tree over count vectors, bulk-loaded: points sorted by size and then dealt by coordinate sums into leaves of FANOUT.

    A node keeps the largest count of each group and the least size below it; a query goes down wherever
    9 x (sum of the smaller counts) >= 4 x (both sizes) can still hold, which a Jaccard index of 0.8 requires.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((points[:, : GROUPS // 2].sum(axis=1), sizes))
        level = (points[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[0]) > FANOUT:
            first = np.arange(0, len(level[0]), FANOUT)
            level = (np.maximum.reduceat(level[0], first, axis=0), np.minimum.reduceat(level[1], first))
            self.levels.append(level)

    def search(self, sizes: np.ndarray, points: np.ndarray, together: int = 4_000):
        """Yields arrays (query, point) whose bound suffices."""
        for a in range(0, len(sizes), max(1, together // FANOUT)):
            q = np.arange(a, min(len(sizes), a + max(1, together // FANOUT)))
            top = len(self.levels[-1][0])
            query, node = np.repeat(q, top), np.tile(np.arange(top), len(q))
            for depth in range(len(self.levels) - 1, -1, -1):
                high, least = self.levels[depth]
                found = [np.zeros(0, np.int64)]
                for k in range(0, len(query), together):
                    u, v = query[k : k + together], node[k : k + together]
                    bound = np.minimum(points[u], high[v]).sum(axis=1, dtype=np.int64)
                    found.append(k + np.flatnonzero(9 * bound >= 4 * (sizes[u] + least[v])))
                keep = np.concatenate(found)
                query, node = query[keep], node[keep]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    query = np.repeat(query, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
                    query, node = query[node < below], node[node < below]
            yield query, self.order[node]


def tree_pairs(tiles: DataFrame, points: DataFrame, buckets: int) -> DataFrame:
    """(a, b), a > b: pairs of different components whose bound suffices, from an R-tree for each tile or pair of parts of a large tile.

    ``tiles``: tile, node, component, n; ``points``: node, point - only tiles of several components get theirs.
    """
    counts = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1")
    parts = F.ceil(F.col("members") / TILE).cast("int")
    own = tiles.join(counts.select("tile", parts.alias("parts")), "tile").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.join(points, "node").withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("tile", "i", "j"), F.lit(buckets)))

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for (_, i, j), g in mine.groupby(["tile", "i", "j"], sort=False):
            node, comp, n, part = (g[c].to_numpy() for c in ("node", "component", "n", "part"))
            points = unfold(g["point"])
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            if not len(left) or not len(right):
                continue
            tree = CountTree(n[right], points[right])
            for u, v in tree.search(n[left], points[left]):
                u, v = left[u], right[v]
                keep = (comp[u] != comp[v]) & ((node[u] > node[v]) | (i != j))
                pairs = np.stack([np.maximum(node[u], node[v]), np.minimum(node[u], node[v])], axis=1)[keep]
                out.append(pairs)
        found = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return own.select("bucket", "tile", "i", "j", "part", "node", "component", "n", "point").groupBy("bucket").applyInPandas(lean(run), "a long, b long").distinct()


def enough(n_a: Column, n_b: Column) -> Column:
    return F.greatest(n_a, n_b) * 4 <= F.least(n_a, n_b) * 5


def within_bound(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points bound the overlap well enough, as at a leaf of the tree."""

    def run(batches):
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = []
            for k in range(0, batch.num_rows, 2000):
                x, y = (unfold(batch.column(c)[k : k + 2000].to_pylist()) for c in (4, 5))
                keep.append(9 * np.minimum(x, y).sum(axis=1) >= 4 * (n_a[k : k + 2000] + n_b[k : k + 2000]))
            keep = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(lean(run), "a long, b long")


def remake(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of all nodes of ``pairs``, made again from the text of a document of each."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = written(nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("_d"), F.col("node").alias("_node")), "asked")
    if asked.count() <= BROADCAST_NODES:
        asked = F.broadcast(asked)
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_d"))).select("_node", "text")

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                h, at = sets(batch.column(1)[a:b], np.zeros(SKETCH, np.int64))
                # Documents of one id may differ: the node tells which is meant.
                keep = np.flatnonzero(node_of(h, at).view(np.int64) == batch.column(0)[a:b].to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(keep)), pa.array([h[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(lean(run), "node long, shingles binary")


def verify(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets in ``found`` (node, n, shingles) have 100 x intersection >= 80 x union."""
    left = found.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = found.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]))
                i = int((both[1:] == both[:-1]).sum())
                if 100 * i >= 80 * (len(both) - i):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, component) of each row of ``docs`` (doc_id, text without nulls): its set's size and a number of its component; 0 for empty sets."""
    counts = sketch(docs)
    order = np.ceil(np.log2(counts + 1)).astype(np.int64)
    entries = int(counts.sum()) // 5
    described = written(describe(docs, order, max(1, entries // SHARD)), "described")
    own = described.where("shard = -1")
    rows = written(own.select("doc_id", "mark", "n", "node"), "rows")
    nodes = written(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("data").alias("point")), "nodes")
    tiles = written(shared_prefixes(described.where("shard >= 0").select("shard", "data")).join(nodes.select("node", "n"), "node"), "tiles")
    drop(described)
    links, label, tested, passing = None, None, None, []
    for turn in range(3):
        if label is None:
            own = tiles.withColumn("component", F.col("node"))
        else:
            own = tiles.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn < 2:
            # Every member of a tile against some of them.
            by = lambda k: F.struct(F.xxhash64("node", F.lit(8 * turn + k)).alias("r"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"))  # noqa: E731, B023
            pivot = own.groupBy("tile").agg(F.array(*[F.min(by(k)) for k in range(PIVOTS[turn])]).alias("p")).select("tile", F.explode("p").alias("p")).select("tile", "p.b", "p.cb", "p.nb")
            pairs = own.join(pivot, "tile").where((F.col("component") != F.col("cb")) & enough(F.col("n"), F.col("nb")))
            pairs = pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        else:
            pairs = tree_pairs(own, nodes.select("node", "point"), max(1, tiles.count() // TREE_ROWS))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(within_bound(pairs, nodes) if turn < 2 else pairs, "pairs")
        found = written(remake(docs, pairs, nodes), "sets")
        linked = written(verify(pairs, found), "verified")
        drop(found)
        passing += [pairs, linked]
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = linked if links is None else links.unionByName(linked)
        label = written(components(links, 1 if turn == 0 else None), "labels")
    out = rows.join(label, "node", "left").select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.lit(0)).alias("component"))
    out = written(out, "labelled")
    drop(rows, nodes, tiles, label, *passing)
    return out


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text): the smallest doc_id that links reach.

    Null and empty texts have no shingles and are linked with nothing; their component are themselves. Rows of equal sets are
    linked. A null doc_id counts as largest; a component of null doc_ids alone has a null component_id. An empty table gives no
    rows; very long texts are one set like others; other columns are not read.
    """
    rows = labelled(plain(docs))
    least = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    out = rows.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id (null last; of these that with the least hash of its text).

    Documents without shingles stay, all of them. Rows of equal doc_id and text are one document, of which one row stays; rows of equal
    doc_id and different texts are documents of their own.
    """
    key = lambda doc_id: F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))
    rows = labelled(plain(docs)).where("n > 0")
    rows = rows.select(key(F.col("doc_id")).alias("d"), F.col("mark").alias("m"), "component").distinct()
    first = rows.groupBy("component").agg(F.min(F.struct("d", "m")).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    gone = rows.join(first, "component").where("struct(d, m) <> first").select("d", "m")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = with_row(docs, d=key(F.col("doc_id")), m=F.xxhash64(text), empty=~F.exists(F.split(text, f"[{WORD[2:-2]}]+", 3), lambda w: w != ""))
    kept = own.join(gone, ["d", "m"], "left_anti")
    again = kept.where(~F.col("empty")).groupBy("d", "m").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("d", "m")
    once = kept.where(~F.col("empty")).join(again, ["d", "m"], "left_semi").dropDuplicates(["d", "m"])
    return kept.join(again, ["d", "m"], "left_anti").unionByName(once).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: size of each document's set and its component."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.g FROM s JOIN shared USING (g)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach(doc_id, seen) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.seen = links.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, t.doc_id) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, min(seen) AS least FROM reach GROUP BY doc_id) m ON m.doc_id = t.doc_id
"""
