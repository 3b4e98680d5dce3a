"""Merkle manifest of a dataset with proofs (operator 12).

Every group of rows (a source) is a tree of ARITY over its leaves in order; the roots of the groups are the leaves of one more tree. A tree is stored
as blocks: aligned subtrees of HEIGHT levels whose digests lie in van Emde Boas order. A subtree is laid out as the upper
half of its levels and then, one after the other, the lower subtrees below it, each part in the same way; so a path from a leaf to the
root stays within few stretches of memory, whatever their size. The address of a node is arithmetic on its depth and place and serves both construction and the
retrieval of siblings. The roots of the blocks are the leaves of the next layer of blocks, until one block holds the whole tree.

Layers are tables of a row for each block, keyed by group and block number, so that a group with a third of all rows is many rows. Paths
go down from the last layer: a block hands each block below it the siblings on the way to the root.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, written

#: Children of a node, and levels of a block: 3 ** 5 = 243 leaves, at most 364 digests of 32 bytes.
ARITY, HEIGHT = 3, 5
SIZE = ARITY**HEIGHT
#: Bytes of leaves for each partition of the sort.
SHARD = 16_000_000
DIGEST = 32

BLOCK = "tree string, block long, nodes binary, n long, height int, root binary, n_tree long"
_BLOCK = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("nodes", pa.binary()), ("n", pa.int64()), ("height", pa.int32()), ("root", pa.binary()), ("n_tree", pa.int64())])


@functools.cache
def veb(height: int) -> tuple[np.ndarray, ...]:
    """Address of every node of a whole subtree: for each depth from the root (0) to the leaves (``height``), by place from left to right."""
    out = [np.zeros(ARITY**d, np.int64) for d in range(height + 1)]

    def lay(depth: int, place: int, levels: int, at: int) -> int:
        """Give addresses from ``at`` on to ``levels`` + 1 levels of nodes below (depth, place); the first address after them."""
        if levels == 0:
            out[depth][place] = at
            return at + 1
        upper = (levels - 1) // 2
        at = lay(depth, place, upper, at)
        below = depth + upper + 1
        for k in range(ARITY ** (upper + 1)):
            at = lay(below, place * ARITY ** (upper + 1) + k, levels - upper - 1, at)
        return at

    lay(0, 0, height, 0)
    return tuple(out)


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of the digests' lowercase hex texts, one after the other."""
    return hashlib.sha256("".join([x.hex() for x in parts]).encode()).digest()


def build(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(digests in van Emde Boas order, root) of an aligned subtree; places without a node hold zeros.

    A node is the digest of up to ARITY nodes below it, at every level, even of one alone.
    """
    at = veb(height)
    nodes = bytearray(DIGEST * (int(at[height].max()) + 1))
    level = leaves
    for depth in range(height, -1, -1):
        for place, x in zip(at[depth][: len(level)].tolist(), level):
            nodes[DIGEST * place : DIGEST * (place + 1)] = x
        if depth:
            level = [digest(level[k : k + ARITY]) for k in range(0, len(level), ARITY)]
    return bytes(nodes), level[0]


def siblings(nodes: bytes, n: int, height: int, leaf: int) -> list[tuple[list[bytes], list[bytes]]]:
    """From a stored block of ``n`` leaves: the digests left and right of the path from a leaf upwards, level by level."""
    at, out = veb(height), []
    for depth in range(height, 0, -1):
        lo = leaf - leaf % ARITY
        own = [nodes[DIGEST * a : DIGEST * (a + 1)] for a in at[depth][lo : min(lo + ARITY, n)].tolist()]
        out.append((own[: leaf - lo], own[leaf - lo + 1 :]))
        leaf, n = leaf // ARITY, -(-n // ARITY)
    return out


def pack(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """A path as bytes: for each level how many digests stand left and right, and these."""
    return b"".join(bytes([len(a), len(b), *b"".join(a + b)]) for a, b in path)


def unpack(data: bytes):
    at = 0
    while at < len(data):
        a, b = data[at], data[at + 1]
        own = [data[at + 2 + DIGEST * k : at + 2 + DIGEST * (k + 1)] for k in range(a + b)]
        at += 2 + DIGEST * (a + b)
        yield own[:a], own[a:]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for a, b in unpack(path):
        leaf = digest([*a, leaf, *b])
    return leaf


def proof(path: bytes) -> bytes:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest([x for a, b in unpack(path) for x in [*a, *b]])


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def ranked(leaves: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """``leaves`` (tree, ...) with ``place``: the number of each row within its tree in the order of ``order``, from 0, and ``n_tree``, the rows of its tree.

    Rows are sorted by range, so that a large tree is dealt over many tasks; the windows see one row for each tree of a task.
    """
    by = [F.col("tree").asc_nulls_first(), *order]
    dealt = leaves.repartitionByRange(shards, *by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumn("shard", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()), "merkle-sorted")
    counts = dealt.groupBy("tree", "shard").agg(F.min("k").alias("k0"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("tree").alias("t"), F.col("shard").alias("s"), "k0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(whole).alias("n_tree"))
    own = dealt.join(counts, dealt.tree.eqNullSafe(counts.t) & (dealt.shard == counts.s))
    return own.withColumn("place", F.col("k") - F.col("k0") + F.col("first")).drop("shard", "k", "k0", "first", "t", "s")


def block_layer(children: DataFrame) -> DataFrame:
    """Blocks (BLOCK) over ``children`` (tree, place, n_tree, leaf), written: a row for each run of up to ARITY ** HEIGHT of a tree.

    A tree whose children fit in one block ends in it, with as many levels as it needs; other blocks have HEIGHT levels.
    """
    own = children.groupBy("tree", F.floor(F.col("place") / SIZE).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "leaf"))).alias("own"), F.first("n_tree").alias("n_tree"))

    def run(batches):
        for batch in batches:
            out = []
            for tree, block, leaves, n_tree in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                height = HEIGHT if n_tree > SIZE else next(h for h in range(HEIGHT + 1) if ARITY**h >= n_tree)
                nodes, root = build(leaves, height)
                out.append((tree, block, nodes, len(leaves), height, root, n_tree))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_BLOCK)], schema=_BLOCK)

    return written(own.select("tree", "block", "own.leaf", "n_tree").mapInArrow(lean(run), BLOCK), "merkle-blocks")


def layers_of(children: DataFrame) -> list[DataFrame]:
    """Layers of blocks from the leaves up; in the last, every tree has one block, whose root is the tree's."""
    layers = [block_layer(children)]
    while layers[-1].where(F.col("n_tree") > SIZE).limit(1).count():
        up = layers[-1].where(F.col("n_tree") > SIZE)  # other trees have ended
        layers.append(block_layer(up.select("tree", F.col("block").alias("place"), F.ceil(F.col("n_tree") / SIZE).alias("n_tree"), F.col("root").alias("leaf"))))
    return layers


def ending(layer: DataFrame) -> DataFrame:
    """The blocks of a layer that hold the root of their tree."""
    return layer.where(F.col("n_tree") <= SIZE)


def roots_of(layers: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree, from the layer in which it ends."""
    return functools.reduce(DataFrame.unionByName, [ending(x).select("tree", "root") for x in layers])


def with_blocks(layer: DataFrame, above: DataFrame) -> DataFrame:
    """The blocks of ``layer`` with the ``path`` above each, from ``above`` (tree, block, path)."""
    own = layer.alias("l").join(above.alias("a"), F.col("l.tree").eqNullSafe(F.col("a.tree")) & (F.col("l.block") == F.col("a.block")))
    return own.select("l.tree", "l.block", "l.nodes", "l.n", "l.height", "a.path")


def paths_to_blocks(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, block, path) of every block of the first layer: all siblings above it, layer by layer from the last down; ``tops`` (tree, path): those above each tree's root."""

    def run(batches):
        for batch in batches:
            for tree, block, nodes, n, height, rest in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                paths = [pack(siblings(nodes, n, height, k)) + rest for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), pa.array(np.arange(n) + block * SIZE), pa.array(paths, pa.binary())], names=["tree", "block", "path"])

    above = None
    for k in range(len(layers) - 1, -1, -1):
        own = ending(layers[k]).select(F.col("tree").alias("t"), "block").join(tops, F.col("t").eqNullSafe(tops.tree)).select(tops.tree, "block", "path")
        above = own if above is None else own.unionByName(with_blocks(layers[k + 1], above).mapInArrow(lean(run), "tree string, block long, path binary"))
    return above


def leaf_paths(leaves: DataFrame, layer: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns and ``path`` of every leaf: leaves meet their stored block as one packed row, and siblings are read at their addresses."""
    packed = leaves.groupBy("tree", F.floor(F.col("place") / SIZE).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*carried).alias("row")))).alias("own"))
    own = packed.alias("p").join(with_blocks(layer, above).alias("b"), F.col("p.tree").eqNullSafe(F.col("b.tree")) & (F.col("p.block") == F.col("b.block")))

    def run(batches):
        for batch in batches:
            for k, (nodes, n, height, rest) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(1, 5)])):
                rows = batch.column(0).slice(k, 1).flatten()
                paths = pa.array([pack(siblings(nodes, n, height, i)) + rest for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.flatten(), paths], names=[*carried, "path"])

    schema = ", ".join(f"{c} {t}" for c, t in leaves.select(*carried).dtypes)
    return own.select("p.own.row", "b.nodes", "b.n", "b.height", "b.path").mapInArrow(lean(run), f"{schema}, path binary")


class Manifest:
    """The stored trees of a dataset: ``leaves`` (tree, place, leaf and what they carry), layers of blocks of the groups' trees and of the tree over their roots, and ``root`` (one row)."""

    def __init__(self, leaves: DataFrame, order: list[Column]):
        """``leaves``: tree (string, null allowed), leaf (32 bytes) and the columns of ``order``, by which a tree's leaves are sorted."""
        shards = lambda df: max(1, df.count() * 100 // SHARD)
        self.leaves = written(ranked(leaves, order, shards(leaves)), "merkle-leaves")
        self.layers = layers_of(self.leaves)
        self.subroots = written(roots_of(self.layers), "merkle-roots")
        names = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
        self.tops = written(ranked(names, [F.col("name").asc_nulls_first()], shards(names)), "merkle-tops")
        self.top_layers = layers_of(self.tops)
        self.root = roots_of(self.top_layers).select("root")

    def proofs(self, carried: list[str]) -> DataFrame:
        """``carried`` columns of the leaves with subroot, root and path (see :func:`pack`): siblings are read from the stored blocks."""
        start = self.leaves.sparkSession.createDataFrame([("", bytearray())], "tree string, path binary")
        above = paths_to_blocks(self.top_layers, start)
        tops = written(leaf_paths(self.tops, self.top_layers[0], above, ["name"]).select(F.col("name").alias("tree"), "path"), "merkle-tops")
        out = leaf_paths(self.leaves, self.layers[0], paths_to_blocks(self.layers, tops), ["tree", *carried])
        sub = self.subroots.select(F.col("tree").alias("t"), F.col("root").alias("subroot"))
        return out.join(sub, out.tree.eqNullSafe(sub.t)).drop("t").crossJoin(F.broadcast(self.root))  # one row


def manifest_of(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text): a leaf for every row, groups by source, leaves by doc_id.

    Nulls of every column are leaves' values of their own; a null source is a group and comes first; a null doc_id comes first within its group. Rows of equal
    doc_id stand by their digests, so that repeated rows and any order of reading give the same root. An empty table has no root. Other columns are not read.
    ``leaf_edited`` is the digest of the row without line feeds in its text where 2 divides the crc32 of the doc_id, else null.
    """
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    edited = F.when(tampered, F.when(text.contains("\n"), row_digest(*head, F.replace(text, F.lit("\n"), F.lit("")))))
    leaves = docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(*head, text).alias("leaf"), edited.alias("leaf_edited"))
    return Manifest(written(leaves, "merkle-digests"), [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()])


def verified(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every leaf: the root folded from the edited leaf, or the leaf itself, and its stored siblings."""

    def run(batches):
        for batch in batches:
            leaf, edited, path, root = (batch.column(k).to_pylist() for k in (1, 2, 3, 5))
            folded = [fold(e or x, p) for x, e, p in zip(leaf, edited, path)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), batch.column(5), pa.array([proof(p) for p in path], pa.binary()), pa.array(folded, pa.binary()), pa.array([a == b for a, b in zip(folded, root)])],
                names=["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"],
            )

    own = manifest.proofs(["doc_id", "leaf", "leaf_edited"]).select("doc_id", "leaf", "leaf_edited", "path", "subroot", "root")
    return own.mapInArrow(lean(run), "doc_id long, leaf binary, subroot binary, root binary, proof binary, folded_root binary, verified boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: leaf, group root, root, digest of the proof and the root folded from the tampered row, of every document."""
    found = verified(manifest_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    text = lambda c, name=None: F.lower(F.hex(c)).alias(name or c)
    return found.select("doc_id", text("leaf"), text("subroot"), text("root"), text("proof", "proof_sha256"), text("folded_root"), "verified")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 1, 2, 3, 4, 5, 6, 7]), lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END))) END AS h
  FROM documents),
e AS (SELECT *, CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS edited,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(edited) || ':' || edited, '-')) AS tampered FROM e),
s AS (SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source FROM l)),
v AS (SELECT l.*, s.t, row_number() OVER (PARTITION BY s.t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
nodes(t, lvl, i, x, n) AS (
  SELECT t, 0, place, leaf, count(*) OVER (PARTITION BY t) FROM v
  UNION ALL
  SELECT t, lvl + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY t, lvl, i // 3),
height AS (SELECT t, max(lvl) AS h FROM nodes GROUP BY t),
tops(lvl, i, x, n) AS (
  SELECT 0, nodes.t, x, count(*) OVER () FROM nodes JOIN height ON nodes.t = height.t AND nodes.lvl = height.h
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (max(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, i // 3),
beside AS (
  SELECT a.t, a.lvl, a.i, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.t = b.t AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.t, a.lvl, a.i),
beside_top AS (
  SELECT a.lvl, a.i, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.lvl, a.i),
fold(t, place, lvl, i, x, proof) AS (
  SELECT t, place, 0, place, tampered, '' FROM v
  UNION ALL
  SELECT f.t, f.place, f.lvl + 1, f.i // 3, sha256(before || x || after), proof || before || after FROM fold f JOIN beside b ON f.t = b.t AND f.lvl = b.lvl AND f.i = b.i),
folded AS (SELECT fold.* FROM fold JOIN height ON fold.t = height.t AND fold.lvl = height.h),
fold_top(t, place, lvl, i, x, proof) AS (
  SELECT t, place, 0, t, x, proof FROM folded
  UNION ALL
  SELECT f.t, f.place, f.lvl + 1, f.i // 3, sha256(before || x || after), proof || before || after FROM fold_top f JOIN beside_top b ON f.lvl = b.lvl AND f.i = b.i),
last AS (SELECT max(lvl) AS h FROM tops),
root AS (SELECT x FROM tops, last WHERE lvl = h)
SELECT v.doc_id, v.leaf, nodes.x AS subroot, root.x AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = root.x AS verified
FROM v JOIN height ON v.t = height.t JOIN nodes ON v.t = nodes.t AND nodes.lvl = height.h JOIN last ON true JOIN root ON true
JOIN fold_top f ON f.t = v.t AND f.place = v.place AND f.lvl = last.h
"""
