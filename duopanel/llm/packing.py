"""Best-fit packing of documents into token sequences (operator 7).

Sizes are whole numbers up to the capacity, so documents and gaps fall into at most ``capacity`` size
classes. A round of the bulk-synchronous match takes the documents of a class in order of rank and the gaps
in order of size; the successor of the class among the gaps is found first, rank decides which documents
get which gaps, the gaps shrink, and the next round follows. The rounds need only the number of pieces of
each class (at most ``capacity`` integers); Spark counts them, ranks the pieces of each class across all
tasks and places every piece by a join of its rank with the intervals that the rounds have matched.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, lean, written
from .tokens import memory, vocabulary

CAPACITY = 1024
#: Pieces that one window partition ranks, about: a class of many pieces is split into as many buckets as it needs.
BUCKET = 50_000
#: Bytes of text that are tokenized together (about 50 times as many in working arrays).
BLOCK = 1 << 20


def tokenize_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32. Null text is empty: only the end id.

    A document of more than ``capacity`` ids is cut into pieces of ``capacity``, of which the first may be shorter.
    Rows with equal doc_id are documents of their own.
    """

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                ids, at = memory(path).encode(batch.column(1)[a:b])
                n = np.diff(at) + 1
                own = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                pieces = (n + capacity - 1) // capacity
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = n - (pieces - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                whole = (np.cumsum(n) - n)[row] + start
                raw = memoryview(own.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + k)]) for x, k in zip(whole.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def match_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over size classes: (length, first rank, last rank + 1, first sequence, offset).

    Longer classes come first. Gaps are ranges of sequences of one gap size. In a round the gaps of the smallest
    sufficient size go to the next documents by rank; when none suffices, new sequences are opened, each to be filled
    with as many of the class as fit. At most one range is split and one opened for each class, so that
    there are at most 2 x capacity ranges.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size: ranges (first sequence, number)
    sizes: list[int] = []  # gap sizes in order
    opened, plan = 0, []

    def give(size: int, first: int, n: int) -> None:
        if not size or not n:
            return
        if size not in gaps:
            bisect.insort(sizes, size)
            gaps[size] = []
        gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                n = -(-left // (capacity // length))
                give(capacity, opened, n)
                opened += n
                continue
            size = sizes[k]
            first, n = gaps[size].pop()
            take = min(n, left)
            if take < n:
                gaps[size].append((first + take, n - take))
            if not gaps[size]:
                del gaps[size]
                del sizes[k]
            plan.append((length, rank, rank + take, first, capacity - size))
            give(size - length, first, take)
            rank, left = rank + take, left - take
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, more columns) with sequence_id and offset; 0 < length <= capacity.

    ``pieces`` must not change between reads (a written table). Ranks: pieces of a class are dealt into buckets by a
    hash of the whole row, counted, and numbered within bucket and class, so that a class that holds most pieces is
    ranked by many tasks. The joined intervals are at most a few thousand rows whatever the number of pieces.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = match_rounds(counts, capacity)
    intervals = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, rank_from long, rank_to long, first long, offset long")
    n_buckets = max(1, -(-sum(counts.values()) // BUCKET))
    own = [c for c in pieces.columns]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*own), F.lit(n_buckets)))
    sums = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy(*own)
    ranked = dealt.withColumn("_k", F.row_number().over(within) - 1).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_k"))
    placed = ranked.join(F.broadcast(intervals), (ranked["length"] == intervals["length"]) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    return placed.select(*[ranked[c] for c in own], (F.col("first") + F.col("_rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row for each piece. An empty table gives no rows."""
    return pack(written(tokenize_pieces(docs, path, end_id, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: place of every piece of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))
