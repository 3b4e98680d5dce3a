"""Token counts of whole texts without their ids (operator 13).

A text's tokens are the sum, over its distinct pre-tokens, of frequency times pieces. One pass packs the frequencies of about BLOCK
bytes of documents into a row: the distinct pre-tokens of the block, and for each document which of them it has and how often.
The pre-tokens of all blocks are dealt and sorted by themselves, so that equal ones are neighbours and each distinct one is split into pieces once;
the numbers of pieces go back to their blocks as packed arrays, and a product of frequencies and pieces gives the counts. So a pre-token is shuffled
once for each block, not once for each document, and ids are never made.

Pre-tokens that are entries of the vocabulary and one piece by themselves (at most as many as it has) need no join: they are counted as
one where they are met. That also takes the pre-tokens that are frequent everywhere out of the join.

The library's own normalizer and pre-tokenizer run on each distinct part of a block (see :mod:`tokens` for the cuts). Parts that hold the
string of an added token are units of their own, counted as the library encodes them, special tokens included.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, first_equal, lean, ragged, utf8, written
from .tokens import _cuts, _decoded, vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text in a block.
BLOCK = 8 << 20
#: Tokens beyond which a document is over the limit.
LIMIT = 1024
#: Before a unit that is a whole part: a blank, which no pre-token holds as such (blanks are mapped to other characters).
WHOLE = " "
_known: dict[str, Splitter] = {}

#: Numbers of pieces that a task packs by block at once.
CHUNK = 1_000_000

PACKED = "block long, doc_id array<long>, n_bytes array<long>, ones array<long>, units array<string>, n_units long, kinds binary, unit binary, n binary"


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte (all low bytes first), deflated."""
    return pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def numbers(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Splitter:
    """Pre-tokens of parts and pieces of pre-tokens, by a file of the tokenizers library; one for each file in a Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        added = set(self.added)
        self.one = {v for v in self.tokenizer.get_vocab() if v not in added and len(self.tokenizer.model.tokenize(v)) == 1}

    def units(self, part: str) -> list[str]:
        """Pre-tokens of a part in the characters of the model, or the part itself after WHOLE."""
        if any(x in part for x in self.added):
            return [WHOLE + part]
        if self.tokenizer.normalizer is not None:
            part = self.tokenizer.normalizer.normalize_str(part)
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]

    def pieces(self, unit: str) -> int:
        if unit.startswith(WHOLE):
            return len(self.tokenizer.encode(unit[len(WHOLE) :], add_special_tokens=False).ids)
        return len(self.tokenizer.model.tokenize(unit))


def splitter(path: str) -> Splitter:
    if path not in _known:
        _known[path] = Splitter(path)
    return _known[path]


def pack_block(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of some whole texts: bytes and pre-tokens of one piece of each; the other distinct pre-tokens; and how many of these each text has, which, and how often."""
    buf, offs = utf8(texts)
    size = np.diff(offs)
    if not len(buf):
        none = np.zeros(0, np.int64)
        return size, np.zeros(len(size), np.int64), [], np.zeros(len(size), np.int64), none, none
    starts, ends = _cuts(buf, offs)
    lead, which = np.unique(first_equal(buf, starts, ends), return_inverse=True)
    split, number, ones, listed, count = splitter(path), {}, np.zeros(len(lead), np.int64), [], np.zeros(len(lead), np.int64)
    for k, part in enumerate(_decoded(buf, starts[lead], ends[lead])):
        units = split.units(part)
        rest = [number.setdefault(x, len(number)) for x in units if x not in split.one]
        ones[k], count[k] = len(units) - len(rest), len(rest)
        listed += rest
    first = np.searchsorted(starts, offs)  # parts of each text
    total = np.append(0, np.cumsum(ones[which]))
    ones_of = total[first[1:]] - total[first[:-1]]
    text = np.repeat(np.arange(len(size)), np.diff(first))
    at = np.cumsum(count) - count
    unit = np.array(listed, np.int64)[ragged(at[which], count[which])]
    # Sorted pre-tokens pack better.
    names = sorted(number)
    rank = np.zeros(len(names), np.int64)
    rank[[number[x] for x in names]] = np.arange(len(names))
    width = max(1, len(names))
    key, n = np.unique(np.repeat(text, count[which]) * width + rank[unit], return_counts=True)
    return size, ones_of, names, np.bincount(key // width, minlength=len(size)), key % width, n


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """Packed rows: about BLOCK bytes of documents with the frequencies of their pre-tokens. A block is named by its task and its number there."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                size, ones, units, kinds, unit, n = pack_block(path, batch.column(1)[a:b])
                step = np.diff(unit, prepend=0)
                first = (np.cumsum(kinds) - kinds)[kinds > 0]
                step[first] = unit[first]  # steps within a document
                one = lambda x: pa.array([x])
                long = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [one(block), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0)[a:b]), pa.array([size], long), pa.array([ones], long), pa.array([units], pa.list_(pa.string())), one(len(units)), one(planes(kinds)), one(planes(step)), one(planes(n))],
                    names=["block", "doc_id", "n_bytes", "ones", "units", "n_units", "kinds", "unit", "n"],
                )
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(lean(run), PACKED)


def piece_counts(units: DataFrame, path: str) -> DataFrame:
    """Of ``units`` (unit, block, k): rows (block, at, pieces, size) that hold the places k of some units of a block and how many pieces each has.

    Equal units are sorted side by side, and each is split once. There is a row of a unit for each block that has it, whatever its frequency.
    """

    def run(batches):
        split, last, held, size = splitter(path), (None, 0), [], 0
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            each = []
            for x in coded.dictionary.to_pylist():
                last = last if x == last[0] else (x, split.pieces(x))
                each.append(last[1])
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.array(each, np.int64)[coded.indices.to_numpy()]))
            size += len(coded)
            if size > CHUNK:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held):
        block, k, pieces = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((k, block))
        block, k, pieces = block[order], k[order], pieces[order]
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        end = np.r_[cut[1:], len(block)].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(block[cut], pa.int64()), pa.array([planes(k[a:b]) for a, b in zip(cut, end)], pa.binary()), pa.array([planes(pieces[a:b]) for a, b in zip(cut, end)], pa.binary()), pa.array((end - cut)[: len(cut)], pa.int64())], names=["block", "at", "pieces", "size"]
        )

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(run), "block long, at binary, pieces binary, size long")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text): UTF-8 bytes, and the number of ids that the library gives the whole text.

    Null and empty texts have none of either. Rows of a null or repeated doc_id, and repeated rows, are counted one by one; a very long text is a block of
    its own. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    packed = written(frequencies(docs, path), "frequencies", "zstd")
    met = packed.select(F.posexplode("units").alias("k", "unit"), "block").select("unit", "block", "k")
    pieces = piece_counts(met, path).groupBy("block").agg(F.collect_list(F.struct("at", "pieces", "size")).alias("found"))

    def run(batches):
        for batch in batches:
            doc, size, ones = (batch.column(k) for k in range(3))
            for k, (found, n_units, kinds, unit, n) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(3, 8)])):
                each = np.zeros(n_units, np.int64)
                for x in found or []:
                    each[numbers(x["at"], x["size"])] = numbers(x["pieces"], x["size"])
                own = doc.slice(k, 1).flatten()
                kinds = numbers(kinds, len(own))
                end = np.cumsum(kinds)
                unit, n = numbers(unit, int(kinds.sum())), numbers(n, int(kinds.sum()))
                run_up = np.append(0, np.cumsum(unit))
                unit = run_up[1:] - np.repeat(run_up[end - kinds], kinds)
                total = np.append(0, np.cumsum(each[unit] * n))
                yield pa.RecordBatch.from_arrays([own, size.slice(k, 1).flatten(), pa.array(ones.slice(k, 1).flatten().to_numpy() + total[end] - total[end - kinds])], names=["doc_id", "n_bytes", "n_tokens"])

    own = packed.select("block", "doc_id", "n_bytes", "ones", "n_units", "kinds", "unit", "n").join(pieces, "block", "left")
    return own.select("doc_id", "n_bytes", "ones", "found", "n_units", "kinds", "unit", "n").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: bytes, tokens and whether these exceed the limit, of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
