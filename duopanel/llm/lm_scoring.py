"""Language-model scores by prediction by partial matching, beside a word-unigram base (operator 5).

A trie of byte contexts up to ORDER is counted over all training texts. A byte is predicted from the longest
context that has met it; each failure codes an escape (method D: half a count for each distinct symbol), and
symbols that a longer context has refused are excluded from the shorter ones. A document's score is the sum of
the log10 probabilities of its lower-cased bytes and of its end.

The trie is dealt by the last LOW bytes of the contexts, so that a shard holds its contexts of LOW to ORDER bytes whole
and scores every gram that ends in them; the shorter contexts are few and go to all shards. Nothing is left out.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, attempt, blocks, lean, mix64, ragged, span_hashes, utf8, words, written

ORDER = 5
#: Bytes of a context by which grams are dealt. Leaves of shorter contexts are broadcast: at most 256 ** LOW, whatever the input.
LOW = 3
#: Grams of a shard that are merged at once. Bounds memory, never what is kept.
MODEL_ROWS = 1_000_000
#: Bytes of text that are scored together.
BLOCK = 4 << 20
#: Blocks of a task share one list of their grams and words until these have so many, or the texts so many bytes; then a new list begins.
LISTED = 1_000_000
LISTED_BYTES = 32 << 20
#: Bytes of text for each shard of the grams and of the word counts.
SHARD = 24_000_000
END = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """ORDER + 1 bytes ending at each byte and at each end of each row, as integers; rows in order.

    Before a row stand zeros, and its end is a zero (as is a zero byte of a text).
    """
    n = np.diff(offs)
    wide = np.zeros(len(buf) + (ORDER + 1) * len(n), np.uint8)
    start = offs[:-1] + (ORDER + 1) * np.arange(len(n)) + ORDER
    wide[ragged(start, n)] = LOWER[buf]
    found = np.zeros(len(wide) - ORDER, np.int64)
    for k in range(ORDER + 1):
        found = (found << 8) | wide[k : len(wide) - ORDER + k]
    return found[ragged(start - ORDER, n + 1)]


def summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``g``, sorted, with their sums of ``n``."""
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return g[new], np.add.reduceat(n, new) if len(g) else n


def lower_levels(g: np.ndarray, n: np.ndarray, highest: int, lowest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Leaves of the orders from ``highest`` down to ``lowest``, from grams or leaves of ``highest`` or more."""
    levels = []
    for k in range(highest, lowest - 1, -1):
        g, n = summed(g & ((1 << 8 * (k + 1)) - 1), n)
        levels.append((g, n))
    return levels


class Trie:
    """Levels from ORDER down to 0: leaves by gram, contexts by their bytes, all in sorted arrays."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for j, (g, n) in enumerate(levels):
            context = g >> 8
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(g) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first).astype(np.float64) if len(g) else np.zeros(0)
            kinds = np.diff(np.r_[first, len(g)]).astype(np.float64)
            if j + 1 < len(levels) and len(g):
                lower, m = levels[j + 1]
                own = m[np.searchsorted(lower, g & ((1 << 8 * (ORDER - j)) - 1))]
                refused = np.add.reduceat(own, first).astype(np.float64)
            else:
                refused = np.zeros(len(first))
            self.levels.append((g, n.astype(np.float64), context[first], total, kinds, refused))

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        out = np.zeros(len(g))
        todo = np.arange(len(g))
        less, fewer = np.zeros(len(g)), np.zeros(len(g))  # counts and kinds excluded at the next level
        for j, (leaf, n, contexts, total, kinds, refused) in enumerate(self.levels):
            if not len(leaf) or not len(todo):
                continue
            own = g[todo] & ((1 << 8 * (ORDER + 1 - j)) - 1)
            at = np.minimum(np.searchsorted(contexts, own >> 8), len(contexts) - 1)
            met = contexts[at] == own >> 8
            left = np.where(met, total[at], 0) - less[todo]
            kinds_left = np.where(met, kinds[at], 0) - fewer[todo]
            place = np.minimum(np.searchsorted(leaf, own), len(leaf) - 1)
            hit = met & (leaf[place] == own)
            out[todo[hit]] += np.log10((n[place[hit]] - 0.5) / left[hit])
            escape = met & ~hit & (left > 0)
            out[todo[escape]] += np.log10(0.5 * kinds_left[escape] / left[escape])
            less[todo], fewer[todo] = np.where(met, refused[at], 0), np.where(met, kinds[at], 0)
            todo = todo[~hit]
        out[todo] -= np.log10(np.maximum(256 - fewer[todo], 1))
        return out


def train(docs: DataFrame) -> tuple[Trie, int]:
    """The whole trie of all texts of ``docs`` and their number of bytes and ends, on the driver: for small tables only; :func:`score` deals it out."""
    g = [np.zeros(0, np.int64), *(grams(*utf8(b.column(0))) for b in docs.select("text").toArrow().to_batches())]
    g, n = np.unique(np.concatenate(g), return_counts=True)
    return Trie(lower_levels(g, n, ORDER, 0)), int(n.sum())


def dump(*arrays) -> bytes:
    return zlib.compress(pickle.dumps(arrays, 5), 1)


def load(data: bytes) -> tuple:
    return pickle.loads(zlib.decompress(data))


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the number of each code among them."""
    coded = pa.array(codes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def text_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends, and the number of both in each row."""
    starts, stops, first = words(buf, offs)
    return np.insert(span_hashes(LOWER[buf], starts, stops), first[1:], END), np.diff(first) + 1


def dealt(codes: np.ndarray, n: np.ndarray, by: np.ndarray, shards: int):
    """(shard, codes, n) of each shard - a hash of ``by`` - with codes; these stay in order."""
    shard = (mix64(by) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)).tolist():
        k = order[cut[s] : cut[s + 1]]
        yield s, codes[k], n[k]


def read_blocks(docs: DataFrame, shards: int) -> DataFrame:
    """Lists of blocks of documents. Of each: the texts of its blocks (shard -1), the training counts of its leaves of order LOW - 1
    (shard -2), and for each shard its distinct words (even numbers) and grams (odd numbers) with their training counts.

    ``docs``: doc_id, text, training (boolean).
    """

    def row(name, shard, a, b=b""):
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["list", "shard", "a", "b"])

    def run(batches):
        empty = lambda: (attempt(), (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0)
        name, g, w, size = empty()

        def end():
            seen = g[1] > 0
            yield row(name, -2, dump(*lower_levels(g[0][seen], g[1][seen], LOW - 1, LOW - 1)[0]))
            for s, x, n in dealt(*w, w[0], shards):
                yield row(name, 2 * s, x.tobytes(), n.astype("<u4").tobytes())
            for s, x, n in dealt(*g, (g[0] >> 8) & ((1 << 8 * LOW) - 1), shards):
                yield row(name, 2 * s + 1, dump(np.diff(x, prepend=0), n.astype("<u4")))

        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                buf, offs = utf8(batch.column(1)[a:b])
                training = batch.column(2)[a:b].to_numpy(zero_copy_only=False).astype(bool)
                yield row(name, -1, dump(batch.column(0)[a:b].to_pylist(), training, offs), pa.compress(buf.tobytes(), "zstd", asbytes=True))
                own, which = numbered(grams(buf, offs))
                g = summed(np.concatenate([g[0], own]), np.concatenate([g[1], np.bincount(which[np.repeat(training, np.diff(offs) + 1)], minlength=len(own))]))
                codes, n = text_words(buf, offs)
                own, which = numbered(codes)
                w = summed(np.concatenate([w[0], own]), np.concatenate([w[1], np.bincount(which[np.repeat(training, n)], minlength=len(own))]))
                size += len(buf)
                del codes, own, which
                if len(g[0]) >= LISTED or len(w[0]) >= LISTED or size >= LISTED_BYTES:
                    yield from end()
                    name, g, w, size = empty()
        if len(g[0]):
            yield from end()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "training").mapInArrow(lean(run), "list string, shard long, a binary, b binary")


def short_levels(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Leaves of the orders below LOW over all blocks: at most 256 ** LOW of the longest reach the driver."""

    def run(batches):
        g, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            parts = [load(x) for x in batch.column(0).to_pylist()]
            g, n = summed(np.concatenate([g, *(p[0] for p in parts)]), np.concatenate([n, *(p[1] for p in parts)]))
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    own = found.where("shard = -2").select("a").mapInArrow(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return lower_levels(own["g"].to_numpy().astype(np.int64), own["n"].to_numpy().astype(np.int64), LOW - 1, 0)


def gram_values(parts: DataFrame, short: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """For each part of a shard (list, shard, grams with training counts): its grams and their log10 probabilities."""
    shared = parts.sparkSession.sparkContext.broadcast(short)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        g, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        have, size = [(g, n)], 0
        for k, x in enumerate(own["a"], 1):
            d, c = load(x)
            have.append((np.cumsum(d), c.astype(np.int64)))
            size += len(d)
            if size > MODEL_ROWS or k == len(own):
                g, n = summed(np.concatenate([v[0] for v in have]), np.concatenate([v[1] for v in have]))
                have, size = [(g, n)], 0
        seen = n > 0
        value = Trie([*lower_levels(g[seen], n[seen], ORDER, LOW), *shared.value]).log10(g)
        out = []
        for x in own["a"]:
            d, _ = load(x)
            out.append(dump(d, value[np.searchsorted(g, np.cumsum(d))]))
        return pd.DataFrame({"list": own["list"], "shard": own["shard"], "c": out})

    return parts.groupBy("shard").applyInPandas(lean(run), "list string, shard long, c binary")


def count_words(parts: DataFrame) -> DataFrame:
    """For each part (list, shard, hashes, counts): its words and their corpus counts, with the shard's tokens and types.

    A shard's words are counted together; the number of shards follows the input, and a list names a word once however often it occurs.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, np.uint64) for x in own["a"]]
        keys, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, which, np.concatenate([np.frombuffer(x, "<u4") for x in own["b"]]).astype(np.int64))
        cut = np.cumsum([0, *map(len, hashes)])
        head = np.zeros((len(own), 2), np.int64)
        head[0] = total.sum(), (total > 0).sum()
        return pd.DataFrame({"list": own["list"], "shard": own["shard"], "c": [dump(h, total[which[x:y]]) for h, x, y in zip(hashes, cut[:-1], cut[1:])], "tokens": head[:, 0], "types": head[:, 1]})

    return parts.groupBy("shard").applyInPandas(lean(run), "list string, shard long, c binary, tokens long, types long")


def put_together(found: DataFrame, values: DataFrame, counts: DataFrame, tokens: int, types: int) -> DataFrame:
    """Texts with the values of their list's grams and the counts of its words: a row for each document."""
    norm = np.log10(tokens + 0.1 * (types + 1))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        shard = own["shard"].to_numpy()
        parts = [load(x) for x in own["c"][(shard >= 0) & (shard % 2 == 1)]]
        g, value = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(g)
        g, value = g[order], value[order]
        parts = [load(x) for x in own["c"][(shard >= 0) & (shard % 2 == 0)]]
        w, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(w)
        w, count = w[order], count[order]
        del parts, order
        out = []
        for a, b in zip(own["a"][shard == -1], own["b"][shard == -1]):
            doc, training, offs = load(a)
            buf = np.frombuffer(pa.decompress(b, int(offs[-1]), "zstd", asbytes=True), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
            distinct, which = numbered(grams(buf, offs))
            score = np.add.reduceat(value[np.searchsorted(g, distinct)][which], offs[:-1] + np.arange(len(doc)))
            codes, n = text_words(buf, offs)
            distinct, which = numbered(codes)
            c = count[np.searchsorted(w, distinct)]
            first = np.cumsum(n) - n
            base = np.add.reduceat((np.log10(c + 0.1) - norm)[which], first)
            known = np.add.reduceat((c > 0).astype(np.int64)[which], first)
            out.append(pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "held_out": ~training, "n_tokens": n, "n_known": known, "base_score": base, "score": score}))
        return pd.concat(out)

    heads = found.where("shard = -1").select("list", "shard", "a", "b", F.lit(None).cast("binary").alias("c"))
    none = F.lit(None).cast("binary")
    both = heads.unionByName(counts.unionByName(values).select("list", "shard", none.alias("a"), none.alias("b"), "c"))
    return both.groupBy("list").applyInPandas(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text), learned from those where ``training`` is true.

    Null text is empty: one end token. Repeated rows count as often as they occur, and get equal scores. Without training rows all bytes are
    equally likely. Very long texts are one block and scored whole. An empty table gives no rows; other columns, of any names, are not read.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), training.alias("training"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, size // SHARD)
    found = written(read_blocks(own, shards), "blocks")
    values = gram_values(found.where("shard >= 0 and shard % 2 = 1"), short_levels(found))
    counts = written(count_words(found.where("shard >= 0 and shard % 2 = 0")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    return put_together(found, values, counts.select("list", "shard", "c"), total["tokens"], total["types"]).withColumn("train_tokens", F.lit(total["tokens"]).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: PPM score and unigram base of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, ~held_out(F.col("doc_id"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
