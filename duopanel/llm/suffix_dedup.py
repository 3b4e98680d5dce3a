"""Removal of long repeated passages by a logarithmic family of suffix arrays (operator 1).

A byte goes if it lies in a LENGTH-byte string that also starts earlier: in a smaller document, or before in its own.
All strings with one anchor - the least hash among the short grams that they hold - are searched by one task. There, new
suffixes come in batches in order of document and place; a batch gets its suffix array (the starts, sorted by
their first LENGTH bytes), is merge-scanned against the levels of the family, and what is new becomes a level of
its own; levels of like size merge, so that a family of n suffixes has about log2(n / BATCH) sorted levels.

Anchors that occur once cannot lie in a repeat. A first pass marks the others in a bitmap of fixed size; the second
pass ships only runs of strings with marked anchors (others may be marked by chance, which costs time alone).
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, first_equal, lean, mix64, ragged, row_schema, utf8, with_row, written

LENGTH = 100
#: Bytes of the grams whose least hash is the anchor.
GRAM = 24
#: Size of the bitmap of repeated anchors: 2 ** BITS bits (32 MB), whatever the input.
BITS = 28
#: Input bytes for each shard of anchors.
SHARD = 4 << 20
#: Suffixes of a batch.
BATCH = 1 << 16
#: Bytes of text whose runs are dealt out together.
CHUNK = 2 << 20
#: Window starts that are hashed together (about 60 bytes of working arrays each).
WINDOW = 1 << 18
LAST = np.int64(2**63 - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: One number for each byte.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
TABLE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the base of gram hashes, or of its inverse, modulo 2**64. Up to TABLE of each (8 MB) stay in memory."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    if base not in _powers:
        table = np.full(TABLE, base, np.uint64)
        table[0] = 1
        _powers[base] = np.cumprod(table)
    if n <= TABLE:
        return _powers[base][:n]
    steps = np.array([pow(base, k * TABLE, 1 << 64) for k in range(-(-n // TABLE))], np.uint64)
    return (steps[:, None] * _powers[base][None, :]).reshape(-1)[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums whose differences, times a power, are the rolling hashes of grams. They only choose anchors: grams that collide cost time, never results."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * powers(len(buf), inverse=True), out=out[1:])
    return out


def slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) over each ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        x = of(x[:-step], x[step:])
        step *= 2
    return of(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def ties(grams: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Anchors that stand twice in one string: their grams follow each other, with no other anchor's between."""
    around = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(low)] = low
    at = np.flatnonzero(slide(around, width, np.maximum) == grams)
    same = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= width)
    return grams[at[1:][same]]


def runs(buf: np.ndarray, offs: np.ndarray, length: int, twice: list | None = None):
    """Yields (row, start in row, number of starts, anchor, place in buf) of maximal runs of strings with one anchor, in chunks.

    ``twice``, if given, gets the anchors that stand twice in one string.
    """
    width = length - GRAM + 1
    for a in range(0, max(len(buf) - length + 1, 0), WINDOW):
        part = buf[a : a + WINDOW + length - 1]
        sums = prefix_sums(part)
        n = len(part) - GRAM + 1
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * powers(len(part))[:n])
        low = slide(grams, width, np.minimum)
        m = len(low)  # one for each window start
        new = np.empty(m, bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        row_a, row_b = np.searchsorted(offs, [a, a + m], "right")
        firsts = offs[max(row_a - 1, 0) : row_b + 1]
        # A start is valid if its row goes on for ``length`` bytes.
        for_rows = np.stack([np.clip(firsts[:-1] - a, 0, m), np.clip(firsts[1:] - length + 1 - a, 0, m)], axis=1)
        for_rows = for_rows[for_rows[:, 1] > for_rows[:, 0]]
        edge = np.zeros(m + 1, np.int32)
        np.add.at(edge, for_rows[:, 0], 1)
        np.add.at(edge, for_rows[:, 1], -1)
        ok = np.cumsum(edge[:-1]) > 0
        new[for_rows[:, 0]] = True
        if twice is not None:
            twice.append(ties(grams, np.where(ok, low, np.uint64(0)), width))
        begins = np.flatnonzero(new & ok)
        stops = np.flatnonzero(np.r_[new | ~ok, True])
        ends = stops[np.searchsorted(stops, begins, "right")]
        at = begins + a
        row = np.searchsorted(offs, at, "right") - 1
        yield row, at - offs[row], ends - begins, low[begins], at


def repeated_anchors(docs: DataFrame, length: int, shards: int) -> np.ndarray:
    """Bitmap (by top bits of the hash) of anchors that occur more than once. A row of it for each shard reaches the driver: 2 ** BITS bits in all."""
    shards = 1 << max(0, (min(shards, 1 << 12) - 1).bit_length())
    top = shards.bit_length() - 1

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(0), CHUNK):
                twice = [np.zeros(0, np.uint64)]
                found = [x[3] for x in runs(*utf8(batch.column(0)[a:b]), length, twice)]
                anchor, n = np.unique(np.concatenate([*found, *twice]), return_counts=True)
                anchor = np.concatenate([anchor, anchor[n > 1]])  # twice, if it repeats here
                anchor.sort()
                shard = (anchor >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(anchor), np.int64)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([anchor[cut[s] : cut[s + 1]].tobytes() for s in used], pa.binary())], names=["shard", "data"])

    size = (1 << BITS) // shards

    def mark(own: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.concatenate([np.frombuffer(v, np.uint64) for v in own["data"]]))
        twice = x[1:][x[1:] == x[:-1]]
        bits = np.zeros(size, np.uint8)
        bits[(twice >> np.uint64(64 - BITS)).astype(np.int64) % size] = 1
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "data": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    marks = docs.select("text").mapInArrow(lean(run), "shard int, data binary").groupBy("shard").applyInPandas(lean(mark), "shard int, data binary")
    out = np.zeros((shards, size // 8), np.uint8)
    for r in marks.toLocalIterator():
        out[r["shard"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out.reshape(-1)


def pack(*arrays) -> bytes:
    return zlib.compress(pickle.dumps(arrays, 5), 1)


def unpack(data: bytes) -> tuple:
    return pickle.loads(zlib.decompress(data))


def by_document(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """A row for each document: its removed runs of starts as (start, number) pairs."""
    order = np.lexsort((start, mark, doc))
    doc, mark, pairs = doc[order], mark[order], np.stack([start, n], axis=1).astype(np.int64)[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]) if len(doc) else np.zeros(0, np.int64)
    cut = np.r_[first, len(doc)]
    return pd.DataFrame({"shard": np.full(len(first), -1, np.int32), "doc": doc[first], "mark": mark[first], "data": [pairs[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]})


def ship_runs(docs: DataFrame, bitmap: np.ndarray, length: int, shards: int) -> DataFrame:
    """Rows of runs for each shard (shard, data), and rows of what a block has already found repeated in itself (with doc and mark, in a shard of their hash).

    Of runs that are equal byte for byte within a block only the earliest is shipped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(2), CHUNK):
                doc, mark = batch.column(0)[a:b].to_numpy(), batch.column(1)[a:b].to_numpy()
                buf, offs = utf8(batch.column(2)[a:b])
                out = []
                for row, start, n, anchor, at in runs(buf, offs, length):
                    bit = (anchor >> np.uint64(64 - BITS)).astype(np.int64)
                    keep = (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                    out.append((row[keep], start[keep], n[keep], anchor[keep], at[keep]))
                if not out:
                    continue
                row, start, n, anchor, at = (np.concatenate(x) for x in zip(*out))
                order = np.lexsort((start, mark[row], doc[row]))
                row, start, n, anchor, at = (x[order] for x in (row, start, n, anchor, at))
                # Repeated rows of one document bring a run twice, and never as a repeat of itself.
                twin = np.zeros(len(row), bool)
                twin[1:] = (doc[row[1:]] == doc[row[:-1]]) & (mark[row[1:]] == mark[row[:-1]]) & (start[1:] == start[:-1])
                row, start, n, anchor, at = (x[~twin] for x in (row, start, n, anchor, at))
                later = first_equal(buf, at, at + n + length - 1) != np.arange(len(row))
                found = by_document(doc[row[later]], mark[row[later]], start[later], n[later])
                if len(found):
                    found["shard"] = (mix64(found["mark"].to_numpy().view(np.uint64)) % np.uint64(shards)).astype(np.int32)
                    yield pa.RecordBatch.from_pandas(found.astype({"shard": "int32"}), preserve_index=False, schema=SHIPPED)
                shard = (mix64(anchor) % np.uint64(shards)).astype(np.int64)
                shard[later] = shards
                by = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[by], np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cut))
                data = []
                for s in used:
                    k = by[cut[s] : cut[s + 1]]
                    data.append(pack(doc[row[k]], mark[row[k]], start[k], n[k].astype(np.int64), anchor[k], buf[ragged(at[k], n[k] + length - 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.array(data, pa.binary())], names=["shard", "doc", "mark", "data"])

    return docs.select("doc", "mark", "text").mapInArrow(lean(run), "shard int, doc long, mark long, data binary")


SHIPPED = pa.schema([("shard", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("data", pa.binary())])


class Family:
    """Levels of suffix arrays, each the distinct suffixes of some batches in order of their first bytes."""

    def __init__(self, length: int):
        self.kind = np.dtype(f"S{length}")
        self.levels: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Take a batch (rows of bytes, in order of place); True where a suffix occurs before it, in the batch or the family."""
        keys = np.ascontiguousarray(suffixes).view(self.kind).reshape(-1)
        order = np.argsort(keys, kind="stable")  # the batch's suffix array; equal ones stay in order of place
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        known = ~new
        fresh = np.flatnonzero(new)
        for level in self.levels:  # merge scan: both are sorted, so that places only rise
            at = np.minimum(np.searchsorted(level, keys[fresh]), len(level) - 1)
            met = level[at] == keys[fresh]
            known[fresh[met]] = True
            fresh = fresh[~met]
        # Copies of a suffix that the family holds are known as well as their first.
        known |= known[np.flatnonzero(new)][np.cumsum(new) - 1]
        if len(fresh):
            self.levels.append(keys[fresh])
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            merged = np.concatenate([self.levels.pop(), self.levels.pop()])
            merged.sort(kind="stable")
            self.levels.append(merged)
        out = np.empty(len(keys), bool)
        out[order] = known
        return out


def held(sums: np.ndarray, at: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """How often each run's text holds its anchor."""
    out = np.zeros(len(at), np.int64)
    for a in range(0, len(at), 2_000):
        n = size[a : a + 2_000] - GRAM + 1
        run = np.repeat(np.arange(len(n)), n)
        p = ragged(at[a : a + 2_000], n)
        hash_ = mix64((sums[p + GRAM] - sums[p]) * powers(len(sums))[p])
        out[a : a + len(n)] = np.bincount(run[hash_ == anchor[a : a + 2_000][run]], minlength=len(n))
    return out


def search_shard(parts: list[bytes], length: int) -> pd.DataFrame:
    """Removed runs of one shard by document, from the packed runs of all blocks."""
    loaded = [unpack(p) for p in parts]
    doc, mark, start, n, anchor = (np.concatenate([x[k] for x in loaded]) for k in range(5))
    text = np.concatenate([x[5] for x in loaded])
    del loaded
    size = n + length - 1
    at = np.cumsum(size) - size
    order = np.lexsort((start, mark, doc))
    # Repeated rows of one document bring a run twice: once is enough.
    doc, mark, start, n, anchor, at, size = (x[order] for x in (doc, mark, start, n, anchor, at, size))
    twin = np.zeros(len(doc), bool)
    twin[1:] = (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (start[1:] == start[:-1])
    whole = first_equal(text, at, at + size) != np.arange(len(doc))
    # Of distinct runs, those that share their anchor, or hold it more than once.
    k = np.flatnonzero(~whole)
    whole &= ~twin
    found = [(doc[whole], mark[whole], start[whole], n[whole])]
    _, which, times = np.unique(anchor[k], return_inverse=True, return_counts=True)
    sums = prefix_sums(text)
    k = k[(times[which] > 1) | (held(sums, at[k], size[k], anchor[k]) > 1)]
    del sums
    if len(k):
        family, views = Family(length), np.lib.stride_tricks.sliding_window_view(text, length)
        end = np.cumsum(n[k])
        known = np.zeros(int(end[-1]), bool)
        for b in range(0, len(known), BATCH):
            place = np.arange(b, min(b + BATCH, len(known)))
            run = np.searchsorted(end, place, "right")
            known[place] = family.add(views[at[k[run]] + place - end[run] + n[k[run]]])
        edge = np.zeros(len(known) + 1, bool)  # runs do not go on into the next
        edge[0] = True
        edge[end] = True
        x = np.flatnonzero(known & (edge[:-1] | ~np.r_[False, known[:-1]]))
        y = np.flatnonzero(known & (edge[1:] | ~np.r_[known[1:], False]))
        run = np.searchsorted(end, x, "right")
        found.append((doc[k[run]], mark[k[run]], start[k[run]] + x - end[run] + n[k[run]], y - x + 1))
    return by_document(*(np.concatenate(c) for c in zip(*found)))


def removed_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, mark, runs): for each document with repeats, packed (start, number) pairs of repeated ``length``-byte strings. ``docs``: doc, mark, text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, total // SHARD)
    bitmap = repeated_anchors(docs, length, shards)

    def search(own: pd.DataFrame) -> pd.DataFrame:
        runs = own["doc"].isna()
        there = own[~runs].astype({"doc": "int64", "mark": "int64"})
        return pd.concat([there, search_shard(list(own["data"][runs]), length)]) if runs.any() else there

    # Document ids of 64 bits must not pass through floats where a column has nulls: they travel as decimal text.
    shipped = ship_runs(docs, bitmap, length, shards).select("shard", F.col("doc").cast("string").alias("doc"), F.col("mark").cast("string").alias("mark"), "data")
    both = shipped.groupBy("shard").applyInPandas(lean(search), "shard int, doc long, mark long, data binary")
    return both.groupBy("doc", "mark").agg(F.collect_list("data").alias("runs"))


def spans_of(parts: list[bytes], size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs (starts, ends) from the packed runs of one document."""
    x = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts])
    x = x[np.argsort(x[:, 0], kind="stable")]
    a, b = x[:, 0], np.maximum.accumulate(x[:, 0] + x[:, 1] - 1 + length)
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]


def with_runs(docs: DataFrame, length: int) -> DataFrame:
    """(row, doc, mark, text, runs): each whole row of ``docs``, the order of its document (null last), a hash of its text, the text without nulls, and its removed runs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = with_row(docs, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))), mark=F.xxhash64(text), text=text)
    return own.join(removed_runs(own.select("doc", "mark", "text"), length), ["doc", "mark"], "left")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty; texts of fewer than ``length`` bytes lose nothing. Rows of equal doc_id and text are one document and
    get the same result; rows of equal doc_id and different text are ordered by a hash of the text; a null doc_id is last.
    """

    def run(batches):
        for batch in batches:
            for first, last in blocks(batch.column(1), 4 << 20):
                buf, offs = utf8(batch.column(1)[first:last])
                raw, out = buf.tobytes(), []
                for k, parts in enumerate(batch.column(2)[first:last].to_pylist()):
                    data = raw[offs[k] : offs[k + 1]]
                    if not parts:
                        out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                        continue
                    a, b = spans_of(parts, len(data), length)
                    sha = hashlib.sha256()
                    for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)]):
                        sha.update(data[x:y])
                    out.append((len(data), int((b - a).sum()), len(a), sha.hexdigest()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    return joined.select("row.doc_id", "text", "runs").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the removed bytes cut out of text; a character that loses some of its bytes goes as a whole. Other columns, of any names, stay as they are."""

    def run(batches):
        for batch in batches:
            for first, last in blocks(batch.column(1), 4 << 20):
                buf, offs = utf8(batch.column(1)[first:last])
                raw, out = buf.tobytes(), []
                for k, parts in enumerate(batch.column(2)[first:last].to_pylist()):
                    data = raw[offs[k] : offs[k + 1]]
                    if parts:
                        a, b = spans_of(parts, len(data), length)
                        data = b"".join(data[x:y].decode("utf-8", "ignore").encode() for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)]))
                    out.append(data.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(out, pa.string())], names=["row", "text"])

    rest = docs.drop("text")
    names = F.struct(*[F.col("row").getField(c).alias(c) for c in rest.columns]).alias("row")
    joined = with_runs(docs, length).select(names, "text", "runs")
    done = joined.mapInArrow(lean(run), row_schema(rest, "text string"))
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what is left of each document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
