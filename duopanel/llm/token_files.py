"""Token ids in frequency-ranked, byte-aligned files (operator 10).

File format: magic, then blocks. A block holds the ids of some documents, each id replaced by its
frequency rank: header (documents, values, control bytes, data bytes as little-endian uint64), the
documents' doc_ids and lengths (int64 each, and a byte for a null doc_id), control bytes (2 bits a value:
its length less 1), data bytes (1 to 4 a value). The ranks are in one table beside the files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attempt, blocks, filesystem, lean, new_dir, written
from .tokens import memory, vocabulary

MAGIC = b"DPTOKEN1"
#: Bytes of text in a file, about; a file is written and read by one task, block by block.
FILE_BYTES = 24_000_000
#: LENGTHS[c]: bytes of the four values under control byte c.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of 32-bit values."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    four[: len(values)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= extra[:, None]
    return control, values.view(np.uint8).reshape(-1, 4)[used]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values, by table lookup of the lengths under each control byte."""
    length = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length) - length
    data = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
    out = data[at]
    for k in range(1, int(length.max(initial=1))):
        more = np.flatnonzero(length > k)
        out[more] |= data[at[more] + k] << np.uint32(8 * k)
    return out & MASKS[length]


def write_block(out, doc: pa.Array, length: np.ndarray, values: np.ndarray) -> None:
    """One block: the documents' ids (null allowed) and lengths, and all their values in the byte-aligned code."""
    control, data = pack(values)
    null = doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    head = np.array([len(doc), len(values), len(control), len(data)], "<u8")
    for x in (head, doc.fill_null(0).to_numpy().astype("<i8"), length.astype("<i8"), null, control, data):
        out.write(x.tobytes())


def read_blocks(uri: str):
    """Blocks of one file: doc_ids, lengths, all values."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as file:
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        while head := file.read(32):
            n, values, n_control, n_data = np.frombuffer(head, "<u8").tolist()
            doc, length = np.frombuffer(file.read(8 * n), "<i8"), np.frombuffer(file.read(8 * n), "<i8")
            null = np.frombuffer(file.read(n), np.uint8).astype(bool)
            control, data = np.frombuffer(file.read(n_control), np.uint8), np.frombuffer(file.read(n_data), np.uint8)
            yield pa.array(doc, pa.int64(), mask=null), length, unpack(control, data, values)


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str, n_files: int) -> DataFrame:
    """Tokenize ``docs`` in ascending doc_id order (null first; rows of equal doc_id by size and a hash of the text) into a file of ids for each range.

    Texts are dealt by range once; ids are never shuffled. Returns the written table of (part, file, n_documents, n_tokens) rows, one
    for each file, and of (id, n) rows, the counts of each file's ids. A task writes a file under a name of its own and closes it before
    it reports it, so that files of lost attempts are never read.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"{part:06d}-{attempt()}.ids"
        documents = tokens = 0
        total = np.zeros(1 << 16, np.int64)
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(MAGIC)
            for batch in batches:
                for a, b in blocks(batch.column(1)):
                    ids, at = memory(path).encode(batch.column(1)[a:b])
                    values = np.insert(ids, at[1:], np.uint32(end_id))
                    write_block(out, batch.column(0)[a:b], np.diff(at) + 1, values)
                    n = np.bincount(values)
                    if len(n) > len(total):
                        total = np.append(total, np.zeros(len(n) - len(total), np.int64))
                    total[: len(n)] += n
                    documents, tokens = documents + b - a, tokens + len(values)
        if not documents:
            fs.delete_file(f"{base}/{name}")
            return
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_documents": documents, "n_tokens": tokens}], schema=MANIFEST)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(used), pa.string()), none, none, pa.array(used), pa.array(total[used])], schema=MANIFEST)

    text = F.coalesce(F.col("text"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.octet_length("text").asc(), F.xxhash64("text").asc()]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return written(own.repartitionByRange(n_files, *order).sortWithinPartitions(*order).mapInArrow(lean(run), "part long, file string, n_documents long, n_tokens long, id long, n long"), "token-ids")


MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def frequency_order(found: DataFrame) -> np.ndarray:
    """The ids by falling frequency over all files (ties: smaller id first). One row for each id of the vocabulary reaches the driver."""
    counts = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def rank_files(manifest: DataFrame, order: np.ndarray, source: str, folder: str) -> DataFrame:
    """Each file of ids again, with frequency ranks in their place, as a file of ``folder``; the manifest of these files."""
    shared = manifest.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        rank = np.zeros(int(shared.value.max(initial=0)) + 1, np.uint32)
        rank[shared.value] = np.arange(len(shared.value), dtype=np.uint32)
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            names = []
            for part, old in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(f"{part:06d}-{attempt()}.tok")
                with fs.open_output_stream(f"{base}/{names[-1]}") as out:
                    out.write(MAGIC)
                    for doc, length, ids in read_blocks(f"{source}/{old}"):
                        write_block(out, doc, length, rank[ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), *batch.columns[2:]], names=["part", "file", "n_documents", "n_tokens"])

    own = manifest.select("part", "file", "n_documents", "n_tokens").repartitionByRange(max(1, manifest.count()), "part")
    return written(own.mapInArrow(lean(run), "part long, file string, n_documents long, n_tokens long"), "token-manifest")


def read_file(uri: str, order: np.ndarray):
    """Blocks of one file: doc_ids, lengths, all ids."""
    for doc, length, ranks in read_blocks(uri):
        yield doc, length, order[ranks]


def read_files(manifest: DataFrame, order: np.ndarray, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32. Files are dealt out one by one; the running sum is over one row for each file."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc, length, ids in read_file(f"{folder}/{name}", shared.value):
                    end = np.cumsum(length)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(end.tolist(), length.tolist())]
                    yield pa.RecordBatch.from_arrays([doc, pa.array(start + end - length), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(end[-1])

    n = max(1, manifest.count())
    return starts.select("file", "start").repartitionByRange(n, "file").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, np.ndarray, str]:
    """Tokenize ``docs`` (doc_id, text) once, rank the ids over the whole corpus and write the files; manifest, order and folder.

    Null texts are empty, a null doc_id comes first, repeated rows are documents of their own, and very long texts are one block.
    Empty tables give no files. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ids, folder = new_dir(spark, "ids"), new_dir(spark, "tokens")
    found = write_ids(docs, path, end_id, ids, max(1, round(size / FILE_BYTES)))
    order = frequency_order(found)
    return rank_files(found.where("file is not null"), order, ids, folder), order, folder


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: start, length and checksum of each document's ids, read back from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_files(*write_tokens(docs, vocabulary("word_bpe_49k.json"), 1))
