"""Shared helpers: the cluster's shared folder, written tables, byte kernels."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import inspect
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that separate words, and the word pattern of the contracts.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; an own one only where it is unset, and only if driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="duopanel-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/duopanel/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a table written in the shared folder: lineage ends here."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path, compression=codec)
    back = spark.read.schema(df.schema).parquet(path)
    back._duopanel_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._duopanel_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that this Python worker has freed back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """``run`` (for mapInArrow or applyInPandas) that gives its memory back at its end."""
    if inspect.isgeneratorfunction(run):

        def wrapped(batches):
            yield from run(batches)
            release()

        return wrapped

    @functools.wraps(run)
    def called(own):
        out = run(own)
        release()
        return out

    return called


def with_row(df: DataFrame, **inputs) -> DataFrame:
    """The whole row of ``df`` as one column ``row``, beside ``inputs``: no name of ``df`` can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in inputs.items()])


def row_schema(df: DataFrame, added: str) -> T.StructType:
    """Schema of ``row`` (the columns of ``df``) and the ``added`` columns (DDL)."""
    return T.StructType([T.StructField("row", df.schema, False), *T.StructType.fromDDL(added).fields])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def blocks(column: pa.Array, most: int = 4 << 20):
    """Runs of rows of about ``most`` bytes: (first row, last row + 1). A longer row is a run of its own."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, int(offs[at]) + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Low bytes that a chunk of 0..8 bytes keeps.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH_CODE = np.uint64(0x9E3779B97F4A7C15)
_STEP_CODE = np.uint64(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one by BLAKE2b instead of eight bytes of all spans at a time.
LONG = 256


def chunks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on, as integers; beyond the end stand zeros."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans get equal hashes wherever they stand.

    No sum of powers, whose structure texts of a regular shape can meet: eight bytes at a time pass through the
    finaliser above, and spans of more than LONG bytes through BLAKE2b. Chance collisions remain possible (2 ** -64 a
    pair): users whose results would suffer compare the bytes (:func:`same_spans`).
    """
    size = ends - starts
    eight = chunks(buf)
    h = mix64((eight[starts] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * _LENGTH_CODE)
    todo, step = np.flatnonzero(size > 8), 8
    while len(todo) and step < LONG:
        own = eight[starts[todo] + step] & _KEEP[np.minimum(size[todo] - step, 8)]
        h[todo] = mix64((h[todo] ^ own) * _STEP_CODE + np.uint64(step))
        step += 8
        todo = todo[size[todo] > step]
    if len(todo):
        raw = memoryview(np.ascontiguousarray(buf))
        for k, a, b in zip(todo.tolist(), starts[todo].tolist(), ends[todo].tolist()):
            h[k] = int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little")
    return h


def same_spans(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True where ``size`` bytes of ``x`` from ``at_x`` on equal those of ``y`` from ``at_y`` on."""
    out = np.ones(len(size), bool)
    left, right = chunks(x), chunks(y)
    todo, step = np.flatnonzero(size > 0), 0
    while len(todo) and step < LONG:
        differ = ((left[at_x[todo] + step] ^ right[at_y[todo] + step]) & _KEEP[np.minimum(size[todo] - step, 8)]) != 0
        out[todo[differ]] = False
        step += 8
        todo = todo[~differ & (size[todo] > step)]
    for k in todo.tolist():
        n = int(size[k])
        out[k] = np.array_equal(x[at_x[k] : at_x[k] + n], y[at_y[k] : at_y[k] + n])
    return out


def first_equal(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span the first span of the same bytes: found by hash and then compared."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    lead = first[which]
    size = ends - starts
    differ = (size != size[lead]) | ~same_spans(buf, starts, buf, starts[lead], np.minimum(size, size[lead]))
    lead[differ] = np.flatnonzero(differ)
    return lead


def words(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not in ``between``, and the first run of each row (n + 1)."""
    inside = np.zeros(len(buf) + 1, bool)
    np.logical_not(between[buf], out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = offs[(offs > 0) & (offs < len(buf))]  # a word never runs on into the next row
    begins[cuts] = inside[cuts]
    ends = inside[:-1] & ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0]..starts[0]+lengths[0]-1, starts[1]..., in one array."""
    if not len(starts):
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder or file that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def attempt() -> str:
    """A name that no other run of the same task uses."""
    return uuid.uuid4().hex[:12]
