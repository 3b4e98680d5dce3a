"""Media columns: Netpbm and BMP images, area resizing, NPY tiles, difference hashes (operator 6)."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, row_schema, utf8, with_row, written

#: Pixels in a row of the image that holds a payload: 64 RGB pixels are 192 bytes.
WIDTH = 64
#: Rows and columns of the resized tile; the difference hash compares its neighbours.
TILE = (8, 9)


def pad(data: bytes, unit: int = 192) -> bytes:
    """``data`` with blanks up to a positive multiple of ``unit`` bytes."""
    return data + b" " * (-len(data) % unit if data else unit)


def to_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm: P6 for (rows, columns, 3), P5 for (rows, columns)."""
    rows, columns = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, columns, rows) + pixels.tobytes()


def to_bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP without compression: bottom row first, BGR, rows filled up to 4 bytes."""
    rows, columns, _ = pixels.shape
    fill = -columns * 3 % 4
    lines = np.zeros((rows, columns * 3 + fill), np.uint8)
    lines[:, : columns * 3] = pixels[::-1, :, ::-1].reshape(rows, -1)
    head = np.array([40, columns, rows], "<i4").tobytes() + np.array([1, 24], "<u2").tobytes() + np.array([0, lines.size, 2835, 2835, 0, 0], "<i4").tobytes()
    return b"BM" + np.array([54 + lines.size, 0, 54], "<u4").tobytes() + head + lines.tobytes()


def decode(media: bytes) -> np.ndarray:
    """Pixels of a binary Netpbm (P4, P5, P6 of 8 bits) or an uncompressed 24-bit BMP; others raise ValueError."""
    if media[:2] == b"BM":
        at = int.from_bytes(media[10:14], "little")
        columns, rows = np.frombuffer(media, "<i4", 2, 18)
        if int.from_bytes(media[28:30], "little") != 24 or int.from_bytes(media[30:34], "little"):
            raise ValueError("only uncompressed 24-bit BMP")
        line = (int(columns) * 3 + 3) // 4 * 4
        lines = np.frombuffer(media, np.uint8, line * abs(int(rows)), at).reshape(-1, line)[:, : columns * 3]
        pixels = lines.reshape(len(lines), columns, 3)[:, :, ::-1]
        return pixels[::-1] if rows > 0 else pixels
    kind = media[:2]
    if kind not in (b"P4", b"P5", b"P6"):
        raise ValueError("neither Netpbm nor BMP")
    numbers, at = [], 2
    while len(numbers) < (2 if kind == b"P4" else 3):
        while media[at : at + 1].isspace():
            at += 1
        if media[at : at + 1] == b"#":
            at = media.index(b"\n", at)
            continue
        end = at
        while media[end : end + 1].isdigit():
            end += 1
        numbers.append(int(media[at:end]))
        at = end
    at += 1
    columns, rows = numbers[:2]
    if kind == b"P4":
        line = (columns + 7) // 8
        bits = np.unpackbits(np.frombuffer(media, np.uint8, rows * line, at).reshape(rows, line), axis=1)[:, :columns]
        return (1 - bits) * np.uint8(255)
    if numbers[2] > 255:
        raise ValueError("only samples of 8 bits")
    depth = 3 if kind == b"P6" else 1
    pixels = np.frombuffer(media, np.uint8, rows * columns * depth, at)
    return pixels.reshape((rows, columns, 3) if depth == 3 else (rows, columns))


def area_resize(pixels: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Mean grey value of each cell of a grid, by an integral image; cells may cover parts of pixels."""
    grey = pixels.sum(axis=2, dtype=np.float64) / pixels.shape[2] if pixels.ndim == 3 else pixels.astype(np.float64)
    whole = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=whole[1:, 1:])

    def at(table: np.ndarray, edges: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(table) - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = (np.linspace(0, n, k + 1) for n, k in zip(grey.shape, shape, strict=True))
    corners = at(at(whole, ys).T, xs).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / ((ys[1] - ys[0]) * (xs[1] - xs[0]))


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """64 bits: is a cell darker than its right neighbour?"""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def encode_column(df: DataFrame, text: str = "text", form: str = "ppm") -> DataFrame:
    """(row, media, n_bytes): each whole row of ``df``, the padded UTF-8 bytes of ``text`` as RGB samples of a PPM or BMP image, and
    their number before padding.

    Null and empty texts give an image of one row of blanks; very long texts give tall images; nothing is cut. Repeated rows are
    encoded each; an empty table gives no rows. Columns of ``df`` may have any names: they stay in ``row``.
    """
    to = {"ppm": to_ppm, "bmp": to_bmp}[form]

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                data, offs = utf8(batch.column(1)[a:b])
                raw = data.tobytes()
                made = [to(np.frombuffer(pad(raw[x:y], WIDTH * 3), np.uint8).reshape(-1, WIDTH, 3)) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(made, pa.binary()), pa.array(np.diff(offs))], names=["row", "media", "n_bytes"])

    return with_row(df, text=F.col(text)).mapInArrow(lean(run), row_schema(df, "media binary, n_bytes long"))


def decode_column(df: DataFrame, media: str = "media") -> DataFrame:
    """(row, payload, tile, dhash): each whole row of ``df``, the samples of its image, its area-resized tile as the bytes of an NPY
    file (float32) and its difference hash; a null image gives nulls."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                out = []
                for value in batch.column(1)[a:b].to_pylist():
                    if value is None:
                        out.append((None, None, None))
                        continue
                    pixels = decode(value)
                    tile = area_resize(pixels, TILE)
                    out.append((pixels.tobytes(), npy(tile.astype("<f4")), difference_hash(tile)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.string())))], names=["row", "payload", "tile", "dhash"])

    return with_row(df, media=F.col(media)).mapInArrow(lean(run), row_schema(df, "payload binary, tile binary, dhash string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: digests of the stored image and of what is read back from it, for every document.

    The images are written as a media column in the shared folder; they are read again from there, and their tiles are written as a
    column of NPY files, from which the feature comes.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = encode_column(docs).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "media")
    found = decode_column(written(stored, "media", "zstd"))
    tiles = found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.n_bytes").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -16, 16)).alias("tail_crc32"),
        F.octet_length("row.media").cast("long").alias("media_bytes"),
        F.sha2("row.media", 256).alias("media_sha256"),
        "dhash",
        "tile",
    )
    tiles = written(tiles, "tiles", "zstd")
    return tiles.select(*tiles.columns[:-2], F.concat(F.col("dhash"), F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"))
