"""WARC archives with a two-level capture index (operator 4).

Archives: one gzip member for each record, one file for each writing task. Index: lines sorted by reversed-host
URL key in deflated blocks of some thousand lines; directory: the first and last key of each block and its place, itself in
deflated pages of PAGE blocks, so that what tasks hold in memory is one row for each page: two million captures. A lookup
searches the pages by bisection, then the page, reads one block, searches in it, and reads the record's range of the archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt, filesystem, lean, new_dir, written

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
#: Lines of an index block.
BLOCK_LINES = 2000
#: Blocks of a page of the directory.
PAGE = 1000
#: Stands for a null page_id in joins.
NULL_PAGE = -(2**63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
LINE = "key string, page_id long, file string, offset long, length long"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.A.org:80/x?y -> org,a,www)/x?y. Without a host, the whole text is the path."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return ")" + quote(url, safe="/?&=%:")
    if not host:
        return ")" + quote(url, safe="/?&=%:")
    named = host if re.fullmatch(r"[\d.]+|.*:.*", host) else ",".join(reversed(host.split(".")))
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(f"{named}{port}", safe=",:") + ")" + quote(rest, safe="/?&=%:")


def line_key(url: str | None, page_id: int | None) -> str:
    """Key of one capture: URL key, then the page_id so written that text order is its order; null last."""
    return f"{url_key(url)} {'~' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record(page_id: int | None, url: str | None, html: str | None, kind: str, refers_to: int | None, digest: str, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has the HTTP header alone, with the length of the full payload."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    fields = lambda text: dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:] if ": " in line)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def with_roles(pages: DataFrame) -> DataFrame:
    """``pages`` with payload_digest, record_type and refers_to.

    Of equal payloads of at least LEAST_REVISIT bytes those with the largest page_id are responses (repeated rows:
    each of them; a null page_id counts as the smallest), the others revisit it. Roles come from digests and page_ids alone; html is
    shuffled, if at all, by page and digest, so that pages of one hot payload go to many tasks.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    keyed = own.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "payload_digest")
    groups = keyed.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").drop("n")
    revisits = keyed.join(groups, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("last"))).distinct()
    revisits = revisits.select(F.coalesce("page_id", F.lit(NULL_PAGE)).alias("key"), "payload_digest", F.col("last").alias("refers_to"))
    joined = own.withColumn("key", F.coalesce("page_id", F.lit(NULL_PAGE))).join(revisits, ["key", "payload_digest"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to", "payload_digest")


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write a record for each page; the table of captures (LINE). Each task's file has a name of its own and is closed before it is reported."""

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, at, out = f"{attempt()}.warc.gz", 0, None
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            lines = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress(record(*row), level, mtime=0)
                out.write(data)
                lines.append((line_key(row[1], row[0]), row[0], name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [()] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    return written(with_roles(pages).mapInArrow(lean(run), LINE), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures by key into deflated blocks and their directory into deflated pages; a row for each page: first, last (keys), file, offset, length."""

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, at = f"{attempt()}.cdx", 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        if first is None:
            return
        entries, found = [], []

        def put(out, text):
            nonlocal at
            data = zlib.compress(text.encode())
            out.write(data)
            at += len(data)
            return at - len(data), len(data)

        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            while first is not None:
                block = [first, *islice(rows, BLOCK_LINES - 1)]
                place = put(out, "\n".join(f"{k} {json.dumps({'page_id': p, 'filename': f, 'offset': o, 'length': n})}" for k, p, f, o, n in block))
                entries.append((block[0][0], block[-1][0], *place))
                first = next(rows, None)
                if len(entries) == PAGE or first is None:
                    found.append((entries[0][0], entries[-1][1], name, *put(out, json.dumps(entries))))
                    entries = []
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["first", "last", "file", "offset", "length"])

    n = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(lean(run), "first string, last string, file string, offset long, length long"), "directory")


def read_part(fs, path: str, offset: int, length: int) -> str:
    with fs.open_input_file(path) as file:
        return zlib.decompress(file.read_at(length, offset)).decode()


def read_block(fs, path: str, offset: int, length: int) -> list[tuple[str, dict]]:
    out = []
    for line in read_part(fs, path, offset, length).split("\n"):
        url, page, rest = line.split(" ", 2)
        out.append((f"{url} {page}", json.loads(rest)))
    return out


def overlapping(parts: list[tuple], key: str):
    """Numbers of the sorted parts (first, last, ...) that may hold ``key``, by bisection."""
    k = bisect.bisect_left(parts, key, key=lambda x: x[1])
    while k < len(parts) and parts[k][0] <= key:
        yield k
        k += 1


def look_up(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """All captures (LINE) of distinct keys (column key): bisection in the pages, in a page, and in a block, or in more where a key goes on.

    Keys come sorted, so that a task reads each page and block once.
    """
    spark = keys.sparkSession
    table = spark.sparkContext.broadcast([tuple(r) for r in directory.orderBy("first", "last", "file", "offset").collect()])

    def run(batches):
        pages = table.value
        fs, base = filesystem(folder)
        page: tuple[int, list] = (-1, [])
        block: tuple[tuple, list] = ((), [])
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                for p in overlapping(pages, key):
                    file = pages[p][2]
                    if page[0] != p:
                        page = (p, json.loads(read_part(fs, f"{base}/{file}", *pages[p][3:])))
                    for b in overlapping(page[1], key):
                        place = (file, *page[1][b][2:])
                        if block[0] != place:
                            block = (place, read_block(fs, f"{base}/{file}", *place[1:]))
                        lines = block[1]
                        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                        while at < len(lines) and lines[at][0] == key:
                            x = lines[at][1]
                            out.append((key, x["page_id"], x["filename"], x["offset"], x["length"]))
                            at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(lean(run), LINE)


def read_records(lines: DataFrame, folder: str) -> DataFrame:
    """Range reads of the captures' records; what each says of its payload (FOUND). Responses are digested anew and checked."""

    def run(batches):
        fs, base = filesystem(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, fs.open_input_file(f"{base}/{path}")
                warc, http, payload = parse(gzip.decompress(file.read_at(length, offset)))
                page = lambda field: int(x) if (x := warc.get(field, "<urn:page:>")[10:-1]) else None
                digest = base64.b32decode(warc["WARC-Payload-Digest"][5:]).hex()
                if warc["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {path} at {offset} does not match its digest")
                out.append((page("WARC-Record-ID"), int(http["Content-Length"]), digest, warc["WARC-Type"], page("WARC-Refers-To")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return lines.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(lean(run), FOUND)


def keys_of(pages: DataFrame) -> DataFrame:
    """Distinct capture keys of (page_id, url)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line_key(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.string())], names=["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "key string").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: write every page, look every page up in the index, read its record back.

    Null html is an empty payload; null urls and page_ids are stored and found as such; repeated rows give a record each; very long
    html is one record. An empty table gives no rows; other columns, of any names, are not read.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_dir(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    directory = write_index(captures, f"{folder}/index")
    lines = written(look_up(keys_of(pages), directory, f"{folder}/index"), "lines")
    return read_records(lines, f"{folder}/archives")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
