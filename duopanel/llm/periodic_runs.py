"""Periodic runs of words and their collapse (operator 11).

A run is a stretch of words whose smallest period it holds at least TURNS times and that no neighbouring word extends. Periods are
searched octave by octave. For the octave of the periods lo..hi-1 a document is exploded into overlapping tiles around boundaries
``step`` words apart: a run of such a period always holds a boundary and one period after it. At a boundary, two Z-functions
(of the words after it, and of the reversed words around it) give for every period how far the equal words reach to either side. Tiles are dealt out and
solved on their own; what they find of a run ends at their edges, and fragments of one document and period that touch are one run.

Only tiles that can hold a piece of a run leave the task of their document: within ``step`` of a boundary, a run shows either the same
eight (from period 16 on: sixteen) words right after or right before the boundary and one period later, which one pass over hashes of
all grams sees. Equal grams have equal hashes, so nothing is lost; the Z-functions compare words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, blocks, first_equal, lean, mix64, ragged, utf8, words, written

#: Fewest words of a run, and periods that it holds at least.
LEAST, TURNS = 24, 3
#: Words of a gram that marks tiles.
GRAM = 8
#: The first octave: its periods (below the last) and the words between its boundaries.
BASE, BASE_STEP = 8, 16
#: Bytes of text searched together, pairs of a boundary and a period compared at once, bytes of tiles in one batch.
BLOCK, PAIRS, BATCH = 2 << 20, 1 << 18, 2 << 20
_CODE = np.uint64(0x9E3779B97F4A7C15)

FOUND = "kind int, doc_id long, digest binary, text string, lo long, c long, at long, words binary"
_FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("text", pa.string()), ("lo", pa.int64()), ("c", pa.int64()), ("at", pa.int64()), ("words", pa.binary())])
KEY = ["doc_id", "digest"]
RUNS = "array<struct<start:long,length:long,period:long>>"


def octaves(n: int, turns: int):
    """(first period, last period + 1, words between boundaries) of the octaves that a document of ``n`` words needs."""
    yield 1, BASE, BASE_STEP
    lo = BASE
    while turns * lo <= n:
        yield lo, 2 * lo, 2 * lo
        lo *= 2


def grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on (of zeros beyond the end)."""
    h, step = mix64(ids.astype(np.uint64) + np.uint64(1)), 1
    while step < GRAM:
        after = np.zeros_like(h)
        after[:-step] = h[step:]
        h = mix64(h * _CODE + after)
        step *= 2
    return h


def marked(ids: np.ndarray, first: np.ndarray, least: int = LEAST, turns: int = TURNS):
    """(lo, hi, step, document, boundary) arrays of the tiles that may hold a piece of a run; words of document d are first[d]..first[d + 1] - 1."""
    n = np.diff(first)
    if not len(n):
        return
    g = grams(ids)
    last = len(g) - 1
    for lo, hi, step in octaves(int(n.max()), turns):
        docs = np.flatnonzero(n >= max(least, turns * lo))
        if not len(docs):
            continue
        count = (n[docs] - lo) // step + 1
        doc, c = np.repeat(docs, count), ragged(np.zeros(len(docs), np.int64), count) * step
        # Equal words reach at least so far around the boundary, so half of it to one side.
        far = GRAM if lo < 2 * GRAM else 2 * GRAM
        q, size = np.arange(lo, hi), max(1, PAIRS // (hi - lo))
        for k in range(0, len(doc), size):
            own, cut = doc[k : k + size], c[k : k + size]
            at, end = (first[own] + cut)[:, None], first[own + 1][:, None]
            to = at + q
            after = to + far <= end
            before = (cut[:, None] >= far) & (to <= end)
            for step_on in range(0, far, GRAM):
                after &= g[np.minimum(at + step_on, last)] == g[np.minimum(to + step_on, last)]
                before &= g[np.maximum(at - far + step_on, 0)] == g[np.clip(to - far + step_on, 0, last)]
            hit = (after | before).any(axis=1)
            if hit.any():
                yield lo, hi, step, own[hit], cut[hit]


def search(docs: DataFrame, clean: bool, least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """One pass over whole texts: with ``clean``, the documents without a marked tile (kind 0, their words joined by one space); else those
    with one (kind 1, the text as it is) and their marked tiles (kind 2: octave, boundary, first word and words as numbers)."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                yield from one(batch.column(0)[a:b], batch.column(1)[a:b])

    def one(doc_id, texts):
        buf, offs = utf8(texts)
        starts, ends, first = words(buf, offs)
        ids = first_equal(buf, starts, ends).astype("<i4")
        tiles = list(marked(ids, first, least, turns))
        has = np.zeros(len(texts), bool)
        for _, _, _, own, _ in tiles:
            has[own] = True
        raw, keys = memoryview(buf), {}
        for kind in (0,) if clean else (1,):
            docs = np.flatnonzero(has if kind else ~has)
            data = [bytes(raw[offs[d] : offs[d + 1]]) for d in docs.tolist()]
            if kind:
                keys = {d: hashlib.blake2b(x, digest_size=16).digest() for d, x in zip(docs.tolist(), data)}
            text = pa.array([x if kind else b" ".join(x.split()) for x in data], pa.binary()).cast(pa.string())
            yield rows(len(docs), kind=kind, doc_id=doc_id.take(pa.array(docs)), text=text, digest=pa.array([keys.get(d) for d in docs.tolist()], pa.binary()))
        if clean:
            return
        held, size = [], 0
        for lo, hi, step, own, cut in tiles:
            low, high = np.maximum(first[own], first[own] + cut - step), np.minimum(first[own + 1], first[own] + cut + step + hi)
            for d, c, x, y in zip(own.tolist(), cut.tolist(), low.tolist(), high.tolist()):
                held.append((d, lo, c, x - int(first[d]), ids[x:y].tobytes()))
                size += 4 * (y - x)
                if size > BATCH:
                    yield packed(doc_id, held, keys)
                    held, size = [], 0
        if held:
            yield packed(doc_id, held, keys)

    def packed(doc_id, held, keys):
        d, lo, c, at, data = zip(*held)
        return rows(len(d), kind=2, doc_id=doc_id.take(pa.array(d)), digest=pa.array([keys[k] for k in d], pa.binary()), lo=pa.array(lo, pa.int64()), c=pa.array(c, pa.int64()), at=pa.array(at, pa.int64()), words=pa.array(data, pa.binary()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(lean(run), FOUND)


def rows(n: int, kind: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.array([kind] * n, pa.int32()) if f.name == "kind" else pa.nulls(n, f.type)) for f in _FOUND], schema=_FOUND)


def z_function(s: list[int], most: int) -> list[int]:
    """For the shifts below ``most``: how many values from the shift on equal the first ones (0 for shift 0)."""
    n = len(s)
    most = min(most, n)
    z, left, right = [0] * most, 0, 0
    for i in range(1, most):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


def solve_tile(s: list[int], c: int, lo: int, hi: int, step: int, least: int = LEAST, turns: int = TURNS) -> list[tuple[int, int, int]]:
    """Fragments (period, from, to) in a tile ``s`` around its word ``c``: words from..to-1 each equal the word one period later.

    Kept are those long enough for a run, and those of ``step`` words, which may go on beyond the tile. A period that is a multiple of a smaller
    one is left out: a run of it is one of the smaller period.
    """
    most = min(hi, len(s) - c + 1)
    if most <= lo:
        return []
    z = z_function(s[c:], most) + [0]
    before = s[:c][::-1]
    around = z_function([*before, -1, *s[: c + most - 1][::-1]], c + most)
    out = []
    for q in range(lo, most):
        right, left = min(z[q], step), min(around[c + most - q], step)
        if right + left >= min(step, max(least, turns * q) - q) and not any(z[q // r] >= q - q // r for r in prime_factors(q)):
            out.append((q, c - left, c + right))
    return out


def prime_factors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return [*out, q] if q > 1 else out


def runs_of(tiles: DataFrame, least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """(doc_id, digest, runs) of the documents with runs, from marked tiles: tiles solved where they are dealt, fragments stitched by document and period.

    The runs of a document are sorted by start, then period; there are fewer than words. Equal fragments (of repeated rows) are one before the stitching.
    """

    def run(batches):
        for batch in batches:
            doc, digest, out = batch.column(0), batch.column(1), []
            lo_, c_, at_ = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for k, (lo, c, at) in enumerate(zip(lo_, c_, at_)):
                data = batch.column(5)[k].as_buffer()
                hi, step = (BASE, BASE_STEP) if lo < BASE else (2 * lo, 2 * lo)
                out += [(k, q, x + at, y + at) for q, x, y in solve_tile(np.frombuffer(data, "<i4").tolist(), c - at, lo, hi, step, least, turns)]
            k, q, x, y = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(k)), digest.take(pa.array(k)), pa.array(q), pa.array(x), pa.array(y)], names=[*KEY, "period", "x", "y"])

    dealt = tiles.select(*KEY, "lo", "c", "at", "words").repartition(*KEY, "lo", "c")
    pieces = dealt.mapInArrow(lean(run), "doc_id long, digest binary, period long, x long, y long").distinct()
    order = Window.partitionBy(*KEY, "period").orderBy("x", "y")
    reach = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("new", F.when(F.col("x") <= reach, 0).otherwise(1)).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy(*KEY, "period", "k").agg(F.min("x").alias("start"), (F.max("y") - F.min("x") + F.col("period")).alias("length"))
    whole = whole.where((F.col("length") >= least) & (F.col("length") >= turns * F.col("period")))
    return whole.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")).select(*KEY, F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(RUNS).alias("runs"))


def collapse(data: bytes, runs: list[dict]) -> bytes:
    """The words of ``data`` joined by one space, without those that stand in a run after its first period."""
    own = data.split()  # by the bytes of SPACES
    edge = np.zeros(len(own) + 1, np.int64)
    for r in runs:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([x for x, k in zip(own, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs`` (doc_id, text): its runs as (start, length, period), by start, then period, and its text with each run cut to one period.

    Whole texts of any length are searched; null and empty texts have no runs and an empty collapse. A null or repeated doc_id is an
    identity like any other: runs belong to doc_id and text, so rows of one doc_id with different texts keep their own, and repeated rows each
    get the same result. An empty table gives no rows. Other columns, whatever their names, are not read. ``least`` is 24 or more and ``turns`` 3 or more, else ValueError.
    """
    if least < LEAST or turns < TURNS:
        raise ValueError(f"runs of fewer than {LEAST} words or {TURNS} periods may miss all boundaries")
    found = written(search(docs, False, least, turns), "periodic")
    runs = runs_of(found.where("kind = 2"), least, turns)

    def finish(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK):
                raw, offs = utf8(batch.column(1)[a:b])
                raw, own = memoryview(raw), batch.column(2)[a:b]
                text = [collapse(bytes(raw[x:y]), r or []) for x, y, r in zip(offs[:-1].tolist(), offs[1:].tolist(), own.to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], own, pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    texts = found.where("kind = 1").select(*KEY, "text").alias("t").join(runs.alias("r"), F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.digest") == F.col("r.digest")), "left")
    with_runs = texts.select("t.doc_id", "t.text", F.coalesce("r.runs", F.array().cast(RUNS)).alias("runs")).mapInArrow(lean(finish), f"doc_id long, runs {RUNS}, collapsed string")
    without = search(docs, True, least, turns).select("doc_id", F.array().cast(RUNS).alias("runs"), F.col("text").alias("collapsed"))
    return with_runs.unionByName(without)


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's text: for a tenth of the documents, by crc32 of the doc_id, the words from one on repeat with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        m = n - a
        p = (F.floor(m / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.floor(m / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), again, F.slice(w, a + 1, F.pmod(m, p))), " ")

    # The words are bound by a lambda, so that they are taken once, and only of the rows that are edited.
    words_once = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), edited)
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(WORD), F.get(words_once, F.lit(0))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: number of runs, the run of the greatest exact exponent, and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    more = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    better = lambda a, b: (more(a, b) > 0) | ((more(a, b) == 0) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda top, r: F.when(better(r, top), r).otherwise(top))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


SQL = r"""
WITH d0 AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 1, 2, 3, 4, 5, 6, 7]), lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END))) END AS h
  FROM documents),
d1 AS (SELECT k, doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0),
d AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d1),
x AS (SELECT k, unnest(range(n)) AS i, w, a, p FROM d WHERE n > 0),
t AS (SELECT k, i, w[1 + CASE WHEN a IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM x),
same AS (SELECT u.k, u.i AS i, v.i - u.i AS q FROM t u JOIN t v ON u.k = v.k AND u.word = v.word AND u.i < v.i),
isle AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS part FROM same),
stretch AS (SELECT k, q, min(i) AS s, count(*) + q AS len FROM isle GROUP BY k, q, part HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM stretch r WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.k = r.k AND o.s = r.s AND o.len = r.len AND o.q < r.q AND r.q % o.q = 0)),
best AS (SELECT r.* FROM runs r QUALIFY row_number() OVER (PARTITION BY r.k ORDER BY CAST(r.len AS DECIMAL(18, 0)) / r.q DESC, r.s, r.q) = 1),
listed AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT t.k, string_agg(t.word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON t.k = gone.k AND t.i = gone.i GROUP BY t.k)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.len AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST((1000 * best.len) // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed ON d.k = listed.k LEFT JOIN best ON d.k = best.k LEFT JOIN kept ON d.k = kept.k
"""
