"""Document fingerprints by one-permutation MinHash (operator 3), in DataFrame operations alone.

Each shingle of five words is hashed once; the top bits of the hash name one of BINS bins, the rest is its
value, and each bin keeps its least value. An empty bin takes the value of another by optimal densification:
it tries bins in a pseudo-random order of its own until one is filled, and hashes that value with its own number, so
that the bits of short texts are independent. Stored are the low 4 bits of each
value, as one hex digit; a share of 1/16 of equal digits comes by chance and is taken out of the likeness.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, written

SHINGLE = 5
BINS = 256
#: Bits of a hash that hold the value; the bits above are the bin.
SHIFT = 56
LOW = (1 << SHIFT) - 1
#: Pseudo-random bins that an empty bin tries by table before all filled bins are ranked for it.
PROBES = 16
#: Rows of one window partition, about.
ROWS_TOGETHER = 2000
#: Quantiles of doc_id between which rows are dealt into partitions of equal width.
QUANTILES = 64


def _probes() -> list[int]:
    """Bins tried by bin i at i * PROBES ...: a linear congruential sequence for each bin."""
    out = []
    for i in range(BINS):
        x = (i * 2654435761 + 12345) % (1 << 32)
        for _ in range(PROBES):
            x = (x * 1664525 + 1013904223) % (1 << 32)
            out.append(x >> 24)
    return out


def with_fingerprint(df: DataFrame, text: str, out: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and ``out``, the fingerprint of ``text``: BINS hex digits, or '' for a text without words.

    A-Z are lower-cased; fewer than five words are one shingle; null text is empty; repeated shingles count once.
    """
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, f"[{WORD[2:-2]}]+"), lambda w: w != "")
    step = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    w = F.col("_w")
    shingles = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.least(F.size(w), F.lit(1)))),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]),
    )
    # A guard with the largest value stands in each bin, so that sorting leaves exactly one first value for each bin.
    guards = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), SHIFT).bitwiseOR(F.lit(LOW)))
    step = step.select(*keep, F.size(w).alias("_n"), F.sort_array(F.concat(shingles, guards)).alias("_s"))
    s = F.col("_s")
    bin_of = lambda x: F.shiftright(x, SHIFT)
    firsts = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    step = step.select(*keep, "_n", firsts.alias("_f"))
    f = F.col("_f")
    filled = lambda x: x.bitwiseAND(F.lit(LOW)) != F.lit(LOW)
    table = F.lit(_probes())
    tried = lambda i: F.get(F.filter(F.transform(F.slice(table, i * PROBES + 1, F.lit(PROBES)), lambda j: F.get(f, j)), filled), F.lit(0))
    ranked = lambda i: F.array_min(F.transform(F.filter(f, filled), lambda v: F.struct(F.xxhash64(i, bin_of(v)).alias("r"), v.alias("v"))))["v"]
    digit = lambda v: F.substring(F.lit("0123456789abcdef"), v.bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1))
    dense = F.transform(f, lambda v, i: digit(F.when(filled(v), v).otherwise(F.xxhash64(F.coalesce(tried(i), ranked(i)), i))))
    return step.select(*keep, F.when(F.col("_n") > 0, F.array_join(dense, "")).otherwise("").alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index from two fingerprints: share of equal digits, freed from chance, in [0, 1]."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same / BINS - 1 / 16) / (1 - 1 / 16)))


def _buckets(ids: DataFrame) -> Column:
    """An expression of doc_id that rises with it and deals rows out in runs of about ROWS_TOGETHER; null is lowest."""
    found = ids.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 10_000).alias("q")).first()
    bounds = sorted(set(found["q"] or [0]))
    each = max(1, math.ceil(found["n"] / ROWS_TOGETHER / max(1, len(bounds) - 1)))
    i, q = F.col("doc_id"), F.lit(bounds)
    at = F.greatest(F.size(F.filter(q, lambda x: x <= i)) - 1, F.lit(0))
    low, high = F.get(q, at), F.coalesce(F.get(q, at + 1), F.get(q, at) + 1)
    part = F.least(F.greatest(F.floor((i - low).cast("double") / (high - low).cast("double") * each), F.lit(0)), F.lit(each - 1))
    return F.coalesce(at.cast("long") * each + part, F.lit(-1))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with next_<c> for each of ``columns``: its value in the next row by descending doc_id (null last), after the last row that of the first.

    Rows of equal doc_id follow each other by text. Rows are dealt into runs of doc_ids; the first rows of each run also go,
    as guests, to the run before it, so that one shuffle is enough and no window sees more than a run.
    """
    ids = df.select("doc_id")
    bucket = _buckets(ids)
    heads = ids.select("doc_id", bucket.alias("_bucket")).groupBy("_bucket").agg(F.max("doc_id").alias("_head"))
    around = Window.orderBy(F.col("_bucket").desc())
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = written(heads.select("_head", F.coalesce(F.lag("_bucket").over(around), F.last("_bucket").over(whole)).alias("_before")), "heads")
    dealt = df.withColumn("_bucket", bucket)
    if heads.count() <= 100_000:  # about 20 bytes each
        heads = F.broadcast(heads)
    dealt = dealt.join(heads, F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    # _guest: 0 own row; 1 guest from the next run. The run of the lowest doc_ids has the very first rows as guests.
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g"))
    guest = F.struct(F.col("_before").alias("b"), F.lit(1).alias("g"))
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    order = Window.partitionBy("_run").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    out = dealt.select(*df.columns, F.col("_at.b").alias("_run"), F.col("_at.g").alias("_guest"))
    return out.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("_guest = 0").drop("_run", "_guest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: fingerprints of each text and of its edited text, and their likeness to each other and to the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = with_next(with_fingerprint(docs, "text", "fingerprint", ["doc_id", "text"]), ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    own = own.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    keep = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "next_fingerprint"]
    both = with_fingerprint(own.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint", keep)
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
