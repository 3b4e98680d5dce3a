"""Mixing sources to target weights (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, with_row, written

#: A rate table of up to so many sources is broadcast (about 100 bytes each); a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, size): one row for each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the total; a target stops at
    ``max_repeats`` times its source's size and the excess is shared again by weight. In order of size
    over weight the sources that stop come first, so that running sums give the common level. Documents
    are aggregated before: the windows see one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_documents"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_rest", F.sum("weight").over(rest))
        .withColumn("stops", F.col("cap") * F.col("w_rest") <= F.col("left") * F.col("weight"))
        .withColumn("rank", F.row_number().over(order))
    )
    # The level holds from the first source that does not stop.
    first = F.min(F.when(~F.col("stops"), F.struct("rank", "left", "w_rest"))).over(whole)
    per = per.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("first.left") / F.col("first.w_rest")
    )
    return per.select("source", "source_size", "weight", target.alias("target"))


def with_copies(docs: DataFrame, size: str, max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """(row, size, source_size, target, rate, copies): each whole row of ``docs`` (doc_id, source, ``size``, more columns of any names) and how often it is taken.

    rate = target / source_size; a document is taken floor(rate) times, and once more if a number that
    depends on its doc_id alone lies below the fraction: reruns and lost executors give the same copies.
    Rows with equal doc_id share that number. A null doc_id is a key of its own. A source without words
    has target 0 and is not taken. An empty table gives no rows.
    """
    rates = written(source_targets(docs.select("source", F.col(size).alias("size")), max_repeats), "rates").drop("weight")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    extra = (uniform(F.col("row.doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    own = with_row(docs, size=F.col(size)).join(rates, F.col("row.source").eqNullSafe(F.col("source"))).drop("source")
    return own.withColumn("rate", rate).withColumn("copies", F.floor("rate") + extra)


def mix(docs: DataFrame, max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mixture itself: each document as many times as it is taken, with the columns of ``docs``.

    Null text has size 0; an empty table gives an empty mixture; extra columns stay as they are.
    """
    sized = docs.select("doc_id", "source", n_words().alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    kept = with_copies(sized, "size", max_repeats, seed).where("copies > 0").select("row.whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return kept.select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: size, target and words taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = written(docs.select("doc_id", "source", n_words().alias("size")), "sizes")
    return with_copies(sizes, "size").select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, 3 * source_size AS cap,
  (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s0),
fill(k, level_n, level_d, n_above) AS (
  SELECT 0, (SELECT CAST(sum(source_size) AS BIGINT) FROM s), (SELECT CAST(sum(weight) AS BIGINT) FROM s), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT k + 1,
    (SELECT CAST(sum(source_size) - coalesce(sum(CASE WHEN cap * level_d <= level_n * weight THEN cap END), 0) AS BIGINT) FROM s),
    (SELECT CAST(coalesce(sum(CASE WHEN cap * level_d > level_n * weight THEN weight END), 0) AS BIGINT) FROM s),
    (SELECT count(*) FROM s WHERE cap * level_d <= level_n * weight)
  FROM fill WHERE k < 60 AND level_d > 0),
last AS (SELECT level_n, level_d FROM fill WHERE level_d > 0 ORDER BY k DESC LIMIT 1),
t AS (SELECT source, source_size,
  CASE WHEN cap * level_d <= level_n * weight THEN CAST(cap AS DOUBLE) ELSE weight * level_n / level_d END AS target FROM s, last),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
     < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
