"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the
columns of ``documents``. Toxic documents go; of near duplicates one stays; long repeated passages are cut out of the
texts; sources are mixed to their target weights; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duopanel.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from duopanel.llm.common import written
from duopanel.llm.tokens import vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of operator 2, fitted on the labelled ones among them."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 8)."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that an earlier document holds too (operator 1)."""
    cut = suffix_dedup.deduplicate(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for (operator 9)."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens (operator 7)."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard", one_of_each_group),
    ("suffix", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL can express the trained, iterative and tokenizing stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
