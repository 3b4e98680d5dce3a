"""Panels from files or tables; results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATIVE = ("csv", "json", "parquet", "orc")


def read_panel(spark: SparkSession, path: str, kind: str = "csv", names: dict[str, str] | None = None, schema: str | None = None, query: str | None = None) -> DataFrame:
    """A panel from csv, json, parquet or orc files or from ``sql`` (a query or table of the session).

    ``names`` maps i, j, t, y, w, g to the source's columns; only those columns are read.
    """
    if kind in NATIVE:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    elif kind == "sql":
        df = spark.sql(query or f"SELECT * FROM {path}")
    else:
        raise ValueError(kind)
    kinds = {"i": "long", "j": "long", "t": "long", "y": "double", "w": "double", "g": "int"}
    return df.select(*[F.col(c).cast(kinds[k]).alias(k) if k in kinds else F.col(c).alias(k) for k, c in names.items()]) if names else df


def read_leverages(spark: SparkSession, paths: str | list[str], keys: tuple[str, ...] = ("i", "j", "t"), value: str = "pii", kind: str = "parquet") -> DataFrame:
    """(keys, leverage): the mean over all files (a glob, say) that give a leverage for the same row; a file's nulls do not count.

    Joined to a panel on its keys it gives the column of leverages that the corrections take.
    """
    if kind not in NATIVE:
        raise ValueError(kind)
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    some = [paths] if isinstance(paths, str) else list(paths)
    return reader.format(kind).load(some).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("leverage"))


def write_result(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result table as JSON lines."""
    result.write.mode(mode).json(path)
